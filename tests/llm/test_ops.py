"""Each operator on the small tables and on edge tables, against brute force, exact round trips or SQL."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, rows
from tidemark.llm import embedding_dedup, html_text, jaccard_join, mixing, packing, quality, queries, suffix_dedup, token_files, url_filter, warc
from tidemark.llm.common import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"w{k}" for k in range(60))
#: Nulls, empty and odd texts, ties and repeated rows.
EDGE = [
    (1, BASE, "a"), (2, BASE, "a"), (2, BASE, "a"), (3, BASE + " more", None), (4, None, None), (5, "", "b"), (6, " \n\t ", "b"), (None, BASE, "b"), (7, "one two", "a"), (8, "ONE  two", "a"),
    (9, "x\xa0y <|endoftext|> 　z", "b"), (10, "é" * 200, "b"), (11, "a " * 4000, "c"), (12, "é" * 200 + "q", "c"), (13, "ab\ncd\nab\nab  \n\nab", "a"),
]


@pytest.fixture(scope="module")
def edge(spark):
    """With columns that clash with those of results."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, source string")
    return df.withColumns({"size": F.lit("mine"), "start": F.lit("mine"), "component_id": F.lit(7), "kept": F.lit("x"), "_id": F.lit(1), "_text": F.lit("t"), "bucket": F.lit(0)})


@pytest.fixture(scope="module")
def small(spark):
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).execute(queries.ORACLE_SQL[name]).df())


def pieces_hold(got: pd.DataFrame, texts: dict, size: int = 1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = got.sort_values(["sequence_id", "offset"])
    end = got.offset + got.length
    assert (end.groupby(got.sequence_id).shift(1).fillna(0) == got.offset).all() and end.max() <= size
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = got[got.doc_id == doc_id].sort_values("piece").drop_duplicates("piece")
        assert mine.start.tolist() == (mine.length.cumsum() - mine.length).tolist() and mine.length.sum() == len(ids)
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n]) for a, n in zip(mine.start, mine.length)]
        assert (mine.length.iloc[1:] == size).all()


def test_packing(spark, edge, small):
    got = packing.query(spark, SF).toPandas()
    pieces_hold(got, dict(zip(small.doc_id, small.text)))
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 1024)
    got = packing.packed(edge, packing.tokenizer_path()).toPandas()
    pieces_hold(got, {i: t for i, t, _ in EDGE if i})
    assert len(got[got.piece == 0]) == len(EDGE)
    assert packing.packed(edge.limit(0), packing.tokenizer_path()).count() == 0
    whole = packing.sequences(packing.packed(edge, packing.tokenizer_path(), with_ids=True))
    assert whole.agg(F.sum(F.size("ids"))).first()[0] == got.length.sum()


def test_fullest_combination_against_all_subsets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 20, 5)}
        items, room, best = [k for k, n in counts.items() for _ in range(n)], int(rng.integers(1, 60)), 0
        for mask in range(1 << len(items)):
            total = sum(x for k, x in enumerate(items) if mask >> k & 1)
            best = max(best, total if total <= room else 0)
        uses = packing.fullest(counts, room)
        assert sum(k * n for k, n in uses.items()) == best and all(n <= counts[k] for k, n in uses.items())


def test_html(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = html_text.query(spark, SF).toPandas().set_index("page_id")
    import html

    for i, page in zip(pages.page_id, pages.html):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
        assert got.text[i] == want and got.n_chars[i] == len(want)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a &lt;b&gt; <script>x"), (4, "<!-- open"), (5, "plain & simple")], "page_id long, html string").withColumn("text", F.lit(1))
    assert {r.page_id for r in html_text.extracted(odd).collect()} == {1, 2, 3, 4, 5}
    assert {r.text for r in html_text.extracted(odd.filter("page_id < 3")).collect()} == {""}
    assert html_text.extracted(odd.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "found"),
    [
        ("one<svg-icon name=x></svg-icon>two", ["one", "two"]), ("a<svg width=1 />b", ["ab"]), ("<p>Let <math><mi>x</mi></math> be<p>b", ["Let x be", "b"]),
        ("a<object>ob</object><canvas>cc</canvas>", ["aobcc"]), ("<script>if(a<b)</script >c", ["c"]), ("1 < 2 <3 & x<a", ["1 < 2 <3 & x<a"]), ("<noscript>never closed", ["never closed"]),
        ("<a title='x>y'>t</a>", ["t"]), ("<video-player>q</video-player>r", ["q", "r"]), ("a<!-->b", ["ab"]), ("a<script>open", ["a"]),
    ],
)
def test_blocks_of_odd_markup(page, found):
    assert html_text.blocks(page)[0] == found


@pytest.mark.parametrize("piece", ["<a", "x <a ", '<a "', "<a \"<a'", "<div>x", "</div>", "<noscript>", "<script></script ", "<!--", '<p class="', "<p>x<b>"])
def test_reading_takes_time_in_proportion(piece):
    import time

    start = time.perf_counter()
    html_text.blocks(piece * 20_000)
    html_text.blocks("<i>" * 20_000 + piece * 20_000 + ">")
    assert time.perf_counter() - start < 4


def held_out(model, n: int = 150) -> float:
    """Share of blocks that are labelled right on invented pages of another seed."""
    rng = np.random.default_rng(99)
    made = [html_text.invented(rng) for _ in range(n)]
    cut = [html_text.blocks(page) for page, _ in made]
    truth = np.array([any(w.rstrip(".,") in own for w in text.split()) for (_, own), (found, _) in zip(made, cut) for text in found])
    return (model.labels(*html_text.vectors(cut)) == truth).mean()


def test_stored_labeller_on_held_out_pages():
    with np.load(html_text.STORED) as held:
        assert int(held["version"]) == html_text.VERSION
    assert held_out(html_text.labeller()) > 0.98


def test_training_gives_a_labeller():
    assert held_out(html_text.train(300, 8)) > 0.93


def test_lstm_gradient_against_differences():
    rng = np.random.default_rng(5)
    x, mask, truth = rng.standard_normal((4, 3, html_text.SIZE)).astype(np.float32), np.ones((4, 3), np.float32), (rng.random((4, 3)) > 0.5).astype(np.float32)
    mask[2:, 1] = 0
    model = html_text.Labeller(1)
    grad = model.gradients(x, mask, truth)[1]
    for name in ("hf", "xb", "bb", "out_b2"):
        k = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        old, step = model.w[name][k], 1e-2
        model.w[name][k] = old + step
        up = model.gradients(x, mask, truth)[0]
        model.w[name][k] = old - step
        down = model.gradients(x, mask, truth)[0]
        model.w[name][k] = old
        assert abs((up - down) / (2 * step) - grad[name][k]) < 0.03 * abs(grad[name][k]) + 1e-4


def shingles(text) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def linked_components(sets: dict) -> dict:
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted, both = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for v in inverted.values():
        for k, a in enumerate(v):
            for b in v[:k]:
                both[min(a, b), max(a, b)] += 1
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("max_sets", [2000, 2])
def test_jaccard_join(spark, edge, small, max_sets):
    sets = {i: shingles(t) for i, t in zip(small.doc_id, small.text)}
    got = jaccard_join.joined(spark.read.parquet(f"{SF}/documents.parquet"), max_sets=max_sets, pivots=2).toPandas().set_index("doc_id")
    assert got.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()} and got.component_id.to_dict() == linked_components(sets)


def test_jaccard_join_edges(spark, edge):
    got = jaccard_join.joined(edge).toPandas()
    want = linked_components({i: shingles(t) for i, t, _ in EDGE if i is not None})
    assert len(got) == len(EDGE) and got[got.doc_id.isna()].component_id.isna().all()
    known = got.dropna(subset="doc_id")
    assert dict(zip(known.doc_id.astype(int), known.component_id.astype(int))) == want
    assert jaccard_join.joined(edge.limit(0)).count() == 0


def test_linked_sets_are_connected_by_prefix_tokens():
    """Whatever the order of tokens is; among them one whose upper half is zero."""
    rng = np.random.default_rng(11)
    rank = rng.integers(jaccard_join.ALONE + 1, 9, 1 << jaccard_join.LEAST_BITS).astype(np.uint8)
    n_linked = 0
    for _ in range(400):
        n = int(rng.integers(1, 40))
        core = np.append(rng.integers(0, 2**63, n).astype(np.uint64), np.uint64(12345))
        sets = [np.unique(np.append(np.where(rng.random(len(core)) < 0.04, rng.integers(0, 2**63, len(core)).astype(np.uint64), core), rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64))) for _ in range(2)]
        both = len(np.intersect1d(*sets))
        if 100 * both >= 80 * (len(sets[0]) + len(sets[1]) - both):
            n_linked += 1
            parts = [jaccard_join.prefix(s, rank, 80) for s in sets]
            token, short = (np.concatenate(x) for x in zip(*parts))
            n_each = [len(p[0]) for p in parts]
            pairs = jaccard_join.near_runs(token, np.repeat([len(s) for s in sets], n_each), np.repeat([1, 2], n_each), short, 80)
            assert len(pairs) or len(sets[0]) == both == len(sets[1])
    assert n_linked > 60


def test_gaps():
    rng = np.random.default_rng(3)
    for at in (np.zeros(0, np.int64), np.array([0]), np.array([65535]), np.array([254, 255, 510, 765]), np.unique(rng.integers(0, 65536, 300))):
        assert (jaccard_join.places(np.frombuffer(jaccard_join.gaps(at), np.uint8)) == at).all()


def test_hashes_of_crafted_words():
    """Two long words whose sums of bytes times powers agree in 64 bits: ids and shingles stay apart."""
    from tidemark.llm.tokens import Encoder

    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    sets = jaccard_join.token_sets(pa.array([word, other]), 5)
    assert len(np.intersect1d(*sets)) == 0
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode, texts = Encoder(packing.tokenizer_path(name)), [word, other, f"x {other} y {word}"]
        ids, at = encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_compares_bytes_on_equal_hashes(monkeypatch, small):
    from tidemark.llm import tokens

    real = tokens.words_hashes
    monkeypatch.setattr(tokens, "words_hashes", lambda *a: real(*a) % np.uint64(50))
    encode = tokens.Encoder(packing.tokenizer_path())
    for part in (small.text[:20], small.text[20:40]):
        ids, at = encode(pa.array(list(part)))
        for k, text in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == encode.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_tree_drops_no_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        core = rng.integers(0, 2**63, int(rng.integers(1, 60))).astype(np.uint64)
        sets += [np.unique(np.where(rng.random(len(core)) < 0.08, rng.integers(0, 2**63, len(core)).astype(np.uint64), core)) for _ in range(4)]
    label = list(range(len(sets)))
    want = set()
    for a in range(len(sets)):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                want.add((b, a))
    for pairs in (want, jaccard_join.links(sets, 80)):
        label = list(range(len(sets)))
        for a, b in pairs:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        want_labels = label if pairs is want else want_labels
    assert label == want_labels


def test_labels_hold_few_vectors_of_long_pages():
    """One long page among short ones: labels as by the training pass, without padding all to the longest."""
    import tracemalloc

    rng = np.random.default_rng(2)
    n = np.array([3, 0, 2000, 5, *rng.integers(1, 9, 120)])
    at = np.concatenate([[0], np.cumsum(n)])
    x = rng.standard_normal((at[-1], html_text.SIZE)).astype(np.float32)
    model = html_text.Labeller(1)
    model.w["out_x"] = rng.standard_normal(html_text.SIZE).astype(np.float32) * 0.1
    tracemalloc.start()
    got = model.labels(x, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for a, b in zip(at[:-1], at[1:]):
        if b > a:
            z = model.logits(x[a:b, None], np.ones((b - a, 1), np.float32))[0][:, 0]
            assert (got[a:b] == (z > 0))[np.abs(z) > 1e-4].all()
    assert peak < 50e6  # padded to the longest: 124 pages x 2000 blocks


def test_mixing_edges(spark, edge):
    got = mixing.with_copies(edge).toPandas()
    assert len(got) == len(EDGE) and (got.taken <= 2 * got["size"]).all() and (got.target <= 2 * got.source_size).all()
    assert mixing.with_copies(edge.limit(0)).count() == 0 and mixing.mixed(edge).columns == edge.columns
    assert rows(mixing.with_copies(edge).drop("_id").toPandas()) == rows(mixing.with_copies(edge.repartition(5)).drop("_id").toPandas())


def test_mixed_has_each_row_copies_times(spark, small):
    """The share leaves the first sources above their target, so that some documents are dropped."""
    docs = spark.createDataFrame(small[["doc_id", "text", "source"]])
    for share in (0.5, 1.5):
        copies = {r.doc_id: r.copies for r in mixing.with_copies(docs, share=share).collect()}
        got = Counter(r.doc_id for r in mixing.mixed(docs, share=share).collect())
        assert 0 in copies.values() or share > 1
        assert got == Counter({i: n for i, n in copies.items() if n})


def test_mixed_with_clashing_names_and_repeated_rows(spark, edge):
    for share in (0.3, 1.5):
        want = Counter()
        for r in mixing.with_copies(edge, share=share).collect():
            want[r.doc_id, r.text, r.source] += r.copies
        assert Counter((r.doc_id, r.text, r.source) for r in mixing.mixed(edge, share=share).collect()) == +want


def base(text) -> tuple:
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen, cover = defaultdict(list), set()
    for k in range(len(w) - 2):
        seen[tuple(w[k : k + 3])].append(k)
    for v in seen.values():
        if len(v) > 1:
            cover |= {k + j for k in v for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, edge, small):
    got = quality.query(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(small.doc_id, small.text):
        want = base(t)
        assert tuple(got.loc[i, list(quality.BASE)]) == want
        assert got.base_failed[i] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (got.kept[i] and got.base_failed[i])
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").join(got)
    good = labels[(labels.quality == 1) & ~labels.base_failed]
    assert good.kept.mean() > 0.97
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = quality.judged(edge, none).toPandas()
    assert sorted(map(tuple, odd[list(quality.BASE)].itertuples(index=False))) == sorted(base(t) for _, t, _ in EDGE)
    assert (odd.kept == ~odd.base_failed).all() and quality.judged(edge.limit(0), none).count() == 0 and quality.kept(edge, none).columns == edge.columns


def verdicts(docs: list, labels: list, quantile: float = 0.01) -> dict:
    """kept by id, by plain counting document by document; hashing of words apart."""
    grams = {}
    for i, text in docs:
        data, offsets = quality.texts(pa.array([text], pa.string()))
        grams[i] = Counter(quality.buckets(data, offsets)[2].tolist())
    good = {i for i, q, x in labels if q >= 1} - {i for i, q, x in labels if q < 1 or x}
    bad = {i for i, q, x in labels if q <= 0}
    raw, side = Counter(), {i: int(quality.half(np.array([i]))[0]) for i in grams}
    target = [Counter(), Counter()]
    for i, g in grams.items():
        raw.update(g)
        if i in good:
            target[side[i]].update(g)
    size, whole = 1 << quality.BITS, sum(raw.values())

    def score(i):
        own, total = target[1 - side[i]], sum(target[1 - side[i]].values())
        each = [n * np.log((own[b] + max(total, 1) * (raw[b] + 1) / (whole + size)) / (total + max(total, 1)) / ((raw[b] + 1) / (whole + size))) for b, n in grams[i].items()]
        return sum(each) / max(sum(grams[i].values()), 1)

    long = {i for i, t in docs if base(t)[0] >= 50}
    low, mid = np.percentile([score(i) for i in sorted(good & long)], 100 * quantile), np.percentile([score(i) for i in sorted(bad & long)], 50)
    least = min(low, (low + mid) / 2)
    failed = {i for i, t in docs if base(t)[0] < 50 or 100 * base(t)[4] > 50 * base(t)[0]}
    return {i: (i not in failed and score(i) >= least, abs(score(i) - least) < 1e-9) for i, _ in docs}


def test_verdicts_against_brute_force(spark, small):
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    want = verdicts(list(zip(small.doc_id, small.text)), list(zip(labels.doc_id, labels.quality, labels.toxic)))
    got = {r.doc_id: r.kept for r in quality.query(spark, SF).collect()}
    assert set(got) == set(want) and all(got[i] == k for i, (k, tie) in want.items() if not tie)
    assert 0 < sum(got.values()) < len(got)


def test_ratio_against_a_plain_count():
    counts = np.zeros((3, 1 << quality.BITS), np.int64)
    counts[0, :3], counts[1, :3], counts[2, :3] = [6, 3, 1], [3, 0, 0], [2, 1, 0]
    raw = (counts[0] + 1) / (10 + (1 << quality.BITS))
    assert np.allclose(quality.log_ratios(counts)[0, :3], np.log((counts[2, :3] + 3 * raw[:3]) / 6) - np.log(raw[:3]))


def test_quality_uses_all_labels_and_finds_exact_quantiles(spark):
    n = 50_200  # more than the labels that an earlier form took of each kind
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('trusted w', id % 7) AS text")
    marks = quality.labelled(docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    counts = quality.bucket_counts(docs.selectExpr("doc_id AS _id", "text AS _text"), marks)
    assert (counts[0] == counts[1] + counts[2]).all() and counts[0].sum() == 3 * n
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=20_000) ** 9, np.repeat([0.5, -1.0, 2.0], 3000), np.array([4.0])):
        scores = spark.createDataFrame([(float(x),) for x in values], "score double")
        for q in (0.0, 0.01, 0.5, 1.0):
            assert np.isclose(quality.quantile_of(scores, q), np.quantile(values, q), rtol=1e-12, atol=0)
    assert quality.quantile_of(scores.limit(0), 0.5) is None


def test_url_filter_drops_false_hits_and_takes_the_longest(spark):
    bloom = url_filter.BlockedBloom.of(spark.range(500).select(F.xxhash64("id").alias("h")), 12, 1 << 20)
    inside, outside = (spark.range(a, b).select(F.xxhash64("id").alias("h")).toPandas().h.to_numpy() for a, b in ((0, 500), (500, 20_500)))
    assert bloom.has(inside).all() and bloom.has(outside).mean() < 0.03
    urls = [(1, "http://A.example.com/en/7x?q"), (2, "https://x.com/en/1"), (3, "https://xcom/en/1"), (4, None), (5, "no scheme"), (6, "http://b.example.net/de/8#x"), (7, "http://net/de/9"), (7, "http://net/de/9"), (8, "ftp://o.org/ES/")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    for bits in (12, 0):  # with no filter to speak of, the join alone decides
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(df, url_filter.rules_frame(spark), bits_per_key=bits).collect()}
        assert got == {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("example.net/de/8", "allow"), 7: ("net/de/", "block"), 8: (None, "allow")}
    assert url_filter.judged(df.limit(0), url_filter.rules_frame(spark)).count() == 0
    assert url_filter.judged(df, url_filter.rules_frame(spark).limit(0)).filter("verdict <> 'allow'").count() == 0


def test_url_filter_takes_each_rule_as_the_contract_has_it(spark):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    urls = [(k, f"https://{part.split(' ')[1]}") for k, part in enumerate(contract.split(", "))]
    got = {r.page_id: f"{r.verdict} {r.rule}" for r in url_filter.judged(spark.createDataFrame(urls, "page_id long, url string"), url_filter.rules_frame(spark)).collect()}
    assert [got[k] for k in sorted(got)] == contract.split(", ")


def test_url_filter_with_long_urls_and_many_path_lengths(spark):
    rules = [("block", "a.com", "/" + "p" * k) for k in range(0, 600, 2)] + [("allow", "a.com", "/" + "p" * 599)]
    urls = [(k, f"http://x.a.com/{'p' * n}{'z' * 200_000}") for k, n in enumerate((0, 1, 2, 301, 599))] + [(9, "http://" + "s." * 300 + "a.com/pp"), (10, "http://a.com")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(df, url_filter.rules_frame(spark, rules)).collect()}
    want = {k: ("a.com/" + "p" * (n - n % 2), "block") for k, n in enumerate((0, 1, 2, 301))} | {4: ("a.com/" + "p" * 599, "allow"), 9: ("a.com/pp", "block"), 10: (None, "allow")}
    assert got == want


@pytest.mark.parametrize("options", [{}, {"leaf": 40, "max_leaf": 30}])
def test_embeddings_against_brute_force(spark, options):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((60, 16))
    x = np.concatenate([centre[rng.integers(60, size=400)] + 0.045 * rng.standard_normal((400, 16)), np.repeat(centre[:1], 90, 0)]).astype(np.float32)
    labels = np.concatenate([rng.integers(0, 3, 400), np.ones(90, int)])
    table = [(k, v.tolist(), int(y)) for k, (v, y) in enumerate(zip(x, labels))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, x[0].tolist(), None), (904, [None] + [1.0] * 15, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1)]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    got = embedding_dedup.near_duplicates(df, **options).toPandas().set_index("vec_id").sort_index()
    u = embedding_dedup.unit(x)
    hit = (u @ u.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(hit, False)
    mine = got.n_links.loc[: len(x) - 1].to_numpy()
    assert (mine <= hit.sum(1)).all() and mine.sum() >= 0.9 * hit.sum()
    assert got.n_links.loc[[900, 901, 902, 903, 904]].tolist() == [0] * 5 and got.n_links.loc[[905, 906]].tolist() == [1, 1] and got.component_id[906] == 905
    assert (got.kept == (got.component_id == got.index)).all() and embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("more", [0, 3000])
def test_embedding_query_against_brute_force(spark, tmp_path, more):
    """The query over a supplied table, and over that with noisy copies beside it."""
    d = "/root/testdata/sf0.1"
    pdf = pd.read_parquet(f"{d}/embeddings.parquet").sort_values("vec_id")
    if more:
        rng = np.random.default_rng(12)
        x = np.stack(pdf.embedding.to_list())
        pick = rng.integers(0, 400, more)
        noise = rng.standard_normal((more, x.shape[1])) * np.sqrt((x[pick] ** 2).sum(1, keepdims=True) / x.shape[1]) * rng.choice([0.02, 0.1, 0.14, 0.19], (more, 1))
        copies = pd.DataFrame({"vec_id": pdf.vec_id.max() + 1 + np.arange(more), "embedding": list((x[pick] + noise).astype(np.float32)), "label": pdf.label.to_numpy()[pick]})
        pdf, d = pd.concat([pdf, copies]), str(tmp_path)
        pdf.to_parquet(f"{d}/embeddings.parquet")
    u = embedding_dedup.unit(np.stack(pdf.embedding.to_list()))
    labels, ids = pdf.label.to_numpy(), pdf.vec_id.to_numpy()
    hit = (u @ u.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(hit, False)
    got = embedding_dedup.query(spark, d).toPandas().set_index("vec_id").loc[ids]
    recall = got.n_links.sum() / hit.sum() if hit.any() else 1.0
    print(f"{hit.sum() // 2} pairs, recall {recall:.4f}")
    assert (got.n_links.to_numpy() <= hit.sum(1)).all() and recall >= 0.95
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(hit, label[None], 2**62).min(1))
        if (new == label).all():
            break
        label = new
    assert (got.component_id.to_numpy() == label).mean() > 0.97
    assert (got.kept == (got.component_id == got.index)).all() and set(got.component_id) <= set(ids)


def test_mix_comes_near_its_targets(spark):
    got = mixing.query(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "source"])
    by = got.merge(docs, on="doc_id").groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= np.maximum(0.03 * by.target, by.most)).all()


def test_token_files(spark, edge, tmp_path):
    from tokenizers import Tokenizer

    path, t = f"file://{tmp_path}/t", Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    token_files.write_files(edge, path, packing.tokenizer_path("word_bpe_49k.json"), segment_bytes=500, segments_per_file=2, files=3)
    for k, file in enumerate(sorted((tmp_path / "t").glob("part-*"), reverse=True)):  # order must not come from names
        file.rename(file.with_name(f"part-{k:05d}-c218-c{k % 3:03d}.txt"))
    back = token_files.read_ids(spark, path).collect()
    want = lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]
    assert sorted((r.doc_id or 0, list(r.ids)) for r in back) == sorted((i or 0, want(x)) for i, x, _ in EDGE)
    out = token_files.with_starts(token_files.read_files(spark, path)).toPandas().sort_values("start")
    assert (out.start == out.n_tokens.cumsum() - out.n_tokens).all() and out.doc_id.isna().iloc[0] and out.doc_id.dropna().is_monotonic_increasing
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 50_000, 1000), np.zeros(1), np.array([0, 2**32 - 1] * 70), np.full(300, 7), np.zeros(0)):
        ids = ids.astype(np.uint32)
        data, starts = token_files.packed_blocks(ids)
        assert (token_files.unpacked_blocks(np.frombuffer(data, np.uint8), starts, len(ids)) == ids).all()


def removed_bytes(docs: list, length: int = 50) -> list:
    """id, text and which of its bytes go, of each document."""
    first, out = {}, []
    order = [(i, t, 2**63 - 1 if i is None else i, (t or "").encode()) for i, t in sorted(docs, key=lambda d: 2**63 - 1 if d[0] is None else d[0])]
    for _, _, key, b in order:
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], key), key)
    for i, t, key, b in order:
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key:
                cut[p : p + length] = True
        out.append((i, t, cut))
    return out


def without_repeats(docs: list, length: int = 50) -> dict:
    out = defaultdict(list)
    for i, t, cut in removed_bytes(docs, length):
        out[i].append(bytes(np.frombuffer((t or "").encode(), np.uint8)[~cut]))
    return {k: sorted(x) for k, x in out.items()}


def without_broken_characters(text, cut) -> str | None:
    if text is None:
        return None
    edges = np.flatnonzero(np.diff(np.concatenate([[1], cut.astype(int), [1]])))
    return "".join(text.encode()[a:b].decode(errors="ignore") for a, b in zip(edges[::2], edges[1::2]))


def test_cut_characters(spark):
    """Cuts inside characters; a replacement character of the text itself stays."""
    passage = "".join(chr(0x20AC + k % 40) for k in range(40))
    docs = [(1, passage), (2, "�x" + passage[:-1] + chr(0x20AC + 45) + "�ü"), (3, "𝄞" + passage + "é�"), (4, passage[3:30] + "\U0001f600"), (5, None), (6, passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: bytes(r._kept) for r in suffix_dedup.without_repeats(df, whole_chars=True).collect()}
    assert got == {i: (without_broken_characters(t, cut) or "").encode() for i, t, cut in removed_bytes(docs)}


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000}, {"heavy_bytes": 300, "task_bytes": 20_000}])
def test_suffix_dedup(spark, edge, small, options, monkeypatch):
    """heavy_bytes so low that the commonest minimizers are dealt out passage by passage."""
    if "heavy_bytes" in options:
        real = suffix_dedup.heavy_cells
        monkeypatch.setattr(suffix_dedup, "heavy_cells", lambda *a: seen.append(real(*a)) or seen[-1])
    seen = []
    got = suffix_dedup.without_repeats(spark.read.parquet(f"{SF}/documents.parquet"), **options).toPandas()
    want = without_repeats(list(zip(small.doc_id, small.text)))
    assert {i: [bytes(k)] for i, k in zip(got.doc_id, got._kept)} == want
    assert not seen or seen[0].any()
    rng = np.random.default_rng(6)
    docs = [(i, t) for i, t, _ in EDGE] + [(100 + k, "".join(rng.choice(list("ab\x00"), 90)) * 3 + "ab" * 60) for k in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("starts", F.lit(1))
    got = suffix_dedup.without_repeats(df, **options).collect()
    mine = defaultdict(list)
    for r in got:
        mine[r.doc_id].append(bytes(r._kept))
    assert {k: sorted(x) for k, x in mine.items()} == without_repeats(docs)
    assert suffix_dedup.without_repeats(df.limit(0), **options).count() == 0


def test_equal_hashes_of_segments_are_told_apart():
    run = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60 + b"a" * 40, np.uint8)
    starts, sizes, ids = np.array([0, 60, 120, 180]), np.array([60, 60, 60, 40]), np.array([3, 2, 1, 0])
    which, low, one = suffix_dedup.equal_runs(np.zeros(4, np.uint64), ids, run, starts, sizes)
    assert len(set(which.tolist())) == 4  # the least id's bytes decide who stays
    which, low, one = suffix_dedup.equal_runs(np.array([5, 5, 5, 6], np.uint64), ids, run, starts, sizes)
    assert which[0] == which[2] != which[1] and low[which[0]] == 1 and one[which[0]] == 2 and low[which[1]] == 2


def test_suffix_array_and_prefixes_against_sorting():
    rng = np.random.default_rng(8)
    sizes = rng.integers(8, 30, 40)
    run = rng.choice(np.frombuffer(b"ab\x00", np.uint8), sizes.sum())
    starts = np.cumsum(sizes) - sizes
    shard = suffix_dedup.Shard(run, sizes, np.arange(40), 8)
    first = {}
    for k, (a, n) in enumerate(zip(starts, sizes)):
        for p in range(a, a + n - 7):
            first.setdefault(run[p : p + 8].tobytes(), k)
    want = [p + 8 <= a + n and first[run[p : p + 8].tobytes()] < k for k, (a, n) in enumerate(zip(starts, sizes)) for p in range(a, a + n)]
    assert shard.removable().tolist() == want
    assert hashlib.sha256(shard.passages().tobytes()).digest() == hashlib.sha256(b"".join(sorted(first))).digest()


def test_warc_edges(spark, tmp_path, monkeypatch):
    body = "<p>" + "é\r\n" * 60
    rows = [(3, "http://a b/\n", body), (1, None, body), (None, "u", body), (4, "v", "tiny"), (5, "w", "tiny"), (6, "x", None), (7, "y", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    warc.write_archives(pages, path := f"file://{tmp_path}/w")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolved(warc.read_archives(spark, path)).collect()}
    n = len(body.encode())
    assert got == {1: ("response", None, n), 3: ("revisit", 1, n), None: ("revisit", 1, n), 4: ("response", None, 4), 5: ("response", None, 4), 6: ("response", None, 0), 7: ("response", None, 280)}
    warc.write_archives(pages.limit(0), empty := f"file://{tmp_path}/e")
    assert warc.resolved(warc.read_archives(spark, empty)).count() == 0


def test_warc_repeated_rows_and_members(spark, tmp_path):
    """Rows that repeat id and payload are responses with record ids of their own; each record is a gzip member."""
    import gzip
    import zlib

    body = "<p>" + "x" * 200
    pages = spark.createDataFrame([(1, "u", body)] * 3 + [(2, "u", body), (9, "v", "b" * 150)], "page_id long, url string, html string")
    warc.write_archives(pages, path := f"file://{tmp_path}/w")
    read = warc.read_archives(spark, path)
    assert read.select("record_id").distinct().count() == 5
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.resolved(read).collect())
    assert got == {(1, "response", None): 3, (2, "revisit", 1): 1, (9, "response", None): 1}
    n = 0
    for file in (tmp_path / "w").glob("part-*"):
        data = file.read_bytes()
        while data:
            one = zlib.decompressobj(31)
            text = one.decompress(data)
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and one.eof
            data, n = one.unused_data, n + 1
    assert n == 5
    long = bytes(range(256)) * (1 << 17)
    assert warc.members(long)[-1] == 0 and gzip.decompress(warc.members(long)) == long


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        counts.append(docs.count())
        assert k == 4 or docs.columns == start.columns
        if k == 1:
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert all(i == c for i, c in linked_components({i: shingles(t) for i, t in texts.items()}).items())
        if k == 2:
            want = {i: without_broken_characters(t, cut) for i, t, cut in removed_bytes(list(texts.items()))}
            assert {r.doc_id: r.text for r in docs.collect()} == {i: x for i, x in want.items() if x or not texts[i]}
            before = {r.doc_id for r in docs.collect()}
        if k == 3:
            assert {r.doc_id for r in docs.collect()} <= before
    assert start.count() > counts[0] >= counts[1] >= counts[2] > 0 and counts[4] >= counts[3] > 0


@pytest.mark.parametrize("rows", ["edge", "empty"])
def test_each_stage_on_edge_tables(spark, edge, rows):
    """Nulls, empty texts, ties, repeated rows, clashing columns, and no rows at all."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = edge.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    docs = docs.limit(0) if rows == "empty" else docs
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stage(spark, docs, SF) for name, stage in stages.items()}
    for name, got in out.items():
        assert name == "best-fit packing" or got.columns == docs.columns
    if rows == "empty":
        assert all(got.count() == 0 for got in out.values())
        return
    texts = [t for _, t, _ in EDGE]
    kept = [(r.doc_id, r.text) for r in out["quality rules"].collect()]
    assert all(not (base(t)[0] < 50 or 100 * base(t)[4] > 50 * base(t)[0]) for _, t in kept) and (None, BASE) in kept
    stay = Counter((r.doc_id, r.text) for r in out["n-gram Jaccard join"].collect())
    lowest = linked_components({i: shingles(t) for i, t, _ in EDGE if i is not None})
    assert stay == Counter((i, t) for i, t, _ in EDGE if i is None or lowest[i] == i)
    cut = {(i, without_broken_characters(t, c)) for i, t, c in removed_bytes([(i, t) for i, t, _ in EDGE])}
    assert {(r.doc_id, r.text) for r in out["suffix-array dedup"].collect()} == {(i, x) for i, x in cut if x or not dict((a, b) for a, b, _ in EDGE)[i]}
    assert {r.text for r in out["mixing"].collect()} <= set(texts)
    pieces = out["best-fit packing"].toPandas()
    assert len(pieces[pieces.piece == 0]) == len(EDGE) and set(pieces.doc_id.dropna().astype(int)) == {i for i, _, _ in EDGE if i is not None}
