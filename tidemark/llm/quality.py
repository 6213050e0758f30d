"""Quality rules: counts of words, symbols and repeats, and a likelihood ratio against trusted text.

Words and pairs of words are hashed into 2^16 buckets. Counts of all documents give the raw
multinomial, those of trusted labelled documents the target, smoothed by as many draws from the raw
one as it has n-grams itself, so a bucket that trusted text never uses costs log 2 at any size of
corpus. A document's score is the mean log ratio of target and raw over its n-grams. The target is
counted in two halves and a document is scored with the half that it isn't in, so trusted and other
documents are judged alike. The threshold lies halfway between a low quantile of the trusted scores
and the median of those labelled as bad; documents at or above it are kept.

All labelled rows are used. They meet the documents in a join by id, which Spark does by broadcast
while the table of labels is small; beyond that it shuffles the texts, once for the target's counts
and once for the labelled scores. Quantiles are exact and found by counting in ranges.

Defined cases: texts of any length are counted and scored whole; null text has no words and score 0; repeated rows are counted and judged one by one;
without trusted or without bad labels no document fails by its score; a document labelled twice
counts as bad if any label says so; a score at the threshold is kept; an empty table gives no rows.
Other columns aren't returned by judged(); kept() returns all columns of its input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import STEP, mixed, pieces, ragged, run_hashes, shingle_hashes, texts, word_spans

BITS, PIECE = 16, 2 << 20
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def buckets(run: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, words before each text, buckets of all words and pairs of words and whose they are, word starts."""
    starts, ends, first = word_spans(run, offsets)
    words = run_hashes(run, starts, ends - starts)
    pairs, n_pairs = shingle_hashes(words, first, 2)
    rows = np.arange(len(offsets) - 1)
    each = np.concatenate([words, pairs]) >> np.uint64(64 - BITS)
    return words, first, each.astype(np.int64), np.concatenate([np.repeat(rows, np.diff(first)), np.repeat(rows, np.diff(n_pairs))]), np.stack([starts, ends])


def by_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the bytes' flags are set in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: has its owner the same key elsewhere too; is it such a key and not the first."""
    own = mixed(keys + (owner.astype(np.uint64) + np.uint64(1)) * STEP)
    _, first, which, n = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    twice = n[which] > 1
    return twice, twice & (first[which] != np.arange(len(keys)))


def base_counts(run: np.ndarray, offsets: np.ndarray, words: np.ndarray, first: np.ndarray, spans: np.ndarray) -> dict[str, np.ndarray]:
    n_texts, rows = len(offsets) - 1, np.arange(len(offsets) - 1)
    lead = np.concatenate([[0], np.cumsum((run & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(lead[spans[1]] - lead[spans[0]])])[first]
    ends = np.zeros(len(run), bool)
    ends[run == 10] = True
    breaks = np.flatnonzero(ends)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1])) if len(run) else np.zeros(0, np.int64)
    owner = np.searchsorted(offsets, begins, "right") - 1
    begins, owner = begins[owner < n_texts], owner[owner < n_texts]
    upto = np.minimum(np.append(begins[1:], len(run)), offsets[1:][owner]) if len(begins) else begins
    upto = upto - ((upto > begins) & (run[np.maximum(upto - 1, 0)] == 10)) if len(begins) else upto
    worded = np.searchsorted(spans[0], upto) > np.searchsorted(spans[0], begins)
    begins, upto, owner = begins[worded], upto[worded], owner[worded]
    again = repeats(run_hashes(run, begins, upto - begins), owner)[1]
    triples, n_triples = shingle_hashes(words, first, 3)
    at = ragged(first[:-1], np.diff(n_triples))
    twice = at[repeats(triples, np.repeat(rows, np.diff(n_triples)))[0]]
    cover = np.zeros(len(words) + 4, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 3, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(words)] > 0)])
    return {
        "n_words": np.diff(first), "word_chars": np.diff(chars), "n_symbols": by_text(SYMBOL[run], offsets),
        "n_dup_lines": np.bincount(owner[again], minlength=n_texts), "n_repeat_words": np.diff(covered[first]),
    }


def labelled(labels: DataFrame) -> DataFrame:
    """_labelled, label: 1 for each trusted document's id, 0 for each bad one's."""
    each = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_labelled")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return each.select("_labelled", F.expr("CASE WHEN q >= 1 AND coalesce(t, 0) = 0 THEN 1 WHEN q <= 0 THEN 0 END").alias("label")).filter("label is not null")


def of_labelled(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose _id is in marks, of labelled(), with their label."""
    return rows.join(marks, F.col("_id").cast("long") == F.col("_labelled")).drop("_labelled")


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def half(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) & np.uint64(1)).astype(np.int64)


def bucket_counts(docs: DataFrame, marks: DataFrame) -> np.ndarray:
    """Counts of each bucket in all documents and in the halves of the trusted ones: 3 rows."""

    def counted(rows: DataFrame, halves: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 1 << BITS), np.int64)
            for whole in batches:
                for batch in pieces(whole, "_text", PIECE):
                    _, _, each, owner, _ = buckets(*texts(batch.column("_text")))
                    if halves:
                        each = each + (half(_ids(batch.column("_id"))) << BITS)[owner]
                    total += np.bincount(each, minlength=2 << BITS).reshape(2, -1)
            used = np.flatnonzero(total.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(t[used]) for t in total)], names=["bucket", "n0", "n1"])

        got = rows.mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # 2^16 rows at most
        out = np.zeros((2, 1 << BITS), np.int64)
        out[:, got["bucket"].to_numpy(np.int64)] = got[["n0", "n1"]].to_numpy(np.int64).T
        return out

    trusted = of_labelled(docs, marks.filter("label = 1")).select("_id", "_text")
    return np.concatenate([counted(docs.select("_text"), False)[:1], counted(trusted, True)])


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """For documents of either half, the log ratio of each bucket by the trusted documents of the other."""
    raw = (counts[0] + 1) / (counts[0].sum() + len(counts[0]))
    target = counts[[2, 1]].astype(np.float64)
    n = np.maximum(target.sum(1, keepdims=True), 1.0)
    return np.log((target + n * raw) / (target.sum(1, keepdims=True) + n)) - np.log(raw)


def fitted(docs: DataFrame, marks: DataFrame, *, id_col: str, text_col: str) -> np.ndarray:
    """Log ratios for the two halves."""
    return log_ratios(bucket_counts(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), marks))


def scored(docs: DataFrame, ratios: np.ndarray, *, id_col: str, text_col: str, keep: tuple[str, ...] = (), marks: DataFrame | None = None) -> DataFrame:
    """id, base counts, base_failed and score of every document, or of those in marks, with their label.

    keep: columns to return with them, as keep_0, keep_1...
    """
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)))
    kept = [f"keep_{k}" for k in range(len(keep))]
    if marks is not None:
        rows, kept = of_labelled(rows, marks), [*kept, "label"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text", PIECE):
                data, offsets = texts(batch.column("_text"))
                words, first, each, owner, spans = buckets(data, offsets)
                base, ids = base_counts(data, offsets, words, first, spans), _ids(batch.column("_id"))
                sums = np.bincount(owner, weights=sent.value[half(ids)[owner], each], minlength=len(ids))
                score = sums / np.maximum(np.bincount(owner, minlength=len(ids)), 1)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(base[c].astype(np.int64)) for c in BASE), pa.array(failed), pa.array(score), *(batch.column(c) for c in kept)], names=["_id", *BASE, "base_failed", "score", *kept])

    schema = [f"_id {kinds['_id']}", *(f"{c} long" for c in BASE), "base_failed boolean", "score double", *(f"{c} {kinds[c]}" for c in kept)]
    return rows.mapInArrow(run, ", ".join(schema)).withColumnRenamed("_id", id_col)


def at_rank(scores: DataFrame, rank: int, few: int = 4096, ranges: int = 1024) -> float:
    """The score at a place (from 0) in ascending order: ranges of scores are counted until few are left in one."""
    low, high, n = scores.agg(F.min("score"), F.max("score"), F.count("score")).first()
    while low < high:
        rows = scores.filter(F.col("score").between(low, high))
        if n <= few:
            return sorted(r[0] for r in rows.select("score").collect())[rank]
        place = F.least(F.floor((F.col("score") - low) / (high - low) * ranges), F.lit(ranges - 1))
        for _, low, high, n in sorted(map(tuple, rows.groupBy(place.alias("k")).agg(F.min("score"), F.max("score"), F.count("score")).collect())):
            if rank < n:
                break
            rank -= n
    return low


def quantile_of(scores: DataFrame, q: float) -> float | None:
    """The exact quantile, between two scores in proportion; None without scores."""
    n = scores.count()
    if not n:
        return None
    at = q * (n - 1)
    low, high = (at_rank(scores, int(k)) for k in (math.floor(at), math.ceil(at)))
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def threshold(scores: DataFrame, quantile: float) -> float:
    """Between the quantile of trusted and the median of bad scores; -inf where either is missing."""
    low, mid = (quantile_of(scores.filter(f"label = {k} and n_words >= 50"), q) for k, q in ((1, quantile), (0, 0.5)))
    return -math.inf if low is None or mid is None else min(low, (low + mid) / 2)


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quantile: float = 0.01, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, base counts, base_failed, score and kept of every document, and the columns of keep as keep_0, keep_1..."""
    names = {"id_col": id_col, "text_col": text_col}
    marks = written(labelled(labels), "labels")
    ratios = fitted(docs, marks, **names)
    least = threshold(written(scored(docs, ratios, **names, marks=marks).select("score", "label", "n_words"), "labelled"), quantile)
    return scored(docs, ratios, **names, keep=keep).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that judged() keeps, with all their columns."""
    out = judged(docs, labels, keep=tuple(docs.columns), **options).filter("kept")
    return out.select(*(F.col(f"keep_{k}").alias(c) for k, c in enumerate(docs.columns)))


def query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
