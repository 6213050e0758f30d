"""Join of documents whose sets of word n-grams overlap, by signature trees.

Documents with equal sets are one class from the start. Classes that may link are brought together
by prefix tokens and sizes, which loses no link: with the n-grams of every set in one global order,
two sets with Jaccard similarity s or more share one of their first size - ceil(s * size) + 1
n-grams, for the smaller one of its first size - ceil(2s / (1 + s) * size) + 1, and the smaller has
at least s times the larger's size. The order puts n-grams first that few documents have, by a table
of hashed counts over all documents, so passages that many documents share hardly ever route; an
n-gram alone in its cell is no other document's and doesn't travel. The table has a cell for every 16
bytes of text, 2^26 at most (64 MiB, a byte each); with more text it tells less apart, which makes
blocks larger but loses nothing. Classes that a chain of shared prefix tokens and near sizes connects
form a block.

Inside a block the sets hang in a signature tree: a leaf has one set's token bitmap, a node the OR
of its children's bitmaps, their range of sizes and how far a bitmap may undercount a set. A dual
traversal from the root compares nodes with nodes and drops a pair of nodes if even the largest
overlap that bitmaps and sizes allow would be too small. What is left at the leaves is compared
exactly, on the sets themselves, unless both are in one component already.

A block beyond max_sets or max_tokens is cut into shards, each with the same few pivots of the
block. After that most of its classes are in one component, the main one. The classes outside it are
dealt into shards of their own, and each of these meets each shard of the block: a dual traversal
across the two trees finds the links that are left. So shards change the work but not the result.

N-grams are compared by 64-bit hashes. Words are hashed whole, whatever their length, and so are
texts of any length.

Defined cases: null or empty text has an empty set and links with nothing; fewer words than n form
one n-gram; a null id gets a null component and links with nothing; rows that repeat an id are judged
each by its own text; an empty table gives no rows. Other columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, written
from .url_filter import BlockedBloom
from .words import LOWER, STEP, mixed, pieces, run_hashes, shingle_hashes, texts, word_spans

PIECE, FAN = 2 << 20, 8
#: The table of counts: cells by the upper bits of a token, in parts of 2^16.
LEAST_BITS, MOST_BITS, PART_BITS = 18, 26, 16


def token_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the n-grams of each text."""
    run, offsets = texts(column)
    run = LOWER[run]
    starts, ends, first = word_spans(run, offsets)
    grams, bounds = shingle_hashes(run_hashes(run, starts, ends - starts), first, n)
    return [np.unique(grams[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def cells(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Where tokens count in a table of 2^bits cells."""
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def gaps(places: np.ndarray) -> bytes:
    """Ascending places as the gaps between them, a byte each and one more for every 255 in a gap."""
    gap = np.diff(places, prepend=0)
    ends = np.cumsum(gap // 255 + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gap % 255
    return out.tobytes()


def places(data: np.ndarray) -> np.ndarray:
    """What gaps() was given."""
    return np.cumsum(data, dtype=np.int64)[data != 255]


def signatures(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """_id, size and two halves of a fingerprint of the set of every document; and, in rows of their
    own with a part, the counts of each task, up to 255: cells of the part (by gaps) and counts.
    """
    names = ["_id", "size", "mark1", "mark2", "part", "places", "counts"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint8)
        for whole in batches:
            for batch in pieces(whole, "_text", PIECE):
                sets = token_sets(batch.column("_text"), n)
                if sets:
                    at, more = np.unique(cells(np.concatenate(sets), bits), return_counts=True)
                    total[at] = np.minimum(total[at] + more, 255)
                marks = [[fingerprint(s, k) for s in sets] for k in (STEP, STEP << np.uint64(7))]
                none = [pa.nulls(len(batch), k) for k in kinds[4:]]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(m, pa.int64()) for m in marks), *none], names=names)
        for part, counts in enumerate(total.reshape(-1, 1 << PART_BITS)):
            some = np.flatnonzero(counts)
            if len(some):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:4]), *(pa.array([x], k) for x, k in zip((part, gaps(some), counts[some].tobytes()), kinds[4:]))], names=names)

    return docs.mapInArrow(run, "_id long, size long, mark1 long, mark2 long, part int, places binary, counts binary")


def rarity(signed: DataFrame, bits: int) -> np.ndarray:
    """For each cell of the table a rank by its count over all documents (a quarter of an octave apart), one byte; 0 for none, ALONE for one."""

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << PART_BITS, np.int64)
        for at, counts in zip(table.column("places"), table.column("counts")):
            total[places(np.frombuffer(at.as_buffer(), np.uint8))] += np.frombuffer(counts.as_buffer(), np.uint8)
        rank = np.minimum(np.log2(total + 1.0) * 4, 255).astype(np.uint8)
        return pa.table({"part": table.column("part")[:1], "rank": pa.array([rank.tobytes()], pa.binary())})

    rows = signed.filter("part is not null").select("part", "places", "counts").groupBy("part").applyInArrow(added, "part int, rank binary").toArrow()  # 2^10 rows of 64 KiB at most
    out = np.zeros((1 << bits - PART_BITS, 1 << PART_BITS), np.uint8)
    for part, rank in zip(rows.column("part").to_pylist(), rows.column("rank")):
        out[part] = np.frombuffer(rank.as_buffer(), np.uint8)
    return out.reshape(-1)


#: The rank of a cell with one token.
ALONE = 4


def prefix(tokens: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of a set in the global order, as many as a linked set must share one of, but
    those that no other set has; and which of them are among those that a larger linked set must share one of.
    """
    bits, size = len(rank).bit_length() - 1, len(tokens)
    own = rank[cells(tokens, bits)]
    first = np.lexsort((tokens, own))[: size - -(-size * percent // 100) + 1]
    shorter = np.arange(len(first)) < size - -(-2 * percent * size // (100 + percent)) + 1
    shared = own[first] > ALONE
    return tokens[first[shared]], shorter[shared]


def near_runs(token: np.ndarray, size: np.ndarray, mark: np.ndarray, short: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of marks that connect the sets of each token that may link: of near sizes, and the smaller with the token in its shorter prefix.

    A set is paired with the next smaller one that has the token there; chains of these connect the rest.
    """
    order = np.lexsort((~short, size, token))
    token, size, mark, short = token[order], size[order], mark[order], short[order]
    at = np.arange(len(token))
    first = np.maximum.accumulate(np.where(np.append(True, token[1:] != token[:-1])[: len(at)], at, 0))
    last = np.append(-1, np.maximum.accumulate(np.where(short, at, -1)))[: len(at)]
    fit = last >= first
    fit[fit] = 100 * size[last[fit]] >= percent * size[fit]
    pairs = np.stack([mark[last[fit]], mark[fit]], 1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def routes(docs: DataFrame, n: int, percent: int, rank: np.ndarray, n_buckets: int) -> DataFrame:
    """a, b: marks of sets that share a prefix token and have near sizes, enough of them to connect all.

    Of the sets of a batch that share token and size one travels for all. Tokens travel as a few
    arrays for each batch and bucket, not as a row each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            token, size, mark, short = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for batch in pieces(whole, "_text", PIECE):
                for s in token_sets(batch.column("_text"), n):
                    mine, shorter = prefix(s, sent.value, percent) if len(s) else (s, s)
                    if len(mine):
                        token.append(mine)
                        short.append(shorter)
                        size.append(np.full(len(mine), len(s)))
                        mark.append(np.full(len(mine), fingerprint(s)))
            token, size, mark, short = (np.concatenate(x) for x in (token, size, mark, short))
            order = np.lexsort((mark, ~short, size, token))
            token, size, mark, short = token[order], size[order], mark[order], short[order]
            new = np.append(True, (token[1:] != token[:-1]) | (size[1:] != size[:-1]))[: len(token)]
            held = mark[np.flatnonzero(new)][np.cumsum(new) - 1]
            here = np.unique(np.stack([held, mark], 1)[held != mark], axis=0)
            token, size, mark, short = token[new], size[new], mark[new], short[new]
            bucket = (token % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            rows = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            packs = [[x[r].tobytes() for r in rows] for x in (token, (size << 1 | short).astype(np.uint32), mark)]
            pairs = [b""] * n_buckets
            pairs[int(abs(int(here.sum())) % n_buckets)] = here.tobytes()
            keep = pa.array([bool(len(r)) or bool(p) for r, p in zip(rows, pairs)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_buckets)), *(pa.array(p, pa.binary()) for p in (*packs, pairs))], names=["bucket", "token", "size", "mark", "pairs"]).filter(keep)

    def meet(table: pa.Table) -> pa.Table:
        token, size, mark, here = (np.concatenate([np.frombuffer(x.as_buffer(), k) for x in table.column(c)]) for c, k in (("token", np.uint64), ("size", np.uint32), ("mark", np.int64), ("pairs", np.int64)))
        pairs = np.concatenate([near_runs(token, (size >> 1).astype(np.int64), mark, (size & 1).astype(bool), percent), here.reshape(-1, 2)])
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    rows = docs.select("_text").mapInArrow(spread, "bucket long, token binary, size binary, mark binary, pairs binary")
    return rows.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


class Tree:
    """A signature tree over sets, which should come in an order that puts like sets together."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits), bool)
        maps[np.repeat(np.arange(len(sets)), sizes), (np.concatenate(sets) >> np.uint64(20)).astype(np.int64) & bits - 1] = True
        maps = np.packbits(maps, axis=1).view(np.uint64)
        over = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, over)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, over = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(over, at)))

    @staticmethod
    def bits_for(sizes: np.ndarray) -> int:
        return 1 << int(np.clip(np.ceil(np.log2(2 * np.median(sizes) + 1)), 7, 15))


def may_link(x: Tree, a: np.ndarray, at: int, y: Tree, b: np.ndarray, level: int, percent: int) -> np.ndarray:
    """Which pairs of nodes, a on level at of x and b on level of y, may hold a link."""
    (maps, low, high, over), (maps2, low2, high2, over2) = x.levels[at], y.levels[level]
    common = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(maps[a[k : k + 4096]] & maps2[b[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(a), 4096))])
    most = np.minimum(np.minimum(high[a], high2[b]), common + np.minimum(over[a], over2[b]))
    return 100 * most >= percent * np.maximum(low[a] + low2[b] - most, np.maximum(low[a], low2[b]))


def near(x: Tree, y: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of parents of leaves that the dual traversal from both roots doesn't drop; once each if x is y.

    The taller tree goes down alone until both are level.
    """
    at, level = len(x.levels) - 1, len(y.levels) - 1
    a = b = np.zeros(1, np.int64)
    children = np.arange(FAN)
    while at > 1 or level > 1:
        down_x, down_y = at >= level, level >= at
        grid = np.broadcast_to
        shape = (len(a), FAN if down_x else 1, FAN if down_y else 1)
        a, b = (grid(a[:, None, None] * FAN + children[:, None] if down_x else a[:, None, None], shape).reshape(-1), grid(b[:, None, None] * FAN + children if down_y else b[:, None, None], shape).reshape(-1))
        at, level = at - down_x, level - down_y
        fit = (a < len(x.levels[at][0])) & (b < len(y.levels[level][0]))
        if x is y:
            fit &= a <= b
        a, b = a[fit], b[fit]
        fit = may_link(x, a, at, y, b, level, percent)
        a, b = a[fit], b[fit]
    return a, b


def linked(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets have a Jaccard similarity of percent or more with x."""
    sizes = np.array([len(o) for o in others], np.int64)
    every = np.concatenate(others)
    hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(x) + sizes - both)


def _by_likeness(sets: list[np.ndarray]) -> list[int]:
    return sorted(range(len(sets)), key=lambda k: (len(sets[k]), sets[k][0]))


def links(sets: list[np.ndarray], percent: int, more: list[np.ndarray] | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Enough of the links among sets, by place, to connect all that are connected.

    With more: of the links between the two lists, places in more counted on from those in sets.
    label: what is connected already, for both lists.
    """
    if more is None and len(sets) == 2:
        return [(0, 1)] if linked(sets[0], sets[1:], percent)[0] else []
    bits = Tree.bits_for(np.array([len(s) for s in (sets + (more or []))]))
    order = _by_likeness(sets)
    one = other = Tree([sets[k] for k in order], bits)
    back = order
    if more is not None:
        back = _by_likeness(more)
        other = Tree([more[k] for k in back], bits)
        back = [k + len(sets) for k in back]
    every = sets + (more or [])
    label = np.arange(len(every)) if label is None else np.unique(label, return_inverse=True)[1]
    order, back, out = np.array(order), np.array(back), []
    nodes_a, nodes_b = near(one, other, percent)
    first = np.argsort(nodes_a != nodes_b, kind="stable")
    for a, b in zip(nodes_a[first].tolist(), nodes_b[first].tolist()):
        mine, rest = np.arange(a * FAN, min(len(order), a * FAN + FAN)), np.arange(b * FAN, min(len(back), b * FAN + FAN))
        if len(np.unique(label[np.concatenate([order[mine], back[rest]])])) == 1:
            continue
        for x in mine.tolist():
            own = order[x]
            y = rest[label[back[rest]] != label[own]]
            if one is other and a == b:
                y = y[y > x]
            if len(y):
                y = y[may_link(one, np.full(len(y), x), 0, other, y, 0, percent)]
            if len(y):
                for k in back[y[linked(every[own], [every[k] for k in back[y]], percent)]].tolist():
                    if label[k] != label[own]:
                        out.append((int(own), k))
                        label[label == label[k]] = label[own]
    return out


def fingerprint(tokens: np.ndarray, k: np.uint64 = STEP) -> int:
    return int(mixed(tokens ^ k).sum(dtype=np.uint64)) - 2**63


def member_sets(rows: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """members (_id, mark1 and more) with tokens, the set as bytes.

    A Bloom filter of their ids, of a bounded size, keeps the texts of other documents out of the
    shuffle; the join behind it is exact. A text whose id is a member's but whose set has another mark
    is none.
    """
    sent = rows.sparkSession.sparkContext.broadcast(BlockedBloom.of(members.select(F.xxhash64("_id").alias("h")), 16, 32 << 20).bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(BlockedBloom(sent.value).has(whole.column("h").to_numpy(zero_copy_only=False))))
            for batch in pieces(whole, "_text", PIECE):
                sets = token_sets(batch.column("_text"), n)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["_id", "mark1", "tokens"])

    sets = rows.filter("_id is not null").withColumn("h", F.xxhash64("_id")).mapInArrow(run, "_id long, mark1 long, tokens binary")
    return sets.join(members, ["_id", "mark1"])


def block_links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links among rows (bin, block, mark1, tokens) that share bin and block."""

    def within(table: pa.Table) -> pa.Table:
        block, ids = (table.column(c).to_numpy() for c in ("block", "mark1"))
        order = np.lexsort((ids, block))
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        tokens, a, b = table.column("tokens"), [], []
        for mine in np.split(order, cuts):
            sets = [np.frombuffer(tokens[k].as_buffer(), np.uint64) for k in mine.tolist()]
            for x, y in links(sets, percent) if len(sets) > 1 else []:
                a.append(ids[mine[x]])
                b.append(ids[mine[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("bin").applyInArrow(within, "a long, b long")


def across(sets: DataFrame, split: DataFrame, percent: int, max_sets: int) -> DataFrame:
    """Links that are left in split blocks: split (mark1, block, shard, shards, component), sets (mark1, shards, tokens).

    Classes outside a block's main component, dealt into shards of their own, meet every shard of the
    block, shard by shard; no pair of classes is a row.
    """
    counts = split.groupBy("block", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = main.withColumn("parts", F.ceil((F.col("all") - F.col("most")) / max_sets).cast("long")).filter("parts > 0")
    own = sets.filter("shards > 1").select("mark1", "tokens").join(split, "mark1").join(main.select("block", "main", "parts"), "block")
    rows = own.dropDuplicates(["mark1"])
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    outside = rows.filter("component <> main").withColumns({"_part": F.pmod(F.xxhash64("mark1", F.lit(3)), F.col("parts")), "_to": F.explode(upto("shards")), "_out": F.lit(True)})
    every = rows.withColumns({"_to": F.col("shard"), "_part": F.explode(upto("parts")), "_out": F.lit(False)})
    names = ["block", "_part", "_to", "_out", "mark1", "component", "tokens"]

    def between(table: pa.Table) -> pa.Table:
        out, ids, label = (table.column(c).to_numpy() for c in ("_out", "mark1", "component"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        left, right = np.flatnonzero(out), np.flatnonzero(~out)
        found = links([sets[k] for k in left], percent, [sets[k] for k in right], label[np.concatenate([left, right])]) if len(left) and len(right) else []
        ids = ids[np.concatenate([left, right])]
        return pa.table({c: pa.array([ids[p[k]] for p in found], pa.int64()) for k, c in enumerate("ab")})

    return outside.select(names).unionByName(every.select(names)).groupBy("block", "_part", "_to").applyInArrow(between, "a long, b long")


def joined(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, max_sets: int = 2000, max_tokens: int = 4_000_000, pivots: int = 16) -> DataFrame:
    """id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0))).first()[0]
    bits = min(max((n_bytes // 16).bit_length(), LEAST_BITS), MOST_BITS)
    made = written(signatures(rows, n, bits), "signatures")
    signed, mark = made.filter("part is null").select("_id", "size", "mark1", "mark2"), ["size", "mark1", "mark2"]
    classes = written(signed.filter("size > 0 and _id is not null").groupBy(*mark).agg(F.min("_id").alias("_id")), "classes")
    edges = written(routes(rows, n, percent, rarity(made, bits), n_buckets), "routes")
    blocks = components(edges, "blocks").select(F.col("id").alias("mark1"), F.col("component").alias("block"))
    # from here on a class goes by its mark1
    members = written(blocks.join(classes, "mark1").select("mark1", "_id", "block", "size"), "members")
    sizes = members.groupBy("block").agg(F.count("*").alias("sets"), F.sum("size").alias("tokens"))
    sizes = sizes.withColumn("shards", F.greatest(F.ceil(F.col("sets") / max_sets), F.ceil(F.col("tokens") / max_tokens)).cast("long"))
    small = sizes.filter("shards = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bins = max(n_buckets, int(small) // max_tokens + 1)
    spread = F.pmod(F.xxhash64("mark1", F.lit(1)), F.col("shards"))
    # of a split block, about as many classes as pivots go to every shard
    pivot = (F.col("shards") > 1) & (F.pmod(F.xxhash64("mark1", F.lit(2)), F.greatest(F.floor(F.col("sets") / pivots), F.lit(1))) == 0)
    placed = members.join(sizes, "block").select(
        "mark1", "_id", "block", "shards", spread.alias("shard"), F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).otherwise(F.array(spread)).alias("into")
    )
    placed = written(placed, "placed")
    sets = written(member_sets(rows, placed, n), "sets")
    name = F.when(F.col("shards") > 1, F.concat_ws(":", "block", "_into")).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("block"), F.lit(bins))))
    found = written(block_links(sets.withColumn("_into", F.explode("into")).select(name.alias("bin"), "block", "mark1", "tokens"), percent), "links")
    comps = components(found, "linked").withColumnRenamed("id", "mark1")
    if (split := placed.filter("shards > 1")).limit(1).count():
        split = written(split.join(comps, "mark1", "left").select("mark1", "block", "shard", "shards", F.coalesce("component", "mark1").alias("component")), "split")
        comps = components(found.unionByName(across(sets, split, percent, max_sets)), "linked").withColumnRenamed("id", "mark1")
    named = written(classes.join(comps, "mark1", "left").select(*mark, "_id", F.coalesce("component", "mark1").alias("component")), "components")
    for table in (edges, members, sets):
        dropped(table)
    low = named.join(named.groupBy("component").agg(F.min("_id").alias("least")), "component").select(*mark, F.col("least").alias("component"))
    out = signed.join(low, mark, "left")
    own = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))  # empty sets are in no class
    return out.select(F.col("_id").alias(id_col), F.col("size").alias("n_shingles"), own.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
