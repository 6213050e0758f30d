"""Removal of passages that an earlier document has, by suffix arrays.

A passage is any run of `length` bytes. Equal runs must meet, wherever their documents are: each run
is dealt out by its minimizer, the 16-byte string in it with the least hash. Consecutive runs of a
document with one minimizer travel together, as one short segment of text, and all segments with one
minimizer come to the same bucket. Segments that are equal as a whole, byte by byte, are settled by
their ids, in the task that cuts them and again in the bucket, so a passage that thousands of
documents share arrives once from each task.

The number of buckets follows the bytes of all texts. A minimizer with more than heavy_bytes of
segments (by hashed counts over all texts, of a fixed size; at least eight times the mean cell) would
still gather in one bucket, so its segments are dealt out as single passages, each by the hash of the
whole passage: equal ones meet, the others spread over all buckets.

The other segments of a minimizer form shards of bounded size. Each shard gets a suffix array by
Larsson and Sadakane's refinement: suffixes are sorted by eight bytes, then groups of equals are
sorted again by the ranks 8, 16, 32 and 64 bytes further on, until the order covers a segment. Common
prefixes follow by Kasai's rule, all segments in step: a suffix's prefix is at most one shorter than
that of the suffix one byte before. Suffixes that share a passage's length form classes, and the
smallest id in a class stays. Where segments of one minimizer fill several shards, each shard looks
its passages up in the sorted passages of the others by binary search.

Defined cases: null text is empty; texts are cut up stretch by stretch, however long; a null id comes after all others and such documents don't remove
from each other; nor do rows that share an id; ids must be integers; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, written
from .words import STEP, eights, mixed, pieces, ragged, run_hashes, run_words, texts

LENGTH, GRAM, NO_ID = 50, 16, 2**63 - 1
#: Bytes of text in a piece, within which equal segments count once, and in the stretches that are hashed at a time.
PIECE, BLOCK = 1 << 21, 1 << 19
#: The table of bytes by minimizer: 2^20 cells in parts of 2^14.
CELL_BITS, PART_BITS = 20, 14
SEGMENTS, SPANS, DOCS = range(3)


def eight(run: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number, zeros past the end."""
    return eights(run, ">").astype(np.uint64)


def same_bytes(run: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the runs of sizes bytes from starts on equal those from others on."""
    if not len(starts):
        return np.zeros(0, bool)
    mine, n = run_words(run, starts, sizes)
    return ~np.logical_or.reduceat(mine != run_words(run, others, sizes)[0], np.cumsum(n) - n)


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place on, from eight()."""
    later = np.concatenate([words[8:], np.zeros(min(8, len(words)), np.uint64)])
    return mixed(words * STEP ^ mixed(later + STEP))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each size consecutive values."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def segments(run: np.ndarray, offsets: np.ndarray, length: int, heavy: np.ndarray | None = None, keyed: bool = True) -> tuple[np.ndarray, ...]:
    """Text, first byte, bytes, minimizer's place (in the segment), what deals it out (the minimizer's hash), and a hash of each segment.

    A segment covers the passages from its first byte to its last less length. Those with a minimizer
    in a heavy cell are cut into single passages, dealt out by their own hash.
    """
    out = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2]
    n = len(run) - length + 1
    for a in range(0, max(0, n), BLOCK):
        b = min(n, a + BLOCK)
        grams = gram_hashes(eight(run[a : b + length + 7]))[: b - a + length - GRAM]
        place = np.arange(len(grams), dtype=np.uint64)
        # the hash's upper 40 bits decide, then the place: the same choice wherever these bytes stand
        least = (sliding_min(grams >> np.uint64(24) << np.uint64(24) | place, length - GRAM + 1)[: b - a] & np.uint64((1 << 24) - 1)).astype(np.int64)
        doc = np.searchsorted(offsets, np.arange(a, b), "right") - 1
        fits = np.arange(a, b) + length <= offsets[doc + 1]
        new = np.ones(b - a, bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~fits[:-1]
        first = np.flatnonzero(new & fits)
        size = np.flatnonzero(fits & np.append(new[1:] | ~fits[1:], True)) - first + length
        deal = grams[least[first]]
        if heavy is not None and (big := heavy[cells(deal)]).any():
            count = np.where(big, size - length + 1, 1)
            first, size, deal, big = ragged(first, count), np.repeat(np.where(big, length, size), count), np.repeat(deal, count), np.repeat(big, count)
        else:
            big = np.zeros(0, np.int64)
        if not keyed:
            out.append([doc[first], first + a, size, least[first] - first, deal, deal])
            continue
        key = mixed(size.astype(np.uint64) * STEP + (least[first] - first).astype(np.uint64))
        for k in range(0, int(size.max()) if len(size) else 0, GRAM):
            key = mixed(key ^ grams[first + np.minimum(k, size - GRAM)] + np.uint64(k))
        deal[np.flatnonzero(big)] = key[np.flatnonzero(big)]
        out.append([doc[first], first + a, size, least[first] - first, deal, key])
    return tuple(np.concatenate(c) for c in zip(*out))


def heavy_cells(docs: DataFrame, length: int, heavy_bytes: int) -> np.ndarray:
    """Cells whose minimizers have more than heavy_bytes of segments, and eight times the mean cell, in docs (_text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for whole in batches:
            for batch in pieces(whole, "_text", PIECE):
                _, _, size, _, deal, _ = segments(*texts(batch.column("_text")), length, keyed=False)
                total += np.bincount(cells(deal), weights=size, minlength=len(total)).astype(np.int64)
        for part, sums in enumerate(total.reshape(-1, 1 << PART_BITS)):
            some = np.flatnonzero(sums)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([some.astype("<u2").tobytes()], pa.binary()), pa.array([sums[some].tobytes()], pa.binary())], names=["part", "places", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << PART_BITS, np.int64)
        for places, sums in zip(table.column("places"), table.column("sums")):
            total[np.frombuffer(places.as_buffer(), "<u2")] += np.frombuffer(sums.as_buffer(), np.int64)
        return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("_text").mapInArrow(count, "part int, places binary, sums binary").groupBy("part").applyInArrow(added, "part int, sums binary").toArrow()  # 64 rows
    total = np.zeros((1 << CELL_BITS - PART_BITS, 1 << PART_BITS), np.int64)
    for part, sums in zip(rows.column("part").to_pylist(), rows.column("sums")):
        total[part] = np.frombuffer(sums.as_buffer(), np.int64)
    return total.reshape(-1) > max(heavy_bytes, 8 * total.mean())


def by_key(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class number of each row, and the least id of each class."""
    names, which = np.unique(keys, return_inverse=True)
    low = np.full(len(names), NO_ID, np.int64)
    np.minimum.at(low, which, ids)
    return which, low


def equal_runs(keys: np.ndarray, ids: np.ndarray, run: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """by_key(), and a row of the least id in each class; rows whose bytes aren't those of that row leave the class."""
    which, low = by_key(keys, ids)
    one = np.full(len(low), -1, np.int64)
    first = np.flatnonzero(ids == low[which])[::-1]
    one[which[first]] = first
    several = np.flatnonzero(np.bincount(which, minlength=len(low))[which] > 1)
    rep = one[which[several]]
    fits = sizes[several] == sizes[rep]
    fits[fits] = same_bytes(run, starts[several[fits]], starts[rep[fits]], sizes[several[fits]])
    odd = several[~fits]
    which[odd] = len(low) + np.arange(len(odd))
    return which, np.concatenate([low, ids[odd]]), np.concatenate([one, odd])


def packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers as differences, byte by byte of equal weight, compressed."""
    planes = [np.diff(x.astype(np.int64), prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays]
    return struct.pack(f"<{len(arrays) + 1}Q", len(arrays), *(len(x) for x in arrays)) + zstandard.compress(b"".join(planes), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<Q", data)[0]
    sizes = struct.unpack_from(f"<{n}Q", data, 8)
    flat = np.frombuffer(zstandard.decompress(data[8 + 8 * n :]), np.uint8)
    ends = np.cumsum(np.array(sizes, np.int64) * 8)
    return [np.cumsum(np.ascontiguousarray(flat[e - 8 * k : e].reshape(8, k).T).view("<i8").reshape(-1)) for e, k in zip(ends, sizes)]


def cut_up(docs: DataFrame, length: int, n_buckets: int, heavy: np.ndarray) -> DataFrame:
    """Rows (bucket, piece, kind, facts, text) of each piece, a stretch of consecutive documents.

    SEGMENTS by bucket; SPANS, of what is found removable here; DOCS, the ids and marks that the
    numbers of documents in the other rows stand for.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(heavy))  # 128 KiB

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, heavy = zstandard.ZstdCompressor(level=1), np.unpackbits(sent.value).astype(bool)
        for whole in batches:
            for batch in pieces(whole, "_text", PIECE):
                run, offsets = texts(batch.column("_text"))
                ids = batch.column("_id").to_numpy(zero_copy_only=False)
                marks = batch.column("_mark").to_numpy(zero_copy_only=False)
                # the same for the same documents, so a task that runs again gives the same rows
                piece = int(mixed((ids.view(np.uint64) * STEP ^ marks.view(np.uint64)) + np.arange(len(ids), dtype=np.uint64)).sum(dtype=np.uint64)) - 2**63
                doc, first, size, at, deal, keys = segments(run, offsets, length, heavy)
                which, low, _ = equal_runs(keys, ids[doc], run, first, size)
                known = ids[doc] > low[which]
                start, side = first - offsets[doc], abs(piece) % n_buckets
                rows = [(side, piece, DOCS, packed(ids, marks), b"")]
                if known.any():
                    rows.append((side, piece, SPANS, packed(doc[known], start[known], size[known] - length + 1), b""))
                bucket = (deal % np.uint64(n_buckets)).astype(np.int64)
                order = np.flatnonzero(~known)[np.argsort(bucket[~known], kind="stable")]
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if y > x:
                        pick = order[x:y]
                        used, own = np.unique(doc[pick], return_inverse=True)
                        rows.append((k, piece, SEGMENTS, packed(used, ids[used], own, start[pick], size[pick], at[pick]), press.compress(run[ragged(first[pick], size[pick])].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "piece", "kind", "facts", "text"])
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(cut, "bucket long, piece long, kind int, facts binary, text binary")


def suffix_array(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The places of a text in the order of their suffixes, which end with their segments.

    words: eight(), zeros past a segment's end; left: bytes left in the segment from each place on.
    Equal suffixes stand in the order of their places; with that, Kasai's rule holds.
    """
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    new = np.append(True, sorted_words[1:] != sorted_words[:-1])
    rank = np.zeros(len(words), np.int64)
    slots = np.flatnonzero(new)
    rank[order] = slots[np.cumsum(new) - 1]
    covered, longest = 8, int(left.max()) if len(left) else 0
    while covered < longest:
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        mine = order[open_]
        further = np.where(left[mine] > covered, rank[np.minimum(mine + covered, len(rank) - 1)] + 1, 0)
        key = rank[mine].astype(np.uint64) << np.uint64(32) | further.astype(np.uint64)
        resort = np.argsort(key, kind="stable")
        order[open_] = mine[resort]
        key = key[resort]
        new[open_] = np.append(True, key[1:] != key[:-1])
        slots = np.flatnonzero(new)
        rank[order[open_]] = slots[np.searchsorted(slots, open_, "right") - 1]
        covered *= 2
    return order


def common_prefixes(words: np.ndarray, starts: np.ndarray, n_passages: np.ndarray, before: np.ndarray, length: int) -> np.ndarray:
    """For each place, bytes up to length that it has in common with before (-1: none), by Kasai's rule.

    All segments go forward in step, a place at a time.
    """
    out = np.zeros(len(words), np.int64)
    has_next = np.zeros(len(words), bool)  # the place after it is a passage of the same segment
    has_next[ragged(starts, n_passages - 1)] = True
    live, have, carried = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    for step in range(int(n_passages.max()) if len(n_passages) else 0):
        live = live[n_passages[live] > step]
        p = starts[live] + step
        q, h = before[p], np.where(carried[live] >= 0, np.maximum(have[live] - 1, 0), 0)
        todo = np.flatnonzero(q >= 0)
        h[q < 0] = 0
        while len(todo):
            x = words[np.minimum(p[todo] + h[todo], len(words) - 1)] ^ words[np.minimum(q[todo] + h[todo], len(words) - 1)]
            same = sum((x < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(8))
            h[todo] = np.minimum(h[todo] + same, length)
            todo = todo[(same == 8) & (h[todo] < length)]
        out[p], have[live] = h, h
        carried[live] = np.where((q >= 0) & has_next[np.maximum(q, 0)], q, -1)
    return out


class Shard:
    """Segments, the smallest id of each, and what their suffix array shows."""

    def __init__(self, run: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int):
        starts = np.cumsum(sizes) - sizes
        left = np.repeat(starts + sizes, sizes) - np.arange(len(run))
        words = eight(run)
        short = np.flatnonzero(left < 8)
        words[short] &= ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * left[short].astype(np.uint64))
        passage = left >= length
        order = suffix_array(words, left)
        order = order[passage[order]]
        before = np.full(len(run), -1, np.int64)
        before[order[1:]] = order[:-1]
        prefix = common_prefixes(words, starts, sizes - length + 1, before, length)
        new = prefix[order] < length
        if len(new):
            new[0] = True
        self.run, self.length, self.first = run, length, order[np.flatnonzero(new)]
        place_ids = np.repeat(ids, sizes)
        self.low = np.minimum.reduceat(place_ids[order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
        self.cls = np.full(len(run), -1, np.int64)
        self.cls[order] = np.cumsum(new) - 1
        self.place_ids, self.starts, self.n_passages = place_ids, starts, sizes - length + 1

    def passages(self) -> np.ndarray:
        """One passage of each class, in order."""
        rows = self.run[self.first[:, None] + np.arange(self.length)]
        return np.ascontiguousarray(rows).view(f"S{self.length}").reshape(-1)

    def merge(self, other: Shard) -> None:
        """Take over the smaller ids that the other shard has for the same passages."""
        mine, theirs = self.passages(), other.passages()
        at = np.minimum(np.searchsorted(theirs, mine), max(len(theirs) - 1, 0))
        same = theirs[at] == mine if len(theirs) else np.zeros(len(mine), bool)
        self.low = np.where(same, np.minimum(self.low, other.low[at] if len(theirs) else self.low), self.low)

    def removable(self) -> np.ndarray:
        """Places at which a passage starts that a smaller id has."""
        return (self.cls >= 0) & (self.place_ids > self.low[np.maximum(self.cls, 0)])


def settled(group: np.ndarray, ids: np.ndarray, sizes: np.ndarray, run: np.ndarray, length: int, most: int) -> np.ndarray:
    """Of distinct segments sorted by group, the places at which a smaller id's passage starts."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    shards, at = [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right")))
        if to < len(sizes) and group[to] == group[to - 1] and group[at] != group[to]:
            to = int(np.searchsorted(group, group[to], "left"))  # keep a group whole if that is possible
        shards.append((at, to, Shard(run[starts[at] : ends[to - 1]], sizes[at:to], ids[at:to], length)))
        at = to
    lows = [s.low.copy() for *_, s in shards]
    for x, (a, b, s) in enumerate(shards):
        for y, (c, d, t) in enumerate(shards):
            if x != y and group[a] <= group[d - 1] and group[c] <= group[b - 1]:
                kept, s.low = s.low, lows[x]
                s.merge(t)
                lows[x], s.low = s.low, kept
    out = []
    for low, (*_, s) in zip(lows, shards):
        s.low = low
        out.append(s.removable())
    return np.concatenate([np.zeros(0, bool), *out])


def found_in(table: pa.Table, length: int, most: int) -> pa.Table:
    """Rows (piece, kind, facts) of a bucket: its SPANS and DOCS as they came, and SPANS found here."""
    kinds, piece_of = table.column("kind").to_pylist(), table.column("piece").to_pylist()
    facts, runs = table.column("facts"), table.column("text")
    out = [(piece_of[k], kind, facts[k].as_py()) for k, kind in enumerate(kinds) if kind != SEGMENTS]
    rows = [k for k, kind in enumerate(kinds) if kind == SEGMENTS]
    got, base, names, owners, ids_of = [], 0, [], [], []
    for j, k in enumerate(rows):
        used, ids, own, *rest = unpacked(facts[k].as_py())
        names.append(used)
        ids_of.append(ids)
        owners.append(np.full(len(used), j))
        got.append([own + base, *rest])
        base += len(used)
    if not rows:
        return _spans_table(out)
    doc_of, begin, sizes, at = (np.concatenate(c) for c in zip(*got))
    ids_of, names, owners = np.concatenate(ids_of), np.concatenate(names), np.concatenate(owners)
    ids = ids_of[doc_of]
    run = np.concatenate([np.frombuffer(zstandard.decompress(runs[k].as_py()), np.uint8) for k in rows])
    doc, start, count = [], [], []
    if len(sizes):
        places = np.cumsum(sizes) - sizes
        view = eights(run, ">")  # only what is asked for becomes numbers
        group, _ = by_key(mixed(view[places + at].astype(np.uint64) * STEP ^ mixed(view[places + at + 8].astype(np.uint64) + STEP)), ids)
        low, high = np.full(int(group.max()) + 1, NO_ID, np.int64), np.full(int(group.max()) + 1, -(2**63), np.int64)
        np.minimum.at(low, group, ids)
        np.maximum.at(high, group, ids)
        pick = np.flatnonzero((low < high)[group])
        if len(pick):
            group, ids, sizes, at, doc_of, begin = (x[pick] for x in (group, ids, sizes, at, doc_of, begin))
            run = run[ragged(places[pick], sizes)]
            places = np.cumsum(sizes) - sizes
            key = mixed(run_hashes(run, places, sizes) + (at.astype(np.uint64) + np.uint64(1)) * STEP)
            which, low, one = equal_runs(key, ids, run, places, sizes)
            later = ids > low[which]  # equal as a whole to a segment of a smaller id
            doc.append(doc_of[later])
            start.append(begin[later])
            count.append(sizes[later] - length + 1)
            several = np.bincount(group[one]) > 1
            one = one[several[group[one]]]
            one = one[np.argsort(group[one], kind="stable")]
            if len(one):
                hit = settled(group[one], ids[one], sizes[one], run[ragged(places[one], sizes[one])], length, most)
                first = np.cumsum(sizes[one]) - sizes[one]
                slot = np.full(len(low), -1, np.int64)
                slot[which[one]] = np.arange(len(one))
                mine = np.flatnonzero(~later & (slot[which] >= 0))  # all segments of the class's own id
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                edge_starts, edge_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                owner = np.searchsorted(first, edge_starts, "right") - 1  # a run of hits ends with its segment: its last bytes start no passage
                order = np.argsort(slot[which[mine]], kind="stable")
                mine = mine[order]
                per = np.searchsorted(slot[which[mine]], np.arange(len(one) + 1))
                n = (per[1:] - per[:-1])[owner]
                rep, seg = np.repeat(np.arange(len(owner)), n), mine[ragged(per[:-1][owner], n)]
                doc.append(doc_of[seg])
                start.append(begin[seg] + (edge_starts - first[owner])[rep])
                count.append((edge_ends - edge_starts)[rep])
    if doc:
        doc, start, count = (np.concatenate(x) for x in (doc, start, count))
        order = np.lexsort((start, doc))
        doc, start, count = doc[order], start[order], count[order]
        cuts = np.searchsorted(owners[doc], np.arange(len(rows) + 1))
        out += [(piece_of[k], SPANS, packed(names[doc[x:y]], start[x:y], count[x:y])) for k, x, y in zip(rows, cuts[:-1], cuts[1:]) if y > x]
    return _spans_table(out)


def _spans_table(rows: list[tuple]) -> pa.Table:
    return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("piece", pa.int64()), ("kind", pa.int32()), ("facts", pa.binary())))})


def merged(table: pa.Table, length: int) -> pa.Table:
    """_id, _mark, starts and ends of the maximal removed runs of bytes of a piece's documents."""
    kinds, facts = table.column("kind").to_pylist(), table.column("facts")
    ids, marks = next(unpacked(facts[k].as_py()) for k, kind in enumerate(kinds) if kind == DOCS)
    got = [unpacked(facts[k].as_py()) for k, kind in enumerate(kinds) if kind == SPANS]
    if not got:
        return pa.table({"_id": ids[:0], "_mark": marks[:0], "starts": pa.array([], pa.list_(pa.int64())), "ends": pa.array([], pa.list_(pa.int64()))})
    doc, start, count = (np.concatenate(c) for c in zip(*got))
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + count + length - 1)[order]
    shift = doc * (int(end.max()) + 1)  # documents one after the other, so one running maximum does for all
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, start[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    own = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    bounds = pa.array(np.append(np.searchsorted(first, own), len(first)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (start[first], reach[last] - shift[last])]
    return pa.table({"_id": ids[doc[own]], "_mark": marks[doc[own]], "starts": lists[0], "ends": lists[1]})


def spans(docs: DataFrame, *, length: int, shard_bytes: int, task_bytes: int, heavy_bytes: int) -> DataFrame:
    """_id (NO_ID for null), _mark, starts, ends of the removed runs of docs (_id, _mark, _text) that have any."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0))).first()[0]
    n_tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // task_bytes)
    cut = cut_up(docs, length, 2 * n_tasks, heavy_cells(docs, length, heavy_bytes))
    found = cut.repartition(n_tasks, "bucket").groupBy("bucket").applyInArrow(lambda t: found_in(t, length, shard_bytes), "piece long, kind int, facts binary")
    out = found.groupBy("piece").applyInArrow(lambda t: merged(t, length), "_id long, _mark long, starts array<long>, ends array<long>")
    return out.distinct()  # pieces of equal documents are one piece, and so are rows that repeat a document


def _trimmed(text: Column, gap: Column) -> Column:
    """gap (a, n) of text without the bytes of characters that begin before it or end after it."""
    part = lambda at, n: F.hex(F.substring(text, (at + 1).cast("int"), n.cast("int")))
    three = F.least(gap["n"], F.lit(3))
    lead = F.when(gap["a"] > 0, F.length(F.regexp_extract(part(gap["a"], three), "^((?:[89AB].)*)", 1)) / 2).otherwise(0).cast("long")
    tail = (F.length(F.regexp_extract(part(gap["a"] + gap["n"] - three, three), "([C-F].|[EF].[89AB].|F.[89AB].[89AB].)$", 1)) / 2).cast("long")
    return F.struct((gap["a"] + lead).alias("a"), F.greatest(gap["n"] - lead - tail, F.lit(0)).alias("n"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = 4 << 20, task_bytes: int = 8 << 20, heavy_bytes: int = 16 << 20, whole_chars: bool = False) -> DataFrame:
    """docs with _n_bytes, _starts and _ends (of the removed runs, in bytes) and _kept, the bytes that stay.

    shard_bytes: bytes of segments in a suffix array; task_bytes: bytes of text for each task that
    compares segments, of which there are three to four times as many bytes. whole_chars: of a
    character that a cut splits, no byte is in _kept, which then is valid UTF-8.
    """
    if length < GRAM:
        raise ValueError(f"passages have {GRAM} bytes or more")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_mark"), text.alias("_text"))
    found = written(spans(marked.drop("_row"), length=length, shard_bytes=shard_bytes, task_bytes=task_bytes, heavy_bytes=heavy_bytes), "spans")
    freed(docs.sparkSession)
    out = marked.join(found, ["_id", "_mark"], "left")
    # what stays between removed runs
    none = F.array().cast("array<long>")
    ends, starts = F.coalesce("ends", none), F.coalesce("starts", none)
    size = F.octet_length("_text").cast("long")
    gaps = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), ends), F.concat(starts, F.array(size)), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    if whole_chars:
        gaps = F.transform(gaps, lambda g: _trimmed(F.col("_text"), g))
    kept = F.aggregate(gaps, F.lit(b"").cast("binary"), lambda s, g: F.concat(s, F.substring(F.col("_text"), (g["a"] + 1).cast("int"), g["n"].cast("int"))))
    kept = F.when(F.col("starts").isNull(), F.col("_text")).otherwise(kept)
    # in two steps, so that no column of docs is taken for one of those here
    out = out.select("_row", size.alias("x0"), starts.alias("x1"), ends.alias("x2"), kept.alias("x3"))
    return out.select("_row.*", *(F.col(f"x{k}").alias(c) for k, c in enumerate(("_n_bytes", "_starts", "_ends", "_kept"))))


def query(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate(F.zip_with("_ends", "_starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, n: s + n)
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("_starts").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))
