"""Best-fit packing of token sequences by minimum bin slack.

Texts become ids in tasks; only the places and lengths of their pieces move on. Which pieces share a
sequence depends on lengths alone, so the whole corpus is a table of counts by length, at most one
row for each length up to the size of a sequence. Over it runs minimum bin slack: the longest piece
left takes a sequence, a subset sum over the lengths left (the reachable sums are bits of one
integer) finds the fullest combination beside it, and that combination is removed as often as the
counts allow, which is what removing it once again and again would do. Each use of a length in a
combination covers a range of the pieces of that length, so pieces find their places by their number
within their length. Those numbers come from counts by (length, salt), with as many salts as the
number of pieces asks for: no length gathers in a task. A piece as long as a sequence is one.

Defined cases: a null text is empty and gives a piece with the end id alone; repeated rows are
separate documents; a null id is kept; a text of any length is encoded whole; an empty table gives no rows. Other columns aren't returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder
from .words import pieces, ragged

SIZE, END_ID = 1024, 2
#: Pieces that a (length, salt) should hold at most, if salts spread evenly.
CELL = 500_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The uses of lengths (length: copies, at most counts) with the largest sum up to room.

    Longer lengths are tried first and preferred.
    """
    reach, steps, all_bits = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & all_bits
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    total, uses = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            uses[length] = uses.get(length, 0) + take
            total -= length * take
    return uses


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int]]:
    """(length, number of the first piece, first sequence, offset) for runs of pieces of a length."""
    counts, used, at, out = {k: n for k, n in counts.items() if n}, dict.fromkeys(counts, 0), 0, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        uses = fullest(rest, size - longest)
        uses[longest] = uses.get(longest, 0) + 1
        times, offset = min(counts[k] // n for k, n in uses.items()), 0
        for length in sorted(uses, reverse=True):
            for _ in range(uses[length]):
                out.append((length, used[length], at, offset))
                used[length] += times
                offset += length
            counts[length] -= times * uses[length]
            if not counts[length]:
                del counts[length]
        at += times
    return out


def cut(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, start and length of the pieces of documents with n ids: all but the first are full."""
    parts = -(-n // size)
    row = np.repeat(np.arange(len(n)), parts)
    piece = ragged(np.zeros(len(n), np.int64), parts)
    head = n - (parts - 1) * size
    start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
    return row, piece, start, np.where(piece == 0, head[row], size)


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in batches:
            for batch in pieces(whole, text_col, 2 << 20):
                ids, at = encode(batch.column(text_col))
                n = np.diff(at)
                row, piece, start, length = cut(n + 1, size)
                ends = np.insert(ids, at[1:], end_id).astype("<u4")
                first = at[:-1][row] + row + start
                crcs = [zlib.crc32(ends[a : a + k]) for a, k in zip(first.tolist(), length.tolist())]
                out = [batch.column(id_col).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ends, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def placed(parts: DataFrame, *, size: int = SIZE, id_col: str = "doc_id") -> DataFrame:
    """parts, a stored table from token_pieces(), with sequence_id and offset."""
    whole, rest = parts.filter(F.col("length") == size), parts.filter(F.col("length") < size)
    salts = max(64, rest.count() // CELL)
    salted = rest.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    slots = sorted(plan(counts, size))
    keys = np.array([s[0] << 48 | s[1] for s in slots], np.int64)
    sequence, offset = np.array([s[2] - s[1] for s in slots], np.int64), np.array([s[3] for s in slots], np.int64)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(keys, length.to_numpy(np.int64) << 48 | number.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": sequence[k] + number.to_numpy(np.int64), "offset": offset[k]})

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "start", "ids_crc32"))
    rows = salted.withColumn("_number", number).join(starts, ["length", "_salt"])
    names = [*parts.columns, "sequence_id", "offset"]
    shared = rows.withColumn("_place", place("length", F.col("_before") + F.col("_number") - 1)).select(*parts.columns, "_place.sequence_id", "_place.offset")
    alone = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})  # apart from the plan's numbers
    return shared.select(names).unionByName(alone.select(names))


def packed(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with their places in as few sequences of size ids as the method finds."""
    parts = token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, size=size, end_id=end_id, with_ids=with_ids)
    return placed(written(parts, "pieces"), size=size, id_col=id_col)


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """sequence_id, ids: the sequences themselves, from packed(..., with_ids=True)."""
    members = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # size ids at most
    return pieces_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(members, lambda m: m["ids"])).alias("ids"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
