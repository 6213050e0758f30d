"""Token ids in files of patched frame-of-reference blocks.

Documents are range-partitioned by id, and a range becomes one or more files, each a row of segments
of a bounded number of bytes of text. A segment has a head (the number of its range, its own number
within the range, counts), the ids and lengths of its documents, the index (start of every block) and the blocks. A block holds up to BLOCK ids: the
block's minimum is subtracted and the differences are packed at the width that fits a set share of
them; of the others, the outliers, the high bits stand in an exception list after the packed bits.
Spark's own text writer writes segments as the bytes they are, each followed by one line end, so
files of lost tasks never show; readers go by the numbers and counts in the heads, never by the names
of files.

Defined cases: a null text is empty and gives the end id alone; a null id comes first and stays
null; documents with the same id stand in the order of their texts; a
text longer than a segment makes one of its own; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, written
from .packing import tokenizer_path
from .tokens import encoder
from .words import pieces, ragged

BLOCK, SHARE, END_ID = 128, 0.9, 1
#: Of a segment: magic, ids a block, the number of its range of ids and its own in that range, documents, ids, bytes of blocks.
HEAD, MAGIC = struct.Struct("<4sIIIQQQ"), b"PFR2"
READ = "part int, segment int, place int, doc_id long, n_tokens long, ids_crc32 long"


def packed_blocks(ids: np.ndarray, share: float = SHARE) -> tuple[bytes, np.ndarray]:
    """Blocks of ids one after the other, and where each starts."""
    n = len(ids)
    rows = -(-n // BLOCK)
    filled = np.concatenate([ids.astype(np.uint32), np.full(rows * BLOCK - n, ids[-1] if n else 0, np.uint32)]).reshape(rows, BLOCK)
    low = filled.min(1)
    rest = filled - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1]  # bit lengths
    width = np.sort(bits, 1)[:, int(np.ceil(share * BLOCK)) - 1]
    out_at, out_high = np.nonzero(bits > width[:, None]), rest >> width[:, None].astype(np.uint32)
    n_out = np.bincount(out_at[0], minlength=rows)
    sizes = 6 + width * (BLOCK // 8) + 5 * n_out
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for k, column in enumerate((*low.view(np.uint8).reshape(rows, 4).T, width.astype(np.uint8), n_out.astype(np.uint8))):
        data[starts + k] = column
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        planes = rest[mine][:, :, None] >> np.arange(w, dtype=np.uint32) & np.uint32(1)
        put = np.packbits(planes.astype(np.uint8).reshape(len(mine), -1), axis=1, bitorder="little")
        data[starts[mine][:, None] + 6 + np.arange(put.shape[1])] = put
    if len(out_at[0]):
        first = (starts + 6 + width * (BLOCK // 8))[out_at[0]] + 5 * ragged(np.zeros(rows, np.int64), n_out)
        data[first] = out_at[1]
        data[first[:, None] + 1 + np.arange(4)] = out_high[out_at].astype("<u4").view(np.uint8).reshape(-1, 4)
    return data.tobytes(), starts


def unpacked_blocks(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ids that packed_blocks() was given, of the blocks that start at starts; n ids in all."""
    rows = len(starts)
    low = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4").reshape(rows)
    width, n_out = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    out = np.zeros((rows, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        planes = np.unpackbits(data[starts[mine][:, None] + 6 + np.arange(w * (BLOCK // 8))], axis=1, bitorder="little").reshape(len(mine), BLOCK, w)
        out[mine] = (planes.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(2, dtype=np.uint32)
    if n_out.any():
        block = np.repeat(np.arange(rows), n_out)
        first = (starts + 6 + width * (BLOCK // 8))[block] + 5 * ragged(np.zeros(rows, np.int64), n_out)
        high = np.ascontiguousarray(data[first[:, None] + 1 + np.arange(4)]).view("<u4").reshape(-1)
        out[block, data[first]] |= high << width[block].astype(np.uint32)
    return (out + low[:, None]).reshape(-1)[:n]


def segment(part: int, number: int, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: its head, ids of documents, which of them are not null, lengths, index, blocks."""
    blocks, starts = packed_blocks(ids)
    parts = [doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), blocks]
    return HEAD.pack(MAGIC, BLOCK, part, number, len(doc_ids), len(ids), len(blocks)) + b"".join(parts)


def segments(data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the range and in it, doc_ids, known, lengths and ids of every segment of a file."""
    at = 0
    while at < len(data):
        magic, block, part, number, n_docs, n_ids, n_bytes = HEAD.unpack(data[at : at + HEAD.size].tobytes())
        if magic != MAGIC or block != BLOCK:
            raise ValueError(f"no segment of blocks of {BLOCK} ids at byte {at}")
        at += HEAD.size
        parts = []
        for kind, n in (("<i8", n_docs), (np.uint8, n_docs), ("<u4", n_docs), ("<u8", -(-n_ids // BLOCK))):
            size = n * np.dtype(kind).itemsize
            parts.append(np.frombuffer(data[at : at + size].tobytes(), kind))
            at += size
        yield part, number, parts[0], parts[1].astype(bool), parts[2].astype(np.int64), unpacked_blocks(data[at : at + n_bytes], parts[3].astype(np.int64), n_ids)
        at += n_bytes + 1  # and the line end


def write_files(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, segment_bytes: int = 4 << 20, segments_per_file: int = 16, files: int | None = None) -> None:
    """Write the ids of docs, end_id after each, to files under path in ascending order of id.

    segment_bytes: bytes of text that a segment covers, a longer text alone. files: range partitions.
    """
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in pieces(whole, "_text", segment_bytes):
                ids, at = encode(batch.column("_text"))
                keys = batch.column("_id")
                row = segment(part, number, keys.fill_null(0).to_numpy(zero_copy_only=False), ~keys.is_null().to_numpy(zero_copy_only=False), np.diff(at) + 1, np.insert(ids, at[1:], end_id))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["segment"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    ordered = rows.repartitionByRange(n, "_id").sortWithinPartitions("_id", "_text")
    ordered.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", segments_per_file).option("compression", "none").text(path)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in READ.split(", ")])
    for batch in batches:
        for content in batch.column("content"):
            for part, number, doc_ids, known, lengths, ids in segments(np.frombuffer(content.as_buffer(), np.uint8)):
                ends, raw = np.cumsum(lengths), ids.astype("<u4")
                crcs = [zlib.crc32(raw[b - n : b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                out = [np.full(len(crcs), part), np.full(len(crcs), number), np.arange(len(crcs)), pa.array(doc_ids, mask=~known), lengths, crcs]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, place, doc_id, n_tokens, ids_crc32 of every document in the files under path."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_rows, READ)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of every document in the files under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for _, _, doc_ids, known, lengths, ids in segments(np.frombuffer(content.as_buffer(), np.uint8)):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=~known), lists], names=["doc_id", "ids"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id long, ids array<int>")


def with_starts(read: DataFrame) -> DataFrame:
    """read, stored rows of read_files(), with the ids before each document in all files.

    Sums by segment come first; of them only those by range, a row a task of the writer, are ordered
    as a whole.
    """
    sums = read.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("_part"))
    sums = sums.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("_segment")).join(parts, "part")
    here = Window.partitionBy("part", "segment").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return read.join(sums, ["part", "segment"]).select(
        "doc_id", (F.col("_part") + F.col("_segment") + F.coalesce(F.sum("n_tokens").over(here), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )


def query(spark, sf_dir: str) -> DataFrame:
    write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path := new_path(spark, "token-ids"), tokenizer_path("word_bpe_49k.json"))
    return with_starts(written(read_files(spark, path), "token-rows"))
