"""Cutting files into chunks and counting what deduplication saves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


def profile_size(size: Column, profile: str = "standard") -> Column:
    """Chunk size by profile; adaptive follows the file: null (content-defined) from 4 GiB on."""
    fixed = {"small": 256 * KIB, "standard": 512 * KIB, "large": MIB}
    if profile in fixed:
        return F.lit(fixed[profile])
    if profile != "adaptive":
        raise ValueError(f"no profile {profile!r}")
    return F.when(size < 16 * MIB, fixed["small"]).when(size < 256 * MIB, fixed["standard"]).when(size < 4 * GIB, fixed["large"])


def fixed_chunks(files: DataFrame, chunk_size: int | Column, *, content: str = "content") -> DataFrame:
    """A row for each chunk: columns of files but the content, ordinal, offset, chunk_bytes, hash.

    An empty or null file has no chunk; the last chunk may be short.
    """
    if isinstance(chunk_size, int) and chunk_size <= 0:
        raise ValueError("chunks have one byte or more")
    size = F.lit(chunk_size) if isinstance(chunk_size, int) else chunk_size
    length = F.octet_length(content)
    rows = files.withColumn("_n", size.cast("long")).filter(length > 0)
    last = F.ceil(length / F.col("_n")).cast("long") - 1
    rows = rows.withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("offset", F.col("ordinal") * F.col("_n"))
    data = F.substring(F.col(content), (F.col("offset") + 1).cast("int"), F.col("_n").cast("int"))
    return rows.withColumns({"chunk_bytes": F.octet_length(data).cast("long"), "hash": F.sha2(data, 256)}).drop(content, "_n")


def gear_cuts(data: bytes, least: int, mask_bits: int, most: int) -> list[int]:
    """Ends of content-defined chunks: from least bytes on, cut where the last mask_bits bits of the rolling sum are zero.

    The rolling sum h = 2h + byte is looked at only in its last mask_bits bits, which forget a byte
    after as many steps. So all places of the file are computed at once, as a sum of shifted copies;
    the first mask_bits - 1 of a chunk's search, where the sum is still short, are counted one by one.
    """
    out, at, n, mask = [], 0, len(data), (1 << mask_bits) - 1
    h = np.frombuffer(data, np.uint8).astype(np.uint16 if mask_bits <= 16 else np.uint64)
    step = 1
    while step < min(mask_bits, n):
        grown = h.copy()
        grown[step:] += h[:-step] << h.dtype.type(step)
        h, step = grown, step * 2
    hits = np.flatnonzero((h & h.dtype.type(mask)) == 0)
    while n - at > least:
        begin, end = at + least, min(n, at + most)
        cut, short, full = end, 0, begin + max(mask_bits - 1, 0)
        for place in range(begin, min(full, end)):
            short = (2 * short + data[place]) & mask
            if short == 0:
                cut = place + 1
                break
        else:
            k = int(np.searchsorted(hits, full))
            if k < len(hits) and hits[k] < end:
                cut = int(hits[k]) + 1
        out.append(cut)
        at = cut
    if at < n:
        out.append(n)
    return out


def content_chunks(files: DataFrame, *, least: int, average: int, most: int, content: str = "content", key: str = "path") -> DataFrame:
    """Content-defined chunks, a row each: key, ordinal, offset, chunk_bytes, hash."""
    bits = average.bit_length() - 1
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        names = ["ordinal", "offset", "chunk_bytes", "hash"]
        for pdf in batches:
            rows, owners, n = [[], [], [], []], [], []
            for name, data in zip(pdf[key], pdf[content]):
                if data:
                    ends = gear_cuts(bytes(data), least, bits, most)
                    starts = [0, *ends[:-1]]
                    owners.append(name)
                    n.append(len(ends))
                    for column, values in zip(rows, (range(len(ends)), starts, [b - a for a, b in zip(starts, ends)], [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(starts, ends)])):
                        column.extend(values)
            if owners:
                yield pd.DataFrame({key: pd.Series(owners).repeat(n).to_numpy(), **dict(zip(names, rows))})

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, ordinal long, offset long, chunk_bytes long, hash string")


def dedup_ratio(chunks: DataFrame) -> DataFrame:
    """One row: refs, unique_chunks, bytes, stored_bytes, ratio (0 without bytes)."""
    unique = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.sum("chunk_bytes").alias("all"), F.max("chunk_bytes").alias("one"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = unique.agg(total("n").alias("refs"), F.count("*").alias("unique_chunks"), total("all").alias("bytes"), total("one").alias("stored_bytes"))
    return out.withColumn("ratio", F.round(F.coalesce(1 - F.col("stored_bytes") / F.nullif(F.col("bytes"), F.lit(0)), F.lit(0.0)), 6))


def first_seen(chunks: DataFrame, *order: str) -> DataFrame:
    """chunks with stored: is this the first sighting of its hash in the given order.

    Contents are hashed once, into a narrow table. Only hashes that come more than once are joined
    back; their minima come from an aggregate with partial sums, so a hash of very many chunks isn't
    sorted in one task, and Spark splits its rows in the join.
    """
    rows = stored(chunks, "chunks")
    first = rows.groupBy("hash").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(first, "hash", "left").withColumn("stored", F.coalesce(F.struct(*order) == F.col("_first"), F.lit(True))).drop("_first")


def backup_totals(files: DataFrame, chunks: DataFrame, *order: str) -> DataFrame:
    """One row: files, skipped_files, skipped (their paths in order), chunks, bytes, stored_bytes, ratio.

    files: path, readable; chunks: those of readable files (hash, chunk_bytes). skipped lists what an
    operator has to look after; it is as long as there are unreadable files.
    """
    gone = F.filter(F.array_sort(F.collect_list(F.when(~F.col("readable"), F.col("path")))), lambda p: p.isNotNull())
    f = files.agg(F.count_if("readable").alias("files"), F.count_if(~F.col("readable")).alias("skipped_files"), F.array_join(gone, ",").alias("skipped"))
    return f.crossJoin(dedup_ratio(chunks).select(F.col("refs").alias("chunks"), "bytes", "stored_bytes", "ratio"))


def prefix_reuse(new: DataFrame, old: DataFrame, key: str = "path") -> DataFrame:
    """Chunks of new with reused: are this and all chunks before it the same at the same place in old."""
    same = F.coalesce(F.col("hash") == F.col("_old"), F.lit(False)).cast("int")
    rows = new.join(old.select(key, "ordinal", F.col("hash").alias("_old")), [key, "ordinal"], "left")
    upto = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("reused", F.min(same).over(upto) == 1).drop("_old")


def put_chunks(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """The index (hash, ref_count, stored_size, status) after a batch of puts (hash, size).

    A hash with an active entry gains references; any other is stored anew, also one that was purged.
    """
    batch = incoming.groupBy("hash").agg(F.count("*").alias("_n"), F.max("size").alias("_size"))
    live = F.col("status") == "active"
    return index.join(batch, "hash", "full_outer").select(
        "hash",
        (F.when(live | F.col("_n").isNull(), F.col("ref_count")).otherwise(F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("ref_count"),
        F.coalesce("stored_size", "_size").cast("long").alias("stored_size"),
        F.when(F.col("_n").isNotNull(), "active").otherwise(F.col("status")).alias("status"),
    )
