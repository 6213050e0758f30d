"""File trees and repositories of chunks and manifests as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import passes
from ..shared import deleted, stored

MANIFEST = "version_id LONG, ts TIMESTAMP_NTZ, files ARRAY<STRUCT<path: STRING, size: LONG, mtime: LONG, chunks: ARRAY<STRING>>>"


def scan(spark: SparkSession, roots: str | list[str], *, with_content: bool = False, only: str | None = None, include: list[tuple[str, str]] = (), exclude: list[tuple[str, str]] = ()) -> DataFrame:
    """path, size, mtime (microseconds) and, if asked for, content of all files under the roots that pass the rules.

    only: a glob on base names, applied while listing. Roots that aren't there and files that go
    meanwhile are left out, and so are empty files, which the reader makes no rows of.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    there = [r for r in roots if _exists(spark, r)]
    columns = [F.col("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime")]
    names = [*columns, *(["content"] if with_content else [])]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    reader = reader.option("pathGlobFilter", only) if only else reader
    rows = reader.load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return rows.filter(passes(F.col("path"), list(include), list(exclude))).select(*names)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def estimate(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def bucket(digest: Column) -> Column:
    """The first byte of a hexadecimal digest: 256 buckets."""
    return F.substring(digest, 1, 2)


def chunk_path(digest: Column) -> Column:
    return F.concat(bucket(digest), F.lit("/"), digest, F.lit(".chunk"))


def store_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunks (hash, data), one of each hash, to a table partitioned by bucket. Its commit shows whole jobs only."""
    one = chunks.groupBy("hash").agg(F.first("data").alias("data"))
    one.withColumn("bucket", bucket(F.col("hash"))).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def checked_chunks(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """hash, data, verdict (pass, mismatch, missing) for each wanted hash; only buckets that hold some are read."""
    stored = spark.read.parquet(path)
    asked = wanted.select("hash").distinct().withColumn("bucket", bucket(F.col("hash")))
    verdict = F.when(F.col("data").isNull(), "missing").when(F.sha2("data", 256) == F.col("hash"), "pass").otherwise("mismatch")
    return asked.join(stored, ["bucket", "hash"], "left").select("hash", "data", verdict.alias("verdict"))


def remove_chunks(spark: SparkSession, path: str, gone: DataFrame) -> DataFrame:
    """Take the chunks of gone (hash) out of the table at path; their hashes and freed bytes are returned.

    Only buckets that hold some are written again, each replaced as a whole.
    """
    asked = gone.select("hash").distinct().withColumn("bucket", bucket(F.col("hash")))
    table = spark.read.parquet(path)
    found = stored(table.join(asked, ["bucket", "hash"], "left_semi").select("hash", "bucket", F.octet_length("data").cast("long").alias("freed")), "removed")
    touched = [r[0] for r in found.select("bucket").distinct().collect()]  # 256 at most
    if touched:
        rest = stored(table.filter(F.col("bucket").isin(touched)).join(asked, ["bucket", "hash"], "left_anti").select(*table.columns), "kept-chunks")
        left = {r[0] for r in rest.select("bucket").distinct().collect()}
        rest.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        for b in set(touched) - left:
            place, fs = _place(spark, f"{path}/bucket={b}")
            fs.delete(place, True)
        deleted(rest)
    return found.select("hash", "freed")


def remove_object(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; False if it isn't there."""
    place, fs = _place(spark, path)
    return fs.delete(place, True)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Append manifests (of MANIFEST), a JSON object a line; they show once the whole job is done."""
    manifests.select("version_id", "ts", "files").write.mode("append").json(path)


def framed_manifest(manifest: Column) -> Column:
    """A manifest (JSON text) as a frame: its length in four bytes, big-endian, and its bytes."""
    data = manifest.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data)


def unframed_manifest(frame: Column) -> Column:
    """The JSON text of a frame; one that is cut short is an error, bytes behind it don't count."""
    size = F.conv(F.hex(F.substring(frame, 1, 4)), 16, 10).cast("int")
    whole = (F.octet_length(frame) >= 4) & (F.octet_length(frame) >= size + 4)
    return F.when(frame.isNull() | whole, F.substring(frame, F.lit(5), size).cast("string")).otherwise(F.raise_error(F.lit("manifest frame cut short")).cast("string"))


def stage_version(manifest: DataFrame, root: str, version: int) -> str:
    """Write a version's manifest to the staging area: nothing reads it before commit_version()."""
    path = f"{root}/staging/{version}"
    manifest.write.mode("overwrite").json(path)
    return path


def commit_version(spark: SparkSession, root: str, version: int, chunks: DataFrame) -> bool:
    """Move a staged version among the versions, in one rename, if all chunks (chunk) it refers to are stored."""
    staged, fs = _place(spark, f"{root}/staging/{version}")
    if not fs.exists(_place(spark, f"{root}/staging/{version}/_SUCCESS")[0]):
        return False
    refs = manifest_refs(spark, f"{root}/staging/{version}")
    if refs.join(chunks.select("chunk"), "chunk", "left_anti").limit(1).count():
        return False
    target, _ = _place(spark, f"{root}/versions/{version}")
    fs.mkdirs(target.getParent())
    return fs.rename(staged, target)


def clear_incomplete(spark: SparkSession, root: str) -> list[int]:
    """Remove staged versions whose writing never ended; their numbers, in order."""
    area, fs = _place(spark, f"{root}/staging")
    out = []
    if fs.exists(area):
        for status in fs.listStatus(area):
            if not _exists(spark, f"{status.getPath().toString()}/_SUCCESS"):
                out.append(int(status.getPath().getName()))
                fs.delete(status.getPath(), True)
    return sorted(out)


def list_versions(spark: SparkSession, path: str) -> DataFrame:
    """version_id, ts, n_files, total_size of every manifest (a JSON object a line); broken ones are skipped."""
    rows = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).filter("version_id IS NOT NULL")
    size = F.aggregate(F.coalesce("files", F.array().cast("array<struct<path:string,size:bigint,mtime:bigint,chunks:array<string>>>")), F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f["size"], F.lit(0)))
    return rows.select("version_id", "ts", F.coalesce(F.size("files"), F.lit(0)).alias("n_files"), size.alias("total_size"))


def manifest_refs(spark: SparkSession, path: str) -> DataFrame:
    """version, path, ordinal, chunk of every reference in the manifests."""
    rows = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).select("version_id", F.explode("files").alias("f"))
    return rows.select(F.col("version_id").alias("version"), "f.path", F.posexplode("f.chunks").alias("ordinal", "chunk"))


def list_objects(objects: DataFrame, prefix: str, most: int, after: str | None = None) -> DataFrame:
    """The next keys under prefix in order: most of them, after the last key of the page before."""
    rows = objects.filter(F.col("key").startswith(prefix))
    return (rows.filter(F.col("key") > after) if after is not None else rows).orderBy("key").limit(most)


def pending(staged: DataFrame, versions: DataFrame) -> DataFrame:
    """Staged versions that were never committed."""
    return staged.join(versions.select("version"), "version", "left_anti")


COMPAT_FILES = "ARRAY<STRUCT<name: STRING, length: LONG, modified: LONG, blocks: ARRAY<STRING>>>"


def to_compat(manifests: DataFrame, *keep: str) -> DataFrame:
    """Manifests in the form of the compatible repository: ids as text, files renamed, refs the distinct chunks in order; columns of keep go along."""
    files = F.transform("files", lambda f: F.struct(f["path"].alias("name"), f["size"].alias("length"), f["mtime"].alias("modified"), f["chunks"].alias("blocks")))
    refs = F.array_sort(F.array_distinct(F.flatten(F.transform("files", lambda f: f["chunks"]))))
    return manifests.select(F.col("version_id").cast("string").alias("version"), F.col("ts").alias("created"), files.cast(COMPAT_FILES).alias("entries"), refs.alias("refs"), *keep)


def from_compat(compat: DataFrame, *keep: str) -> DataFrame:
    """The other way; a version that is no number is an error. Columns of keep go along."""
    files = F.transform("entries", lambda e: F.struct(e["name"].alias("path"), e["length"].alias("size"), e["modified"].alias("mtime"), e["blocks"].alias("chunks")))
    number = F.coalesce(F.expr("try_cast(version AS BIGINT)"), F.raise_error(F.concat(F.lit("no version: "), F.coalesce("version", F.lit("null")))).cast("long"))
    return compat.select(number.alias("version_id"), F.col("created").alias("ts"), files.alias("files"), *keep)
