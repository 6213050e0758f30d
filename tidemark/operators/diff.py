"""Comparing snapshots of a file tree (path, size, mtime, digest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """path, change: added, deleted or modified (same path, other size or mtime)."""
    b = baseline.select("path", F.col("size").alias("b_size"), F.col("mtime").alias("b_mtime"), F.lit(True).alias("b"))
    c = current.select("path", F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"), F.lit(True).alias("c"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "deleted").when((F.col("b_size") != F.col("c_size")) | (F.col("b_mtime") != F.col("c_mtime")), "modified")
    return b.join(c, "path", "full_outer").select("path", kind.alias("change"), "b_size", "b_mtime", "c_size", "c_mtime").filter("change IS NOT NULL")


def _paired(changed: DataFrame) -> DataFrame:
    """changed with old_path and new_path where a deleted and an added path of equal size and mtime are paired.

    Both sides are numbered in order of path within (size, mtime); equal numbers are a pair. One
    shuffle serves both windows. Modified paths stand alone.
    """
    alone = F.col("change") == "modified"
    keyed = changed.select("path", "change", F.when(alone, F.xxhash64("path")).otherwise(F.coalesce("b_size", "c_size")).alias("size"), F.when(~alone, F.coalesce("b_mtime", "c_mtime")).alias("mtime"))
    number = F.row_number().over(Window.partitionBy("change", "size", "mtime").orderBy("path"))
    pair = Window.partitionBy("size", "mtime", "rn")
    side = lambda kind: F.max(F.when(F.col("change") == kind, F.col("path"))).over(pair)
    return keyed.repartition("size", "mtime").withColumn("rn", number).withColumns({"old_path": side("deleted"), "new_path": side("added")})


def renames(changed: DataFrame) -> DataFrame:
    """old_path, new_path: deleted and added paths of equal size and mtime, paired one to one in order of path."""
    return _paired(changed).filter("change = 'added' AND old_path IS NOT NULL").select("old_path", "new_path", "size", "mtime")


def snapshot_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """path, old_path, change; renamed paths are neither added nor deleted."""
    rows = _paired(changes(baseline, current)).filter("NOT (change = 'deleted' AND new_path IS NOT NULL)")
    moved = (F.col("change") == "added") & F.col("old_path").isNotNull()
    return rows.select("path", F.when(moved, F.col("old_path")).alias("old_path"), F.when(moved, "renamed").otherwise(F.col("change")).alias("change"))


def incremental_manifest(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Files of the new version: path, size, mtime, digest, origin (kept from the parent, or new data).

    Deleted files and old names of renamed ones are gone; a renamed file keeps the parent's data.
    """
    diff = snapshot_diff(baseline, current)
    fresh = diff.filter("change IN ('added', 'modified')").select("path").withColumn("_new", F.lit(True))
    return current.join(fresh, "path", "left").select("path", "size", "mtime", "digest", F.when(F.col("_new"), "new").otherwise("parent").alias("origin"))


def dual_compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row over two copies by path: total, consistent, missing on either side, differing, rate (1 without files), and the execution's conclusion and state."""
    a = one.select("path", F.col("size").alias("a_size"), F.col("digest").alias("a_digest"))
    b = two.select("path", F.col("size").alias("b_size"), F.col("digest").alias("b_digest"))
    same = (F.col("a_size") == F.col("b_size")) & (F.col("a_digest") == F.col("b_digest"))
    no_a, no_b = F.col("a_size").isNull(), F.col("b_size").isNull()
    out = a.join(b, "path", "full_outer").agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(same, F.lit(False))).alias("consistent"), F.count_if(no_a).alias("missing_one"),
        F.count_if(no_b).alias("missing_two"), F.count_if(~no_a & ~no_b & ~same).alias("differing"),
    )
    same_all = F.col("consistent") == F.col("total")
    out = out.withColumn("rate", F.round(F.coalesce(F.col("consistent") / F.nullif(F.col("total"), F.lit(0)), F.lit(1.0)), 6))
    return out.withColumns({"conclusion": F.when(same_all, "consistent").otherwise("inconsistent"), "state": F.when(same_all, "success").otherwise("failed")})
