"""Small helpers that the operators share: tables in the cluster's shared folder, components."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path

__all__ = ["components", "dropped", "freed", "lower_ascii", "n_words", "new_path", "written"]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again.

    This cuts the lineage and makes later reads cheap; it survives the loss of executors.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from written() that no later step reads."""
    spark, path = df.sparkSession, df._written_at
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def freed(spark: SparkSession) -> None:
    """Ask for the deletion of shuffle files that no frame in use needs any longer.

    Spark deletes them when the driver's garbage collection finds their frames gone, which by itself
    may take half an hour. A first collection lets go of the frames, a second one of what they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all else unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t \\n \\v \\f \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def components(edges: DataFrame, name: str = "components", keep_roots: bool = True) -> DataFrame:
    """id, component: the smallest id reachable, for every id in the columns a and b of edges.

    Large-star and small-star steps: each points the neighbours of an id at the smallest of them, so
    the number of rounds grows with the logarithm of a component's size and no round makes more rows
    than there are edges. Ids of either column may be hubs: their minima come from aggregates with
    partial sums, and the joins back are plain equi-joins, which Spark splits where they are skewed.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now, last = written(pairs, name), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
        # edges point from u down to v, so only where v is some edge's u too is there anything below it
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        large = now.join(low.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        then = written(small.distinct(), name)
        dropped(now)
        now = then
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return out.unionByName(roots) if keep_roots else out
