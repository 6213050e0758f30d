"""Which version and which data a restore takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import deleted, stored


def as_of(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (job, at) with version: the latest at or before that moment, null if there is none.

    Versions and wanted moments of a job are merged in one ordered pass; nothing is paired up.
    """
    v = versions.select("job", "ts", F.lit(0).alias("_k"), "version", F.lit(None).cast("timestamp_ntz").alias("at"))
    w = wanted.select("job", F.col("at").alias("ts"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("version"), "at")
    upto = Window.partitionBy("job").orderBy("ts", "_k", "version").rowsBetween(Window.unboundedPreceding, 0)
    return v.unionByName(w).withColumn("version", F.last("version", ignorenulls=True).over(upto)).filter("_k = 1").select("job", "at", "version")


def valid_baseline(versions: DataFrame, broken: DataFrame) -> DataFrame:
    """broken (version) with baseline: the latest earlier version of its job that isn't broken itself."""
    rows = versions.join(broken.select("version").distinct().withColumn("_bad", F.lit(True)), "version", "left")
    before = Window.partitionBy("job").orderBy("ts", "version").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("_bad").isNull(), F.col("version"))
    return rows.withColumn("baseline", F.last(good, ignorenulls=True).over(before)).filter("_bad").select("version", "baseline")


def with_parents(versions: DataFrame) -> DataFrame:
    """versions numbered in order within their job, each with the version before it as parent."""
    w = Window.partitionBy("job").orderBy("ts", "version")
    return versions.withColumns({"number": F.row_number().over(w), "parent": F.lag("version").over(w)})


#: Steps from which on chains are searched for versions that they hold twice.
FAR = 64


def chains(versions: DataFrame, start: DataFrame) -> DataFrame:
    """start, version, depth: the parents of each start version, itself included, to a root.

    A chain that meets a version it already holds (a cycle) ends there; length doesn't matter. By
    pointer doubling: a round knows the ancestor 2^k steps up of every version that has one and
    doubles all chains, so the number of joins is the logarithm of the longest chain. Only chains of
    FAR steps and more can go round a cycle unseen for long; from there on repeats are dropped.
    """
    up = stored(versions.filter("parent is not null").select("version", "parent"), "parents")
    own = start.join(versions.select("version"), "version", "left_semi").select("version").distinct()
    out = stored(own.select(F.col("version").alias("start"), "version", F.lit(0).alias("depth")), "chains")
    pieces, n, step = [out], -1, 1
    while up.count():
        # the further half of each chain, below it what is known
        part = out.join(up, "version").select("start", F.col("parent").alias("version"), (F.col("depth") + step).alias("depth"))
        if step < FAR:
            pieces.append(stored(part, "chains"))
            out = out.unionByName(pieces[-1])
        else:
            whole = stored(out.unionByName(part).groupBy("start", "version").agg(F.min("depth").alias("depth")), "chains")
            for old in pieces:
                deleted(old)
            out, pieces, last, n = whole, [whole], n, whole.count()
            if n == last:
                break
        twice = stored(up.join(up.select(F.col("version").alias("parent"), F.col("parent").alias("_p")), "parent").select("version", F.col("_p").alias("parent")), "parents")
        deleted(up)
        up, step = twice, step * 2
    return out


def chain_verdicts(chain: DataFrame, readable: DataFrame) -> DataFrame:
    """start, versions, whole, first_broken: are all versions of each chain readable (version), and which is the nearest that isn't."""
    known = readable.select("version").distinct().withColumn("_r", F.lit(True))
    bad = F.col("_r").isNull()
    rows = chain.join(known, "version", "left").groupBy("start")
    return rows.agg(F.count("*").alias("versions"), (F.count_if(bad) == 0).alias("whole"), F.min_by(F.when(bad, F.col("version")), F.when(bad, F.col("depth"))).alias("first_broken"))


def rebuilt(versions: DataFrame, baselines: DataFrame, readable: DataFrame) -> DataFrame:
    """baseline, version, ts, number: readable versions (version) of the job of each baseline (version), from its moment on."""
    numbered = with_parents(versions)
    base = numbered.join(baselines.select("version").distinct(), "version", "left_semi").select("job", F.col("version").alias("baseline"), F.col("ts").alias("_from"))
    rows = numbered.join(readable.select("version").distinct(), "version", "left_semi").join(base, "job").filter(F.col("ts") >= F.col("_from"))
    return rows.select("baseline", "version", "ts", "number")


def plan(refs: DataFrame, chunks: DataFrame, wanted: DataFrame, located: DataFrame | None = None) -> DataFrame:
    """version, ordinal, chunk, location, found_by for every reference of the wanted versions (version).

    The manifest's own location (located: version, chunk, location) comes first, then the
    repository's (chunks), then the place that follows from the chunk's name.
    """
    name = lambda bucket: F.concat(bucket, F.lit("/"), F.col("chunk").cast("string"), F.lit(".chunk"))
    kept = chunks.select("chunk", name(F.col("bucket")).alias("_stored"))
    rows = refs.join(wanted.select("version").distinct(), "version", "left_semi").join(kept, "chunk", "left")
    if located is None:
        rows = rows.withColumn("_manifest", F.lit(None).cast("string"))
    else:
        rows = rows.join(located.select("version", "chunk", F.col("location").alias("_manifest")).dropDuplicates(["version", "chunk"]), ["version", "chunk"], "left")
    derived = name(F.substring(F.sha2(F.col("chunk").cast("string"), 256), 1, 2))
    by = F.when(F.col("_manifest").isNotNull(), "manifest").when(F.col("_stored").isNotNull(), "repository").otherwise("name")
    return rows.select("version", "ordinal", "chunk", F.coalesce("_manifest", "_stored", derived).alias("location"), by.alias("found_by"))


def progress(done: DataFrame, total: DataFrame) -> DataFrame:
    """version, restored, total, share (1 where there is nothing to do)."""
    d = done.groupBy("version").agg(F.count("*").alias("restored"))
    t = total.groupBy("version").agg(F.count("*").alias("total"))
    rows = t.join(d, "version", "left").withColumn("restored", F.coalesce("restored", F.lit(0)).cast("long"))
    return rows.withColumn("share", F.round(F.coalesce(F.col("restored") / F.nullif(F.col("total"), F.lit(0)), F.lit(1.0)), 6)).select("version", "restored", "total", "share")
