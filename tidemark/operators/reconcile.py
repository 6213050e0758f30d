"""Chunk references against stored chunks: counts, missing and orphaned data, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refcounts(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk, ref_count of every stored chunk: the versions that refer to it, each counted once."""
    counts = refs.select("version", "chunk").distinct().groupBy("chunk").agg(F.count("*").alias("n"))
    return chunks.join(counts, "chunk", "left").select("chunk", F.coalesce("n", F.lit(0)).cast("long").alias("ref_count"))


def missing(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk, versions that need it: referenced but not stored."""
    return refs.join(chunks, "chunk", "left_anti").groupBy("chunk").agg(F.countDistinct("version").alias("versions"))


def orphans(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored chunks that nothing refers to, with all their columns.

    References are made distinct before the join, with partial sums: tasks hold chunks, not references.
    """
    return chunks.join(refs.select("chunk").distinct(), "chunk", "left_anti")


def version_health(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """version, refs, missing, complete."""
    stored = chunks.select("chunk").withColumn("_s", F.lit(True))
    gone = F.count_if(F.col("_s").isNull())
    return refs.join(stored, "chunk", "left").groupBy("version").agg(F.count("*").alias("refs"), gone.alias("missing"), (gone == 0).alias("complete"))


def deleted_versions(wanted: DataFrame, versions: DataFrame, as_of: str) -> DataFrame:
    """wanted (version) with outcome: missing, immutable (versions: version, immutable_until after as_of) or deleted."""
    known = versions.select("version", "immutable_until").withColumn("_k", F.lit(True))
    outcome = F.when(F.col("_k").isNull(), "missing").when(F.coalesce(F.col("immutable_until") > F.lit(as_of).cast("timestamp_ntz"), F.lit(False)), "immutable").otherwise("deleted")
    return wanted.select("version").distinct().join(known, "version", "left").select("version", outcome.alias("outcome"))


def gc_report(index: DataFrame, on_disk: DataFrame) -> DataFrame:
    """hash, outcome, freed of the chunks of index (hash, ref_count, stored_size, status) without references.

    purged: pending and there (on_disk: hash); gone: pending, but no longer there, so only the index
    forgets it; skipped: not pending.
    """
    here = on_disk.select("hash").distinct().withColumn("_h", F.lit(True))
    outcome = F.when(F.col("status") != "gc_pending", "skipped").when(F.col("_h"), "purged").otherwise("gone")
    rows = index.filter("ref_count = 0").join(here, "hash", "left").withColumn("outcome", outcome)
    return rows.select("hash", "outcome", F.when(F.col("outcome") == "purged", F.col("stored_size")).otherwise(F.lit(0)).cast("long").alias("freed"))


def index_after_gc(index: DataFrame, report: DataFrame) -> DataFrame:
    """index with what the report purged, or found gone, as purged."""
    done = report.filter("outcome in ('purged', 'gone')").select("hash", F.lit(True).alias("_d"))
    return index.join(done, "hash", "left").withColumn("status", F.when(F.col("_d"), "purged").otherwise(F.col("status"))).drop("_d")


def removed(index: DataFrame, dropped: DataFrame) -> DataFrame:
    """ref_count of index (chunk, ref_count) after the references in dropped are gone, 0 at least, and state: gc_pending at 0."""
    n = dropped.groupBy("chunk").agg(F.count("*").alias("n"))
    left = F.greatest(F.col("ref_count") - F.coalesce("n", F.lit(0)), F.lit(0))
    return index.join(n, "chunk", "left").select("chunk", left.alias("ref_count"), F.when(left == 0, "gc_pending").when(F.col("n").isNotNull(), "kept_shared").otherwise("active").alias("state"))


def gc_candidates(refs: DataFrame, chunks: DataFrame, immutable: DataFrame) -> DataFrame:
    """Orphans by bucket that may go: bucket, chunks, freed_bytes. Chunks listed in immutable (chunk) stay."""
    free = orphans(refs, chunks).join(immutable.select("chunk").distinct(), "chunk", "left_anti")
    return free.groupBy("bucket").agg(F.count("*").alias("chunks"), F.sum("stored_size").cast("long").alias("freed_bytes"))


def reclaimable(refs: DataFrame, deleted: DataFrame, in_use: DataFrame | None = None) -> DataFrame:
    """Chunks of deleted versions (version) that no kept version, nor one in use, refers to."""
    gone = deleted if in_use is None else deleted.join(in_use, "version", "left_anti")
    mine = refs.join(gone, "version", "left_semi").select("chunk").distinct()
    return mine.join(refs.join(gone, "version", "left_anti").select("chunk"), "chunk", "left_anti")


def set_equality(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """group, only_left, only_right, equal for two tables of (group, item).

    Both tables meet in one aggregate instead of two and a join: a task holds each pair once. As in a
    join, pairs with a null are equal to none.
    """
    side = lambda x, k: x.select(group, item, F.lit(k).alias("_side"))
    alone = F.when(F.col(group).isNull() | F.col(item).isNull(), F.col("_side")).otherwise(F.lit(0)).alias("_alone")
    pairs = side(left, 1).unionByName(side(right, 2)).groupBy(group, item, alone).agg(F.bit_or("_side").alias("_in"))
    only = lambda k: F.count_if(F.col("_in") == k)
    return pairs.groupBy(group).agg(only(1).alias("only_left"), only(2).alias("only_right"), (only(1) + only(2) == 0).alias("equal"))


def damage(refs: DataFrame, chunks: DataFrame, manifest: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """finding, subject, versions: what is wrong with a repository and how many versions it touches.

    refs: version, chunk; manifest: version, expected (references it lists); broken: versions whose
    manifest can't be read; chunks: chunk, name (of its file) and content_ok, where known.
    missing: referenced, not stored; orphan: stored, not referenced; tampered: referenced and stored
    with other content; bad_name: a file that isn't named by 64 hexadecimal digits; mismatch: a
    manifest that lists other references than its files have; invalid_manifest.
    """
    text = lambda c: F.col(c).cast("string").alias("subject")
    touched = refs.groupBy("chunk").agg(F.countDistinct("version").alias("versions"))
    lost = missing(refs, chunks).select(F.lit("missing").alias("finding"), text("chunk"), "versions")
    out = lost.unionByName(orphans(refs, chunks).select(F.lit("orphan").alias("finding"), text("chunk"), F.lit(0).cast("long").alias("versions")))
    if "content_ok" in chunks.columns:
        bad = chunks.filter(~F.col("content_ok")).select("chunk").join(touched, "chunk")
        out = out.unionByName(bad.select(F.lit("tampered").alias("finding"), text("chunk"), "versions"))
    if "name" in chunks.columns:
        odd = chunks.filter(~F.col("name").rlike("^[0-9a-fA-F]{64}$"))
        out = out.unionByName(odd.select(F.lit("bad_name").alias("finding"), text("name"), F.lit(0).cast("long").alias("versions")))
    have = refs.groupBy("version").agg(F.count("*").alias("n"))
    one = F.lit(1).cast("long").alias("versions")
    uneven = manifest.join(have, "version", "left").filter(~F.col("expected").eqNullSafe(F.coalesce("n", F.lit(0))))
    out = out.unionByName(uneven.select(F.lit("mismatch").alias("finding"), text("version"), one))
    return out if broken is None else out.unionByName(broken.select(F.lit("invalid_manifest").alias("finding"), text("version"), one))


def lookup(hashes: DataFrame, index: DataFrame) -> DataFrame:
    """chunk, found, ref_count, bucket for each asked chunk."""
    return hashes.join(index.withColumn("_f", F.lit(True)), "chunk", "left").select("chunk", F.coalesce("_f", F.lit(False)).alias("found"), F.coalesce("ref_count", F.lit(0)).cast("long").alias("ref_count"), "bucket")


def placement(chunks: DataFrame, nodes: DataFrame, copies: int) -> DataFrame:
    """chunk, node, rank: the nodes with the least hashes of (chunk, node) hold a chunk.

    nodes is a cluster's member list. It goes along as one array, so each chunk ranks the members
    within its own row: nothing is shuffled and no member is left out.
    """
    members = nodes.agg(F.array_sort(F.collect_set("node")).alias("_nodes"))
    score = lambda n: F.struct(F.sha2(F.concat_ws(":", F.col("chunk").cast("string"), n.cast("string")), 256).alias("score"), n.alias("node"))
    best = F.slice(F.array_sort(F.transform("_nodes", score)), 1, copies)
    rows = chunks.select("chunk").crossJoin(F.broadcast(members)).select("chunk", F.posexplode(best).alias("_k", "_s"))
    return rows.select("chunk", F.col("_s.node").alias("node"), (F.col("_k") + 1).alias("rank"))


def replica_health(replicas: DataFrame, copies: int) -> DataFrame:
    """One row from (chunk, ok): chunks, healthy (a quorum of whole copies), degraded, missing copies, lost."""
    quorum = copies // 2 + 1
    per = replicas.groupBy("chunk").agg(F.count_if("ok").alias("good"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(F.count("*").alias("chunks"), F.count_if(F.col("good") >= quorum).alias("healthy"), F.count_if((F.col("good") < quorum) & (F.col("good") > 0)).alias("degraded"), F.count_if(F.col("good") == 0).alias("lost"), total(F.greatest(F.lit(copies) - F.col("good"), F.lit(0))).alias("missing_copies"))
