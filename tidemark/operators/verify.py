"""Checking copies layer by layer, totals, samples and hashes of hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is compared in turn, and the layer it belongs to.
LAYERS = (("digest", "digest"), ("digest2", "digest2"), ("size", "metadata"), ("mtime", "metadata"), ("permissions", "metadata"))


def verify_layers(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, verdict, layer: the first thing that differs, and its layer.

    In turn: missing, digest, digest2 (a hash of another kind), size, mtime, permissions, as far as
    both sides have them; extra for files not expected; else ok. A digest that both sides lack is no
    match.
    """
    known = [(c, layer) for c, layer in LAYERS if c in expected.columns and c in actual.columns]
    side = lambda df, s: df.select("path", *(F.col(c).alias(f"{s}_{c}") for c, _ in known), F.lit(1).alias(s))
    verdict, layer = F.when(F.col("e").isNull(), "extra").when(F.col("a").isNull(), "missing"), F.when(F.col("e").isNull(), "structure").when(F.col("a").isNull(), "digest")
    for c, name in known:
        differs = ~F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}"))
        differs = differs | F.col(f"e_{c}").isNull() if c.startswith("digest") else differs
        verdict, layer = verdict.when(differs, c), layer.when(differs, name)
    return side(expected, "e").join(side(actual, "a"), "path", "full_outer").select("path", verdict.otherwise("ok").alias("verdict"), layer.alias("layer"))


def verify_report(verdicts: DataFrame) -> DataFrame:
    """One row: expected and actual files, failed files, are paths and counts the same, all_passed, failed layers in order."""
    of = lambda *names: F.col("verdict").isin(*names)
    out = verdicts.agg(
        F.count_if(~of("extra")).alias("expected_files"), F.count_if(~of("missing")).alias("actual_files"), F.count_if(~of("ok", "extra")).alias("failed"),
        (F.count_if(of("extra", "missing")) == 0).alias("same_paths"), F.array_sort(F.collect_set("layer")).alias("_l"),
    )
    same = F.col("expected_files") == F.col("actual_files")
    layers = F.array_sort(F.concat(F.filter("_l", lambda x: x != "structure"), F.filter(F.array(F.when(~F.col("same_paths"), F.lit("structure")), F.when(~same, F.lit("count"))), lambda x: x.isNotNull())))
    return out.withColumns({"same_count": same, "all_passed": (F.col("failed") == 0) & F.col("same_paths") & same, "failed_layers": F.array_join(layers, ",")}).drop("_l")


def verify_totals(verdicts: DataFrame) -> DataFrame:
    """total, passed, failed and all_passed over the verdicts of verify_layers()."""
    return verdicts.agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "ok").alias("passed"), F.count_if(F.col("verdict") != "ok").alias("failed"), F.coalesce(F.bool_and(F.col("verdict") == "ok"), F.lit(True)).alias("all_passed"))


def chunk_checks(refs: DataFrame, store: DataFrame) -> DataFrame:
    """chunk, outcome of every chunk that refs (chunk) name, each once: pass, mismatch or missing (store: chunk, content_ok)."""
    outcome = F.when(F.col("content_ok").isNull(), "missing").when(F.col("content_ok"), "pass").otherwise("mismatch")
    return refs.select("chunk").distinct().join(store.select("chunk", "content_ok"), "chunk", "left").select("chunk", outcome.alias("outcome"))


def manifest_checks(refs: DataFrame, checks: DataFrame) -> DataFrame:
    """version, outcome, chunk: pass, or the outcome and name of the first bad chunk in order (version, ordinal, chunk)."""
    bad = refs.join(checks.filter("outcome <> 'pass'"), "chunk").groupBy("version").agg(F.min_by(F.struct("outcome", "chunk"), F.struct("ordinal", "chunk")).alias("_b"))
    return refs.select("version").distinct().join(bad, "version", "left").select("version", F.coalesce("_b.outcome", F.lit("pass")).alias("outcome"), F.col("_b.chunk").alias("chunk"))


def snapshot_checks(snapshots: DataFrame) -> DataFrame:
    """snapshots (version, status, verified) with outcome: not_sealed, unverified (sealed without a check) or pass."""
    return snapshots.withColumn("outcome", F.when(F.coalesce(F.col("status"), F.lit("")) != "sealed", "not_sealed").when(~F.coalesce("verified", F.lit(False)), "unverified").otherwise("pass"))


def failures(checks: DataFrame, kind: str, key: str) -> DataFrame:
    """item_type, identifier, outcome of what didn't pass: the rows of a report."""
    return checks.filter("outcome <> 'pass'").select(F.lit(kind).alias("item_type"), F.col(key).cast("string").alias("identifier"), "outcome")


def _rank(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)


def sample(rows: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """ceil(n * ratio) rows, one at least: those with the least hash of key and seed. The same rows each time.

    Hashes are spread evenly, so nearly all of the sample is cut off by a bound on the hash alone;
    only the few rows about the bound are put in order.
    """
    n = rows.count()
    k = min(n, max(1, math.ceil(n * ratio)))
    hashed, width = rows.withColumn("_h", _rank(key, seed)), 4 * math.sqrt(k) + 20
    bound = lambda x: f"{min(max(int(x / max(n, 1) * 2**60), 0), 2**60 - 1):015x}"
    while True:
        low, high = bound(k - width), bound(k + width) if k + width < n else "g"
        sure, near = hashed.agg(F.count_if(F.col("_h") < low), F.count_if((F.col("_h") >= low) & (F.col("_h") < high))).first()
        if sure <= k <= sure + near:
            break
        width *= 4
    rest = hashed.filter((F.col("_h") >= low) & (F.col("_h") < high)).orderBy("_h", key).limit(k - sure)
    return hashed.filter(F.col("_h") < low).unionByName(rest).drop("_h")


def _hash_of(order: str, digest: str) -> Column:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda e: e[digest])
    return F.sha2(F.unhex(F.array_join(ordered, "")), 256)


def manifest_hashes(entries: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """A hash of hashes for each group: SHA-256 over the digests (hex) in order.

    A group's digests meet in one row, 64 bytes an entry: groups are manifests, whose files or chunks
    one writer has put together.
    """
    return entries.groupBy(group).agg(F.count("*").alias("entries"), _hash_of(order, digest).alias("manifest_hash"))


def hash_levels(versions: DataFrame, files: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """version, file_index, chunk_index, manifest, repo: the four hashes of each version.

    files: version, ordinal, digest; refs: version, ordinal, digest; versions: version and fields.
    Where each file is one chunk, refs may be left out: files then has both digests, as file_index
    and chunk_index, and is gone through once.
    file_index and chunk_index are hashes over the digests in order (of nothing: the empty hash),
    manifest that of the version's fields as JSON with both, repo that of the three others.
    """
    level = lambda rows, name: rows.groupBy("version").agg(_hash_of("ordinal", "digest").alias(name))
    none = F.sha2(F.lit(b"").cast("binary"), 256)
    if refs is None:
        rows = versions.join(files.groupBy("version").agg(*(_hash_of("ordinal", c).alias(c) for c in ("file_index", "chunk_index"))), "version", "left")
    else:
        rows = versions.join(level(files, "file_index"), "version", "left").join(level(refs, "chunk_index"), "version", "left")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("file_index", "chunk_index")})
    rows = rows.withColumn("manifest", F.sha2(F.to_json(F.struct(*versions.columns, "file_index", "chunk_index")), 256))
    return rows.select("version", "file_index", "chunk_index", "manifest", F.sha2(F.unhex(F.concat("manifest", "file_index", "chunk_index")), 256).alias("repo"))
