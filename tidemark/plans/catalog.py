"""The registered queries over the supplied tables, each with the SQL that an oracle runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crypto, redact, rules, schedule, text
from ..operators import chunking, config, control, diff, fleet, journal, reconcile, restore, retention, tree, verify
from ..shared import new_path
from ..sources import repository
from ..sources import views as v
from ..sources.views import oracle
from ..streaming import jobs
from .registry import AS_OF, ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


# Scans, filters, selection


@query(oracle("v_files", body="SELECT count(*)::BIGINT AS total_files, coalesce(sum(size), 0)::BIGINT AS total_size FROM v_files WHERE path LIKE '%/en/%'"))
def scan_estimate(spark, d):
    f = v.files(spark, d).filter(F.col("path").contains("/en/"))
    return f.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


INCLUDE, EXCLUDE = [("glob", "src1*/??/*.txt"), ("prefix", "src2/")], [("regex", r"/1\d*7\.txt$"), ("regex", "(")]


@query(oracle("v_files", body=r"SELECT path, size FROM v_files WHERE (regexp_matches(path, '^src1.*/../.*\.txt$') OR starts_with(path, 'src2/')) AND NOT regexp_matches(path, '/1\d*7\.txt$')"))
def filter_include_exclude(spark, d):
    return v.files(spark, d).filter(text.passes(F.col("path"), INCLUDE, EXCLUDE)).select("path", "size")


@query(oracle("v_files", body="SELECT path FROM v_files WHERE path LIKE 'src%/en/%5.txt'"))
def filter_glob(spark, d):
    return v.files(spark, d).filter(F.col("path").rlike(text.glob_regex("src*/en/*5.txt"))).select("path")


@query(oracle("v_files", body="SELECT 'between' AS kind, path FROM v_files WHERE mtime BETWEEN 10 AND 60 UNION ALL SELECT 'substring', path FROM v_files WHERE contains(path, '/fr/') UNION ALL SELECT 'prefix', path FROM v_files WHERE starts_with(path, 'src3/')"))
def file_selection(spark, d):
    f = v.files(spark, d)
    parts = [f.filter(text.selected(kind, *args)).select(F.lit(kind).alias("kind"), "path") for kind, args in (("between", (10, 60)), ("substring", ("/fr/",)), ("prefix", ("src3/",)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(oracle("v_files", body="SELECT path, '/restore/' || path || '.restored' AS target, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KB', round(size / 1024.0::DOUBLE, 2)) WHEN size < 1073741824 THEN printf('%.2f MB', round(size / 1048576.0::DOUBLE, 2)) WHEN size < 1099511627776 THEN printf('%.2f GB', round(size / 1073741824.0::DOUBLE, 2)) ELSE printf('%.2f TB', round(size / 1099511627776.0::DOUBLE, 2)) END AS shown FROM v_files"))
def restore_targets(spark, d):
    return v.files(spark, d).select("path", text.restore_path("/restore", F.col("path"), True).alias("target"), text.format_bytes(F.col("size")).alias("shown"))


@query(oracle("v_files", body=", p AS (SELECT string_split(path, '/') AS parts FROM v_files) SELECT parts[1] AS folder, count(*)::BIGINT AS files FROM p GROUP BY 1 UNION ALL SELECT parts[1] || '/' || parts[2], count(*)::BIGINT FROM p GROUP BY 1"))
def path_levels(spark, d):
    return v.files(spark, d).select(F.explode(text.path_levels(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


@query("SELECT c_custkey AS id, c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_custkey % 7 = 0 AS allowed FROM customer")
def permissions(spark, d):
    held = F.array(F.when(F.col("c_custkey") % 7 == 0, "*").otherwise("log:read"), F.when(F.col("c_mktsegment") == "BUILDING", "job:*").when(F.col("c_mktsegment") == "MACHINERY", "job:run").otherwise("version:*"))
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.permitted(held, "job:run").alias("allowed"))


# Chunks

CHUNKS = ", n AS (SELECT unnest(generate_series(0, (SELECT max(size) FROM v_files) // 256))::BIGINT AS ordinal), c AS (SELECT doc_id, path, size, mtime, ordinal, ordinal * 256 AS \"offset\", content[(ordinal * 256 + 1):(ordinal * 256 + 256)] AS data FROM v_files JOIN n ON ordinal * 256 < size), h AS (SELECT doc_id, path, size, mtime, ordinal, \"offset\", octet_length(data)::BIGINT AS chunk_bytes, sha256(data) AS hash FROM c)"


@query(oracle("v_files", body=CHUNKS + " SELECT path, ordinal, \"offset\", chunk_bytes, hash FROM h"))
def chunk_fixed(spark, d):
    return chunking.fixed_chunks(v.files(spark, d), 256).select("path", "ordinal", "offset", "chunk_bytes", "hash")


@query(oracle("v_files", body="SELECT path, CASE WHEN size * 65536 < 16777216 THEN 262144 WHEN size * 65536 < 268435456 THEN 524288 WHEN size * 65536 < 4294967296 THEN 1048576 END AS chunk_size FROM v_files"))
def chunk_profile(spark, d):
    return v.files(spark, d).select("path", chunking.profile_size(F.col("size") * 65536, "adaptive").alias("chunk_size"))


@query(oracle("v_files", body=CHUNKS + ", u AS (SELECT hash, count(*) AS n, sum(chunk_bytes) AS a, max(chunk_bytes) AS o FROM h GROUP BY hash) SELECT sum(n)::BIGINT AS refs, count(*)::BIGINT AS unique_chunks, sum(a)::BIGINT AS bytes, sum(o)::BIGINT AS stored_bytes, round(1 - sum(o)::DOUBLE / sum(a)::DOUBLE, 6) AS ratio FROM u"))
def dedup_ratio(spark, d):
    return chunking.dedup_ratio(chunking.fixed_chunks(v.files(spark, d), 256))


@query(oracle("v_files", body=CHUNKS + " SELECT path, ordinal, row_number() OVER (PARTITION BY hash ORDER BY path, ordinal) = 1 AS stored FROM h"))
def dedup_first_seen(spark, d):
    return chunking.first_seen(chunking.fixed_chunks(v.files(spark, d), 256), "path", "ordinal").select("path", "ordinal", "stored")


@query(None)
def chunk_cdc(spark, d):
    return chunking.content_chunks(v.files(spark, d), least=256, average=1024, most=4096)


@query(oracle("v_files", body=CHUNKS + ", o AS (SELECT path, ordinal, CASE WHEN doc_id % 3 = 0 AND ordinal = 2 THEN 'x' ELSE hash END AS old FROM h WHERE doc_id % 4 <> 0), e AS (SELECT h.path, h.ordinal, coalesce(h.hash = o.old, false)::INT AS same FROM h LEFT JOIN o ON h.path = o.path AND h.ordinal = o.ordinal) SELECT path, ordinal, min(same) OVER (PARTITION BY path ORDER BY ordinal ROWS UNBOUNDED PRECEDING) = 1 AS reused FROM e"))
def chunk_prefix_reuse(spark, d):
    new = chunking.fixed_chunks(v.files(spark, d), 256)
    old = new.filter("doc_id % 4 <> 0").withColumn("hash", F.when((F.col("doc_id") % 3 == 0) & (F.col("ordinal") == 2), "x").otherwise(F.col("hash")))
    return chunking.prefix_reuse(new, old).select("path", "ordinal", "reused")


INDEX = "SELECT p_partkey AS chunk, p_partkey % 3 AS ref_count, p_size::BIGINT AS stored_size, CASE WHEN p_partkey % 5 = 0 THEN 'deleted' ELSE 'active' END AS status FROM part WHERE p_partkey % 2 = 0"


@query(f"WITH i AS ({INDEX}), b AS (SELECT l_partkey AS chunk, count(*) AS n, max(l_quantity::BIGINT) AS s FROM lineitem GROUP BY 1) SELECT chunk AS hash, (CASE WHEN status = 'active' OR n IS NULL THEN ref_count ELSE 0 END + coalesce(n, 0))::BIGINT AS ref_count, coalesce(stored_size, s)::BIGINT AS stored_size, CASE WHEN n IS NOT NULL THEN 'active' ELSE status END AS status FROM i FULL JOIN b USING (chunk)")
def chunk_put(spark, d):
    index = v.table(spark, d, "part").filter("p_partkey % 2 = 0").selectExpr("p_partkey AS hash", "p_partkey % 3 AS ref_count", "CAST(p_size AS BIGINT) AS stored_size", "CASE WHEN p_partkey % 5 = 0 THEN 'deleted' ELSE 'active' END AS status")
    return chunking.put_chunks(index, v.table(spark, d, "lineitem").selectExpr("l_partkey AS hash", "CAST(l_quantity AS BIGINT) AS size"))


# Snapshots

DIFF = """, e AS (SELECT coalesce(b.path, c.path) AS path, b.size AS bs, b.mtime AS bm, c.size AS cs, c.mtime AS cm,
  CASE WHEN b.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' WHEN b.size <> c.size OR b.mtime <> c.mtime THEN 'modified' END AS change
  FROM v_baseline b FULL JOIN v_current c ON b.path = c.path),
g AS (SELECT path, bs, bm, row_number() OVER (PARTITION BY bs, bm ORDER BY path) AS rn FROM e WHERE change = 'deleted'),
a AS (SELECT path, cs, cm, row_number() OVER (PARTITION BY cs, cm ORDER BY path) AS rn FROM e WHERE change = 'added'),
r AS (SELECT g.path AS old_path, a.path AS new_path, bs AS size, bm AS mtime FROM g JOIN a ON bs = cs AND bm = cm AND g.rn = a.rn),
s AS (SELECT path, NULL::VARCHAR AS old_path, change FROM e WHERE change IS NOT NULL AND NOT (change = 'deleted' AND path IN (SELECT old_path FROM r)) AND NOT (change = 'added' AND path IN (SELECT new_path FROM r))
  UNION ALL SELECT new_path, old_path, 'renamed' FROM r)"""


@query(oracle("v_baseline", "v_current", body=DIFF + " SELECT * FROM s"))
def snapshot_diff(spark, d):
    return diff.snapshot_diff(v.baseline(spark, d), v.current(spark, d))


@query(oracle("v_baseline", "v_current", body=DIFF + " SELECT * FROM r"))
def rename_pairs(spark, d):
    return diff.renames(diff.changes(v.baseline(spark, d), v.current(spark, d)))


@query(oracle("v_baseline", "v_current", body=DIFF + " SELECT c.path, c.size, c.mtime, c.digest, CASE WHEN path IN (SELECT path FROM s WHERE change IN ('added', 'modified')) THEN 'new' ELSE 'parent' END AS origin FROM v_current c"))
def incremental_manifest(spark, d):
    return diff.incremental_manifest(v.baseline(spark, d), v.current(spark, d))


@query(oracle("v_baseline", "v_current", body=" SELECT count(*)::BIGINT AS total, count_if(coalesce(b.size = c.size AND b.digest = c.digest, false))::BIGINT AS consistent, count_if(b.path IS NULL)::BIGINT AS missing_one, count_if(c.path IS NULL)::BIGINT AS missing_two, count_if(b.size <> c.size OR b.digest <> c.digest)::BIGINT AS differing, round(count_if(coalesce(b.size = c.size AND b.digest = c.digest, false)) / count(*)::DOUBLE, 6) AS rate, CASE WHEN count_if(coalesce(b.size = c.size AND b.digest = c.digest, false)) = count(*) THEN 'consistent' ELSE 'inconsistent' END AS conclusion, CASE WHEN count_if(coalesce(b.size = c.size AND b.digest = c.digest, false)) = count(*) THEN 'success' ELSE 'failed' END AS state FROM v_baseline b FULL JOIN v_current c ON b.path = c.path"))
def dual_copy_compare(spark, d):
    return diff.dual_compare(v.baseline(spark, d), v.current(spark, d))


LAYERS = ", l AS (SELECT coalesce(b.path, c.path) AS path, CASE WHEN b.path IS NULL THEN 'extra' WHEN c.path IS NULL THEN 'missing' WHEN b.digest <> c.digest THEN 'digest' WHEN b.digest2 <> c.digest2 THEN 'digest2' WHEN b.size <> c.size THEN 'size' WHEN b.mtime <> c.mtime THEN 'mtime' WHEN b.permissions <> c.permissions THEN 'permissions' ELSE 'ok' END AS verdict FROM v_baseline b FULL JOIN v_current c ON b.path = c.path)"


@query(oracle("v_baseline", "v_current", body=LAYERS + " SELECT *, CASE WHEN verdict = 'extra' THEN 'structure' WHEN verdict IN ('missing', 'digest') THEN 'digest' WHEN verdict = 'digest2' THEN 'digest2' WHEN verdict <> 'ok' THEN 'metadata' END AS layer FROM l"))
def verify_layers(spark, d):
    return verify.verify_layers(v.baseline(spark, d), v.current(spark, d))


@query(oracle("v_baseline", "v_current", body=LAYERS + " SELECT count(*)::BIGINT AS total, count_if(verdict = 'ok')::BIGINT AS passed, count_if(verdict <> 'ok')::BIGINT AS failed, bool_and(verdict = 'ok') AS all_passed FROM l"))
def verify_totals(spark, d):
    return verify.verify_totals(verify.verify_layers(v.baseline(spark, d), v.current(spark, d)))


@query(oracle("v_chunks", body="SELECT chunk FROM v_chunks ORDER BY sha256(chunk::VARCHAR || ':7'), chunk LIMIT (SELECT ceil(count(*) * 0.05)::BIGINT FROM v_chunks)"))
def verify_sample(spark, d):
    return verify.sample(v.chunks(spark, d).select("chunk"), "chunk", 0.05, 7)


@query(oracle("v_refs", body="SELECT version, count(*)::BIGINT AS entries, sha256(unhex(string_agg(sha256(chunk::VARCHAR), '' ORDER BY ordinal))) AS manifest_hash FROM v_refs GROUP BY version"))
def manifest_hash(spark, d):
    entries = v.refs(spark, d).withColumn("digest", F.sha2(F.col("chunk").cast("string"), 256))
    return verify.manifest_hashes(entries, "version", "ordinal", "digest")


# References


@query(oracle("v_refs", "v_chunks", body="SELECT c.chunk, count(DISTINCT version)::BIGINT AS ref_count FROM v_chunks c LEFT JOIN v_refs r ON r.chunk = c.chunk GROUP BY c.chunk"))
def refcounts(spark, d):
    return reconcile.refcounts(v.refs(spark, d), v.chunks(spark, d))


@query(oracle("v_refs", "v_chunks", body="SELECT chunk, count(DISTINCT version)::BIGINT AS versions FROM v_refs WHERE chunk NOT IN (SELECT chunk FROM v_chunks) GROUP BY chunk"))
def missing_chunks(spark, d):
    return reconcile.missing(v.refs(spark, d), v.chunks(spark, d))


@query(oracle("v_refs", "v_chunks", body="SELECT chunk, stored_size FROM v_chunks WHERE chunk NOT IN (SELECT chunk FROM v_refs)"))
def orphan_chunks(spark, d):
    return reconcile.orphans(v.refs(spark, d), v.chunks(spark, d)).select("chunk", "stored_size")


@query(oracle("v_refs", "v_chunks", body="SELECT version, count(*)::BIGINT AS refs, count_if(c.chunk IS NULL)::BIGINT AS missing, count_if(c.chunk IS NULL) = 0 AS complete FROM v_refs r LEFT JOIN v_chunks c ON r.chunk = c.chunk GROUP BY version"))
def version_health(spark, d):
    return reconcile.version_health(v.refs(spark, d), v.chunks(spark, d))


@query(oracle("v_refs", "v_chunks", body=", i AS (SELECT c.chunk, count(DISTINCT version) AS rc FROM v_chunks c LEFT JOIN v_refs r ON r.chunk = c.chunk GROUP BY c.chunk), n AS (SELECT chunk, count(DISTINCT version) AS n FROM v_refs WHERE version % 3 = 0 GROUP BY chunk) SELECT i.chunk, greatest(rc - coalesce(n, 0), 0)::BIGINT AS ref_count, CASE WHEN greatest(rc - coalesce(n, 0), 0) = 0 THEN 'gc_pending' WHEN n IS NOT NULL THEN 'kept_shared' ELSE 'active' END AS state FROM i LEFT JOIN n ON i.chunk = n.chunk"))
def version_delete(spark, d):
    refs = v.refs(spark, d)
    return reconcile.removed(reconcile.refcounts(refs, v.chunks(spark, d)), refs.filter("version % 3 = 0").select("version", "chunk").distinct())


@query(oracle("v_refs", "v_chunks", body="SELECT bucket, count(*)::BIGINT AS chunks, sum(stored_size)::BIGINT AS freed_bytes FROM v_chunks WHERE chunk NOT IN (SELECT chunk FROM v_refs) AND chunk % 13 <> 0 GROUP BY bucket"))
def gc_candidates(spark, d):
    chunks = v.chunks(spark, d)
    return reconcile.gc_candidates(v.refs(spark, d), chunks, chunks.filter("chunk % 13 = 0"))


@query(oracle("v_refs", body="SELECT DISTINCT chunk FROM v_refs WHERE version % 2 = 0 AND version % 5 <> 0 AND chunk NOT IN (SELECT chunk FROM v_refs WHERE NOT (version % 2 = 0 AND version % 5 <> 0))"))
def reclaimable_chunks(spark, d):
    refs = v.refs(spark, d)
    every = refs.select("version").distinct()
    return reconcile.reclaimable(refs, every.filter("version % 2 = 0"), every.filter("version % 5 = 0"))


@query(oracle("v_refs", body=", a AS (SELECT DISTINCT version, chunk FROM v_refs WHERE chunk % 19 <> 0), b AS (SELECT DISTINCT version, chunk FROM v_refs WHERE chunk % 23 <> 0) SELECT version, count_if(b.chunk IS NULL)::BIGINT AS only_left, count_if(a.chunk IS NULL)::BIGINT AS only_right, count_if(a.chunk IS NULL OR b.chunk IS NULL) = 0 AS equal FROM a FULL JOIN b USING (version, chunk) GROUP BY version"))
def refs_set_equality(spark, d):
    refs = v.refs(spark, d)
    return reconcile.set_equality(refs.filter("chunk % 19 <> 0"), refs.filter("chunk % 23 <> 0"), "version", "chunk")


@query(oracle("v_refs", "v_chunks", body="""SELECT 'missing' AS finding, chunk::VARCHAR AS subject, count(DISTINCT version)::BIGINT AS versions FROM v_refs WHERE chunk NOT IN (SELECT chunk FROM v_chunks) GROUP BY chunk
UNION ALL SELECT 'orphan', chunk::VARCHAR, 0 FROM v_chunks WHERE chunk NOT IN (SELECT chunk FROM v_refs)
UNION ALL SELECT 'tampered', r.chunk::VARCHAR, count(DISTINCT version) FROM v_refs r JOIN v_chunks c ON r.chunk = c.chunk WHERE r.chunk % 29 = 0 GROUP BY r.chunk
UNION ALL SELECT 'bad_name', 'chunk-' || chunk, 0 FROM v_chunks WHERE chunk % 31 = 0
UNION ALL SELECT 'mismatch', version::VARCHAR, 1 FROM v_refs WHERE version % 97 = 0 GROUP BY version
UNION ALL SELECT 'invalid_manifest', o_orderkey::VARCHAR, 1 FROM orders WHERE o_orderkey % 101 = 0"""))
def repository_damage(spark, d):
    refs = v.refs(spark, d)
    manifest = refs.groupBy("version").agg((F.count("*") + F.when(F.col("version") % 97 == 0, 1).otherwise(0)).alias("expected"))
    digest = F.sha2(F.col("chunk").cast("string"), 256)
    chunks = v.chunks(spark, d).withColumns({"name": F.when(F.col("chunk") % 31 == 0, F.concat(F.lit("chunk-"), "chunk")).otherwise(digest), "content_ok": F.col("chunk") % 29 != 0})
    broken = v.versions(spark, d).filter("version % 101 = 0").select("version")
    return reconcile.damage(refs, chunks, manifest, broken)


@query(oracle("v_chunks", "v_refs", body=", i AS (SELECT c.chunk, bucket, count(DISTINCT version) AS rc FROM v_chunks c LEFT JOIN v_refs r ON r.chunk = c.chunk GROUP BY ALL) SELECT p_partkey AS chunk, i.chunk IS NOT NULL AS found, coalesce(rc, 0)::BIGINT AS ref_count, bucket FROM part LEFT JOIN i ON i.chunk = p_partkey"))
def dedup_lookup(spark, d):
    chunks = v.chunks(spark, d)
    index = reconcile.refcounts(v.refs(spark, d), chunks).join(chunks.select("chunk", "bucket"), "chunk")
    return reconcile.lookup(v.table(spark, d, "part").select(F.col("p_partkey").alias("chunk")), index)


@query(oracle("v_chunks", body=", s AS (SELECT chunk, n_nationkey AS node, sha256(chunk || ':' || n_nationkey) AS score FROM v_chunks, nation), r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY score, node)::INT AS rank FROM s) SELECT chunk, node, rank FROM r WHERE rank <= 3"))
def replica_placement(spark, d):
    nodes = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return reconcile.placement(v.chunks(spark, d), nodes, 3)


@query("WITH p AS (SELECT l_partkey AS chunk, count_if(l_returnflag <> 'R') AS good FROM lineitem GROUP BY 1) SELECT count(*)::BIGINT AS chunks, count_if(good >= 2)::BIGINT AS healthy, count_if(good = 1)::BIGINT AS degraded, count_if(good = 0)::BIGINT AS lost, sum(greatest(3 - good, 0))::BIGINT AS missing_copies FROM p")
def replica_health(spark, d):
    return reconcile.replica_health(v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("chunk"), (F.col("l_returnflag") != "R").alias("ok")), 3)


# Retention and restore

RN = "row_number() OVER (PARTITION BY job{} ORDER BY ts DESC, version DESC)"


@query(oracle("v_versions", body=f"SELECT version, {RN.format('')} <= 5 AS keep FROM v_versions"))
def retention_keep_last_n(spark, d):
    return retention.keep_last(v.versions(spark, d), 5).select("version", "keep")


@query(oracle("v_versions", body=f"SELECT version, ts >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY AS keep FROM v_versions"))
def retention_time(spark, d):
    return retention.keep_younger(v.versions(spark, d), AS_OF, 400).select("version", "keep")


@query(oracle("v_versions", body=f""", b AS (SELECT *, date_diff('day', DATE '1970-01-01', ts::DATE) AS dd, year(ts) * 12 + month(ts) AS mm FROM v_versions), k AS (SELECT date_diff('day', DATE '1970-01-01', DATE '1998-09-01') AS d0, 1998 * 12 + 9 AS m0),
r AS (SELECT version, dd, mm, {RN.format(', dd')} AS r0, {RN.format(', dd // 7')} AS r1, {RN.format(', mm')} AS r2 FROM b)
SELECT version, (dd > d0 - 70 AND r0 = 1) OR (dd // 7 > d0 // 7 - 40 AND r1 = 1) OR (mm > m0 - 24 AND r2 = 1) AS keep FROM r, k"""))
def retention_gfs(spark, d):
    return retention.gfs(v.versions(spark, d), AS_OF, 70, 40, 24).select("version", "keep")


@query(oracle("v_versions", body=f"SELECT version, {RN.format('')} <= 3 OR ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY OR {RN.format(', ts::DATE')} = 1 OR row_number() OVER (PARTITION BY job, ts::DATE ORDER BY ts, version) = 1 AS keep FROM v_versions"))
def retention_smart(spark, d):
    return retention.smart(v.versions(spark, d), AS_OF, 3, 90).select("version", "keep")


@query(oracle("v_versions", body=f", w AS (SELECT c_custkey AS job, TIMESTAMP '{AS_OF}' - to_days((c_custkey % 2000)::INT) AS a FROM customer) SELECT w.job, a AS \"at\", (SELECT max_by(version, (ts, version)) FROM v_versions x WHERE x.job = w.job AND ts <= a) AS version FROM w"))
def restore_point_asof(spark, d):
    wanted = v.table(spark, d, "customer").select(F.col("c_custkey").alias("job"), (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((F.col("c_custkey") % 2000).cast("int"))).alias("at"))
    return restore.as_of(v.versions(spark, d), wanted)


@query(oracle("v_versions", body="SELECT version, (SELECT max_by(version, (ts, version)) FROM v_versions y WHERE y.job = x.job AND (y.ts, y.version) < (x.ts, x.version) AND y.status <> 'P' AND NOT (y.version % 9 = 0)) AS baseline FROM v_versions x WHERE x.status = 'P' OR x.version % 9 = 0"))
def nearest_baseline(spark, d):
    versions = v.versions(spark, d)
    return restore.valid_baseline(versions, versions.filter("status = 'P' OR version % 9 = 0"))


@query(oracle("v_versions", body=", p AS (SELECT version, job, ts, lag(version) OVER (PARTITION BY job ORDER BY ts, version) AS parent FROM v_versions), n AS (SELECT max_by(version, (ts, version)) AS version FROM v_versions GROUP BY job), chain(start, version, depth) AS (SELECT version, version, 0 FROM n UNION ALL SELECT c.start, p.parent, c.depth + 1 FROM chain c JOIN p ON p.version = c.version WHERE p.parent IS NOT NULL) SELECT start, version, depth FROM chain"))
def version_chain(spark, d):
    return restore.chains(restore.with_parents(v.versions(spark, d)), _newest(spark, d))


def _newest(spark, d):
    """The newest version of each job."""
    return fleet.latest(v.versions(spark, d), "job", "ts", "version").select("version")


LOCATED = "r.version % 4 = 0 AND r.ordinal % 2 = 1"


@query(oracle("v_refs", "v_chunks", "v_versions", body=f"""SELECT r.version, ordinal::INT AS ordinal, r.chunk,
  CASE WHEN {LOCATED} THEN 'm/' || r.version || '/' || r.chunk WHEN c.chunk IS NOT NULL THEN bucket || '/' || c.chunk || '.chunk' ELSE substr(sha256(r.chunk::VARCHAR), 1, 2) || '/' || r.chunk || '.chunk' END AS location,
  CASE WHEN {LOCATED} THEN 'manifest' WHEN c.chunk IS NOT NULL THEN 'repository' ELSE 'name' END AS found_by
FROM (SELECT *, bool_or(version % 4 = 0 AND ordinal % 2 = 1) OVER (PARTITION BY version, chunk) AS known FROM v_refs) r LEFT JOIN v_chunks c ON r.chunk = c.chunk JOIN v_versions w ON r.version = w.version WHERE status = 'P'""".replace(LOCATED, "known")))
def restore_plan(spark, d):
    refs = v.refs(spark, d)
    located = refs.filter("version % 4 = 0 AND ordinal % 2 = 1").select("version", "chunk", F.concat(F.lit("m/"), "version", F.lit("/"), "chunk").alias("location"))
    return restore.plan(refs, v.chunks(spark, d), v.versions(spark, d).filter("status = 'P'"), located)


@query(oracle("v_refs", body="SELECT version, count_if(ordinal <= 2)::BIGINT AS restored, count(*)::BIGINT AS total, round(count_if(ordinal <= 2) / count(*)::DOUBLE, 6) AS share FROM v_refs GROUP BY version"))
def restore_progress(spark, d):
    refs = v.refs(spark, d)
    return restore.progress(refs.filter("ordinal <= 2"), refs)


@query("WITH p AS (SELECT o_orderkey AS id, 'log_' || strftime(o_orderdate, '%Y%m%d') AS name, o_orderdate + INTERVAL 1 DAY AS end_ts, o_orderstatus = 'P' AS archived FROM orders) SELECT id, name FROM p WHERE NOT archived AND end_ts < TIMESTAMP '1998-07-01' - INTERVAL 7 DAY")
def partition_expiry(spark, d):
    o = v.table(spark, d, "orders")
    parts = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("log_"), F.date_format("o_orderdate", "yyyyMMdd")).alias("name"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("end_ts"), (F.col("o_orderstatus") == "P").alias("archived"))
    return retention.partition_expiry(parts, "1998-07-01 00:00:00").select("id", "name")


# Fleet


@query("SELECT (SELECT count(*) FROM customer)::BIGINT AS devices, (SELECT count_if(c_acctbal > 0) FROM customer)::BIGINT AS devices_online, (SELECT count(*) FROM supplier)::BIGINT AS jobs, (SELECT count_if(s_acctbal > 0) FROM supplier)::BIGINT AS jobs_active, count(*)::BIGINT AS versions, round(coalesce(sum(o_totalprice), 0), 2) AS stored, (SELECT count_if(event_type = 'error') FROM events)::BIGINT AS open_alerts FROM orders")
def dashboard(spark, d):
    devices = v.table(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("online"))
    tasks = v.table(spark, d, "supplier").select((F.col("s_acctbal") > 0).alias("active"))
    return fleet.dashboard(devices, tasks, v.versions(spark, d), v.samples(spark, d).select((F.col("metric") == "error").alias("open")))


@query("SELECT o_orderpriority, count_if(o_orderstatus = 'F')::BIGINT AS n_f, count_if(o_orderstatus = 'O')::BIGINT AS n_o, count_if(o_orderstatus = 'P')::BIGINT AS n_p FROM orders GROUP BY 1")
def status_histogram(spark, d):
    return fleet.histogram(v.table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT count(*)::BIGINT AS total, count_if(o_orderstatus = 'F')::BIGINT AS success, round(count_if(o_orderstatus = 'F') / count(*)::DOUBLE, 6) AS rate FROM orders")
def success_rate(spark, d):
    return fleet.success_rate(v.table(spark, d, "orders"), "o_orderstatus", "F")


@query("WITH f AS (SELECT l_returnflag, l_linestatus, l_discount < 0.05 AS p FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O')), g AS (SELECT a.l_returnflag, b.l_linestatus FROM (SELECT DISTINCT l_returnflag FROM f) a, (SELECT DISTINCT l_linestatus FROM f) b), c AS (SELECT l_returnflag, l_linestatus, count(*) AS t, count_if(p) AS k FROM f GROUP BY ALL), t AS (SELECT g.*, t, k FROM g LEFT JOIN c USING (l_returnflag, l_linestatus) UNION ALL SELECT l_returnflag, NULL, count(*), count_if(p) FROM f GROUP BY 1 UNION ALL SELECT NULL, l_linestatus, count(*), count_if(p) FROM f GROUP BY 2 UNION ALL SELECT NULL, NULL, count(*), count_if(p) FROM f) SELECT l_returnflag, l_linestatus, coalesce(t, 0)::BIGINT AS total, coalesce(k, 0)::BIGINT AS passed, round(coalesce(k / t::DOUBLE, 0), 6) AS rate FROM t")
def pass_rate_grid(spark, d):
    rows = v.table(spark, d, "lineitem").filter("NOT (l_returnflag = 'R' AND l_linestatus = 'O')")
    return fleet.pass_grid(rows, "l_returnflag", "l_linestatus", F.col("l_discount") < 0.05)


@query("WITH l AS (SELECT o_orderpriority AS line, count(*)::BIGINT AS total, count_if(o_totalprice > CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 5000 END)::BIGINT AS passed FROM orders GROUP BY 1), s AS (SELECT *, CASE WHEN total = 0 THEN 'pending' WHEN passed = total THEN 'pass' ELSE 'fail' END AS status, round(passed / total::DOUBLE, 6) AS rate FROM l) SELECT *, (SELECT bool_and(status = 'pass') FROM s) AS signable, coalesce((SELECT string_agg(line, ',' ORDER BY line) FROM s WHERE status <> 'pass'), '') AS failing FROM s")
def acceptance_lines(spark, d):
    floor = F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(5000)
    lines = v.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("line")).agg(F.count("*").alias("total"), F.count_if(F.col("o_totalprice") > floor).alias("passed"))
    return fleet.acceptance(lines)


@query("WITH r AS (SELECT p_partkey AS f, CASE WHEN p_size > 25 THEN 'implemented' ELSE 'partial' END AS s FROM part WHERE p_partkey % 3 <> 0) SELECT count_if(s = 'implemented')::BIGINT AS implemented, count_if(s = 'partial')::BIGINT AS partial, count_if(s IS NULL)::BIGINT AS missing, count(*)::BIGINT AS total, round(count_if(s = 'implemented') / count(*)::DOUBLE, 6) AS coverage FROM part LEFT JOIN r ON f = p_partkey")
def coverage(spark, d):
    p = v.table(spark, d, "part")
    registry = p.filter("p_partkey % 3 <> 0").selectExpr("p_partkey AS feature", "CASE WHEN p_size > 25 THEN 'implemented' ELSE 'partial' END AS state")
    return fleet.coverage(p.select(F.col("p_partkey").alias("feature")), registry)


@query("SELECT event_id AS id, user_id AS device, event_type AS metric, ts, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def top_logs(spark, d):
    return fleet.newest(v.samples(spark, d).filter("metric = 'error'"), 100, "ts", "id")


@query("SELECT user_id AS device, max_by(event_type, (ts, event_id)) AS metric, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def latest_per_key(spark, d):
    return fleet.latest(v.samples(spark, d), "device", "ts", "id").select("device", "metric", "value")


TASKS = "SELECT o_orderkey AS task, o_custkey % 40 AS agent, o_custkey AS job, o_orderpriority AS priority, o_orderdate AS created FROM orders WHERE o_orderstatus = 'P'"


def _tasks(spark, d):
    return v.table(spark, d, "orders").filter("o_orderstatus = 'P'").selectExpr("o_orderkey AS task", "o_custkey % 40 AS agent", "o_custkey AS job", "o_orderpriority AS priority", "o_orderdate AS created")


@query(f"WITH t AS ({TASKS}), n AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY created, task) AS n FROM t) SELECT task, agent, created FROM n WHERE n <= 5")
def claim_tasks(spark, d):
    return fleet.claimed(_tasks(spark, d), 5).select("task", "agent", "created")


@query(f"WITH t AS ({TASKS}), n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY priority DESC, created, task) AS n FROM t) SELECT task, job, priority, row_number() OVER (ORDER BY priority DESC, created, task)::INT AS place FROM n WHERE n = 1 ORDER BY place LIMIT 20")
def queue_order(spark, d):
    return fleet.queue(_tasks(spark, d), 20).select("task", "job", "priority", "place")


RULES = [("r1", "high", "error", ">", 20.0, True, 86400), ("r2", "low", "click", ">=", 90.0, True, 3600), ("r3", "low", "view", "<", 1.0, True, 600), ("r4", "low", "view", "~", 1.0, True, 600), ("r5", "high", "error", ">", 0.0, False, 600), ("r6", "mid", "purchase", ">", 30.0, True, 172800), ("r7", "mid", "login", "<=", 40.0, True, 43200)]
RULES_SQL = ", ".join(str(r).replace("True", "true").replace("False", "false") for r in RULES)
MATCHES = f", r(rule, severity, metric, op, threshold, enabled, suppress_s) AS (VALUES {RULES_SQL}), m AS (SELECT rule, severity, device, s.metric, ts, id, value, suppress_s FROM v_samples s JOIN r ON s.metric = r.metric AND enabled AND CASE op WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold WHEN '==' THEN value = threshold ELSE false END)"


def _matches(spark, d):
    table = spark.createDataFrame(RULES, "rule string, severity string, metric string, op string, threshold double, enabled boolean, suppress_s int")
    return fleet.alert_matches(v.samples(spark, d), table)


@query(oracle("v_samples", body=MATCHES + " SELECT rule, severity, device, id, value FROM m"))
def alert_matches(spark, d):
    return _matches(spark, d).select("rule", "severity", "device", "id", "value")


@query(oracle("v_samples", body=MATCHES + ", f(rule, device, ts, s) AS (SELECT rule, device, min(ts), min(suppress_s) FROM m GROUP BY ALL UNION ALL SELECT f.rule, f.device, (SELECT min(m.ts) FROM m WHERE m.rule = f.rule AND m.device = f.device AND m.ts >= f.ts + to_seconds(f.s)) AS t, f.s FROM f WHERE f.ts IS NOT NULL) SELECT rule, device, ts FROM f WHERE ts IS NOT NULL"))
def alert_suppressed(spark, d):
    return fleet.fired(_matches(spark, d))


SLOPES = ", x AS (SELECT device, metric, value, (row_number() OVER (PARTITION BY device, metric ORDER BY ts, id) - 1)::DOUBLE AS k FROM v_samples), g AS (SELECT device, metric, count(*)::BIGINT AS n, round(coalesce(regr_slope(value, k), 0), 8) AS slope FROM x GROUP BY ALL)"


@query(oracle("v_samples", body=SLOPES + " SELECT * FROM g"))
def stability_slope(spark, d):
    return fleet.slopes(v.samples(spark, d), F.col("value"))


VERDICTS = SLOPES + ", t AS (SELECT device, g.metric, n, slope, CASE WHEN n < 2 THEN 'not_tested' WHEN slope > CASE g.metric WHEN 'click' THEN 1.0 WHEN 'error' THEN 0.5 ELSE 1e308 END THEN 'fail' ELSE 'pass' END AS verdict FROM g)"


def _stability(spark, d):
    return fleet.stability(v.samples(spark, d), spark.createDataFrame([("click", 1.0), ("error", 0.5)], "metric string, most double"))


@query(oracle("v_samples", body=VERDICTS + " SELECT * FROM t"))
def stability_verdicts(spark, d):
    return _stability(spark, d)


@query(oracle("v_samples", body=VERDICTS + " SELECT device, bool_and(verdict = 'pass') AS all_passed, bool_or(verdict = 'fail') AS any_failed FROM t GROUP BY device"))
def stability_overall(spark, d):
    return fleet.overall(_stability(spark, d))


@query(oracle("v_samples", body=", k AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ts, id) AS n FROM v_samples) SELECT a.id, round(max(b.value), 4) AS peak, round(avg(b.value), 8) AS mean FROM k a JOIN k b ON a.device = b.device AND b.n BETWEEN a.n - 11 AND a.n AND b.ts >= a.ts - INTERVAL 2 DAY GROUP BY a.id"))
def sliding_peak_avg(spark, d):
    return fleet.sliding(v.samples(spark, d), 12, 2 * 86400).select("id", "peak", "mean")


@query(oracle("v_samples", body="SELECT device, round(min_by(value, (ts, id)), 4) AS first, round(max_by(value, (ts, id)), 4) AS last, round(round(max_by(value, (ts, id)), 4) - round(min_by(value, (ts, id)), 4), 4) AS grown FROM v_samples GROUP BY device"))
def disk_growth(spark, d):
    return fleet.growth(v.samples(spark, d))


@query(oracle("v_samples", body="SELECT device, max(ts) AS last_seen, CASE WHEN device % 11 = 0 THEN 'disabled' WHEN max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 90 SECOND THEN 'offline' ELSE 'online' END AS state FROM v_samples GROUP BY device"))
def heartbeat_timeout(spark, d):
    s = v.samples(spark, d)
    known = s.select("device", F.when(F.col("device") % 11 == 0, "disabled").otherwise("online").alias("status")).distinct()
    return fleet.timeouts(s, "2024-01-30 00:00:00", known=known)


@query("SELECT s_suppkey AS node, CASE WHEN s_acctbal / 100 > 90 OR s_suppkey % 17 = 0 THEN 'critical' WHEN s_acctbal / 100 > 80 OR s_suppkey % 13 = 0 OR s_suppkey % 23 > (50 + s_suppkey % 50) // 10 THEN 'warning' ELSE 'healthy' END AS level FROM supplier")
def health_rollup(spark, d):
    s = v.table(spark, d, "supplier")
    return fleet.health(s.selectExpr("s_suppkey AS node", "s_acctbal / 100 AS disk_used", "s_suppkey % 17 <> 0 AS journal_ok", "s_suppkey % 13 <> 0 AS last_ok", "50 + s_suppkey % 50 AS total", "s_suppkey % 23 AS failures"))


@query("SELECT l_orderkey AS case_id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_partkey % 50 = 0 THEN 'by_design' WHEN l_returnflag <> 'A' AND l_linestatus <> 'F' THEN 'not_supported' WHEN l_returnflag = 'A' AND l_linestatus <> 'F' THEN 'fail' WHEN l_tax >= 0.07 THEN 'fail' ELSE 'pass' END AS verdict FROM lineitem")
def adjudication(spark, d):
    rows = v.table(spark, d, "lineitem").selectExpr("l_orderkey AS case_id", "l_linenumber AS line", "l_partkey AS part", "l_partkey % 50 = 0 AS by_design", "l_returnflag = 'A' AS reference_ok", "l_linestatus = 'F' AS ours_ok", "l_tax < 0.07 AS same_digest")
    return fleet.adjudicated(rows).select("case_id", "line", "part", "verdict")


@query("SELECT max(o_custkey % 90)::DOUBLE AS max_rto_s, max(o_orderkey % 40)::DOUBLE AS max_rpo_s, max(o_custkey % 90) <= 60 AS rto_met, true AS rpo_met FROM orders")
def recovery_targets(spark, d):
    o = v.table(spark, d, "orders")
    at = F.col("o_orderdate")
    return fleet.recovery_times(o.select(at.alias("fault_at"), (at + F.make_dt_interval(secs=F.col("o_custkey") % 90)).alias("recovered_at"), (at - F.make_dt_interval(secs=F.col("o_orderkey") % 40)).alias("last_data_at")), 60, 0)


@query("WITH m AS (SELECT event_type AS name, user_id % 3 AS g, count(*)::BIGINT AS n FROM events GROUP BY ALL) SELECT name, 'counter' AS kind, '# HELP ' || name || ' events of this kind' || chr(10) || '# TYPE ' || name || ' counter' || chr(10) || string_agg(name || '{group=\"' || g || '\",zone=\"z\"} ' || n, chr(10) ORDER BY name || '{group=\"' || g || '\",zone=\"z\"} ' || n) AS text FROM m GROUP BY name")
def metric_text(spark, d):
    counts = v.samples(spark, d).groupBy(F.col("metric").alias("name"), (F.col("device") % 3).cast("string").alias("g")).agg(F.count("*").alias("value"))
    return fleet.metric_lines(counts.select("name", F.lit("events of this kind").alias("help"), F.lit("counter").alias("kind"), F.create_map(F.lit("zone"), F.lit("z"), F.lit("group"), F.col("g")).alias("labels"), "value"))


# Text, trees, schedules, journals, configurations

REDACT = "message"
for _names in ("password|passwd|pwd", "secret|token|api_key|apikey", "private_key|privatekey", "credential|cred", "", "access_key|accesskey|secret_key|secretkey", "encryption_key|encryptionkey"):
    if _names:
        REDACT = rf"regexp_replace(regexp_replace({REDACT}, '(?i)({_names})(\s*=)\s*\S+', '\1\2***REDACTED***', 'g'), '(?i)({_names})(\s*:)\s*\S+', '\1\2 ***REDACTED***', 'g')"
    else:
        REDACT = rf"regexp_replace({REDACT}, '-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----', '-----REDACTED PRIVATE KEY-----', 'g')"
        REDACT = rf"regexp_replace({REDACT}, '(?i)(authorization)(\s*:)\s*Bearer\s+\S+', '\1\2 ***REDACTED***', 'g')"
        REDACT = rf"regexp_replace({REDACT}, '(?i)(bearer)\s+[A-Za-z0-9\-_\.]+', '***REDACTED***', 'g')"
        REDACT = rf"regexp_replace({REDACT}, '(?i)(mongodb|redis|postgres|mysql|s3|sftp|ftp)://[^\s]+', '\1://***REDACTED***', 'g')"


@query(oracle("v_messages", body=f", r AS (SELECT id, message, {REDACT} AS m FROM v_messages) SELECT id, sha256(m) AS digest, m <> message AS changed FROM r"))
def redact_messages(spark, d):
    out = redact.redacted(F.col("message"))
    rows = v.messages(spark, d).select("id", "message", out.alias("m"))
    return rows.select("id", F.sha2("m", 256).alias("digest"), (F.col("m") != F.col("message")).alias("changed"))


@query(oracle("v_messages", body=f"SELECT id FROM v_messages WHERE {REDACT} <> message"))
def leak_scan(spark, d):
    return v.messages(spark, d).filter(redact.leaks(F.col("message"))).select("id")


@query("SELECT event_id AS id, '[REDACTED]' AS secret, event_type || ' Bearer [REDACTED]' AS note, user_id::VARCHAR AS who, event_type || ' token=***REDACTED***' AS logged FROM events")
def redact_map(spark, d):
    fields = F.create_map(F.lit("Token"), F.concat(F.lit("t"), "event_id"), F.lit("note"), F.concat("event_type", F.lit(" Bearer t"), "event_id"), F.lit("who"), F.col("user_id").cast("string"))
    m, logged = redact.redacted_fields(fields), redact.redacted_map(F.create_map(F.lit("note"), F.concat("event_type", F.lit(" token=t"), "event_id")))
    return v.table(spark, d, "events").select(F.col("event_id").alias("id"), m["Token"].alias("secret"), m["note"].alias("note"), m["who"].alias("who"), logged["note"].alias("logged"))


@query(oracle("v_tree", body="SELECT path, parent FROM v_tree WHERE starts_with(path, (SELECT min(path) FROM v_tree WHERE parent IS NULL) || '/')"))
def tree_subtree(spark, d):
    nodes = v.tree(spark, d)
    return tree.subtree(nodes, nodes.filter("parent IS NULL").agg(F.min("path")).first()[0])


@query(oracle("v_tree", body="SELECT a.path, b.path AS ancestor, (len(string_split(a.path, '/')) - len(string_split(b.path, '/')))::INT AS distance FROM v_tree a JOIN v_tree b ON starts_with(a.path, b.path || '/')"))
def tree_ancestors(spark, d):
    return tree.ancestors(v.tree(spark, d))


@query(oracle("v_tree", body="SELECT path, (len(string_split(path, '/')) - 1)::INT AS depth FROM v_tree"))
def tree_depth(spark, d):
    return v.tree(spark, d).select("path", tree.depth(F.col("path")).alias("depth"))


@query(oracle("v_tree", body="SELECT CASE WHEN path = '/ASIA/INDIA' OR starts_with(path, '/ASIA/INDIA/') THEN '/EUROPE/INDIA' || substr(path, 12) ELSE path END AS path, CASE WHEN path = '/ASIA/INDIA' THEN '/EUROPE' WHEN starts_with(path, '/ASIA/INDIA/') THEN '/EUROPE/INDIA' || substr(parent, 12) ELSE parent END AS parent FROM v_tree"))
def tree_move(spark, d):
    return tree.moved(v.tree(spark, d), "/ASIA/INDIA", "/EUROPE")


POLICIES = [("p1", "global", None), ("p2", "group", "/ASIA"), ("p3", "device", "/EUROPE/FRANCE"), ("p4", "group", "/EUROPE/FRANCE")]


@query(oracle("v_tree", body="SELECT 'p1' AS policy, path FROM v_tree UNION ALL SELECT 'p2', path FROM v_tree WHERE starts_with(path, '/ASIA/') UNION ALL SELECT 'p3', path FROM v_tree WHERE path = '/EUROPE/FRANCE' UNION ALL SELECT 'p4', path FROM v_tree WHERE starts_with(path, '/EUROPE/FRANCE/')"))
def policy_scope(spark, d):
    return tree.scope(spark.createDataFrame(POLICIES, "policy string, scope string, target string"), v.tree(spark, d))


MODES = "['interval', 'daily', 'weekly', 'monthly', 'manual']"


@query(f"""WITH x AS (SELECT o_orderkey AS id, o_orderdate AS now, {MODES}[(o_orderkey % 5 + 1)::INT] AS mode, (o_orderkey % 24)::INT AS h, (o_orderkey % 60)::INT AS mi, (o_orderkey % 7)::INT AS wd, (o_orderkey % 31 + 1)::INT AS dy, o_orderkey % 5000 AS s FROM orders),
y AS (SELECT *, date_trunc('day', now)::TIMESTAMP + to_hours(h) + to_minutes(mi) AS dat, date_trunc('month', now)::TIMESTAMP AS m1 FROM x),
z AS (SELECT *, dat + to_days((((wd - dayofweek(now)) % 7 + 7) % 7)::INT) AS wat, m1 + to_days(dy - 1) + to_hours(h) + to_minutes(mi) AS a1, m1 + INTERVAL 1 MONTH + to_days(dy - 1) + to_hours(h) + to_minutes(mi) AS a2 FROM y)
SELECT id, mode, CASE mode WHEN 'interval' THEN now + to_seconds(s) WHEN 'daily' THEN CASE WHEN dat > now THEN dat ELSE dat + INTERVAL 1 DAY END WHEN 'weekly' THEN CASE WHEN wat > now THEN wat ELSE wat + INTERVAL 7 DAY END
  WHEN 'monthly' THEN CASE WHEN month(a1) <> month(m1) THEN NULL WHEN a1 > now THEN a1 WHEN month(a2) = month(m1 + INTERVAL 1 MONTH) THEN a2 END END AS next_run FROM z""")
def next_run(spark, d):
    o = v.table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS now", "element_at(array('interval', 'daily', 'weekly', 'monthly', 'manual'), CAST(o_orderkey % 5 + 1 AS INT)) AS mode", "CAST(o_orderkey % 24 AS INT) AS h", "CAST(o_orderkey % 60 AS INT) AS mi", "CAST(o_orderkey % 7 AS INT) AS wd", "CAST(o_orderkey % 31 + 1 AS INT) AS dy", "o_orderkey % 5000 AS s")
    c = F.col
    return o.select("id", "mode", schedule.next_run(c("mode"), c("now"), seconds=c("s"), hour=c("h"), minute=c("mi"), weekday=c("wd"), day=c("dy")).alias("next_run"))


@query(None)  # an oracle would have to make every minute of a year for every row; tested by brute force
def cron_next(spark, d):
    o = v.table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS now")
    return schedule.cron_next(o, "*/30 2,14 10-20 3,6,9,12 1", "now").select("id", "next_run")


@query("SELECT user_id AS job, max_by(event_id, event_id) AS id, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def journal_last_checkpoint(spark, d):
    return journal.last_checkpoint(v.samples(spark, d).withColumnRenamed("device", "job"), "job", "id", "metric", "purchase", "value").select("job", "id", "value")


KINDS = "CASE event_type WHEN 'click' THEN 'commit_step' WHEN 'view' THEN 'gc_step' WHEN 'login' THEN 'verify_step' WHEN 'purchase' THEN 'state_transition' ELSE 'recovery' END"


@query(f"SELECT user_id AS job, {KINDS} AS kind, count(*)::BIGINT AS entries, CASE {KINDS} WHEN 'commit_step' THEN 'clean_staging' WHEN 'gc_step' THEN 'rerun_gc' WHEN 'verify_step' THEN 'mark_verify_incomplete' WHEN 'state_transition' THEN 'continue_state_transition' ELSE 'skip' END AS action FROM events WHERE value <= 60 GROUP BY 1, 2, 4")
def journal_plan(spark, d):
    return journal.recovery_plan(v.table(spark, d, "events").selectExpr("user_id AS job", f"{KINDS} AS kind", "value > 60 AS committed"))


@query("WITH b AS (SELECT user_id, min(event_id) AS b FROM events WHERE event_type = 'error' GROUP BY 1) SELECT event_id AS id FROM events LEFT JOIN b USING (user_id) WHERE b IS NULL OR event_id < b")
def journal_valid_prefix(spark, d):
    return journal.valid_prefix(v.samples(spark, d).withColumn("ok", F.col("metric") != "error"), "device", "id", "ok").select("id")


STATES = "'created', 'writing', 'verifying', 'committing', 'sealed', 'expired', 'deleted', 'gc_pending', 'purged'"
#: The steps that are legal, typed out for the oracle.
STEPS = "('created', 'writing'), ('writing', 'verifying'), ('writing', 'created'), ('verifying', 'committing'), ('verifying', 'writing'), ('committing', 'sealed'), ('sealed', 'expired'), ('sealed', 'deleted'), ('expired', 'deleted'), ('expired', 'gc_pending'), ('deleted', 'gc_pending'), ('gc_pending', 'purged')"


@query(f"WITH s AS (SELECT user_id AS version, event_id AS id, [{STATES}][(event_id * 7 % 9 + 1)::INT] AS st FROM events), l AS (SELECT *, lag(st) OVER (PARTITION BY version ORDER BY id) AS f FROM s) SELECT version, id, f AS from_state, st AS to_state, CASE WHEN st = 'sealed' THEN 'skip_verifying' ELSE 'invalid_transition' END AS fault FROM l WHERE f <> st AND (f, st) NOT IN ({STEPS})")
def state_violations(spark, d):
    s = v.table(spark, d, "events").selectExpr("user_id AS version", "event_id AS id", f"element_at(array({STATES}), CAST(event_id * 7 % 9 + 1 AS INT)) AS st")
    return journal.violations(s, "version", "id", "st")


#: A configuration for each supplier, made in both engines: options and filters that are known or not, and broken ones.
CONFIG = """CASE WHEN s_suppkey % 11 = 0 THEN '{not json' ELSE concat('{"Name": "', CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END, '", "Sources": [', CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '"/x", "/y"' END,
  '], "Destination": {"Type": "', CASE WHEN s_suppkey % 3 = 0 THEN 'azure' ELSE 'file' END, '", "Path": "/b"}, "Encryption": {"Type": "AES256"}, "Compression": "zip", "Options": {"blocksize": "1", "', CASE WHEN s_suppkey % 2 = 0 THEN 'dblock-size' ELSE 'warp-speed' END,
  '": "9"}, "Filters": [{"Type": "', CASE WHEN s_suppkey % 4 = 0 THEN 'wildcard' ELSE 'moon' END, '", "Rule": "*.txt"}]}') END"""
SOUND = "(s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0)"


def _configs(spark, d):
    return v.table(spark, d, "supplier").selectExpr("s_suppkey AS id", f"{CONFIG} AS config")


@query(f"""SELECT s_suppkey AS id, CASE WHEN NOT {SOUND} THEN 'failed' WHEN s_suppkey % 2 = 1 OR s_suppkey % 4 <> 0 THEN 'partial' ELSE 'success' END AS status, CASE WHEN {SOUND} THEN s_name END AS name, CASE WHEN {SOUND} THEN 2 ELSE 0 END::INT AS n_sources,
  CASE WHEN {SOUND} THEN CASE WHEN s_suppkey % 3 = 0 THEN 'azure_blob' ELSE 'local' END END AS storage, CASE WHEN {SOUND} THEN 'aes-256-gcm' END AS encryption, CASE WHEN {SOUND} THEN 'zstd' END AS compression,
  CASE WHEN NOT {SOUND} THEN '' ELSE concat_ws(',', CASE WHEN s_suppkey % 4 <> 0 THEN 'Filters.moon' END, CASE WHEN s_suppkey % 2 = 1 THEN 'Options.warp-speed' END) END AS unsupported FROM supplier""")
def config_mapping(spark, d):
    return config.mapped(_configs(spark, d))


@query(f"""WITH s AS (SELECT * FROM supplier WHERE {SOUND}) SELECT s_suppkey AS id, unnest([
  {{'f': 'Name', 't': 'job.name', 'v': s_name}}, {{'f': 'Sources', 't': 'source_config.paths', 'v': '["/x","/y"]'}}, {{'f': 'Destination.Type', 't': 'storage_backend', 'v': CASE WHEN s_suppkey % 3 = 0 THEN 'azure_blob' ELSE 'local' END}},
  {{'f': 'Destination.Path', 't': 'backend_config.root_path', 'v': '/b'}}, {{'f': 'Encryption.Type', 't': 'encryption_config.algorithm', 'v': 'aes-256-gcm'}}, {{'f': 'Compression', 't': 'compression_config.algorithm', 'v': 'zstd'}},
  {{'f': 'Filters', 't': 'source_config.filters', 'v': '[{{"Type":"' || CASE WHEN s_suppkey % 4 = 0 THEN 'wildcard' ELSE 'moon' END || '","Rule":"*.txt"}}]'}}, {{'f': 'Options.blocksize', 't': 'options.blocksize', 'v': '1'}}]
  || CASE WHEN s_suppkey % 2 = 0 THEN [{{'f': 'Options.dblock-size', 't': 'options.dblock-size', 'v': '9'}}] ELSE [] END) AS m FROM s""".join(("WITH x AS (", ") SELECT id, m.f AS field, m.t AS target, m.v AS value FROM x")))
def config_fields(spark, d):
    return config.field_mappings(_configs(spark, d))


@query(f"SELECT min(s_suppkey) AS id, sha256({CONFIG}) AS digest FROM supplier GROUP BY 2")
def config_imports(spark, d):
    return config.imported_once(_configs(spark, d)).select("id", "digest")


# Control tables and small rules


@query("SELECT o_orderkey AS execution, o_custkey AS job, c_name AS name, o_orderdate AS started FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' ORDER BY started, execution LIMIT 10")
def pending_executions(spark, d):
    e = v.table(spark, d, "orders").selectExpr("o_orderkey AS execution", "o_custkey AS job", "if(o_orderstatus = 'P', 'pending', 'done') AS state", "o_orderdate AS started")
    return control.pending_executions(e, v.table(spark, d, "customer").selectExpr("c_custkey AS job", "c_name AS name"))


@query("SELECT DISTINCT c_custkey AS user, unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN ['job:*', 'log:read'] ELSE ['log:read'] END) AS permission FROM customer")
def user_permissions(spark, d):
    users = v.table(spark, d, "customer").selectExpr("c_custkey AS user", "c_mktsegment AS role")
    roles = users.select("role").distinct().withColumn("permissions", F.expr("CASE WHEN role = 'BUILDING' THEN '[\"job:*\", \"log:read\"]' ELSE '[\"log:read\"]' END"))
    return control.user_permissions(users, roles)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'new' || s_suppkey ELSE s_name END AS s_name, CASE WHEN s_suppkey % 6 = 0 THEN 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier")
def partial_update(spark, d):
    s = v.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = s.filter("s_suppkey % 3 = 0").selectExpr("s_suppkey", "concat('new', s_suppkey) AS s_name", "if(s_suppkey % 6 = 0, 1.5D, NULL) AS s_acctbal")
    return control.updated(s, changes, "s_suppkey", ["s_name", "s_acctbal"])


@query("SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN o_totalprice <= 1000 THEN 'positive' END, CASE WHEN o_orderstatus = 'P' THEN 'settled' END], lambda x: x IS NOT NULL)) AS rule FROM orders")
def constraint_violations(spark, d):
    o = v.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return control.violations(o, {"positive": F.col("o_totalprice") > 1000, "settled": F.col("o_orderstatus") != "P"}, "id")


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey % 9 <> 0)::BIGINT AS orders, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 9 <> 0) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders))::BIGINT AS lines, (SELECT count(*) FROM customer WHERE c_custkey % 9 <> 0)::BIGINT AS customers")
def delete_cascade(spark, d):
    tables = {n: v.table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    gone = tables["customer"].filter("c_custkey % 9 = 0").select("c_custkey")
    out = control.deleted(tables, "customer", gone, [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    n = lambda t, a: out[t].agg(F.count("*").alias(a))
    return n("orders", "orders").crossJoin(n("lineitem", "lines")).crossJoin(n("customer", "customers"))


@query("SELECT event_type AS name, '{\"g\":\"' || user_id % 4 || '\"}' AS labels, CASE WHEN event_type = 'error' THEN 'counter' ELSE 'gauge' END AS kind, round(CASE WHEN event_type = 'error' THEN sum(value) ELSE max_by(value, event_id) END, 4) AS value FROM events GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY event_type, user_id % 4"))
def metric_state(spark, d):
    e = v.table(spark, d, "events").select(F.col("event_type").alias("name"), F.create_map(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("labels"), F.when(F.col("event_type") == "error", "counter").otherwise("gauge").alias("kind"), "value", F.col("event_id").alias("at"))
    return control.metric_state(e).withColumn("value", F.round("value", 4))


@query(oracle("v_versions", "v_refs", body=", x AS (SELECT *, job % 10 AS repo FROM v_versions), c AS (SELECT repo, count(DISTINCT chunk) AS n FROM v_refs r JOIN x ON r.version = x.version GROUP BY repo) SELECT repo, count(*)::BIGINT AS versions, round(sum(size), 2) AS size, coalesce(max(n), 0)::BIGINT AS chunks FROM x LEFT JOIN c USING (repo) GROUP BY repo"))
def repository_rollup(spark, d):
    return control.roll_up(v.versions(spark, d).withColumn("repo", F.col("job") % 10), v.refs(spark, d), "repo")


@query(oracle("v_files", body="SELECT count_if(doc_id % 6 <> 0)::BIGINT AS accepted, count_if(doc_id % 6 = 0)::BIGINT AS refused FROM v_files"))
def batch_put(spark, d):
    f = v.files(spark, d)
    return control.batch_put(f.select(F.when(F.col("doc_id") % 6 == 0, "bad").otherwise(F.sha2("content", 256)).alias("hash"), F.col("content").alias("data")))


KIND = "['network_break', 'disk_full', 'permission_denied', 'file_locked', 'source_missing', 'repo_unavailable', 'process_killed', 'power_off', 'other'][(event_id % 9 + 1)::INT]"


@query(f"""WITH e AS (SELECT *, {KIND} AS kind FROM events) SELECT event_id AS id,
  CASE kind WHEN 'network_break' THEN 'retry' WHEN 'disk_full' THEN 'abort' WHEN 'permission_denied' THEN 'skip' WHEN 'file_locked' THEN 'retry' WHEN 'source_missing' THEN 'skip' WHEN 'repo_unavailable' THEN 'retry' WHEN 'process_killed' THEN 'resume' WHEN 'power_off' THEN 'self_check_and_isolate' END AS decision,
  CASE kind WHEN 'disk_full' THEN 'abort' WHEN 'permission_denied' THEN 'skip' WHEN 'source_missing' THEN 'skip' WHEN 'file_locked' THEN 'retry' WHEN 'network_break' THEN 'retry' WHEN 'repo_unavailable' THEN 'retry' WHEN 'process_killed' THEN 'continue' WHEN 'power_off' THEN 'continue' ELSE 'mark_failed' END AS action,
  CASE WHEN event_id % 7 = 0 THEN 'pending' WHEN event_id % 5 = 0 THEN 'not_tested' WHEN value > 60 THEN 'exceed' ELSE 'pass' END AS target, value < 40 AS blocked, round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value * 1000 / (event_id % 5) END, 4) AS speed, greatest(0, least(1, value / 100)) AS progress FROM e""")
def small_rules(spark, d):
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, (*rules.DECISIONS, "other"))), (c("event_id") % 9 + 1).cast("int"))
    target = F.when(c("event_id") % 5 == 0, 0.0).otherwise(60.0)
    return v.table(spark, d, "events").select(
        c("event_id").alias("id"), rules.decision(kind).alias("decision"), rules.engine_action(kind).alias("action"), rules.target_status(c("event_id") % 7 != 0, target, c("value")).alias("target"),
        rules.blocked(F.lit(40.0), c("value")).alias("blocked"), F.round(rules.throughput(c("value"), c("event_id") % 5), 4).alias("speed"), rules.clamped(c("value") / 100).alias("progress"),
    )


@query(oracle("v_files", body="SELECT path, true AS same, true AS tampered_is_null, true AS unpacked FROM v_files"))
def chunk_round_trip(spark, d):
    key, digest = F.lit(b"0123456789abcdef0123456789abcdef"), F.sha2("content", 256)
    packed = v.files(spark, d).select("path", "content", crypto.encrypted(F.col("content"), key, digest).alias("e"), crypto.compressed("content").alias("z"))
    torn = F.concat(F.col("e"), F.lit(b"x").cast("binary"))
    return packed.select("path", crypto.decrypted(F.col("e"), key).eqNullSafe(F.col("content")).alias("same"), crypto.decrypted(torn, key).isNull().alias("tampered_is_null"), crypto.decompressed("z").eqNullSafe(F.col("content")).alias("unpacked"))


@query(oracle("v_files", body="SELECT path AS key FROM v_files WHERE starts_with(path, 'src1') AND path > 'src11/' ORDER BY path LIMIT 25"))
def list_objects(spark, d):
    return repository.list_objects(v.files(spark, d).select(F.col("path").alias("key")), "src1", 25, "src11/")


# Streams, run to the end of what is there


def streamed(spark, stream, run=jobs.to_parquet):
    path = new_path(spark, "stream")
    run(stream, f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _plain(df, *times):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@query(oracle("v_samples", body=", w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, metric, value FROM v_samples) SELECT start, metric, count(*)::BIGINT AS n, round(max(value), 4) AS peak, round(avg(value), 4) AS mean FROM w GROUP BY start, metric"))
def stream_windows(spark, d):
    return _plain(streamed(spark, jobs.windows(jobs.samples(spark, d), late=None), jobs.replayed), "start")


@query(oracle("v_samples", body=", g AS (SELECT device, ts, coalesce(ts > lag(ts) OVER (PARTITION BY device ORDER BY ts) + INTERVAL 1 DAY, true)::INT AS new FROM v_samples), s AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY ts) AS k FROM g) SELECT device, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS \"end\", count(*)::BIGINT AS n FROM s GROUP BY device, k"))
def stream_sessions(spark, d):
    return _plain(streamed(spark, jobs.sessions(jobs.samples(spark, d), "1 day", late=None), jobs.replayed), "start", "end")


@query(ORACLE_SQL["alert_suppressed"])
def stream_alerts(spark, d):
    table = spark.createDataFrame(RULES, "rule string, severity string, metric string, op string, threshold double, enabled boolean, suppress_s int")
    # all files in one batch: files that overlap in time come in no order, and which match fires hangs on all before it
    matches = fleet.alert_matches(jobs.samples(spark, d, None), table).select("rule", "device", "ts", "suppress_s")
    return _plain(streamed(spark, matches, jobs.suppressed).select("rule", "device", "ts"), "ts")


RATE = 40.0


@query(f"""WITH RECURSIVE r AS (SELECT user_id AS source, event_id AS id, epoch_us(ts) // 100000000000 AS at_s, value AS amount, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 100000000000, event_id) AS n FROM events),
b(source, id, n, t, have, amount) AS (SELECT source, id, n, at_s, {2 * RATE}::DOUBLE, amount FROM r WHERE n = 1
  UNION ALL SELECT r.source, r.id, r.n, r.at_s, least(b.have - CASE WHEN b.amount <= b.have THEN b.amount ELSE 0 END + {RATE}::DOUBLE * (r.at_s - b.t), {2 * RATE}::DOUBLE), r.amount FROM b JOIN r ON r.source = b.source AND r.n = b.n + 1)
SELECT source, id, amount <= have AS granted, amount > {2 * RATE}::DOUBLE AS infeasible FROM b""")
def rate_limit_replay(spark, d):
    at = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 100000)
    e = v.table(spark, d, "events").select(F.col("user_id").alias("source"), at.alias("at_s"), F.col("value").alias("amount"), F.col("event_id").alias("id"))
    return jobs.token_bucket(e, RATE)


from . import more  # noqa: E402, F401  registers the rest
