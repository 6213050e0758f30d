"""Backup data as views over the supplied tables: files, snapshots, versions, references, samples.

Each view is a SELECT that Spark and other SQL engines both read, so queries and their oracles start
from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned files: path, content (binary), size, mtime (seconds), doc_id."""
    docs = table(spark, sf_dir, "documents")
    content = F.col("text").cast("binary")
    return docs.select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), content.alias("content"), F.octet_length(content).cast("long").alias("size"), F.col("doc_id").alias("mtime"))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older snapshot: path, size, mtime, digest of the content, one of another kind, permissions."""
    f = files(spark, sf_dir).filter("doc_id % 10 <> 0")
    return f.select("path", "size", "mtime", F.sha2("content", 256).alias("digest"), F.md5("content").alias("digest2"), F.lit(420).alias("permissions"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newer snapshot: some files gone, some moved, some changed."""
    f = files(spark, sf_dir).filter("doc_id % 7 <> 0")
    moved, changed = F.col("doc_id") % 11 == 0, (F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 11 != 0)
    text = F.when(changed, F.concat(F.col("content"), F.lit(b"!").cast("binary"))).otherwise(F.col("content"))
    return f.select(F.when(moved, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), (F.col("size") + changed.cast("long")).alias("size"), "mtime", F.sha2(text, 256).alias("digest"), F.when(F.col("doc_id") % 13 == 0, "torn").otherwise(F.md5(text)).alias("digest2"), F.when(F.col("doc_id") % 17 == 0, 384).otherwise(420).alias("permissions"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("job"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk references of versions: version, chunk, size, ordinal."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS version", "l_partkey AS chunk", "CAST(l_quantity AS BIGINT) AS size",
        "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ordinal",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks: chunk, bucket, stored_size. Some parts are missing; some chunks, with keys below zero, nothing refers to."""
    part = table(spark, sf_dir, "part")
    keys = part.filter("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("chunk"), "p_size").unionByName(part.filter("p_partkey % 23 = 0").select((-F.col("p_partkey")).alias("chunk"), "p_size"))
    return keys.select("chunk", F.substring(F.sha2(F.col("chunk").cast("string"), 256), 1, 2).alias("bucket"), F.col("p_size").cast("long").alias("stored_size"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("device"), F.col("event_type").alias("metric"), "ts", "value")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in nations in regions, as node, path, parent."""
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    regions = r.select(F.concat(F.lit("/"), "r_name").alias("path"), F.lit(None).cast("string").alias("parent"))
    nations = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", F.lit(""), "r_name", "n_name").alias("path"), F.concat(F.lit("/"), "r_name").alias("parent"))
    customers = (
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat_ws("/", F.lit(""), "r_name", "n_name", "c_name").alias("path"), F.concat_ws("/", F.lit(""), "r_name", "n_name").alias("parent"))
    )
    return regions.unionByName(nations).unionByName(customers)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log messages, some of which hold a secret: id, message."""
    secret = F.expr("CASE WHEN doc_id % 20 = 0 THEN ' db_password=x' || doc_id WHEN doc_id % 20 = 5 THEN ' Authorization: Bearer abc.' || doc_id WHEN doc_id % 20 = 10 THEN ' postgres://app:pw' || doc_id || '@db/main' WHEN doc_id % 20 = 15 THEN ' secret_key : k' || doc_id ELSE '' END")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat("text", secret).alias("message"))
    talks = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("id"), F.col("text").alias("message"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("message"))
    return docs.unionByName(talks).unionByName(pages)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for every order: version_id, ts, files, each a line of it with two chunks."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("version_id")).agg(
        F.min("l_shipdate").alias("ts"),
        F.array_sort(F.collect_list(F.struct(
            F.concat_ws("/", F.lit("f"), "l_linenumber", "l_partkey", "l_suppkey").alias("path"), F.col("l_quantity").cast("long").alias("size"), F.col("l_suppkey").alias("mtime"),
            F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")).alias("chunks"),
        ))).alias("files"),
    )
    return lines


#: The same views for the oracle, each as a common table expression.
SQL = {
    "v_files": "SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, encode(text) AS content, octet_length(encode(text))::BIGINT AS size, doc_id AS mtime FROM documents",
    "v_baseline": "SELECT path, size, mtime, sha256(content) AS digest, md5(content) AS digest2, 420 AS permissions FROM v_files WHERE doc_id % 10 <> 0",
    "v_current": "SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' || path ELSE path END AS path, size + CASE WHEN doc_id % 5 = 0 AND doc_id % 11 <> 0 THEN 1 ELSE 0 END AS size, mtime, CASE WHEN doc_id % 5 = 0 AND doc_id % 11 <> 0 THEN sha256(content || encode('!')) ELSE sha256(content) END AS digest, CASE WHEN doc_id % 13 = 0 THEN 'torn' WHEN doc_id % 5 = 0 AND doc_id % 11 <> 0 THEN md5(content || encode('!')) ELSE md5(content) END AS digest2, CASE WHEN doc_id % 17 = 0 THEN 384 ELSE 420 END AS permissions FROM v_files WHERE doc_id % 7 <> 0",
    "v_versions": "SELECT o_orderkey AS version, o_custkey AS job, o_orderdate AS ts, o_orderstatus AS status, o_totalprice AS size FROM orders",
    "v_refs": "SELECT l_orderkey AS version, l_partkey AS chunk, l_quantity::BIGINT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ordinal FROM lineitem",
    "v_chunks": "SELECT chunk, substr(sha256(chunk::VARCHAR), 1, 2) AS bucket, p_size::BIGINT AS stored_size FROM (SELECT p_partkey AS chunk, p_size FROM part WHERE p_partkey % 17 <> 0 UNION ALL SELECT -p_partkey, p_size FROM part WHERE p_partkey % 23 = 0)",
    "v_samples": "SELECT event_id AS id, user_id AS device, event_type AS metric, ts, value FROM events",
    "v_tree": "SELECT '/' || r_name AS path, NULL AS parent FROM region UNION ALL SELECT '/' || r_name || '/' || n_name, '/' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '/' || r_name || '/' || n_name || '/' || c_name, '/' || r_name || '/' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "v_messages": "SELECT 'd' || doc_id AS id, text || CASE WHEN doc_id % 20 = 0 THEN ' db_password=x' || doc_id WHEN doc_id % 20 = 5 THEN ' Authorization: Bearer abc.' || doc_id WHEN doc_id % 20 = 10 THEN ' postgres://app:pw' || doc_id || '@db/main' WHEN doc_id % 20 = 15 THEN ' secret_key : k' || doc_id ELSE '' END AS message FROM documents UNION ALL SELECT 'c' || conv_id || ':' || turn, text FROM conversations UNION ALL SELECT 'p' || page_id, html FROM pages",
}
NEEDS = {"v_baseline": ("v_files",), "v_current": ("v_files",)}


def oracle(*views: str, body: str) -> str:
    """body after the common table expressions of the views it names. body may start with more of them: ', x AS (...) SELECT'."""
    order: list[str] = []
    for v in views:
        order += [n for n in (*NEEDS.get(v, ()), v) if n not in order]
    ctes = ", ".join(f"{v} AS ({SQL[v]})" for v in order)
    return f"WITH RECURSIVE {ctes}{'' if body.lstrip().startswith(',') else ' '}{body}" if ctes else body
