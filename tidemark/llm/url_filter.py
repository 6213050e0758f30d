"""URL filtering: a blocked Bloom filter before an exact hash join.

A list holds canonical URLs, each a host and the start of a path, with block or allow. A URL fits
an entry if its host is the entry's or a subdomain of it and its path starts with the entry's path.
Every URL makes one key for each of its host suffixes and each path length that the list has. The
Bloom filter, of bounded size and broadcast, drops nearly all keys that aren't listed; those that
pass meet the list in a hash join by the whole key, which removes the false positives. The longest
entry wins (host and path together; on a tie the longer host); where none fits, the URL is allowed.

Defined cases: a URL of any length is read whole; a null URL or one without '://' has an empty host and path and fits nothing; repeated
rows are judged one by one; repeated entries of the list count once (block wins over allow); an
empty list or table gives allow or no rows. Columns other than the id and the URL aren't returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii

#: (action, host, start of path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
WORDS, PROBES = 4, 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")


class BlockedBloom:
    """Bits in blocks of 256; all probes of a key fall into the one block its hash names."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def spread(h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
        h = h.astype(np.int64).view(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        block = ((h >> np.uint64(40)) % np.uint64(n_blocks)).astype(np.int64)
        rest = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return block, np.stack([(rest >> np.uint64(8 * k + 8)) & np.uint64(255) for k in range(PROBES)], 1)

    @classmethod
    def masks(cls, h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
        block, place = cls.spread(h, n_blocks)
        out = np.zeros((len(h), WORDS), np.uint64)
        for k in range(PROBES):
            out[np.arange(len(h)), place[:, k] >> np.uint64(6)] |= np.uint64(1) << (place[:, k] & np.uint64(63))
        return block, out

    @classmethod
    def of(cls, hashes: DataFrame, bits_per_key: int, max_bytes: int) -> BlockedBloom:
        """Filter over the column h. Its size follows the number of keys up to max_bytes; beyond
        that more false positives pass on to the exact join."""
        n = hashes.count()
        n_blocks = int(min(max(1, n * bits_per_key // 256 + 1), max_bytes // 32))

        def parts(batches):
            for pdf in batches:
                block, masks = cls.masks(pdf["h"].to_numpy(np.int64), n_blocks)
                yield pd.DataFrame({"block": block} | {f"w{k}": masks[:, k].view(np.int64) for k in range(WORDS)})

        words = [f"w{k}" for k in range(WORDS)]
        rows = hashes.select("h").mapInPandas(parts, "block long, " + ", ".join(f"{w} long" for w in words)).groupBy("block").agg(*(F.bit_or(w).alias(w) for w in words)).toPandas()  # at most n_blocks rows
        bits = np.zeros((n_blocks, WORDS), np.uint64)
        bits[rows["block"].to_numpy(np.int64)] = rows[words].to_numpy(np.int64).view(np.uint64)
        return cls(bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        block, masks = self.masks(h, len(self.bits))
        return ((self.bits[block] & masks) == masks).all(1)


def judged(urls: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", bits_per_key: int = 12, max_filter_bytes: int = 32 << 20) -> DataFrame:
    """id, host, path, rule (host + path of the winning entry, else null), verdict of every row of urls.

    rules: action, host, path. The list may be large; only the filter (max_filter_bytes at most) is
    broadcast. The distinct path lengths of the list, at most as many as the longest path has
    characters, go to the driver.
    """
    spark = urls.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    entry = F.concat("host", "path")
    listed = (
        rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy("host", "path")
        .agg(F.when(F.max(F.col("action") == "block"), "block").otherwise("allow").alias("action"))
        .select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "action", entry.alias("rule"))
    )
    lengths = sorted(r[0] for r in listed.select(F.length("r_path")).distinct().collect())
    bloom = spark.sparkContext.broadcast(BlockedBloom.of(listed.select(F.xxhash64("r_host", "r_path").alias("h")), bits_per_key, max_filter_bytes).bits)

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(bloom.value).has(h.to_numpy(np.int64)))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    starts = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)).cast("array<string>"), lambda s: s.isNotNull())
    keys = (
        rows.filter("host != ''").select("host", "path").distinct()
        .withColumn("r_host", F.explode(suffixes))
        .withColumn("r_path", F.explode(starts))
        .filter(passes(F.xxhash64("r_host", "r_path")))
    )
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.length("r_host"), "r_host"))
    hits = keys.join(listed, ["r_host", "r_path"]).groupBy("host", "path").agg(best.alias("hit"))
    # rows without a host fit nothing: their keys are spread
    key = F.when(F.col("host") == "", F.concat(F.lit("/"), F.pmod(F.xxhash64(id_col, url_col), F.lit(4096)).cast("string"))).otherwise(F.col("host"))
    rows = urls.select(id_col, url_col).select(id_col, host.alias("host"), path.alias("path"), url_col).withColumn("_key", key)
    hits = hits.select(F.col("host").alias("_key"), F.col("path").alias("_path"), "hit")
    return rows.join(hits, (rows["_key"] == hits["_key"]) & (rows["path"] == hits["_path"]), "left").select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit("allow")).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark))


SQL = r"""
WITH u AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
q AS (SELECT u.*, (SELECT arg_max({'rule': rhost || rpath, 'action': action}, length(rhost || rpath)) FROM r
    WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)) AS hit FROM u)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.action, 'allow') AS verdict FROM q
"""
