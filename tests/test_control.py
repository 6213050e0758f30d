"""Repositories on disk, control tables and small rules."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import crypto, rules
from tidemark.operators import control
from tidemark.operators import reconcile
from tidemark.sources import repository


def test_scan_and_manifests(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.txt").write_bytes(b"12345")
    (tmp_path / "a/b/y.txt").write_bytes(b"")
    (tmp_path / "a/b/z.log").write_bytes(b"1")
    assert repository.estimate(repository.scan(spark, f"file://{tmp_path}/a", only="*.txt")).first()[:] == (1, 5)
    assert {bytes(r.content) for r in repository.scan(spark, f"file://{tmp_path}/a", with_content=True).collect()} == {b"12345", b"1"}
    good = {"version_id": 1, "ts": "2024-01-01 00:00:00", "files": [{"path": "p", "size": 3, "mtime": 1, "chunks": ["h1", "h2"]}]}
    (tmp_path / "m.json").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"version_id": 2, "files": None}) + "\n")
    got = {r.version_id: (r.n_files, r.total_size) for r in repository.list_versions(spark, f"file://{tmp_path}/m.json").collect()}
    assert got == {1: (1, 3), 2: (0, 0)}
    assert [r.chunk for r in repository.manifest_refs(spark, f"file://{tmp_path}/m.json").orderBy("ordinal").collect()] == ["h1", "h2"]


def test_chunk_store_finds_damage(spark, tmp_path):
    data = spark.createDataFrame([(b"a",), (b"b",), (b"b",)], "data binary").withColumn("hash", F.sha2("data", 256))
    bad = spark.createDataFrame([("ff" * 32, b"other")], "hash string, data binary")
    repository.store_chunks(data.select("hash", "data").unionByName(bad), path := f"file://{tmp_path}/c")
    wanted = data.select("hash").unionByName(bad.select("hash")).unionByName(spark.createDataFrame([("00",)], "hash string"))
    got = sorted(r.verdict for r in repository.checked_chunks(spark, path, wanted).collect())
    assert got == ["mismatch", "missing", "pass", "pass"]


def test_upserts_and_inserts(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    more = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in control.upserted(rows, more.distinct(), "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert sorted(tuple(r) for r in control.inserted(rows, more, "k").collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert control.repeated_keys(more, "k").first().n == 2


def test_policy_rollback_appends_a_copy(spark):
    p = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 7, "z")], "policy string, version int, body string")
    assert {tuple(r) for r in control.next_version(p, "p", 1).collect()} - {tuple(r) for r in p.collect()} == {("p", 3, "x")}


def test_logs_metrics_and_rules(spark):
    lines = spark.createDataFrame([("ok  pkg",), ("FAIL pkg",), ("test result: ok. 3",), ("nok",)], "value string")
    assert control.test_counts(lines).first()[:] == (2, 1)
    row = spark.range(1).select(rules.decision(F.lit("?")), rules.throughput(F.lit(5), F.lit(0)), rules.clamped(F.lit(7.0)), rules.blocked(F.lit(None), F.lit(1)), rules.fixture_verdict(F.lit(""), F.lit(-1), F.lit(None), F.lit("x"), F.lit(False))).first()
    assert tuple(row) == (None, 0.0, 1.0, False, "bad_size")


@pytest.mark.parametrize("text", [b"", b"abc" * 100, None])
def test_crypto_round_trip(spark, text):
    df = spark.createDataFrame([(text,)], "d binary").withColumn("id", F.lit("ab" * 32))
    key, other = F.lit(b"k" * 32), F.lit(b"o" * 32)
    e = crypto.encrypted(F.col("d"), key, F.col("id"))
    row = df.select(crypto.decrypted(e, key).alias("a"), crypto.decrypted(e, other).alias("b"), crypto.decompressed(crypto.compressed("d")).alias("c")).first()
    assert (row.a, row.b, row.c) == (text, None, text)


def test_compressed_values_leave_before_the_batch_is_done():
    import pyarrow as pa

    turned = []
    parts = crypto._mapped(iter([pa.array([b"x" * (crypto.LEAVES_AT // 2), None] * 4 + [b"y"], pa.binary())]), lambda b: turned.append(1) or b.to_pybytes())
    first = next(parts)
    assert len(turned) == 2 and len(first) == 3
    assert [len(x.as_py() or b"") for x in [*first, *(y for p in parts for y in p)]] == [crypto.LEAVES_AT // 2, 0] * 4 + [1]


def test_crypto_round_trip_of_more_than_leaves_at_once(spark):
    df = spark.range(40, numPartitions=1).withColumn("d", F.when(F.col("id") % 7 != 3, F.repeat(F.concat(F.lit("ab"), "id"), 200_000)).cast("binary"))
    got = df.select("id", F.sha2("d", 256).alias("a"), F.sha2(crypto.decompressed(crypto.compressed("d")), 256).alias("b")).collect()
    assert len(got) == 40 and all(r.a == r.b and (r.a is None) == (r.id % 7 == 3) for r in got)


def test_round_trip_of_a_file_without_content(spark, tmp_path):
    from tidemark.plans import catalog

    spark.sql("SELECT * FROM VALUES (1L, 'one', 'en', 's'), (2L, NULL, 'en', 's'), (3L, '', 'en', 's') AS t(doc_id, text, lang, source)").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in catalog.chunk_round_trip(spark, str(tmp_path)).collect()) == [(f"s/en/{k}.txt", True, True, True) for k in (1, 2, 3)]


def test_scan_of_several_roots_with_rules(spark, tmp_path):
    for name in ("a/x.txt", "a/skip/y.txt", "b/z.txt", "b/z.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    roots = [f"file://{tmp_path}/{r}" for r in ("a", "b", "missing")]
    got = {r.path.rsplit("/", 1)[1] for r in repository.scan(spark, roots, include=[("glob", "*.txt")], exclude=[("glob", "*/skip/*")]).collect()}
    assert got == {"x.txt", "z.txt"} and repository.scan(spark, roots[2]).count() == 0


def test_chunks_are_removed_and_other_buckets_left_alone(spark, tmp_path):
    data = spark.createDataFrame([(f"d{k}".encode(),) for k in range(60)], "data binary").withColumn("hash", F.sha2("data", 256))
    repository.store_chunks(data.select("hash", "data"), path := f"file://{tmp_path}/c")
    hashes = sorted(r.hash for r in data.collect())
    before = {f.name for f in (tmp_path / "c").glob("bucket=*")}
    only = hashes[0]
    gone = repository.remove_chunks(spark, path, spark.createDataFrame([(only,), (hashes[30],), ("ff" * 32,)], "hash string"))
    assert {r.hash for r in gone.collect()} == {only, hashes[30]}
    assert sorted(r.hash for r in spark.read.parquet(path).select("hash").collect()) == sorted(set(hashes) - {only, hashes[30]})
    assert {f.name for f in (tmp_path / "c").glob("bucket=*")} <= before
    assert repository.remove_chunks(spark, path, spark.createDataFrame([("00",)], "hash string")).count() == 0


def test_versions_show_once_they_are_committed(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    manifest = spark.createDataFrame([(1, None, [("p", 3, 1, ["h1", "h2"])])], repository.MANIFEST)
    chunks = spark.createDataFrame([("h1",), ("h2",)], "chunk string")
    repository.stage_version(manifest, root, 1)
    repository.stage_version(manifest, root, 2)
    (tmp_path / "r/staging/2/_SUCCESS").unlink()
    assert not repository.commit_version(spark, root, 1, chunks.limit(1)) and repository.commit_version(spark, root, 1, chunks)
    assert [r.version_id for r in repository.list_versions(spark, f"{root}/versions/1").collect()] == [1]
    assert not repository.commit_version(spark, root, 2, chunks) and repository.clear_incomplete(spark, root) == [2] and repository.clear_incomplete(spark, root) == []
    assert repository.remove_object(spark, f"{root}/versions/1") and not repository.remove_object(spark, f"{root}/versions/1")


def test_conversion_there_and_back(spark):
    m = spark.createDataFrame([(1, None, [("p", 3, 1, ["h1", "h2"]), ("q", 0, 2, [])]), (2, None, None)], repository.MANIFEST)
    assert repository.from_compat(repository.to_compat(m)).collect() == m.collect()
    with pytest.raises(Exception, match="no version"):
        repository.from_compat(repository.to_compat(m).withColumn("version", F.lit("x"))).collect()


def test_collection(spark):
    index = spark.createDataFrame([("a", 0, 5, "gc_pending"), ("b", 0, 6, "gc_pending"), ("c", 0, 7, "active"), ("d", 2, 8, "gc_pending")], "hash string, ref_count long, stored_size long, status string")
    report = reconcile.gc_report(index, spark.createDataFrame([("a",), ("c",), ("d",)], "hash string"))
    assert {tuple(r) for r in report.collect()} == {("a", "purged", 5), ("b", "gone", 0), ("c", "skipped", 0)}
    assert {r.hash: r.status for r in reconcile.index_after_gc(index, report).collect()} == {"a": "purged", "b": "purged", "c": "active", "d": "gc_pending"}


def test_frames_cut_short_are_errors(spark):
    df = spark.createDataFrame([("{}",), ("",), (None,)], "m string").select("m", repository.framed_manifest(F.col("m")).alias("f"))
    assert [r.b for r in df.select(repository.unframed_manifest(F.concat("f", F.lit(b"x").cast("binary"))).alias("b")).collect()] == ["{}", "", None]
    with pytest.raises(Exception, match="cut short"):
        df.select(repository.unframed_manifest(F.substring("f", F.lit(1), F.octet_length("f") - 1))).collect()
