"""Every registered query against its SQL on the smallest tables; the others against their batch twins."""

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, rows
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalog.ORACLE_SQL[name]).df())


def test_sessions_are_disjoint(spark):
    out = catalog.stream_sessions(spark, SF).toPandas().sort_values(["device", "start"])
    later = out.groupby("device")["start"].shift(-1)
    assert ((later > out["end"]) | later.isna()).all()


@pytest.fixture(scope="module")
def in_parts(spark, tmp_path_factory):
    """Events as a folder of more part files than one trigger takes, out of order."""
    d = str(tmp_path_factory.mktemp("parts"))
    spark.read.parquet(f"{SF}/events.parquet").repartition(10, "event_id").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["stream_windows", "stream_sessions"])
def test_streams_return_all_that_a_batch_does(spark, in_parts, name):
    from tidemark.sources import views
    from tidemark.streaming import jobs

    batch = views.samples(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    want = jobs.windows(batch, late=None) if name == "stream_windows" else jobs.sessions(batch, "1 day", late=None)
    want = rows(catalog._plain(want, *(c for c in ("start", "end") if c in want.columns)).toPandas())
    for d in (SF, in_parts):
        assert rows(catalog.QUERIES[name](spark, d).toPandas()) == want


def test_alerts_read_a_folder_of_part_files(spark, in_parts):
    assert catalog.stream_alerts(spark, in_parts).count() > 0


def test_alerts_are_whole_however_files_overlap_in_time(spark, con, in_parts):
    assert rows(catalog.stream_alerts(spark, in_parts).toPandas()) == rows(con.execute(catalog.ORACLE_SQL["stream_alerts"]).df())


def test_alerts_carry_the_last_fired_from_batch_to_batch(spark, con, tmp_path):
    import os

    import pyarrow.parquet as pq

    from tidemark.operators import fleet
    from tidemark.streaming import jobs

    events = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    (tmp_path / "events.parquet").mkdir()
    for k in range(4):
        name = str(tmp_path / f"events.parquet/{k}.parquet")
        pq.write_table(events.slice(k * len(events) // 4, (k + 1) * len(events) // 4 - k * len(events) // 4), name)
        os.utime(name, (1e9 + 60 * k, 1e9 + 60 * k))
    table = spark.createDataFrame(catalog.RULES, "rule string, severity string, metric string, op string, threshold double, enabled boolean, suppress_s int")
    matches = fleet.alert_matches(jobs.samples(spark, str(tmp_path), 1), table).select("rule", "device", "ts", "suppress_s")
    out, log = f"file://{tmp_path}/out", f"file://{tmp_path}/log"
    for _ in range(2):  # a second start finds nothing new
        jobs.suppressed(matches, out, log).awaitTermination()
    got = spark.read.parquet(out)
    assert got.agg(F.countDistinct("batch")).first()[0] == 4 and sorted(os.listdir(tmp_path / "log/last"))[-2:] == ["2", "3"]
    assert rows(got.select("rule", "device", "ts").toPandas()) == rows(con.execute(catalog.ORACLE_SQL["stream_alerts"]).df())


def test_matches_without_a_time_never_fire(spark):
    from tidemark.operators import fleet

    asks = spark.sql("SELECT * FROM VALUES ('r', 1L, NULL, 60), ('r', 1L, TIMESTAMP_NTZ '2024-01-01 00:00:00', 60), ('r', 2L, NULL, 60) AS t(rule, device, ts, suppress_s)")
    assert [(r.device, str(r.ts)) for r in fleet.fired(asks).collect()] == [(1, "2024-01-01 00:00:00")]


def test_contents_defined_chunks_cover_each_file(spark):
    from tidemark.sources import views

    sizes = {r.path: r.size for r in views.files(spark, SF).collect()}
    got = catalog.chunk_cdc(spark, SF).toPandas().sort_values(["path", "ordinal"])
    assert got.groupby("path").chunk_bytes.sum().to_dict() == {k: n for k, n in sizes.items() if n}
    assert (got.groupby("path").chunk_bytes.cumsum() - got.chunk_bytes == got.offset).all() and got.chunk_bytes.max() <= 4096


def test_token_bucket_against_a_loop(spark):
    from tidemark.streaming import jobs

    asks = [(1, 0, 3.0, 1), (1, 1, 2.0, 2), (1, 2, 9.0, 3), (1, 9, 4.0, 4), (2, 5, 1.0, 5)]
    got = {r.id: (r.granted, r.infeasible) for r in jobs.token_bucket(spark.createDataFrame(asks, "source long, at_s long, amount double, id long"), 2.0).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (True, False), 5: (True, False)}
