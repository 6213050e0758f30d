"""Physical plans: what is read, where Python runs."""

import re

import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
PYTHON = {"chunk_cdc", "chunk_round_trip", "stream_alerts", "alert_suppressed", "rate_limit_replay", "journal_frames", "redact_json"}
#: Written by a stream before the frame is returned.
STREAMS = {"stream_alerts", "stream_windows", "stream_sessions", "log_ingest", "stream_heartbeats"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMS))
def test_python_only_where_it_must_run(spark, name):
    assert bool(re.search("Python|Pandas|Arrow", plan(catalog.QUERIES[name](spark, SF)))) == (name in PYTHON)


def test_scans_read_what_is_asked_for(spark):
    text = plan(catalog.gc_candidates(spark, SF))
    assert "l_extendedprice" not in "".join(re.findall(r"ReadSchema: struct<[^>]*>", plan(catalog.status_histogram(spark, SF)))) and "p_name" not in text
    scan = next(x for x in plan(catalog.claim_tasks(spark, SF)).split("\n") if "FileScan" in x)
    assert "EqualTo(o_orderstatus,P)" in scan and "o_totalprice" not in scan


def test_placement_shuffles_nothing(spark):
    text = plan(catalog.QUERIES["replica_placement"](spark, SF))
    assert "hashpartitioning" not in text and "Window" not in text


@pytest.mark.parametrize("name", ["orphan_chunks", "gc_candidates"])
def test_references_are_distinct_before_they_meet_chunks(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[(l_partkey|chunk)#\d+L?\]", text) and "Join Inner" not in text


@pytest.mark.parametrize("name", ["refs_set_equality", "manifest_conversion"])
def test_both_sides_come_from_one_aggregate(spark, name):
    assert "Join" not in plan(catalog.QUERIES[name](spark, SF))


def test_set_equality_with_nulls_and_repeated_pairs(spark):
    from tidemark.operators import reconcile

    kind = "g long, i long"
    left, right = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, None), (None, 5)], kind), spark.createDataFrame([(1, 1), (2, None), (None, 5), (3, 7)], kind)
    got = {r.g: (r.only_left, r.only_right, r.equal) for r in reconcile.set_equality(left, right, "g", "i").collect()}
    assert got == {1: (1, 0, False), 2: (1, 1, False), 3: (0, 1, False), None: (1, 1, False)}


def test_hash_levels_number_references_once(spark):
    assert catalog.QUERIES["hash_levels"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_cron_days_are_made_for_each_day_and_not_for_each_row(spark):
    assert "BroadcastHashJoin" in plan(catalog.cron_next(spark, SF))


def test_cuts_follow_the_rolling_sum_from_the_start_of_each_search():
    import random

    from tidemark.operators import chunking

    def slow(data, least, bits, most):
        out, at = [], 0
        while len(data) - at > least:
            h, end = 0, min(len(data), at + most)
            cut = end
            for p in range(at + least, end):
                h = (2 * h + data[p]) % 2**64
                if h % 2**bits == 0:
                    cut = p + 1
                    break
            out.append(cut)
            at = cut
        return out + [len(data)] * (at < len(data))

    rnd = random.Random(4)
    for k in range(300):
        data = bytes(rnd.choice([0, 1, 32, 64, 128, rnd.randrange(256)]) for _ in range(rnd.randrange(3000)))
        args = rnd.choice([(256, 10, 4096), (16, 4, 64), (1, 0, 5), (5, 1, 40), (10, 6, 10), (3, 20, 500), (2, 8, 2000)])
        assert chunking.gear_cuts(data, *args) == slow(data, *args)
