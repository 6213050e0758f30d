"""Fleet figures: counts, rates, alerts, stability, health, queues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import stale
from ..functions.text import compares


def share(part: Column, whole: Column, empty: float) -> Column:
    return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(empty)), 6)


def dashboard(devices: DataFrame, jobs: DataFrame, versions: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row. devices (online), jobs (active), versions (size), alerts (open); one pass over each table."""
    d = devices.agg(F.count("*").alias("devices"), F.count_if("online").alias("devices_online"))
    j = jobs.agg(F.count("*").alias("jobs"), F.count_if("active").alias("jobs_active"))
    v = versions.agg(F.count("*").alias("versions"), F.round(F.coalesce(F.sum("size"), F.lit(0.0)), 2).alias("stored"))
    return d.crossJoin(j).crossJoin(v).crossJoin(alerts.agg(F.count_if("open").alias("open_alerts")))


def histogram(rows: DataFrame, by: str, state: str, states: list[str]) -> DataFrame:
    """by and a count column for each state."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(state) == s).alias(f"n_{s.lower()}") for s in states))


def success_rate(rows: DataFrame, state: str, good: str) -> DataFrame:
    """total, success, rate; 1 without rows."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col(state) == good).alias("success")).withColumn("rate", share(F.col("success"), F.col("total"), 1.0))


def pass_grid(rows: DataFrame, a: str, b: str, passed: Column) -> DataFrame:
    """a, b, total, passed, rate for each cell that any a and any b span, 0 where empty, with totals (null) of rows, columns and all."""
    facts = rows.select(a, b, passed.alias("_p"))
    cells = facts.cube(a, b).agg(F.count("*").alias("total"), F.count_if("_p").alias("passed"), F.grouping_id().alias("_g"))
    grid = cells.filter("_g = 1").select(a).join(cells.filter("_g = 2").select(b))
    inner = grid.join(cells.filter("_g = 0"), [a, b], "left").select(a, b, "total", "passed")
    every = inner.unionByName(cells.filter("_g > 0").select(a, b, "total", "passed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return every.select(a, b, zero(F.col("total")).alias("total"), zero(F.col("passed")).alias("passed"), share(F.col("passed"), F.col("total"), 0.0).alias("rate"))


def acceptance(lines: DataFrame) -> DataFrame:
    """lines (line, total, passed) with status (pending without entries, pass, fail), rate, signable (do all lines pass) and failing, the lines that don't."""
    status = F.when(F.col("total") == 0, "pending").when(F.col("passed") == F.col("total"), "pass").otherwise("fail")
    rows = lines.withColumns({"status": status, "rate": share(F.col("passed"), F.col("total"), 0.0)})
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != "pass", F.col("line")))), ",")
    return rows.crossJoin(rows.agg(F.coalesce(F.bool_and(F.col("status") == "pass"), F.lit(True)).alias("signable"), names.alias("failing")))


def coverage(catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """One row from features and their states (feature, state): implemented, partial, missing, coverage."""
    state = F.coalesce("state", F.lit("not_implemented"))
    rows = catalog.join(registry, "feature", "left")
    return rows.agg(F.count_if(state == "implemented").alias("implemented"), F.count_if(state == "partial").alias("partial"), F.count_if(~state.isin("implemented", "partial")).alias("missing"), F.count("*").alias("total")).withColumn("coverage", share(F.col("implemented"), F.col("total"), 0.0))


def alert_matches(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, severity, device, metric, ts, id, value of samples that fit an enabled rule (rule, severity, metric, op, threshold, enabled).

    An equi-join on metric with the comparison beside it; Spark broadcasts the rules if they are small.
    """
    live = rules.filter("enabled").select("rule", "severity", "metric", "op", "threshold", "suppress_s")
    return samples.join(live, "metric").filter(compares(F.col("op"), F.col("value"), F.col("threshold"))).select("rule", "severity", "device", "metric", "ts", "id", "value", "suppress_s")


def folded(rows: DataFrame, keys: list[str], order: list[str], schema: str, step: Callable[[tuple, pa.RecordBatch, object], tuple[pa.RecordBatch | None, object]]) -> DataFrame:
    """rows by key in order, a stretch at a time: step(key, stretch, state) gives what comes out and the state for the key's next stretch.

    state is None at a key's start. A key may have any number of rows: tasks hold a batch and a state.
    What comes out of a batch leaves as one batch, as keys with few rows are many.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(k) for k in keys]
            new = np.zeros(len(batch), bool)
            for c in columns:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            cuts, parts = np.concatenate([[0], np.flatnonzero(new), [len(batch)]]), []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                key = tuple(c[a].as_py() for c in columns)
                state = state if key == last else None
                out, state = step(key, batch.slice(a, b - a), state)
                last = key
                if out is not None:
                    parts.append(out)
            if parts:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return rows.select(names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fired(matches: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """rule, device, ts of the matches that fire: the first, and each first one suppress_s or more after the last that fired.

    The time of the last one fired is all that a (rule, device) carries on; any number of matches will do.
    before has such times of earlier matches (rule, device, ts), one for each (rule, device) at most.
    """

    def step(key: tuple, part: pa.RecordBatch, last: int | None) -> tuple[pa.RecordBatch | None, int | None]:
        times, gap = part.column("us").to_numpy(), int(part.column("suppress_s")[len(part) - 1].as_py()) * 1_000_000
        if not part.column("fresh")[0].as_py():
            last, times = int(times[0]), times[1:]
        at, hits = (0 if last is None else int(np.searchsorted(times, last + gap))), []
        while at < len(times):
            hits.append(at)
            at = max(at + 1, int(np.searchsorted(times, times[at] + gap)))
        if not hits:
            return None, last
        us = times[hits]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(us), pa.string()), pa.array([key[1]] * len(us), pa.int64()), pa.array(us, pa.int64())], names=["rule", "device", "us"]), int(us[-1])

    slim = lambda df, gap, fresh: df.select("rule", F.col("device").cast("long").alias("device"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), gap.cast("long").alias("suppress_s"), F.lit(fresh).alias("fresh"))
    rows = slim(matches.filter("ts IS NOT NULL"), F.col("suppress_s"), True)
    if before is not None:
        rows = rows.unionByName(slim(before, F.lit(0), False))
    out = folded(rows, ["rule", "device"], ["fresh", "us"], "rule string, device long, us long", step)
    return out.select("rule", "device", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))


def alert_states(fires: DataFrame, resolved: DataFrame) -> DataFrame:
    """rule, device, fires, last_fire, state: active, or resolved if a resolution (rule, device, ts) came at or after the last fire."""
    f = fires.groupBy("rule", "device").agg(F.count("*").alias("fires"), F.max("ts").alias("last_fire"))
    r = resolved.groupBy("rule", "device").agg(F.max("ts").alias("_r"))
    return f.join(r, ["rule", "device"], "left").select("rule", "device", "fires", "last_fire", F.when(F.col("_r") >= F.col("last_fire"), "resolved").otherwise("active").alias("state"))


def slopes(samples: DataFrame, value: Column) -> DataFrame:
    """device, metric, n, slope of value over the number of the sample (0 for fewer than two).

    A slope below zero that rounds to zero stays -0.0, as in SQL engines that round doubles in place.
    """
    at = F.row_number().over(Window.partitionBy("device", "metric").orderBy("ts", "id")) - 1
    rows = samples.withColumns({"_x": at.cast("double"), "_y": value})
    per = rows.groupBy("device", "metric").agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("_y", "_x"), F.lit(0.0)).alias("_s"))
    return per.select("device", "metric", "n", F.when(F.col("_s") < 0, -F.round(-F.col("_s"), 8)).otherwise(F.round("_s", 8)).alias("slope"))


def stability(samples: DataFrame, limits: DataFrame) -> DataFrame:
    """device, metric, verdict: not_tested below two samples, fail above the metric's limit (metric, most), else pass."""
    verdict = F.when(F.col("n") < 2, "not_tested").when(F.col("slope") > F.coalesce("most", F.lit(float("inf"))), "fail").otherwise("pass")
    return slopes(samples, F.col("value")).join(limits, "metric", "left").select("device", "metric", "n", "slope", verdict.alias("verdict"))


#: Slopes a sample, bytes a sample and lost heartbeats above which a metric fails.
LIMITS = {"memory_leak": 1e3, "handle_leak": 1.0, "cpu_drift": 0.1, "connection_leak": 0.5}
DISK_PER_SAMPLE, HEARTBEAT_LOSS = 100 * 1024 * 1024, 0.01


def soak_verdicts(samples: DataFrame) -> DataFrame:
    """device, metric, n, measured, verdict of the seven metrics of a soak run.

    samples: device, ts, id, rss, handles, cpu, connections, disk_bytes, heartbeat_ok. Slopes over the
    number of the sample; disk by last less first; heartbeats by the share lost; zombies always pass.
    Fewer than two samples (for heartbeats: none) aren't tested.
    """
    at = F.row_number().over(Window.partitionBy("device").orderBy("ts", "id")) - 1
    slope = lambda c: F.coalesce(F.regr_slope(F.col(c).cast("double"), "_x"), F.lit(0.0))
    order = F.struct("ts", "id")
    per = samples.withColumn("_x", at.cast("double")).groupBy("device").agg(
        F.count("*").alias("n"), slope("rss").alias("memory_leak"), slope("handles").alias("handle_leak"), slope("cpu").alias("cpu_drift"), slope("connections").alias("connection_leak"),
        (F.max_by("disk_bytes", order) - F.min_by("disk_bytes", order)).cast("double").alias("disk_growth"), (F.count_if(~F.col("heartbeat_ok")) / F.count("*")).alias("heartbeat_stability"),
        F.lit(0.0).alias("zombie_process"),
    )
    names = (*LIMITS, "disk_growth", "heartbeat_stability", "zombie_process")
    rows = per.select("device", "n", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("measured")) for m in names))).alias("m")).select("device", "n", "m.*")
    limit = F.create_map(*(F.lit(x) for pair in LIMITS.items() for x in pair))[F.col("metric")]
    bad = F.when(F.col("metric") == "disk_growth", F.col("measured") > F.col("n") * F.lit(float(DISK_PER_SAMPLE))).when(F.col("metric") == "heartbeat_stability", F.col("measured") > HEARTBEAT_LOSS).otherwise(F.col("measured") > limit)
    untested = (F.col("n") < 2) & ~F.col("metric").isin("heartbeat_stability", "zombie_process")
    verdict = F.when(untested, "not_tested").when(F.coalesce(bad, F.lit(False)), "fail").otherwise("pass")
    return rows.select("device", "metric", "n", F.round("measured", 6).alias("measured"), verdict.alias("verdict"))


def overall(verdicts: DataFrame) -> DataFrame:
    """device, all_passed (not tested isn't passed), any_failed."""
    return verdicts.groupBy("device").agg(F.bool_and(F.col("verdict") == "pass").alias("all_passed"), F.bool_or(F.col("verdict") == "fail").alias("any_failed"))


def sliding(samples: DataFrame, rows: int, seconds: int) -> DataFrame:
    """samples with peak and mean of the last rows samples of the device that are no older than seconds."""
    w = Window.partitionBy("device").orderBy("ts", "id").rowsBetween(-(rows - 1), 0)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    recent = F.filter(F.collect_list(F.struct(at.alias("t"), F.col("value").alias("v"))).over(w), lambda s: s["t"] >= at - F.lit(seconds * 1_000_000))
    values = F.transform(recent, lambda s: s["v"])
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    return samples.withColumns({"peak": F.round(F.array_max(values), 4), "mean": F.round(mean, 8)})


def growth(samples: DataFrame) -> DataFrame:
    """device, first, last, grown between the first and the last sample."""
    order = F.struct("ts", "id")
    out = samples.groupBy("device").agg(F.round(F.min_by("value", order), 4).alias("first"), F.round(F.max_by("value", order), 4).alias("last"))
    return out.withColumn("grown", F.round(F.col("last") - F.col("first"), 4))


def timeouts(samples: DataFrame, as_of: str, seconds: int = 90, known: DataFrame | None = None) -> DataFrame:
    """device, last_seen, state. Only a device that is online (known: device, status; else all are) goes offline, more than so many seconds after its last sample."""
    return timed_out(samples.groupBy("device").agg(F.max("ts").alias("last_seen")), as_of, seconds, known)


def timed_out(last: DataFrame, as_of: str, seconds: int = 90, known: DataFrame | None = None) -> DataFrame:
    """timeouts() from what is known of each device (device, last_seen)."""
    status = F.lit("online")
    if known is not None:
        last, status = last.join(known.select("device", "status"), "device", "left"), F.coalesce("status", F.lit("online"))
    late = F.col("last_seen") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds))
    return last.select("device", "last_seen", F.when(status != "online", status).when(late, "offline").otherwise("online").alias("state"))


def peer_failures(peers: DataFrame, missing_replicas: Column, as_of: str, seconds: int = 30) -> DataFrame:
    """node, failure: unreachable peers (node, last_heartbeat), and 'unknown' with insufficient_replicas where some are missing."""
    lost = peers.filter(stale(F.col("last_heartbeat"), F.lit(as_of).cast("timestamp_ntz"), seconds)).select("node", F.lit("node_unreachable").alias("failure"))
    few = peers.sparkSession.range(1).filter(missing_replicas > 0).select(F.lit("unknown").alias("node"), F.lit("insufficient_replicas").alias("failure"))
    return few.unionByName(lost)


def in_group(devices: DataFrame, group: str) -> DataFrame:
    return devices.filter(F.col("group_id") == group)


def pending_policy(devices: DataFrame) -> DataFrame:
    return devices.filter(F.coalesce("pending_policy", F.lit("")) != "")


def incomplete_verdicts(verdicts: DataFrame, gap: Column) -> DataFrame:
    """id, lacks of the verdicts that lack something: gap from rules.verdict_gap()."""
    return verdicts.withColumn("lacks", gap).filter("lacks is not null").select("id", "lacks")


def golden_totals(fixtures: DataFrame) -> DataFrame:
    """One row from fixtures (ordinal, type, size, deleted): fixtures, types in the order they come first, bytes without the deleted."""
    types = fixtures.groupBy("type").agg(F.min("ordinal").alias("o")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "type"))), lambda t: t["type"]), ",").alias("types"))
    total = fixtures.agg(F.count("*").alias("fixtures"), F.coalesce(F.sum(F.when(~F.col("deleted"), F.col("size"))), F.lit(0)).cast("long").alias("bytes"))
    return total.crossJoin(types)


def materialisable(fixtures: DataFrame, most: int = 255) -> DataFrame:
    """The fixtures (path, deleted) that can be written as files: not deleted, base names of most bytes."""
    return fixtures.filter(~F.col("deleted") & (F.octet_length(F.element_at(F.split("path", "/"), -1)) <= most))


def restore_summary(files: DataFrame, verified: bool) -> DataFrame:
    """One row over the files (size) that a selection restores."""
    return files.agg(F.count("*").alias("files_restored"), F.lit(0).cast("long").alias("files_failed"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes_restored"), F.lit(verified).alias("all_verified"))


def directory_sizes(files: DataFrame, levels: Column) -> DataFrame:
    """folder, files, bytes of everything below each folder. levels: the folders above a file."""
    return files.select(F.explode(levels).alias("folder"), "size").groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def health(nodes: DataFrame) -> DataFrame:
    """node, level from nodes (node, disk_used, journal_ok, last_ok, total, failures): the worst of its findings."""
    findings = F.array(
        F.when(F.col("disk_used") > 90, 2).when(F.col("disk_used") > 80, 1).otherwise(0),
        F.when(~F.col("journal_ok"), 2).otherwise(0),
        F.when(~F.col("last_ok"), 1).otherwise(0),
        F.when(F.col("failures") > F.floor(F.col("total") / 10), 1).otherwise(0),
    )
    return nodes.select("node", F.element_at(F.array(F.lit("healthy"), F.lit("warning"), F.lit("critical")), F.array_max(findings) + 1).alias("level"))


def newest(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The n last rows (100 if n is None) by the given columns, which should end with a key."""
    n = 100 if n is None else n
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def claimed(tasks: DataFrame, most: int) -> DataFrame:
    """The oldest tasks (task, agent, created) of each agent, most of them at once."""
    return tasks.withColumn("_n", F.row_number().over(Window.partitionBy("agent").orderBy("created", "task"))).filter(F.col("_n") <= most).drop("_n")


def claimable(tasks: DataFrame, agent: int | str, most: int = 5) -> DataFrame:
    """The oldest tasks (task, agent, created) that an agent may claim: its own and those of nobody."""
    return tasks.filter((F.col("agent") == agent) | F.col("agent").isNull()).orderBy("created", "task").limit(most)


def queue(tasks: DataFrame, cap: int) -> DataFrame:
    """The tasks (task, job, priority, created) that run now: one a job, by priority and then age, cap at most; place from 1."""
    first = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("priority"), "created", "task"))
    ready = tasks.withColumn("_f", first).filter("_f = 1").drop("_f").orderBy(F.desc("priority"), "created", "task").limit(cap)  # cap rows meet below
    return ready.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "created", "task")))


def adjudicated(results: DataFrame) -> DataFrame:
    """results (case, by_design, reference_ok, ours_ok, same_digest) with verdict, the first rule that fits."""
    verdict = (
        F.when(F.col("by_design"), "by_design").when(~F.col("reference_ok") & ~F.col("ours_ok"), "not_supported")
        .when(F.col("reference_ok") & ~F.col("ours_ok"), "fail").when(~F.col("same_digest"), "fail").otherwise("pass")
    )
    return results.withColumn("verdict", verdict)


def recovery_times(faults: DataFrame, rto_s: int, rpo_s: int) -> DataFrame:
    """One row from (fault_at, recovered_at, last_data_at): the largest times in seconds and whether targets are met; a target of 0 is."""
    gap = lambda a, b: F.max((F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / 1_000_000)
    met = lambda c, t: F.lit(True) if t == 0 else F.coalesce(F.col(c) <= t, F.lit(True))
    return faults.agg(gap("recovered_at", "fault_at").alias("max_rto_s"), gap("fault_at", "last_data_at").alias("max_rpo_s")).withColumns({"rto_met": met("max_rto_s", rto_s), "rpo_met": met("max_rpo_s", rpo_s)})


def metric_lines(metrics: DataFrame) -> DataFrame:
    """Exposition text of metrics (name, help, kind, labels map, value), one row a name: HELP and TYPE lines and a line for each set of labels."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    line = F.concat("name", F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    top = F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), F.min("help"), F.lit("\n# TYPE "), F.col("name"), F.lit(" "), F.col("kind"), F.lit("\n"))
    return metrics.groupBy("name", "kind").agg(F.concat(top, lines).alias("text"))
