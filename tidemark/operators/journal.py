"""Event logs: what counts, what was done last, what is left to do, which steps were not allowed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The steps a version may take.
EDGES = (
    ("created", "writing"), ("writing", "verifying"), ("writing", "created"), ("verifying", "committing"), ("verifying", "writing"), ("committing", "sealed"),
    ("sealed", "expired"), ("sealed", "deleted"), ("expired", "deleted"), ("expired", "gc_pending"), ("deleted", "gc_pending"), ("gc_pending", "purged"),
)
#: What to do about an entry that was never committed.
ACTIONS = {"commit_step": "clean_staging", "gc_step": "rerun_gc", "verify_step": "mark_verify_incomplete", "state_transition": "continue_state_transition", "recovery": "skip"}


def framed(kind: Column, at_ms: Column, job: Column, payload: Column) -> Column:
    """A journal frame: kind (a byte), time (eight), job (16 bytes), length (four), payload, CRC-32 of all before it; all big-endian."""
    n = lambda c, digits: F.unhex(F.lpad(F.hex(c), digits, "0"))
    body = F.concat(n(kind, 2), n(at_ms, 16), job, n(F.octet_length(payload), 8), payload)
    return F.concat(body, n(F.crc32(body), 8))


HEAD = 29


def frames(logs: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """name, number, offset, kind, at_ms, job (hex), payload of the frames of each log up to its first bad or short one."""
    kind_of = logs.schema[name].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            for log, data in zip(pdf[name], pdf[content]):
                out, at = [], 0
                while data is not None and at + HEAD + 4 <= len(data):
                    size = int.from_bytes(data[at + 25 : at + 29], "big")
                    end = at + HEAD + size
                    if end + 4 > len(data) or zlib.crc32(data[at:end]) != int.from_bytes(data[end : end + 4], "big"):
                        break
                    out.append((log, len(out), at, data[at], int.from_bytes(data[at + 1 : at + 9], "big"), bytes(data[at + 9 : at + 25]).hex(), bytes(data[at + HEAD : end])))
                    at = end + 4
                if out:
                    yield pd.DataFrame(out, columns=[name, "number", "offset", "kind", "at_ms", "job", "payload"])

    return logs.select(name, content).mapInPandas(run, f"{name} {kind_of}, number long, offset long, kind int, at_ms long, job string, payload binary")


def valid_prefix(entries: DataFrame, log: str, offset: str, ok: str) -> DataFrame:
    """The entries of each log before its first bad one."""
    first_bad = entries.filter(~F.coalesce(F.col(ok), F.lit(False))).groupBy(log).agg(F.min(offset).alias("_bad"))
    return entries.join(first_bad, log, "left").filter(F.col("_bad").isNull() | (F.col(offset) < F.col("_bad"))).drop("_bad")


def with_crc(rows: DataFrame, payload: str, stated: str) -> DataFrame:
    return rows.withColumn("ok", F.crc32(F.col(payload)) == F.col(stated))


def rotated(entries: DataFrame, log: str, offset: str, size: str, most: int = 16 << 20) -> DataFrame:
    """entries with file, the number of the file of its log: a new one begins with the entry that finds most bytes before it."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(log).orderBy(offset).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("file", F.floor(before / most).cast("long"))


def last_checkpoint(entries: DataFrame, job: str, offset: str, kind: str, checkpoint: str, *facts: str) -> DataFrame:
    """The facts of the last checkpoint of each job."""
    last = F.max_by(F.struct(offset, *facts), F.col(offset)).alias("_l")
    return entries.filter(F.col(kind) == checkpoint).groupBy(job).agg(last).select(job, "_l.*")


def recovery_plan(entries: DataFrame) -> DataFrame:
    """job, kind, entries, action for the entries (job, kind, committed) that were never committed."""
    action = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))[F.col("kind")]
    return entries.filter(~F.coalesce("committed", F.lit(False))).groupBy("job", "kind").agg(F.count("*").alias("entries")).withColumn("action", action)


def to_resume(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is planned and not done yet."""
    return planned.join(done.select(key), key, "left_anti")


def violations(states: DataFrame, key: str, order: str, state: str, edges=EDGES) -> DataFrame:
    """key, order, from_state, to_state, fault of every step that isn't among the edges; staying is no step.

    fault: skip_verifying for a way to sealed that isn't from committing, else invalid_transition.
    """
    w = Window.partitionBy(key).orderBy(order)
    steps = states.withColumn("from_state", F.lag(state).over(w)).filter(F.col("from_state") != F.col(state))
    allowed = states.sparkSession.createDataFrame(list(edges), "from_state string, to_state string")
    steps = steps.select(key, order, "from_state", F.col(state).alias("to_state"))
    fault = F.when(F.col("to_state") == "sealed", "skip_verifying").otherwise("invalid_transition")
    return steps.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti").select(key, order, "from_state", "to_state", fault.alias("fault"))
