"""Streams of samples (id, device, metric, ts, value): windows, sessions, suppressed alerts, timeouts, rate limits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redact
from ..operators.fleet import fired, folded
from ..shared import removed

SAMPLE = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def samples(spark: SparkSession, folder: str, files_per_trigger: int | None = 8, table: str = "events.parquet") -> DataFrame:
    """A stream of the table in folder, a file or a folder of part files, files_per_trigger in a batch at most; None: all that is there."""
    reader = spark.readStream.schema(SAMPLE)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern, since Spark takes a plain path for a folder
    raw = reader.parquet(f"{folder}/{table[:-1]}[{table[-1]}]")
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("device"), F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _marked(stream: DataFrame, late: str | None) -> DataFrame:
    return stream if late is None else stream.withWatermark("ts", late)


def windows(stream: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Peak, mean and count by metric in sliding windows; rows later than the watermark are dropped, none if late is None."""
    out = _marked(stream, late).groupBy(F.window("ts", size, slide), "metric").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("peak"), F.round(F.avg("value"), 4).alias("mean"))
    return out.select(F.col("window.start").alias("start"), "metric", "n", "peak", "mean")


def sessions(stream: DataFrame, gap: str = "90 seconds", late: str | None = "10 minutes") -> DataFrame:
    """Runs of a device's samples with no gap longer than gap: what lies between is time offline."""
    out = _marked(stream, late).groupBy(F.session_window("ts", gap), "device").agg(F.count("*").alias("n"))
    return out.select("device", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def last_seen(stream: DataFrame) -> DataFrame:
    """device, last_seen: one time a device as state; what is offline at a moment follows from it (fleet.timed_out)."""
    return stream.groupBy("device").agg(F.max("ts").alias("last_seen"))


def new_only(stream: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that is there now, written with Spark's own exactly-once file sink."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def replayed(stream: DataFrame, path: str, checkpoint: str):
    """All groups of an aggregation without watermark over all that is there now, those still open at the end included.

    Each batch replaces the result, so path holds the last one; state is one row a group.
    """
    stream.sparkSession.createDataFrame([], stream.schema).write.parquet(path)
    put = lambda rows, _: rows.write.mode("overwrite").parquet(path)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def suppressed(matches: DataFrame, path: str, checkpoint: str):
    """rule, device, ts of matches (rule, device, ts, suppress_s) that fire, of all that is there now, with the last one fired as state.

    Within a batch matches may come in any order and number, and none is dropped as late; one that comes
    batches after a later one doesn't fire before it. State is one time a (rule, device), a table for each
    batch, so a batch that is run again gives the same.
    """
    kind = "rule string, device long, ts timestamp_ntz"
    for first in (f"{path}/batch=-1", f"{checkpoint}/last/-1"):
        matches.sparkSession.createDataFrame([], kind).write.mode("ignore").parquet(first)

    def put(rows: DataFrame, batch: int) -> None:
        read = rows.sparkSession.read.schema(kind).parquet
        last = read(f"{checkpoint}/last/{batch - 1}")
        fired(rows, last).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        new = last.unionByName(read(f"{path}/batch={batch}")).groupBy("rule", "device").agg(F.max("ts").alias("ts"))
        new.write.mode("overwrite").parquet(f"{checkpoint}/last/{batch}")
        removed(rows.sparkSession, f"{checkpoint}/last/{batch - 2}")

    return matches.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(stream: DataFrame) -> DataFrame:
    """Log rows (id, device, level, message, fields) with secrets masked before they reach a sink; fields are kept."""
    return stream.withColumns({"message": redact.redacted(F.col("message")), "fields": redact.redacted_fields(F.col("fields"))})


def token_bucket(requests: DataFrame, rate: float) -> DataFrame:
    """requests (source, at_s, amount, id) with granted and infeasible (above the capacity of 2 * rate); rate 0 grants all.

    Each source replays its requests in order of time and id; the tokens left and the last moment are
    all that it carries on.
    """
    if rate == 0:
        return requests.select("source", "id", F.lit(True).alias("granted"), F.lit(False).alias("infeasible"))
    cap = 2.0 * rate

    def step(key: tuple, part: pa.RecordBatch, state: tuple[float, float] | None) -> tuple[pa.RecordBatch, tuple[float, float]]:
        at, amount = part.column("at_s").to_pylist(), part.column("amount").to_pylist()
        tokens, last = state or (cap, at[0])
        granted = []
        for t, a in zip(at, amount):
            tokens, last = min(tokens + rate * (t - last), cap), t
            granted.append(a <= tokens)
            tokens -= a if granted[-1] else 0.0
        out = [part.column("source"), part.column("id"), pa.array(granted, pa.bool_()), pa.array([a > cap for a in amount], pa.bool_())]
        return pa.RecordBatch.from_arrays(out, names=["source", "id", "granted", "infeasible"]), (tokens, last)

    rows = requests.select("source", "id", F.col("at_s").cast("double").alias("at_s"), F.col("amount").cast("double").alias("amount"))
    kinds = dict(rows.dtypes)
    return folded(rows, ["source"], ["at_s", "id"], f"source {kinds['source']}, id {kinds['id']}, granted boolean, infeasible boolean", step)
