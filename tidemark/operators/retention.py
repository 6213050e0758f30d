"""Which versions a policy keeps. All take versions (version, job, ts) and add keep; as_of is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _rank(*partition: str | Column, newest: bool = True) -> Column:
    order = (F.desc("ts"), F.desc("version")) if newest else (F.asc("ts"), F.asc("version"))
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def days(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def months(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def keep_last(versions: DataFrame, n: int) -> DataFrame:
    return versions.withColumn("keep", _rank("job") <= n)


def keep_younger(versions: DataFrame, as_of: str, max_days: int) -> DataFrame:
    """Not older than max_days, that moment included."""
    return versions.withColumn("keep", F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(max_days)))


def gfs(versions: DataFrame, as_of: str, daily: int, weekly: int, monthly: int) -> DataFrame:
    """The newest of each of the last days, weeks (seven days counted from 1970-01-01) and months."""
    now = F.lit(as_of).cast("timestamp_ntz")
    rules = ((daily, days(F.col("ts")), days(now)), (weekly, F.floor(days(F.col("ts")) / 7), F.floor(days(now) / 7)), (monthly, months(F.col("ts")), months(now)))
    out, keep = versions, F.lit(False)
    for k, (n, bucket, here) in enumerate(rules):
        out = out.withColumn(f"_b{k}", bucket)
        keep = keep | ((F.col(f"_b{k}") > here - n) & (F.col(f"_r{k}") == 1))
    for k in range(3):
        out = out.withColumn(f"_r{k}", _rank("job", f"_b{k}"))
    return out.withColumn("keep", keep).drop(*(f"_{c}{k}" for c in "br" for k in range(3)))


def smart(versions: DataFrame, as_of: str, least: int, max_days: int) -> DataFrame:
    """The newest few, all that are young, and the first and last of every day."""
    day = days(F.col("ts"))
    young = F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(max_days))
    out = versions.withColumn("_d", day)
    return out.withColumn("keep", (_rank("job") <= least) | young | (_rank("job", "_d") == 1) | (_rank("job", "_d", newest=False) == 1)).drop("_d")


def retain(versions: DataFrame, policy: str, **options) -> DataFrame:
    """The policy by name: all, last, days, gfs, smart. A missing parameter is an error."""
    rules = {"all": lambda v: v.withColumn("keep", F.lit(True)), "last": keep_last, "days": keep_younger, "gfs": gfs, "smart": smart}
    if policy not in rules:
        raise ValueError(f"no policy {policy!r}")
    return rules[policy](versions, **options)


def partition_expiry(partitions: DataFrame, as_of: str, keep_days: Column | int = 7) -> DataFrame:
    """Log partitions (name, end_ts, archived) that are past their days and not archived."""
    end = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(keep_days) if isinstance(keep_days, int) else keep_days)
    return partitions.filter(~F.col("archived") & (F.col("end_ts") < end))


def partition_name(table: str, ts: Column) -> Column:
    """The name of the log partition that a moment belongs to."""
    return F.concat(F.lit(f"{table}_"), F.date_format(ts, "yyyyMMdd"))


def needed_partitions(rows: DataFrame, ts: str, table: str) -> DataFrame:
    """name, start_ts, end_ts of the daily partitions that rows need; the end is not included."""
    start = F.date_trunc("DAY", F.col(ts)).cast("timestamp_ntz")
    return rows.select(partition_name(table, F.col(ts)).alias("name"), start.alias("start_ts"), (start + F.make_dt_interval(F.lit(1))).alias("end_ts")).filter("name is not null").distinct()


def split(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions to keep and versions to delete: disjoint, and all of them together."""
    return versions.filter("keep"), versions.filter("NOT keep")
