"""When a job runs next. All take columns of a schedule and the moment `now` (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_run(mode: Column, now: Column, *, seconds: Column, hour: Column, minute: Column, weekday: Column, day: Column) -> Column:
    """manual: null; interval: now + seconds; daily, weekly (0 is Sunday), monthly: the first such moment after now.

    A monthly run whose day the month lacks is null: no other day takes its place.
    """
    midnight = F.date_trunc("DAY", now).cast("timestamp_ntz")
    at = midnight + F.make_dt_interval(hours=hour, mins=minute)
    one = lambda n: F.make_dt_interval(days=F.lit(n) if isinstance(n, int) else n)
    daily = F.when(at > now, at).otherwise(at + one(1))
    ahead = F.pmod(weekday - (F.dayofweek(now) - 1), F.lit(7))
    weekly_at = at + one(ahead)
    weekly = F.when(weekly_at > now, weekly_at).otherwise(weekly_at + one(7))
    first = F.date_trunc("MONTH", now).cast("timestamp_ntz")

    def in_month(start: Column) -> Column:
        moment = start + F.make_dt_interval(days=day - 1, hours=hour, mins=minute)
        return F.when(F.month(moment) == F.month(start), moment)

    this, after = in_month(first), in_month((first + F.make_ym_interval(months=F.lit(1))).cast("timestamp_ntz"))
    monthly = F.when(this.isNotNull() & (this > now), this).when(this.isNull(), F.lit(None)).otherwise(after)
    return F.when(mode == "interval", now + F.make_dt_interval(secs=seconds)).when(mode == "daily", daily).when(mode == "weekly", weekly).when(mode == "monthly", monthly)


def cron_field(text: str, low: int, high: int) -> list[int]:
    """The values of one field: *, */n, lists and ranges."""
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, b = (low, high) if span == "*" else (int(x) for x in (span.split("-") if "-" in span else (span, span)))
        if not low <= a <= b <= high or step and int(step) < 1:
            raise ValueError(f"{part!r} isn't within {low} and {high}")
        out.update(range(a, b + 1, int(step or 1)))
    return sorted(out)


def cron_next(rows: DataFrame, expression: str, now: str, name: str = "next_run", days: int = 366) -> DataFrame:
    """rows with the first minute after the column now that fits expression, null if none does in so many days.

    Day of month and day of week must both fit. The next two days that fit are looked up for each
    distinct day of now, so the calendar bounds that table, which is broadcast; a row takes a time of
    the first of them that is still ahead, else the first time of the second.
    """
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("minute, hour, day, month, weekday")
    minutes, hours, dom, months, dow = (cron_field(f, a, b) for f, (a, b) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))))
    start = F.date_trunc("DAY", F.col(now)).cast("timestamp_ntz")
    every = F.transform(F.sequence(F.lit(0), F.lit(days)), lambda d: F.col("_day") + F.make_dt_interval(days=d))
    fit = F.filter(every, lambda d: F.dayofmonth(d).isin(dom) & F.month(d).isin(months) & (F.dayofweek(d) - 1).isin(dow))
    calendar = rows.select(start.alias("_day")).distinct().select("_day", F.slice(fit, 1, 2).alias("_fit")).select("_day", F.get("_fit", F.lit(0)).alias("_first"), F.get("_fit", F.lit(1)).alias("_second"))
    times = sorted(h * 60 + m for h in hours for m in minutes)
    after = F.array(*(F.lit(next((t for t in times if t > m), None)).cast("int") for m in range(24 * 60)))
    today = F.get(after, F.hour(now) * 60 + F.minute(now))
    moment = lambda d, t: d + F.make_dt_interval(mins=t)
    first = F.when(F.col("_first") == F.col("_day"), moment(F.col("_first"), today)).otherwise(moment(F.col("_first"), F.lit(times[0])))
    found = F.coalesce(first, moment(F.col("_second"), F.lit(times[0])))
    end = F.col(now) + F.make_dt_interval(F.lit(days))
    return rows.withColumn("_at", start).join(F.broadcast(calendar), F.col("_at") == F.col("_day"), "left").select(*(x for x in rows.columns if x != name), F.when(found <= end, found).alias(name))


def due(next_at: Column, now: Column) -> Column:
    return F.coalesce(now >= next_at, F.lit(False))
