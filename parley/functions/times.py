"""Column functions on epoch seconds, timestamps and day numbers. The session time zone decides local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import col

#: Formats tried in order; ambiguous day and month are read month first.
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd"]
CHAT_FORMATS = ["M/d/yy, h:mm a", "M/d/yyyy, h:mm a", "M/d/yy, h:mm:ss a", "d/M/yy, HH:mm", "d/M/yyyy, HH:mm", "d/M/yyyy, HH:mm:ss", "d.M.yy, HH:mm", "d.M.yyyy, HH:mm"]


def parse(c: Column | str, formats: list[str] = FORMATS) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(col(c), F.lit(f)) for f in formats])


def epoch(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp with or without time zone."""
    return F.unix_timestamp(col(ts).cast("timestamp"))


def format_epoch(c: Column | str, pattern: str, invalid: str) -> Column:
    """Epoch seconds by pattern; null, zero and negative ones give `invalid`."""
    return F.when(col(c) > 0, F.date_format(F.timestamp_seconds(col(c)), pattern)).otherwise(F.lit(invalid))


def describe_gap(seconds: Column | str) -> Column:
    """Minutes below an hour, hours and minutes below a day, else days and hours; parts of zero are left out."""
    s = F.greatest(F.floor(col(seconds)), F.lit(0)).cast("long")
    days, hours, minutes = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    return (
        F.when(s < 3600, F.concat(minutes.cast("string"), F.lit("分钟")))
        .when(s < 86400, F.concat(hours.cast("string"), F.lit("小时"), part(minutes, "分钟")))
        .otherwise(F.concat(days.cast("string"), F.lit("天"), part(hours, "小时")))
    )


def period_of_day(ts: Column | str) -> Column:
    """night before 6, morning before 12, afternoon before 18, else evening."""
    h = F.hour(col(ts))
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def generalise(ts: Column | str) -> Column:
    """period, day type and the range of three hours of a timestamp."""
    start = (F.floor(F.hour(col(ts)) / 3) * 3).cast("int")
    return F.struct(
        period_of_day(ts).alias("period"),
        F.when(F.weekday(col(ts)) >= 5, "weekend").otherwise("weekday").alias("day_type"),
        F.format_string("%02d-%02d", start, start + 3).alias("hour_range"),
    )


def day_number(date: Column | str, day1: str) -> Column:
    """Day 1 is `day1`."""
    return F.datediff(col(date), F.lit(day1).cast("date")) + 1


def relative_day(ts: Column | str, base: Column | str) -> Column:
    """Whole days from base to ts in epoch seconds, rounded down also before base."""
    return F.floor((col(ts) - col(base)) / 86400)


def fuzzy_day_score(ts: Column | str, target: Column | str, days: int) -> Column:
    """1 / (1 + days apart) within `days`, else null; epoch seconds, whole days by rounding down."""
    apart = F.abs(F.floor((col(target) - col(ts)) / 86400))
    return F.when(apart <= days, 1 / (1 + apart))
