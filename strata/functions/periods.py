"""Calendar periods."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = {"1w": "7 days", "1m": "1 month", "3m": "3 months", "6m": "6 months", "1y": "12 months"}
#: Years of history when neither a start nor a number of periods is given.
HISTORY_YEARS = 10


def period_label(start: Column, span: str) -> Column:
    year = F.year(start).cast("string")
    if span == "1w":
        return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(start).cast("string"), 2, "0"))
    if span == "1m":
        return F.date_format(start, "yyyy-MM")
    if span == "3m":
        return F.concat(year, F.lit("-Q"), F.quarter(start).cast("string"), F.lit(" ("), F.date_format(start, "MMM"), F.lit(")"))
    if span == "6m":
        return F.concat(year, F.lit("-H"), F.when(F.month(start) <= 6, "1").otherwise("2"))
    if span == "1y":
        return year
    raise ValueError(f"span must be one of {sorted(SPANS)}")


def period_range(times: DataFrame, span: str, at: str = "committed_at") -> DataFrame:
    """(label, start, end) half-open windows that cover the times of a table, from the first day of the first year on."""
    step = F.expr(f"INTERVAL {SPANS[span]}")
    ends = times.agg(F.date_trunc("year", F.min(at)).alias("first"), F.max(at).alias("last")).where("first is not null")
    starts = ends.select(F.explode(F.sequence("first", "last", step)).alias("start"))
    return starts.select(period_label(F.col("start"), span).alias("label"), "start", (F.col("start") + step).alias("end"))


def build_periods(spark: SparkSession, span: str, as_of: datetime, since: datetime | None = None, n: int | None = None) -> DataFrame:
    """(label, start, end) half-open windows: forward from `since` (the last is cut at as_of), or n windows back."""
    step, now = f"INTERVAL {SPANS[span]}", F.lit(as_of).cast("timestamp")
    one = spark.range(1)
    if n is not None:
        back = F.expr(f"transform(sequence(1, {int(n)}), i -> to_timestamp('{as_of:%Y-%m-%d %H:%M:%S}') - i * {step})")
        starts = one.select(F.explode(F.array_sort(back)).alias("start"))
    else:
        first = since or as_of.replace(year=as_of.year - HISTORY_YEARS)
        starts = one.select(F.explode(F.sequence(F.lit(first).cast("timestamp"), now, F.expr(step))).alias("start")).where(F.col("start") < now)
    return starts.withColumn("end", F.least(F.col("start") + F.expr(step), now)).select(period_label(F.col("start"), span).alias("label"), "start", "end")
