"""Event study: windows around event dates, as-of prices, abnormal and cumulative abnormal returns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.stats import ratio, running


def event_windows(tickers: DataFrame, dates: list[date], before: int, after: int) -> DataFrame:
    """ticker, event_date, event_offset, target_date: every ticker and event date, a row for each offset."""
    events = F.explode(F.array(*[F.lit(d).cast("date") for d in dates]))
    rows = tickers.select("ticker").distinct().withColumn("event_date", events)
    rows = rows.withColumn("event_offset", F.explode(F.sequence(F.lit(-before), F.lit(after))))
    return rows.withColumn("target_date", F.expr("date_add(event_date, event_offset)"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time; others are dropped.

    One shuffle by key of both sides together and one pass in time order; no range join.
    """
    own = [c for c in left.columns if c != key]
    a = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own])
    b = left.select(key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_v"].dataType).alias("_v"), *own)
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return out.where("_side = 1 and _last is not null").select(key, *own, *[F.col(f"_last.{v}").alias(v) for v in values])


def abnormal_returns(prices: DataFrame, dates: list[date], before: int = 10, after: int = 20) -> DataFrame:
    """The panel: actual, normal and abnormal return and the running sum of the latter, by event and offset."""
    windows = event_windows(prices, dates, before, after)
    priced = as_of(windows, prices, "ticker", "target_date", "price_date", ["close", "benchmark"])
    event = Window.partitionBy("ticker", "event_date")
    w = event.orderBy("event_offset")
    step = lambda c: ratio(F.col(c), F.lag(c).over(w)) - 1
    rows = priced.withColumn("actual_return", step("close")).withColumn("normal_return", step("benchmark")).where("actual_return is not null")
    rows = rows.withColumn("abnormal_return", F.col("actual_return") - F.col("normal_return"))
    return rows.select(
        F.col("ticker").alias("benchmark_id"),
        "event_date",
        "event_offset",
        "abnormal_return",
        F.sum("abnormal_return").over(running(w)).alias("car_from_t0"),
        "normal_return",
        "actual_return",
        F.count("*").over(event).alias("n_events"),
    )


def car_from(panel: DataFrame, offset: int = 0) -> DataFrame:
    """The panel with ``car``: abnormal returns summed from an offset on, NULL before it."""
    w = Window.partitionBy("benchmark_id", "event_date").orderBy("event_offset")
    x = F.when(F.col("event_offset") >= offset, F.col("abnormal_return"))
    return panel.withColumn("car", F.sum(x).over(running(w)))
