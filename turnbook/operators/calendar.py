"""Trading calendar: distinct dates, ages, period buckets.

A calendar has one row per trading date, so it is bounded by the number of
days the market has been open and is safe to broadcast and to order in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Dates offered for selection, and the period lengths.
SELECTABLE_DATES = 120
PERIOD_OPTIONS = (1, 5, 10, 20, 60)


def as_of(daily: DataFrame, end_date: dt.date | None) -> DataFrame:
    """Rows known on ``end_date``; everything later does not exist yet."""
    return daily if end_date is None else daily.where(F.col("trading_date") <= F.lit(end_date))


def distinct_dates(daily: DataFrame) -> DataFrame:
    return daily.select("trading_date").distinct()


def with_age(dates: DataFrame) -> DataFrame:
    """``age`` counts trading dates back from the newest one (0), ``n_dates`` all of them."""
    newest_first = W.orderBy(F.desc("trading_date"))
    every = W.orderBy(F.desc("trading_date")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        dates.withColumn("age", F.row_number().over(newest_first) - 1)
        .withColumn("n_dates", F.count(F.lit(1)).over(every).cast("int"))
        .withColumn("base_date", F.max("trading_date").over(every))
    )


def trading_calendar(daily: DataFrame, end_date: dt.date | None = None) -> DataFrame:
    return with_age(distinct_dates(as_of(daily, end_date)))


def period_bucket(age: Column, period_days: int) -> Column:
    """0 is the current period, 1 the previous, 2 the one before, and so on."""
    return F.floor(age / period_days).cast("int")


def period_windows(daily: DataFrame, period_days: int, end_date: dt.date | None = None) -> DataFrame:
    """First and last date of the three newest periods and whether each one is complete."""
    cal = trading_calendar(daily, end_date).withColumn("bucket", period_bucket(F.col("age"), period_days))
    return (
        cal.where("bucket <= 2")
        .groupBy("bucket")
        .agg(
            F.min("trading_date").alias("period_start"),
            F.max("trading_date").alias("period_end"),
            F.count(F.lit(1)).cast("int").alias("days"),
            F.max("n_dates").alias("n_dates"),
        )
        .withColumn("complete", F.col("days") == period_days)
    )


def selectable_dates(daily: DataFrame, limit: int = SELECTABLE_DATES) -> DataFrame:
    """The newest ``limit`` trading dates, oldest first."""
    return distinct_dates(daily).orderBy(F.desc("trading_date")).limit(limit).orderBy("trading_date")


def cross_dates_periods(daily: DataFrame, periods=PERIOD_OPTIONS, limit: int = SELECTABLE_DATES) -> DataFrame:
    """Every selectable date with every period length."""
    options = F.array(*[F.lit(p) for p in periods])
    return selectable_dates(daily, limit).select("trading_date", F.explode(options).alias("period_days"))


def retain_newest_dates(daily: DataFrame, keep: int) -> DataFrame:
    """Rows of the newest ``keep`` trading dates."""
    kept = distinct_dates(daily).orderBy(F.desc("trading_date")).limit(keep)
    return daily.join(F.broadcast(kept), "trading_date", "left_semi")
