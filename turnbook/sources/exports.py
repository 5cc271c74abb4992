"""Result files: rankings of all dates and periods, adjusted bars of all tickers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from turnbook.functions import measures as m
from turnbook.operators import calendar as cal, kline as kl, ranking as r


def _whole_average(total: str) -> Column:
    """Average rounded half-even to whole units; divided as decimals, so halves are exact."""
    days = F.col("period_days").cast("decimal(5,0)")
    return m.half_even(F.col(total).cast("decimal(25,0)") / days, 0).cast("bigint")


def rounded_rankings(rows: DataFrame) -> DataFrame:
    """Rows as exported: whole averages, eight decimals, eight significant digits for shares."""
    return rows.select(
        "period_days",
        "base_date",
        "ticker",
        "name",
        F.lower("market").alias("market"),
        _whole_average("total").alias("value"),
        _whole_average("previous_total").alias("previous_value"),
        m.half_even(F.col("change_rate"), 8).alias("rate"),
        m.half_even(F.col("previous_change_rate"), 8).alias("previous_rate"),
        m.significant(F.col("share")).alias("share"),
        m.significant(F.col("share_change")).alias("share_change"),
        m.half_even(F.col("daily_price_change"), 8).alias("price_change"),
        m.half_even(F.col("weekly_price_change"), 8).alias("weekly_price_change"),
        F.col("week_baseline").alias("weekly_baseline_close"),
        F.col("end_close").alias("close"),
    )


def export_rankings(daily: DataFrame, stocks: DataFrame, path: str, turnover: DataFrame | None = None) -> None:
    """All selectable dates and periods, one partition folder each.

    The rebalance hint lets adaptive execution split a large folder over several
    tasks and merge small ones.
    """
    rows = rounded_rankings(r.ranking_all_dates(daily, stocks, ranks=False, turnover=turnover))
    keys = ("period_days", "base_date")
    rows.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def export_bars(daily: DataFrame, events: DataFrame, path: str, end_date: dt.date | None = None) -> None:
    """Adjusted bars of every ticker, three months before the oldest selectable date onwards.

    Nothing after ``end_date`` counts, neither bars nor events.  A ticker's bars
    lie together in one file, so reading one ticker touches few row groups.
    """
    daily = cal.as_of(daily, end_date)
    events = events if end_date is None else events.where(F.col("effective_date") <= F.lit(end_date))
    dates = cal.selectable_dates(daily)
    bounds = dates.agg(
        F.add_months(F.min("trading_date"), -kl.DEFAULT_MONTHS).alias("_start"), F.max("trading_date").alias("_end")
    )
    counts = events.groupBy("ticker").agg(F.count(F.lit(1)).alias("event_count"))
    rows = r.with_scalars(kl.adjusted(daily, events), bounds).where(
        F.col("trading_date").between(F.col("_start"), F.col("_end"))
        & F.col("adj_open").isNotNull()
        & F.col("adj_high").isNotNull()
        & F.col("adj_low").isNotNull()
    )
    (
        kl.rounded(rows)
        .drop("_start", "_end")
        .join(counts, "ticker", "left")
        .withColumn("event_count", F.coalesce("event_count", F.lit(0)))
        .repartition("ticker")
        .sortWithinPartitions("ticker", "trading_date")
        .write.mode("overwrite")
        .parquet(path)
    )
