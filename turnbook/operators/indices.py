"""Market index history: as-of lookups, year-to-date change, wide history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnbook.functions import measures as m
from turnbook.operators.asof import asof_join
from turnbook.schemas import MARKETS


def value_as_of(day: Column) -> Column:
    """Aggregate: newest positive value up to ``day``."""
    usable = (F.col("trading_date") <= day) & (F.col("value") > 0)
    return F.max_by("value", F.when(usable, F.col("trading_date")))


def ytd_percent(ending: Column, baseline: Column) -> Column:
    """Two decimals, halves away from zero; null without two positive values."""
    ratio = m.percent_ratio(ending - baseline, baseline)
    return F.when((baseline > 0) & (ending > 0), m.half_away(ratio, 2).cast("decimal(14,2)"))


def year_to_date(index: DataFrame, end: dt.date, live: DataFrame | None = None) -> DataFrame:
    """Year-to-date change per market on ``end``; a live value may replace the ending."""
    values = index.groupBy("market").agg(
        value_as_of(F.lit(dt.date(end.year - 1, 12, 31))).alias("baseline"), value_as_of(F.lit(end)).alias("ending")
    )
    if live is not None:
        values = values.join(live.select("market", F.col("value").alias("_live")), "market", "full_outer").select(
            "market", "baseline", F.coalesce("_live", "ending").alias("ending")
        )
    return values.withColumn("ytd_change_percent", ytd_percent(F.col("ending"), F.col("baseline")))


def year_to_date_of(index: DataFrame, dates: DataFrame) -> DataFrame:
    """Year-to-date change of every market on each of the given dates, traded or not.

    Baseline and ending are looked up in one pass: the newest positive value before
    the year of the date, and up to the date.
    """
    markets = F.explode(F.array(*[F.lit(x) for x in MARKETS])).alias("market")
    asked = dates.select(F.col("trading_date").alias("base_date"), markets)
    wanted = F.explode(
        F.array(
            F.struct(F.lit("ending").alias("what"), F.col("base_date").alias("trading_date")),
            F.struct(F.lit("baseline").alias("what"), F.date_sub(F.trunc("base_date", "year"), 1).alias("trading_date")),
        )
    )
    requests = asked.select("base_date", "market", wanted.alias("_w")).select("base_date", "market", "_w.*")
    found = asof_join(
        requests, index, ("market",), "trading_date", ("value",), span=F.year("trading_date"), usable=F.col("value") > 0
    )
    pairs = found.groupBy("base_date", "market").agg(
        *[F.max(F.when(F.col("what") == what, F.col("value"))).alias(what) for what in ("baseline", "ending")]
    )
    return pairs.withColumn("ytd_change_percent", ytd_percent(F.col("ending"), F.col("baseline")))


def with_year_to_date(index: DataFrame) -> DataFrame:
    """Every row with its change since the last value of an earlier year.

    The history has one row per market and date, so one ordered pass per market suffices.
    """
    by_date = W.partitionBy("market").orderBy("trading_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    before_year = (
        W.partitionBy("market").orderBy(F.year("trading_date")).rangeBetween(W.unboundedPreceding, -1)
    )
    positive = F.when(F.col("value") > 0, F.col("value"))
    dated = F.when(F.col("value") > 0, F.col("trading_date"))
    return (
        index.withColumn("baseline", F.max_by(F.col("value"), dated).over(before_year))
        .withColumn("ending", F.last(positive, ignorenulls=True).over(by_date))
        .withColumn("ytd_change_percent", ytd_percent(F.col("ending"), F.col("baseline")))
    )


def with_change_percent(index: DataFrame) -> DataFrame:
    """Change against the previous row of the market."""
    previous = F.lag("value").over(W.partitionBy("market").orderBy("trading_date"))
    return index.withColumn(
        "change_percent",
        m.percent_change(F.col("value"), previous).cast("decimal(14,2)"),
    )


def wide_history(index: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per wanted date: value, daily and year-to-date change of both markets."""
    pivoted = (
        with_year_to_date(index)
        .groupBy("trading_date")
        .pivot("market", list(MARKETS))
        .agg(
            F.first("value").alias("value"),
            F.first("change_percent").alias("change"),
            F.first("ytd_change_percent").alias("ytd"),
        )
    )
    lowered = pivoted.toDF(*[c.lower() for c in pivoted.columns])
    return dates.select("trading_date").join(lowered, "trading_date", "left")


def year_start_baselines(index: DataFrame, dates: DataFrame) -> DataFrame:
    """Per year of the given dates: last positive value of each market before that year."""
    years = dates.select(F.year("trading_date").alias("year")).distinct()
    # Last positive value of each year and market, then carried forward over the years.
    closing = (
        index.where("value > 0")
        .groupBy("market", F.year("trading_date").alias("year"))
        .agg(F.max_by("value", "trading_date").alias("value"))
    )
    marks = closing.select("market", (F.col("year") + 1).alias("year"), "value").unionByName(
        years.select(F.explode(F.array(*[F.lit(x) for x in MARKETS])).alias("market"), "year"), allowMissingColumns=True
    )
    per_year = marks.groupBy("market", "year").agg(F.max("value").alias("value"))
    carried = per_year.withColumn(
        "value",
        F.last("value", ignorenulls=True).over(
            W.partitionBy("market").orderBy("year").rowsBetween(W.unboundedPreceding, W.currentRow)
        ),
    )
    wide = carried.groupBy("year").pivot("market", list(MARKETS)).agg(F.first("value"))
    return years.join(wide.toDF("year", "twse_baseline", "tpex_baseline"), "year")
