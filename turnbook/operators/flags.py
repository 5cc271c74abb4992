"""Trading restrictions: dispositions and full delivery."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F


def latest_dispositions(notices: DataFrame, today: dt.date, order: str = "source_order") -> DataFrame:
    """Notices in force on ``today``; per ticker the latest end, first seen wins ties."""
    best = W.partitionBy("ticker").orderBy(F.desc("end"), F.asc(order))
    return (
        notices.where(F.lit(today).between(F.col("start"), F.col("end")))
        .withColumn("_n", F.row_number().over(best))
        .where("_n = 1")
        .drop("_n")
    )


def flagged_tickers(dispositions: DataFrame, altered: DataFrame) -> DataFrame:
    return dispositions.select("ticker").union(altered.select("ticker")).distinct()


def market_flags(dispositions: DataFrame, altered: DataFrame) -> DataFrame:
    """One row per flagged ticker: period text, matching minutes, full delivery."""
    period = F.concat(
        F.date_format("start", "yyyy/MM/dd"), F.lit(" ~ "), F.date_format("end", "yyyy/MM/dd")
    )
    return (
        dispositions.select("ticker", period.alias("disposition_period"), "matching_minutes")
        .join(altered.select("ticker").distinct().withColumn("_altered", F.lit(True)), "ticker", "full_outer")
        .select(
            "ticker",
            "disposition_period",
            "matching_minutes",
            F.coalesce("_altered", F.lit(False)).alias("altered_trading"),
        )
    )
