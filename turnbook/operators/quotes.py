"""Daily quotes: regular trading only, merges, dimensions, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sum_non_regular(reports: DataFrame, keys: tuple[str, ...] = ("trading_date", "ticker")) -> DataFrame:
    return reports.groupBy(*keys).agg(
        F.sum("trading_value").alias("excluded_value"), F.sum("trading_volume").alias("excluded_volume")
    )


def regular_only(quotes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Take odd lots, fixed-price and block trades off; never below zero."""

    def less(name: str, off: str):
        return F.greatest(F.col(name) - F.coalesce(F.col(off), F.lit(0)), F.lit(0))

    return (
        quotes.join(excluded, ["trading_date", "ticker"], "left")
        .withColumn("trading_value", less("trading_value", "excluded_value"))
        .withColumn("trading_volume", less("trading_volume", "excluded_volume"))
        .select(*quotes.columns)
    )


def merge_bars(quotes: DataFrame, bars: DataFrame) -> DataFrame:
    """Back-fill open, high and low; a quote without a bar stays as it is."""
    prices = ("open_price", "high_price", "low_price")
    found = bars.select("trading_date", "ticker", F.lit(True).alias("_found"), *[F.col(p).alias("_" + p) for p in prices])
    joined = quotes.join(found, ["trading_date", "ticker"], "left")
    for p in prices:
        joined = joined.withColumn(p, F.when(F.col("_found"), F.col("_" + p)).otherwise(F.col(p)))
    return joined.select(*quotes.columns)


def merge_indices(snapshots: DataFrame, indices: DataFrame, version: int) -> DataFrame:
    """Put index rows on existing dates and raise the index version of those dates.

    ``indices``: trading_date and an array ``market_indices`` (one entry per market).
    """
    new = indices.select("trading_date", F.col("market_indices").alias("_new"))
    return (
        snapshots.join(new, "trading_date", "left")
        .withColumn("market_indices", F.coalesce("_new", "market_indices"))
        .withColumn(
            "market_index_schema_version",
            F.when(F.col("_new").isNotNull(), F.lit(version)).otherwise(F.col("market_index_schema_version")),
        )
        .select(*snapshots.columns)
    )


def latest_dimension(quotes: DataFrame) -> DataFrame:
    """Name and market of each ticker on its latest date."""
    return quotes.groupBy("ticker").agg(
        F.max_by("name", "trading_date").alias("name"), F.max_by("market", "trading_date").alias("market")
    )


def known_only(rows: DataFrame, securities: DataFrame) -> DataFrame:
    return rows.join(securities.select("ticker"), "ticker", "left_semi")


def daily_view(quotes: DataFrame, securities: DataFrame) -> DataFrame:
    """Quotes with name and market of the securities table."""
    return quotes.select(
        "trading_date", "ticker", "close_price", "trading_value", "trading_volume", "transaction_count"
    ).join(securities.select("ticker", "name", "market"), "ticker")


def daily_totals(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("trading_date").agg(
        F.count(F.lit(1)).alias("quote_count"),
        F.sum("trading_value").alias("total_value"),
        F.sum("trading_volume").alias("total_volume"),
    )
