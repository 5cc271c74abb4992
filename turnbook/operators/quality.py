"""Reconciliation, gap planning, coverage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from turnbook.operators.quotes import daily_totals
from turnbook.schemas import DAILY_BAR_SCHEMA_VERSION, MARKET_INDEX_SCHEMA_VERSION, SCHEMA_VERSION

# Curve days needed for calibration; calendar days walked back per wanted day.
CURVE_DAYS_READY = 10

# What a reconciliation can find on one date.
TARGET_ONLY = "target_only"
COUNT_MISMATCH = "count_mismatch"
VALUE_MISMATCH = "value_mismatch"
VOLUME_MISMATCH = "volume_mismatch"
SOURCE_ONLY = "source_only"


def reconcile_totals(source: DataFrame, target: DataFrame) -> DataFrame:
    """Differences between two frames of daily totals, one row per finding.

    Both frames have one row per trading date.
    """
    names = ("quote_count", "total_value", "total_volume")
    s = source.select("trading_date", *[F.col(n).alias("s_" + n) for n in names])
    t = target.select("trading_date", *[F.col(n).alias("t_" + n) for n in names])
    oldest = t.agg(F.min("trading_date")).scalar()
    in_source, in_target = F.col("s_quote_count").isNotNull(), F.col("t_quote_count").isNotNull()
    both = in_source & in_target

    def differs(name: str):
        return both & (F.col("s_" + name) != F.col("t_" + name))

    findings = F.array(
        F.when(in_target & ~in_source, TARGET_ONLY),
        F.when(differs("quote_count"), COUNT_MISMATCH),
        F.when(differs("total_value"), VALUE_MISMATCH),
        F.when(differs("total_volume"), VOLUME_MISMATCH),
        F.when(in_source & ~in_target & (F.col("trading_date") >= F.col("_oldest")), SOURCE_ONLY),
    )
    return (
        s.join(t, "trading_date", "full_outer")
        .withColumn("_oldest", oldest)
        .withColumn("verdict", F.explode(F.array_compact(findings)))
        .select("trading_date", "verdict", *["s_" + n for n in names], *["t_" + n for n in names])
    )


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """Compare two daily tables through their totals."""
    return reconcile_totals(daily_totals(source), daily_totals(target))


def missing_dates(source: DataFrame, target: DataFrame) -> DataFrame:
    """Trading dates of ``source`` that ``target`` does not have."""
    return source.select("trading_date").distinct().join(
        target.select("trading_date").distinct(), "trading_date", "left_anti"
    )


def rows_of_missing_dates(source: DataFrame, target: DataFrame) -> DataFrame:
    # Dates are bounded by the calendar.
    return source.join(F.broadcast(target.select("trading_date").distinct()), "trading_date", "left_anti")


def plan_gaps(snapshots: DataFrame, start: dt.date, wanted_days: int) -> DataFrame:
    """State of each weekday walking back from ``start`` until enough days are stored.

    ``snapshots``: trading_date, is_trading_day, schema_version, market_index_schema_version,
    has_indices, daily_bar_schema_version (one row per stored date).
    """
    walked = wanted_days * 3 + 30
    days = (
        snapshots.sparkSession.range(walked)
        .select(F.date_sub(F.lit(start), F.col("id").cast("int")).alias("trading_date"))
        .where(F.weekday("trading_date") < 5)
    )
    current = F.col("schema_version") >= SCHEMA_VERSION
    indexed = (F.col("market_index_schema_version") >= MARKET_INDEX_SCHEMA_VERSION) & F.col("has_indices")
    barred = F.col("daily_bar_schema_version") >= DAILY_BAR_SCHEMA_VERSION
    status = (
        F.when(F.col("is_trading_day").isNull(), "missing")
        .when(~F.col("is_trading_day"), "closed")
        .when(~current, "stale_version")
        .when(~indexed, "index_missing")
        .when(~barred, "bars_missing")
        .otherwise("complete")
    )
    back = W.orderBy(F.desc("trading_date")).rowsBetween(W.unboundedPreceding, -1)
    stored = F.when(F.col("status") != "closed", 1).otherwise(0)
    return (
        days.join(snapshots, "trading_date", "left")
        .select("trading_date", status.alias("status"))
        .withColumn("_before", F.coalesce(F.sum(stored).over(back), F.lit(0)))
        .where((F.col("_before") < wanted_days) & (F.col("status") != "closed"))
        .drop("_before")
    )


def day_outcomes(arrivals: DataFrame, holidays: DataFrame, today: dt.date) -> DataFrame:
    """What a downloaded date becomes.

    ``arrivals``: trading_date, twse_count, tpex_count, has_twse_index, has_tpex_index.
    """
    closed = holidays.select("trading_date").distinct().withColumn("_closed", F.lit(True))
    empty = (F.col("twse_count") == 0) & (F.col("tpex_count") == 0)
    past = F.col("trading_date") < F.lit(today)
    outcome = (
        F.when(empty & (past | F.col("_closed")), "closed")
        .when(empty, "not_published")
        .when(~(F.col("has_twse_index") & F.col("has_tpex_index")), "index_missing")
        .otherwise("stored")
    )
    one_sided = ~empty & ((F.col("twse_count") == 0) | (F.col("tpex_count") == 0))
    return (
        arrivals.join(F.broadcast(closed), "trading_date", "left")
        .withColumn("_closed", F.coalesce("_closed", F.lit(False)))
        .withColumn("outcome", outcome)
        .withColumn("bar_backfill_failed", empty | one_sided)
        .drop("_closed")
    )


def coverage(target: DataFrame, securities: DataFrame, source: DataFrame) -> DataFrame:
    """One row: rows, dates, range, securities; warns when the target lags the source."""
    # Count per date first: a distinct count over all rows would shuffle every row.
    per_date = target.groupBy("trading_date").agg(F.count(F.lit(1)).alias("n"))
    row = per_date.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("quote_rows"),
        F.count(F.lit(1)).alias("trading_days"),
        F.min("trading_date").alias("oldest_date"),
        F.max("trading_date").alias("latest_date"),
    )
    known = securities.agg(F.count(F.lit(1)))
    latest_source = source.agg(F.max("trading_date"))
    return (
        row.withColumn("securities", known.scalar())
        .withColumn("source_latest", latest_source.scalar())
        .withColumn("lagging", F.coalesce(F.col("source_latest") > F.col("latest_date"), F.lit(False)))
    )


def coverage_report(target: DataFrame, securities: DataFrame, source: DataFrame, curve: DataFrame) -> DataFrame:
    """Coverage plus the number of curve days and whether they suffice for calibration."""
    days = curve.select("trade_date").distinct().agg(F.count(F.lit(1)))
    return coverage(target, securities, source).withColumn("curve_days", days.scalar()).withColumn(
        "curve_ready", F.col("curve_days") >= CURVE_DAYS_READY
    )
