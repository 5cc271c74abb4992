"""Monthly revenue: growth, new-high streaks, recent months, display joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnbook.functions import measures as m

# Fixed value: months kept for the chart; newest months always loaded again.
RECENT_MONTHS = 20
ALWAYS_REFRESH = 2


def eligible_month_of(today: dt.date) -> dt.date:
    first = today.replace(day=1)
    return (first - dt.timedelta(days=1)).replace(day=1)


def _growth(current: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, (current - baseline).cast("double") / baseline.cast("double"))


def with_growth(monthly: DataFrame) -> DataFrame:
    """Year-over-year and month-over-month growth, looked up by calendar month.

    (``ticker``, ``month``) is unique, so a ticker has at most one row per month.
    """
    indexed = monthly.withColumn("_m", m.month_index(F.col("month")))
    by_month = W.partitionBy("ticker").orderBy("_m")

    def months_ago(n: int) -> Column:
        return F.max("revenue").over(by_month.rangeBetween(-n, -n))

    revenue = F.col("revenue")
    return (
        indexed.withColumn("yoy", _growth(revenue, months_ago(12)))
        .withColumn("mom", _growth(revenue, months_ago(1)))
        .drop("_m")
    )


def with_high_streak(monthly: DataFrame) -> DataFrame:
    """``high_months`` and ``record_high`` for every month.

    Counts back until a month with at least the same revenue.  A missing month
    or the end of the history stops the count and marks it "at least".  Months
    without a gap are folded in order over a stack of those that can still stop
    a later one; a month without revenue is stopped by none and stops none.
    """
    indexed = monthly.withColumn("_m", m.month_index(F.col("month")))
    by_month = W.partitionBy("ticker").orderBy("_m")
    # An island has one row per calendar month, so its list is bounded by the calendar.
    islands = (
        indexed.withColumn("_island", F.col("_m") - F.row_number().over(by_month))
        .groupBy("ticker", "_island")
        .agg(F.array_sort(F.collect_list(F.struct("_m", F.struct(*monthly.columns).alias("_row")))).alias("_rows"))
    )
    months = F.transform("_rows", lambda x: F.struct(x["_m"].alias("m"), x["_row"]["revenue"].alias("revenue")))
    nothing = F.filter(months, lambda _: F.lit(False))
    start = F.struct(nothing.alias("stack"), F.transform(nothing, lambda x: x["m"]).alias("blocks"))

    def step(state: Column, row: Column) -> Column:
        higher = F.filter(state["stack"], lambda s: s["revenue"] >= row["revenue"])
        known = row["revenue"].isNotNull()
        return F.struct(
            F.when(known, F.concat(higher, F.array(row))).otherwise(state["stack"]).alias("stack"),
            # What is left on the stack is in order of months.
            F.concat(state["blocks"], F.array(F.when(known, F.try_element_at(higher, F.lit(-1))["m"]))).alias("blocks"),
        )

    first = F.col("_rows")[0]["_m"]
    counted = (
        islands.withColumn("_blocks", F.aggregate(months, start, step, lambda s: s["blocks"]))
        .select(first.alias("_first"), F.inline(F.arrays_zip("_rows", "_blocks")))
        .select(
            "_rows._row.*",
            F.col("_blocks").alias("_block"),
            (F.col("_rows._m") - F.coalesce("_blocks", F.col("_first") - 1)).alias("_months"),
        )
    )
    high = F.col("_months") >= 2
    return (
        counted.withColumn("high_months", F.when(high, F.col("_months").cast("int")))
        .withColumn("record_high", high & F.col("_block").isNull())
        .select(*monthly.columns, "high_months", "record_high")
    )


def latest(monthly: DataFrame, month: dt.date) -> DataFrame:
    """Summary of one month for every ticker that reported it.

    Only that month needs a streak, so counting replaces the lists of the
    general form: months without a gap have an age equal to their position.
    """
    target = month.year * 12 + month.month
    by_ticker = W.partitionBy("ticker")
    rows = (
        monthly.select("ticker", "revenue", (F.lit(target) - m.month_index(F.col("month"))).alias("age"))
        .where(F.col("age") >= 0)
        .withColumn("current", F.max(F.when(F.col("age") == 0, F.col("revenue"))).over(by_ticker))
        .withColumn("unbroken", F.col("age") == F.row_number().over(by_ticker.orderBy("age")) - 1)
        .where(F.col("current").isNotNull())
    )

    def revenue_at(age: int) -> Column:
        return F.max(F.when(F.col("age") == age, F.col("revenue")))

    blocks = F.col("unbroken") & (F.col("age") > 0) & (F.col("revenue") >= F.col("current"))
    months = F.coalesce(F.col("block"), F.col("run"))
    return (
        rows.groupBy("ticker")
        .agg(
            F.max("current").alias("revenue"),
            revenue_at(12).alias("year_ago"),
            revenue_at(1).alias("month_ago"),
            F.min(F.when(blocks, F.col("age"))).alias("block"),
            F.count_if("unbroken").cast("int").alias("run"),
        )
        .select(
            "ticker",
            F.lit(month).alias("month"),
            "revenue",
            _growth(F.col("revenue"), F.col("year_ago")).alias("yoy"),
            _growth(F.col("revenue"), F.col("month_ago")).alias("mom"),
            F.when(months >= 2, months).alias("high_months"),
            ((months >= 2) & F.col("block").isNull()).alias("record_high"),
        )
    )


def recent_months(monthly: DataFrame, count: int = RECENT_MONTHS) -> DataFrame:
    """The newest ``count`` available rows per ticker."""
    newest = W.partitionBy("ticker").orderBy(F.desc("month"))
    return monthly.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= count).drop("_n")


def history(monthly: DataFrame, count: int = RECENT_MONTHS) -> DataFrame:
    """Growth is computed on the whole history first, then cut to recent months."""
    return recent_months(with_growth(monthly), count)


def high_count(latest_rows: DataFrame, history_rows: DataFrame) -> DataFrame:
    """Rows per output table and the number of tickers with a streak; one row."""
    packed = history_rows.agg(
        F.count(F.lit(1)).alias("history_rows"), F.count_distinct("ticker").alias("history_tickers")
    ).select(F.struct("history_rows", "history_tickers"))
    return (
        latest_rows.agg(
            F.count(F.lit(1)).alias("latest_rows"), F.count("high_months").alias("high_tickers")
        )
        .withColumn("_h", packed.scalar())
        .select("latest_rows", "high_tickers", "_h.history_rows", "_h.history_tickers")
    )


def overlay_latest(history_rows: DataFrame, latest_rows: DataFrame, count: int = RECENT_MONTHS) -> DataFrame:
    """History with the row of the latest table put over the same month, cut to ``count`` rows."""
    columns = ["ticker", "month", "revenue", "yoy", "mom"]
    both = history_rows.select(*columns, F.lit(0).alias("_p")).unionByName(
        latest_rows.select(*columns, F.lit(1).alias("_p"))
    )
    first = W.partitionBy("ticker", "month").orderBy(F.desc("_p"))
    merged = both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_p")
    return recent_months(merged, count)


def display(rows: DataFrame, latest_rows: DataFrame, month: dt.date) -> DataFrame:
    """Attach the revenue of the eligible month; a stale month is left out altogether."""
    shown = latest_rows.where(F.col("month") == F.lit(month)).select(
        "ticker", F.col("revenue").alias("month_revenue"), "yoy", "mom", "high_months", "record_high"
    )
    return rows.join(shown, "ticker", "left")


def month_counts(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("month").agg(F.count(F.lit(1)).alias("row_count"))


def plan_months(monthly: DataFrame, eligible: dt.date, back: int, refresh: int = ALWAYS_REFRESH) -> DataFrame:
    """Months to load: the last ``back`` ones without rows, and always the newest ``refresh``."""
    wanted = (
        monthly.sparkSession.range(back)
        .select(F.col("id").cast("int").alias("index"))
        .withColumn("month", F.add_months(F.lit(eligible), -F.col("index")))
    )
    have = monthly.select("month").distinct()
    missing = wanted.where(F.col("index") >= refresh).join(have, "month", "left_anti")
    return wanted.where(F.col("index") < refresh).unionByName(missing).select("month", "index")
