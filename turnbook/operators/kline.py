"""Daily bars adjusted backwards for ex-rights and dividends, with moving averages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Lengths of the averages in bars, and the months shown.
AVERAGES = (5, 10, 20, 60, 240)
DEFAULT_MONTHS = 3
PRICES = ("open_price", "high_price", "low_price", "close_price")
# Adjusted closes are summed as decimals, so running sums stay exact.
EXACT = "decimal(28,12)"


def event_factors(events: DataFrame, through: dt.date | None = None) -> DataFrame:
    """One factor per ticker and effective date; events of the same day multiply."""
    usable = (F.col("previous_close") > 0) & (F.col("reference_price") > 0)
    if through is not None:
        usable = usable & (F.col("effective_date") <= F.lit(through))
    return (
        events.where(usable)
        .groupBy("ticker", "effective_date")
        .agg(F.product(F.col("reference_price").cast("double") / F.col("previous_close").cast("double")).alias("factor"))
    )


def _valid(daily: DataFrame, through: dt.date | None) -> DataFrame:
    rows = daily.where(F.col("close_price") > 0)
    return rows if through is None else rows.where(F.col("trading_date") <= F.lit(through))


def with_adjust_factor(daily: DataFrame, events: DataFrame, through: dt.date | None = None) -> DataFrame:
    """Add the product of all factors that take effect after the row's date.

    Bars and events of a ticker share one ordered window, so the range join
    becomes a running product: no pair of row and event is ever formed.
    """
    columns = daily.columns
    days = daily.withColumn("_day", F.unix_date("trading_date")).withColumn("_factor", F.lit(None).cast("double"))
    marks = event_factors(events, through).select(
        "ticker", F.unix_date("effective_date").alias("_day"), F.col("factor").alias("_factor")
    )
    later = W.partitionBy("ticker").orderBy(F.desc("_day")).rangeBetween(W.unboundedPreceding, -1)
    return (
        days.unionByName(marks, allowMissingColumns=True)
        .withColumn("factor", F.coalesce(F.product("_factor").over(later), F.lit(1.0)))
        .where(F.col("trading_date").isNotNull())
        .select(*columns, "factor")
    )


def with_averages(rows: DataFrame, lengths: tuple[int, ...] = AVERAGES) -> DataFrame:
    """Moving averages of ``adj_close`` and the previous adjusted close.

    Running sums and lags: the work per row does not grow with the length.
    """
    by_date = W.partitionBy("ticker").orderBy("trading_date")
    so_far = by_date.rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = (
        rows.withColumn("_cum", F.sum(F.col("adj_close").cast(EXACT)).over(so_far))
        .withColumn("_bar", F.row_number().over(by_date))
        .withColumn("previous_close", F.lag("adj_close", 1).over(by_date))
    )

    def average(n: int) -> Column:
        before = F.coalesce(F.lag("_cum", n).over(by_date), F.lit(0).cast("decimal(38,12)"))
        return F.when(F.col("_bar") >= n, (F.col("_cum") - before).cast("double") / n).alias(f"ma{n}")

    return summed.select(*rows.columns, "previous_close", *[average(n) for n in lengths])


def trend(close: Column, previous_close: Column, open_: Column) -> Column:
    """Direction against the previous adjusted close, or the own open for the first bar.

    Compared as decimals: a close that only changed by its factor is not a move.
    """
    close = close.cast("decimal(28,9)")
    reference = F.coalesce(previous_close, open_).cast("decimal(28,9)")
    return F.when(close > reference, "up").when(close < reference, "down").otherwise("flat")


def adjusted(daily: DataFrame, events: DataFrame, through: dt.date | None = None) -> DataFrame:
    """All rows with a positive close: adjusted prices, averages, previous close."""
    rows = with_adjust_factor(_valid(daily.select("ticker", "trading_date", *PRICES), through), events, through)
    scaled = rows.select(
        "ticker",
        "trading_date",
        *[(F.col(p).cast("double") * F.col("factor")).alias("adj_" + p.split("_")[0]) for p in PRICES],
    )
    return with_averages(scaled)


def complete_bars(rows: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Bars with open, high and low in the range; applied after all windows."""
    return rows.where(
        F.col("trading_date").between(F.lit(start), F.lit(end))
        & F.col("adj_open").isNotNull()
        & F.col("adj_high").isNotNull()
        & F.col("adj_low").isNotNull()
    )


BAR_VALUES = ("adj_open", "adj_high", "adj_low", "adj_close", "previous_close", *[f"ma{n}" for n in AVERAGES])


def rounded(rows: DataFrame, scale: int = 4) -> DataFrame:
    """Bar values rounded half-even; decimals first, so binary noise cannot decide a half."""
    values = {v: F.bround(F.col(v).cast("decimal(28,9)"), scale).cast("double") for v in BAR_VALUES if v in rows.columns}
    return rows.withColumns(values)


def months_before(day: dt.date, months: int) -> dt.date:
    """Calendar months back, clamped to the end of a shorter month."""
    if months < 1:
        raise ValueError("months must be at least 1")
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    following = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (following - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(day.day, last))


def bars(daily: DataFrame, events: DataFrame, start: dt.date, end: dt.date, through: dt.date) -> DataFrame:
    rows = complete_bars(adjusted(daily, events, through), start, end)
    return rows.withColumn("trend", trend(F.col("adj_close"), F.col("previous_close"), F.col("adj_open")))


def select_bars(
    daily: DataFrame, events: DataFrame, end: dt.date, through: dt.date | None = None, months: int = DEFAULT_MONTHS
) -> DataFrame:
    """The last ``months`` of bars up to ``end`` for every ticker."""
    return bars(daily, events, months_before(end, months), end, through or end)


def append_live_bar(history: DataFrame, live: DataFrame, end: dt.date) -> DataFrame:
    """Replace the bar of ``end`` by the live one when that has all four prices.

    ``history``: ticker, trading_date, open, high, low, close, previous_close.
    ``live``: ticker, trading_date, open, high, low, close.
    """
    prices = ["open", "high", "low", "close"]
    whole = live.where(" AND ".join(f"{p} IS NOT NULL" for p in prices))
    columns = ["ticker", "trading_date", *prices, "previous_close"]
    replaced = whole.select("ticker", F.lit(end).alias("trading_date"))
    kept = history.join(replaced, ["ticker", "trading_date"], "left_anti").select(*columns, F.lit(False).alias("is_live"))
    added = whole.select(
        "ticker", "trading_date", *prices, F.lit(None).cast("double").alias("previous_close"), F.lit(True).alias("is_live")
    )
    # The live bar refers to the newest bar of the history, wherever it sorts.
    last_close = F.max_by("close", F.when(~F.col("is_live"), F.col("trading_date"))).over(W.partitionBy("ticker"))
    return (
        kept.unionByName(added)
        .withColumn("previous_close", F.when(F.col("is_live"), last_close).otherwise(F.col("previous_close")))
        .select(*columns, "is_live")
    )
