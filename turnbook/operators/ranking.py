"""Turnover rankings of one base date, and of many base dates in one job."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnbook.functions import measures as m
from turnbook.operators import calendar as cal
from turnbook.operators.ranks import with_positions
from turnbook.session import materialize

HEAT = "heat"
ACCELERATION = "acceleration"
ALL_MARKETS = "all"


@dataclass(frozen=True)
class RankingQuery:
    """What to rank.  ``min_average`` is in the unit of ``trading_value``."""

    period_days: int = 5
    end_date: dt.date | None = None
    mode: str = HEAT
    market: str = ALL_MARKETS
    min_average: int = 100_000_000
    top: int | None = 100

    def __post_init__(self):
        if self.period_days < 1:
            raise ValueError("period_days must be at least 1")

    @property
    def required_dates(self) -> int:
        return self.period_days * (3 if self.mode == ACCELERATION else 2)


def _latest_close(condition: Column) -> Column:
    """Close of the newest matching row that has one."""
    known = condition & F.col("close_price").isNotNull()
    return F.max_by("close_price", F.when(known, F.col("trading_date")))


def day_totals(turnover: DataFrame) -> DataFrame:
    """Value of each trading date, written once: calendar and market totals of a job both come from it.

    ``turnover`` may have any grain (single trades will do): only dates and values
    are read, and they are summed before the one small exchange.
    """
    return materialize(turnover.groupBy("trading_date").agg(F.sum("trading_value").alias("trading_value")), "days")


def _aged(rows: DataFrame, end_date, days: DataFrame | None = None) -> DataFrame:
    # The calendar holds one row per trading date.
    calendar = cal.trading_calendar(rows if days is None else days, end_date)
    return cal.as_of(rows, end_date).join(F.broadcast(calendar), "trading_date")


def period_stats(
    daily: DataFrame, period_days: int, end_date: dt.date | None = None, days: DataFrame | None = None
) -> DataFrame:
    """One row per ticker with the sums of the three newest periods, closes and baselines.

    A single conditional aggregation: rows are combined before the only shuffle,
    whatever the share of one ticker.  Periods that are not complete count as empty.
    """
    bucket = cal.period_bucket(F.col("age"), period_days)

    def in_period(k: int) -> Column:
        return (bucket == k) & (F.col("n_dates") >= period_days * (k + 1))

    def total(k: int) -> Column:
        return F.coalesce(F.sum(F.when(in_period(k), F.col("trading_value"))), F.lit(0))

    def active(k: int) -> Column:
        return F.count_if(in_period(k) & (F.col("trading_value") > 0)).cast("int")

    newest = F.col("age") == 0
    monday = m.week_start(F.col("base_date"))
    return (
        _aged(daily, end_date, days)
        .groupBy("ticker")
        .agg(
            F.max("n_dates").alias("n_dates"),
            total(0).alias("total"),
            total(1).alias("previous_total"),
            total(2).alias("prior_total"),
            active(0).alias("active_days"),
            _latest_close(in_period(0)).alias("end_close"),
            _latest_close(bucket >= 1).alias("baseline_close"),
            F.max(F.when(newest, F.col("close_price"))).alias("day_close"),
            _latest_close(F.col("age") > 0).alias("day_baseline"),
            _latest_close(F.col("trading_date") < monday).alias("week_baseline"),
        )
    )


def traded(total: Column, active_days: Column, close: Column) -> Column:
    """A ticker without value, active day or close has no statistics at all."""
    return ~((total == 0) & (active_days == 0) & close.isNull())


def market_totals(turnover: DataFrame, period_days: int, end_date: dt.date | None = None) -> DataFrame:
    """One row: turnover of both markets in the current and the previous period; any grain will do."""
    aged = _aged(turnover.select("trading_date", "trading_value"), end_date)
    bucket = cal.period_bucket(F.col("age"), period_days)
    value = F.col("trading_value").cast("decimal(38,0)")
    return aged.where(F.col("age") < period_days * 2).agg(
        F.coalesce(F.sum(F.when(bucket == 0, value)), F.lit(0)).alias("market_total"),
        F.coalesce(F.sum(F.when(bucket == 1, value)), F.lit(0)).alias("previous_market_total"),
    )


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame as a scalar subquery, not as a join."""
    packed = one_row.select(F.struct(*one_row.columns))
    named = df.withColumn("_one", packed.scalar())
    return named.select(*df.columns, *[F.col("_one")[c].alias(c) for c in one_row.columns])


def average(total: str, period_days: int) -> Column:
    """Divides by the length of the period, not by the rows present."""
    return F.col(total).cast("double") / F.lit(float(period_days))


def with_measures(stats: DataFrame, period_days: int) -> DataFrame:
    return (
        stats.withColumn("average_value", average("total", period_days))
        .withColumn("previous_average_value", average("previous_total", period_days))
        .withColumn("prior_average_value", average("prior_total", period_days))
        .withColumn("change_rate", m.turnover_growth(F.col("total"), F.col("previous_total")))
        .withColumn("previous_change_rate", m.turnover_growth(F.col("previous_total"), F.col("prior_total")))
        .withColumn("price_change", m.price_growth(F.col("end_close"), F.col("baseline_close")))
        .withColumn("daily_price_change", m.price_growth(F.col("day_close"), F.col("day_baseline")))
        .withColumn("weekly_price_change", m.price_growth(F.col("day_close"), F.col("week_baseline")))
    )


def candidates(
    daily: DataFrame,
    stocks: DataFrame,
    query: RankingQuery,
    turnover: DataFrame | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """Known, traded tickers that pass market and threshold, with all measures.

    ``turnover`` is where dates and market totals are read from, if there is a
    cheaper place than ``daily``; ``days`` are its day totals, if already there.
    """
    n = query.period_days
    days = day_totals(turnover or daily) if days is None else days
    stats = period_stats(daily, n, query.end_date, days).where(
        (F.col("n_dates") >= query.required_dates)
        & traded(F.col("total"), F.col("active_days"), F.col("end_close"))
        & (F.col("total") >= F.lit(query.min_average) * n)
    )
    listed = stocks if query.market == ALL_MARKETS else stocks.where(F.col("market") == query.market)
    joined = with_measures(stats, n).join(listed.select("ticker", "name", "market"), "ticker")
    with_totals = with_scalars(joined, market_totals(days, n, query.end_date))
    return with_totals.withColumn("share", m.share(F.col("total"), F.col("market_total"))).withColumn(
        "previous_share", m.share(F.col("previous_total"), F.col("previous_market_total"))
    ).withColumn("share_change", F.col("share") - F.col("previous_share"))


def sort_keys(mode: str) -> tuple[str, str]:
    if mode == ACCELERATION:
        return "change_rate", "previous_change_rate"
    return "average_value", "previous_average_value"


def with_ranks(rows: DataFrame, mode: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``rank``, ``previous_rank`` and ``rank_change`` over the same rows."""
    key, previous_key = sort_keys(mode)
    placed = with_positions(rows, {"rank": key, "_previous": previous_key}, within)
    comparable = F.col(previous_key).isNotNull()
    if mode == HEAT:
        comparable = comparable & (F.col(previous_key) > 0)
    return (
        placed.withColumn("previous_rank", F.when(comparable, F.col("_previous")))
        .withColumn("rank_change", F.col("previous_rank") - F.col("rank"))
        .drop("_previous")
    )


def ranked(daily: DataFrame, stocks: DataFrame, query: RankingQuery, turnover: DataFrame | None = None) -> DataFrame:
    """The whole ranking, not cut to the top rows."""
    return with_ranks(candidates(daily, stocks, query, turnover), query.mode)


def ranking(daily: DataFrame, stocks: DataFrame, query: RankingQuery, turnover: DataFrame | None = None) -> DataFrame:
    rows = ranked(daily, stocks, query, turnover)
    return rows if query.top is None else rows.where(F.col("rank") <= query.top)


def rank_lookup(rows: DataFrame, pinned: DataFrame) -> DataFrame:
    """Rank of pinned tickers over the full ranking; null when unranked."""
    return pinned.select("ticker").join(rows.select("ticker", "rank"), "ticker", "left")


def ranking_summary(
    daily: DataFrame,
    stocks: DataFrame,
    query: RankingQuery,
    turnover: DataFrame | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """One row about a ranking: status, periods, totals and counts."""
    n = query.period_days
    days = day_totals(turnover or daily) if days is None else days
    calendar = cal.trading_calendar(days, query.end_date)
    bucket = cal.period_bucket(F.col("age"), n)
    bounds = calendar.agg(
        F.count(F.lit(1)).cast("int").alias("date_count"),
        F.min(F.when(bucket == 0, F.col("trading_date"))).alias("current_start"),
        F.max(F.when(bucket == 0, F.col("trading_date"))).alias("current_end"),
        F.min(F.when(bucket == 1, F.col("trading_date"))).alias("previous_start"),
        F.max(F.when(bucket == 1, F.col("trading_date"))).alias("previous_end"),
    )
    counted = candidates(daily, stocks, query, days=days).agg(F.count(F.lit(1)).alias("ranked_count"))
    row = with_scalars(bounds, counted)
    row = with_scalars(row, market_totals(days, n, query.end_date).select("market_total"))
    row = with_scalars(row, stocks.agg(F.count(F.lit(1)).alias("stock_count")))
    enough = F.col("date_count") >= query.required_dates

    def if_enough(name: str) -> Column:
        return F.when(enough, F.col(name)).alias(name)

    return row.select(
        F.lit(n).alias("period_days"),
        F.lit(query.mode).alias("mode"),
        enough.alias("has_sufficient_data"),
        F.lit(query.required_dates).alias("required_dates"),
        "date_count",
        (F.col("date_count") >= 3 * n).alias("acceleration_available"),
        *[if_enough(c) for c in ("current_start", "current_end", "previous_start", "previous_end")],
        F.when(enough, F.col("market_total")).otherwise(F.lit(0)).alias("market_total"),
        F.when(enough, F.col("market_total").cast("double") / n).alias("market_daily_average"),
        "ranked_count",
        "stock_count",
    )


# --- many base dates at once -------------------------------------------------


#: Rows of tickers and date ages that a task holds.
GRID_ROWS = 1 << 19


def _grid_tasks(stocks: DataFrame, horizon: int) -> int:
    least = int(stocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(stocks.count() * horizon / GRID_ROWS))


def rolling_periods(
    daily: DataFrame,
    stocks: DataFrame,
    periods: tuple[int, ...] = cal.PERIOD_OPTIONS,
    dates: int = cal.SELECTABLE_DATES,
    days: DataFrame | None = None,
) -> DataFrame:
    """Statistics of every ticker for the newest ``dates`` base dates and all ``periods``.

    One shuffle by ticker.  Each ticker gets one row per date age, missing rows
    are zeros, and everything older than the oldest window shrinks to one row
    that only carries the last close.  Running sums and lags then give every
    period; their cost does not depend on its length.  Tickers are spread over so
    many tasks that none holds more than about ``GRID_ROWS`` rows, before they get
    a row per age: the securities alone are a small table, which is read by one task.
    """
    horizon = dates + 3 * max(periods) - 1
    base = cal.distinct_dates(daily if days is None else days)
    calendar = F.broadcast(cal.with_age(base).select("trading_date", "age", "n_dates"))
    n_dates = base.agg(F.count(F.lit(1)).cast("int").alias("n_dates"))

    recent = F.col("age") < horizon
    facts = daily.join(calendar, "trading_date").select(
        "ticker",
        F.least("age", F.lit(horizon)).alias("age"),
        F.when(recent, F.col("trading_value")).otherwise(F.lit(0)).alias("trading_value"),
        F.when(recent & (F.col("trading_value") > 0), 1).otherwise(0).alias("active"),
        "close_price",
        F.when(F.col("close_price").isNotNull(), F.col("trading_date")).alias("close_date"),
    )
    # What is older shrinks here, so the rows that travel by ticker are no more than the grid's.
    facts = facts.groupBy("ticker", "age").agg(
        F.sum("trading_value").alias("trading_value"),
        F.sum("active").alias("active"),
        F.max_by("close_price", "close_date").alias("close_price"),
        F.max("close_date").alias("close_date"),
    )
    tasks = _grid_tasks(stocks, horizon)
    grid = (
        with_scalars(stocks.select("ticker").repartition(tasks, "ticker"), n_dates)
        .select(
            "ticker",
            F.explode(F.sequence(F.lit(0), F.least("n_dates", F.lit(horizon)) - 1)).alias("age"),
        )
        .select(
            "ticker",
            "age",
            F.lit(0).cast("bigint").alias("trading_value"),
            F.lit(0).cast("bigint").alias("active"),
            F.lit(None).cast("decimal(10,2)").alias("close_price"),
            F.lit(None).cast("date").alias("close_date"),
        )
    )
    # (ticker, date) is unique in a daily panel, so no ticker has more rows than the calendar.
    dense = (
        facts.unionByName(grid)
        .repartition(tasks, "ticker")
        .groupBy("ticker", "age")
        .agg(
            F.sum("trading_value").alias("value"),
            F.sum("active").alias("active"),
            F.max_by("close_price", "close_date").alias("close"),
        )
    )

    by_age = W.partitionBy("ticker").orderBy(F.desc("age"))
    so_far = by_age.rowsBetween(W.unboundedPreceding, W.currentRow)
    running = (
        dense.withColumn("cum_value", F.sum("value").over(so_far))
        .withColumn("cum_active", F.sum("active").over(so_far))
        .withColumn("last_close", F.last("close", ignorenulls=True).over(so_far))
        .withColumn(
            "last_close_age", F.last(F.when(F.col("close").isNotNull(), F.col("age")), ignorenulls=True).over(so_far)
        )
        .withColumn("day_baseline", F.lag("last_close", 1).over(by_age))
    )

    # Ages that open a week, to carry the close known before its Monday.
    weeks = cal.with_age(base).select(
        "age",
        F.col("trading_date").alias("base_date"),
        "n_dates",
        F.coalesce(
            m.week_start(F.col("trading_date"))
            != m.week_start(F.lag("trading_date").over(W.orderBy("trading_date"))),
            F.lit(True),
        ).alias("opens_week"),
    )
    opening = F.when(F.col("opens_week"), F.struct(F.col("day_baseline").alias("close")))
    weekly = (
        running.join(F.broadcast(weeks), "age", "left")
        .withColumn("week_baseline", F.last(opening, ignorenulls=True).over(so_far)["close"])
    )

    # One look back per distinct distance, shared by the periods.
    state = F.struct("cum_value", "cum_active", "last_close")
    distances = sorted({k * n for n in periods for k in (1, 2, 3)})
    weekly = weekly.withColumns({f"_back{k}": F.lag(state, k).over(by_age) for k in distances})

    def back(k: int, name: str) -> Column:
        return F.coalesce(F.col(f"_back{k}")[name], F.lit(0))

    per_period = []
    for n in periods:
        prior = back(2 * n, "cum_value") - back(3 * n, "cum_value")
        per_period.append(
            F.struct(
                F.lit(n).alias("period_days"),
                (F.col("cum_value") - back(n, "cum_value")).alias("total"),
                (back(n, "cum_value") - back(2 * n, "cum_value")).alias("previous_total"),
                F.when(F.col("n_dates") - F.col("age") >= 3 * n, prior).otherwise(F.lit(0)).alias("prior_total"),
                (F.col("cum_active") - back(n, "cum_active")).cast("int").alias("active_days"),
                F.when(F.col("last_close_age") < F.col("age") + n, F.col("last_close")).alias("end_close"),
                F.col(f"_back{n}")["last_close"].alias("baseline_close"),
            )
        )
    stats = (
        weekly.withColumn("_periods", F.array(*per_period))
        .where(F.col("age") < dates)
        .select(
            "ticker",
            "base_date",
            "age",
            "n_dates",
            F.col("close").alias("day_close"),
            "day_baseline",
            "week_baseline",
            F.inline("_periods"),
        )
    )
    enough = F.col("n_dates") - F.col("age") >= 2 * F.col("period_days")
    return stats.where(enough & traded(F.col("total"), F.col("active_days"), F.col("end_close")))


def rolling_market_totals(
    days: DataFrame, periods: tuple[int, ...] = cal.PERIOD_OPTIONS, dates: int = cal.SELECTABLE_DATES
) -> DataFrame:
    """Market totals per base date and period, from the totals of each date."""
    newest_first = W.orderBy("trading_date")
    running = newest_first.rowsBetween(W.unboundedPreceding, W.currentRow)
    aged = (
        cal.with_age(days.select("trading_date", F.col("trading_value").alias("_day")))
        .withColumn("_cum", F.sum(F.col("_day").cast("decimal(38,0)")).over(running))
    )

    def cum(by: int) -> Column:
        return F.coalesce(F.lag("_cum", by).over(newest_first), F.lit(0).cast("decimal(38,0)"))

    packed = F.array(
        *[
            F.struct(
                F.lit(n).alias("period_days"),
                (F.col("_cum") - cum(n)).alias("market_total"),
                (cum(n) - cum(2 * n)).alias("previous_market_total"),
            )
            for n in periods
        ]
    )
    return (
        aged.withColumn("_periods", packed)
        .where(F.col("age") < dates)
        .select(F.col("trading_date").alias("base_date"), F.inline("_periods"))
    )


def ranking_all_dates(
    daily: DataFrame,
    stocks: DataFrame,
    periods: tuple[int, ...] = cal.PERIOD_OPTIONS,
    dates: int = cal.SELECTABLE_DATES,
    ranks: bool = True,
    turnover: DataFrame | None = None,
) -> DataFrame:
    """Unfiltered rankings of every selectable date and period in one job."""
    market_days = day_totals(turnover or daily)
    stats = rolling_periods(daily, stocks, periods, dates, market_days)
    totals = rolling_market_totals(market_days, periods, dates)
    n = F.col("period_days")
    rows = (
        stats.join(F.broadcast(totals), ["base_date", "period_days"])
        .join(stocks.select("ticker", "name", "market"), "ticker")
        .withColumn("average_value", F.col("total").cast("double") / n)
        .withColumn("previous_average_value", F.col("previous_total").cast("double") / n)
        .withColumn("change_rate", m.turnover_growth(F.col("total"), F.col("previous_total")))
        .withColumn("previous_change_rate", m.turnover_growth(F.col("previous_total"), F.col("prior_total")))
        .withColumn("price_change", m.price_growth(F.col("end_close"), F.col("baseline_close")))
        .withColumn("daily_price_change", m.price_growth(F.col("day_close"), F.col("day_baseline")))
        .withColumn("weekly_price_change", m.price_growth(F.col("day_close"), F.col("week_baseline")))
        .withColumn("share", m.share(F.col("total"), F.col("market_total")))
        .withColumn("previous_share", m.share(F.col("previous_total"), F.col("previous_market_total")))
        .withColumn("share_change", F.col("share") - F.col("previous_share"))
    )
    if not ranks:
        return rows
    return with_ranks(rows, HEAT, ("base_date", "period_days"))
