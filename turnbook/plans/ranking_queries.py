"""Ranking queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from turnbook.functions import measures as m
from turnbook.operators import browse, calendar as cal, ranking as r, quotes as qt
from turnbook.operators.ranks import with_position
from turnbook.plans import base_sql as b
from turnbook.plans.registry import query, shape
from turnbook.sources import driver_tables as d

END = dt.date(2001, 6, 29)
ENDS = END.isoformat()
N = 20
MINIMUM = 500_000

HEAT = r.RankingQuery(period_days=N, end_date=END, min_average=MINIMUM)
ACCELERATION = r.RankingQuery(period_days=N, end_date=END, min_average=MINIMUM, mode=r.ACCELERATION)

RANK_SPEC = (
    "rank:l previous_rank:l rank_change:l ticker name market average_value:r4 previous_average_value:r4 "
    "change_rate:r6 previous_change_rate:r6 share:r8 previous_share:r8 share_change:r8 price_change:r6 "
    "daily_price_change:r6 weekly_price_change:r6 week_baseline:d close=end_close:d active_days:l"
)
RANK_SQL = """
SELECT "rank", previous_rank, rank_change, ticker, name, market, round(average_value, 4) AS average_value,
       round(previous_average_value, 4) AS previous_average_value, round(change_rate, 6) AS change_rate,
       round(previous_change_rate, 6) AS previous_change_rate, round(share, 8) AS share,
       round(previous_share, 8) AS previous_share, round(share - previous_share, 8) AS share_change,
       round(price_change, 6) AS price_change, round(daily_price_change, 6) AS daily_price_change,
       round(weekly_price_change, 6) AS weekly_price_change, week_base_c / 100.0::DOUBLE AS week_baseline,
       end_c / 100.0::DOUBLE AS "close", active_days
FROM ranked"""


def _ctes(mode="heat", market="all", minimum=MINIMUM, end=ENDS, n=N):
    return "WITH " + b.ranking_ctes(n, end, mode, market, minimum)


@query("ranking_heat", _ctes() + RANK_SQL + ' WHERE "rank" <= 100')
def ranking_heat(spark, sf):
    return shape(r.ranking(d.daily(spark, sf), d.securities(spark, sf), HEAT, d.turnover(spark, sf)), RANK_SPEC)


@query("ranking_acceleration", _ctes("acceleration") + RANK_SQL + ' WHERE "rank" <= 100')
def ranking_acceleration(spark, sf):
    return shape(r.ranking(d.daily(spark, sf), d.securities(spark, sf), ACCELERATION, d.turnover(spark, sf)), RANK_SPEC)


def _summary_sql(mode, n, end, minimum):
    need = n * (3 if mode == "acceleration" else 2)
    return "WITH " + b.ranking_ctes(n, end, mode, "all", minimum) + f""",
bounds AS (
  SELECT count(*) AS date_count, min(trading_date) FILTER (WHERE age < {n}) AS cs, max(trading_date) FILTER (WHERE age < {n}) AS ce,
         min(trading_date) FILTER (WHERE age >= {n} AND age < {2 * n}) AS ps,
         max(trading_date) FILTER (WHERE age >= {n} AND age < {2 * n}) AS pe
  FROM cal)
SELECT {n}::BIGINT AS period_days, '{mode}' AS mode, date_count >= {need} AS has_sufficient_data, {need}::BIGINT AS required_dates,
       date_count, date_count >= {3 * n} AS acceleration_available,
       CASE WHEN date_count >= {need} THEN cs END AS current_start, CASE WHEN date_count >= {need} THEN ce END AS current_end,
       CASE WHEN date_count >= {need} THEN ps END AS previous_start, CASE WHEN date_count >= {need} THEN pe END AS previous_end,
       CAST(CASE WHEN date_count >= {need} THEN (SELECT market_total FROM totals) ELSE 0 END AS BIGINT) AS market_total,
       round(CASE WHEN date_count >= {need} THEN (SELECT market_total FROM totals)::DOUBLE / {n} END, 4) AS market_daily_average,
       (SELECT count(*) FROM cand) AS ranked_count, (SELECT count(*) FROM stocks) AS stock_count
FROM bounds"""


SUMMARY_SPEC = (
    "period_days:l mode has_sufficient_data required_dates:l date_count:l acceleration_available current_start "
    "current_end previous_start previous_end market_total:l market_daily_average:r4 ranked_count:l stock_count:l"
)


@query(
    "ranking_summary",
    _summary_sql("heat", N, ENDS, MINIMUM).replace("WITH", "SELECT * FROM (WITH", 1)
    + ") UNION ALL SELECT * FROM ("
    + _summary_sql("acceleration", 900, ENDS, 0)
    + ")",
)
def ranking_summary(spark, sf):
    """A ranking that has enough dates, and one that has not."""
    daily, stocks, trades = d.daily(spark, sf), d.securities(spark, sf), d.turnover(spark, sf)
    short = r.RankingQuery(period_days=900, end_date=END, mode=r.ACCELERATION, min_average=0)
    days = r.day_totals(trades)
    both = r.ranking_summary(daily, stocks, HEAT, days=days).unionByName(r.ranking_summary(daily, stocks, short, days=days))
    return shape(both, SUMMARY_SPEC)


PRICE_SPEC = (
    "ticker price_change:r6 daily_price_change:r6 weekly_price_change:r6 close=end_close:d day_close:d "
    "period_baseline=baseline_close:d day_baseline:d week_baseline:d"
)


@query("price_changes", _ctes(minimum=0) + """
SELECT ticker, round(price_change, 6) AS price_change, round(daily_price_change, 6) AS daily_price_change,
       round(weekly_price_change, 6) AS weekly_price_change, end_c / 100.0::DOUBLE AS "close", day_c / 100.0::DOUBLE AS day_close,
       base_c / 100.0::DOUBLE AS period_baseline, day_base_c / 100.0::DOUBLE AS day_baseline,
       week_base_c / 100.0::DOUBLE AS week_baseline
FROM cand""")
def price_changes(spark, sf):
    everything = r.RankingQuery(period_days=N, end_date=END, min_average=0)
    return shape(r.candidates(d.daily(spark, sf), d.securities(spark, sf), everything, d.turnover(spark, sf)), PRICE_SPEC)


# --- steps of the ranking ----------------------------------------------------


@query("filter_as_of", "WITH " + b.BARS + f"""
SELECT ticker, trading_date, trading_value, close_c / 100.0::DOUBLE AS close_price FROM bars WHERE trading_date <= DATE '{ENDS}'""")
def filter_as_of(spark, sf):
    return shape(cal.as_of(d.daily(spark, sf), END), "ticker trading_date trading_value close_price:d")


@query("filter_market", _ctes(market="TPEX") + RANK_SQL)
def filter_market(spark, sf):
    only = r.RankingQuery(period_days=N, end_date=END, min_average=MINIMUM, market="TPEX", top=None)
    return shape(r.ranking(d.daily(spark, sf), d.securities(spark, sf), only, d.turnover(spark, sf)), RANK_SPEC)


@query("filter_threshold", _ctes(minimum=2_000_000) + RANK_SQL)
def filter_threshold(spark, sf):
    high = r.RankingQuery(period_days=N, end_date=END, min_average=2_000_000, top=None)
    return shape(r.ranking(d.daily(spark, sf), d.securities(spark, sf), high, d.turnover(spark, sf)), RANK_SPEC)


@query("period_windows", "WITH " + b.BARS + f""",
cal AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date DESC) - 1 AS age, count(*) OVER () AS n_dates
        FROM (SELECT DISTINCT trading_date FROM bars WHERE trading_date <= DATE '{ENDS}'))
SELECT age // {N} AS bucket, min(trading_date) AS period_start, max(trading_date) AS period_end, count(*) AS days,
       count(*) = {N} AS complete
FROM cal WHERE age < {3 * N} GROUP BY 1""")
def period_windows(spark, sf):
    return shape(cal.period_windows(d.daily(spark, sf), N, END), "bucket:l period_start period_end days:l complete")


@query("agg_period_stats", _ctes() + """
SELECT ticker, CAST(total AS BIGINT) AS total, CAST(previous_total AS BIGINT) AS previous_total, CAST(prior_total AS BIGINT) AS prior_total,
       round(total / 20.0::DOUBLE, 4) AS average_value, active_days, end_c / 100.0::DOUBLE AS end_close, base_c / 100.0::DOUBLE AS baseline_close
FROM stats WHERE NOT (total = 0 AND active_days = 0 AND end_c IS NULL)""")
def agg_period_stats(spark, sf):
    stats = r.period_stats(d.daily(spark, sf), N, END)
    kept = stats.where(r.traded(F.col("total"), F.col("active_days"), F.col("end_close")))
    return shape(
        kept.withColumn("average_value", r.average("total", N)),
        "ticker total previous_total prior_total average_value:r4 active_days:l end_close:d baseline_close:d",
    )


@query("agg_market_total", _ctes() + """
SELECT CAST(market_total AS BIGINT) AS market_total, CAST(previous_market_total AS BIGINT) AS previous_market_total FROM totals""")
def agg_market_total(spark, sf):
    return shape(r.market_totals(d.turnover(spark, sf), N, END), "market_total:l previous_market_total:l")


@query("market_share", _ctes() + """
SELECT ticker, round(share, 8) AS share, round(previous_share, 8) AS previous_share, round(share - previous_share, 8) AS share_change
FROM cand""")
def market_share(spark, sf):
    rows = r.candidates(d.daily(spark, sf), d.securities(spark, sf), HEAT, d.turnover(spark, sf))
    return shape(rows, "ticker share:r8 previous_share:r8 share_change:r8")


@query("join_stock_dim", _ctes(minimum=0) + """
SELECT s.ticker, k.name, k.market, CAST(total AS BIGINT) AS total FROM stats s JOIN stocks k USING (ticker)""")
def join_stock_dim(spark, sf):
    stats = r.period_stats(d.daily(spark, sf), N, END)
    return shape(stats.join(d.securities(spark, sf), "ticker"), "ticker name market total")


@query("join_period_stats", _ctes(minimum=0) + """
SELECT ticker, round(total / 20.0::DOUBLE, 4) AS average_value, round(previous_total / 20.0::DOUBLE, 4) AS previous_average_value,
       round(prior_total / 20.0::DOUBLE, 4) AS prior_average_value,
       round(CASE WHEN previous_total <> 0 THEN (total - previous_total)::DOUBLE / previous_total::DOUBLE END, 6) AS change_rate,
       round(CASE WHEN prior_total <> 0 THEN (previous_total - prior_total)::DOUBLE / prior_total::DOUBLE END, 6) AS previous_change_rate
FROM stats""")
def join_period_stats(spark, sf):
    rows = r.with_measures(r.period_stats(d.daily(spark, sf), N, END), N)
    return shape(
        rows,
        "ticker average_value:r4 previous_average_value:r4 prior_average_value:r4 change_rate:r6 previous_change_rate:r6",
    )


@query("asof_baseline_close", _ctes(minimum=0) + """
SELECT ticker, base_c / 100.0::DOUBLE AS period_baseline, day_base_c / 100.0::DOUBLE AS day_baseline,
       week_base_c / 100.0::DOUBLE AS week_baseline
FROM stats""")
def asof_baseline_close(spark, sf):
    stats = r.period_stats(d.daily(spark, sf), N, END)
    return shape(stats, "ticker period_baseline=baseline_close:d day_baseline:d week_baseline:d")


@query("rank_rows", _ctes("acceleration", minimum=0) + """
SELECT ticker, round(change_rate, 6) AS change_rate, "rank" FROM ranked""")
def rank_rows(spark, sf):
    everything = r.RankingQuery(period_days=N, end_date=END, min_average=0, mode=r.ACCELERATION)
    rows = with_position(r.candidates(d.daily(spark, sf), d.securities(spark, sf), everything, d.turnover(spark, sf)), "change_rate", "rank")
    return shape(rows, "ticker change_rate:r6 rank:l")


@query("rank_previous", _ctes(minimum=0) + "SELECT ticker, previous_rank FROM ranked")
def rank_previous(spark, sf):
    everything = r.RankingQuery(period_days=N, end_date=END, min_average=0)
    return shape(r.ranked(d.daily(spark, sf), d.securities(spark, sf), everything, d.turnover(spark, sf)), "ticker previous_rank:l")


@query("rank_change", _ctes("acceleration", minimum=0) + 'SELECT ticker, "rank", previous_rank, rank_change FROM ranked')
def rank_change(spark, sf):
    everything = r.RankingQuery(period_days=N, end_date=END, min_average=0, mode=r.ACCELERATION)
    rows = r.ranked(d.daily(spark, sf), d.securities(spark, sf), everything, d.turnover(spark, sf))
    return shape(rows, "ticker rank:l previous_rank:l rank_change:l")


@query("topn_ranking", _ctes(minimum=0) + """
SELECT "rank", ticker, round(average_value, 4) AS average_value, (SELECT count(*) FROM cand) AS candidate_count
FROM ranked WHERE "rank" <= 25""")
def topn_ranking(spark, sf):
    """A top-k report together with the number of candidates behind it."""
    everything = r.RankingQuery(period_days=N, end_date=END, min_average=0, top=25)
    daily, stocks, trades = d.daily(spark, sf), d.securities(spark, sf), d.turnover(spark, sf)
    count = r.candidates(daily, stocks, everything, trades).agg(F.count(F.lit(1)).alias("candidate_count"))
    return shape(
        r.with_scalars(r.ranking(daily, stocks, everything, trades), count), "rank:l ticker average_value:r4 candidate_count:l"
    )


@query("rank_lookup", _ctes(minimum=MINIMUM) + """
SELECT l.ticker, r."rank" FROM listing l LEFT JOIN ranked r ON l.ticker = r.ticker""")
def rank_lookup(spark, sf):
    """Every supplier is pinned; those without a listing or below the threshold stay unranked."""
    pinned = d.table(spark, sf, "supplier").select(d.ticker_of(F.col("s_suppkey")).alias("ticker"))
    rows = r.ranked(d.daily(spark, sf), d.securities(spark, sf), HEAT, d.turnover(spark, sf))
    return shape(r.rank_lookup(rows, pinned), "ticker rank:l")


@query("sort_by_column", _ctes(minimum=0) + """
SELECT ticker, round(daily_price_change, 6) AS daily_price_change, row_number() OVER (ORDER BY daily_price_change ASC NULLS LAST, ticker) AS position
FROM ranked""")
def sort_by_column(spark, sf):
    """Ascending with nulls last; the position shows the order in an unordered comparison."""
    everything = r.RankingQuery(period_days=N, end_date=END, min_average=0)
    stocks = d.securities(spark, sf)
    rows = r.candidates(d.daily(spark, sf), stocks, everything, d.turnover(spark, sf))
    placed = with_position(rows, "daily_price_change", "position", descending=False)
    ordered = browse.sort_by(placed, "daily_price_change", descending=False)
    return shape(ordered, "ticker daily_price_change:r6 position:l")


@query("page_rows", _ctes(minimum=0) + """,
numbered AS (
  SELECT ticker, average_value, row_number() OVER (ORDER BY average_value DESC NULLS LAST, ticker) AS position,
         least(2, greatest(1, ceil(count(*) OVER () / 40.0))) AS page
  FROM ranked)
SELECT ticker, round(average_value, 4) AS average_value FROM numbered
WHERE position > (page - 1) * 40 AND position <= page * 40""")
def page_rows(spark, sf):
    """The second page, or the last one where there are fewer."""
    everything = r.RankingQuery(period_days=N, end_date=END, min_average=0)
    rows = r.candidates(d.daily(spark, sf), d.securities(spark, sf), everything, d.turnover(spark, sf))
    return shape(browse.page(rows, 2, "average_value", size=40), "ticker average_value:r4")


@query("distinct_dates", "WITH " + b.LINES + "SELECT DISTINCT trading_date FROM lines")
def distinct_dates(spark, sf):
    return cal.distinct_dates(d.daily(spark, sf)).orderBy("trading_date")


@query("selectable_dates", "WITH " + b.LINES + "SELECT DISTINCT trading_date FROM lines ORDER BY 1 DESC LIMIT 120")
def selectable_dates(spark, sf):
    return cal.selectable_dates(d.daily(spark, sf))


@query("cross_dates_periods", "WITH " + b.LINES + """,
days AS (SELECT DISTINCT trading_date FROM lines ORDER BY 1 DESC LIMIT 120)
SELECT trading_date, p AS period_days FROM days, (SELECT unnest([1, 5, 10, 20, 60])::BIGINT AS p)""")
def cross_dates_periods(spark, sf):
    return shape(cal.cross_dates_periods(d.daily(spark, sf)), "trading_date period_days:l")


@query("trading_active", "WITH " + b.QUOTES + "," + b.NON_REGULAR + """
SELECT q.ticker, q.trading_date, greatest(trading_value - coalesce(excluded_value, 0), 0) > 0 AS active
FROM quotes q LEFT JOIN excluded x USING (ticker, trading_date)""")
def trading_active(spark, sf):
    regular = qt.regular_only(d.daily_quotes(spark, sf), qt.sum_non_regular(d.non_regular(spark, sf)))
    return regular.select("ticker", "trading_date", (F.col("trading_value") > 0).alias("active"))


@query("safe_growth", _ctes(minimum=0) + """
SELECT ticker, round(CASE WHEN prior_total <> 0 THEN (previous_total - prior_total)::DOUBLE / prior_total::DOUBLE END, 6) AS turnover_growth,
       round(CASE WHEN base_c > 0 THEN (end_c - base_c)::DOUBLE / base_c END, 6) AS price_growth
FROM stats""")
def safe_growth(spark, sf):
    stats = r.period_stats(d.daily(spark, sf), N, END)
    return stats.select(
        "ticker",
        F.round(m.turnover_growth(F.col("previous_total"), F.col("prior_total")), 6).alias("turnover_growth"),
        F.round(m.price_growth(F.col("end_close"), F.col("baseline_close")), 6).alias("price_growth"),
    )


# --- all dates and periods at once -------------------------------------------

ALL_DATES = "WITH " + b.BARS + "," + b.LISTING + """,
cal AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date DESC) - 1 AS age, count(*) OVER () AS n_dates
        FROM (SELECT DISTINCT trading_date FROM bars)),
aged AS (SELECT b.*, age FROM bars b JOIN cal USING (trading_date)),
spans AS (
  SELECT c.trading_date AS base_date, c.age AS base_age, p AS n, c.n_dates - c.age AS past, f.trading_date AS first_date
  FROM cal c CROSS JOIN (SELECT unnest([1, 5, 10, 20, 60]) AS p) JOIN cal f ON f.age = c.age + p - 1
  WHERE c.age < 120 AND c.n_dates - c.age >= 2 * p),
sums AS (
  SELECT s.base_date, s.n, a.ticker, any_value(s.first_date) AS first_date,
         coalesce(sum(trading_value) FILTER (WHERE a.age < s.base_age + s.n), 0) AS total,
         coalesce(sum(trading_value) FILTER (WHERE a.age >= s.base_age + s.n AND a.age < s.base_age + 2 * s.n), 0) AS previous_total,
         coalesce(sum(trading_value) FILTER (WHERE a.age >= s.base_age + 2 * s.n AND past >= 3 * s.n), 0) AS prior_total,
         count(*) FILTER (WHERE a.age < s.base_age + s.n AND trading_value > 0) AS active_days,
         arg_max(close_c, trading_date) FILTER (WHERE a.age < s.base_age + s.n AND close_c IS NOT NULL) AS end_c,
         max(close_c) FILTER (WHERE a.age = s.base_age) AS day_c
  FROM spans s JOIN aged a ON a.age >= s.base_age AND a.age < s.base_age + 3 * s.n
  GROUP BY s.base_date, s.n, a.ticker
  HAVING NOT (total = 0 AND active_days = 0 AND end_c IS NULL)),
closes AS (SELECT ticker, trading_date, close_c FROM bars WHERE close_c IS NOT NULL),
totals AS (SELECT base_date, n, sum(total) AS market_total, sum(previous_total) AS previous_market_total
           FROM (SELECT s.base_date, s.n,
                        sum(trading_value) FILTER (WHERE a.age < s.base_age + s.n) AS total,
                        sum(trading_value) FILTER (WHERE a.age >= s.base_age + s.n) AS previous_total
                 FROM spans s JOIN aged a ON a.age >= s.base_age AND a.age < s.base_age + 2 * s.n GROUP BY s.base_date, s.n)
           GROUP BY 1, 2),
w1 AS (SELECT x.*, c.close_c AS base_c FROM sums x ASOF LEFT JOIN closes c ON x.ticker = c.ticker AND x.first_date > c.trading_date),
w2 AS (SELECT x.*, c.close_c AS day_base_c FROM w1 x ASOF LEFT JOIN closes c ON x.ticker = c.ticker AND x.base_date > c.trading_date),
w3 AS (SELECT x.*, CAST(date_trunc('week', base_date) AS DATE) AS monday FROM w2 x),
w4 AS (SELECT x.*, c.close_c AS week_base_c FROM w3 x ASOF LEFT JOIN closes c ON x.ticker = c.ticker AND x.monday > c.trading_date),
rows_ AS (
  SELECT w4.*, name, market, market_total, previous_market_total,
         total / n::DOUBLE AS average_value, previous_total / n::DOUBLE AS previous_average_value,
         CASE WHEN previous_total <> 0 THEN (total - previous_total)::DOUBLE / previous_total::DOUBLE END AS change_rate,
         CASE WHEN prior_total <> 0 THEN (previous_total - prior_total)::DOUBLE / prior_total::DOUBLE END AS previous_change_rate,
         CASE WHEN base_c > 0 THEN (end_c - base_c)::DOUBLE / base_c END AS price_change,
         CASE WHEN day_base_c > 0 THEN (day_c - day_base_c)::DOUBLE / day_base_c END AS daily_price_change,
         CASE WHEN week_base_c > 0 THEN (day_c - week_base_c)::DOUBLE / week_base_c END AS weekly_price_change,
         CASE WHEN market_total = 0 THEN 0.0::DOUBLE ELSE total::DOUBLE / market_total::DOUBLE END AS share,
         CASE WHEN previous_market_total = 0 THEN 0.0::DOUBLE
              ELSE previous_total::DOUBLE / previous_market_total::DOUBLE END AS previous_share
  FROM w4 JOIN totals USING (base_date, n) JOIN stocks USING (ticker))"""


@query("rolling_period_all_dates", ALL_DATES + """
SELECT base_date, n::BIGINT AS period_days, ticker, CAST(total AS BIGINT) AS total, CAST(previous_total AS BIGINT) AS previous_total,
       CAST(prior_total AS BIGINT) AS prior_total, active_days, end_c / 100.0::DOUBLE AS end_close, base_c / 100.0::DOUBLE AS baseline_close,
       day_c / 100.0::DOUBLE AS day_close, day_base_c / 100.0::DOUBLE AS day_baseline, week_base_c / 100.0::DOUBLE AS week_baseline
FROM rows_""")
def rolling_period_all_dates(spark, sf):
    stocks = d.securities(spark, sf)
    daily = d.daily(spark, sf)
    # Unlisted shares count for the calendar alone.
    rows = r.rolling_periods(daily.join(stocks.select("ticker"), "ticker", "left_semi"), stocks, days=daily)
    return shape(
        rows,
        "base_date period_days:l ticker total previous_total prior_total active_days:l end_close:d baseline_close:d "
        "day_close:d day_baseline:d week_baseline:d",
    )


@query("ranking_full_export", ALL_DATES + """
SELECT base_date, n::BIGINT AS period_days, row_number() OVER (PARTITION BY base_date, n ORDER BY average_value DESC, ticker) AS "rank",
       CASE WHEN previous_average_value > 0
            THEN row_number() OVER (PARTITION BY base_date, n ORDER BY previous_average_value DESC, ticker) END AS previous_rank,
       ticker, name, market, round(average_value, 4) AS average_value, round(previous_average_value, 4) AS previous_average_value,
       round(change_rate, 6) AS change_rate, round(previous_change_rate, 6) AS previous_change_rate, round(share, 8) AS share,
       round(share - previous_share, 8) AS share_change, round(price_change, 6) AS price_change,
       round(daily_price_change, 6) AS daily_price_change, round(weekly_price_change, 6) AS weekly_price_change,
       week_base_c / 100.0::DOUBLE AS week_baseline, end_c / 100.0::DOUBLE AS "close", active_days
FROM rows_""")
def ranking_full_export(spark, sf):
    rows = r.ranking_all_dates(d.daily(spark, sf), d.securities(spark, sf), turnover=d.turnover(spark, sf))
    return shape(
        rows,
        "base_date period_days:l rank:l previous_rank:l ticker name market average_value:r4 previous_average_value:r4 "
        "change_rate:r6 previous_change_rate:r6 share:r8 share_change:r8 price_change:r6 daily_price_change:r6 "
        "weekly_price_change:r6 week_baseline:d close=end_close:d active_days:l",
    )
