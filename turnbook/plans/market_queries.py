"""Queries on daily quotes, bars, revenue, indices, flags, and data quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from turnbook.functions import measures as m, parsing as p
from turnbook.operators import (
    browse,
    flags as fl,
    indices as ix,
    kline as kl,
    quality as ql,
    quotes as qt,
    ranking as r,
    revenue as rv,
)
from turnbook.plans import base_sql as b
from turnbook.plans.ranking_queries import END, ENDS, N, _ctes
from turnbook.plans.registry import query, shape
from turnbook.sources import driver_tables as d

QUOTE_SPEC = (
    "market ticker name trading_date open_price:d high_price:d low_price:d close_price:d trading_value "
    "trading_volume transaction_count:l"
)
REVENUE_DAY = dt.date(2001, 2, 5)
MONTH = rv.eligible_month_of(REVENUE_DAY)
FLAG_DAY = dt.date(1998, 6, 15)
FLAG_DAYS = FLAG_DAY.isoformat()


# --- filters -----------------------------------------------------------------


@query("filter_common_stock", "SELECT part AS code FROM (SELECT CAST(p_partkey AS VARCHAR) AS part FROM part UNION ALL"
       " SELECT CAST(p_partkey + 1000 AS VARCHAR) || CASE WHEN p_size > 25 THEN 'L' ELSE '' END FROM part"
       " UNION ALL SELECT CASE WHEN p_size > 10 THEN '' END FROM part)"
       " WHERE regexp_full_match(part, '[1-9][0-9]{3}')")
def filter_common_stock(spark, sf):
    """Candidate codes of all lengths, with letters, blanks and nulls among them."""
    part = d.table(spark, sf, "part")
    key = F.col("p_partkey")
    codes = (
        part.select(key.cast("string").alias("code"))
        .union(part.select(F.concat((key + 1000).cast("string"), F.when(F.col("p_size") > 25, "L").otherwise(""))))
        .union(part.select(F.when(F.col("p_size") > 10, F.lit(""))))
    )
    return codes.where(p.is_common_stock(F.col("code")))


@query("filter_search", "WITH " + b.LISTING + """
SELECT ticker, s_name AS name FROM listing WHERE contains(lower(ticker), '07') OR contains(lower(s_name), '07')""")
def filter_search(spark, sf):
    rows = d.listing(spark, sf).select(d.ticker_of(F.col("s_suppkey")).alias("ticker"), F.col("s_name").alias("name"))
    return rows.where(browse.matches_search("  07 ", "ticker", "name"))


FLAG_CTES = b.NOTICES + "," + b.ALTERED + f""",
active AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY "end" DESC, source_order) AS n
                 FROM notices WHERE DATE '{FLAG_DAYS}' BETWEEN start AND "end") WHERE n = 1),
flags AS (
  SELECT coalesce(a.ticker, x.ticker) AS ticker,
         strftime(start, '%Y/%m/%d') || ' ~ ' || strftime("end", '%Y/%m/%d') AS disposition_period,
         matching_minutes, x.ticker IS NOT NULL AS altered_trading
  FROM active a FULL OUTER JOIN altered x ON a.ticker = x.ticker)"""


def _flags(spark, sf):
    active = fl.latest_dispositions(d.dispositions(spark, sf), FLAG_DAY)
    return fl.market_flags(active, d.altered(spark, sf))


@query("filter_status_any", "WITH " + b.QUOTES + "," + FLAG_CTES + """
SELECT ticker, trading_date, trading_value FROM quotes
WHERE ticker IN (SELECT ticker FROM flags WHERE disposition_period IS NOT NULL OR altered_trading)""")
def filter_status_any(spark, sf):
    rows = browse.status_any(d.daily_quotes(spark, sf), _flags(spark, sf), disposition=True, full_delivery=True)
    return shape(rows, "ticker trading_date trading_value")


@query("latest_disposition", "WITH " + FLAG_CTES + """
SELECT ticker, start, "end", matching_minutes::BIGINT AS matching_minutes FROM active""")
def latest_disposition(spark, sf):
    return shape(
        fl.latest_dispositions(d.dispositions(spark, sf), FLAG_DAY), "ticker start end matching_minutes:l"
    )


FLAG_SQL = "WITH " + FLAG_CTES + """
SELECT ticker, disposition_period, matching_minutes::BIGINT AS matching_minutes, altered_trading FROM flags"""


@query("market_flags", FLAG_SQL)
def market_flags(spark, sf):
    return shape(_flags(spark, sf), "ticker disposition_period matching_minutes:l altered_trading")


@query("join_flags_full", "WITH " + FLAG_CTES + """
SELECT coalesce(a.ticker, x.ticker) AS ticker, a.ticker IS NOT NULL AS disposed, x.ticker IS NOT NULL AS altered_trading
FROM notices a FULL OUTER JOIN altered x ON a.ticker = x.ticker GROUP BY ALL""")
def join_flags_full(spark, sf):
    """Every ticker that ever had a notice, joined with full delivery."""
    ever = fl.latest_dispositions(
        d.dispositions(spark, sf).withColumn("end", F.lit(FLAG_DAY)).withColumn("start", F.lit(FLAG_DAY)), FLAG_DAY
    )
    return fl.market_flags(ever, d.altered(spark, sf)).select(
        "ticker", F.col("disposition_period").isNotNull().alias("disposed"), "altered_trading"
    )


@query("union_flag_tickers", "WITH " + FLAG_CTES + "SELECT ticker FROM active UNION SELECT ticker FROM altered")
def union_flag_tickers(spark, sf):
    return fl.flagged_tickers(
        fl.latest_dispositions(d.dispositions(spark, sf), FLAG_DAY), d.altered(spark, sf)
    )


# --- quotes ------------------------------------------------------------------


@query("agg_non_regular", "WITH " + b.LINES + "," + b.NON_REGULAR + "SELECT * FROM excluded")
def agg_non_regular(spark, sf):
    return qt.sum_non_regular(d.non_regular(spark, sf))


REGULAR = "WITH " + b.QUOTES + "," + b.NON_REGULAR + """,
regular AS (
  SELECT q.* REPLACE (CAST(greatest(trading_value - coalesce(excluded_value, 0), 0) AS BIGINT) AS trading_value,
                      CAST(greatest(trading_volume - coalesce(excluded_volume, 0), 0) AS BIGINT) AS trading_volume)
  FROM quotes q LEFT JOIN excluded x USING (ticker, trading_date))"""


def _regular(spark, sf):
    return qt.regular_only(d.daily_quotes(spark, sf), qt.sum_non_regular(d.non_regular(spark, sf)))


@query("join_regular_only", REGULAR + "SELECT * FROM regular")
def join_regular_only(spark, sf):
    return shape(_regular(spark, sf), QUOTE_SPEC)


@query("join_merge_bars", "WITH " + b.QUOTES + """,
bare AS (SELECT ticker, trading_date, name, close_price, trading_value, trading_volume FROM quotes),
found AS (SELECT ticker, trading_date, open_price, high_price, low_price FROM quotes WHERE transaction_count > 1)
SELECT b.*, open_price, high_price, low_price FROM bare b LEFT JOIN found USING (ticker, trading_date)""")
def join_merge_bars(spark, sf):
    """Quotes stored without bars, filled from a download that has some of them."""
    full = d.daily_quotes(spark, sf)
    empty = F.lit(None).cast("decimal(10,2)")
    stored = full.withColumn("open_price", empty).withColumn("high_price", empty).withColumn("low_price", empty)
    merged = qt.merge_bars(stored, full.where("transaction_count > 1"))
    return shape(
        merged,
        "ticker trading_date name close_price:d trading_value trading_volume open_price:d high_price:d low_price:d",
    )


@query("join_merge_indices", "WITH " + b.LINES + "," + b.INDEX + """,
days AS (SELECT DISTINCT trading_date FROM lines)
SELECT trading_date, CASE WHEN count(market) > 0 THEN 1 ELSE 0 END AS index_version,
       max(value_c) FILTER (market = 'TWSE') / 100.0::DOUBLE AS twse, max(value_c) FILTER (market = 'TPEX') / 100.0::DOUBLE AS tpex
FROM days LEFT JOIN idx USING (trading_date) GROUP BY 1""")
def join_merge_indices(spark, sf):
    """Dates stored without index rows get those of their date, and a higher index version."""
    entry = "array<struct<market:string,value:decimal(20,2)>>"
    stored = d.daily(spark, sf).select("trading_date").distinct().select(
        "trading_date",
        F.array().cast(entry).alias("market_indices"),
        F.lit(0).alias("market_index_schema_version"),
    )
    # Two markets: the list has at most two entries per date.
    found = d.market_index(spark, sf).groupBy("trading_date").agg(
        F.collect_list(F.struct("market", "value")).alias("market_indices")
    )
    merged = qt.merge_indices(stored, found, 1)

    def of(market):
        return F.get(F.filter("market_indices", lambda x: x["market"] == market), F.lit(0))["value"].cast("double")

    return merged.select(
        "trading_date",
        F.col("market_index_schema_version").alias("index_version"),
        of("TWSE").alias("twse"),
        of("TPEX").alias("tpex"),
    )


@query("latest_dimension", "WITH " + b.QUOTES + """
SELECT ticker, arg_max(name, trading_date) AS name, arg_max(market, trading_date) AS market FROM quotes GROUP BY ticker""")
def latest_dimension(spark, sf):
    return qt.latest_dimension(d.daily_quotes(spark, sf))


@query("semi_known_security", "WITH " + b.QUOTES + """
SELECT ticker, trading_date, trading_value FROM quotes WHERE ticker IN (SELECT ticker FROM stocks)""")
def semi_known_security(spark, sf):
    return qt.known_only(
        d.daily(spark, sf).select("ticker", "trading_date", "trading_value"), d.securities(spark, sf)
    )


@query("view_daily", "WITH " + b.QUOTES + """
SELECT q.trading_date, q.ticker, k.name, k.market, close_price, trading_value, trading_volume, transaction_count
FROM quotes q JOIN stocks k USING (ticker)""")
def view_daily(spark, sf):
    return shape(
        qt.daily_view(d.daily(spark, sf), d.securities(spark, sf)),
        "trading_date ticker name market close_price:d trading_value trading_volume transaction_count:l",
    )


TOTALS = """
SELECT trading_date, count(*) AS quote_count, CAST(sum(trading_value) AS BIGINT) AS total_value,
       CAST(sum(trading_volume) AS BIGINT) AS total_volume FROM bars GROUP BY 1"""


@query("agg_daily_totals", "WITH " + b.BARS + TOTALS)
def agg_daily_totals(spark, sf):
    return qt.daily_totals(d.daily(spark, sf))


@query("union_markets", "WITH " + b.QUOTES + """
SELECT market, ticker, trading_date, trading_value FROM quotes WHERE market = 'TWSE'
UNION ALL SELECT market, ticker, trading_date, trading_value FROM quotes WHERE market = 'TPEX'""")
def union_markets(spark, sf):
    quotes = d.daily_quotes(spark, sf).select("market", "ticker", "trading_date", "trading_value")
    return quotes.where(F.col("market").isin("TWSE", "TPEX"))


# --- bars --------------------------------------------------------------------



def _half_even(value: str) -> str:
    """SQL: half-even rounding to four decimals of a positive number given to nine decimals."""
    nano = f"CAST(CAST({value} AS DECIMAL(28, 9)) * 1000000000 AS HUGEINT)"
    rest = f"({nano} - {nano} // 100000 * 100000)"
    odd = f"({nano} // 100000 - {nano} // 200000 * 2 = 1)"
    up = f"CASE WHEN {rest} > 50000 OR ({rest} = 50000 AND {odd}) THEN 1 ELSE 0 END"
    return f"CAST({nano} // 100000 + {up} AS DOUBLE) / 10000"


KLINE = "WITH " + b.BARS + "," + b.EVENTS + """,
valid AS (SELECT ticker, trading_date, open_c, high_c, low_c, close_c FROM bars WHERE close_c > 0 AND trading_date <= DATE '{end}'),
factors AS (SELECT ticker, effective_date, product(reference_price / previous_close) AS f FROM actions
            WHERE previous_close > 0 AND reference_price > 0 AND effective_date <= DATE '{end}' GROUP BY 1, 2),
factored AS (
  SELECT v.ticker, v.trading_date, any_value(open_c) AS open_c, any_value(high_c) AS high_c, any_value(low_c) AS low_c,
         any_value(close_c) AS close_c, coalesce(product(f.f), 1.0) AS factor
  FROM valid v LEFT JOIN factors f ON f.ticker = v.ticker AND v.trading_date < f.effective_date
  GROUP BY v.ticker, v.trading_date),
adj AS (
  SELECT ticker, trading_date, factor, open_c / 100.0::DOUBLE * factor AS o, high_c / 100.0::DOUBLE * factor AS h,
         low_c / 100.0::DOUBLE * factor AS l, close_c / 100.0::DOUBLE * factor AS c
  FROM factored),
points AS (
  SELECT *, lag(c) OVER w AS previous_close, row_number() OVER w AS bar,
         avg(c) OVER (w ROWS 4 PRECEDING) AS ma5, avg(c) OVER (w ROWS 9 PRECEDING) AS ma10,
         avg(c) OVER (w ROWS 19 PRECEDING) AS ma20, avg(c) OVER (w ROWS 59 PRECEDING) AS ma60,
         avg(c) OVER (w ROWS 239 PRECEDING) AS ma240
  FROM adj WINDOW w AS (PARTITION BY ticker ORDER BY trading_date)),
bars_out AS (
  SELECT ticker, trading_date, """ + ", ".join(
    f'{_half_even(value)} AS {name}'
    for value, name in (
        ("o", "open"), ("h", "high"), ("l", "low"), ("c", '"close"'), ("previous_close", "previous_close"),
        ("CASE WHEN bar >= 5 THEN ma5 END", "ma5"), ("CASE WHEN bar >= 10 THEN ma10 END", "ma10"),
        ("CASE WHEN bar >= 20 THEN ma20 END", "ma20"), ("CASE WHEN bar >= 60 THEN ma60 END", "ma60"),
        ("CASE WHEN bar >= 240 THEN ma240 END", "ma240"),
    )
) + """,
         CASE WHEN c::DECIMAL(28, 9) > coalesce(previous_close, o)::DECIMAL(28, 9) THEN 'up'
              WHEN c::DECIMAL(28, 9) < coalesce(previous_close, o)::DECIMAL(28, 9) THEN 'down' ELSE 'flat' END AS trend,
         o IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AS complete
  FROM points)"""

BAR_SPEC = (
    "ticker trading_date open=adj_open high=adj_high low=adj_low close=adj_close previous_close "
    "ma5 ma10 ma20 ma60 ma240 trend"
)
BAR_COLUMNS = "ticker, trading_date, open, high, low, \"close\", previous_close, ma5, ma10, ma20, ma60, ma240, trend"


@query("kline", KLINE.format(end=ENDS) + f"""
SELECT {BAR_COLUMNS} FROM bars_out WHERE complete AND trading_date BETWEEN DATE '2001-03-29' AND DATE '{ENDS}'""")
def kline(spark, sf):
    return shape(kl.rounded(kl.select_bars(d.daily(spark, sf), d.adjustments(spark, sf), END)), BAR_SPEC)


WHOLE_END = dt.date(2001, 12, 31)


def _adjusted(spark, sf):
    return kl.rounded(kl.adjusted(d.daily(spark, sf), d.adjustments(spark, sf), WHOLE_END))


@query("join_adjust_factor", KLINE.format(end=WHOLE_END) + "SELECT ticker, trading_date, round(factor, 8) AS factor FROM factored")
def join_adjust_factor(spark, sf):
    rows = kl.with_adjust_factor(
        d.daily(spark, sf).where("close_price > 0").select("ticker", "trading_date", "close_price"),
        d.adjustments(spark, sf),
        WHOLE_END,
    )
    return shape(rows, "ticker trading_date factor:r8")


@query("moving_averages", KLINE.format(end=WHOLE_END) + "SELECT ticker, trading_date, ma5, ma10, ma20, ma60, ma240 FROM bars_out")
def moving_averages(spark, sf):
    return shape(_adjusted(spark, sf), "ticker trading_date ma5 ma10 ma20 ma60 ma240")


@query("previous_adjusted_close", KLINE.format(end=WHOLE_END) + 'SELECT ticker, trading_date, "close", previous_close FROM bars_out')
def previous_adjusted_close(spark, sf):
    return shape(_adjusted(spark, sf), "ticker trading_date close=adj_close previous_close")


@query("filter_complete_bar", KLINE.format(end=WHOLE_END) + f"""
SELECT ticker, trading_date, ma5 FROM bars_out WHERE complete AND trading_date BETWEEN DATE '2000-01-01' AND DATE '{ENDS}'""")
def filter_complete_bar(spark, sf):
    """Incomplete bars are dropped only after they have fed the averages."""
    return shape(kl.complete_bars(_adjusted(spark, sf), dt.date(2000, 1, 1), END), "ticker trading_date ma5")


@query("bar_trend", KLINE.format(end=WHOLE_END) + "SELECT ticker, trading_date, trend FROM bars_out WHERE complete")
def bar_trend(spark, sf):
    rows = kl.bars(d.daily(spark, sf), d.adjustments(spark, sf), dt.date(1990, 1, 1), WHOLE_END, WHOLE_END)
    return shape(rows, "ticker trading_date trend")


LIVE_SQL = """,
history AS (SELECT ticker, trading_date, open, high, low, "close", previous_close FROM bars_out
            WHERE complete AND trading_date BETWEEN DATE '2001-03-29' AND DATE '{ends}'),
live AS (SELECT ticker, DATE '{ends}' AS trading_date, open_c / 100.0::DOUBLE AS open, high_c / 100.0::DOUBLE AS high,
                low_c / 100.0::DOUBLE AS low, close_c / 100.0::DOUBLE AS "close"
         FROM bars WHERE trading_date = DATE '2001-06-30'),
whole AS (SELECT * FROM live WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND "close" IS NOT NULL),
kept AS (SELECT h.*, FALSE AS is_live FROM history h WHERE NOT (h.trading_date = DATE '{ends}' AND h.ticker IN (SELECT ticker FROM whole)))
SELECT * FROM kept
UNION ALL SELECT w.ticker, w.trading_date, open, high, low, "close",
                 (SELECT arg_max(k."close", k.trading_date) FROM kept k WHERE k.ticker = w.ticker) AS previous_close, TRUE AS is_live
FROM whole w"""


def _live_bars(spark, sf):
    """Bars with the quotes of the following day standing in for the live round."""
    history = shape(
        kl.rounded(kl.select_bars(d.daily(spark, sf), d.adjustments(spark, sf), END)),
        "ticker trading_date open=adj_open high=adj_high low=adj_low close=adj_close previous_close",
    )
    live = d.daily(spark, sf).where(F.col("trading_date") == F.lit(END + dt.timedelta(days=1)))
    live = shape(live.withColumn("trading_date", F.lit(END)),
                 "ticker trading_date open=open_price:d high=high_price:d low=low_price:d close=close_price:d")
    return kl.append_live_bar(history, live, END)


@query("append_live_bar", KLINE.format(end=ENDS) + LIVE_SQL.format(ends=ENDS))
def append_live_bar(spark, sf):
    return _live_bars(spark, sf)


@query("kline_live", KLINE.format(end=ENDS) + LIVE_SQL.format(ends=ENDS).replace("SELECT * FROM kept\nUNION", ", live_rows AS (SELECT * FROM kept\nUNION")
       + """)
SELECT ticker, trading_date, open, high, low, "close", previous_close, is_live,
       CASE WHEN "close" > coalesce(previous_close, open) THEN 'up' WHEN "close" < coalesce(previous_close, open) THEN 'down' ELSE 'flat' END AS trend
FROM live_rows""")
def kline_live(spark, sf):
    rows = _live_bars(spark, sf)
    return rows.withColumn("trend", kl.trend(F.col("close"), F.col("previous_close"), F.col("open")))


# --- revenue -----------------------------------------------------------------

LAGGED = "WITH " + b.REVENUE + """,
grown AS (
  SELECT a.ticker, a.month, a.m, a.revenue, CASE WHEN y.revenue > 0 THEN (a.revenue - y.revenue)::DOUBLE / y.revenue END AS yoy,
         CASE WHEN o.revenue > 0 THEN (a.revenue - o.revenue)::DOUBLE / o.revenue END AS mom
  FROM monthly a LEFT JOIN monthly y ON y.ticker = a.ticker AND y.m = a.m - 12
                 LEFT JOIN monthly o ON o.ticker = a.ticker AND o.m = a.m - 1),
runs AS (SELECT *, m - row_number() OVER (PARTITION BY ticker ORDER BY m) AS island FROM grown),
blocked AS (
  SELECT a.ticker, a.m, max(q.m) FILTER (WHERE q.revenue >= a.revenue) AS block, min(q.m) AS first_m
  FROM runs a LEFT JOIN runs q ON q.ticker = a.ticker AND q.island = a.island AND q.m < a.m
  GROUP BY a.ticker, a.m),
streaks AS (
  SELECT g.*, block, CASE WHEN block IS NOT NULL THEN g.m - block ELSE g.m - coalesce(first_m, g.m) + 1 END AS months
  FROM grown g JOIN blocked USING (ticker, m)),
summed AS (
  SELECT ticker, month, m, revenue, round(yoy, 6) AS yoy, round(mom, 6) AS mom, CASE WHEN months >= 2 THEN months END AS high_months,
         months >= 2 AND block IS NULL AS record_high,
         row_number() OVER (PARTITION BY ticker ORDER BY m DESC) AS recent
  FROM streaks)"""
LATEST = f"SELECT ticker, month, revenue, yoy, mom, high_months::BIGINT AS high_months, record_high FROM summed WHERE month = DATE '{MONTH}'"


@query("eligible_month", f"""
SELECT DISTINCT CAST(o_orderdate AS DATE) AS today, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS month FROM orders""")
def eligible_month(spark, sf):
    today = F.to_date("o_orderdate")
    return d.table(spark, sf, "orders").select(today.alias("today"), m.eligible_month(today).alias("month")).distinct()


@query("join_revenue_lag", LAGGED + "SELECT ticker, month, revenue, yoy, mom FROM summed")
def join_revenue_lag(spark, sf):
    return shape(rv.with_growth(d.monthly_revenue(spark, sf)), "ticker month revenue yoy:r6 mom:r6")


@query("high_streak", LAGGED + "SELECT ticker, month, revenue, high_months::BIGINT AS high_months, record_high FROM summed")
def high_streak(spark, sf):
    return shape(rv.with_high_streak(d.monthly_revenue(spark, sf)), "ticker month revenue high_months:l record_high")


@query("recent_n_months", "WITH " + b.REVENUE + """
SELECT ticker, month, revenue FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY month DESC) AS n FROM monthly) WHERE n <= 20""")
def recent_n_months(spark, sf):
    return rv.recent_months(d.monthly_revenue(spark, sf))


@query("revenue_latest", LAGGED + LATEST)
def revenue_latest(spark, sf):
    return shape(rv.latest(d.monthly_revenue(spark, sf), MONTH), "ticker month revenue yoy:r6 mom:r6 high_months:l record_high")


@query("revenue_history", LAGGED + "SELECT ticker, month, revenue, yoy, mom FROM summed WHERE recent <= 20")
def revenue_history(spark, sf):
    return shape(rv.history(d.monthly_revenue(spark, sf)), "ticker month revenue yoy:r6 mom:r6")


@query("revenue_high_count", LAGGED + f"""
SELECT count(*) FILTER (WHERE month = DATE '{MONTH}') AS latest_rows,
       count(high_months) FILTER (WHERE month = DATE '{MONTH}') AS high_tickers,
       count(*) FILTER (WHERE recent <= 20) AS history_rows, count(DISTINCT ticker) AS history_tickers FROM summed""")
def revenue_high_count(spark, sf):
    monthly = d.monthly_revenue(spark, sf)
    return rv.high_count(rv.latest(monthly, MONTH), rv.history(monthly))


@query("overlay_latest_revenue", LAGGED + f""",
base AS (SELECT ticker, month, revenue, yoy, mom FROM summed WHERE month <> DATE '{MONTH}'
         UNION ALL SELECT ticker, month, revenue * 2, yoy, mom FROM summed WHERE month = DATE '{MONTH}')
SELECT ticker, month, revenue, yoy, mom
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY month DESC) AS n FROM base) WHERE n <= 20""")
def overlay_latest_revenue(spark, sf):
    """The latest table says twice the revenue; the overlay must show it."""
    monthly = d.monthly_revenue(spark, sf)
    latest = rv.latest(monthly, MONTH).withColumn("revenue", F.col("revenue") * 2)
    whole = rv.with_growth(monthly)
    return shape(rv.overlay_latest(whole, latest), "ticker month revenue yoy:r6 mom:r6")


@query("agg_month_counts", "WITH " + b.REVENUE + "SELECT month, count(*) AS row_count FROM monthly GROUP BY 1")
def agg_month_counts(spark, sf):
    return rv.month_counts(d.monthly_revenue(spark, sf))


@query("plan_revenue_months", "WITH " + b.REVENUE + f""",
wanted AS (SELECT CAST(DATE '2002-01-01' - to_months(CAST(i AS INTEGER)) AS DATE) AS month, i AS "index" FROM range(36) t(i))
SELECT month, "index" FROM wanted WHERE "index" < 2 OR month NOT IN (SELECT month FROM monthly)""")
def plan_revenue_months(spark, sf):
    return shape(rv.plan_months(d.monthly_revenue(spark, sf), dt.date(2002, 1, 1), 36), "month index:l")


@query("join_revenue_display", LAGGED + "," + b.LISTING + f"""
SELECT k.ticker, k.name, k.market, revenue AS month_revenue, yoy, mom, high_months::BIGINT AS high_months, record_high
FROM stocks k LEFT JOIN (SELECT * FROM summed WHERE month = DATE '{MONTH}') USING (ticker)""")
def join_revenue_display(spark, sf):
    latest = rv.latest(d.monthly_revenue(spark, sf), MONTH)
    rows = rv.display(d.securities(spark, sf), latest, MONTH)
    return shape(rows, "ticker name market month_revenue yoy:r6 mom:r6 high_months:l record_high")


# --- indices -----------------------------------------------------------------

YTD = "WITH " + b.INDEX + """,
pairs AS (
  SELECT a.trading_date, a.market, a.value_c, arg_max(p.value_c, p.trading_date) AS base_c
  FROM idx a LEFT JOIN idx p ON p.market = a.market AND year(p.trading_date) < year(a.trading_date) AND p.value_c > 0
  GROUP BY 1, 2, 3),
ytd AS (
  SELECT *, CASE WHEN base_c > 0 AND value_c > 0
                 THEN CAST(round(CAST((value_c - base_c) * 100 AS DECIMAL(30, 0)) * 100 / base_c, 0) AS DOUBLE) / 100 END AS ytd_change_percent,
         lag(value_c) OVER (PARTITION BY market ORDER BY trading_date) AS prior_c
  FROM pairs)"""


@query("index_ytd", YTD + """
SELECT trading_date, market, value_c / 100.0::DOUBLE AS value, base_c / 100.0::DOUBLE AS baseline, ytd_change_percent FROM ytd""")
def index_ytd(spark, sf):
    return shape(
        ix.with_year_to_date(d.market_index(spark, sf)), "trading_date market value:d baseline:d ytd_change_percent:d"
    )


@query("asof_index", "WITH " + b.INDEX + f"""
SELECT market, arg_max(value_c, trading_date) FILTER (WHERE trading_date <= DATE '2000-12-31' AND value_c > 0) / 100.0::DOUBLE AS baseline,
       arg_max(value_c, trading_date) FILTER (WHERE trading_date <= DATE '{ENDS}' AND value_c > 0) / 100.0::DOUBLE AS ending
FROM idx GROUP BY market""")
def asof_index(spark, sf):
    return shape(ix.year_to_date(d.market_index(spark, sf), END), "market baseline:d ending:d")


@query("asof_index_dates", "WITH " + b.INDEX + """,
asked AS (SELECT base_date, market, CAST(date_trunc('year', base_date) AS DATE) AS year_start
          FROM (SELECT DISTINCT trading_date + 1 AS base_date FROM idx), (SELECT unnest(['TWSE', 'TPEX']) AS market)),
positive AS (SELECT * FROM idx WHERE value_c > 0),
ended AS (SELECT a.*, p.value_c AS end_c FROM asked a ASOF LEFT JOIN positive p ON a.market = p.market AND a.base_date >= p.trading_date)
SELECT base_date, e.market, p.value_c / 100.0::DOUBLE AS baseline, end_c / 100.0::DOUBLE AS ending,
       CASE WHEN p.value_c > 0 AND end_c > 0
            THEN CAST(round(CAST((end_c - p.value_c) * 100 AS DECIMAL(30, 0)) * 100 / p.value_c, 0) AS DOUBLE) / 100 END AS ytd_change_percent
FROM ended e ASOF LEFT JOIN positive p ON e.market = p.market AND e.year_start > p.trading_date""")
def asof_index_dates(spark, sf):
    """The day after every trading date, so that some requests fall on days without trading."""
    index = d.market_index(spark, sf)
    dates = index.select(F.date_add("trading_date", 1).alias("trading_date")).distinct()
    return shape(
        ix.year_to_date_of(index, dates), "base_date market baseline:d ending:d ytd_change_percent:d"
    )


HALF_EVEN_PERCENT = """CASE WHEN prior_c > 0 THEN round_even((value_c - prior_c)::DOUBLE / prior_c * 100, 2) END"""


@query("export_index_history", YTD + f""",
days AS (SELECT DISTINCT trading_date FROM idx ORDER BY 1 DESC LIMIT 120),
shown AS (SELECT *, {HALF_EVEN_PERCENT} AS change FROM ytd),
bases AS (
  SELECT y, arg_max(value_c, trading_date) FILTER (WHERE market = 'TWSE') / 100.0::DOUBLE AS twse_baseline,
         arg_max(value_c, trading_date) FILTER (WHERE market = 'TPEX') / 100.0::DOUBLE AS tpex_baseline
  FROM (SELECT DISTINCT year(trading_date) AS y FROM days) JOIN idx ON year(trading_date) < y AND value_c > 0 GROUP BY y)
SELECT d.trading_date, w.value_c / 100.0::DOUBLE AS twse_value, w.change AS twse_change, w.ytd_change_percent AS twse_ytd,
       t.value_c / 100.0::DOUBLE AS tpex_value, t.change AS tpex_change, t.ytd_change_percent AS tpex_ytd,
       twse_baseline, tpex_baseline
FROM days d LEFT JOIN shown w ON w.trading_date = d.trading_date AND w.market = 'TWSE'
     LEFT JOIN shown t ON t.trading_date = d.trading_date AND t.market = 'TPEX'
     LEFT JOIN bases ON y = year(d.trading_date)""")
def export_index_history(spark, sf):
    from turnbook.operators.calendar import selectable_dates

    index = d.market_index(spark, sf)
    dates = selectable_dates(index)
    wide = ix.wide_history(ix.with_change_percent(index), dates)
    bases = ix.year_start_baselines(index, dates)
    rows = wide.join(bases, F.year("trading_date") == F.col("year"), "left")
    return shape(
        rows,
        "trading_date twse_value:d twse_change:d twse_ytd:d tpex_value:d tpex_change:d tpex_ytd:d "
        "twse_baseline:d tpex_baseline:d",
    )


# --- browsing ----------------------------------------------------------------


@query("browse_day", _ctes(n=1, minimum=0) + "," + FLAG_CTES + """
SELECT ticker, name, round(average_value, 4) AS average_value, round(share, 8) AS share
FROM ranked WHERE average_value >= 1000000 AND contains(lower(name), 'supplier')
  AND ticker IN (SELECT ticker FROM flags WHERE disposition_period IS NOT NULL OR altered_trading)
ORDER BY average_value DESC NULLS LAST, ticker LIMIT 100 OFFSET 0""")
def browse_day(spark, sf):
    """One day's list: threshold, any of the flags, search, sort, first page."""
    day = r.RankingQuery(period_days=1, end_date=END, min_average=0)
    rows = r.candidates(d.daily(spark, sf), d.securities(spark, sf), day, d.turnover(spark, sf))
    rows = rows.where(F.col("average_value") >= 1_000_000).where(browse.matches_search(" Supplier ", "ticker", "name"))
    rows = browse.status_any(rows, _flags(spark, sf), True, True)
    shown = browse.page(rows, 1, "average_value")
    return shape(shown, "ticker name average_value:r4 share:r8")


# --- data quality ------------------------------------------------------------

# The target lacks seventh lines shipped on Sundays, whole days of one week, and
# has one extra week that the source lacks; it starts in 1996.
TARGET_WHERE = (
    "NOT (l_linenumber = 7 AND dayofweek(trading_date) = {sunday}) AND trading_date >= DATE '1996-01-01' "
    "AND NOT (trading_date BETWEEN DATE '1999-03-01' AND DATE '1999-03-05')"
)
SOURCE_WHERE = "NOT (trading_date BETWEEN DATE '2000-07-03' AND DATE '2000-07-07')"


def _bars_of(spark, sf, condition):
    lines = d.lines(spark, sf).where(condition)
    return lines.groupBy(d.ticker_of(F.col("l_suppkey")).alias("ticker"), "trading_date").agg(
        F.sum("cents").alias("trading_value"), F.sum("qty").alias("trading_volume")
    )


def _source(spark, sf):
    return _bars_of(spark, sf, SOURCE_WHERE)


def _target(spark, sf):
    return _bars_of(spark, sf, TARGET_WHERE.format(sunday=1))


SIDES = "WITH " + b.LINES + f""",
source AS (SELECT CAST(l_suppkey + 1000 AS VARCHAR) AS ticker, trading_date, sum(cents) AS v, sum(qty) AS q
           FROM lines WHERE {SOURCE_WHERE} GROUP BY 1, 2),
target AS (SELECT CAST(l_suppkey + 1000 AS VARCHAR) AS ticker, trading_date, sum(cents) AS v, sum(qty) AS q
           FROM lines WHERE {TARGET_WHERE.format(sunday=0)} GROUP BY 1, 2),
s AS (SELECT trading_date, count(*) AS n, sum(v) AS v, sum(q) AS q FROM source GROUP BY 1),
t AS (SELECT trading_date, count(*) AS n, sum(v) AS v, sum(q) AS q FROM target GROUP BY 1),
found AS (
  SELECT t.trading_date, 'target_only' AS verdict FROM t ANTI JOIN s USING (trading_date)
  UNION ALL SELECT t.trading_date, 'count_mismatch' FROM t JOIN s USING (trading_date) WHERE t.n <> s.n
  UNION ALL SELECT t.trading_date, 'value_mismatch' FROM t JOIN s USING (trading_date) WHERE t.v <> s.v
  UNION ALL SELECT t.trading_date, 'volume_mismatch' FROM t JOIN s USING (trading_date) WHERE t.q <> s.q
  UNION ALL SELECT s.trading_date, 'source_only' FROM s ANTI JOIN t USING (trading_date)
            WHERE s.trading_date >= (SELECT min(trading_date) FROM t))"""


@query("reconcile", SIDES + """
SELECT f.trading_date, verdict, s.n AS source_count, t.n AS target_count, CAST(s.v AS BIGINT) AS source_value,
       CAST(t.v AS BIGINT) AS target_value, CAST(s.q AS BIGINT) AS source_volume, CAST(t.q AS BIGINT) AS target_volume
FROM found f LEFT JOIN s USING (trading_date) LEFT JOIN t USING (trading_date)""")
def reconcile(spark, sf):
    return shape(
        ql.reconcile(_source(spark, sf), _target(spark, sf)),
        "trading_date verdict source_count=s_quote_count target_count=t_quote_count source_value=s_total_value "
        "target_value=t_total_value source_volume=s_total_volume target_volume=t_total_volume",
    )


@query("full_reconcile", SIDES + "SELECT verdict, count(*) AS days FROM found GROUP BY 1")
def full_reconcile(spark, sf):
    found = ql.reconcile_totals(qt.daily_totals(_source(spark, sf)), qt.daily_totals(_target(spark, sf)))
    return found.groupBy("verdict").agg(F.count(F.lit(1)).alias("days"))


@query("anti_missing_dates", SIDES + """
SELECT ticker, trading_date, CAST(v AS BIGINT) AS trading_value FROM source WHERE trading_date NOT IN (SELECT trading_date FROM t)""")
def anti_missing_dates(spark, sf):
    rows = ql.rows_of_missing_dates(_source(spark, sf), _target(spark, sf))
    return shape(rows, "ticker trading_date trading_value")


@query("except_dates", SIDES + "SELECT trading_date FROM s EXCEPT SELECT trading_date FROM t")
def except_dates(spark, sf):
    return ql.missing_dates(_source(spark, sf), _target(spark, sf))


@query("coverage_status", SIDES + "," + b.LISTING + """
SELECT CAST((SELECT sum(n) FROM t) AS BIGINT) AS quote_rows, (SELECT count(*) FROM t) AS trading_days,
       (SELECT min(trading_date) FROM t) AS oldest_date, (SELECT max(trading_date) FROM t) AS latest_date,
       (SELECT count(*) FROM stocks) AS securities, (SELECT max(trading_date) FROM s) AS source_latest,
       (SELECT max(trading_date) FROM s) > (SELECT max(trading_date) FROM t) AS lagging""")
def coverage_status(spark, sf):
    return ql.coverage(_target(spark, sf), d.securities(spark, sf), _source(spark, sf))


# Stored state of each date, told apart by the number of the day, so that every state occurs at every size.
DAY_NUMBER = "CAST(trading_date - DATE '1970-01-01' AS INTEGER)"
STORED_SQL = b.LINES + "," + b.INDEX + f""",
both_idx AS (SELECT trading_date FROM idx GROUP BY 1 HAVING count(*) = 2),
numbered AS (SELECT trading_date, {DAY_NUMBER} AS e FROM lines GROUP BY 1),
stored AS (
  SELECT trading_date, e % 13 <> 5 AS is_trading_day, CASE WHEN e % 17 = 2 THEN 1 ELSE 2 END AS schema_version,
         CASE WHEN e % 19 = 4 THEN 0 ELSE 1 END AS daily_bar_schema_version,
         e % 23 <> 1 AND trading_date IN (SELECT trading_date FROM both_idx) AS has_indices
  FROM numbered WHERE e % 11 <> 3)"""


def _stored(spark, sf):
    both = d.market_index(spark, sf).groupBy("trading_date").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2")
    e = F.unix_date("trading_date")
    days = d.lines(spark, sf).select("trading_date").distinct().where(e % 11 != 3)
    return days.join(both.select("trading_date", F.lit(True).alias("_i")), "trading_date", "left").select(
        "trading_date",
        (e % 13 != 5).alias("is_trading_day"),
        F.when(e % 17 == 2, 1).otherwise(2).alias("schema_version"),
        F.lit(1).alias("market_index_schema_version"),
        (F.coalesce("_i", F.lit(False)) & (e % 23 != 1)).alias("has_indices"),
        F.when(e % 19 == 4, 0).otherwise(1).alias("daily_bar_schema_version"),
    )


GAPS = "WITH " + STORED_SQL + f""",
days AS (SELECT CAST(DATE '{ENDS}' - CAST(i AS INTEGER) AS DATE) AS trading_date FROM range(300 * 3 + 30) t(i)),
state AS (
  SELECT d.trading_date,
         CASE WHEN is_trading_day IS NULL THEN 'missing' WHEN NOT is_trading_day THEN 'closed' WHEN schema_version < 2 THEN 'stale_version'
              WHEN NOT has_indices THEN 'index_missing' WHEN daily_bar_schema_version < 1 THEN 'bars_missing' ELSE 'complete' END AS status
  FROM days d LEFT JOIN stored USING (trading_date) WHERE isodow(d.trading_date) <= 5)
SELECT trading_date, status FROM state WHERE status <> 'closed' ORDER BY trading_date DESC LIMIT 300"""


@query("plan_gaps", GAPS)
def plan_gaps(spark, sf):
    return ql.plan_gaps(_stored(spark, sf), END, 300)


@query("gap_plan", "WITH " + b.QUOTES + "," + b.INDEX + f""",
arrivals AS (
  SELECT trading_date, e, count(*) FILTER (WHERE market = 'TWSE' AND close_price IS NOT NULL AND e % 9 NOT IN (4, 5)) AS tw,
         count(*) FILTER (WHERE market = 'TPEX' AND e % 9 NOT IN (5, 6)) AS tp
  FROM (SELECT q.*, {DAY_NUMBER} AS e FROM quotes q) GROUP BY 1, 2),
flagged AS (
  SELECT a.*, count(*) FILTER (WHERE i.market = 'TWSE') > 0 AS it, count(*) FILTER (WHERE i.market = 'TPEX') > 0 AS ip
  FROM arrivals a LEFT JOIN idx i USING (trading_date) GROUP BY ALL)
SELECT trading_date,
       CASE WHEN tw = 0 AND tp = 0 AND (trading_date < DATE '{ENDS}' OR isodow(trading_date) > 5) THEN 'closed'
            WHEN tw = 0 AND tp = 0 THEN 'not_published' WHEN NOT (it AND e % 13 <> 2 AND ip) THEN 'index_missing' ELSE 'stored' END AS outcome,
       tw = 0 OR tp = 0 AS bar_backfill_failed
FROM flagged""")
def gap_plan(spark, sf):
    """Outcome of every downloaded date; by the number of the day a market's report or index may not have come."""
    quotes = d.daily_quotes(spark, sf)
    e = F.unix_date("trading_date")
    arrivals = quotes.groupBy("trading_date").agg(
        F.count_if((F.col("market") == "TWSE") & F.col("close_price").isNotNull() & ~(e % 9).isin(4, 5)).alias("twse_count"),
        F.count_if((F.col("market") == "TPEX") & ~(e % 9).isin(5, 6)).alias("tpex_count"),
    )
    index = d.market_index(spark, sf).groupBy("trading_date").agg(
        F.count_if(F.col("market") == "TWSE").alias("_t"), F.count_if(F.col("market") == "TPEX").alias("_p")
    )
    joined = arrivals.join(index, "trading_date", "left").select(
        "trading_date",
        "twse_count",
        "tpex_count",
        (F.coalesce(F.col("_t") > 0, F.lit(False)) & (e % 13 != 2)).alias("has_twse_index"),
        F.coalesce(F.col("_p") > 0, F.lit(False)).alias("has_tpex_index"),
    )
    weekends = quotes.select("trading_date").distinct().where(F.weekday("trading_date") > 4)
    rows = ql.day_outcomes(joined, weekends, END)
    return rows.select("trading_date", "outcome", "bar_backfill_failed")
