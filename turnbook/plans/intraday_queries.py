"""Intraday rounds, gate, curves and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnbook.functions import measures as m
from turnbook.operators import indices as ix, intraday as it, quality as ql, ranking as r
from turnbook.plans import base_sql as b, landed
from turnbook.plans.market_queries import SIDES, _source, _target
from turnbook.plans.ranking_queries import END, _ctes
from turnbook.plans.registry import query, shape
from turnbook.session import materialize
from turnbook.sources import driver_tables as d

TICKS = "WITH RECURSIVE " + b.INTRADAY

# The events read as feed entries: which field carries the price.
FEED_PRICE = """CASE WHEN event_type = 'purchase' THEN price_c * 100
                 WHEN event_type = 'click' AND lots < 60 THEN price_c * 100
                 WHEN event_type = 'click' THEN price_c * 100 + 250
                 WHEN event_type = 'view' AND lots < 50 THEN price_c * 100 + 250
                 WHEN event_type = 'view' THEN price_c * 100
                 WHEN lots >= 20 THEN price_c * 100 + 1000 END"""
FEED = "WITH " + b.INTRADAY + f""",
feed AS (
  SELECT *, {FEED_PRICE} AS p4,
         CASE WHEN event_type = 'purchase' THEN 'last_trade'
              WHEN event_type = 'click' AND lots < 30 THEN 'previous_trade'
              WHEN event_type = 'click' THEN 'bid_ask_mid' WHEN event_type = 'view' AND lots < 50 THEN 'high_low_mid'
              WHEN event_type = 'view' THEN 'open' WHEN lots >= 20 THEN 'previous_close' ELSE 'none' END AS price_source,
         CASE WHEN event_type <> 'error' OR lots >= 20 THEN price_c * 100 + 1000 END AS y4
  FROM ticks WHERE event_type <> 'signup'),
moved AS (
  SELECT *, CASE WHEN p4 IS NOT NULL AND y4 > 0 THEN CAST(p4 - y4 AS HUGEINT) * 10000 END AS num FROM feed),
whole AS (SELECT *, CAST(floor(num / y4::DECIMAL(38, 0)) AS HUGEINT) AS q0 FROM moved),
exact AS (SELECT *, CASE WHEN q0 * y4 > num THEN q0 - 1 WHEN (q0 + 1) * y4 <= num THEN q0 + 1 ELSE q0 END AS q FROM whole),
priced AS (
  SELECT *, CASE WHEN 2 * (num - q * y4) > y4 OR (2 * (num - q * y4) = y4 AND q - 2 * (q // 2) <> 0) THEN q + 1 ELSE q END AS hundredths
  FROM exact)"""


def _quotes(spark, sf):
    return it.quotes_of_items(it.message_items(landed.messages(spark, sf)), d.KEY_CODES)


@query("resolve_price", FEED + """
SELECT captured_at, ticker, CASE WHEN lots >= 50 THEN 'TPEX' ELSE 'TWSE' END AS market, p4 / 10000.0::DOUBLE AS price, price_source,
       count(*) AS quotes
FROM feed GROUP BY ALL""")
def resolve_price(spark, sf):
    grouped = _quotes(spark, sf).groupBy("captured_at", "ticker", "market", "price", "price_source").agg(
        F.count(F.lit(1)).alias("quotes")
    )
    return shape(grouped, "captured_at ticker market price:d price_source quotes")


@query("estimate_turnover", FEED + """
SELECT captured_at, ticker, CAST(sum(coalesce(p4 * lots // 10, 0)) AS BIGINT) AS turnover, CAST(sum(lots * 1000) AS BIGINT) AS volume
FROM feed GROUP BY ALL""")
def estimate_turnover(spark, sf):
    return _quotes(spark, sf).groupBy("captured_at", "ticker").agg(
        F.sum("turnover").alias("turnover"), F.sum("trading_volume").alias("volume")
    )


@query("change_percent", FEED + """
SELECT captured_at, ticker, p4 / 10000.0::DOUBLE AS price, hundredths / 100.0::DOUBLE AS change_percent, count(*) AS quotes
FROM priced GROUP BY ALL""")
def change_percent(spark, sf):
    grouped = _quotes(spark, sf).groupBy("captured_at", "ticker", "price", "change_percent").agg(
        F.count(F.lit(1)).alias("quotes")
    )
    return shape(grouped, "captured_at ticker price:d change_percent:d quotes")


@query("price_source_profile", FEED + """
SELECT price_source, count(*) AS quotes, count(*) FILTER (WHERE p4 IS NULL AND lots > 0) AS priceless_with_volume
FROM feed GROUP BY 1""")
def price_source_profile(spark, sf):
    return it.price_source_profile(_quotes(spark, sf))


@query("filter_stale_round", "WITH " + b.INTRADAY + """
SELECT trade_date, captured_at, turnover_total FROM rounds WHERE trade_date = CAST(captured_at + INTERVAL 8 HOUR AS DATE)""")
def filter_stale_round(spark, sf):
    rounds = d.round_totals(spark, sf)
    return rounds.where(it.is_current(F.col("trade_date"), F.col("captured_at"))).select(*it.ROUND, "turnover_total")


PROGRESS = """least(greatest((hour(captured_at + INTERVAL 8 HOUR) * 60 + minute(captured_at + INTERVAL 8 HOUR) - 540) / 270.0::DOUBLE, 0.0), 1.0)"""


@query("session_progress", "WITH " + b.INTRADAY + f"SELECT captured_at, round({PROGRESS}::DOUBLE, 8) AS progress FROM rounds")
def session_progress(spark, sf):
    rounds = d.round_totals(spark, sf)
    return rounds.select("captured_at", F.round(m.session_progress(F.col("captured_at")), 8).alias("progress"))


@query("projected_close", "WITH " + b.INTRADAY + f"""
SELECT captured_at, turnover_total, round(CASE WHEN {PROGRESS} >= 0.1 THEN turnover_total / ({PROGRESS}::DOUBLE) END, 2) AS projected FROM rounds""")
def projected_close(spark, sf):
    rounds = d.round_totals(spark, sf)
    progress = m.session_progress(F.col("captured_at"))
    return rounds.select(
        "captured_at", "turnover_total", F.round(m.projected_close(F.col("turnover_total"), progress), 2).alias("projected")
    )


@query("agg_round_total", "WITH " + b.INTRADAY + "SELECT * FROM rounds")
def agg_round_total(spark, sf):
    return d.round_totals(spark, sf)


FOLD = """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY captured_at) AS rn FROM rounds),
fold AS (
  SELECT trade_date, captured_at, turnover_total, quote_count, rn, NULL::BIGINT AS previous_total, TRUE AS accepted, turnover_total AS last
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.trade_date, o.captured_at, o.turnover_total, o.quote_count, o.rn, f.last,
         NOT (f.last > 0 AND o.turnover_total * 10 < f.last * 9),
         CASE WHEN f.last > 0 AND o.turnover_total * 10 < f.last * 9 THEN f.last ELSE o.turnover_total END
  FROM fold f JOIN ordered o ON o.trade_date = f.trade_date AND o.rn = f.rn + 1)"""
GATE = TICKS + FOLD


def _judged(spark, sf):
    return it.judge_rounds(d.round_totals(spark, sf))


GATE_COLUMNS = "trade_date, captured_at, turnover_total, quote_count, previous_total, accepted"


@query("monotonic_gate", GATE + f"SELECT {GATE_COLUMNS} FROM fold")
def monotonic_gate(spark, sf):
    return _judged(spark, sf)


def _curve(spark, sf):
    return _judged(spark, sf).where("accepted").select(*it.ROUND, "turnover_total", "quote_count")


RATIOS = ",\nratios AS (SELECT trade_date, captured_at, turnover_total / (max(turnover_total) OVER (PARTITION BY trade_date))::DOUBLE AS ratio FROM {src})"


@query("curve_ratio", GATE + ", curve AS (SELECT * FROM fold WHERE accepted)" + RATIOS.format(src="curve") + """
SELECT trade_date, captured_at, round(ratio, 8) AS ratio FROM ratios""")
def curve_ratio(spark, sf):
    return shape(it.curve_ratio(_curve(spark, sf)), "trade_date captured_at ratio:r8")


PROFILE = """,
slots AS (SELECT (hour(captured_at + INTERVAL 8 HOUR) * 60 + minute(captured_at + INTERVAL 8 HOUR)) // 2 * 2 AS slot, ratio FROM ratios)
SELECT slot, round(avg(ratio), 6) AS volume_ratio, round(least(greatest((slot - 540) / 270.0::DOUBLE, 0.0), 1.0)::DOUBLE, 6) AS time_ratio,
       round(avg(ratio) - least(greatest((slot - 540) / 270.0::DOUBLE, 0.0), 1.0), 6) AS gap, count(*) AS points
FROM slots GROUP BY slot"""
PROFILE_SPEC = "slot:l volume_ratio:r6 time_ratio:r6 gap:r6 points"


@query("curve_profile", "WITH " + b.INTRADAY + RATIOS.format(src="rounds") + PROFILE)
def curve_profile(spark, sf):
    return shape(it.curve_profile(d.round_totals(spark, sf)), PROFILE_SPEC)


@query("volume_curve", GATE + ", curve AS (SELECT * FROM fold WHERE accepted)" + RATIOS.format(src="curve") + PROFILE)
def volume_curve(spark, sf):
    """Only accepted rounds make up the curve."""
    return shape(it.curve_profile(_curve(spark, sf)), PROFILE_SPEC)


@query("latest_run", "WITH " + b.INTRADAY + "SELECT * FROM rounds ORDER BY trade_date DESC, captured_at DESC LIMIT 1")
def latest_run(spark, sf):
    return it.latest_run(d.round_totals(spark, sf))


@query("latest_before", "WITH " + b.INTRADAY + """
SELECT a.trade_date, a.captured_at, arg_max(p.turnover_total, p.captured_at) AS previous_total
FROM rounds a LEFT JOIN rounds p ON p.trade_date = a.trade_date AND p.captured_at < a.captured_at GROUP BY 1, 2""")
def latest_before(spark, sf):
    rounds = d.round_totals(spark, sf)
    return it.latest_before(rounds).select(*it.ROUND, "previous_total")


@query("retain_current_session", GATE + """
SELECT trade_date, captured_at, turnover_total FROM fold WHERE accepted AND trade_date >= (SELECT max(trade_date) FROM fold WHERE accepted)""")
def retain_current_session(spark, sf):
    curve = _curve(spark, sf)
    return it.retain_current_session(curve, curve).select(*it.ROUND, "turnover_total")


ROUND_QUOTES = """,
round_quotes AS (
  SELECT trade_date, captured_at, ticker, CAST(sum(turnover) AS BIGINT) AS turnover, arg_max(price_c, event_id) AS last_c,
         arg_min(price_c, event_id) AS first_c, max(price_c) AS high_c, min(price_c) AS low_c
  FROM ticks GROUP BY 1, 2, 3),
newest AS (SELECT max(captured_at) AS captured_at FROM rounds),
now_ AS (SELECT q.*, k.name, k.market FROM round_quotes q JOIN newest USING (captured_at) JOIN stocks k USING (ticker))"""


@query("view_intraday_latest", "WITH " + b.INTRADAY + "," + b.LISTING + "," + b.INDEX + ROUND_QUOTES + """,
past AS (SELECT arg_max(value_c, trading_date) AS base_c FROM idx
         WHERE market = 'TWSE' AND value_c > 0 AND trading_date < (SELECT date_trunc('year', max(trade_date)) FROM rounds)),
spread AS (SELECT captured_at, max(price_c) AS hi, min(price_c) AS lo, count(*) AS quote_count FROM ticks GROUP BY 1)
SELECT ticker, name, market, last_c / 100.0::DOUBLE AS price, turnover, first_c / 100.0::DOUBLE AS open_price,
       high_c / 100.0::DOUBLE AS high_price, low_c / 100.0::DOUBLE AS low_price, trade_date, captured_at, quote_count,
       hi / 100.0::DOUBLE AS twse_index, lo / 100.0::DOUBLE AS tpex_index,
       CASE WHEN base_c > 0 THEN CAST(round(CAST((hi - base_c) * 100 AS DECIMAL(30, 0)) * 100 / base_c, 0) AS DOUBLE) / 100 END AS twse_ytd
FROM now_ JOIN spread USING (captured_at) CROSS JOIN past""")
def view_intraday_latest(spark, sf):
    """Prices, range and year-to-date fields together; the year began at the last index value before it."""
    runs = d.runs(spark, sf, newest=True).drop("turnover_total")
    opening = runs.agg(F.trunc(F.max("trade_date"), "year")).scalar()
    history = d.market_index(spark, sf).where((F.col("market") == "TWSE") & (F.col("value") > 0) & (F.col("trading_date") < opening))
    base = history.agg(F.max_by("value", "trading_date")).scalar()
    runs = runs.withColumn("twse_ytd", ix.ytd_percent(F.col("twse_index"), base))
    view = it.latest_view(d.newest_round(spark, sf), runs, d.securities(spark, sf))
    return shape(
        view,
        "ticker name market price:d turnover open_price:d high_price:d low_price:d trade_date captured_at quote_count "
        "twse_index:d tpex_index:d twse_ytd:d",
    )


def _now(spark, sf):
    return it.latest_view(d.newest_round(spark, sf), d.runs(spark, sf, newest=True).select(*it.ROUND), d.securities(spark, sf))


def _reference(spark, sf):
    everything = r.RankingQuery(period_days=20, end_date=END, min_average=0)
    return r.candidates(d.daily(spark, sf), d.securities(spark, sf), everything, d.turnover(spark, sf))


LIVE = _ctes(minimum=0) + "," + b.INTRADAY + ROUND_QUOTES + f""",
live_total AS (SELECT sum(turnover) AS live_total FROM now_),
live AS (
  SELECT w.ticker, w.name, w.market, w.turnover, w.captured_at, last_c, turnover::DOUBLE / live_total::DOUBLE AS live_share,
         c.average_value AS past_value, c.share AS past_share, c.share - c.previous_share AS past_share_change,
         CASE WHEN c.end_c > 0 THEN (last_c - c.end_c)::DOUBLE / c.end_c END AS weekly_price_change,
         {PROGRESS.replace("captured_at", "w.captured_at")} AS progress
  FROM now_ w CROSS JOIN live_total LEFT JOIN cand c ON c.ticker = w.ticker)"""
LIVE_COLUMNS = """ticker, name, market, turnover, round(live_share, 8) AS share, round(live_share - past_share, 8) AS share_change,
       round(weekly_price_change, 6) AS weekly_price_change, round(CASE WHEN progress >= 0.1 THEN turnover / progress::DOUBLE END, 2) AS projected"""
LIVE_SPEC = "ticker name market turnover share:r8 share_change:r8 weekly_price_change:r6 projected:r2"


@query("join_intraday_reference", LIVE + f"SELECT {LIVE_COLUMNS} FROM live")
def join_intraday_reference(spark, sf):
    return shape(it.with_reference(_now(spark, sf), _reference(spark, sf), END), LIVE_SPEC)


@query("ranking_intraday", LIVE + f""",
by_heat AS (
  SELECT 'heat' AS mode, *, row_number() OVER (ORDER BY turnover DESC NULLS LAST, ticker) AS "rank",
         CASE WHEN past_value IS NOT NULL THEN row_number() OVER (ORDER BY past_value DESC NULLS LAST, ticker) END AS previous_rank
  FROM live),
by_share AS (
  SELECT 'acceleration' AS mode, *, row_number() OVER (ORDER BY live_share - past_share DESC NULLS LAST, ticker) AS "rank",
         CASE WHEN past_share_change IS NOT NULL THEN row_number() OVER (ORDER BY past_share_change DESC NULLS LAST, ticker) END AS previous_rank
  FROM live WHERE market = 'TWSE')
SELECT mode, "rank", previous_rank, previous_rank - "rank" AS rank_change, {LIVE_COLUMNS}
FROM (SELECT * FROM by_heat UNION ALL SELECT * FROM by_share) WHERE "rank" <= 100""")
def ranking_intraday(spark, sf):
    """Both modes: all shares by turnover, one market by change of share."""
    reference = materialize(_reference(spark, sf), "reference")
    measured = materialize(it.with_reference(_now(spark, sf), reference, END), "round")
    heat = it.ranking_of_measured(measured, reference).withColumn("mode", F.lit("heat"))
    share = it.ranking_of_measured(measured, reference, r.ACCELERATION, "TWSE").withColumn("mode", F.lit("acceleration"))
    return shape(heat.unionByName(share), "mode rank:l previous_rank:l rank_change:l " + LIVE_SPEC)


@query("round_outcomes", "WITH RECURSIVE " + b.INTRADAY.replace("rounds AS", "all_rounds AS") + """,
states AS (SELECT *, CAST(captured_at + INTERVAL 8 HOUR AS DATE) AS session_date FROM all_rounds),
rounds AS (SELECT * FROM states WHERE epoch(captured_at) // 3600 % 10 <> 3 AND trade_date = session_date)""" + FOLD + """,
labelled AS (
  SELECT s.session_date, CASE WHEN epoch(s.captured_at) // 3600 % 10 = 3 THEN 'failed' WHEN s.trade_date <> s.session_date THEN 'stale'
                              WHEN f.accepted THEN 'written' ELSE 'rejected' END AS status
  FROM states s LEFT JOIN fold f USING (trade_date, captured_at)),
counts AS (
  SELECT session_date, count(*) FILTER (WHERE status = 'written') AS written, count(*) FILTER (WHERE status = 'stale') AS stale,
         count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'rejected') AS rejected
  FROM labelled GROUP BY 1)
SELECT *, CASE WHEN written > 0 AND rejected > 0 THEN 'partial' WHEN written > 0 THEN 'ok' WHEN failed > 0 OR rejected > 0 THEN 'failed'
               ELSE 'closed_market' END AS verdict FROM counts""")
def round_outcomes(spark, sf):
    """Every tenth hour's round counts as failed, those of another day as stale, the rest go through the gate."""
    totals = d.round_totals(spark, sf)
    current = it.is_current(F.col("trade_date"), F.col("captured_at"))
    failed = F.floor(F.unix_seconds(F.col("captured_at").cast("timestamp")) / 3600) % 10 == 3
    judged = it.judge_rounds(totals.where(~failed & current)).select(*it.ROUND, "accepted")
    status = (
        F.when(failed, "failed")
        .when(~current, "stale")
        .when(F.col("accepted"), "written")
        .otherwise("rejected")
    )
    rounds = totals.join(judged, it.ROUND, "left").select(
        F.to_date(m.taipei(F.col("captured_at"))).alias("session_date"), status.alias("status")
    )
    return it.session_outcomes(rounds)


@query("coverage_report", SIDES + "," + b.LISTING + "," + b.INTRADAY + """
SELECT CAST((SELECT sum(n) FROM t) AS BIGINT) AS quote_rows, (SELECT count(*) FROM t) AS trading_days,
       (SELECT min(trading_date) FROM t) AS oldest_date, (SELECT max(trading_date) FROM t) AS latest_date,
       (SELECT count(*) FROM stocks) AS securities, (SELECT max(trading_date) FROM s) AS source_latest,
       (SELECT max(trading_date) FROM s) > (SELECT max(trading_date) FROM t) AS lagging,
       (SELECT count(DISTINCT trade_date) FROM rounds) AS curve_days, (SELECT count(DISTINCT trade_date) FROM rounds) >= 10 AS curve_ready""")
def coverage_report(spark, sf):
    curve = d.round_totals(spark, sf)
    return ql.coverage_report(_target(spark, sf), d.securities(spark, sf), _source(spark, sf), curve)
