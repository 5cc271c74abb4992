"""Stored snapshots, exports, upserts, replacement, retention: written, then read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from turnbook.operators import flags as fl, intraday as it, revenue as rv
from turnbook.plans import base_sql as b
from turnbook.plans.intraday_queries import ROUND_QUOTES
from turnbook.plans.market_queries import (
    FLAG_CTES,
    FLAG_DAY,
    KLINE,
    LAGGED,
    LATEST,
    MONTH,
    QUOTE_SPEC,
    SIDES,
    _flags,
    _source,
    _target,
)
from turnbook.plans.ranking_queries import ALL_DATES, END, ENDS
from turnbook.plans.registry import query, shape
from turnbook.schemas import SCHEMA_VERSION
from turnbook.session import scratch_path
from turnbook.sources import driver_tables as d, exports, snapshots as sn, tables as tb

# --- snapshots ---------------------------------------------------------------

QUOTES_PER_LINE = 500


def whole_lines(spark, sf, per_line: int = QUOTES_PER_LINE) -> DataFrame:
    """The lines of all dates with their part numbers and checksums; weekends are marked as closed."""
    part = F.floor((F.col("ticker").cast("bigint") - 1000) / per_line).cast("int").alias("part")
    fields = [c for c in ("market ticker name open_price high_price low_price close_price trading_value "
                          "trading_volume transaction_count").split()]
    # A line takes at most per_line tickers, one row each, and a date has a line for each part.
    quotes = d.daily_quotes(spark, sf).groupBy("trading_date", part).agg(
        F.collect_list(F.struct(*fields)).alias("quotes")
    )
    quotes = quotes.withColumn("parts", F.count(F.lit(1)).over(W.partitionBy("trading_date")).cast("int"))
    # Two markets: at most two entries.
    indices = d.market_index(spark, sf).groupBy("trading_date").agg(
        F.collect_list(F.struct("market", "value", F.lit(None).cast("decimal(10,4)").alias("change_percent"))).alias(
            "market_indices"
        )
    )
    return quotes.join(indices, "trading_date", "left").select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "trading_date",
        (F.weekday("trading_date") < 5).alias("is_trading_day"),
        F.lit("2002-01-01T00:00:00").alias("downloaded_at"),
        "quotes",
        F.lit(1).alias("market_index_schema_version"),
        "market_indices",
        F.lit(1).alias("daily_bar_schema_version"),
        "part",
        "parts",
        sn.checksum().alias("checksum"),
    )


def snapshot_lines(spark, sf) -> DataFrame:
    """JSON lines of all dates, with broken lines that belong to no date mixed in."""
    lines = whole_lines(spark, sf)
    good = lines.select(F.to_json(F.struct(*lines.columns)).alias("value"))
    broken = lines.select(F.concat(F.lit('{"trading_date":"'), F.col("trading_date").cast("string"), F.lit('","quotes":[')).alias("value"))
    return good.union(broken)


def _snapshots(spark, sf):
    path = scratch_path(spark, "snapshots")
    sn.write_lines(snapshot_lines(spark, sf), path)
    return sn.scan(spark, path)


@query("scan_snapshots", "WITH " + b.QUOTES + """
SELECT trading_date, 2::BIGINT AS schema_version, count(*) AS quotes, CAST(sum(trading_value) AS BIGINT) AS trading_value
FROM quotes WHERE isodow(trading_date) <= 5 GROUP BY 1""")
def scan_snapshots(spark, sf):
    rows = _snapshots(spark, sf).select("trading_date", "schema_version", F.inline("quotes"))
    grouped = rows.groupBy("trading_date", "schema_version").agg(
        F.count(F.lit(1)).alias("quotes"), F.sum("trading_value").alias("trading_value")
    )
    return shape(grouped, "trading_date schema_version:l quotes trading_value")


FAULTY_LINES = """,
parted AS (
  SELECT trading_date, (CAST(ticker AS BIGINT) - 1000) // 25 AS part, count(*) AS quotes, CAST(sum(trading_value) AS BIGINT) AS trading_value
  FROM quotes WHERE isodow(trading_date) <= 5 GROUP BY 1, 2),
numbered AS (
  SELECT *, count(*) OVER own AS parts, part = min(part) OVER own AS is_first, part = max(part) OVER own AS is_last, dayofyear(trading_date) % 10 AS k
  FROM parted WINDOW own AS (PARTITION BY trading_date)),
kept AS (SELECT *, k = 7 AND is_first AS altered FROM numbered WHERE NOT (k = 3 AND is_first) AND NOT (k = 5 AND is_last))"""


@query("scan_complete_snapshots", "WITH " + b.QUOTES + FAULTY_LINES + """
SELECT trading_date, count(*) = any_value(parts) AND NOT bool_or(altered) AS complete,
       CAST(CASE WHEN count(*) = any_value(parts) AND NOT bool_or(altered) THEN sum(quotes) END AS BIGINT) AS quotes,
       CAST(CASE WHEN count(*) = any_value(parts) AND NOT bool_or(altered) THEN sum(trading_value) END AS BIGINT) AS trading_value
FROM kept GROUP BY trading_date""")
def scan_complete_snapshots(spark, sf):
    """On some days a line is cut off, lost or altered: such a date is listed and none of its rows are read."""
    own, fault = W.partitionBy("trading_date"), F.dayofyear("trading_date") % 10
    numbered = whole_lines(spark, sf, 25).withColumns({"_first": F.min("part").over(own) == F.col("part"), "_last": F.max("part").over(own) == F.col("part")})
    sent = numbered.where(~((fault == 5) & F.col("_last")))
    altered = F.transform("quotes", lambda q: q.withField("trading_value", q["trading_value"] + 1))
    sent = sent.withColumn("quotes", F.when((fault == 7) & F.col("_first"), altered).otherwise(F.col("quotes")))
    text = F.to_json(F.struct(*[c for c in numbered.columns if not c.startswith("_")]))
    path = scratch_path(spark, "faulty")
    cut = F.when((fault == 3) & F.col("_first"), F.substring(text, F.lit(1), F.length(text) - 40)).otherwise(text)
    sn.write_lines(sent.select(cut.alias("value")), path)
    read = sn.read_lines(spark, path)
    rows = sn.scan(spark, path, read).select("trading_date", F.inline("quotes"))
    whole = rows.groupBy("trading_date").agg(F.count(F.lit(1)).alias("quotes"), F.sum("trading_value").alias("trading_value"))
    nothing = F.lit(None).cast("bigint")
    broken = sn.incomplete_dates(spark, path, read).select("trading_date", F.lit(False).alias("complete"), nothing.alias("quotes"), nothing.alias("trading_value"))
    return whole.withColumn("complete", F.lit(True)).unionByName(broken)


@query("flatten_snapshots", "WITH " + b.QUOTES + "," + b.INDEX + """,
open_days AS (SELECT * FROM quotes WHERE isodow(trading_date) <= 5),
dim AS (SELECT ticker, arg_max(name, trading_date) AS name, arg_max(market, trading_date) AS market FROM open_days GROUP BY 1)
SELECT q.trading_date, q.ticker, dim.name, dim.market, open_price, high_price, low_price, close_price, trading_value,
       value_c / 100.0::DOUBLE AS index_value
FROM open_days q JOIN dim USING (ticker)
     LEFT JOIN idx ON idx.trading_date = q.trading_date AND idx.market = dim.market""")
def flatten_snapshots(spark, sf):
    """Daily rows, index rows and the share dimension, put together again."""
    stored = _snapshots(spark, sf)
    daily = sn.quotes(stored).drop("name", "market")
    indices = sn.indices(stored).select("trading_date", "market", F.col("value").alias("index_value"))
    rows = daily.join(sn.dimension(stored), "ticker").join(indices, ["trading_date", "market"], "left")
    return shape(
        rows,
        "trading_date ticker name market open_price:d high_price:d low_price:d close_price:d trading_value index_value:d",
    )


STORED_QUOTES = """
SELECT market, ticker, name, trading_date, open_price, high_price, low_price, close_price, trading_value, trading_volume, transaction_count
FROM quotes"""


@query("write_snapshot", "WITH " + b.QUOTES + STORED_QUOTES)
def write_snapshot(spark, sf):
    """All dates are written, then one date of 1998 once more; nothing may appear twice or be lost."""
    path = scratch_path(spark, "daily")
    quotes = d.daily_quotes(spark, sf)
    sn.write(quotes, path, "trading_month")
    sn.write_day(quotes, path, dt.date(1998, 6, 15))
    return shape(spark.read.parquet(path), QUOTE_SPEC)


@query("scan_snapshot_day", "WITH " + b.QUOTES + STORED_QUOTES + f" WHERE trading_date = DATE '{ENDS}'")
def scan_snapshot_day(spark, sf):
    path = scratch_path(spark, "daily")
    sn.write(d.daily_quotes(spark, sf), path, "trading_month")
    return shape(sn.day(spark, path, END), QUOTE_SPEC)


# --- exports -----------------------------------------------------------------


def _half_even_average(total: str) -> str:
    """SQL: half-even rounding of total / n in whole numbers."""
    whole = f"CAST({total} AS BIGINT) // n"
    rest = f"(CAST({total} AS BIGINT) - ({whole}) * n)"
    odd = f"(({whole}) - ({whole}) // 2 * 2 = 1)"
    return f"({whole}) + CASE WHEN 2 * {rest} > n OR (2 * {rest} = n AND {odd}) THEN 1 ELSE 0 END"


def _significant(value: str) -> str:
    scale = f"pow(10.0, least(greatest(7 - floor(log10(abs({value}))), 0), 28))"
    return f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE round_even({value} * {scale}, 0) / {scale} END"


@query("export_rankings", ALL_DATES + f"""
SELECT n::BIGINT AS period_days, base_date, ticker, name, lower(market) AS market, {_half_even_average("total")} AS value,
       {_half_even_average("previous_total")} AS previous_value, round(change_rate, 8) AS rate, round(previous_change_rate, 8) AS previous_rate,
       {_significant("share")} AS share, {_significant("(share - previous_share)")} AS share_change,
       round(daily_price_change, 8) AS price_change, round(weekly_price_change, 8) AS weekly_price_change,
       week_base_c / 100.0::DOUBLE AS weekly_baseline_close, end_c / 100.0::DOUBLE AS "close"
FROM rows_""")
def export_rankings(spark, sf):
    path = scratch_path(spark, "rankings")
    exports.export_rankings(d.daily(spark, sf), d.securities(spark, sf), path, d.turnover(spark, sf))
    return shape(
        spark.read.parquet(path),
        "period_days:l base_date ticker name market value previous_value rate previous_rate share share_change "
        "price_change weekly_price_change weekly_baseline_close:d close:d",
    )


@query("export_kline", KLINE.format(end=ENDS) + f""",
days AS (SELECT DISTINCT trading_date FROM bars WHERE trading_date <= DATE '{ENDS}' ORDER BY 1 DESC LIMIT 120),
span AS (SELECT CAST(min(trading_date) - INTERVAL 3 MONTH AS DATE) AS first_day, max(trading_date) AS last_day FROM days),
counted AS (SELECT ticker, count(*) AS event_count FROM actions WHERE effective_date <= DATE '{ENDS}' GROUP BY 1)
SELECT ticker, trading_date, open, high, low, "close", previous_close, ma5, ma10, ma20, ma60, ma240, coalesce(event_count, 0) AS event_count
FROM bars_out CROSS JOIN span LEFT JOIN counted USING (ticker)
WHERE complete AND trading_date BETWEEN first_day AND last_day""")
def export_kline(spark, sf):
    path = scratch_path(spark, "bars")
    exports.export_bars(d.daily(spark, sf), d.adjustments(spark, sf), path, END)
    return shape(
        spark.read.parquet(path),
        "ticker trading_date open=adj_open high=adj_high low=adj_low close=adj_close previous_close ma5 ma10 ma20 ma60 "
        "ma240 event_count",
    )


# --- upserts -----------------------------------------------------------------


@query("upsert_daily", "WITH " + b.BARS + """
SELECT ticker, trading_date, CASE WHEN trading_date < DATE '1999-01-01' THEN trading_value * 2 ELSE trading_value END AS trading_value,
       close_c / 100.0::DOUBLE AS close_price FROM bars""")
def upsert_daily(spark, sf):
    """The stored table has doubled values up to 1999; the download corrects 1999 and adds later dates."""
    daily = d.daily(spark, sf).select("ticker", "trading_date", "trading_value", "close_price")
    stored = daily.where("trading_date < DATE'2000-01-01'").withColumn("trading_value", F.col("trading_value") * 2)
    incoming = daily.where("trading_date >= DATE'1999-01-01'")
    path = scratch_path(spark, "upsert")
    by_year = F.year("trading_date")
    tb.write_partitioned(stored.withColumn("trading_year", by_year), path, "trading_year")
    tb.upsert_into(path, incoming.withColumn("trading_year", by_year), ("trading_date", "ticker"), "trading_year")
    return shape(spark.read.parquet(path), "ticker trading_date trading_value close_price:d")


@query("upsert_securities", "WITH " + b.QUOTES + """
SELECT ticker, arg_max(name, trading_date) AS name, arg_max(market, trading_date) AS market FROM quotes GROUP BY 1
UNION SELECT ticker, s_name, market FROM listing WHERE ticker NOT IN (SELECT ticker FROM quotes)""")
def upsert_securities(spark, sf):
    """Names seen in the quotes replace the stored ones; the latest date wins."""
    stored = d.listing(spark, sf).select(
        d.ticker_of(F.col("s_suppkey")).alias("ticker"), F.col("s_name").alias("name"), "market"
    )
    seen = d.daily_quotes(spark, sf).select("ticker", "name", "market", "trading_date")
    path = scratch_path(spark, "securities")
    tb.write_bucketed(stored.withColumn("trading_date", F.lit(None).cast("date")), path, ("ticker",))
    tb.upsert_buckets(path, seen, ("ticker",), ("trading_date",))
    return spark.read.parquet(path).select("ticker", "name", "market")


@query("upsert_monthly_revenue", "WITH " + b.REVENUE + """
SELECT ticker, month, CASE WHEN month < DATE '2000-01-01' THEN revenue + 1 ELSE revenue END AS revenue FROM monthly""")
def upsert_monthly_revenue(spark, sf):
    monthly = d.monthly_revenue(spark, sf)
    stored = monthly.where("month < DATE'2001-01-01'").withColumn("revenue", F.col("revenue") + 1)
    path, by_year = scratch_path(spark, "revenue"), F.year("month")
    tb.write_partitioned(stored.withColumn("year", by_year), path, "year")
    tb.upsert_into(path, monthly.where("month >= DATE'2000-01-01'").withColumn("year", by_year), ("ticker", "month"), "year")
    return spark.read.parquet(path).select("ticker", "month", "revenue")


@query("upsert_runs", "WITH " + b.INTRADAY + "," + b.LISTING + ROUND_QUOTES + """
SELECT trade_date, captured_at, ticker, CASE WHEN trade_date >= DATE '2024-01-15' THEN turnover ELSE turnover * 2 END AS turnover
FROM round_quotes r WHERE trade_date < DATE '2024-01-15' OR ticker IN (SELECT ticker FROM stocks)
   OR captured_at NOT IN (SELECT captured_at FROM round_quotes WHERE ticker IN (SELECT ticker FROM stocks))""")
def upsert_runs(spark, sf):
    """Rounds from mid-January are sent again with known shares only; their old quotes must go.

    A round without a known share is not sent again and keeps its quotes.
    """
    quotes = d.round_quotes(spark, sf).select("trade_date", "captured_at", "ticker", "turnover")
    late = F.col("trade_date") >= F.lit(dt.date(2024, 1, 15))
    stored = quotes.withColumn("turnover", F.when(late, F.col("turnover")).otherwise(F.col("turnover") * 2))
    again = quotes.where(late).join(d.securities(spark, sf).select("ticker"), "ticker", "left_semi")
    path = scratch_path(spark, "runs")
    tb.write_partitioned(stored, path, "trade_date")
    tb.replace_rounds_into(path, again.select(*quotes.columns), ("trade_date", "captured_at"), "trade_date")
    return spark.read.parquet(path).select(*quotes.columns)


@query("upsert_curve", "WITH " + b.INTRADAY + """
SELECT trade_date, captured_at, CASE WHEN trade_date < DATE '2024-01-20' THEN 0 ELSE turnover_total END AS turnover_total, quote_count FROM rounds""")
def upsert_curve(spark, sf):
    rounds = d.round_totals(spark, sf)
    stored = rounds.where("trade_date < DATE'2024-01-25'").withColumn("turnover_total", F.lit(0).cast("bigint"))
    path = scratch_path(spark, "curve")
    tb.write_partitioned(stored, path, "trade_date")
    tb.upsert_into(path, rounds.where("trade_date >= DATE'2024-01-20'"), ("trade_date", "captured_at"), "trade_date")
    return spark.read.parquet(path).select(*rounds.columns)


# --- whole-table replacement -------------------------------------------------


@query("replace_summaries", LAGGED + f"""
SELECT 'latest' AS kind, ticker, month, revenue, yoy, mom FROM summed WHERE month = DATE '{MONTH}'
UNION ALL SELECT 'history', ticker, month, revenue, yoy, mom FROM summed WHERE recent <= 20""")
def replace_summaries(spark, sf):
    """Published twice; readers see the second pair of tables only."""
    monthly = d.monthly_revenue(spark, sf)
    store = tb.VersionedTables(spark, scratch_path(spark, "revenue"))
    older = dt.date(2000, 6, 1)
    store.publish(latest=rv.latest(monthly, older), history=rv.history(monthly, 5))
    store.publish(latest=rv.latest(monthly, MONTH), history=rv.history(monthly))
    columns = ["ticker", "month", "revenue", "yoy", "mom"]
    both = store.read("latest").select(F.lit("latest").alias("kind"), *columns).unionByName(
        store.read("history").select(F.lit("history").alias("kind"), *columns)
    )
    return shape(both, "kind ticker month revenue yoy:r6 mom:r6")


@query("replace_flags", "WITH " + FLAG_CTES + """
SELECT ticker, disposition_period, matching_minutes::BIGINT AS matching_minutes, altered_trading FROM flags""")
def replace_flags(spark, sf):
    """Yesterday's flags are gone after today's are published."""
    store = tb.VersionedTables(spark, scratch_path(spark, "flags"))
    before = fl.latest_dispositions(d.dispositions(spark, sf), FLAG_DAY - dt.timedelta(days=60))
    store.publish(flags=fl.market_flags(before, d.altered(spark, sf)))
    store.publish(flags=_flags(spark, sf))
    return shape(store.read("flags"), "ticker disposition_period matching_minutes:l altered_trading")


# --- retention and sync ------------------------------------------------------


@query("retain_last_n_dates", "WITH " + b.BARS + """
SELECT ticker, trading_date, trading_value FROM bars
WHERE trading_date IN (SELECT DISTINCT trading_date FROM bars ORDER BY 1 DESC LIMIT 300)""")
def retain_last_n_dates(spark, sf):
    """Stored by month; the range is published, then the months before it are deleted."""
    table = tb.RetainedTable(spark, scratch_path(spark, "retained"))
    table.write(d.daily(spark, sf).select("ticker", "trading_date", "trading_value"))
    table.publish()
    table.expire()
    return table.read().select("ticker", "trading_date", "trading_value")


@query("sync_incremental", SIDES + "," + b.LISTING + """,
merged AS (
  SELECT ticker, trading_date, v FROM target
  UNION ALL SELECT ticker, trading_date, v FROM source
  WHERE trading_date NOT IN (SELECT trading_date FROM t) AND ticker IN (SELECT ticker FROM stocks))
SELECT ticker, trading_date, CAST(v AS BIGINT) AS trading_value FROM merged
WHERE trading_date IN (SELECT DISTINCT trading_date FROM merged ORDER BY 1 DESC LIMIT 900)""")
def sync_incremental(spark, sf):
    """Keeps 900 dates, so that dates missing in the target fall into the kept range."""
    path = scratch_path(spark, "sync")
    tb.write_partitioned(_target(spark, sf).withColumn("trading_month", F.trunc("trading_date", "month")), path, "trading_month")
    synced = tb.sync_into(path, _source(spark, sf), d.securities(spark, sf), keep=900)
    return synced.select("ticker", "trading_date", "trading_value")
