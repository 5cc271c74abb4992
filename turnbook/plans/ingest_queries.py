"""Report ingest: documents derived from the tables, parsed back into typed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnbook.plans import base_sql as b, landed
from turnbook.plans.market_queries import QUOTE_SPEC
from turnbook.plans.registry import query, shape
from turnbook.operators import quotes as qt
from turnbook.session import scratch_path
from turnbook.sources import driver_tables as d, reports as rp, revenue_pages as pages

QUOTES_OF = "WITH " + b.QUOTES + """
SELECT market, ticker, name, trading_date, open_price, high_price, low_price, close_price, trading_value, trading_volume, transaction_count
FROM quotes WHERE market = '{}'"""


@query("ingest_daily_twse", QUOTES_OF.format("TWSE"))
def ingest_daily_twse(spark, sf):
    return shape(rp.daily_twse(landed.read_back(landed.twse_daily(d.daily_quotes(spark, sf)), "twse"), d.KEY_CODES), QUOTE_SPEC)


@query("ingest_daily_tpex", QUOTES_OF.format("TPEX"))
def ingest_daily_tpex(spark, sf):
    return shape(rp.daily_tpex(landed.read_back(landed.tpex_daily(d.daily_quotes(spark, sf)), "tpex"), d.KEY_CODES), QUOTE_SPEC)


@query("ingest_index", "WITH " + b.INDEX + """,
moved AS (SELECT *, value_c - lag(value_c) OVER (PARTITION BY market ORDER BY trading_date) AS points_c FROM idx)
SELECT trading_date, market, value_c / 100.0::DOUBLE AS value,
       CASE WHEN market = 'TWSE' AND isodow(trading_date) <= 2 THEN 1.25::DOUBLE
            WHEN value_c - points_c > 0 THEN round_even(points_c::DOUBLE / (value_c - points_c) * 100, 2) END AS change_percent
FROM moved""")
def ingest_index(spark, sf):
    """Three report shapes: price index table, monthly summary, counter market table."""
    index = landed.with_points(d.market_index(spark, sf))
    rows = (
        rp.index_twse(landed.twse_index(index))
        .unionByName(rp.index_twse_summary(landed.twse_summary(index)))
        .unionByName(rp.index_tpex(landed.tpex_index(index)))
    )
    return shape(rows, "trading_date market value:d change_percent:d")


@query("ingest_non_regular", "WITH " + b.LINES + """
SELECT trading_date, CAST(l_suppkey + 1000 AS VARCHAR) AS ticker, CAST(sum(cents) AS BIGINT) AS excluded_value,
       CAST(sum(qty * CASE WHEN l_linenumber = 3 THEN 1000 ELSE 1 END) AS BIGINT) AS excluded_volume
FROM lines WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def ingest_non_regular(spark, sf):
    return qt.sum_non_regular(rp.non_regular(landed.non_regular(spark, sf), d.KEY_CODES))


@query("ingest_adjustments", "WITH " + b.EVENTS + "," + b.LISTING + """
SELECT a.ticker, effective_date, floor(previous_close * 100 + 0.5) / 100 AS previous_close,
       floor(reference_price * 100 + 0.5) / 100 AS reference_price, market
FROM actions a JOIN listing USING (ticker)""")
def ingest_adjustments(spark, sf):
    rows = rp.adjustments(landed.adjustments(spark, sf, "TWSE"), "TWSE", codes=d.KEY_CODES).unionByName(
        rp.adjustments(landed.adjustments(spark, sf, "TPEX"), "TPEX", codes=d.KEY_CODES)
    )
    return shape(rows.orderBy("ticker", "effective_date"), "ticker effective_date previous_close:d reference_price:d market")


@query("ingest_dispositions", "WITH " + b.NOTICES + """
SELECT ticker, start, "end", matching_minutes::BIGINT AS matching_minutes, source_order FROM notices""")
def ingest_dispositions(spark, sf):
    """Periods and intervals are spelled in all the ways the notices use."""
    orders = d.dispositions(spark, sf).join(
        d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_order"), "o_orderstatus"), "source_order"
    )
    status = F.col("o_orderstatus")
    slashed = F.concat(landed.roc_slashed(F.col("start")), F.lit(" ～ "), landed.roc_slashed(F.col("end")))
    compact = F.concat(landed.roc_compact(F.col("start")), F.lit("~"), landed.roc_compact(F.col("end")))
    five = F.col("matching_minutes") == 5
    minutes = (
        F.when(status == "F", F.col("matching_minutes").cast("string"))
        .when(status == "O", F.when(five, "５").otherwise("１０"))
        .otherwise(F.when(five, "五").otherwise("十"))
    )
    content = F.concat(F.lit("以人工管制之撮合終端機執行撮合作業（約每"), minutes, F.lit("分鐘撮合一次）"))
    documents = orders.where(status != "F").select(
        "source_order",
        landed.flat(
            [],
            F.array(
                landed.row("1", "x", F.concat(F.col("ticker"), F.lit(" ")), "x", "1", "x", slashed, "x", content, "x"),
                landed.row("2", "x", "030001", "x", "1", "x", slashed, "x", content, "x"),
                landed.row("3", "short"),
            ),
        ).alias("body"),
    )
    feed = orders.where(status == "F").select(
        "ticker", compact.alias("period"), content.alias("content"), "source_order"
    )
    parsed = rp.dispositions(rp.disposition_rows(documents).unionByName(feed), d.KEY_CODES)
    return shape(parsed, "ticker start end matching_minutes:l source_order")


@query("ingest_altered", """
SELECT DISTINCT CAST(o_custkey + 1000 AS VARCHAR) AS ticker FROM orders
WHERE (o_orderpriority = '5-LOW' AND o_orderstatus = 'P'
      OR o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' AND o_totalprice > 400000)""")
def ingest_altered(spark, sf):
    pending = d.table(spark, sf, "orders").where("o_orderstatus = 'P'")
    code = d.ticker_of(F.col("o_custkey"))
    twse = pending.where("o_orderpriority = '5-LOW'").select(F.concat(code, F.lit(" ")).alias("Code"))
    tpex = pending.where("o_orderpriority = '4-NOT SPECIFIED'").select(
        code.alias("SecuritiesCompanyCode"),
        F.when(F.col("o_totalprice") > 400000, "Ｙ").otherwise("Y").alias("AlteredTrading"),
    )
    return rp.altered(twse, tpex, d.KEY_CODES)


@query("ingest_revenue_json", "WITH " + b.REVENUE + """
SELECT ticker, month, revenue // 1000 * 1000 AS revenue FROM monthly""")
def ingest_revenue_json(spark, sf):
    """Documents of a month and up to ROWS_PER_DOCUMENT companies, landed and read back."""
    monthly = d.monthly_revenue(spark, sf)
    month = F.format_string("%03d%02d", landed.roc_year(F.col("month")), F.month("month"))
    good = F.struct(
        F.col("ticker").alias(rp.REVENUE_TICKER),
        month.alias(rp.REVENUE_MONTH),
        amount_in_thousands(F.col("revenue")).alias(rp.REVENUE_AMOUNT),
    )
    bad = F.struct(
        F.col("ticker").alias(rp.REVENUE_TICKER), F.lit("1x").alias(rp.REVENUE_MONTH), F.lit("--").alias(rp.REVENUE_AMOUNT)
    )
    part = F.floor((F.col("ticker").cast("bigint") - 1000) / landed.ROWS_PER_DOCUMENT)
    # A ticker has one row per month, so a document has at most twice ROWS_PER_DOCUMENT entries.
    bodies = monthly.groupBy("month", part.alias("part")).agg(
        F.to_json(F.flatten(F.collect_list(F.array(good, bad)))).alias("body")
    )
    layout = f"array<struct<`{rp.REVENUE_TICKER}`:string,`{rp.REVENUE_MONTH}`:string,`{rp.REVENUE_AMOUNT}`:string>>"
    documents = landed.read_back(bodies.select("body"), "revenue")
    return rp.revenue_rows(documents.select(F.inline(F.from_json("body", layout))), d.KEY_CODES)


def amount_in_thousands(revenue):
    return F.format_number(F.floor(revenue / 1000), 0)


PAGE_ROW = (
    "<tr align=right><td align=center>%s</td> <td align=left>¤¤</td><td nowrap> %s </td><td nowrap>1</td></tr>"
)
SUM_ROW = "<TR ALIGN=RIGHT><td align=center>0050</td><td align=left>x</td><td nowrap>1</td></TR>"


def revenue_html(monthly):
    """Pages of up to ROWS_PER_DOCUMENT companies; first ones with another amount, then the valid ones."""
    def listed(page, revenue):
        cells = F.format_string(PAGE_ROW, F.col("ticker"), amount_in_thousands(revenue))
        part = F.floor((F.col("ticker").cast("bigint") - 1000) / landed.ROWS_PER_DOCUMENT)
        # A ticker has one row per month, so a page has at most ROWS_PER_DOCUMENT rows.
        rows = monthly.groupBy("month", part.alias("part")).agg(F.array_join(F.collect_list(cells), "").alias("rows"))
        return rows.select("month", F.lit(page).alias("page"), F.concat(F.lit("<table>"), "rows", F.lit(SUM_ROW + "</table>")).alias("html"))

    return listed("p0", F.col("revenue") * 2).unionByName(listed("p3", F.col("revenue")))


@query("ingest_revenue_html", "WITH " + b.REVENUE + """
SELECT ticker, month, revenue // 1000 * 1000 AS revenue FROM monthly""")
def ingest_revenue_html(spark, sf):
    """Page files by month, read as bytes; a later file wins."""
    path = scratch_path(spark, "revenue")
    pages.write_pages(revenue_html(d.monthly_revenue(spark, sf)), path)
    return pages.revenue_of_pages(pages.read_pages(spark, path), d.KEY_CODES)


@query("dedupe_last_wins", "WITH " + b.QUOTES + """
SELECT ticker, CAST(date_trunc('month', trading_date) AS DATE) AS month, arg_max(trading_value, trading_date) AS trading_value
FROM quotes GROUP BY 1, 2""")
def dedupe_last_wins(spark, sf):
    rows = d.daily(spark, sf).select(
        "ticker", F.to_date(F.date_trunc("month", "trading_date")).alias("month"), "trading_date", "trading_value"
    )
    return pages.last_wins(rows, ("ticker", "month"), ("trading_date",)).select("ticker", "month", "trading_value")


@query("ingest_universe", "WITH " + b.LISTING + "SELECT market, ticker FROM listing")
def ingest_universe(spark, sf):
    listing = d.listing(spark, sf).select(d.ticker_of(F.col("s_suppkey")).alias("ticker"), "market")
    twice = listing.unionByName(listing.withColumn("ticker", F.concat("ticker", F.lit(" "))))
    twse = twice.where("market = 'TWSE'").select(F.col("ticker").alias(rp.REVENUE_TICKER))
    tpex = twice.where("market = 'TPEX'").select(F.col("ticker").alias("SecuritiesCompanyCode"))
    return rp.universe(twse, tpex, d.securities(spark, sf), d.KEY_CODES)


@query("ingest_holidays", "WITH " + b.LINES + "SELECT DISTINCT trading_date AS holiday FROM lines WHERE isodow(trading_date) > 5")
def ingest_holidays(spark, sf):
    days = d.daily(spark, sf).select("trading_date").distinct()
    name = F.when(F.weekday("trading_date") > 4, "例假日").otherwise("國曆新年開始交易日")
    return rp.holidays(days.select(name.alias("Name"), landed.roc_compact(F.col("trading_date")).alias("Date")))


@query("regular_quotes", "WITH " + b.QUOTES + """,
x AS (SELECT trading_date, CAST(l_suppkey + 1000 AS VARCHAR) AS ticker, sum(cents) AS v,
             sum(qty * CASE WHEN l_linenumber = 3 THEN 1000 ELSE 1 END) AS q
      FROM lines WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT market, ticker, name, trading_date, open_price, high_price, low_price, close_price,
       CAST(greatest(trading_value - coalesce(v, 0), 0) AS BIGINT) AS trading_value,
       CAST(greatest(trading_volume - coalesce(q, 0), 0) AS BIGINT) AS trading_volume, transaction_count
FROM quotes LEFT JOIN x USING (trading_date, ticker)""")
def regular_quotes(spark, sf):
    """Both daily reports, all seven deduction reports, regular trading left; stored by date and read back."""
    from turnbook.sources import snapshots

    quotes = d.daily_quotes(spark, sf)
    both = rp.daily_twse(landed.read_back(landed.twse_daily(quotes), "twse"), d.KEY_CODES).unionByName(
        rp.daily_tpex(landed.read_back(landed.tpex_daily(quotes), "tpex"), d.KEY_CODES)
    )
    excluded = qt.sum_non_regular(rp.non_regular(landed.non_regular(spark, sf), d.KEY_CODES))
    path = scratch_path(spark, "regular")
    regular = qt.regular_only(both, excluded)
    snapshots.write(regular, path, "trading_month")
    return shape(spark.read.parquet(path), QUOTE_SPEC)
