"""Market tables derived from the order, line item and event tables.

Suppliers act as listed shares and ship dates as trading dates.  Money is kept
in whole cents (bigint), so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from turnbook.functions import measures as m
from turnbook.operators import intraday as it

PRICE = "decimal(10,2)"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The keys of the given tables as codes, of any length; the generated documents also hold codes that start with 0.
KEY_CODES = r"^[1-9][0-9]{3,}\z"


def cents(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5).cast("bigint")


def price(in_cents: Column) -> Column:
    return (in_cents.cast("decimal(12,0)") / F.lit(100).cast("decimal(3,0)")).cast(PRICE)


def ticker_of(key: Column) -> Column:
    return (key + 1000).cast("string")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with cents, whole quantities and the unit price."""
    qty = F.col("l_quantity").cast("bigint")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("cents", cents(F.col("l_extendedprice")))
        .withColumn("qty", qty)
        .withColumn("unit", F.expr("cents div qty"))
        .withColumn("trading_date", F.to_date("l_shipdate"))
        .withColumn("regular", F.col("l_returnflag") != "R")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel without names: one row per (ticker, trading date).

    Combined before the shuffle, so one supplier with a third of all lines costs
    no more than any other.
    """
    regular = F.col("regular")
    grouped = (
        lines(spark, sf_dir)
        .groupBy("l_suppkey", "trading_date")
        .agg(
            F.sum("cents").alias("trading_value"),
            F.sum("qty").alias("trading_volume"),
            F.count(F.lit(1)).cast("int").alias("transaction_count"),
            F.sum(F.when(regular, F.col("cents"))).alias("_c"),
            F.sum(F.when(regular, F.col("qty"))).alias("_q"),
            F.max(F.when(regular, F.col("unit"))).alias("_high"),
            F.min(F.when(regular, F.col("unit"))).alias("_low"),
            F.max(F.when(F.col("l_returnflag") == "N", F.col("unit"))).alias("_open"),
            F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("_open_line"),
        )
    )
    return grouped.select(
        ticker_of(F.col("l_suppkey")).alias("ticker"),
        "l_suppkey",
        "trading_date",
        price(F.col("_open")).alias("open_price"),
        price(F.col("_high")).alias("high_price"),
        price(F.col("_low")).alias("low_price"),
        price(F.expr("(2 * _c + _q) div (2 * _q)")).alias("close_price"),
        "trading_value",
        "trading_volume",
        "transaction_count",
        "_open_line",
    )


def with_market(spark: SparkSession, sf_dir: str, rows: DataFrame, nation_key: str) -> DataFrame:
    """Add the market of a nation: TWSE for three of the five regions, TPEX for the others.

    The nations of the first market, at most 25 at every scale, come as one
    array, so ``rows`` is read once and keeps its size estimate.
    """
    nations = table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(0, 2, 4)).agg(F.collect_set("n_nationkey"))
    return rows.withColumn("market", F.when(F.array_contains(nations.scalar(), F.col(nation_key)), "TWSE").otherwise("TPEX"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers with their market, listed or not."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    return with_market(spark, sf_dir, rows, "s_nationkey").drop("s_nationkey")


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known shares; suppliers in debt are not listed, so their lines have no security."""
    return listing(spark, sf_dir).where(F.col("s_acctbal") >= 0).select(
        ticker_of(F.col("s_suppkey")).alias("ticker"), F.col("s_name").alias("name"), "market"
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel with just the columns of the calculators."""
    return bars(spark, sf_dir).drop("l_suppkey", "_open_line")


def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of every single trade, for totals that need no panel."""
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("trading_date"), cents(F.col("l_extendedprice")).alias("trading_value")
    )


def daily_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel with market and name; a name may change from one date to the next."""
    named = listing(spark, sf_dir).select("s_suppkey", "s_name", "market")
    return (
        bars(spark, sf_dir)
        .join(named, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "market",
            "ticker",
            F.concat("s_name", F.when(F.col("_open_line") == 1, " O").otherwise("")).alias("name"),
            "trading_date",
            "open_price",
            "high_price",
            "low_price",
            "close_price",
            "trading_value",
            "trading_volume",
            "transaction_count",
        )
    )


def non_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd-lot and block trades: returned lines, not yet summed."""
    return (
        lines(spark, sf_dir)
        .where(~F.col("regular"))
        .select(
            ticker_of(F.col("l_suppkey")).alias("ticker"),
            "trading_date",
            F.col("cents").alias("trading_value"),
            F.col("qty").alias("trading_volume"),
        )
    )


def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ex-dividend events: large, well discounted seventh lines."""
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_linenumber = 7 AND l_discount >= 0.09 AND l_quantity >= 45")
        .select(
            ticker_of(F.col("l_suppkey")).alias("ticker"),
            F.to_date("l_shipdate").alias("effective_date"),
            F.col("l_extendedprice").alias("previous_close"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("reference_price"),
        )
    )


def market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index value per date and market: order totals, in units of the order currency."""
    customer = with_market(
        spark, sf_dir, table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey"
    ).select("c_custkey", "market")
    return (
        table(spark, sf_dir, "orders")
        .select("o_custkey", F.to_date("o_orderdate").alias("trading_date"), cents(F.col("o_totalprice")).alias("c"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("trading_date", "market")
        .agg(F.sum("c").alias("c"))
        .select(
            "trading_date",
            "market",
            (F.col("c").cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)").alias("value"),
        )
    )


def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"))
        .agg(F.sum(cents(F.col("l_extendedprice"))).alias("revenue"))
        .select(ticker_of(F.col("l_suppkey")).alias("ticker"), "month", "revenue")
    )


def intraday_quotes(spark: SparkSession, sf_dir: str, since: Column | None = None) -> DataFrame:
    """Quotes of hourly rounds; every event adds to the turnover of its user."""
    events = table(spark, sf_dir, "events")
    events = events if since is None else events.where(F.col("ts") >= since)
    lots = F.get_json_object("props", "$.k").cast("bigint")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")
    return events.select(
        F.to_date("ts").alias("trade_date"),
        hour.alias("captured_at"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        ticker_of(F.col("user_id")).alias("ticker"),
        "event_id",
        "event_type",
        F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("price_cents"),
        lots.alias("lots"),
        (F.floor(F.col("value") * 100 + 0.5).cast("bigint") * lots * 1000).alias("turnover"),
    )


def round_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the hourly rounds as a feed reports them: what has been traded since the day began.

    Every thirteenth hour the reading is wrong, half of what it should be.
    """
    sums = it.round_totals(intraday_quotes(spark, sf_dir))
    # At most one row per round of a day.
    running = F.sum("turnover_total").over(W.partitionBy("trade_date").orderBy("captured_at"))
    wrong = F.floor(F.unix_seconds(F.col("captured_at").cast("timestamp")) / 3600) % 13 == 5
    totals = sums.withColumn("_running", running).withColumn("turnover_total", F.when(wrong, F.expr("_running div 2")).otherwise(F.col("_running")))
    return totals.select("trade_date", "captured_at", "turnover_total", "quote_count")


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of the newest round alone, found before anything is aggregated."""
    newest = table(spark, sf_dir, "events").agg(F.date_trunc("hour", F.max("ts")))
    return intraday_quotes(spark, sf_dir, since=newest.scalar())


def newest_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_quotes(spark, sf_dir, newest_events(spark, sf_dir))


def round_quotes(spark: SparkSession, sf_dir: str, quotes: DataFrame | None = None) -> DataFrame:
    """One row per round and ticker: last price, range of prices, turnover."""
    p = F.col("price_cents")
    quotes = intraday_quotes(spark, sf_dir) if quotes is None else quotes
    grouped = quotes.groupBy("trade_date", "captured_at", "ticker").agg(
        F.sum("turnover").alias("turnover"),
        F.max_by(p, F.col("event_id")).alias("_last"),
        F.min_by(p, F.col("event_id")).alias("_first"),
        F.max(p).alias("_high"),
        F.min(p).alias("_low"),
    )
    return grouped.select(
        "trade_date",
        "captured_at",
        "ticker",
        "turnover",
        price(F.col("_last")).alias("price"),
        price(F.col("_first")).alias("open_price"),
        price(F.col("_high")).alias("high_price"),
        price(F.col("_low")).alias("low_price"),
        m.percent_change(price(F.col("_last")), price(F.col("_first"))).cast("decimal(12,2)").alias("change_percent"),
    )


def runs(spark: SparkSession, sf_dir: str, newest: bool = False) -> DataFrame:
    """One row per round with two index values (highest and lowest price of the round)."""
    return (
        (newest_events(spark, sf_dir) if newest else intraday_quotes(spark, sf_dir))
        .groupBy("trade_date", "captured_at")
        .agg(
            F.sum("turnover").alias("turnover_total"),
            F.count(F.lit(1)).alias("quote_count"),
            price(F.max("price_cents")).alias("twse_index"),
            price(F.min("price_cents")).alias("tpex_index"),
        )
    )


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disposition notices: urgent and high priority orders, longer for higher priority numbers."""
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    start = F.to_date("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .select(
            ticker_of(F.col("o_custkey")).alias("ticker"),
            start.alias("start"),
            F.date_add(start, level * 10).alias("end"),
            (level * 5).alias("matching_minutes"),
            F.col("o_orderkey").alias("source_order"),
        )
    )


def altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares on full delivery: customers with a pending low priority order."""
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
        .select(ticker_of(F.col("o_custkey")).alias("ticker"))
        .distinct()
    )
