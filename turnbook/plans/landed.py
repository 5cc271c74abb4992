"""Landed report documents, derived from the market tables.

Daily reports hold up to ROWS_PER_DOCUMENT shares of a date, the others the rows
of one share, each with lines that ingest must skip; so the number of documents
grows with the data and no document grows without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnbook.session import scratch_path
from turnbook.sources import driver_tables as d
from turnbook.sources import reports as rp

ROWS_PER_DOCUMENT = 500


def amount(value: Column, decimals: int = 0) -> Column:
    """Number with thousands separators; dashes for a missing one."""
    return F.coalesce(F.format_number(value, decimals), F.lit("--"))


def roc_year(day: Column) -> Column:
    return F.year(day) - 1911


def roc_slashed(day: Column) -> Column:
    return F.format_string("%03d/%02d/%02d", roc_year(day), F.month(day), F.day(day))


def roc_compact(day: Column) -> Column:
    return F.format_string("%03d%02d%02d", roc_year(day), F.month(day), F.day(day))


def roc_worded(day: Column) -> Column:
    return F.format_string("%d年%02d月%02d日", roc_year(day), F.month(day), F.day(day))


def row(*cells) -> Column:
    return F.array(*[c if isinstance(c, Column) else F.lit(c) for c in cells])


def table(title: str, fields, *rows: Column) -> Column:
    heads = fields if isinstance(fields, Column) else F.array(*[F.lit(f) for f in fields]).cast("array<string>")
    return F.struct(F.lit(title).alias("title"), heads.alias("fields"), F.array(*rows).alias("data"))


def tables(*parts: Column) -> Column:
    return F.to_json(F.struct(F.lit("OK").alias("stat"), F.array(*parts).alias("tables")))


def flat(fields, rows: Column) -> Column:
    heads = F.array(*[F.lit(f) for f in fields]).cast("array<string>")
    return F.to_json(F.struct(F.lit("OK").alias("stat"), heads.alias("fields"), rows.alias("data")))


def titled(title: str, data: Column) -> Column:
    """A table whose rows are an array column."""
    return F.struct(F.lit(title).alias("title"), F.array().cast("array<string>").alias("fields"), data.alias("data"))


def _gathered(quotes: DataFrame, market: str, cells: Column) -> DataFrame:
    """Report rows of a market by date, up to ROWS_PER_DOCUMENT tickers in a document."""
    part = F.floor((F.col("ticker").cast("bigint") - 1000) / ROWS_PER_DOCUMENT)
    # A ticker has one row per date, so a document has at most ROWS_PER_DOCUMENT rows.
    grouped = quotes.where(F.col("market") == market).groupBy("trading_date", part.alias("part"))
    return grouped.agg(F.collect_list(cells).alias("rows"))


def twse_daily(quotes: DataFrame) -> DataFrame:
    cells = row(
        F.concat("ticker", F.lit(" ")),
        F.concat("name", F.lit(" ")),
        amount(F.col("trading_volume")),
        amount(F.col("transaction_count")),
        amount(F.col("trading_value")),
        amount(F.col("open_price"), 2),
        amount(F.col("high_price"), 2),
        amount(F.col("low_price"), 2),
        amount(F.col("close_price"), 2),
    )
    fund = F.array(row("0123", "fund", "1", "1", "1", "1", "1", "1", "1"))
    data = F.concat(fund, F.col("rows"), F.array(row("5678", "short row")))
    body = tables(titled("大盤統計資訊", F.array(row("x", "1"))), titled("103年 " + rp.TWSE_QUOTE_TITLE + "(全部)", data))
    return _gathered(quotes, "TWSE", cells).select("trading_date", body.alias("body"))


def tpex_daily(quotes: DataFrame) -> DataFrame:
    cells = row(
        F.col("ticker"),
        F.col("name"),
        amount(F.col("close_price"), 2),
        "+1.00",
        "1",
        amount(F.col("open_price"), 2),
        amount(F.col("high_price"), 2),
        amount(F.col("low_price"), 2),
        amount(F.col("trading_volume")),
        amount(F.col("trading_value")),
        amount(F.col("transaction_count")),
    )
    data = F.concat(F.col("rows"), F.array(row("04567L", "x", *["1"] * 9)))
    body = tables(titled(rp.TPEX_QUOTE_TITLE, data))
    return _gathered(quotes, "TPEX", cells).select("trading_date", body.alias("body"))


def read_back(documents: DataFrame, label: str) -> DataFrame:
    """Documents written as files of one JSON line each and read from there."""
    path = scratch_path(documents.sparkSession, label)
    documents.write.json(path)
    return documents.sparkSession.read.schema(documents.schema).json(path)


def with_points(index: DataFrame) -> DataFrame:
    """Index rows with their change in points; the first date of a market has none."""
    previous = F.lag("value").over(W.partitionBy("market").orderBy("trading_date"))
    return index.withColumn("points", F.col("value") - previous)


def _signed(points: Column) -> Column:
    return F.when(points.isNull(), F.lit("--")).otherwise(
        F.concat(F.when(points >= 0, "+").otherwise(""), F.format_number(points, 2))
    )


def twse_index(index: DataFrame) -> DataFrame:
    """Price index tables; on some weekdays with a percent column, on others with points only."""
    value, points = amount(F.col("value"), 2), _signed(F.col("points"))
    with_percent = tables(
        table(
            rp.PRICE_INDEX_TITLE + "(臺灣證券交易所)",
            ["指數", "收盤指數", "漲跌(+/-)", "漲跌點數", "漲跌百分比(%)"],
            row("寶島股價指數", "1.00", "+", "1.00", "9.99"),
            row(rp.TWSE_INDEX_NAME, value, "+", points, "+1.25"),
        )
    )
    points_only = tables(
        table(
            rp.PRICE_INDEX_TITLE,
            ["指數", "收市", "漲跌"],
            row(rp.TWSE_INDEX_NAME, value, points),
        )
    )
    body = F.when(F.weekday("trading_date") < 2, with_percent).otherwise(points_only)
    return index.where("market = 'TWSE' AND weekday(trading_date) < 4").select("trading_date", body.alias("body"))


def twse_summary(index: DataFrame) -> DataFrame:
    """Market summaries: the wanted date and a neighbouring one."""
    value, points = amount(F.col("value"), 2), _signed(F.col("points"))
    other = F.date_add("trading_date", 1)
    rows = F.array(
        row(roc_slashed(other), "1", "1", "1", "99.00", "1.00"),
        row(roc_slashed(F.col("trading_date")), "1", "1", "1", value, points),
    )
    body = flat(["日期", "成交股數", "成交金額", "成交筆數", rp.TWSE_INDEX_NAME, "漲跌點數"], rows)
    return index.where("market = 'TWSE' AND weekday(trading_date) >= 4").select("trading_date", body.alias("body"))


def tpex_index(index: DataFrame) -> DataFrame:
    value, points = amount(F.col("value"), 2), _signed(F.col("points"))
    body = tables(
        table(
            "櫃買指數",
            ["日期", "開市", "最高", "最低", "收市", "漲/跌"],
            row(roc_slashed(F.date_sub("trading_date", 1)), "1", "1", "1", "77.00", "1.00"),
            row(roc_slashed(F.col("trading_date")), "1", "1", "1", value, points),
        )
    )
    return index.where("market = 'TPEX'").select("trading_date", body.alias("body"))


# Line numbers 1 to 7 stand for the seven reports, in this order.
REPORT_OF_LINE = tuple(rp.NON_REGULAR_REPORTS)


def non_regular(spark, sf: str) -> DataFrame:
    """One document per returned line, in the layout of the report its line number stands for."""
    lines = d.lines(spark, sf).where(~F.col("regular"))
    ticker, value, volume = d.ticker_of(F.col("l_suppkey")), amount(F.col("cents")), amount(F.col("qty"))
    name, data = F.lit(None).cast("string"), F.lit(None).cast("array<array<string>>")
    for line, report in enumerate(REPORT_OF_LINE, 1):
        at_ticker, at_volume, at_value, _ = rp.NON_REGULAR_REPORTS[report]
        cells = [F.lit("-")] * (max(at_ticker, at_volume, at_value) + 1)
        total = list(cells)
        cells[at_ticker], cells[at_volume], cells[at_value] = ticker, volume, value
        total[at_ticker], total[at_volume], total[at_value] = F.lit("總計"), volume, value
        here = F.col("l_linenumber") == line
        name = F.when(here, report).otherwise(name)
        data = F.when(here, F.array(row(*cells), row(*total))).otherwise(data)
    rows = lines.select("trading_date", name.alias("report_name"), data.alias("data"))
    in_table = F.to_json(F.struct(F.array(F.struct(F.col("data"))).alias("tables")))
    flat_body = F.to_json(F.struct(F.col("data")))
    body = F.when(F.startswith(F.col("report_name"), F.lit("tpex")), in_table).otherwise(flat_body)
    return rows.select("trading_date", "report_name", body.alias("body"))


def adjustments(spark, sf: str, market: str) -> DataFrame:
    listing = d.listing(spark, sf).select(d.ticker_of(F.col("s_suppkey")).alias("ticker"), "market")
    events = d.adjustments(spark, sf).join(listing.where(F.col("market") == market), "ticker")
    before = amount(F.col("previous_close"), 2)
    after = amount(d.cents(F.col("reference_price")) / 100, 2)
    day = F.col("effective_date")
    if market == "TWSE":
        heads = [*rp.TWSE_EVENT_FIELDS, "股票名稱", rp.PREVIOUS_CLOSE_FIELD, rp.REFERENCE_PRICE_FIELD]
        rows = F.array(
            row(roc_worded(day), F.col("ticker"), "x", before, after), row("103年07月22日", "0123", "x", "--", "--")
        )
        return events.select(flat(heads, rows).alias("body"))
    heads = [*rp.TPEX_EVENT_FIELDS, "名稱", rp.PREVIOUS_CLOSE_FIELD, rp.REFERENCE_PRICE_FIELD]
    return events.select(tables(table("除權息", heads, row(roc_slashed(day), F.col("ticker"), "x", before, after))).alias("body"))


def raw_items(spark, sf: str) -> DataFrame:
    """Feed entries: each event fills other fields of the quote, so every price source occurs.

    Sign-ups stand for the two index channels.
    """
    return items_of(d.intraday_quotes(spark, sf))


def items_of(e: DataFrame) -> DataFrame:
    price = F.col("price_cents").cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")
    text = F.format_string("%.4f", price.cast("double"))
    ask = F.format_string("%.4f", ((F.col("price_cents") + 5) / 100))
    kind, lots = F.col("event_type"), F.col("lots")
    signup = kind == "signup"

    def given(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(F.lit("-"))

    return e.select(
        "captured_at",
        "event_id",
        F.when(signup, F.when(lots < 50, "t00").otherwise("o00")).otherwise(F.col("ticker")).alias("c"),
        F.concat(F.lit("Share "), F.col("ticker")).alias("n"),
        F.when(lots < 50, "tse").otherwise("otc").alias("ex"),
        F.date_format("trade_date", "yyyyMMdd").alias("d"),
        given((kind == "purchase") | signup, text).alias("z"),
        given((kind == "click") & (lots < 30), text).alias("pz"),
        given((kind == "click") & (lots >= 60), F.concat(ask, F.lit("_99.0000_"))).alias("a"),
        given((kind == "click") & (lots >= 30), F.concat(text, F.lit("_1.0000_"))).alias("b"),
        given((kind == "view") & (lots >= 50), text).alias("o"),
        given((kind == "view") & (lots < 50), ask).alias("h"),
        given((kind == "view") & (lots < 50), text).alias("l"),
        given((kind != "error") | (lots >= 20), F.format_string("%.2f", (F.col("price_cents") + 10) / 100)).alias("y"),
        F.format_number(lots, 0).alias("v"),
    )


def messages(spark, sf: str) -> DataFrame:
    items = raw_items(spark, sf)
    fields = [c for c in items.columns if c not in ("captured_at", "event_id")]
    return items.select(
        "captured_at", F.lit("collector").alias("source"), F.array(F.struct(*fields)).alias("msgArray")
    )


# Shares that the collector asks for at a time.
SHARES_PER_RESPONSE = 150


def responses(spark, sf: str) -> DataFrame:
    """Raw responses of two-minute rounds between 07:00 and 13:35 Taipei, with a tick of the clock for every weekday.

    A round has each share that traded in its two minutes, 150 to a response,
    and the index channels in its first and last response.  By its number a
    response is cut off, lost, five minutes late or 26 hours late.
    """
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    trades = d.intraday_quotes(spark, sf).where("event_type <> 'signup'").withColumn("slot", F.floor(seconds / 120))
    minute = (F.col("slot") * 2 + 480) % 1440
    trades = trades.where((minute >= 420) & (minute < 815)).withColumn("captured_at", F.timestamp_seconds(F.col("slot") * 120).cast("timestamp_ntz"))
    fields = ["event_id", "event_type", "price_cents", "lots", "trade_date"]
    last = trades.groupBy("captured_at", "slot", "ticker").agg(F.max_by(F.struct(*fields), "event_id").alias("e"))
    last = last.select("captured_at", "slot", "ticker", "e.*")
    items = items_of(last)
    entry = F.struct(*[c for c in items.columns if c not in ("captured_at", "event_id")])
    keyed = items.select("captured_at", "event_id", entry.alias("item")).join(last.select("captured_at", "event_id", "slot", "ticker", "price_cents"), ["captured_at", "event_id"])
    part = F.floor((F.col("ticker").cast("bigint") - 1000) / SHARES_PER_RESPONSE).cast("int")
    # At most SHARES_PER_RESPONSE entries, then at most as many rows of a round as it has responses.
    grouped = keyed.groupBy("captured_at", "slot", part.alias("part")).agg(
        F.sort_array(F.collect_list("item")).alias("items"), F.max("price_cents").alias("high"), F.min("price_cents").alias("low")
    )
    own = W.partitionBy("captured_at")
    rounds = grouped.withColumns({
        "parts": F.count(F.lit(1)).over(own).cast("int"), "first": F.min("part").over(own), "last": F.max("part").over(own),
        "high": F.max("high").over(own), "low": F.min("low").over(own),
    })
    day, high, low = F.date_format("captured_at", "yyyyMMdd"), *[F.format_string("%.2f", F.col(c) / 100) for c in ("high", "low")]

    def index(code: str, exchange: str, z, y) -> Column:
        given = {"c": F.lit(code), "ex": F.lit(exchange), "d": day, "z": z, "y": y}
        return F.struct(*[given.get(f, F.lit("-")).alias(f) for f in entry_fields])

    entry_fields = [c for c in items.columns if c not in ("captured_at", "event_id")]
    opening = F.array(index("t00", "tse", high, low), index("o00", "otc", low, high))
    closing = F.array(index("t00", "tse", F.lit("-"), low))
    extra = F.when(F.col("part") == F.col("first"), opening).otherwise(F.when(F.col("part") == F.col("last"), closing).otherwise(F.slice(closing, 1, 0)))
    body = F.to_json(F.struct(F.concat("items", extra).alias("msgArray")))
    fault = (F.col("slot") * 7 + F.col("part") * 3) % 40
    late = F.when(fault == 3, 300).when(fault == 4, 93600).otherwise(0)
    arrival = F.timestamp_seconds(F.col("slot") * 120 + 10 + F.col("part") + late).cast("timestamp_ntz")
    sent = rounds.where(fault != 2).select(
        "captured_at", F.lit("collector").alias("source"), "part", "parts", arrival.alias("arrival"),
        F.when(fault == 1, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body).alias("body"),
    )
    return sent.unionByName(ticks(spark, sf))


def ticks(spark, sf: str) -> DataFrame:
    """A tick an hour after each weekday's session, and one three days after the last, which lets every timer run out."""
    days = d.intraday_quotes(spark, sf).agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"))
    due = days.select(F.explode(F.sequence("first", "last")).alias("day"), "last").where((F.weekday("day") < 5) | (F.col("day") == F.col("last")))
    end = due.withColumn("end", F.unix_seconds(F.col("day").cast("timestamp")) + (13 * 60 + 34 - 480) * 60)
    wait = F.explode(F.when(F.col("day") == F.col("last"), F.array(F.lit(3600), F.lit(4 * 86400))).otherwise(F.array(F.lit(3600))))
    ticked = end.select("end", wait.alias("wait"))
    none = lambda kind: F.lit(None).cast(kind)
    return ticked.select(
        F.timestamp_seconds("end").cast("timestamp_ntz").alias("captured_at"), F.lit("clock").alias("source"), none("int").alias("part"),
        none("int").alias("parts"), F.timestamp_seconds(F.col("end") + F.col("wait")).cast("timestamp_ntz").alias("arrival"), none("string").alias("body"),
    )
