"""Ingest of landed exchange reports.

Every function takes a frame of documents, one report per row, and explodes it
into typed rows; documents are never gathered, so files can be split freely.
``codes`` is the pattern of the tickers to keep, the common shares by default.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from turnbook.functions import measures as m, parsing as p
from turnbook.schemas import INDEX_VALUE, REPORT, TPEX, TWSE

# Titles, headers and marks used in the exchange reports.
TWSE_QUOTE_TITLE = "每日收盤行情"
TPEX_QUOTE_TITLE = "上櫃股票行情"
PRICE_INDEX_TITLE = "價格指數"
TWSE_INDEX_NAME = "發行量加權股價指數"
INDEX_NAME_FIELDS = ("指數",)
INDEX_VALUE_FIELDS = ("收盤指數", "收市")
PERCENT_FIELDS = ("漲跌百分比(%)", "漲跌百分比")
POINT_FIELDS = ("漲跌點數", "漲跌")
DATE_FIELDS = ("日期",)
TPEX_VALUE_FIELDS = ("收市", "收盤", "收盤指數")
TPEX_POINT_FIELDS = ("漲/跌", "漲跌", "漲跌點數")
SUMMARY_POINT_FIELDS = ("漲跌點數",)
OPEN_DAY_WORD = "交易日"
ALTERED_MARK = "Ｙ"
TWSE_EVENT_FIELDS = ("資料日期", "股票代號")
TPEX_EVENT_FIELDS = ("除權息日期", "代號")
PREVIOUS_CLOSE_FIELD = "除權息前收盤價"
REFERENCE_PRICE_FIELD = "除權息參考價"
REVENUE_TICKER, REVENUE_MONTH, REVENUE_AMOUNT = "公司代號", "資料年月", "營業收入-當月營收"

# Report -> (ticker, volume, value) columns and shares per volume unit.
NON_REGULAR_REPORTS = {
    "twse_odd_lot": (0, 2, 4, 1),
    "twse_after_hours_odd_lot": (0, 2, 4, 1),
    "twse_fixed_price": (0, 2, 4, 1000),
    "twse_block": (0, 4, 5, 1),
    "tpex_odd_lot": (0, 7, 8, 1),
    "tpex_after_hours_odd_lot": (0, 2, 4, 1),
    "tpex_block": (2, 5, 6, 1),
}

# Positions in the daily quote tables.
TWSE_COLUMNS = {"volume": 2, "count": 3, "value": 4, "open": 5, "high": 6, "low": 7, "close": 8}
TPEX_COLUMNS = {"close": 2, "open": 5, "high": 6, "low": 7, "volume": 8, "value": 9, "count": 10}


def parse_report(documents: DataFrame, body: str = "body") -> DataFrame:
    """Parse the JSON text of each document into the common report layout."""
    return documents.withColumn("report", F.from_json(body, REPORT))


def _table_titled(word: str) -> Column:
    hits = F.filter("report.tables", lambda t: F.contains(t["title"], F.lit(word)))
    return F.get(hits, F.lit(0))


def _quotes(documents: DataFrame, market: str, title: str, at: dict[str, int], width: int, codes: str) -> DataFrame:
    rows = (
        parse_report(documents)
        .select("trading_date", F.explode(_table_titled(title)["data"]).alias("r"))
        .where(F.size("r") >= width)
        .withColumn("ticker", F.trim(p.cell(F.col("r"), 0)))
        .where(p.is_code(F.col("ticker"), codes))
    )

    def text(name: str) -> Column:
        return p.cell(F.col("r"), at[name])

    def price(name: str) -> Column:
        return p.number(text(name)).cast("decimal(10,2)").alias(f"{name}_price")

    return rows.select(
        F.lit(market).alias("market"),
        "ticker",
        F.coalesce(F.trim(p.cell(F.col("r"), 1)), F.col("ticker")).alias("name"),
        "trading_date",
        price("open"),
        price("high"),
        price("low"),
        price("close"),
        p.whole(text("value")).alias("trading_value"),
        p.whole(text("volume")).alias("trading_volume"),
        p.whole(text("count")).cast("int").alias("transaction_count"),
    )


def daily_twse(documents: DataFrame, codes: str = p.COMMON_STOCK_PATTERN) -> DataFrame:
    """``documents``: trading_date, body."""
    return _quotes(documents, TWSE, TWSE_QUOTE_TITLE, TWSE_COLUMNS, 9, codes)


def daily_tpex(documents: DataFrame, codes: str = p.COMMON_STOCK_PATTERN) -> DataFrame:
    return _quotes(documents, TPEX, TPEX_QUOTE_TITLE, TPEX_COLUMNS, 11, codes)


def _index_row(rows: DataFrame, market: str, percent: Column, points: Column, value: Column) -> DataFrame:
    read = rows.select("trading_date", value.alias("value"), percent.alias("percent"), points.alias("points"), "pos")
    change = F.coalesce(F.col("percent"), m.percent_from_points(F.col("points"), F.col("value")))
    found = read.where(F.col("value") > 0).select(
        "trading_date",
        "pos",
        F.struct(F.col("value").cast(INDEX_VALUE).alias("value"), change.cast("decimal(10,4)").alias("change")).alias("v"),
    )
    return (
        found.groupBy("trading_date")
        .agg(F.min_by("v", "pos").alias("v"))
        .select("trading_date", F.lit(market).alias("market"), "v.value", F.col("v.change").alias("change_percent"))
    )


def _number_at(index: Column) -> Column:
    return F.when(index.isNotNull(), p.number(p.cell(F.col("r"), index)))


def index_twse(documents: DataFrame) -> DataFrame:
    """Weighted index of the price index table, columns found by header."""
    table = parse_report(documents).select("trading_date", _table_titled(PRICE_INDEX_TITLE).alias("t")).select(
        "trading_date", F.coalesce("t.fields", F.array().cast("array<string>")).alias("f"), F.posexplode("t.data").alias("pos", "r")
    )
    fields = F.col("f")
    name_at = F.coalesce(p.field_index(fields, *INDEX_NAME_FIELDS), F.lit(0))
    value_at = F.coalesce(
        p.field_index(fields, *INDEX_VALUE_FIELDS), F.when(F.size(fields) > 1, F.lit(1)).otherwise(F.lit(0))
    )
    rows = table.where(F.contains(p.cell(F.col("r"), name_at), F.lit(TWSE_INDEX_NAME)))
    # Only the first row of that name counts.
    first = rows.groupBy("trading_date").agg(F.min_by(F.struct("f", "r", "pos"), "pos").alias("s")).select("trading_date", "s.*")
    return _index_row(
        first,
        TWSE,
        _number_at(p.field_index(fields, *PERCENT_FIELDS)),
        _number_at(p.field_index(fields, *POINT_FIELDS)),
        _number_at(value_at),
    )


def index_twse_summary(documents: DataFrame) -> DataFrame:
    """Weighted index of the monthly market summary: the row of the wanted date."""
    table = parse_report(documents).select(
        "trading_date", F.col("report.fields").alias("f"), F.posexplode("report.data").alias("pos", "r")
    )
    fields = F.col("f")
    row_date = p.roc_date_parts(p.cell(F.col("r"), p.field_index(fields, *DATE_FIELDS)))
    rows = table.where(row_date == F.col("trading_date"))
    return _index_row(
        rows,
        TWSE,
        F.lit(None).cast(p.NUMBER),
        _number_at(p.field_index(fields, *SUMMARY_POINT_FIELDS)),
        _number_at(p.field_index(fields, TWSE_INDEX_NAME)),
    )


def index_tpex(documents: DataFrame) -> DataFrame:
    """Counter market index: first row of the date (or without one) with a positive value."""
    with_data = F.get(F.filter("report.tables", lambda t: t["data"].isNotNull()), F.lit(0))
    table = parse_report(documents).select("trading_date", with_data.alias("t")).select(
        "trading_date", F.coalesce("t.fields", F.array().cast("array<string>")).alias("f"), F.posexplode("t.data").alias("pos", "r")
    )
    fields = F.col("f")
    row_date = p.roc_or_common_date(p.cell(F.col("r"), F.coalesce(p.field_index(fields, *DATE_FIELDS), F.lit(0))))
    rows = table.where(row_date.isNull() | (row_date == F.col("trading_date")))
    return _index_row(
        rows,
        TPEX,
        _number_at(p.field_index(fields, *PERCENT_FIELDS)),
        _number_at(F.coalesce(p.field_index(fields, *TPEX_POINT_FIELDS), F.lit(5))),
        _number_at(F.coalesce(p.field_index(fields, *TPEX_VALUE_FIELDS), F.lit(4))),
    )


def non_regular(documents: DataFrame, codes: str = p.COMMON_STOCK_PATTERN) -> DataFrame:
    """``documents``: trading_date, report_name, body.  Rows of all seven reports, one unit."""
    layout = F.create_map(
        *[
            part
            for name, (ticker, volume, value, scale) in NON_REGULAR_REPORTS.items()
            for part in (
                F.lit(name),
                F.struct(
                    F.lit(ticker).alias("ticker"),
                    F.lit(volume).alias("volume"),
                    F.lit(value).alias("value"),
                    F.lit(scale).alias("scale"),
                ),
            )
        ]
    )
    # One exchange puts rows at the top level, the other into every table.
    empty = F.array().cast("array<array<string>>")
    in_tables = F.flatten(
        F.transform(
            F.coalesce("report.tables", F.array().cast("array<struct<title:string,fields:array<string>,data:array<array<string>>>>")),
            lambda t: F.coalesce(t["data"], empty),
        )
    )
    all_rows = F.when(F.startswith(F.col("report_name"), F.lit("tpex")), in_tables).otherwise(
        F.coalesce("report.data", empty)
    )
    return (
        parse_report(documents)
        .withColumn("at", layout[F.col("report_name")])
        .select("trading_date", "report_name", "at", F.explode(all_rows).alias("r"))
        .select(
            "trading_date",
            F.when(F.startswith(F.col("report_name"), F.lit("tpex")), TPEX).otherwise(TWSE).alias("market"),
            "report_name",
            F.trim(p.cell(F.col("r"), F.col("at.ticker"))).alias("ticker"),
            p.whole(p.cell(F.col("r"), F.col("at.value"))).alias("trading_value"),
            (p.number_or_zero(p.cell(F.col("r"), F.col("at.volume"))) * F.col("at.scale")).cast("bigint").alias("trading_volume"),
        )
        .where(p.is_code(F.col("ticker"), codes))
    )


def _fail_unless(condition: Column, message: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(message).cast("string"))


def adjustments(documents: DataFrame, market: str, strict: bool = True, codes: str = p.COMMON_STOCK_PATTERN) -> DataFrame:
    """Ex-right and dividend events; a share whose prices or date cannot be read fails the load.

    With ``strict=False`` such rows come back with ``broken`` set instead.
    """
    date_field, ticker_field = TWSE_EVENT_FIELDS if market == TWSE else TPEX_EVENT_FIELDS
    parsed = parse_report(documents)
    fields = F.col("report.fields") if market == TWSE else F.get("report.tables", F.lit(0))["fields"]
    data = F.col("report.data") if market == TWSE else F.get("report.tables", F.lit(0))["data"]
    required = [date_field, ticker_field, PREVIOUS_CLOSE_FIELD, REFERENCE_PRICE_FIELD]
    usable = F.coalesce(
        (F.lower("report.stat") == "ok") & (F.size(F.array_intersect(fields, F.array(*map(F.lit, required)))) == len(required)) & data.isNotNull(),
        F.lit(False),
    )
    checked = parsed.withColumn(
        "ok", _fail_unless(usable, F.lit(f"{market}: report without the needed headers"), F.lit("yes"))
    )
    rows = checked.where(F.col("ok") == "yes").select(fields.alias("f"), F.explode(data).alias("r"))

    def text(name: str) -> Column:
        return p.cell(F.col("r"), p.field_index(F.col("f"), name))

    typed = (
        rows.withColumn("ticker", F.trim(text(ticker_field)))
        .where(p.is_code(F.col("ticker"), codes))
        .select(
            "ticker",
            p.roc_date_parts(text(date_field)).alias("effective_date"),
            p.number(text(PREVIOUS_CLOSE_FIELD)).alias("previous_close"),
            p.number(text(REFERENCE_PRICE_FIELD)).alias("reference_price"),
            F.lit(market).alias("market"),
        )
    )
    good = F.coalesce(
        F.col("effective_date").isNotNull() & (F.col("previous_close") > 0) & (F.col("reference_price") > 0), F.lit(False)
    )
    if not strict:
        return typed.withColumn("broken", ~good)
    message = F.concat(F.lit(f"{market}: cannot read prices or date of "), F.col("ticker"))
    return typed.withColumn("ticker", _fail_unless(good, message, F.col("ticker")))


def month_ranges(start: dt.date, end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """Calendar-month slices of a date range, without gaps; what one report file covers."""
    if end < start:
        raise ValueError("end before start")
    slices = []
    while start <= end:
        following = dt.date(start.year + start.month // 12, start.month % 12 + 1, 1)
        stop = min(following - dt.timedelta(days=1), end)
        slices.append((start, stop))
        start = stop + dt.timedelta(days=1)
    return slices


def dispositions(notices: DataFrame, codes: str = p.COMMON_STOCK_PATTERN) -> DataFrame:
    """``notices``: ticker, period, content, source_order.  Unreadable periods are dropped."""
    ends = F.transform(F.split("period", "[～~]"), lambda end: p.roc_date_compact(end))
    start, end = F.get("_ends", F.lit(0)), F.get("_ends", F.lit(1))
    return (
        notices.withColumn("ticker", F.trim("ticker"))
        .where(p.is_code(F.col("ticker"), codes))
        # A generated column is read once; conditions on a plain one would each read the period again.
        .select("ticker", F.explode(F.array(ends)).alias("_ends"), "content", "source_order")
        .where((F.size("_ends") == 2) & start.isNotNull() & end.isNotNull())
        .select(
            "ticker",
            start.alias("start"),
            end.alias("end"),
            p.matching_minutes(F.col("content")).alias("matching_minutes"),
            "source_order",
        )
    )


def disposition_rows(documents: DataFrame) -> DataFrame:
    """Rows of the positional notice report (columns 2, 6 and 8 of at least nine)."""
    return (
        parse_report(documents)
        .select("source_order", F.posexplode("report.data").alias("pos", "r"))
        .where(F.size("r") >= 9)
        .select(
            p.cell(F.col("r"), 2).alias("ticker"),
            p.cell(F.col("r"), 6).alias("period"),
            p.cell(F.col("r"), 8).alias("content"),
            (F.col("source_order") + F.col("pos")).alias("source_order"),
        )
    )


def altered(twse: DataFrame, tpex: DataFrame, codes: str = p.COMMON_STOCK_PATTERN) -> DataFrame:
    """``twse``: Code.  ``tpex``: SecuritiesCompanyCode, AlteredTrading (only the full-width mark counts)."""
    listed = twse.select(F.trim("Code").alias("ticker"))
    marked = tpex.where(F.trim("AlteredTrading") == ALTERED_MARK).select(F.trim("SecuritiesCompanyCode").alias("ticker"))
    return listed.union(marked).where(p.is_code(F.col("ticker"), codes)).distinct()


def revenue_rows(rows: DataFrame, codes: str = p.COMMON_STOCK_PATTERN) -> DataFrame:
    """Latest revenue feed; every row carries its own month, amounts are in thousands."""
    return (
        rows.select(
            F.trim(F.col(f"`{REVENUE_TICKER}`")).alias("ticker"),
            p.roc_month(F.col(f"`{REVENUE_MONTH}`")).alias("month"),
            p.thousands(F.col(f"`{REVENUE_AMOUNT}`")).alias("revenue"),
        )
        .where(p.is_code(F.col("ticker"), codes) & F.col("month").isNotNull() & F.col("revenue").isNotNull())
    )


def universe(twse: DataFrame, tpex: DataFrame, fallback: DataFrame, codes: str = p.COMMON_STOCK_PATTERN) -> DataFrame:
    """Listed tickers of both markets; when one side is empty the known securities are used."""

    def side(rows: DataFrame, column: str, market: str) -> DataFrame:
        return (
            rows.select(F.trim(column).alias("ticker"))
            .where(p.is_code(F.col("ticker"), codes))
            .distinct()
            .select(F.lit(market).alias("market"), "ticker")
        )

    both = side(twse, REVENUE_TICKER, TWSE).unionByName(side(tpex, "SecuritiesCompanyCode", TPEX))
    sides = both.agg(F.count_distinct("market").alias("n")).scalar()
    fresh = both.withColumn("_sides", sides).where("_sides = 2").drop("_sides")
    spare = fallback.select("market", "ticker").withColumn("_sides", sides).where("_sides < 2").drop("_sides")
    return fresh.unionByName(spare)


def holidays(rows: DataFrame) -> DataFrame:
    """``rows``: Name, Date.  Entries that name a trading day are open days."""
    return (
        rows.where(F.col("Name").isNull() | ~F.contains(F.col("Name"), F.lit(OPEN_DAY_WORD)))
        .select(p.roc_date_compact(F.col("Date")).alias("holiday"))
        .where(F.col("holiday").isNotNull())
        .distinct()
    )
