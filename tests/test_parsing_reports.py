from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from turnbook.functions import measures as m, parsing as p
from turnbook.sources import reports as rp, revenue_pages as pages


def apply(spark, make, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [x.v for x in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    got = apply(spark, p.number, "1,234.5", "+7", "--", "---", "", " ", None, "　12　", "abc", "-3", "0")
    assert got == [Decimal("1234.5"), 7, None, None, None, None, None, 12, None, -3, 0]
    assert apply(spark, p.whole, "1,999.9", "--", None) == [1999, 0, 0]


def test_common_stock(spark):
    got = apply(spark, p.is_common_stock, "1234", "9876", "0123", "04567L", "07654T", "1234B", "合計", "", None, "1234\n", "１２３４")
    assert got == [True, True] + [False] * 9


def test_dates(spark):
    assert apply(spark, p.roc_date_compact, "1150812", "115/08/12", "1150230", "11508", "115081x", None) == [
        dt.date(2026, 8, 12), dt.date(2026, 8, 12), None, None, None, None]
    assert apply(spark, p.roc_date_parts, "101年02月29日", "99/11/07", "84/1/2", "x", "101/13/01") == [
        dt.date(2012, 2, 29), dt.date(2010, 11, 7), dt.date(1995, 1, 2), None, None]
    assert apply(spark, p.roc_or_common_date, "115/08/18", "2026-08-18", "115-8-8", "") == [
        dt.date(2026, 8, 18), dt.date(2026, 8, 18), dt.date(2026, 8, 8), None]
    assert apply(spark, p.roc_month, "11507", "11513", "1507x", None) == [dt.date(2026, 7, 1), None, None, None]
    assert apply(spark, p.compact_date, "20260818", "20260231", "-") == [dt.date(2026, 8, 18), None, None]


def test_matching_minutes(spark):
    said = ["2", "２０", "二", "五", "十", "二十", "二十五", "十五", "百"]
    texts = [f"（約每{x}分鐘撮合一次）" for x in said] + ["無", None]
    assert apply(spark, p.matching_minutes, *texts) == [2, 20, 2, 5, 10, 20, 25, 15, None, None, None]


def test_rounding(spark):
    row = spark.range(1).select(
        m.half_even(F.lit(Decimal("2.5")), 0).alias("even"), m.half_away(F.lit(Decimal("2.5")), 0).alias("away"),
        m.significant(F.lit(0.000123456789)).alias("small"), m.significant(F.lit(0.0)).alias("zero"),
        m.significant(F.lit(-12.3456789012)).alias("minus"),
    ).first()
    assert (row.even, row.away, row.small, row.zero, row.minus) == (2, 3, 0.00012345679, 0.0, -12.345679)


def test_session_progress(spark):
    stamps = ["2026-08-18 00:59:00", "2026-08-18 01:00:00", "2026-08-18 01:27:00", "2026-08-18 03:15:00", "2026-08-18 06:00:00"]
    got = apply(spark, lambda t: m.session_progress(t.cast("timestamp_ntz")), *stamps)
    assert got == pytest.approx([0, 0, 0.1, 0.5, 1])
    got = apply(spark, lambda t: m.projected_close(F.lit(100), m.session_progress(t.cast("timestamp_ntz"))), *stamps)
    assert got == [None, None, pytest.approx(1000), 200, 100]
    assert apply(spark, lambda t: m.slot_of(m.taipei(t.cast("timestamp_ntz"))), "2026-08-18 01:03:59") == [542]


def documents(spark, *bodies, date="2026-08-18", **extra):
    names = "".join(f", {k} string" for k in extra)
    rows = [(dt.date.fromisoformat(date), b if isinstance(b, str) else json.dumps(b, ensure_ascii=False), *extra.values()) for b in bodies]
    return spark.createDataFrame(rows, "trading_date date, body string" + names)


def test_daily_reports(spark):
    twse = {"tables": [{"title": "每日收盤行情", "data": [
        ["4321", "甲", "64,300", "81", "3,279,300", "50.50", "52.10", "49.95", "51.00"],
        ["04567L", "x", "1", "1", "1", "1", "1", "1", "1"], ["5678", "no trade", "0", "0", "0", "--", "--", "--", "--"]]}]}
    rows = {x.ticker: x for x in rp.daily_twse(documents(spark, twse, {"stat": "nothing"}, "broken{")).collect()}
    x = rows["4321"]
    assert [float(v) for v in (x.open_price, x.high_price, x.low_price, x.close_price)] == [50.5, 52.1, 49.95, 51]
    assert (x.trading_volume, x.transaction_count, x.trading_value) == (64_300, 81, 3_279_300)
    assert rows["5678"].close_price is None and set(rows) == {"5678", "4321"}
    assert {x.ticker for x in rp.daily_twse(documents(spark, twse), r"^[0-9]+[A-Z]?\z").collect()} == {"4321", "04567L", "5678"}
    tpex = {"tables": [{"title": "上櫃股票行情", "data": [
        ["7654", "乙", "18.35", "-0.15", "18.40", "18.60", "18.90", "18.20", "24,000", "442,180", "37"]]}]}
    x = rp.daily_tpex(documents(spark, tpex)).first()
    assert [float(v) for v in (x.open_price, x.high_price, x.low_price, x.close_price)] == [18.6, 18.9, 18.2, 18.35]
    assert (x.market, x.trading_value, x.transaction_count) == ("TPEX", 442_180, 37)


def test_index_reports(spark):
    table = {"tables": [{"title": "價格指數(x)", "fields": ["指數", "收盤指數", "漲跌(+/-)", "漲跌點數", "漲跌百分比(%)"],
                         "data": [["other", "1.00", "+", "1.00", "9.99"], ["發行量加權股價指數", "8,070.50", "-", "-40.35", "-0.50"]]}]}
    x = rp.index_twse(documents(spark, table)).first()
    assert (x.value, x.change_percent) == (Decimal("8070.50"), Decimal("-0.50"))
    summary = {"fields": ["日期", "成交股數", "成交金額", "成交筆數", "發行量加權股價指數", "漲跌點數"], "data": [
        ["102/09/12", "1", "1", "1", "5,100.00", "100.00"], ["102/09/13", "1", "1", "1", "5,049.00", "-51.00"]]}
    x = rp.index_twse_summary(documents(spark, summary, date="2013-09-13")).first()
    assert (x.value, float(x.change_percent)) == (Decimal("5049.00"), -1.0)
    tpex = {"tables": [{"fields": ["日期", "開市", "最高", "最低", "收市", "漲/跌"],
                        "data": [["102/09/13", "101.00", "103.00", "100.00", "102.00", "+2.00"]]}]}
    x = rp.index_tpex(documents(spark, tpex, date="2013-09-13")).first()
    assert (x.value, float(x.change_percent)) == (Decimal("102.00"), 2.0)
    assert rp.index_tpex(documents(spark, tpex, date="2013-09-12")).count() == 0


def test_non_regular_reports(spark):
    flat = {"data": [["4321", "x", "3", "1", "1,000"], ["合計", "x", "9", "9", "9"]]}
    fixed = spark.createDataFrame([(dt.date(2026, 8, 18), json.dumps(flat), n) for n in ("twse_odd_lot", "twse_fixed_price")],
                                  "trading_date date, body string, report_name string")
    block = documents(spark, {"tables": [{"data": [["1", "x", "7654", "x", "x", "7", "70"], ["1", "x", "7654", "x", "x", "1", "2"]]}, {"title": "none"}]},
                      {"stat": "no data"}, report_name="tpex_block")
    rows = rp.non_regular(fixed.unionByName(block)).groupBy("ticker").agg(F.sum("trading_value").alias("v"), F.sum("trading_volume").alias("q"))
    assert {x.ticker: (x.v, x.q) for x in rows.collect()} == {"4321": (2000, 3003), "7654": (72, 8)}


GOOD = {"stat": "OK", "fields": ["資料日期", "股票代號", "股票名稱", "除權息前收盤價", "除權息參考價"],
        "data": [["103年07月22日", "4321", "甲", "2,040.00", "1,938.50"], ["103年07月22日", "0123", "x", "--", "--"]]}


def test_adjustments(spark):
    x = rp.adjustments(documents(spark, GOOD), "TWSE").collect()
    assert [(r.ticker, r.effective_date, r.previous_close, r.reference_price) for r in x] == [("4321", dt.date(2014, 7, 22), 2040, Decimal("1938.5"))]
    tpex = {"stat": "ok", "tables": [{"fields": ["除權息日期", "代號", "名稱", "除權息前收盤價", "除權息參考價"],
                                      "data": [["103/07/09", "7654", "乙", "33.00", "31.20"]]}]}
    assert rp.adjustments(documents(spark, tpex), "TPEX").first().effective_date == dt.date(2014, 7, 9)


@pytest.mark.parametrize("change", [{"stat": "error"}, {"fields": ["資料日期"]}, {"data": [["x", "4321", "n", "1", "1"]]},
                                    {"data": [["103/07/22", "4321", "n", "0", "1"]]}])
def test_unreadable_adjustments_fail_the_load(spark, change):
    with pytest.raises(Exception, match="TWSE"):
        rp.adjustments(documents(spark, {**GOOD, **change}), "TWSE").collect()


def test_lenient_adjustments_mark_broken_rows(spark):
    bad = {**GOOD, "data": [*GOOD["data"], ["x", "5678", "n", "1", "1"]]}
    got = {x.ticker: x.broken for x in rp.adjustments(documents(spark, bad), "TWSE", strict=False).collect()}
    assert got == {"4321": False, "5678": True}


def test_month_ranges():
    start, end = dt.date(2025, 5, 21), dt.date(2026, 8, 19)
    slices = rp.month_ranges(start, end)
    assert (slices[0][0], slices[-1][1]) == (start, end)
    assert all(a[1] + dt.timedelta(days=1) == b[0] for a, b in zip(slices, slices[1:]))
    assert all((b - a).days < 31 for a, b in slices)
    with pytest.raises(ValueError):
        rp.month_ranges(end, start)


def test_universe_falls_back_when_one_side_is_empty(spark):
    twse = spark.createDataFrame([("4321 ",), ("4321",), ("0123",)], f"`{rp.REVENUE_TICKER}` string")
    none = spark.createDataFrame([], "SecuritiesCompanyCode string")
    tpex = spark.createDataFrame([("7654",)], none.schema)
    known = spark.createDataFrame([("TWSE", "5678")], "market string, ticker string")
    assert {tuple(x) for x in rp.universe(twse, tpex, known).collect()} == {("TWSE", "4321"), ("TPEX", "7654")}
    assert {tuple(x) for x in rp.universe(twse, none, known).collect()} == {("TWSE", "5678")}


def test_revenue_pages_are_read_as_bytes(spark, tmp_path):
    row = "<tr align=right><td align=center>{}</td> <td align=left>公<b>司</b></td><td nowrap>\r\n {} </td><td>7</td></tr>"
    other = "<table><tr><th>x</th></tr><TR class=sum><TD>合計</TD><TD>x</TD><TD>99</TD></TR>"
    (tmp_path / "a.html").write_bytes((other + row.format("4321", "1,234") + row.format("<a href=x>5678</a>", "60") + row.format("0123", "9")).encode("big5"))
    (tmp_path / "b.html").write_bytes(row.format("4321", "5").encode("big5"))
    read = pages.read_pages(spark, str(tmp_path))
    dated = read.select(F.lit(dt.date(2026, 7, 1)).alias("month"), "file_order", "html")
    assert {tuple(x)[::2] for x in pages.revenue_of_pages(dated).collect()} == {("4321", 5000), ("5678", 60_000)}
    first = pages.revenue_of_pages(dated.where("endswith(file_order, 'a.html')"), r"^[0-9]+\z").collect()
    assert {x.ticker: x.revenue for x in first} == {"4321": 1_234_000, "5678": 60_000, "0123": 9000}


def test_revenue_pages_are_files_in_their_order(spark, tmp_path):
    row = "<tr><td>{}</td><td>x</td><td>{}</td></tr>"
    day, other = dt.date(2026, 7, 1), dt.date(2026, 8, 1)
    rows = [
        (day, "p1", row.format("4321", "7") + row.format("5678", "8")),
        (day, "p0", row.format("4321", "1") + row.format("8765", "2")),
        (day, "p0", row.format("1111", "3")),
        (other, "p0", row.format("4321", "4")),
        (other, "p1", "no table at all"),
    ]
    pages.write_pages(spark.createDataFrame(rows, "month date, page string, html string"), str(tmp_path / "pages"))
    read = pages.read_pages(spark, str(tmp_path / "pages"))
    assert read.count() == len(rows)
    found = {(x.ticker, x.month): x.revenue for x in pages.revenue_of_pages(read).collect()}
    assert found == {
        ("4321", day): 7000, ("5678", day): 8000, ("8765", day): 2000, ("1111", day): 3000, ("4321", other): 4000,
    }


def test_disposition_periods_are_read_once_per_notice(spark):
    rows = [("1234", "1150812~1150230", "x", 1), ("1234 ", "115/08/12～1150831", "約每二十五分鐘", 2), ("1234", None, None, 3), ("1234", "1150812", "x", 4)]
    got = rp.dispositions(spark.createDataFrame(rows, "ticker string, period string, content string, source_order bigint"))
    assert [(r.ticker, str(r.start), str(r.end), r.matching_minutes) for r in got.collect()] == [("1234", "2026-08-12", "2026-08-31", 25)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_extract(") == 1
