from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from market_builder import DAILY, day
from turnbook.operators import indices as ix, kline as kl, quotes as qt, revenue as rv

EVENTS = "ticker string, effective_date date, previous_close double, reference_price double"


def bar(ticker, date, close, complete=True):
    c = Decimal(close)
    return (ticker, date, c - 1 if complete else None, c + 1 if complete else None, c - 2 if complete else None, c, 1)


def test_prices_are_adjusted_backwards(spark):
    daily = spark.createDataFrame([bar("2330", day(n), 99 + n) for n in (1, 2, 3, 4)], DAILY)
    events = spark.createDataFrame(
        [("2330", day(2), 100.0, 90.0), ("2330", day(4), 100.0, 80.0), ("2330", day(9), 100.0, 1.0),
         ("2330", day(3), 0.0, 5.0), ("1101", day(3), 10.0, 1.0)],
        EVENTS,
    )
    rows = kl.bars(daily, events, day(1), day(4), day(4)).orderBy("trading_date").collect()
    first = rows[0]
    assert [first.adj_open, first.adj_high, first.adj_low, first.adj_close] == pytest.approx([71.28, 72.72, 70.56, 72])
    assert [x.adj_close for x in rows[1:]] == pytest.approx([80.8, 81.6, 103])


def test_events_of_one_day_multiply(spark):
    daily = spark.createDataFrame([bar("2330", day(1), 100), bar("2330", day(2), 100)], DAILY)
    events = spark.createDataFrame([("2330", day(2), 10.0, 9.0), ("2330", day(2), 10.0, 8.0)], EVENTS)
    rows = kl.adjusted(daily, events).orderBy("trading_date").collect()
    assert [x.adj_close for x in rows] == pytest.approx([72, 100])


def test_averages_use_closes_before_the_range_and_of_incomplete_bars(spark):
    daily = spark.createDataFrame([bar("2330", day(n), n, n > 240) for n in range(1, 261)], DAILY)
    events = spark.createDataFrame([], EVENTS)
    rows = kl.bars(daily, events, day(1), day(260), day(260)).orderBy("trading_date").collect()
    assert len(rows) == 20
    assert [rows[0][c] for c in ("ma5", "ma10", "ma20", "ma60", "ma240")] == pytest.approx([239, 236.5, 231.5, 211.5, 121.5])
    assert [rows[-1][c] for c in ("ma5", "ma10", "ma20", "ma60", "ma240")] == pytest.approx([258, 255.5, 250.5, 230.5, 140.5])
    assert rows[0].previous_close == 240


def test_range_covers_three_months_and_complete_bars(spark):
    dates = ["2026-05-18", "2026-05-19", "2026-05-20", "2026-05-21", "2026-08-19"]
    rows = [bar("2330", dt.date.fromisoformat(x), 100, x != "2026-05-20") for x in dates]
    got = kl.select_bars(spark.createDataFrame(rows, DAILY), spark.createDataFrame([], EVENTS), dt.date(2026, 8, 19))
    assert [str(x.trading_date) for x in got.orderBy("trading_date").collect()] == ["2026-05-19", "2026-05-21", "2026-08-19"]


@pytest.mark.parametrize("end,start", [("2026-05-31", "2026-02-28"), ("2026-01-15", "2025-10-15"), ("2026-12-31", "2026-09-30")])
def test_months_are_clamped(end, start):
    assert kl.months_before(dt.date.fromisoformat(end), 3) == dt.date.fromisoformat(start)


def test_trend_is_against_the_previous_close(spark):
    rows = [
        ("2330", day(1), None, None, None, Decimal(2415), 1),
        ("2330", day(2), Decimal(2440), Decimal(2450), Decimal(2425), Decimal(2435), 1),
    ]
    got = kl.bars(spark.createDataFrame(rows, DAILY), spark.createDataFrame([], EVENTS), day(1), day(2), day(2)).collect()
    assert [x.trend for x in got] == ["up"]


def test_merging_bars_touches_nothing_else(spark):
    quote = "trading_date date, ticker string, open_price double, high_price double, low_price double, close_price double, trading_value int, trading_volume int"
    stored = spark.createDataFrame([(day(1), "2330", None, None, None, 100.0, 123, 456), (day(1), "1101", 1.0, 1.0, 1.0, 1.0, 1, 1)], quote)
    bars = spark.createDataFrame([(day(1), "2330", 98.0, 102.0, 97.0, 999.0, 9, 9)], quote)
    got = {x.ticker: tuple(x)[2:] for x in qt.merge_bars(stored, bars).collect()}
    assert got == {"2330": (98.0, 102.0, 97.0, 100.0, 123, 456), "1101": (1.0, 1.0, 1.0, 1.0, 1, 1)}


def test_deductions_never_go_below_zero(spark):
    quotes = spark.createDataFrame(
        [(day(1), "2330", 1000, 10), (day(1), "1101", 50, 5), (day(1), "6488", 7, 7)],
        "trading_date date, ticker string, trading_value bigint, trading_volume bigint",
    )
    reports = spark.createDataFrame(
        [(day(1), "2330", 100, 1), (day(1), "2330", 200, 2), (day(1), "1101", 80, 9)], quotes.schema
    )
    got = {x.ticker: (x.trading_value, x.trading_volume) for x in qt.regular_only(quotes, qt.sum_non_regular(reports)).collect()}
    assert got == {"2330": (700, 7), "1101": (0, 0), "6488": (7, 7)}


# --- revenue -----------------------------------------------------------------


def months(spark, *pairs, ticker="2330"):
    return spark.createDataFrame(
        [(ticker, dt.date.fromisoformat(m + "-01"), v) for m, v in pairs], "ticker string, month date, revenue bigint"
    )


def both(spark, month, *pairs):
    """Streak of one month by the general and by the single-month form."""
    rows = months(spark, *pairs)
    wanted = dt.date.fromisoformat(month + "-01")
    general = rv.with_high_streak(rv.with_growth(rows)).where(f"month = DATE'{wanted}'").first()
    single = rv.latest(rows, wanted).first()
    for name in ("yoy", "mom", "high_months", "record_high"):
        assert general[name] == single[name]
    return single


def test_growth(spark):
    row = both(spark, "2026-07", ("2025-07", 100), ("2026-06", 200), ("2026-07", 250))
    assert (row.yoy, row.mom) == (1.5, 0.25)


def test_growth_needs_a_positive_baseline(spark):
    row = both(spark, "2026-07", ("2025-07", 0), ("2026-06", 0), ("2026-07", 250))
    assert (row.yoy, row.mom) == (None, None)


@pytest.mark.parametrize(
    "pairs,expected",
    [
        ([("2026-03", 999), ("2026-04", 100), ("2026-05", 150), ("2026-06", 200), ("2026-07", 250)], (4, False)),
        ([("2026-05", 100), ("2026-06", 200), ("2026-07", 250)], (3, True)),
        ([("2026-03", 10), ("2026-04", 20), ("2026-06", 200), ("2026-07", 250)], (2, True)),
        ([("2026-06", 250), ("2026-07", 250)], (None, False)),
        ([("2026-06", 300), ("2026-07", 250)], (None, False)),
        ([("2026-07", 250)], (None, False)),
    ],
)
def test_high_streak(spark, pairs, expected):
    row = both(spark, "2026-07", *pairs)
    assert (row.high_months, row.record_high) == expected


def test_streaks_against_a_loop(spark):
    import random

    rng = random.Random(3)
    data = {}
    for t in range(6):
        for i in range(60):
            if rng.random() < 0.9:
                data[(f"T{t}", 24000 + i)] = rng.randint(1, 9) if rng.random() < 0.95 else None
    rows = spark.createDataFrame(
        [(t, dt.date((m - 1) // 12, (m - 1) % 12 + 1, 1), v) for (t, m), v in data.items()],
        "ticker string, month date, revenue bigint",
    )
    found = rv.with_high_streak(rows.withColumn("_m2", F.lit("extra"))).drop("_m2").collect()
    assert len(found) == len(data)
    for x in found:
        m = x.month.year * 12 + x.month.month
        count, cursor = 1, m - 1
        # A month without revenue neither stops a count nor is stopped.
        while (x.ticker, cursor) in data and not (
            x.revenue is not None and data[(x.ticker, cursor)] is not None and data[(x.ticker, cursor)] >= x.revenue
        ):
            count, cursor = count + 1, cursor - 1
        record = (x.ticker, cursor) not in data
        assert (x.high_months, x.record_high) == ((count, record) if count >= 2 else (None, False))


def test_streak_of_thirty_years_in_one_island(spark):
    """Every month a new high: the longest stack there can be is one month, the longest list the history."""
    pairs = [(f"{1990 + i // 12}-{i % 12 + 1:02d}", 100 + i) for i in range(360)]
    rows = rv.with_high_streak(months(spark, *pairs)).orderBy("month").collect()
    assert [x.high_months for x in rows] == [None, *range(2, 361)]
    falling = rv.with_high_streak(months(spark, *[(p, -v) for p, v in pairs])).collect()
    assert {(x.high_months, x.record_high) for x in falling} == {(None, False)}


def test_history_keeps_twenty_months(spark):
    pairs = [(f"{2023 + i // 12}-{i % 12 + 1:02d}", 100 + i) for i in range(33)]
    rows = rv.history(months(spark, *pairs)).orderBy("month").collect()
    assert len(rows) == 20
    assert rows[-1].yoy == pytest.approx(12 / 120)


def test_missing_month_has_no_summary(spark):
    assert rv.latest(months(spark, ("2026-05", 1)), dt.date(2026, 6, 1)).count() == 0


@pytest.mark.parametrize("today,month", [("2026-01-05", "2025-12-01"), ("2026-08-31", "2026-07-01")])
def test_eligible_month(today, month):
    assert rv.eligible_month_of(dt.date.fromisoformat(today)) == dt.date.fromisoformat(month)


def test_stale_latest_month_is_not_shown(spark):
    latest = rv.latest(months(spark, ("2026-05", 1), ("2026-06", 2)), dt.date(2026, 6, 1))
    names = spark.createDataFrame([("2330",)], "ticker string")
    assert rv.display(names, latest, dt.date(2026, 7, 1)).first().month_revenue is None
    assert rv.display(names, latest, dt.date(2026, 6, 1)).first().month_revenue == 2


# --- indices -----------------------------------------------------------------


def history(spark, *rows):
    return spark.createDataFrame(
        [(dt.date.fromisoformat(x), m, Decimal(str(v))) for x, m, v in rows],
        "trading_date date, market string, value decimal(20,4)",
    )


def test_year_to_date(spark):
    index = history(
        spark, ("2025-12-30", "TWSE", 1), ("2025-12-31", "TWSE", 110), ("2025-12-31", "TPEX", 220), ("2026-08-18", "TWSE", 132),
        ("2026-08-18", "TPEX", 210), ("2026-08-19", "TWSE", 0),
    )
    got = {x.market: x.ytd_change_percent for x in ix.year_to_date(index, dt.date(2026, 8, 18)).collect()}
    assert got == {"TWSE": Decimal("20.00"), "TPEX": Decimal("-4.55")}
    live = spark.createDataFrame([("TWSE", Decimal(121))], "market string, value decimal(20,4)")
    got = {x.market: x.ytd_change_percent for x in ix.year_to_date(index, dt.date(2026, 8, 20), live).collect()}
    assert got == {"TWSE": Decimal("10.00"), "TPEX": Decimal("-4.55")}


def test_year_to_date_without_baseline(spark):
    index = history(spark, ("2026-08-18", "TWSE", 132))
    assert ix.year_to_date(index, dt.date(2026, 8, 18)).first().ytd_change_percent is None


def test_percentages_just_off_a_half_are_not_ties(spark):
    index = history(spark, ("2026-01-01", "TWSE", "1110507.22"), ("2026-01-02", "TWSE", "1343325.06"))
    assert ix.with_change_percent(index).orderBy("trading_date").collect()[1].change_percent == Decimal("20.97")
