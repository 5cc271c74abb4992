from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window as W, functions as F

from market_builder import day, panel, stocks, values
from turnbook.operators import calendar as cal, ranking as r
from turnbook.operators.ranks import with_position, with_positions

BASIC = values("1101", 100, 200, 300, 500) + values("2330", 400, 400, 500, 300) + values("6488", 50, 50, 100, 100)
TICKERS = ("1101", "2330", "6488")


def rank(spark, rows, tickers=TICKERS, **options):
    options = {"period_days": 2, "min_average": 0, **options}
    found = r.ranking(panel(spark, rows), stocks(spark, *tickers), r.RankingQuery(**options))
    return {row.ticker: row for row in found.collect()}


def summary(spark, rows, tickers=TICKERS, **options):
    options = {"period_days": 2, "min_average": 0, **options}
    return r.ranking_summary(panel(spark, rows), stocks(spark, *tickers), r.RankingQuery(**options)).first()


def test_averages_growth_and_ranks(spark):
    got = rank(spark, BASIC)
    assert [(t, got[t].average_value, got[t].previous_average_value) for t in TICKERS] == [
        ("1101", 400, 150),
        ("2330", 400, 400),
        ("6488", 100, 50),
    ]
    assert got["1101"].change_rate == pytest.approx(1.6667, abs=1e-4)
    assert (got["2330"].change_rate, got["6488"].change_rate) == (0, 1)
    assert [(got[t].rank, got[t].previous_rank, got[t].rank_change) for t in TICKERS] == [(1, 2, 1), (2, 1, -1), (3, 3, 0)]


@pytest.mark.parametrize("market", ["all", "TWSE", "TPEX"])
def test_share_denominator_ignores_the_market_filter(spark, market):
    got = rank(spark, BASIC, market=market)
    row = got["6488" if market == "TPEX" else "1101"]
    assert (row.market_total, row.previous_market_total) == (1800, 1200)
    if market != "TPEX":
        assert row.share == pytest.approx(0.4444, abs=1e-4)
        assert row.previous_share == 0.25
        assert row.share_change == pytest.approx(0.1944, abs=1e-4)
    assert set(got) == {"all": set(TICKERS), "TWSE": {"1101", "2330"}, "TPEX": {"6488"}}[market]


def test_threshold_drops_rows_but_not_the_total(spark):
    assert set(rank(spark, BASIC, min_average=200)) == {"1101", "2330"}
    row = summary(spark, BASIC, min_average=200)
    assert (row.ranked_count, row.market_total, row.market_daily_average) == (2, 1800, 900)


def test_top_rows_and_full_count(spark):
    assert len(rank(spark, BASIC, top=2)) == 2
    assert summary(spark, BASIC, top=2).ranked_count == 3


def test_base_date_hides_the_future(spark):
    got = rank(spark, BASIC, period_days=1, end_date=day(3))
    assert got["1101"].average_value == 300
    row = summary(spark, BASIC, period_days=1, end_date=day(3))
    assert (row.current_end, row.date_count) == (day(3), 3)


def test_missing_row_still_divides_by_the_period(spark):
    rows = values("1101", 1, 1, 1, 1) + values("2330", 100, 100, 500)
    assert rank(spark, rows)["2330"].average_value == 250


def test_zero_baseline_has_no_growth_and_no_previous_rank(spark):
    rows = values("1101", 10, 10, 10, 10) + values("2330", 0, 0, 900, 900)
    row = rank(spark, rows)["2330"]
    assert (row.change_rate, row.previous_rank, row.rank_change) == (None, None, None)


def test_acceleration_ranks_by_growth(spark):
    rows = values("1101", 50, 50, 100, 100, 400, 400) + values("2330", 50, 50, 400, 400, 500, 500)
    got = rank(spark, rows, mode=r.ACCELERATION)
    assert (got["1101"].change_rate, got["2330"].change_rate) == (3.0, 0.25)
    assert (got["1101"].previous_rank, got["2330"].previous_rank) == (2, 1)


def test_growth_that_cannot_be_computed_ranks_last(spark):
    rows = values("1101", 100, 100, 100, 100, 50, 50) + values("2330", 100, 100, 0, 0, 900, 900)
    got = rank(spark, rows, mode=r.ACCELERATION)
    assert (got["1101"].rank, got["2330"].rank) == (1, 2)
    assert got["2330"].change_rate is None


def test_heat_has_previous_growth_only_with_three_periods(spark):
    six = values("1101", 50, 50, 100, 100, 400, 400)
    assert rank(spark, six)["1101"].previous_change_rate == 1.0
    five = values("1101", 50, 100, 100, 400, 400)
    assert rank(spark, five)["1101"].previous_change_rate is None


def closes(ticker, *prices):
    return [(ticker, i + 1, 100, p) for i, p in enumerate(prices)]


def test_period_price_change_starts_before_the_period(spark):
    row = rank(spark, closes("1101", 50, 100, 110, 125))["1101"]
    assert (row.price_change, float(row.end_close)) == (0.25, 125)


def test_one_day_price_change(spark):
    assert rank(spark, closes("1101", 100, 110), period_days=1)["1101"].price_change == pytest.approx(0.10)


def test_daily_and_weekly_changes_have_their_own_baselines(spark):
    friday, monday, tuesday = dt.date(2026, 1, 9), dt.date(2026, 1, 12), dt.date(2026, 1, 13)
    rows = [("1101", friday, 1, 100), ("1101", monday, 1, 110), ("1101", tuesday, 1, 121)]
    row = rank(spark, rows, period_days=1)["1101"]
    assert row.daily_price_change == pytest.approx(0.10)
    assert row.weekly_price_change == pytest.approx(0.21)
    assert float(row.week_baseline) == 100


def test_no_earlier_close_and_no_close_at_all(spark):
    row = rank(spark, closes("1101", None, None, 20, 25))["1101"]
    assert (row.price_change, float(row.end_close)) == (None, 25)
    row = rank(spark, closes("1101", None, None, None, None))["1101"]
    assert (row.price_change, row.end_close) == (None, None)


def test_halted_day_is_not_active(spark):
    row = rank(spark, values("1101", 1, 1, 0, 1000))["1101"]
    assert (row.active_days, row.average_value) == (1, 500)


@pytest.mark.parametrize("mode,days,need", [(r.HEAT, 3, 4), (r.ACCELERATION, 5, 6)])
def test_too_few_dates(spark, mode, days, need):
    rows = values("1101", *[100] * days)
    assert rank(spark, rows, mode=mode) == {}
    row = summary(spark, rows, mode=mode)
    assert (row.has_sufficient_data, row.required_dates, row.date_count) == (False, need, days)
    assert row.current_start is None


def test_unknown_ticker_counts_in_the_total_only(spark):
    got = rank(spark, BASIC, tickers=("1101",))
    assert set(got) == {"1101"}
    assert got["1101"].market_total == 1800


def test_rank_lookup(spark):
    rows = r.ranked(panel(spark, BASIC), stocks(spark, *TICKERS), r.RankingQuery(period_days=2, min_average=200))
    pinned = spark.createDataFrame([("2330",), ("6488",)], "ticker string")
    assert {x.ticker: x.rank for x in r.rank_lookup(rows, pinned).collect()} == {"2330": 2, "6488": None}


@pytest.mark.parametrize("days,expected", [(130, 120), (7, 7)])
def test_selectable_dates(spark, days, expected):
    got = [x.trading_date for x in cal.selectable_dates(panel(spark, values("1101", *[1] * days))).collect()]
    assert got == [day(n) for n in range(days - expected + 1, days + 1)]


def test_no_dates(spark):
    assert cal.selectable_dates(panel(spark, [])).collect() == []


def test_period_must_be_positive():
    with pytest.raises(ValueError):
        r.RankingQuery(period_days=0)


def test_all_dates_agree_with_single_rankings(spark):
    """Gaps, missing closes and unknown tickers; each date and period against its own query."""
    import random

    rng = random.Random(7)
    rows = []
    for ticker in ("1101", "1102", "2330", "6488", "9999"):
        for n in range(1, 41):
            if rng.random() < 0.6:
                rows.append((ticker, n, rng.choice([0, 10, 250, 900]), rng.choice([None, 10, 12.5, 99])))
    daily, known = panel(spark, rows), stocks(spark, "1101", "1102", "2330", "6488", "7777")
    together = r.ranking_all_dates(daily, known, periods=(1, 3, 5), dates=12)
    columns = [
        "ticker", "rank", "previous_rank", "average_value", "previous_average_value", "change_rate",
        "previous_change_rate", "share", "previous_share", "price_change", "daily_price_change",
        "weekly_price_change", "week_baseline", "end_close", "active_days",
    ]
    found = {}
    for x in together.collect():
        found.setdefault((x.base_date, x.period_days), []).append(tuple(x[c] for c in columns))
    dates = sorted({x[1] for x in rows})[-12:]
    checked = 0
    for n in dates[::4] + [dates[-1]]:
        for period in (1, 3, 5):
            query = r.RankingQuery(period_days=period, end_date=day(n), min_average=0, top=None)
            single = [tuple(x[c] for c in columns) for x in r.ranking(daily, known, query).collect()]
            assert sorted(found.get((day(n), period), [])) == sorted(single)
            checked += len(single)
    assert checked > 30


def test_positions_in_ranges_equal_one_ordered_window(spark):
    """Heavily tied values: a third of the rows share one key."""
    df = spark.range(30_000).select(
        F.format_string("%05d", F.col("id")).alias("ticker"),
        F.when(F.col("id") < 10_000, F.lit(5.0))
        .when(F.col("id") < 12_000, F.lit(None))
        .otherwise(F.hash("id").cast("double")).alias("key"),
        F.when(F.col("id") < 20_000, "a").otherwise("b").alias("g"),
    )
    for within in ((), ("g",)):
        window = W.partitionBy(*within).orderBy(F.col("key").desc_nulls_last(), "ticker")
        one = df.withColumn("n", F.row_number().over(window).cast("bigint"))
        for rows in (700, 30_000):
            ranged = with_position(df, "key", "m", within, range_rows=rows)
            assert dict(ranged.dtypes)["m"] == "bigint"
            assert one.join(ranged.select("ticker", *within, "m"), ["ticker", *within]).where("n <> m").count() == 0
            assert ranged.count() == 30_000


def test_positions_by_two_keys_in_one_pass(spark):
    """Groups of very unequal size, a group without a name, keys that are null or not a number."""
    df = spark.range(6_000).select(
        F.format_string("%05d", F.col("id")).alias("ticker"),
        F.when(F.col("id") < 5_000, "big").when(F.col("id") % 2 == 0, "small").alias("g"),
        F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 11 > 0, F.pmod(F.hash("id"), F.lit(50)) * 1.0).alias("x"),
        F.when(F.col("id") % 3 > 0, F.hash(F.col("id") + 1)).alias("y"),
    )
    keys = {"by_x": "x", "by_y": "y", "again": "x", "by_name": "ticker"}
    for within in ((), ("g",)):
        placed = with_positions(df, keys, within, range_rows=250)
        assert placed.columns == [*df.columns, *keys]
        for name, key in keys.items():
            window = W.partitionBy(*within).orderBy(F.col(key).desc_nulls_last(), "ticker")
            wrong = placed.withColumn("n", F.row_number().over(window)).where(F.col("n") != F.col(name))
            assert wrong.count() == 0
        assert placed.count() == 6_000


def test_positions_of_nothing(spark):
    empty = spark.createDataFrame([], "ticker string, g string, key double")
    assert with_position(empty, "key", "n").collect() == []
    assert with_position(empty, "key", "n", ("g",)).collect() == []


def test_positions_compare_keys_in_their_own_type(spark):
    """Neighbouring whole numbers beyond 2**53, which a double cannot tell apart."""
    df = spark.range(20_000).select(
        F.format_string("%05d", F.pmod(F.col("id") * 7919, F.lit(20_000))).alias("ticker"),
        (F.lit(2**53) + F.floor(F.col("id") / 3).cast("bigint")).alias("key"),
    )
    for descending in (True, False):
        rows = with_position(df, "key", "n", descending=descending, range_rows=900).collect()
        expected = sorted(rows, key=lambda r: (-r.key if descending else r.key, r.ticker))
        assert [r.n for r in expected] == list(range(1, 20_001))
