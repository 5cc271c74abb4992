from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from turnbook.operators import flags as fl, intraday as it, quality as ql
from turnbook.plans import stream_queries as sq
from turnbook.session import scratch_path
from turnbook.sources import driver_tables as d, snapshots as sn, tables as tb
from turnbook.streaming import rounds as st

AT = dt.datetime(2026, 8, 18, 2, 0)
FULL = {"c": "4321", "n": "甲", "ex": "tse", "d": "20260818", "z": "-", "pz": "-", "a": "64.20_64.30_64.40_",
        "b": "64.00_63.90_", "o": "62.50", "h": "65.00", "l": "62.00", "y": "61.00", "v": "815"}


def items(spark, *changes):
    names = list(FULL)
    rows = [(AT, "s", *[{**FULL, **c}[n] for n in names]) for c in changes]
    return spark.createDataFrame(rows, "captured_at timestamp_ntz, source string, " + ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize("change,price,source", [
    ({}, 64.1, "bid_ask_mid"),
    ({"z": "64.5"}, 64.5, "last_trade"),
    ({"pz": "63.7"}, 63.7, "previous_trade"),
    ({"a": ""}, 64, "bid_ask_mid"),
    ({"b": "-"}, 64.2, "bid_ask_mid"),
    ({"a": "-", "b": "-"}, 63.5, "high_low_mid"),
    ({"a": "-", "b": "-", "h": "-"}, 62.5, "open"),
    ({"a": "-", "b": "-", "h": "-", "o": "-", "v": "0"}, 61, "previous_close"),
    ({"a": "-", "b": "-", "h": "-", "o": "-", "y": "-"}, None, "none"),
])
def test_price_sources(spark, change, price, source):
    x = it.quotes_of_items(items(spark, change)).first()
    assert (None if x.price is None else float(x.price), x.price_source) == (price, source)
    if price is None:
        assert (x.turnover, x.change_percent) == (0, None)
    elif source == "previous_close":
        assert (x.turnover, float(x.change_percent)) == (0, 0)
    else:
        assert x.trading_volume == 815_000 and x.turnover == round(price * 815_000)


def test_index_channels_are_not_quotes(spark):
    rows = items(spark, {"c": "t00", "z": "110", "y": "100"}, {"c": "o00", "ex": "otc", "z": "-", "y": "50"}, {})
    assert it.quotes_of_items(rows).count() == 1
    got = {x.market: (float(x.value), float(x.change_percent)) for x in it.indices_of_items(rows).collect()}
    assert got == {"TWSE": (110, 10), "TPEX": (50, 0)}
    assert it.trade_dates(rows).first().trade_date == dt.date(2026, 8, 18)


@pytest.mark.parametrize("before,now,ok", [
    (None, 1, True), (700, 820, True), (700, 640, True), (700, 520, False), (31000, 27800, False), (450, 3, False),
    (0, 0, True), (100, 90, True), (1000, 899, False),
])
def test_gate_rule(spark, before, now, ok):
    falls = spark.range(1).select(it.falls_back(F.lit(now).cast("bigint"), F.lit(before).cast("bigint")).alias("f")).first().f
    assert falls is not ok


def test_gate_compares_with_the_last_accepted_round(spark):
    totals = [100, 120, 50, 109, 130]
    rows = spark.createDataFrame(
        [(AT.date(), AT + dt.timedelta(minutes=2 * i), t, 1) for i, t in enumerate(totals)],
        "trade_date date, captured_at timestamp_ntz, turnover_total bigint, quote_count bigint",
    )
    got = it.judge_rounds(rows).orderBy("captured_at").collect()
    assert [x.accepted for x in got] == [True, True, False, True, True]
    assert [x.previous_total for x in got] == [None, 100, 120, 120, 109]


def reference(spark, week):
    return spark.createDataFrame([("4321", 10.0, 0.5, 0.1, 100.0, week)],
                                 "ticker string, average_value double, share double, share_change double, end_close double, week_baseline double")


@pytest.mark.parametrize("reference_date,expected", [(dt.date(2026, 8, 17), 0.5), (dt.date(2026, 8, 14), 0.2)])
def test_intraday_week_baseline(spark, reference_date, expected):
    rows = spark.createDataFrame([("4321", "n", "TWSE", 120.0, 60, AT.date(), AT), ("5678", "n", "TPEX", 1.0, 40, AT.date(), AT)],
                                 "ticker string, name string, market string, price double, turnover bigint, trade_date date, captured_at timestamp_ntz")
    got = {x.ticker: x for x in it.ranking(rows, reference(spark, 80.0), reference_date).collect()}
    assert got["4321"].weekly_price_change == pytest.approx(expected)
    assert (got["4321"].share, got["4321"].previous_rank, got["5678"].previous_rank) == (0.6, 1, None)
    assert it.ranking(rows, reference(spark, 80.0).where("false"), reference_date, mode="acceleration").count() == 0


def test_session_verdicts(spark):
    data = {"a": ["written", "stale"], "b": ["written", "rejected"], "c": ["stale"], "d": ["stale", "failed"], "e": ["rejected"]}
    rows = spark.createDataFrame([(k, s) for k, v in data.items() for s in v], "session_date string, status string")
    got = {x.session_date: x.verdict for x in it.session_outcomes(rows).collect()}
    assert got == {"a": "ok", "b": "partial", "c": "closed_market", "d": "failed", "e": "failed"}


def test_latest_disposition_wins(spark):
    day = dt.date
    rows = spark.createDataFrame([
        ("4321", day(2026, 8, 1), day(2026, 8, 20), 5, 1), ("4321", day(2026, 8, 2), day(2026, 8, 25), 20, 2),
        ("4321", day(2026, 8, 3), day(2026, 8, 25), 2, 3), ("5678", day(2026, 8, 19), day(2026, 8, 30), 5, 4),
        ("7654", day(2026, 8, 18), day(2026, 8, 18), 5, 5)],
        "ticker string, start date, end date, matching_minutes int, source_order int")
    active = fl.latest_dispositions(rows, day(2026, 8, 18))
    assert {x.ticker: x.matching_minutes for x in active.collect()} == {"4321": 20, "7654": 5}
    flags = {x.ticker: tuple(x)[1:] for x in fl.market_flags(active, spark.createDataFrame([("4321",), ("9999",)], "ticker string")).collect()}
    assert flags["4321"] == ("2026/08/02 ~ 2026/08/25", 20, True)
    assert flags["9999"] == (None, None, True) and flags["7654"][2] is False


def test_day_outcomes(spark):
    day = dt.date
    rows = spark.createDataFrame([
        (day(2026, 8, 17), 0, 0, False, False), (day(2026, 8, 18), 0, 0, False, False), (day(2026, 8, 19), 0, 0, False, False),
        (day(2026, 8, 14), 5, 0, True, True), (day(2026, 8, 13), 5, 5, True, False)],
        "trading_date date, twse_count int, tpex_count int, has_twse_index boolean, has_tpex_index boolean")
    holidays = spark.createDataFrame([(day(2026, 8, 19),)], "trading_date date")
    got = {x.trading_date.day: (x.outcome, x.bar_backfill_failed) for x in ql.day_outcomes(rows, holidays, day(2026, 8, 18)).collect()}
    assert got == {17: ("closed", True), 18: ("not_published", True), 19: ("closed", True), 14: ("stored", True), 13: ("index_missing", False)}


def test_snapshots_by_date(spark, sf_dir):
    path = scratch_path(spark, "by-date")
    daily = d.daily(spark, sf_dir).where("trading_date >= DATE'2001-07-01' AND trading_date < DATE'2001-07-15'")
    first, second = sorted({x.trading_date for x in daily.collect()})[:2]
    sn.write(daily, path)
    sn.write(daily.where(F.col("trading_date") == first).withColumn("trading_value", F.lit(1)), path)
    stored = spark.read.parquet(path)
    assert stored.count() == daily.count()
    assert {x.trading_value for x in sn.day(spark, path, first).collect()} == {1}
    assert sn.exists(spark, path, second) and not sn.exists(spark, path, dt.date(2005, 1, 1))
    plan = sn.day(spark, path, first)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trading_date" in plan


def test_sync_is_idempotent(spark, sf_dir):
    daily, known = d.daily(spark, sf_dir).select("ticker", "trading_date", "trading_value"), d.securities(spark, sf_dir)
    once = tb.sync(daily, daily.where("trading_date < DATE'2001-03-01'"), known, 50)
    path = scratch_path(spark, "sync-test")
    once.write.parquet(path)
    stored = spark.read.parquet(path)
    assert tb.sync(daily.where("trading_date >= DATE'2001-03-01'"), stored, known, 50).exceptAll(stored).count() == 0


def replay(rows, lateness):
    """Brute force over arrivals: every accepted round is kept for ever, and each day has its own order."""
    accepted, newest, out = {}, {}, {}
    for x in sorted(rows, key=lambda r: r.arrival):
        day, at = x.trade_date, x.captured_at
        known = accepted.setdefault(day, {})
        earlier = [t for t in known if t < at]
        before = known[max(earlier)] if earlier else None
        late = lateness is not None and day in newest and at < newest[day] - lateness
        fell = before is not None and before > 0 and x.turnover_total * 10 < before * 9
        reason = "late" if late else "fell" if fell else None
        if reason is None:
            known[at] = x.turnover_total
        newest[day] = max(newest.get(day, at), at)
        out[(day, at)] = (x.turnover_total, reason)
    return out


def test_late_rounds_against_a_replay(spark, sf_dir):
    rows = sq.shuffled_rounds(spark, sf_dir).collect()
    expected = replay(rows, dt.timedelta(hours=2))
    got = {(x.trade_date, x.captured_at): (x.turnover_total, x.reason) for x in sq.stream_late_rounds(spark, sf_dir).collect()}
    assert got == expected


def test_random_arrivals_against_a_replay(spark):
    rng = random.Random(5)
    data = []
    for day in (18, 19):
        for i in range(60):
            at = dt.datetime(2026, 8, day, 1, 0) + dt.timedelta(minutes=2 * i)
            data.append((at.date(), at, rng.randint(50, 120), 1, 60 * day + i + rng.choice([0, 0, 0, 3.5, 9.5, 20.5]) * 1.0))
    order = {x: n for n, x in enumerate(sorted(data, key=lambda x: x[4]))}
    opening = {x[0]: int(dt.datetime.combine(x[0], dt.time(), dt.timezone.utc).timestamp()) for x in data}
    rows = spark.createDataFrame([(*x[:4], opening[x[0]] + 500 * order[x]) for x in data], st.ROUND_ROW)
    source, out = sq.land_in_order(rows, "random"), scratch_path(spark, "random-out")
    sq.run(st.gate(st.read_files(spark, st.ROUND_ROW, source), 15).writeStream.foreachBatch(st.by_batch(out)), "random", spark)
    got = {(x.trade_date, x.captured_at): (x.turnover_total, x.reason) for x in spark.read.parquet(out).collect()}
    expected = replay(rows.collect(), dt.timedelta(minutes=15))
    assert got == expected
    assert {r for _, r in expected.values()} == {None, "late", "fell"}


def test_gate_without_a_lateness_judges_all_rounds_of_the_day(spark):
    """A round far too low that comes after later ones still meets its predecessor."""
    arrivals = [(0, 1000), (2, 1200), (3, 1300), (1, 10)]
    rows = spark.createDataFrame(
        [(AT.date(), AT + dt.timedelta(minutes=2 * i), total, 1, n) for n, (i, total) in enumerate(arrivals)], st.ROUND_ROW
    )
    source, out = sq.land_in_order(rows, "default"), scratch_path(spark, "default-out")
    sq.run(st.gate(st.read_files(spark, st.ROUND_ROW, source)).writeStream.foreachBatch(st.by_batch(out)), "default", spark)
    got = {x.turnover_total: (x.accepted, x.previous_total) for x in spark.read.parquet(out).collect()}
    assert got == {1000: (True, None), 1200: (True, 1000), 1300: (True, 1200), 10: (False, 1000)}


@pytest.mark.parametrize("name,column,states", [
    ("plan_gaps", "status", {"missing", "stale_version", "index_missing", "bars_missing", "complete"}),
    ("gap_plan", "outcome", {"closed", "not_published", "index_missing", "stored"}),
    ("stream_late_rounds", "reason", {None, "late", "fell"}),
])
def test_every_state_occurs(spark, sf_dir, name, column, states):
    from turnbook.plans import REGISTRY

    assert {x[column] for x in REGISTRY[name].run(spark, sf_dir).collect()} == states


def test_an_old_quote_stays_in_a_current_response(spark):
    """The newest date in a response is the trade date of the round."""
    rows = items(spark, {}, {"c": "5678", "d": "20260814"}, {"c": "t00", "z": "110", "y": "100"})
    fields = [c for c in rows.columns if c not in ("captured_at", "source")]
    messages = rows.groupBy("captured_at", "source").agg(F.collect_list(F.struct(*fields)).alias("msgArray"))
    got = {x.ticker: x.trade_date for x in st.quotes_stream(messages).collect()}
    assert got == {"4321": AT.date(), "5678": AT.date()}
    assert [(x.market, float(x.value)) for x in st.indices_stream(messages).collect()] == [("TWSE", 110.0)]
    stale = rows.where("c = '5678'").groupBy("captured_at", "source").agg(F.collect_list(F.struct(*fields)).alias("msgArray"))
    assert st.quotes_stream(stale).count() == 0


def test_a_round_sent_again_replaces_itself_in_the_curve(spark):
    path = scratch_path(spark, "again")
    sink = st.curve_sink(path)
    schema = "trade_date date, captured_at timestamp_ntz, turnover_total bigint, quote_count bigint, accepted boolean"
    for batch_id, total in enumerate((100, 130)):
        sink(spark.createDataFrame([(AT.date(), AT, total, 1, True)], schema), batch_id)
    assert [x.turnover_total for x in st.read_curve(spark, path).collect()] == [130]


def test_replayed_batch_does_not_duplicate(spark, sf_dir):
    path = scratch_path(spark, "replay")
    sink = st.curve_sink(path)
    batch = it.judge_rounds(d.round_totals(spark, sf_dir))
    sink(batch, 0)
    sink(batch, 0)
    assert spark.read.parquet(path).count() == batch.where("accepted").count()
