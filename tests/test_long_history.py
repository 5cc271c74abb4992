"""Streams over an event history much longer than any watermark delay, read one file at a time, against their SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import compare
from turnbook.plans import REGISTRY, stream_queries as sq
from turnbook.session import scratch_path

DAYS = 110
EVERY_MINUTES = 20


@pytest.fixture(scope="module")
def history(spark):
    """Events of 110 days, shuffled over 12 files."""
    path = scratch_path(spark, "history")
    number = F.pmod(F.xxhash64("id"), F.lit(1000))
    events = spark.range(DAYS * 24 * 60 // EVERY_MINUTES).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * (EVERY_MINUTES * 60)).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 10).alias("user_id"),
        F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "purchase", "error")]), (F.col("id") % 4 + 1).cast("int")).alias("event_type"),
        (number / 4).alias("value"),
        F.concat(F.lit('{"k": '), (number % 100).cast("string"), F.lit("}")).alias("props"),
    )
    events.repartition(12, F.xxhash64("event_id", F.lit(1))).write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture
def one_by_one(spark, monkeypatch):
    """Many landed files, one per micro-batch."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    monkeypatch.setattr(sq, "FILES_PER_TRIGGER", 1)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def against_sql(spark, history, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{history}/events.parquet/*.parquet')")
    q = REGISTRY[name]
    return compare.differences(q.run(spark, history), con, q.sql)


@pytest.mark.parametrize("name", ["stream_dedupe", "stream_tumbling_slots"])
def test_no_row_falls_behind_the_watermark(spark, history, one_by_one, name):
    assert against_sql(spark, history, name) == []


@pytest.mark.parametrize("name", ["stream_gate", "stream_curve_sink", "stream_latest_sink", "stream_late_rounds"])
def test_the_gate_sees_every_round_of_a_long_history(spark, history, one_by_one, name):
    assert against_sql(spark, history, name) == []


def test_a_store_that_sets_times_itself(spark, monkeypatch):
    """Ranges are then written one after the other."""
    monkeypatch.setattr(sq, "_timed_in_order", lambda *_: False)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("at"))
    path = sq.land_by_time(rows, "at", "own-times")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    files = sorted(glob.glob(f"{path}/part-*.parquet"), key=lambda f: os.stat(f).st_mtime_ns)
    held_in = [[r["at"] for r in spark.read.parquet(f).collect()] for f in files]
    assert len(files) > 1 and sum(held_in, []) == list(range(1000))


def test_rolling_grid_is_spread_over_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    """The rows per ticker and age arise in many tasks, not in the one that reads the securities."""
    from turnbook.operators import ranking as r
    from turnbook.sources import driver_tables as d

    stocks, daily = d.securities(spark, sf_dir), d.daily(spark, sf_dir)
    whole = sorted(map(repr, r.rolling_periods(daily, stocks, periods=(1, 3), dates=12).collect()))
    monkeypatch.setattr(r, "GRID_ROWS", 20)
    assert r._grid_tasks(stocks, 20) == stocks.count()
    assert sorted(map(repr, r.rolling_periods(daily, stocks, periods=(1, 3), dates=12).collect())) == whole and whole
