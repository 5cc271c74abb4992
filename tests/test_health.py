"""Counters that streams keep of themselves: equal to the batch, counted once, never lost in silence."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from turnbook.operators import intraday as it
from turnbook.session import scratch_path
from turnbook.streaming import health as hl, rounds as st

QUOTE = "price_source string, price double, trading_volume bigint"
QUOTES = [("last_trade", 1.0, 5), ("none", None, 7), ("none", None, 0), ("open", 2.0, None), ("last_trade", None, 1), (None, 1.0, 1)]


def progress(batch, given, dropped=0, name="x", query="q"):
    observed = {"rounds": SimpleNamespace(asDict=lambda: {"given": given})}
    operators = [SimpleNamespace(numRowsDroppedByWatermark=dropped), SimpleNamespace(numRowsDroppedByWatermark=1)]
    return SimpleNamespace(id=query, name=name, batchId=batch, numInputRows=given + dropped, stateOperators=operators, observedMetrics=observed)


def landed(spark, rows, files):
    path = scratch_path(spark, "quotes")
    spark.createDataFrame(rows, QUOTE).repartition(files).write.parquet(path)
    return path


@pytest.mark.parametrize("files", [1, 3])
def test_counters_equal_the_batch_profile_however_rows_are_batched(spark, files):
    source, out, counted = landed(spark, QUOTES * 5, files), scratch_path(spark, "out"), scratch_path(spark, "counted")
    stream = hl.profiled(st.read_files(spark, QUOTE, source, 1))
    hl.run_counted(spark, stream.writeStream.foreachBatch(st.by_batch(out)), "profile", scratch_path(spark, "checkpoint"), counted)
    counters = hl.read_counters(spark, counted)
    assert counters.select("batch_id").distinct().count() == files
    expected = it.price_source_profile(spark.read.parquet(out).where("price_source is not null"))
    columns = ("price_source", "quotes", "priceless_with_volume")
    got = sorted(hl.price_source_totals(counters).select(*columns).collect())
    assert got == sorted(expected.select(*columns).collect()) == [("last_trade", 10, 5), ("none", 10, 5), ("open", 5, 0)]
    engine = {r.field: r.value for r in hl.totals(counters).where("label = 'engine'").collect()}
    assert engine == {"input_rows": 30, "dropped_by_watermark": 0}


def test_a_stream_without_rows_counts_nothing(spark):
    source, out, counted = landed(spark, [], 1), scratch_path(spark, "out"), scratch_path(spark, "counted")
    stream = hl.profiled(st.read_files(spark, QUOTE, source, 1))
    hl.run_counted(spark, stream.writeStream.foreachBatch(st.by_batch(out)), "profile", scratch_path(spark, "checkpoint"), counted)
    assert hl.read_counters(spark, counted).where("value <> 0").count() == 0


def test_a_batch_that_runs_again_counts_once_and_other_streams_do_not(spark):
    path = scratch_path(spark, "counted")
    health = hl.Health(spark, "x", path)
    for p in (progress(0, 4), progress(1, 5, 2), progress(1, 6, 3), progress(2, 100, name="y"), progress(0, 1, query="r")):
        health.onQueryProgress(SimpleNamespace(progress=p))
    found = {(r.label, r.field): r.value for r in hl.totals(hl.read_counters(spark, path)).collect()}
    assert found == {("rounds", "given"): 11, ("engine", "input_rows"): 14, ("engine", "dropped_by_watermark"): 6}


def test_counters_that_cannot_be_landed_are_an_error(spark):
    health = hl.Health(spark, "x", "nosuchstore://counted")
    health.onQueryProgress(SimpleNamespace(progress=progress(0, 1)))
    health.onQueryTerminated(SimpleNamespace(runId="run"))
    with pytest.raises(RuntimeError):
        health.settle("run")


def test_a_failing_stream_raises_its_own_error(spark):
    source, counted = landed(spark, QUOTES, 1), scratch_path(spark, "counted")

    def fail(batch, batch_id):
        raise ValueError("sink")

    stream = hl.profiled(st.read_files(spark, QUOTE, source, 1))
    with pytest.raises(Exception, match="sink"):
        hl.run_counted(spark, stream.writeStream.foreachBatch(fail), "profile", scratch_path(spark, "checkpoint"), counted)


def test_rows_behind_the_watermark_are_counted_over_a_restart(spark):
    schema = "trade_date date, captured_at timestamp_ntz, turnover_total bigint"
    days = spark.range(20).select(F.expr("date_add(DATE'2024-01-01', CAST(id AS INT))").alias("trade_date"), "id")
    rounds = days.select("trade_date", F.col("trade_date").cast("timestamp_ntz").alias("captured_at"), F.col("id").alias("turnover_total"))
    source, out, counted, checkpoint = (scratch_path(spark, x) for x in ("in", "out", "counted", "checkpoint"))

    def go(rows):
        rows.coalesce(1).write.mode("append").parquet(source)
        unique = st.dedupe(st.read_files(spark, schema, source), ("captured_at",), delay="2 days")
        stream = hl.observed(unique, "rounds", given=F.count(F.lit(1)))
        hl.run_counted(spark, stream.writeStream.foreachBatch(st.by_batch(out)), "late", checkpoint, counted)

    go(rounds)
    # The watermark stands at the eighteenth day: four rows are behind it, the last one is known.
    go(rounds.where("turnover_total < 4 OR turnover_total = 19"))
    found = {(r.label, r.field): r.value for r in hl.totals(hl.read_counters(spark, counted)).collect()}
    assert found == {("engine", "input_rows"): 25, ("engine", "dropped_by_watermark"): 4, ("rounds", "given"): 20}
    assert spark.read.parquet(out).count() == 20
