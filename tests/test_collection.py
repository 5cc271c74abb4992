"""Rounds put together from responses: orders of arrival, broken parts, timers, batches of any size."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnbook.plans import stream_queries as sq
from turnbook.session import scratch_path
from turnbook.streaming import collection as co, rounds as st

START = pd.Timestamp("2024-01-08 01:00:00")
RESPONSE_COLUMNS = [c.split()[0] for c in co.RESPONSE.split(", ")]


def body(day="20240108", *codes):
    return json.dumps({"msgArray": [{"c": c, "ex": "tse", "d": day, "z": "10.0", "y": "9.0", "v": "1"} for c in codes or ("2330",)]})


def row(minute, part, parts, after, text, source="collector"):
    """A response of the round at ``minute`` that arrives ``after`` seconds later."""
    at = START + pd.Timedelta(minutes=minute)
    return (at.to_pydatetime(), source, part, parts, (at + pd.Timedelta(seconds=after)).to_pydatetime(), text)


TICK = row(34, None, None, 5 * 86400, None, "clock")


def run(spark, rows, files=1):
    """Tagged rows of responses that are read ``files`` files at a time."""
    out, source = scratch_path(spark, "out"), scratch_path(spark, "in")
    for k, r in enumerate(sorted(rows, key=lambda r: r[4])):
        spark.createDataFrame([r], co.RESPONSE).coalesce(1).write.mode("append").parquet(source)
    stream = co.assemble(st.read_files(spark, co.RESPONSE, source, files))
    sq.run(stream.writeStream.foreachBatch(st.by_batch(out, lambda df: df, "kind")), "test", spark)
    return spark.read.schema(co.TAGGED.replace("trade_date string", "trade_date date")).parquet(out)


def statuses(tagged):
    rows = tagged.where("kind = 'round' AND status <> 'tick'").select("captured_at", "status").collect()
    return sorted(((r.captured_at - START).total_seconds() / 60, r.status) for r in rows)


def fates(tagged):
    rows = tagged.where("kind <> 'round'").select("captured_at", "part", "status").collect()
    return sorted(((r.captured_at - START).total_seconds() / 60, r.part, r.status) for r in rows)


@pytest.mark.parametrize("files", [1, 100])
def test_every_arrival_has_one_fate_however_it_is_batched(spark, files):
    rows = [
        row(0, 0, 2, 10, body()), row(0, 1, 2, 20, body("20240105")),
        row(2, 0, 2, 10, body()), row(2, 1, 2, 400, body()),
        row(4, 0, 1, 10, body()[:-3]), row(4, 0, 1, 30, body()),
        row(6, 1, 2, 5, body()), row(6, 1, 2, 8, body("20240105")), row(6, 0, 2, 9, body()),
        row(8, 0, 1, 90000, body()),
        row(10, 0, 1, 5, json.dumps({"rtmessage": "no data"})),
        row(12, 0, 2, 5, None), row(12, 1, 2, 6, body()),
        TICK,
    ]
    tagged = run(spark, rows, files).cache()
    assert statuses(tagged) == [(0, "ok"), (2, "incomplete"), (4, "unreadable"), (6, "ok"), (10, "undated"), (12, "unreadable")]
    assert fates(tagged) == [
        (0, 0, "ok"), (0, 1, "ok"), (2, 0, "round_failed"), (2, 1, "after_round"), (4, 0, "after_round"), (4, 0, "round_failed"),
        (6, 0, "ok"), (6, 1, "ok"), (6, 1, "replaced"), (8, 0, "expired"), (10, 0, "round_failed"), (12, 0, "round_failed"), (12, 1, "round_failed"),
    ]
    dates = {(r.trade_date is None, str(r.trade_date)) for r in tagged.where("kind = 'part'").collect()}
    assert dates == {(False, "2024-01-08")}


def test_the_last_response_with_an_index_counts(spark):
    def index(z):
        return json.dumps({"msgArray": [{"c": " T00 ", "ex": "TSE", "d": "20240108", "z": z, "y": "100"}, {"c": "2330", "ex": "tse", "d": "20240105", "z": "7", "v": "2"}]})

    tagged = run(spark, [row(0, 0, 2, 10, index("104.5")), row(0, 1, 2, 11, index("103")), TICK])
    parts = tagged.where("kind = 'part'")
    assert [(r.market, float(r.value), float(r.change_percent)) for r in co.round_indices(parts).collect()] == [("TWSE", 103.0, 3.0)]
    quotes = co.quotes(parts).collect()
    assert [(q.ticker, str(q.trade_date), q.turnover) for q in quotes] == [("2330", "2024-01-08", 14000)] * 2


def test_a_broken_response_does_not_stop_the_stream_and_its_slot_is_reported(spark):
    tagged = run(spark, [row(0, 0, 1, 10, "{"), row(2, 0, 1, 10, body()), TICK])
    rounds = tagged.where("kind = 'round'")
    source, out = scratch_path(spark, "rounds"), scratch_path(spark, "slots")
    rounds.orderBy("closed_at").coalesce(1).write.parquet(source)
    stream = co.missing_slots(st.read_files(spark, rounds.schema, source))
    sq.run(stream.writeStream.foreachBatch(st.by_batch(out)), "slots", spark)
    slots = spark.read.parquet(out)
    assert {r.slot: r.status for r in slots.where("status <> 'missing'").collect()} == {540: "unreadable", 542: "ok"}
    missing = [r.slot for r in slots.where("status = 'missing'").orderBy("slot").collect()]
    assert missing == [s for s in range(420, 815, 2) if s not in (540, 542)]
