"""Stored tables: what an upsert reads and replaces, retention that removes, snapshots with lost lines."""

from __future__ import annotations

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from turnbook.session import scratch_path
from turnbook.sources import folders, snapshots as sn, tables as tb


def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_an_upsert_replaces_the_buckets_of_its_keys_only(spark):
    path = scratch_path(spark, "bucketed")
    rows = spark.range(2000).select(F.col("id").cast("string").alias("ticker"), F.lit(1).alias("version"), F.lit("old").alias("name"))
    tb.write_bucketed(rows, path, ("ticker",))
    before = files(path)
    again = spark.createDataFrame([("7", 2, "newer"), ("7", 3, "newest"), ("7", 2, "late"), ("new", 1, "added")], "ticker string, version int, name string")
    tb.upsert_buckets(path, again, ("ticker",), ("version",))
    stored = {r.ticker: r.name for r in spark.read.parquet(path).select("ticker", F.col("name").alias("name")).collect()}
    assert len(stored) == 2001 and stored["7"] == "newest" and stored["new"] == "added" and stored["8"] == "old"
    touched = {r[0] for r in again.select(tb.bucket_of(("ticker",))).collect()}
    same = {f for f, at in files(path).items() if before.get(f) == at}
    assert {f for f in before if int(f.split("=")[1].split("/")[0]) not in touched} == same
    tb.upsert_buckets(path, again, ("ticker",), ("version",))
    assert spark.read.parquet(path).count() == 2001


def test_a_round_sent_again_touches_its_date_only(spark):
    path = scratch_path(spark, "rounds")
    quotes = spark.createDataFrame([(dt.date(2024, 1, day), at, t, 1) for day in (1, 2) for at in (1, 2) for t in "ab"], "trade_date date, captured_at int, ticker string, turnover int")
    tb.write_partitioned(quotes, path, "trade_date")
    before = files(path)
    again = spark.createDataFrame([(dt.date(2024, 1, 2), 1, "b", 5)], quotes.schema)
    tb.replace_rounds_into(path, again, ("trade_date", "captured_at"), "trade_date")
    rows = sorted((r.trade_date.day, r.captured_at, r.ticker, r.turnover) for r in spark.read.parquet(path).collect())
    assert rows == [(1, 1, "a", 1), (1, 1, "b", 1), (1, 2, "a", 1), (1, 2, "b", 1), (2, 1, "b", 5), (2, 2, "a", 1), (2, 2, "b", 1)]
    assert all(files(path)[f] == at for f, at in before.items() if "01-01" in f)


def dates_of(df):
    return sorted(r[0] for r in df.select("trading_date").distinct().collect())


def test_expired_months_go_and_a_reader_in_between_sees_one_range(spark):
    days = spark.range(120).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("trading_date"), F.col("id").alias("v"))
    table = tb.RetainedTable(spark, scratch_path(spark, "retained"), keep=40)
    table.write(days.where("v < 80"))
    old = table.publish()
    assert old[:2] == (dt.date(2024, 2, 10), dt.date(2024, 3, 20)) and len(dates_of(table.read())) == 40
    assert table.expire() == [(dt.date(2024, 1, 1), 1)]
    reading = table.read()
    table.write(days.where("trading_date >= DATE'2024-03-01'").withColumn("v", F.col("v") + 1000))
    # Rows that are there but not published are not seen.
    assert dates_of(table.read()) == dates_of(reading) and len(dates_of(reading)) == 40
    new = table.publish()
    assert table.expire() == []
    assert new[:2] == (dt.date(2024, 3, 21), dt.date(2024, 4, 29)) and len(dates_of(table.read())) == 40
    # A reader of the range before still has its own rows, those of March as they were.
    for before in (reading, table.read(old)):
        assert len(dates_of(before)) == 40 and before.agg(F.max("v")).first()[0] == 79
    assert table.read().agg(F.min("v")).first()[0] == 1080
    table.publish()
    assert table.expire() == [(dt.date(2024, 2, 1), 1), (dt.date(2024, 3, 1), 1)]
    assert [f.rsplit("=", 1)[1] for f in folders.partitions(spark, table.data, "trading_month") if folders.partitions(spark, f, "version")] == ["2024-03-01", "2024-04-01"]


def line(date, part, parts, checksum, value="1", trading="true"):
    return (
        '{"schema_version":2,"trading_date":"%s","is_trading_day":%s,"quotes":[{"market":"TWSE","ticker":"1001","trading_value":%s}],'
        '"market_indices":[],"part":%d,"parts":%d,"checksum":%s}' % (date, trading, value, part, parts, checksum)
    )


def scanned(spark, lines):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    return sorted(str(x) for x in dates_of(sn.scan(spark, path))), sorted(str(x) for x in dates_of(sn.incomplete_dates(spark, path)))


def test_a_date_counts_only_as_a_whole(spark):
    path = scratch_path(spark, "one")
    spark.createDataFrame([(line("2024-01-01", 0, 1, "null"),)], "value string").write.text(path)
    good = sn.lines(spark, path).select(sn.checksum().alias("c")).first()["c"]
    lines = [
        line("2024-01-02", 0, 2, good), line("2024-01-02", 1, 2, good),
        line("2024-01-03", 0, 2, good), line("2024-01-03", 1, 2, good)[:-9],
        line("2024-01-04", 1, 2, good),
        line("2024-01-05", 0, 1, good, value="2"),
        line("2024-01-08", 0, 2, good), line("2024-01-08", 0, 2, good),
        line("2024-01-09", 0, 1, good), line("2024-01-09", 0, 2, good),
        line("2024-01-13", 0, 1, good, trading="false"),
        '{"schema_version":2,"trading_date":"2024-01-10","is_trading_day":true,"quotes":[]}',
        "{broken",
    ]
    assert scanned(spark, lines) == (["2024-01-02", "2024-01-10"], ["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08", "2024-01-09"])


def test_no_lines(spark):
    assert scanned(spark, ["", "{"]) == ([], [])


def test_snapshot_lines_are_compressed_files_of_bounded_lines(spark, tmp_path, monkeypatch):
    import gzip

    from turnbook.sources import snapshots as sn

    monkeypatch.setattr(sn, "LINES_PER_FILE", 10)
    values = spark.range(35).selectExpr("concat('line ', id) AS value").coalesce(1)
    sn.write_lines(values, str(tmp_path / "lines"))
    files = [gzip.open(f, "rt").read().splitlines() for f in (tmp_path / "lines").glob("*.gz")]
    assert sorted(map(len, files)) == [5, 10, 10, 10]
    assert sorted(line for f in files for line in f) == sorted(f"line {i}" for i in range(35))
