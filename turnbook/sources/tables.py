"""Stored tables: keyed upserts, incremental sync, retention, atomic replacement."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from turnbook.operators.calendar import retain_newest_dates
from turnbook.operators.quality import rows_of_missing_dates
from turnbook.session import materialize
from turnbook.sources import folders

# Fixed value: trading dates kept in the synced table.
RETENTION_DATES = 300
# Files of a bucketed table that an upsert may have to replace; fixed when the table is written first.
BUCKETS = 32


def upsert(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """``incoming`` rows replace ``existing`` ones of the same key; new keys are added.

    Among incoming rows of one key the last by ``order`` wins.  The rank filter
    is applied before the shuffle as well, so repeated keys stay cheap.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc(c) for c in order])
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def replace_round(existing_quotes: DataFrame, incoming_quotes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A re-sent round first clears its own quotes, then adds the new ones."""
    rounds = incoming_quotes.select(*keys).distinct()
    return existing_quotes.join(rounds, list(keys), "left_anti").unionByName(incoming_quotes)


def write_partitioned(df: DataFrame, path: str, *partitions: str) -> None:
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def bucket_of(keys: tuple[str, ...], buckets: int = BUCKETS) -> Column:
    """Bucket of a key for tables that have no date to store them by."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """A table stored by a hash of its keys; ``upsert_buckets`` then reads and replaces only the buckets it has rows for."""
    write_partitioned(df.withColumn("bucket", bucket_of(keys)), path, "bucket")


def upsert_buckets(path: str, incoming: DataFrame, keys: tuple[str, ...], order: tuple[str, ...] = ()) -> None:
    """Upsert into a bucketed table.  Of the incoming rows of a key only the last by ``order`` travels on."""
    last = upsert(incoming.limit(0), incoming, keys, order)
    upsert_into(path, materialize(last.withColumn("bucket", bucket_of(keys)), "incoming"), keys, "bucket", order)


def replace_rounds_into(path: str, incoming: DataFrame, keys: tuple[str, ...], partition: str) -> None:
    """``replace_round`` of a stored table: only the partitions of the rounds that are sent again are read and replaced."""
    spark = incoming.sparkSession
    # Partition values are bounded by the calendar.
    touched = [r[0] for r in incoming.select(partition).distinct().collect()]
    before = spark.read.parquet(path).where(F.col(partition).isin(touched)).select(*incoming.columns)
    write_partitioned(materialize(replace_round(before, incoming, keys), "rounds"), path, partition)


def upsert_into(path: str, incoming: DataFrame, keys: tuple[str, ...], partition: str, order: tuple[str, ...] = ()) -> None:
    """Upsert into a stored table; only partitions that ``incoming`` has rows for are read and replaced.

    ``partition`` is a column of both.  Running it again changes nothing.
    """
    spark = incoming.sparkSession
    # Partition values are bounded by the calendar.
    touched = [r[0] for r in incoming.select(partition).distinct().collect()]
    stored = spark.read.parquet(path)
    before = stored.where(F.col(partition).isin(touched)).withColumn(partition, F.col(partition).cast(incoming.schema[partition].dataType))
    merged = materialize(upsert(before.select(*incoming.columns), incoming, keys, order), "upsert")
    write_partitioned(merged, path, partition)


def sync(source: DataFrame, target: DataFrame, securities: DataFrame, keep: int = RETENTION_DATES) -> DataFrame:
    """Target after adding the dates it lacks (known tickers only) and keeping the newest ``keep`` dates."""
    known = securities.select("ticker")
    added = rows_of_missing_dates(source, target).join(known, "ticker", "left_semi")
    return retain_newest_dates(target.unionByName(added.select(*target.columns)), keep)


def sync_into(path: str, source: DataFrame, securities: DataFrame, keep: int = RETENTION_DATES) -> DataFrame:
    """``sync`` of a table stored by ``trading_month``; returns the synced table.

    Only months that gain a date are read and replaced.  Dates that fall out of
    the newest ``keep`` leave the months that are replaced; older months are no
    longer read.
    """
    spark = source.sparkSession
    stored = spark.read.parquet(path)
    added = rows_of_missing_dates(source, stored).join(securities.select("ticker"), "ticker", "left_semi")
    added = materialize(added.withColumn("trading_month", F.trunc("trading_date", "month")), "added")
    dates = stored.select("trading_date").union(added.select("trading_date")).distinct()
    oldest = dates.orderBy(F.desc("trading_date")).limit(keep).agg(F.min("trading_date")).first()[0]
    months = [r[0] for r in added.select("trading_month").distinct().collect()]
    before = stored.where(F.col("trading_month").isin(months))
    renewed = before.unionByName(added.select(*stored.columns)).where(F.col("trading_date") >= F.lit(oldest))
    write_partitioned(materialize(renewed, "synced"), path, "trading_month")
    first_month = None if oldest is None else oldest.replace(day=1)
    return spark.read.parquet(path).where((F.col("trading_month") >= F.lit(first_month)) & (F.col("trading_date") >= F.lit(oldest)))


class VersionedTables:
    """A group of tables replaced together.

    Every publish writes a new version folder; one small append to the log then
    makes it current, so readers see either all old or all new tables.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, **tables: DataFrame) -> str:
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/versions/{version}/{name}")
        entry = self.spark.range(1).select(F.lit(version).alias("version"), F.now().alias("published_at"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return version

    def current(self) -> str:
        log = self.spark.read.parquet(f"{self.root}/log")
        return log.orderBy(F.desc("published_at"), F.desc("version")).first()["version"]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/versions/{self.current()}/{name}")


class RetainedTable:
    """A table stored by month whose readers see the newest dates only; it has one writer at a time.

    Rows of a month that are written again become a new version of it beside the
    old one.  The range of dates and the versions that may be read are published
    by one small append to a log, after the rows are there; folders are deleted
    only then, and ``expire`` spares what the range published before the newest
    one needs.  So a reader sees one whole range, and its files stay.
    """

    PARTITIONS = ("trading_month", "version")

    def __init__(self, spark: SparkSession, root: str, keep: int = RETENTION_DATES):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.data = f"{self.root}/data"

    def _folders(self) -> dict[tuple[dt.date, int], str]:
        """(month, version) of each stored folder; their number is bounded by the calendar and by ``expire``."""
        months = folders.partitions(self.spark, self.data, "trading_month")
        found = [(m, v) for m in months for v in folders.partitions(self.spark, m, "version")]
        value = lambda f: f.rsplit("=", 1)[1]
        return {(dt.date.fromisoformat(value(m)), int(value(v))): v for m, v in found}

    def write(self, rows: DataFrame) -> None:
        """Store rows; the months they fall into are replaced as soon as the next range is published."""
        version = 1 + max((v for _, v in self._folders()), default=0)
        placed = rows.withColumns({"trading_month": F.trunc("trading_date", "month"), "version": F.lit(version)})
        placed.hint("rebalance", *self.PARTITIONS).write.mode("append").partitionBy(*self.PARTITIONS).parquet(self.data)

    def _versions(self, upto: int, first: dt.date | None = None) -> set[tuple[dt.date, int]]:
        """The newest version of each month, as of version ``upto``, of the months that a range from ``first`` needs."""
        newest: dict[dt.date, int] = {}
        for month, v in self._folders():
            if v <= upto and (first is None or month >= first.replace(day=1)):
                newest[month] = max(v, newest.get(month, 0))
        return set(newest.items())

    def _rows(self, versions: set[tuple[dt.date, int]]) -> DataFrame:
        wanted = F.lit(False)
        for version in sorted({v for _, v in versions}):
            months = [m for m, v in versions if v == version]
            wanted = wanted | ((F.col("version") == version) & F.col("trading_month").isin(months))
        return self.spark.read.parquet(self.data).where(wanted)

    def publish(self) -> tuple[dt.date, dt.date, int] | None:
        """Make the newest ``keep`` stored dates the range that readers see: first and last date, and the version."""
        version = max((v for _, v in self._folders()), default=0)
        dates = self._rows(self._versions(version)).select("trading_date").distinct()
        first, last = dates.orderBy(F.desc("trading_date")).limit(self.keep).agg(F.min("trading_date"), F.max("trading_date")).first()
        if first is None:
            return None
        number = 1 + len(folders.partitions(self.spark, f"{self.root}/ranges", "number"))
        entry = self.spark.range(1).select(F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(version).alias("version"))
        entry.coalesce(1).write.parquet(f"{self.root}/ranges/number={number}")
        return first, last, version

    def ranges(self, n: int) -> list[tuple[dt.date, dt.date, int]]:
        """The newest ``n`` published ranges, newest first."""
        log = self.spark.read.parquet(f"{self.root}/ranges").orderBy(F.desc("number"))
        return [(r["first"], r["last"], r["version"]) for r in log.limit(n).collect()]

    def read(self, published: tuple[dt.date, dt.date, int] | None = None) -> DataFrame:
        """Rows of a published range, by default the newest; only its months are read."""
        first, last, version = published or self.ranges(1)[0]
        rows = self._rows(self._versions(version, first))
        return rows.where(F.col("trading_date").between(F.lit(first), F.lit(last))).drop(*self.PARTITIONS)

    def expire(self) -> list[tuple[dt.date, int]]:
        """Delete what neither of the two newest ranges needs; returns the months and versions that went."""
        published = self.ranges(2)
        needed = {x for first, _, version in published for x in self._versions(version, first)}
        newest = published[0][2]
        gone = {x: f for x, f in self._folders().items() if x not in needed and x[1] <= newest}
        folders.delete(self.spark, list(gone.values()))
        return sorted(gone)
