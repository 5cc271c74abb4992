"""Intraday rounds as streams: sources, gate with state, idempotent sinks."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnbook.functions.parsing import COMMON_STOCK_PATTERN, compact_date, number
from turnbook.operators import intraday as it
from turnbook.schemas import INTRADAY_MESSAGE

# Fixed value: one collection round every two minutes.
TRIGGER = "2 minutes"
# The state of a day is dropped once event time has moved this far past it.  Rounds
# that come later than this are left out by the engine and show up in its
# dropped-rows metric; later than the lateness of the gate they are rejected visibly.
STATE_DELAY = "7 days"
DAY_MS = 24 * 60 * 60 * 1000
DAY_MINUTES = 24 * 60

ROUND_ROW = "trade_date date, captured_at timestamp_ntz, turnover_total bigint, quote_count bigint, arrival bigint"
VERDICT = (
    "trade_date date, captured_at timestamp_ntz, turnover_total bigint, quote_count bigint, "
    "previous_total bigint, accepted boolean, reason string"
)
VERDICT_COLUMNS = [part.split()[0] for part in VERDICT.split(", ")]
GATE_STATE = "newest bigint, times array<bigint>, totals array<bigint>"


def read_messages(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Landed feed responses, as JSON files."""
    return (
        spark.readStream.schema(INTRADAY_MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def read_files(spark: SparkSession, schema, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(writer, checkpoint: str, trigger: str | None = TRIGGER):
    """Start on the collection clock, or (``trigger=None``) take what is there and stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start()


def quotes_stream(messages: DataFrame, codes: str = COMMON_STOCK_PATTERN) -> DataFrame:
    """Typed quotes of responses of the Taipei day they were collected on.

    The newest date in a response is the trade date of all its quotes, so a share
    last traded on an earlier day stays in the round.
    """
    dated = messages.withColumn("trade_date", F.array_max(F.transform("msgArray", lambda x: compact_date(x["d"]))))
    current = dated.where(it.is_current(F.col("trade_date"), F.col("captured_at")))
    # The trade date replaces the date of each entry.
    stamped = current.withColumn(
        "msgArray",
        F.transform("msgArray", lambda x: x.withField("d", F.date_format("trade_date", "yyyyMMdd"))),
    )
    return it.quotes_of_items(it.message_items(stamped), codes).withColumnRenamed("quote_date", "trade_date")


def indices_stream(messages: DataFrame) -> DataFrame:
    """Index channels of each response: market, value, change; combine per round with ``newest_version``."""
    items = it.message_items(messages)
    market = it.index_market(F.col("c"), F.col("ex"))
    value = F.coalesce(number(F.col("z")), number(F.col("pz")), number(F.col("y")))
    rows = items.select("captured_at", "source", market.alias("market"), value.cast("decimal(14,4)").alias("value"))
    return rows.where(F.col("market").isNotNull() & F.col("value").isNotNull())


def by_batch(path: str, make: Callable[[DataFrame], DataFrame] = lambda df: df, *partitions: str):
    """A foreachBatch sink: every batch owns one folder, so a replay overwrites only itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out = make(batch)
        target = f"{path}/batch_id={batch_id}"
        writer = out.write.mode("overwrite")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(target)

    return write


def round_totals_sink(path: str):
    """Totals of the parts of rounds in a batch, combined before they are written.

    Quotes carry the ``part`` of the round (one request) and ``sent``, which grows
    when a part is sent again.
    """
    return by_batch(path, lambda batch: batch.groupBy(*it.ROUND, "part", "sent").agg(
        F.sum("turnover").alias("turnover_total"), F.count(F.lit(1)).alias("quote_count")
    ))


def read_round_totals(spark: SparkSession, path: str) -> DataFrame:
    """The parts of a round are added up; of a part that was sent again only the last one counts."""
    sums = [F.sum(c).alias(c) for c in ("turnover_total", "quote_count")]
    sent = spark.read.parquet(path).groupBy(*it.ROUND, "part", "sent").agg(*sums)
    last = sent.groupBy(*it.ROUND, "part").agg(F.max(F.struct("sent", "turnover_total", "quote_count")).alias("s"))
    return last.select(*it.ROUND, "s.*").groupBy(*it.ROUND).agg(*sums)


def dedupe(rounds: DataFrame, keys: tuple[str, ...], event_time: str = "captured_at", delay: str = "2 days") -> DataFrame:
    """Drop identical re-sends; the state of a key leaves with the watermark."""
    stamped = rounds.withColumn("_at", F.col(event_time).cast("timestamp"))
    return stamped.withWatermark("_at", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_at")


def tumbling(quotes: DataFrame, event_time: str, width: str = TRIGGER, delay: str = "10 minutes") -> DataFrame:
    """Turnover per slot; run in update mode, so open slots are refined and old ones leave the state."""
    return (
        quotes.withColumn("_at", F.col(event_time).cast("timestamp"))
        .withWatermark("_at", delay)
        .groupBy(F.window("_at", width).alias("w"))
        .agg(F.sum("turnover").alias("turnover_total"), F.count(F.lit(1)).alias("quote_count"))
        .select(F.col("w.start").alias("slot_start"), "turnover_total", "quote_count")
    )


def newest_version(path: str, spark: SparkSession, keys: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """One version per key: the last by ``order``, among equals that of the latest batch."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], F.desc("batch_id"))
    return (
        spark.read.parquet(path)
        .withColumn("_n", F.row_number().over(w))
        .where("_n = 1")
        .drop("_n", "batch_id")
    )


def judge_one(row, accepted: dict[int, int], newest: int | None, lateness_us: int) -> tuple[tuple, int]:
    """(verdict, newest capture) of a round; ``accepted`` keeps what a late one may still have to be compared with.

    Those are the accepted rounds inside the lateness, and the last one before it.
    """
    at = int(row.captured_at.value // 1000)
    total = int(row.turnover_total)
    too_late = newest is not None and at < newest - lateness_us
    # What came before a round that is too late may be forgotten already.
    earlier = [] if too_late else [t for t in accepted if t < at]
    before = accepted[max(earlier)] if earlier else None
    falls = before is not None and before > 0 and total * 10 < before * 9
    reason = "late" if too_late else "fell" if falls else None
    if reason is None:
        accepted[at] = total
    newest = at if newest is None else max(newest, at)
    seen = -1 if before is None else before
    old = sorted(t for t in accepted if t < newest - lateness_us)
    for t in old[:-1]:
        del accepted[t]
    return (row.trade_date, row.captured_at, total, int(row.quote_count), seen, reason is None, reason or ""), newest


def _judge(lateness_us: int):
    """State function of the gate."""

    def judge(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The worker joins empty and full frames when it sends results back.
        warnings.simplefilter("ignore", FutureWarning)
        if state.hasTimedOut:
            state.remove()
            return
        newest, times, totals = state.get if state.exists else (None, (), ())
        accepted = dict(zip(times, totals))
        # Rounds of one day: at most one per two minutes.
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            verdict, newest = judge_one(row, accepted, newest, lateness_us)
            out.append(verdict)
        kept = sorted(accepted)
        state.update((newest, kept, [accepted[t] for t in kept]))
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + DAY_MS)
        yield pd.DataFrame(out, columns=VERDICT_COLUMNS)

    return judge


def gate(rounds: DataFrame, lateness_minutes: int = DAY_MINUTES) -> DataFrame:
    """Judge rounds in order of arrival against the last accepted round before them.

    ``rounds`` has one row per round (``ROUND_ROW``), so a group never holds quotes.
    Rounds older than the lateness are rejected as late; by default it spans the
    day, so that every round of the day is judged.
    """
    lateness = lateness_minutes * 60 * 1_000_000
    judged = (
        rounds.withColumn("event_time", F.col("captured_at").cast("timestamp"))
        .withWatermark("event_time", STATE_DELAY)
        .groupBy("trade_date")
        .applyInPandasWithState(_judge(lateness), VERDICT, GATE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
    # The state function has no nulls to give: totals are never negative.
    return judged.withColumn("previous_total", F.when(F.col("previous_total") >= 0, F.col("previous_total"))).withColumn(
        "reason", F.when(F.col("reason") != "", F.col("reason"))
    )


def curve_sink(path: str):
    """Accepted rounds become curve rows; the curve is never pruned.  Read it with ``read_curve``."""
    return by_batch(
        path, lambda batch: batch.where("accepted").select(*it.ROUND, "turnover_total", "quote_count")
    )


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """A round that was sent again counts once, as sent last."""
    return newest_version(path, spark, tuple(it.ROUND))


def latest_session_sink(path: str):
    """Keep the rounds of the newest session only.

    New rounds are written first; older days are dropped once those are durable.
    The comparison is strict, so rounds of the same day stay.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where("accepted").select(*it.ROUND, "turnover_total", "quote_count")
        (
            fresh.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("trade_date", "batch_id")
            .parquet(path)
        )
        prune_older_days(spark, path)

    return write


def read_latest_session(spark: SparkSession, path: str) -> DataFrame:
    """The newest trade date alone, also while older folders are still there; a re-sent round counts as sent last."""
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("trade_date")).scalar()
    w = W.partitionBy(*it.ROUND).orderBy(F.desc("batch_id"))
    rows = stored.where(F.col("trade_date") == newest).withColumn("_n", F.row_number().over(w))
    return rows.where("_n = 1").drop("_n", "batch_id")


def prune_older_days(spark: SparkSession, path: str) -> None:
    """Delete the folders of all trade dates before the newest one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("trade_date=")]
    # One folder per trade date, and all but one go away each time.
    for folder in sorted(folders, key=lambda p: p.getName())[:-1]:
        fs.delete(folder, True)
