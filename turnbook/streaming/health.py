"""Health counters of streams: what each micro-batch read, gave, and left behind the watermark.

``observed`` lets a stream count its own rows while they pass; a listener lands
the counts of every micro-batch, with the engine's input rows and the rows it
dropped behind the watermark, in a folder of that batch.  A batch that is run
again replaces its folder, so totals count it once.

Observe the rows that go to the sink, after every shuffle: a task of the last
stage is counted once however often executors are lost, and one of an earlier
stage may be counted again.  A sink must read its batch once.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from turnbook.operators import intraday as it
from turnbook.streaming.rounds import start

COUNTER = "counter string, value bigint"
STORED = COUNTER + ", query_id string, batch_id bigint"
# Seconds to wait for the last events of a stream that has ended.
SETTLE_SECONDS = 120


def observed(rows: DataFrame, label: str, **counters: Column) -> DataFrame:
    """``rows`` that count themselves; a counter is an aggregate of whole numbers, null counts as 0."""
    return rows.observe(label, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for name, c in counters.items()])


def profiled(quotes: DataFrame, sources: Iterable[str] = it.PRICE_SOURCES) -> DataFrame:
    """Quotes that count themselves by price source, and those with volume but no price."""
    priceless = F.col("price").isNull() & (F.col("trading_volume") > 0)
    counters = {}
    for source in sources:
        own = F.col("price_source") == source
        counters |= {f"{source}:quotes": F.count_if(own), f"{source}:priceless": F.count_if(own & priceless)}
    return observed(quotes, "profile", **counters)


def counters_of(progress) -> list[tuple[str, int]]:
    """(counter, value) of a micro-batch: the engine's own, then those that its rows kept, by label."""
    dropped = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
    rows = [("engine:input_rows", progress.numInputRows), ("engine:dropped_by_watermark", dropped)]
    for label, row in sorted(progress.observedMetrics.items()):
        rows += [(f"{label}:{name}", value) for name, value in row.asDict().items()]
    return rows


class Health(StreamingQueryListener):
    """Lands the counters of the streams named ``name`` below ``path``, one small file per micro-batch."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path
        self.failure: BaseException | None = None
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def land(self, progress) -> None:
        target = f"{self.path}/query_id={progress.id}/batch_id={progress.batchId}"
        self.spark.createDataFrame(counters_of(progress), COUNTER).coalesce(1).write.mode("overwrite").parquet(target)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name != self.name:
            return
        try:
            self.land(event.progress)
        except Exception as failure:  # The engine only logs what a listener raises; ``settle`` tells.
            self.failure = self.failure or failure

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def settle(self, run_id: str) -> None:
        """Wait until all counters of an ended run are down; raises if some could not be landed."""
        with self._changed:
            if not self._changed.wait_for(lambda: run_id in self._ended, SETTLE_SECONDS):
                raise TimeoutError("the stream's last events did not arrive")
        if self.failure is not None:
            raise RuntimeError("counters of a micro-batch could not be landed") from self.failure


def run_counted(spark: SparkSession, writer, name: str, checkpoint: str, path: str) -> None:
    """Take what is there and stop, with the counters of every micro-batch below ``path``."""
    health = Health(spark, name, path)
    spark.streams.addListener(health)
    try:
        running = start(writer.queryName(name), checkpoint, trigger=None)
        running.awaitTermination()
        health.settle(str(running.runId))
    finally:
        spark.streams.removeListener(health)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """counter, value, query_id, batch_id of every micro-batch."""
    return spark.read.schema(STORED).parquet(path)


def totals(counters: DataFrame) -> DataFrame:
    """label, field, value: counters summed over micro-batches; a name is ``label:field`` or ``label:field:kind``."""
    summed = counters.groupBy("counter").agg(F.sum("value").alias("value"))
    return summed.select(
        F.substring_index("counter", ":", 1).alias("label"), F.expr("substring(counter, instr(counter, ':') + 1)").alias("field"), "value"
    )


def price_source_totals(counters: DataFrame) -> DataFrame:
    """The profile of all micro-batches in the form of the batch profile; a source without quotes has no row."""
    fields = totals(counters).where("label = 'profile'").select(
        F.substring_index("field", ":", 1).alias("price_source"), F.substring_index("field", ":", -1).alias("kind"), "value"
    )
    rows = fields.groupBy("price_source").agg(
        F.sum(F.when(F.col("kind") == "quotes", F.col("value"))).alias("quotes"),
        F.sum(F.when(F.col("kind") == "priceless", F.col("value"))).alias("priceless_with_volume"),
    )
    return rows.where("quotes > 0")
