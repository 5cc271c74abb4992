"""Exact deduplication as a stateful stream whose state lives on disk and never expires.

Arrivals (digest of the normalised text, length, id) are landed as files and
streamed; the keyed state in RocksDB holds, per digest, how many rows came, and
of the best row its stable identifier and where its content is found (document
id and row of the landed table).  A later run with the same checkpoint goes on
where the last one ended.  Every document whose digest was hit is then compared
with the stored one byte by byte; texts that share a digest without being equal
are grouped anew by the texts themselves.

Defined cases: null texts are empty texts and equal each other; a row without
doc_id loses ties and may still stand for its group (keep_id null); of equal
rows that share a doc_id one stays; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnbook.llm.text import GAP
from turnbook.llm.stored import materialize
from turnbook.session import scratch_path

#: Landed bytes per micro-batch.
BYTES_PER_TRIGGER = 512 << 20

#: Settings of the state store: on disk without space set aside, bounded memory, only changes are uploaded.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP + "+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def grouped(arrivals: DataFrame) -> DataFrame:
    """Running state per digest of a (streaming or finished) table of arrivals."""
    best = F.struct("n_chars", (-F.col("doc_id")).alias("order_id"), (-F.col("row_id")).alias("order_row"))
    return arrivals.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(best).alias("best"))


def stream_state(spark: SparkSession, landed: str, schema, work: str) -> DataFrame:
    """Run all that is landed through the state; returns its newest row per digest."""
    kept = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        incoming = spark.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_TRIGGER).parquet(landed)
        # A replayed batch overwrites its own folder.
        query = (
            grouped(incoming)
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{work}/state")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{work}/updates/run={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = "digest string, group_size bigint, best struct<n_chars: int, order_id: bigint, order_row: bigint>"
    updates = spark.read.schema(shape).parquet(f"{work}/updates")
    # The state only grows, so the update of the largest group is the newest.
    newest = updates.groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("s"))
    return newest.select("digest", "s.group_size", "s.best")


def _settled(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    both = rows.join(state, key)
    return both.select(
        "doc_id",
        (-F.col("best.order_id")).alias("keep_id"),
        "group_size",
        (F.col("row_id") == -F.col("best.order_row")).alias("kept"),
        "text_sha256",
    )


def exact_duplicates(docs: DataFrame, digest=lambda sha: sha) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` shortens the hash by which rows meet; shorter ones cost more byte comparisons.
    """
    spark = docs.sparkSession
    arrivals = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_id"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"),
        sha256(normalised(F.col("text"))).alias("text_sha256"),
    ).withColumn("digest", digest(F.col("text_sha256")))
    work = scratch_path(spark, "exact")
    landed = f"{work}/arrivals"
    arrivals.write.parquet(landed)
    arrivals = spark.read.schema(arrivals.schema).parquet(landed)
    if arrivals.isEmpty():
        state = grouped(arrivals)
    else:
        state = materialize(stream_state(spark, landed, arrivals.schema, work), "state")

    bad = materialize(_unequal(docs, state, digest), "collisions")
    if bad.isEmpty():
        return _settled(arrivals, state, "digest")
    sound = _settled(arrivals.join(bad, "digest", "left_anti"), state, "digest")
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("plain", normalised(F.col("text"))).withColumn("text_sha256", sha256(F.col("plain")))
    texts = texts.withColumn("digest", digest(F.col("text_sha256"))).join(bad, "digest", "left_semi")
    texts = materialize(texts.withColumn("n_chars", F.char_length("text")).drop("digest", "text"), "collided")
    exact = grouped(texts.withColumnRenamed("plain", "digest")).withColumnRenamed("digest", "plain")
    return sound.unionByName(_settled(texts, exact, "plain"))


def _unequal(docs: DataFrame, state: DataFrame, digest) -> DataFrame:
    """Digests under which a document's full normalised text differs from the stored one's, once for each such document."""
    hits = state.where("group_size > 1").select("digest", (-F.col("best.order_id")).alias("keep_id"), "best.n_chars")
    plain = normalised(F.col("text"))
    texts = docs.select("doc_id", "text", digest(sha256(plain)).alias("digest"))
    texts = texts.join(hits, "digest").select("digest", "doc_id", "keep_id", "n_chars", "text", plain.cast("binary").alias("bytes"))
    texts = materialize(texts, "hits")
    held = texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.coalesce(F.char_length("text"), F.lit(0)) == F.col("n_chars")))
    # A written table, so that the join can split a large group of copies.
    held = materialize(held.groupBy("digest").agg(F.min("bytes").alias("held")), "held")
    return texts.join(held, "digest").where("bytes <> held").select("digest")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that an equal one stands for; rows without doc_id cannot be named and stay."""
    verdicts = exact_duplicates(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    verdicts = materialize(verdicts.where("doc_id is not null and (n > 1 or not kept)"), "verdicts")
    left = docs.join(verdicts.where("not kept"), "doc_id", "left_anti")
    twice = verdicts.where("kept")
    if twice.isEmpty():
        return left.select(*docs.columns)
    # Rows that share an id: one of each text stays.
    again = left.join(twice, "doc_id", "left_semi").withColumn("_plain", sha256(normalised(F.col("text")))).dropDuplicates(["doc_id", "_plain"])
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
