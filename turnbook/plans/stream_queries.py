"""Streams over the event table, run to the end of the landed files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window as W, functions as F

from turnbook.operators import intraday as it
from turnbook.plans import base_sql as b, landed
from turnbook.plans.intraday_queries import FEED, FEED_PRICE, GATE, GATE_COLUMNS
from turnbook.plans.registry import query, shape
from turnbook.session import materialize, scratch_path
from turnbook.sources import driver_tables as d
from turnbook.streaming import collection as co, health as hl, rounds as st

FILES_PER_TRIGGER = 8


def land(df: DataFrame, label: str, fmt: str = "parquet") -> str:
    """Put the rows down as files for a stream; their number follows the data."""
    path = scratch_path(df.sparkSession, label)
    df.write.format(fmt).save(path)
    return path


def _timed_in_order(spark, path: str) -> bool:
    """Give the part files of a folder times a second apart, in the order of their numbers; False if the store keeps none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("part-")]
    files.sort(key=lambda f: (int(f.getName().split("-")[1]), f.getName()))
    last = int(time.time())
    for k, file in enumerate(files):
        at = (last - len(files) + k) * 1000
        fs.setTimes(file, at, -1)
        if fs.getFileStatus(file).getModificationTime() != at:
            return False
    return True


def land_by_time(df: DataFrame, at: str, label: str) -> str:
    """Put the rows down for a stream in the order of ``at``: no file begins before the one before it ends.

    A file source takes files by their time, so no unread row is ever older than
    what was read, however long the history and however few files a batch takes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.repartitionByRange(at).sortWithinPartitions(at).write.parquet(path)
    if _timed_in_order(spark, path):
        return path
    # The store sets times itself, to the second at worst: the ranges once more, one after the other.
    ordered, ranges = scratch_path(spark, label), spark.read.schema(df.schema).parquet(path)
    for file in sorted(ranges.inputFiles(), key=lambda f: int(f.rsplit("/part-", 1)[1].split("-")[0])):
        spark.read.schema(df.schema).parquet(file).coalesce(1).write.mode("append").parquet(ordered)
        time.sleep(1)
    return ordered


def land_in_order(rounds: DataFrame, label: str) -> str:
    """Put rounds down in the order of ``arrival``, over all days; those of a day that arrive together share a file."""
    return land_by_time(rounds, "arrival", label)


def run(writer, label: str, spark) -> None:
    st.start(writer, scratch_path(spark, label + "-checkpoint"), trigger=None).awaitTermination()


def landed_rounds(spark, sf) -> str:
    """Files of judged-to-be rounds; the arrival number follows the clock."""
    totals = d.round_totals(spark, sf)
    return land_in_order(totals.withColumn("arrival", F.unix_seconds(F.col("captured_at").cast("timestamp"))), "rounds")


# Responses of two-minute rounds, what becomes of each, and of their rounds.
COLLECTED = f"""
traded AS (
  SELECT epoch_us(ts) // 120000000 AS slot, CAST(ts AS DATE) AS trade_date, user_id, event_id, event_type,
         CAST(floor(value * 100 + 0.5) AS BIGINT) AS price_c, CAST(json_extract_string(props, '$.k') AS BIGINT) AS lots
  FROM events WHERE event_type <> 'signup'),
shares AS (
  SELECT *, user_id // 150 AS part, make_timestamp(slot * 120000000) AS captured_at, {FEED_PRICE} AS p4 FROM traded
  WHERE (slot * 2 + 480) % 1440 BETWEEN 420 AND 814
  QUALIFY row_number() OVER (PARTITION BY slot, user_id ORDER BY event_id DESC) = 1),
parted AS (
  SELECT slot, captured_at, part, (slot * 7 + part * 3) % 40 AS fault, count(*) OVER (PARTITION BY slot) AS parts FROM shares GROUP BY 1, 2, 3),
sent AS (
  SELECT *, captured_at + to_seconds(10 + part + CASE fault WHEN 3 THEN 300 WHEN 4 THEN 93600 ELSE 0 END) AS arrival, fault = 1 AS broken
  FROM parted WHERE fault <> 2),
timely AS (
  SELECT *, arrival > captured_at + INTERVAL 1 DAY AS expired,
         arrival <= min(arrival) FILTER (arrival <= captured_at + INTERVAL 1 DAY) OVER (PARTITION BY slot) + INTERVAL 2 MINUTE AS in_time
  FROM sent),
collected AS (
  SELECT slot, captured_at, CASE WHEN count(*) FILTER (in_time) < any_value(parts) THEN 'incomplete' WHEN bool_or(broken AND in_time) THEN 'unreadable' ELSE 'ok' END AS status,
         CASE WHEN count(*) FILTER (in_time) < any_value(parts) THEN min(arrival) + INTERVAL 2 MINUTE ELSE max(arrival) END AS closed_at
  FROM timely WHERE NOT expired GROUP BY 1, 2)"""


def collected(spark, sf) -> str:
    """The sink of assembled rounds, with one folder per batch and kind of row."""
    source, out = land_by_time(landed.responses(spark, sf), "arrival", "responses"), scratch_path(spark, "collected")
    tagged = co.assemble(st.read_files(spark, co.RESPONSE, source, FILES_PER_TRIGGER))
    run(tagged.writeStream.foreachBatch(st.by_batch(out, lambda df: df, "kind")), "collected", spark)
    return out


@query("stream_intraday_source", "WITH" + COLLECTED + """,
current AS (
  SELECT s.*, count(DISTINCT part) OVER (PARTITION BY slot) AS parts, max(price_c) OVER (PARTITION BY slot) AS hi, min(price_c) OVER (PARTITION BY slot) AS lo
  FROM shares s JOIN collected c USING (slot) WHERE c.status = 'ok' AND trade_date = CAST(s.captured_at + INTERVAL 8 HOUR AS DATE))
SELECT captured_at, trade_date, 'quote' AS kind, CASE WHEN lots >= 50 THEN 'TPEX' ELSE 'TWSE' END AS market, CAST(user_id + 1000 AS VARCHAR) AS code,
       p4 / 10000.0::DOUBLE AS price, CAST(coalesce(p4 * lots // 10, 0) AS BIGINT) AS turnover FROM current
UNION ALL
SELECT DISTINCT captured_at, trade_date, 'index', market, code, CASE WHEN market = 'TWSE' AND parts = 1 THEN hi ELSE lo END / 100.0::DOUBLE, 0::BIGINT
FROM current CROSS JOIN (VALUES ('TWSE', 't00'), ('TPEX', 'o00')) AS m(market, code)""")
def stream_intraday_source(spark, sf):
    """Quotes of complete rounds of the day, and one index value per market and round."""
    parts = materialize(co.read_kind(spark, collected(spark, sf), "part"), "parts")
    dates = parts.select("captured_at", "source", "trade_date").distinct()
    quotes = co.quotes(parts, d.KEY_CODES).select("captured_at", "trade_date", F.lit("quote").alias("kind"), "market", F.col("ticker").alias("code"), "price", "turnover")
    indices = co.round_indices(parts).join(dates, ["captured_at", "source"]).select(
        "captured_at", "trade_date", F.lit("index").alias("kind"), "market", F.when(F.col("market") == "TWSE", "t00").otherwise("o00").alias("code"),
        F.col("value").alias("price"), F.lit(0).cast("bigint").alias("turnover"),
    )
    return shape(quotes.unionByName(indices), "captured_at trade_date kind market code price:d turnover")


@query("stream_rejects", "WITH" + COLLECTED + """
SELECT captured_at, part::BIGINT AS part, CASE WHEN expired THEN 'expired' WHEN NOT in_time THEN 'after_round' WHEN status = 'ok' THEN 'ok' ELSE 'round_failed' END AS fate
FROM timely LEFT JOIN collected USING (slot, captured_at)""")
def stream_rejects(spark, sf):
    """Every response exactly once: in a complete round, or among the rejects with the reason."""
    rows = spark.read.parquet(collected(spark, sf)).where("kind IN ('part', 'reject')")
    return shape(rows, "captured_at part:l fate=status")


@query("stream_round_slots", "WITH" + COLLECTED + """,
span AS (SELECT min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events),
due AS (SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS session_date, last FROM span),
seen AS (SELECT CAST(captured_at + INTERVAL 8 HOUR AS DATE) AS session_date, (slot * 2 + 480) % 1440 AS slot, status, closed_at FROM collected),
sessions AS (SELECT session_date FROM due WHERE isodow(session_date) <= 5 OR session_date = last UNION SELECT session_date FROM seen),
grid AS (SELECT session_date, unnest(range(420, 815, 2)) AS slot FROM sessions)
SELECT session_date, slot::BIGINT AS slot, status FROM seen
UNION ALL
SELECT session_date, slot::BIGINT, 'missing' FROM grid g WHERE NOT EXISTS (
  SELECT 1 FROM seen s WHERE s.session_date = g.session_date AND s.slot = g.slot AND s.closed_at <= g.session_date + INTERVAL 345 MINUTE)""")
def stream_round_slots(spark, sf):
    """Rounds by their slot, broken ones included, and the slots of every session that no round took."""
    rounds = materialize(co.read_kind(spark, collected(spark, sf), "round"), "rounds")
    source, out = land_by_time(rounds, "closed_at", "closed"), scratch_path(spark, "slots")
    slots = co.missing_slots(st.read_files(spark, rounds.schema, source, FILES_PER_TRIGGER))
    run(slots.writeStream.foreachBatch(st.by_batch(out)), "slots", spark)
    return shape(spark.read.parquet(out), "session_date slot:l status")


@query("stream_rounds", "WITH " + b.INTRADAY + """
SELECT trade_date, captured_at, CAST(sum(turnover * CASE WHEN (CAST(ticker AS BIGINT) - 1000) % 3 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS turnover_total,
       count(*) AS quote_count
FROM ticks GROUP BY 1, 2""")
def stream_rounds(spark, sf):
    """Quotes in, totals of each round out; every third request is sent again with doubled values."""
    part = ((F.col("ticker").cast("bigint") - 1000) % 3).cast("int")
    quotes = d.intraday_quotes(spark, sf).select(*it.ROUND, "ticker", "turnover", part.alias("part"), F.lit(1).alias("sent"))
    again = quotes.where("part = 1").withColumns({"turnover": F.col("turnover") * 2, "sent": F.lit(2)})
    sent = quotes.unionByName(again)
    source, out = land(sent, "ticks"), scratch_path(spark, "totals")
    stream = st.read_files(spark, sent.schema, source, FILES_PER_TRIGGER)
    run(stream.writeStream.foreachBatch(st.round_totals_sink(out)), "rounds", spark)
    return st.read_round_totals(spark, out)


@query("stream_dedupe", "WITH " + b.INTRADAY + """
SELECT trade_date, captured_at, 'collector' AS source, turnover_total + CASE WHEN quote_count % 2 = 0 THEN 7 ELSE 0 END AS turnover_total
FROM rounds""")
def stream_dedupe(spark, sf):
    """Every round is sent three times: as it was, the same again, and a day later, some with another total; the last counts."""
    totals = d.round_totals(spark, sf).select(
        *it.ROUND, F.lit("collector").alias("source"), "turnover_total", "quote_count"
    )
    first = totals.withColumn("sent_at", F.col("captured_at"))
    changed = F.col("turnover_total") + F.when(F.col("quote_count") % 2 == 0, 7).otherwise(0)
    second = totals.withColumn("turnover_total", changed).withColumn("sent_at", F.col("captured_at") + F.expr("INTERVAL 1 DAY"))
    sent = first.unionByName(first).unionByName(second)
    source, out = land_by_time(sent, "sent_at", "resent"), scratch_path(spark, "deduped")
    stream = st.read_files(spark, sent.schema, source)
    keys = ("trade_date", "captured_at", "source")
    unique = st.dedupe(stream, (*keys, "sent_at"), event_time="sent_at", delay="10 days")
    run(unique.writeStream.foreachBatch(st.by_batch(out)), "dedupe", spark)
    return st.newest_version(out, spark, keys, ("sent_at",)).select(*keys, "turnover_total")


@query("stream_tumbling_slots", """
SELECT time_bucket(INTERVAL 2 MINUTE, ts) AS slot_start,
       CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT) * CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000) AS BIGINT) AS turnover_total,
       count(*) AS quote_count FROM events GROUP BY 1""")
def stream_tumbling_slots(spark, sf):
    ticks = d.intraday_quotes(spark, sf).select("ts", "turnover")
    source, out = land_by_time(ticks, "ts", "slots"), scratch_path(spark, "slots-out")
    slots = st.tumbling(st.read_files(spark, ticks.schema, source, FILES_PER_TRIGGER), "ts")
    run(slots.writeStream.outputMode("update").foreachBatch(st.by_batch(out)), "slots", spark)
    rows = st.newest_version(out, spark, ("slot_start",))
    return rows.withColumn("slot_start", F.col("slot_start").cast("timestamp_ntz"))


@query("stream_gate", GATE + f"SELECT {GATE_COLUMNS} FROM fold")
def stream_gate(spark, sf):
    out = scratch_path(spark, "verdicts")
    judged = st.gate(st.read_files(spark, st.ROUND_ROW, landed_rounds(spark, sf), FILES_PER_TRIGGER))
    run(judged.writeStream.foreachBatch(st.by_batch(out)), "gate", spark)
    return spark.read.parquet(out).drop("batch_id", "reason")


@query("stream_curve_sink", GATE + "SELECT trade_date, captured_at, turnover_total, quote_count FROM fold WHERE accepted")
def stream_curve_sink(spark, sf):
    out = scratch_path(spark, "curve")
    judged = st.gate(st.read_files(spark, st.ROUND_ROW, landed_rounds(spark, sf), FILES_PER_TRIGGER))
    run(judged.writeStream.foreachBatch(st.curve_sink(out)), "curve", spark)
    return st.read_curve(spark, out)


@query("stream_latest_sink", GATE + """
SELECT trade_date, captured_at, turnover_total, quote_count FROM fold
WHERE accepted AND trade_date = (SELECT max(trade_date) FROM fold WHERE accepted)""")
def stream_latest_sink(spark, sf):
    out = scratch_path(spark, "session")
    judged = st.gate(st.read_files(spark, st.ROUND_ROW, landed_rounds(spark, sf), FILES_PER_TRIGGER))
    run(judged.writeStream.foreachBatch(st.latest_session_sink(out)), "session", spark)
    return st.read_latest_session(spark, out).select(*it.ROUND, "turnover_total", "quote_count")


def shuffled_rounds(spark, sf) -> DataFrame:
    """Rounds in a disturbed order: by the number of the hour some come one or three hours after their time."""
    totals = d.round_totals(spark, sf)
    seconds = F.unix_seconds(F.col("captured_at").cast("timestamp"))
    hour = F.floor(seconds / 3600)
    delay = F.when(hour % 7 == 2, 3 * 3600 + 2).when(hour % 5 == 1, 3600 + 1).otherwise(0)
    return totals.withColumn("arrival", seconds + delay)


LATE = "WITH RECURSIVE " + b.INTRADAY + """,
hours AS (SELECT *, CAST(epoch(captured_at) AS BIGINT) AS sec, CAST(epoch(captured_at) AS BIGINT) // 3600 AS h FROM rounds),
arrivals AS (
  SELECT trade_date, captured_at, turnover_total, quote_count,
         row_number() OVER (PARTITION BY trade_date ORDER BY sec + CASE WHEN h % 7 = 2 THEN 10802 WHEN h % 5 = 1 THEN 3601 ELSE 0 END) AS n
  FROM hours),
fold AS (
  SELECT trade_date, captured_at, turnover_total, quote_count, n, CAST(NULL AS BIGINT) AS previous_total, CAST(NULL AS VARCHAR) AS reason,
         captured_at AS newest, [{'at': captured_at, 'total': turnover_total}] AS kept
  FROM arrivals WHERE n = 1
  UNION ALL
  SELECT trade_date, captured_at, turnover_total, quote_count, n, CASE WHEN NOT late THEN past END,
         CASE WHEN late THEN 'late' WHEN fell THEN 'fell' END, greatest(newest, captured_at),
         CASE WHEN late OR fell THEN kept ELSE list_append(kept, {'at': captured_at, 'total': turnover_total}) END
  FROM (SELECT *, captured_at < newest - INTERVAL 120 MINUTE AS late, coalesce(past > 0 AND turnover_total * 10 < past * 9, false) AS fell
        FROM (SELECT a.*, f.newest, f.kept, list_sort(list_filter(f.kept, lambda x: x.at < a.captured_at))[-1].total AS past
              FROM fold f JOIN arrivals a ON a.trade_date = f.trade_date AND a.n = f.n + 1)))
SELECT trade_date, captured_at, turnover_total, quote_count, previous_total, reason IS NULL AS accepted, reason FROM fold"""


@query("stream_late_rounds", LATE)
def stream_late_rounds(spark, sf):
    """Late rounds find the accepted round before them; those more than two hours late are rejected."""
    out = scratch_path(spark, "late")
    source = land_in_order(shuffled_rounds(spark, sf), "shuffled")
    judged = st.gate(st.read_files(spark, st.ROUND_ROW, source, FILES_PER_TRIGGER), lateness_minutes=120)
    run(judged.writeStream.foreachBatch(st.by_batch(out)), "late", spark)
    return spark.read.parquet(out).drop("batch_id")


ALL_ARRIVALS = LATE.replace("FROM hours)", "FROM hours WHERE h % 11 <> 4)", 1) + """
UNION ALL SELECT trade_date, captured_at, turnover_total, quote_count, NULL, false, 'expired' FROM hours WHERE h % 11 = 4"""


@query("stream_gate_rejects", ALL_ARRIVALS)
def stream_gate_rejects(spark, sf):
    """Every arrival once: judged, or rejected when it comes more than a day after its capture, here two days later."""
    rounds = shuffled_rounds(spark, sf)
    old = F.floor(F.unix_seconds(F.col("captured_at").cast("timestamp")) / 3600) % 11 == 4
    rounds = rounds.withColumn("arrival", F.when(old, F.unix_seconds(F.col("captured_at").cast("timestamp")) + 2 * 86400).otherwise(F.col("arrival")))
    out = scratch_path(spark, "gate-rejects")
    judged = co.gate_with_rejects(st.read_files(spark, st.ROUND_ROW, land_in_order(rounds, "two-days"), FILES_PER_TRIGGER), lateness_minutes=120)
    run(judged.writeStream.foreachBatch(st.by_batch(out)), "gate-rejects", spark)
    return spark.read.parquet(out).drop("batch_id")


@query("stream_price_profile", FEED + """
SELECT price_source, count(*) AS quotes, count(*) FILTER (WHERE p4 IS NULL AND lots > 0) AS priceless_with_volume
FROM feed GROUP BY 1""")
def stream_price_profile(spark, sf):
    """The feed's price sources, counted by the stream itself while its quotes are written."""
    messages = landed.messages(spark, sf)
    source, out, counted = land(messages, "messages"), scratch_path(spark, "quotes"), scratch_path(spark, "counted")
    stream = st.read_files(spark, messages.schema, source, FILES_PER_TRIGGER)
    quotes = hl.profiled(it.quotes_of_items(it.message_items(stream), d.KEY_CODES))
    hl.run_counted(spark, quotes.writeStream.foreachBatch(st.by_batch(out)), "profile", scratch_path(spark, "profile-checkpoint"), counted)
    return hl.price_source_totals(hl.read_counters(spark, counted))


@query("stream_health", "WITH " + b.INTRADAY + """,
old AS (
  SELECT * FROM rounds WHERE CAST(epoch(captured_at) AS BIGINT) // 3600 % 5 = 2
                         AND captured_at < (SELECT max(captured_at) FROM rounds) - INTERVAL 10 DAY)
SELECT 'engine' AS label, 'input_rows' AS field, (SELECT count(*) FROM rounds) + (SELECT count(*) FROM old) AS value
UNION ALL SELECT 'engine', 'dropped_by_watermark', count(*) FROM old
UNION ALL SELECT 'rounds', 'given', count(*) FROM rounds
UNION ALL SELECT 'rounds', 'empty', count(*) FROM rounds WHERE turnover_total = 0
UNION ALL SELECT 'rounds', 'turnover', CAST(sum(turnover_total) AS BIGINT) FROM rounds""")
def stream_health(spark, sf):
    """Rounds as they come, then, after a restart, every fifth hour's rounds once more, ten days too late: the engine drops those, visibly."""
    totals = materialize(d.round_totals(spark, sf).withColumn("source", F.lit("collector")), "health-rounds")
    source, out, counted = land_by_time(totals, "captured_at", "health"), scratch_path(spark, "health-out"), scratch_path(spark, "counted")
    checkpoint = scratch_path(spark, "health-checkpoint")

    def go():
        stream = st.read_files(spark, totals.schema, source, FILES_PER_TRIGGER)
        unique = st.dedupe(stream, ("trade_date", "captured_at", "source"), delay="2 days")
        counted_rows = hl.observed(
            unique, "rounds", given=F.count(F.lit(1)), empty=F.count_if(F.col("turnover_total") == 0), turnover=F.sum("turnover_total")
        )
        hl.run_counted(spark, counted_rows.writeStream.foreachBatch(st.by_batch(out)), "health", checkpoint, counted)

    go()
    newest = totals.agg(F.max("captured_at").alias("newest"))
    hour = F.floor(F.unix_seconds(F.col("captured_at").cast("timestamp")) / 3600)
    old = totals.join(F.broadcast(newest)).where((hour % 5 == 2) & (F.col("captured_at") < F.col("newest") - F.expr("INTERVAL 10 DAYS")))
    old.select(*totals.columns).write.mode("append").parquet(source)
    go()
    return hl.totals(hl.read_counters(spark, counted))
