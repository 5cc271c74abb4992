"""A collector's responses as rounds: parts put together, broken and late ones set aside, slots without a round reported.

Event time is the time of arrival, not that of capture, so the engine's
watermark never drops a late response: it reaches the state functions here, and
each arrival leaves them exactly once, in a round or among the rejects.  What
counts as late follows from the times in the rows, so results do not depend on
how a history is cut into micro-batches.

* ``assemble`` is keyed by round.  A round is complete when all its parts are
  there; its trade date is the newest of all its responses.  It fails when a part
  cannot be read, when no part has a date, or when the interval ends first.  Its
  state goes a day after capture; later arrivals are rejected as expired.
* ``missing_slots`` is keyed by session and sees one row per round.  When the
  session is over it reports the slots of the two-minute grid that no round took.
* ``gate_with_rejects`` judges rounds like the gate, and rejects what comes more
  than a day after its capture instead of leaving it to the engine.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnbook.functions import measures as m
from turnbook.functions.parsing import COMMON_STOCK_PATTERN, compact_date
from turnbook.operators import intraday as it
from turnbook.schemas import INTRADAY_MESSAGE
from turnbook.streaming.rounds import GATE_STATE, ROUND_ROW, VERDICT, VERDICT_COLUMNS, judge_one

# The collection grid in minutes of the Taipei day; a round has as long as the interval.
SESSION_START = 7 * 60
SESSION_END = 13 * 60 + 35
INTERVAL_MINUTES = 2
SLOTS = range(SESSION_START, SESSION_END, INTERVAL_MINUTES)
MINUTE_US = 60 * 1_000_000
INTERVAL_US = INTERVAL_MINUTES * MINUTE_US
DAY_US = 24 * 60 * MINUTE_US
# Slots are reported this long after the end of the session.
GRACE_US = 10 * MINUTE_US
TAIPEI_US = 8 * 60 * MINUTE_US
ARRIVAL_DELAY = "1 minute"

#: A landed response.  A row without part is a tick of the clock: it says that a session was due.
RESPONSE = "captured_at timestamp_ntz, source string, part int, parts int, arrival timestamp_ntz, body string"
BODY = "struct<msgArray:" + INTRADAY_MESSAGE.split("msgArray ", 1)[1] + ",_broken:string>"
ARRIVED = "captured_at timestamp_ntz, source string, part int, parts int, arrival timestamp_ntz, body string, readable boolean, response_date date"
OPEN_ROUND = "status string, first bigint, parts int, numbers array<int>, dates array<string>, bodies array<string>"
#: kind: round (one per round, with its status), part (of a complete round), reject (one per arrival that is in none).
TAGGED = "kind string, captured_at timestamp_ntz, source string, part int, parts int, status string, trade_date string, body string, closed_at timestamp_ntz"
TAGGED_COLUMNS = [c.split()[0] for c in TAGGED.split(", ")]


def _us(at: pd.Timestamp) -> int:
    return int(at.value // 1000)


def _time(us: int) -> pd.Timestamp:
    return pd.Timestamp(us * 1000)


def arrivals(responses: DataFrame) -> DataFrame:
    """Responses with whether they can be read, and the newest date of their entries."""
    parsed = F.from_json("body", BODY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    opened = responses.withColumn("_body", parsed)
    newest = F.array_max(F.transform("_body.msgArray", lambda x: compact_date(x["d"])))
    readable = F.col("part").isNull() | (F.col("_body").isNotNull() & F.col("_body._broken").isNull() & F.col("body").isNotNull())
    return opened.select(*responses.columns, readable.alias("readable"), newest.alias("response_date"))


def _assemble(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    warnings.simplefilter("ignore", FutureWarning)
    captured, source = key
    captured_us, out = _us(captured), []
    held: dict[int, tuple[str, str]] = {}
    status, first, parts = "new", 0, 0
    if state.exists:
        status, first, parts, numbers, dates, bodies = state.get
        held = {n: (d, b) for n, d, b in zip(numbers, dates, bodies)}

    def emit(kind, part, reason, body="", date="", closed=0):
        out.append((kind, captured, source, part, parts, reason, date, body, _time(closed)))

    def close(result: str, at: int, date: str = "") -> None:
        nonlocal status, held
        for number, (_, body) in sorted(held.items()):
            emit("part" if result == "ok" else "reject", number, "ok" if result == "ok" else "round_failed", body, date, at)
        emit("round", -1, result, date=date, closed=at)
        status, held = "closed", {}

    if state.hasTimedOut:
        if status == "open":
            close("incomplete", first + INTERVAL_US)
    else:
        rows = pd.concat(list(frames)).sort_values(["arrival", "part"], kind="stable")
        for r in rows.itertuples(index=False):
            at = _us(r.arrival)
            if pd.isna(r.part):
                emit("round", -1, "tick", closed=at)
                continue
            if at > captured_us + DAY_US:
                emit("reject", int(r.part), "expired", r.body or "", closed=at)
                continue
            if status == "open" and at > first + INTERVAL_US:
                close("incomplete", first + INTERVAL_US)
            if status == "closed":
                emit("reject", int(r.part), "after_round", r.body or "", closed=at)
                continue
            if status == "new":
                status, first, parts = "open", at, int(r.parts)
            number = int(r.part)
            if number in held:
                # Sent again: the newer one counts.
                emit("reject", number, "replaced", held[number][1], closed=at)
            date = "broken" if not r.readable else "" if pd.isna(r.response_date) else str(r.response_date)
            held[number] = (date, r.body or "")
            if len(held) == parts:
                newest = max(d for d, _ in held.values())
                broken = any(d == "broken" for d, _ in held.values())
                close("unreadable" if broken else "ok" if newest else "undated", at, "" if broken else newest)
    due = first + INTERVAL_US if status == "open" else captured_us + DAY_US
    if status == "new" or (state.hasTimedOut and state.getCurrentWatermarkMs() * 1000 >= captured_us + DAY_US):
        # Nothing but ticks or expired arrivals, or a round whose day is over.
        if state.exists:
            state.remove()
    else:
        kept = sorted(held)
        state.update((status, first, parts, kept, [held[n][0] for n in kept], [held[n][1] for n in kept]))
        state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=TAGGED_COLUMNS)


def assemble(responses: DataFrame) -> DataFrame:
    """Tagged rows of rounds, parts and rejects (``TAGGED``), in append mode; write them with one sink by ``kind``."""
    timed = arrivals(responses).withColumn("event_time", F.col("arrival").cast("timestamp")).withWatermark("event_time", ARRIVAL_DELAY)
    tagged = timed.groupBy("captured_at", "source").applyInPandasWithState(
        _assemble, TAGGED, OPEN_ROUND, "append", GroupStateTimeout.EventTimeTimeout
    )
    return tagged.withColumns({
        "part": F.when(F.col("part") >= 0, F.col("part")),
        "trade_date": F.try_to_date("trade_date"),
        "body": F.when(F.col("kind") != "round", F.col("body")),
    })


def read_kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a kind from a sink by batch."""
    return spark.read.schema(TAGGED.replace("trade_date string", "trade_date date") + ", batch_id bigint").parquet(path).where(F.col("kind") == kind).drop("kind", "batch_id")


def entries(parts: DataFrame) -> DataFrame:
    """Entries of the parts of current rounds; the round's trade date replaces that of each entry."""
    current = parts.where(it.is_current(F.col("trade_date"), F.col("captured_at")))
    opened = current.withColumn("_body", F.from_json("body", BODY))
    items = opened.select("captured_at", "source", "part", "trade_date", F.explode("_body.msgArray").alias("i"))
    stamped = F.col("i").withField("d", F.date_format("trade_date", "yyyyMMdd"))
    return items.withColumn("i", stamped).select("captured_at", "source", "part", "i.*")


def quotes(parts: DataFrame, codes: str = COMMON_STOCK_PATTERN) -> DataFrame:
    """Quotes of complete rounds, under the trade date of their round."""
    return it.quotes_of_items(entries(parts), codes).withColumnRenamed("quote_date", "trade_date")


def round_indices(parts: DataFrame) -> DataFrame:
    """One index row per market and complete round: that of the last response that has one."""
    found = it.index_entries(entries(parts))
    last = found.groupBy("captured_at", "source", "market").agg(F.max_by(F.struct("value", "y"), F.struct("part", "value", "y")).alias("v"))
    change = m.percent_change(F.col("v.value"), F.col("v.y")).cast("decimal(12,2)")
    return last.select("captured_at", "source", "market", F.col("v.value").cast("decimal(14,4)").alias("value"), change.alias("change_percent"))


# --- the clock ----------------------------------------------------------------

SLOT_ROW = "session_date date, slot int, status string"


def session_of(captured_at: Column) -> Column:
    return F.to_date(m.taipei(captured_at))


def _report_slots(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    warnings.simplefilter("ignore", FutureWarning)
    (session,) = key
    end = _us(pd.Timestamp(session)) - TAIPEI_US + SESSION_END * MINUTE_US + GRACE_US
    taken = set(state.get[0]) if state.exists else set()
    if state.hasTimedOut:
        missing = [s for s in SLOTS if s not in taken]
        state.remove()
        yield pd.DataFrame({"session_date": [session] * len(missing), "slot": missing, "status": ["missing"] * len(missing)})
        return
    out = []
    for r in pd.concat(list(frames)).itertuples(index=False):
        if r.status == "tick":
            continue
        minute = int((_us(r.captured_at) + TAIPEI_US) // MINUTE_US % (24 * 60))
        out.append((session, minute, r.status))
        if _us(r.closed_at) <= end:
            taken.add(minute)
    if state.getCurrentWatermarkMs() * 1000 <= end:
        state.update((sorted(taken),))
        state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=["session_date", "slot", "status"])


def missing_slots(rounds: DataFrame) -> DataFrame:
    """session_date, slot (minute of the Taipei day), status: every round, and every slot of the session that no round took in time."""
    timed = rounds.withColumn("event_time", F.col("closed_at").cast("timestamp")).withWatermark("event_time", "1 day")
    keyed = timed.select(session_of(F.col("captured_at")).alias("session_date"), "captured_at", "status", "closed_at", "event_time")
    return keyed.groupBy("session_date").applyInPandasWithState(
        _report_slots, SLOT_ROW, "taken array<int>", "append", GroupStateTimeout.EventTimeTimeout
    )


# --- the gate -----------------------------------------------------------------


def _judge_or_reject(lateness_us: int):
    def judge(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warnings.simplefilter("ignore", FutureWarning)
        if state.hasTimedOut:
            state.remove()
            return
        newest, times, totals = state.get if state.exists else (None, (), ())
        accepted, out = dict(zip(times, totals)), []
        for row in pd.concat(list(frames)).sort_values("arrival", kind="stable").itertuples(index=False):
            if int(row.arrival) * 1_000_000 > _us(row.captured_at) + DAY_US:
                out.append((row.trade_date, row.captured_at, int(row.turnover_total), int(row.quote_count), -1, False, "expired"))
                continue
            verdict, newest = judge_one(row, accepted, newest, lateness_us)
            out.append(verdict)
        if newest is not None:
            kept = sorted(accepted)
            state.update((newest, kept, [accepted[t] for t in kept]))
            # The last capture of a trade date is less than two days after its first moment, so nothing unexpired comes after three.
            gone = _us(pd.Timestamp(key[0])) // 1000 + 3 * DAY_US // 1000
            state.setTimeoutTimestamp(max(gone, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=VERDICT_COLUMNS)

    return judge


def gate_with_rejects(rounds: DataFrame, lateness_minutes: int) -> DataFrame:
    """Every arrival once: judged by the gate, or with the reason expired when it comes more than a day after its capture.

    ``rounds`` are rows of ``ROUND_ROW``; ``arrival`` is in seconds.
    """
    judged = (
        rounds.withColumn("event_time", F.timestamp_seconds("arrival"))
        .withWatermark("event_time", ARRIVAL_DELAY)
        .groupBy("trade_date")
        .applyInPandasWithState(
            _judge_or_reject(lateness_minutes * MINUTE_US), VERDICT, GATE_STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )
    # The state function has no nulls to give: totals are never negative.
    return judged.withColumn("previous_total", F.when(F.col("previous_total") >= 0, F.col("previous_total"))).withColumn(
        "reason", F.when(F.col("reason") != "", F.col("reason"))
    )
