"""Intraday rounds: price resolution, monotonic gate, curves, rankings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnbook.functions import measures as m, parsing as p
from turnbook.operators.ranking import ACCELERATION, ALL_MARKETS, HEAT
from turnbook.operators.ranks import with_positions

# Shares per lot; a round may fall to nine tenths of the last accepted one.
SHARES_PER_LOT = 1000
GATE_TENTHS = 9

# Index channels of the feed (exchange, code) per market.
TWSE_INDEX = ("tse", "t00")
TPEX_INDEX = ("otc", "o00")

ROUND = ["trade_date", "captured_at"]


def message_items(messages: DataFrame) -> DataFrame:
    """One row per entry of a feed response."""
    return messages.select("captured_at", "source", F.explode("msgArray").alias("i")).select(
        "captured_at", "source", "i.*"
    )


def _mid(a: Column, b: Column) -> Column:
    return m.half_even((a + b) / 2, 4).cast(p.NUMBER)


#: What ``resolve_price`` may name, best first.
PRICE_SOURCES = ("last_trade", "previous_trade", "bid_ask_mid", "high_low_mid", "open", "previous_close", "none")


def resolve_price(z, pz, ask, bid, high, low, open_, previous) -> tuple[Column, Column]:
    """Price and the name of the field it came from, best source first."""
    last, before = p.number(z), p.number(pz)
    a, b = p.best_level(ask), p.best_level(bid)
    h, l = p.number(high), p.number(low)
    o, y = p.number(open_), p.number(previous)
    book = F.coalesce(_mid(b, a), b, a)
    price = F.coalesce(last, before, book, _mid(h, l), o, y)
    source = (
        F.when(last.isNotNull(), "last_trade")
        .when(before.isNotNull(), "previous_trade")
        .when(a.isNotNull() | b.isNotNull(), "bid_ask_mid")
        .when(h.isNotNull() & l.isNotNull(), "high_low_mid")
        .when(o.isNotNull(), "open")
        .when(y.isNotNull(), "previous_close")
        .otherwise("none")
    )
    return price.cast("decimal(18,4)"), source


def estimated_turnover(price: Column, volume: Column) -> Column:
    """Price times cumulative shares, whole units; zero without a price."""
    return F.coalesce(m.half_even(price * volume, 0), F.lit(0)).cast("bigint")


def quotes_of_items(items: DataFrame, codes: str = p.COMMON_STOCK_PATTERN) -> DataFrame:
    """Typed quotes of the feed entries with a wanted code, by default the common shares."""
    price, source = resolve_price(*[F.col(c) for c in ("z", "pz", "a", "b", "h", "l", "o", "y")])
    return (
        items.where(p.is_code(F.col("c"), codes))
        .withColumn("price", price)
        .withColumn("price_source", source)
        .withColumn("trading_volume", (p.number_or_zero(F.col("v")) * SHARES_PER_LOT).cast("bigint"))
        .select(
            "captured_at",
            "source",
            p.compact_date(F.col("d")).alias("quote_date"),
            F.when(F.col("ex") == "otc", "TPEX").otherwise("TWSE").alias("market"),
            F.col("c").alias("ticker"),
            F.coalesce(F.trim("n"), F.col("c")).alias("name"),
            "price",
            "price_source",
            p.number(F.col("o")).cast("decimal(18,4)").alias("open_price"),
            p.number(F.col("h")).cast("decimal(18,4)").alias("high_price"),
            p.number(F.col("l")).cast("decimal(18,4)").alias("low_price"),
            "trading_volume",
            estimated_turnover(F.col("price"), F.col("trading_volume")).alias("turnover"),
            m.percent_change(F.col("price"), p.number(F.col("y"))).cast("decimal(12,2)").alias("change_percent"),
        )
    )


def index_market(code: Column, exchange: Column) -> Column:
    """Market of an index channel; null for shares."""
    code, exchange = F.lower(F.trim(code)), F.lower(F.trim(exchange))
    return F.when((exchange == TWSE_INDEX[0]) & (code == TWSE_INDEX[1]), "TWSE").when(
        (exchange == TPEX_INDEX[0]) & (code == TPEX_INDEX[1]), "TPEX"
    )


def index_entries(items: DataFrame) -> DataFrame:
    """Index entries of the parts of rounds: market, value and previous close."""
    previous = p.number(F.col("y"))
    value = F.coalesce(p.number(F.col("z")), p.number(F.col("pz")), previous)
    rows = items.select("captured_at", "source", "part", index_market(F.col("c"), F.col("ex")).alias("market"), value.alias("value"), previous.alias("y"))
    return rows.where(F.col("market").isNotNull() & F.col("value").isNotNull())


def indices_of_items(items: DataFrame) -> DataFrame:
    """Index entries; several responses of a round may repeat one, the last by value order wins."""
    market = index_market(F.col("c"), F.col("ex"))
    previous = p.number(F.col("y"))
    value = F.coalesce(p.number(F.col("z")), p.number(F.col("pz")), previous)
    return (
        items.select("captured_at", "source", market.alias("market"), value.alias("value"), previous.alias("y"))
        .where(F.col("market").isNotNull() & F.col("value").isNotNull())
        .groupBy("captured_at", "source", "market")
        .agg(F.max(F.struct("value", "y")).alias("v"))
        .select(
            "captured_at",
            "source",
            "market",
            F.col("v.value").cast("decimal(14,4)").alias("value"),
            m.percent_change(F.col("v.value"), F.col("v.y")).cast("decimal(12,2)").alias("change_percent"),
        )
    )


def trade_dates(items: DataFrame) -> DataFrame:
    """Trade date of each round: the newest date any entry reports."""
    return items.groupBy("captured_at", "source").agg(F.max(p.compact_date(F.col("d"))).alias("trade_date"))


def is_current(trade_date: Column, captured_at: Column) -> Column:
    """A round counts only on the Taipei day it was collected."""
    return trade_date == F.to_date(m.taipei(captured_at))


def price_source_profile(quotes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Quotes per price source, and those with volume but no price."""
    return quotes.groupBy(*keys, "price_source").agg(
        F.count(F.lit(1)).alias("quotes"),
        F.count_if(F.col("price").isNull() & (F.col("trading_volume") > 0)).alias("priceless_with_volume"),
    )


def round_totals(quotes: DataFrame) -> DataFrame:
    """Turnover and quote count of each round."""
    return quotes.groupBy(*ROUND).agg(
        F.coalesce(F.sum("turnover"), F.lit(0)).alias("turnover_total"), F.count(F.lit(1)).alias("quote_count")
    )


def falls_back(total: Column, accepted: Column) -> Column:
    """Total dropped by more than a tenth below the accepted one."""
    wide = "decimal(28,0)"
    return F.coalesce(
        (accepted > 0) & (total.cast(wide) * 10 < accepted.cast(wide) * GATE_TENTHS), F.lit(False)
    )


def judge_rounds(totals: DataFrame) -> DataFrame:
    """Add ``accepted`` and ``previous_total`` (last accepted total of the day before the round).

    Whether a round counts depends on the rounds accepted before it, so each day is
    folded in order.  Rounds sit on a two-minute grid: at most 720 a day.
    """
    packed = totals.groupBy("trade_date").agg(
        F.sort_array(F.collect_list(F.struct("captured_at", "turnover_total", "quote_count"))).alias("rounds")
    )
    verdict = (
        "array<struct<captured_at:timestamp_ntz,turnover_total:bigint,quote_count:bigint,"
        "previous_total:bigint,accepted:boolean>>"
    )
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast(verdict).alias("out"))

    def step(state, r):
        ok = ~falls_back(r["turnover_total"], state["last"])
        judged = F.struct(
            r["captured_at"].alias("captured_at"),
            r["turnover_total"].alias("turnover_total"),
            r["quote_count"].alias("quote_count"),
            state["last"].alias("previous_total"),
            ok.alias("accepted"),
        )
        return F.struct(
            F.when(ok, r["turnover_total"]).otherwise(state["last"]).alias("last"),
            F.concat(state["out"], F.array(judged)).cast(verdict).alias("out"),
        )

    return packed.select("trade_date", F.inline(F.aggregate("rounds", start, step, lambda s: s["out"])))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest round; one row."""
    return runs.orderBy(F.desc("trade_date"), F.desc("captured_at")).limit(1)


def latest_view(quotes: DataFrame, runs: DataFrame, securities: DataFrame) -> DataFrame:
    """Quotes of the newest round with the round's index fields and the security's name."""
    newest = latest_run(runs)
    return quotes.join(F.broadcast(newest), ROUND).join(securities.select("ticker", "name", "market"), "ticker")


def latest_before(runs: DataFrame) -> DataFrame:
    """Each round with the total of the previous round of its day."""
    w = W.partitionBy("trade_date").orderBy("captured_at")
    return runs.withColumn("previous_total", F.lag("turnover_total").over(w))


def retain_current_session(runs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Drop rounds strictly older than the newest accepted trade date."""
    newest = accepted.agg(F.max("trade_date")).scalar()
    return runs.withColumn("_newest", newest).where(F.col("trade_date") >= F.col("_newest")).drop("_newest")


def curve_ratio(curve: DataFrame) -> DataFrame:
    """Share of the day's highest total reached in each round."""
    top = F.max("turnover_total").over(W.partitionBy("trade_date"))
    return curve.withColumn(
        "ratio", F.try_divide(F.col("turnover_total").cast("double"), top.cast("double"))
    )


def curve_profile(curve: DataFrame, slot_minutes: int = 2) -> DataFrame:
    """Average ratio per Taipei slot beside the linear share of elapsed time."""
    slotted = curve_ratio(curve).withColumn("slot", m.slot_of(m.taipei(F.col("captured_at")), slot_minutes))
    return (
        slotted.groupBy("slot")
        .agg(F.avg("ratio").alias("volume_ratio"), F.count(F.lit(1)).alias("points"))
        .withColumn("time_ratio", m.progress_at_minute(F.col("slot")))
        .withColumn("gap", F.col("volume_ratio") - F.col("time_ratio"))
    )


def session_outcomes(rounds: DataFrame) -> DataFrame:
    """Rounds per status and the verdict of each session.

    ``rounds``: session_date and a status of written, stale, failed or rejected.
    """
    counted = rounds.groupBy("session_date").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("written", "stale", "failed", "rejected")]
    )
    return counted.withColumn(
        "verdict",
        F.when((F.col("written") > 0) & (F.col("rejected") > 0), "partial")
        .when(F.col("written") > 0, "ok")
        .when((F.col("failed") > 0) | (F.col("rejected") > 0), "failed")
        .otherwise("closed_market"),
    )


def with_reference(rows: DataFrame, reference: DataFrame, reference_date: dt.date) -> DataFrame:
    """Share of the round, change against the reference period, week change.

    ``rows``: ticker, name, market, price, turnover, change_percent, trade_date, captured_at of one round.
    ``reference``: ticker, average_value, share, share_change, end_close, week_baseline.
    """
    total = rows.agg(F.sum("turnover").cast("decimal(38,0)")).scalar()
    past = reference.select(
        "ticker",
        F.col("average_value").alias("past_value"),
        F.col("share").alias("past_share"),
        F.col("share_change").alias("past_share_change"),
        F.col("end_close").alias("past_close"),
        F.col("week_baseline").alias("past_week_baseline"),
    )
    same_week = m.week_start(F.col("trade_date")) == m.week_start(F.lit(reference_date))
    baseline = F.when(same_week, F.col("past_week_baseline")).otherwise(F.col("past_close"))
    progress = m.session_progress(F.col("captured_at"))
    return (
        rows.withColumn("market_total", total)
        .join(past, "ticker", "left")
        .withColumn(
            "share", F.when(F.col("market_total") > 0, F.col("turnover").cast("double") / F.col("market_total").cast("double"))
        )
        .withColumn("share_change", F.col("share") - F.col("past_share"))
        .withColumn("weekly_price_change", m.price_growth(F.col("price"), baseline))
        .withColumn("progress", progress)
        .withColumn("projected", m.projected_close(F.col("turnover"), F.col("progress")))
    )


def ranking(
    rows: DataFrame,
    reference: DataFrame,
    reference_date: dt.date,
    mode: str = HEAT,
    market: str = ALL_MARKETS,
    top: int | None = 100,
) -> DataFrame:
    """Rank one round by turnover or share change; previous rank by the reference period."""
    return ranking_of_measured(with_reference(rows, reference, reference_date), reference, mode, market, top)


def ranking_of_measured(
    measured: DataFrame, reference: DataFrame, mode: str = HEAT, market: str = ALL_MARKETS, top: int | None = 100
) -> DataFrame:
    """The ranking of a round that ``with_reference`` has already measured."""
    chosen = measured if market == ALL_MARKETS else measured.where(F.col("market") == market)
    key, past_key = ("share_change", "past_share_change") if mode == ACCELERATION else ("turnover", "past_value")
    if mode == ACCELERATION:
        # Without any reference there is nothing to accelerate against.
        chosen = chosen.withColumn("_known", reference.limit(1).agg(F.count(F.lit(1))).scalar()).where("_known > 0").drop("_known")
    placed = with_positions(chosen, {"rank": key, "_previous": past_key})
    result = (
        placed.withColumn("previous_rank", F.when(F.col(past_key).isNotNull(), F.col("_previous")))
        .withColumn("rank_change", F.col("previous_rank") - F.col("rank"))
        .drop("_previous")
    )
    return result if top is None else result.where(F.col("rank") <= top)
