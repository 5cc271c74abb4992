"""As-of lookup of many requests at once: for each, the last value known at its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def asof_join(
    requests: DataFrame,
    history: DataFrame,
    keys: tuple[str, ...],
    at: str,
    values: tuple[str, ...],
    span: Column,
    usable: Column | None = None,
    strictly: bool = False,
) -> DataFrame:
    """Add to each request the ``values`` of the newest usable history row of its ``keys`` at or before its time.

    ``at`` names the time in both tables, ``strictly`` leaves out rows of the very
    same time.  Requests and history of a key are read in one ordered pass, not
    matched in pairs.  ``span`` is an expression of ``at`` that grows with it (a
    month, a year): a key's rows are sorted span by span in different tasks, and
    the last value of each span, found by an aggregate that combines before its
    shuffle, is carried into the spans after it.  So a key may hold any share of
    the rows.

    Every request row stays, repeated ones too, with nulls where nothing is known
    or where its time is null; null keys equal each other.  Of history rows with
    the same time the one with the largest values counts.  Request columns with
    the name of a value are replaced.
    """
    kept = [c for c in requests.columns if c not in values]
    known = history.where(F.col(at).isNotNull())
    known = known if usable is None else known.where(usable)
    known = known.select(*keys, at, F.struct(*values).alias("_value")).withColumn("_span", span)
    asked = requests.select(*keys, at, F.struct(*kept).alias("_request")).withColumn("_span", span)

    # Requests come after values of the same time, or before them.
    tagged = known.withColumn("_turn", F.lit(1)).unionByName(
        asked.withColumn("_turn", F.lit(0 if strictly else 2)), allowMissingColumns=True
    )
    in_span = W.partitionBy(*keys, "_span").orderBy(at, "_turn", "_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = tagged.withColumn("_local", F.last("_value", ignorenulls=True).over(in_span)).where("_request IS NOT NULL")

    # One row per key and span: bounded by the calendar.
    marks = known.groupBy(*keys, "_span").agg(F.max(F.struct(at, "_value"))["_value"].alias("_last"))
    marks = marks.unionByName(asked.select(*keys, "_span").distinct(), allowMissingColumns=True)
    marks = marks.groupBy(*keys, "_span").agg(F.max("_last").alias("_last"))
    earlier = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).select(
        *[F.col(c).alias(f"_k_{c}") for c in (*keys, "_span")], "_carried"
    )

    same = F.lit(True)
    for c in (*keys, "_span"):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    value = F.when(F.col(at).isNotNull(), F.coalesce("_local", "_carried"))
    joined = local.join(carried, same).select("_request", value.alias("_found"))
    return joined.select("_request.*", *[F.col("_found")[v].alias(v) for v in values])
