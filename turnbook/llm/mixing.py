"""Mixing sources to target weights by entropy balancing.

The mix should take, from each source, its share of all words.  Among all
document rates that meet these token constraints the ones nearest to 1 in
relative entropy, with none above three, are ``min(3, exp(lambda_s * size))``:
exponentially tilted by the constraint's own coefficient.  The dual is convex
and has one variable per source; each Newton step aggregates the table of
distinct (source, size) cells on the cluster and moves all variables at once.

Rates are then rounded into copies from the longest to the shortest cell: each
takes the nearest number of copies to its own tokens and the remainder of the
cells before, within one or two copies of its rate, so a source ends within
half of a short document of its target.  Which documents of a cell get one
more follows from a hash of their id.

Bounds: the driver holds one row per source (the constraints).  A cell is a
distinct size, so a source has no more cells than its longest document has
words, however many rows it has.

Defined cases: null source is a source of its own, the last; null texts have
size 0 and are taken once where their source's rate is at least one half, as
are other texts without words; rows that repeat are taken one by one; further
columns are carried along.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, functions as F

from turnbook.llm.spread import positions
from turnbook.llm.text import word_count
from turnbook.llm.stored import materialize

#: No document is taken more often.
MOST_COPIES = 3
#: Sources in code point order, null last, weigh so much, repeating.
WEIGHTS = (1, 2, 3)
STEPS = 60
CLOSE = 1e-9


def targets(sizes: list[int], weights: list[float], most: float = MOST_COPIES) -> list[float]:
    """Shares of the sum of sizes by weight; what exceeds ``most`` times a size goes to the others by weight."""
    left, goal = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if weights[i] > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                goal[i] = unit * weights[i]
            break
        for i in full:
            goal[i] = float(most * sizes[i])
            left -= goal[i]
        open_ = [i for i in open_ if i not in set(full)]
    return goal


def cell_table(rows: DataFrame) -> DataFrame:
    """(source, size, n) of a table with source and size."""
    return rows.groupBy("source", "size").agg(F.count("*").alias("n"))


def source_table(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> pd.DataFrame:
    """One row per source: source, source_size, scale (mean squared size over mean size), target."""
    per = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.col("size") * F.col("size") * F.col("n")).cast("double").alias("squares"))
    rows = sorted((r.asDict() for r in per.collect()), key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    table = pd.DataFrame(rows, columns=["source", "source_size", "squares"])
    table["target"] = targets(table["source_size"].tolist(), [weights[i % len(weights)] for i in range(len(table))])
    table["scale"] = (table["squares"] / table["source_size"].clip(lower=1)).clip(lower=1.0)
    return table


def solve_dual(cells: DataFrame, sources: pd.DataFrame) -> np.ndarray:
    """Tilt per source, so that sum(n * size * min(3, exp(tilt * size / scale))) is its target.

    Newton steps are kept inside the bracket that earlier steps have proven; a
    source at its cap has an infinite tilt.
    """
    spark = cells.sparkSession
    size, goal = sources["source_size"].to_numpy(float), sources["target"].to_numpy(float)
    capped = goal >= MOST_COPIES * size * (1 - 1e-12)
    tilt = np.where(capped, np.inf, 0.0)
    low, high = np.full(len(tilt), -np.inf), np.full(len(tilt), np.inf)
    for _ in range(STEPS):
        now = pd.DataFrame({"number": np.arange(len(tilt)), "tilt": np.where(np.isfinite(tilt), tilt, 0.0)})
        # One row per constraint.
        at = F.broadcast(spark.createDataFrame(now, "number bigint, tilt double"))
        power = F.col("tilt") * F.col("size") / F.col("scale")
        free = power < math.log(MOST_COPIES)
        rate = F.when(free, F.exp(F.least(power, F.lit(math.log(MOST_COPIES))))).otherwise(F.lit(float(MOST_COPIES)))
        tokens = F.col("n") * F.col("size")
        sums = cells.join(at, "number").groupBy("number").agg(
            F.sum(tokens * rate).alias("taken"),
            F.sum(F.when(free, tokens * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
        )
        got = {r["number"]: (r["taken"], r["slope"]) for r in sums.collect()}
        moved = False
        for i in range(len(tilt)):
            if capped[i]:
                continue
            taken, slope = got[i]
            miss = goal[i] - taken
            if abs(miss) <= CLOSE * max(1.0, goal[i]):
                continue
            moved = True
            if miss > 0:
                low[i] = tilt[i]
            else:
                high[i] = tilt[i]
            step = tilt[i] + miss / slope if slope > 0 else np.inf
            if not low[i] < step < high[i] or abs(step - tilt[i]) > 4:
                if np.isfinite(low[i]) and np.isfinite(high[i]):
                    step = (low[i] + high[i]) / 2
                else:
                    step = tilt[i] + math.copysign(max(1.0, abs(tilt[i])), miss)
            tilt[i] = step
        if not moved:
            break
    return tilt


def _rounded(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of each cell of one source: base for every document, one more for ``extra`` of them.

    What a cell's whole copies leave of its tokens goes on to the next shorter cell.
    """
    cells = cells.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
    base, extra, carry = [], [], 0.0
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist()):
        whole = math.floor(rate + 1e-12)
        if size == 0:
            total = n * min(MOST_COPIES, math.floor(rate + 0.5))
        else:
            carry += n * rate * size
            least, most = n * max(0, whole - 1), n * min(MOST_COPIES, whole + 2)
            total = min(most, max(least, math.floor(carry / size + 0.5)))
            carry -= total * size
        base.append(total // n)
        extra.append(total % n)
    return cells.assign(base=base, extra=extra)[["source", "size", "n", "base", "extra", "source_size", "target"]]


def copies(rows: DataFrame, tie: str) -> DataFrame:
    """``rows`` (with source, size and a column ``tie`` that names a row) with copies, source_size and target."""
    spark = rows.sparkSession
    cells = materialize(cell_table(rows), "cells")
    sources = source_table(cells)
    if not len(sources):
        return rows.withColumns({"copies": F.lit(0), "source_size": F.lit(0).cast("bigint"), "target": F.lit(0.0)})
    sources["number"] = np.arange(len(sources))
    # One row per constraint.
    plain = [(None if r.source is None else r.source, int(r.number), float(r.scale), int(r.source_size), float(r.target)) for r in sources.itertuples()]
    known = F.broadcast(spark.createDataFrame(plain, "name string, number bigint, scale double, source_size bigint, target double"))
    numbered = materialize(cells.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name"), "cells")
    tilt = solve_dual(numbered, sources)
    tilts = F.broadcast(spark.createDataFrame([(i, float(t) if np.isfinite(t) else None) for i, t in enumerate(tilt)], "number bigint, tilt double"))
    top = F.lit(math.log(MOST_COPIES))
    power = F.when(F.col("tilt").isNull(), top).otherwise(F.least(F.col("tilt") * F.col("size") / F.col("scale"), top))
    rated = numbered.join(tilts, "number").withColumn("rate", F.when(power >= top, F.lit(float(MOST_COPIES))).otherwise(F.exp(power)))
    shape = "source string, size bigint, n bigint, base int, extra bigint, source_size bigint, target double"
    plan = rated.select("number", "source", "size", "n", "rate", "source_size", "target").groupBy("number").applyInPandas(_rounded, shape)
    plan = materialize(plan, "plan").select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("n").alias("group_rows"), "base", "extra", "source_size", "target")
    planned = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).drop("_source", "_size")
    placed = positions(planned, ["source", "size"], [tie], "_position")
    return placed.withColumn("copies", (F.col("base") + (F.col("_position") < F.col("extra")).cast("int")).cast("int")).drop("_position", "group_rows", "base", "extra")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("_tie", F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    slim = materialize(_sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "_tie"), "sizes")
    out = copies(slim, "_tie")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken."""
    names = docs.columns
    held = docs.select(F.struct(*names).alias("_row"), "doc_id", "source", "text")
    out = copies(_sized(held).select("_row", "source", "size", "_tie"), "_tie").where("copies > 0")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_again")).select("_row.*")
