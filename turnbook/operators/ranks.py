"""Positions 1..n over a whole result, without one task sorting everything.

The rows of a group are put into value ranges; positions within a range and the
sizes of the ranges before it add up to the position.  The number of ranges
follows from the counted rows of the largest group, so that no task sorts more
than about ``RANGE_ROWS`` of them, however large the result is; groups of fewer
rows are one range each.  The bounds come from a sample chosen by hash, which
makes them a pure function of the data: a re-run task after a lost executor
always sees the same bounds.  Keys are compared in their own type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnbook.session import materialize

#: Rows that a task sorts; more rows of a group are spread over ranges.
RANGE_ROWS = 1 << 19
#: Sampled rows for each range.
SAMPLE_PER_RANGE = 16


def ordering(key: str, ticker: str = "ticker", descending: bool = True) -> list[Column]:
    """Nulls last, larger (or smaller) first, then ticker in ordinal order."""
    column = F.col(key)
    return [column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col(ticker).asc()]


def with_positions(
    df: DataFrame,
    keys: dict[str, str],
    within: tuple[str, ...] = (),
    ticker: str = "ticker",
    descending: bool = True,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add for each ``name: key`` the bigint position by ``key`` inside each ``within`` group.

    (``ticker``, ``within``) must be unique.  Several branches read the rows, so
    they are computed once.
    """
    df = materialize(df, "ranking")
    ranges = math.ceil(_largest_group(df, within) / range_rows)
    if ranges > 1:
        return _by_ranges(df, keys, within, ticker, descending, ranges)
    return df.withColumns(
        {
            name: F.row_number().over(W.partitionBy(*within).orderBy(*ordering(key, ticker, descending))).cast("bigint")
            for name, key in keys.items()
        }
    )


def with_position(
    df: DataFrame,
    key: str,
    name: str,
    within: tuple[str, ...] = (),
    ticker: str = "ticker",
    descending: bool = True,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    return with_positions(df, {name: key}, within, ticker, descending, range_rows)


def _largest_group(df: DataFrame, within: tuple[str, ...]) -> int:
    if not within:
        return df.count()
    return df.groupBy(*within).count().agg(F.max("count")).first()[0] or 0


def _bounds(df, keys, within, ticker, descending, ranges) -> DataFrame:
    """One row: for every key the bounds in ranking order, evenly spread over one bottom-k sample by hash."""
    size = ranges * SAMPLE_PER_RANGE
    order = ("_h", *within, ticker)
    sample = df.withColumn("_h", F.xxhash64(ticker, *within)).orderBy(*order).limit(size)
    sample = sample.select(*dict.fromkeys((ticker, *keys)))

    def ahead(a: Column, b: Column) -> Column:
        before = a["key"] > b["key"] if descending else a["key"] < b["key"]
        by_key = (
            F.when(a["key"].isNull() | b["key"].isNull(), a["key"].isNull().cast("int") - b["key"].isNull().cast("int"))
            .when(before, -1)
            .when(a["key"] == b["key"], 0)
            .otherwise(1)
        )
        by_ticker = F.when(a["ticker"] < b["ticker"], -1).when(a["ticker"] == b["ticker"], 0).otherwise(1)
        return F.when(by_key != 0, by_key).otherwise(by_ticker)

    def chosen(key: str) -> Column:
        rows = F.collect_list(F.struct(F.col(key).alias("key"), F.col(ticker).alias("ticker")))
        ordered = F.array_sort(rows, ahead)
        step = F.greatest(F.lit(1), F.floor(F.size(ordered) / ranges).cast("int"))
        return F.filter(ordered, lambda _, i: (i > 0) & (i % step == 0))

    return sample.agg(*[chosen(key).alias(f"b{i}") for i, key in enumerate(keys)])


def _precedes(bound: Column, key: str, ticker: str, descending: bool) -> Column:
    """Whether a bound comes before the row in ranking order, or is the row itself."""
    mine, theirs = F.col(key), bound["key"]
    ahead = theirs > mine if descending else theirs < mine
    tie = theirs.eqNullSafe(mine) & (bound["ticker"] <= F.col(ticker))
    return F.coalesce(ahead, theirs.isNotNull() & mine.isNull()) | tie


def _range_of(bounds: Column, key: str, ticker: str, descending: bool, ranges: int) -> Column:
    """Number of bounds before the row: every so many of them are looked at first, then those in between."""
    stride = max(1, math.isqrt(ranges))

    def ahead(some: Column) -> Column:
        return F.size(F.filter(some, lambda b: _precedes(b, key, ticker, descending)))

    coarse = ahead(F.filter(bounds, lambda _, i: i % stride == stride - 1)) * stride
    return coarse + ahead(F.slice(bounds, coarse + 1, F.lit(stride)))


def _by_ranges(df, names, within, ticker, descending, ranges):
    """Ranges of all keys are found in one pass over keys alone; the wide rows meet the positions in one join."""
    keys = list(dict.fromkeys(names.values()))
    slim = df.select(ticker, *within, *[k for k in keys if k not in (ticker, *within)])
    bounds = _bounds(slim, keys, within, ticker, descending, ranges).select(
        F.struct(*[f"b{i}" for i in range(len(keys))])
    )
    found = slim.withColumn("_bounds", bounds.scalar())
    found = found.select(
        *slim.columns,
        *[
            _range_of(F.col("_bounds")[f"b{i}"], key, ticker, descending, ranges).alias(f"_r{i}")
            for i, key in enumerate(keys)
        ],
    )
    # Sizes and positions both read the ranges.
    found = materialize(found, "ranges")

    tagged = F.array(*[F.struct(F.lit(i).alias("_k"), F.col(f"_r{i}").alias("_r")) for i in range(len(keys))])
    before = W.partitionBy(*within, "_k").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        found.select(*within, F.inline(tagged))
        .groupBy(*within, "_k", "_r")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    placed = found
    for i, key in enumerate(keys):
        local = W.partitionBy(*within, f"_r{i}").orderBy(*ordering(key, ticker, descending))
        mine = offsets.where(F.col("_k") == i).select(
            *[F.col(c).alias(f"_w_{c}") for c in within], F.col("_r").alias("_range"), "_offset"
        )
        same = F.col(f"_r{i}") == F.col("_range")
        for c in within:
            same = same & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
        # A task of the window has one row of offsets for each of its ranges.
        placed = (
            placed.withColumn("_local", F.row_number().over(local))
            .join(mine, same)
            .withColumn(f"_p{i}", (F.col("_local") + F.col("_offset")).cast("bigint"))
            .drop("_local", "_range", "_offset", *[f"_w_{c}" for c in within])
        )
    positions = placed.select(
        F.col(ticker).alias("_ticker"),
        *[F.col(c).alias(f"_w_{c}") for c in within],
        *[F.col(f"_p{keys.index(key)}").alias(name) for name, key in names.items()],
    )
    same = F.col(ticker).eqNullSafe(F.col("_ticker"))
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    return df.join(positions, same).select(*df.columns, *names)
