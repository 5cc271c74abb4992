"""Dense positions within groups of any size, without ordering a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def chunk_of(size: Column, *by: str) -> Column:
    """Chunk of a row in a group of ``size`` rows: about sqrt(size) chunks of sqrt(size) rows each."""
    return F.pmod(F.xxhash64(F.lit(17), *by), F.greatest(F.lit(1), F.ceil(F.sqrt(size)))).cast("bigint")


def positions(rows: DataFrame, group: list[str], by: list[str], name: str = "position") -> DataFrame:
    """Adds the 0-based position of each row in its group; ``rows`` carries ``group_rows``, the group's row count.

    Chunks follow each other, rows within a chunk are ordered by ``by``; the
    order is the same in every run.
    """
    chunked = rows.withColumn("_chunk", chunk_of(F.col("group_rows"), *by))
    keys = [*group, "_chunk"]
    counts = chunked.groupBy(*keys).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(*group).orderBy("_chunk")) - F.col("_rows")
    counts = counts.withColumn("_before", before).drop("_rows")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*by)) - 1
    same = None
    right = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_before")
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = equal if same is None else same & equal
    placed = chunked.withColumn("_place", place).join(right, same)
    return placed.withColumn(name, F.col("_before") + F.col("_place")).drop("_place", "_before", "_chunk", *[f"_k_{k}" for k in keys])
