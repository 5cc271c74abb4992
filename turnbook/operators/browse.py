"""List operations on result rows: filters, sorting, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnbook.operators.ranks import with_position

# Fixed value: rows per page.
PAGE_ROWS = 100


def status_any(rows: DataFrame, flags: DataFrame, disposition: bool, full_delivery: bool) -> DataFrame:
    """Rows with any of the chosen flags; nothing chosen keeps all rows."""
    if not disposition and not full_delivery:
        return rows
    wanted = F.lit(False)
    if disposition:
        wanted = wanted | F.col("disposition_period").isNotNull()
    if full_delivery:
        wanted = wanted | F.col("altered_trading")
    return rows.join(flags.where(wanted).select("ticker"), "ticker", "left_semi")


def matches_search(text: str, *columns: str) -> Column:
    """Case-insensitive substring of any column; blank text matches all."""
    needle = text.strip().lower()
    if not needle:
        return F.lit(True)
    found = F.lit(False)
    for name in columns:
        found = found | F.contains(F.lower(F.col(name)), F.lit(needle))
    return found


def sort_by(rows: DataFrame, column: str, descending: bool = True, text: bool = False) -> DataFrame:
    """Numbers: nulls last either way, ties by ticker.  Text: ordinal."""
    return rows.orderBy(*sort_order(column, descending, text))


def sort_order(column: str, descending: bool, text: bool) -> list[Column]:
    key = F.col(column)
    if text:
        return [key.desc() if descending else key.asc(), F.col("ticker").asc()]
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("ticker").asc()]


def page(rows: DataFrame, number: int, column: str, descending: bool = True, size: int = PAGE_ROWS) -> DataFrame:
    """One page in the order of ``sort_by``; the number is clamped to the pages there are.

    Position and number of rows come from the same computed rows.
    """
    placed = with_position(rows, column, "_position", descending=descending)
    total = placed.agg(F.count(F.lit(1)).alias("n")).scalar()
    pages = F.greatest(F.lit(1), F.ceil(total / size))
    chosen = F.least(F.lit(max(number, 1)), pages)
    on_page = F.ceil(F.col("_position") / size) == chosen
    return placed.where(on_page).orderBy("_position").drop("_position")
