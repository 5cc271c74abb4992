"""Monthly revenue report pages: HTML files read as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from turnbook.functions import parsing as p

# Positions of the cells of a company's row.
TICKER_CELL, AMOUNT_CELL = 0, 2


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files as one character per byte: all that is read of them, tags and digits, is plain ASCII.

    Folders like ``month=2026-07-01`` become columns; ``file_order`` is the path of
    a file, so that pages follow each other by the names of their files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    folders = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select(
        "path",
        *folders,
        F.col("_metadata.file_path").alias("file_order"),
        F.decode("content", "ISO-8859-1").alias("html"),
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """``pages``: month, page, html.  Every page is a file of its own, below the folders of its month and page.

    ``page`` is text that sorts in the order in which the files are to be read.
    """
    lone = pages.select("month", "page", "html")
    lone.write.partitionBy("month", "page").option("maxRecordsPerFile", 1).text(path)


def table_rows(html: Column) -> Column:
    """The cells of each table row as trimmed text without inner tags."""

    def plain(cell: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(cell, "<[^>]*>", ""), r"\s+", " "))

    # What stands before the first row is not one.
    pieces = F.filter(F.split(html, "(?i)<tr[ >]"), lambda _, i: i > 0)
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
    return F.transform(pieces, lambda row: F.transform(cells(row), plain))


def revenue_of_pages(pages: DataFrame, codes: str = p.COMMON_STOCK_PATTERN) -> DataFrame:
    """``pages``: month, file_order, html.  A later file wins for a ticker it repeats."""
    rows = (
        pages.select("month", "file_order", F.posexplode(table_rows(F.col("html"))).alias("pos", "r"))
        .select(
            "month",
            "file_order",
            "pos",
            p.cell(F.col("r"), TICKER_CELL).alias("ticker"),
            p.thousands(p.cell(F.col("r"), AMOUNT_CELL)).alias("revenue"),
        )
        .where(p.is_code(F.col("ticker"), codes) & F.col("revenue").isNotNull())
    )
    return last_wins(rows, ("ticker", "month"), ("file_order", "pos")).select("ticker", "month", "revenue")


def last_wins(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row per key: the last one in the given order."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
