"""Per-date snapshot files: scan, flatten, write."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from turnbook.operators.quotes import latest_dimension
from turnbook.schemas import SNAPSHOT
from turnbook.session import materialize

CORRUPT = "_corrupt_record"
#: Lines of a compressed file; a line has up to a few hundred quotes.
LINES_PER_FILE = 1000


def snapshot_schema() -> StructType:
    return StructType.fromDDL(SNAPSHOT)


def checksum() -> Column:
    """What the content of a line adds up to, the same before it is written and after it is read."""
    # In the types that are read back, so that numbers have their digits there already.
    typed = [F.col(c).cast(snapshot_schema()[c].dataType).alias(c) for c in ("quotes", "market_indices")]
    return F.crc32(F.to_json(F.struct(*typed)).cast("binary"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines that can be parsed."""
    schema = snapshot_schema().add(CORRUPT, "string")
    rows = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def dates(read: DataFrame) -> DataFrame:
    """trading_date, complete: whether all lines of a date are there, each once and as it was written.

    Lines without a part number are from before lines had one; they count as they are.
    """
    intact = F.col("checksum").isNull() | (F.col("checksum") == checksum())
    seen = read.groupBy("trading_date").agg(
        F.count("part").alias("_lines"), F.countDistinct("part").alias("_parts"),
        F.min("parts").alias("_least"), F.max("parts").alias("_most"), F.bool_and(intact).alias("_intact"),
    )
    whole = F.col("_most").isNull() | ((F.col("_least") == F.col("_most")) & (F.col("_parts") == F.col("_most")) & (F.col("_lines") == F.col("_parts")))
    return seen.select("trading_date", (whole & F.col("_intact")).alias("complete"))


def write_lines(values: DataFrame, path: str) -> None:
    """Text lines as compressed files; a file is read by one task, so it takes no more than LINES_PER_FILE."""
    values.write.option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines that can be parsed, stored so that what is judged and what is read are parsed once."""
    return materialize(lines(spark, path), "lines")


def scan(spark: SparkSession, path: str, read: DataFrame | None = None) -> DataFrame:
    """The lines of complete trading days; a date of which a line is lost, broken or altered is left out as a whole.

    ``read``: what ``read_lines`` gave, if it is already there.
    """
    read = read_lines(spark, path) if read is None else read
    complete = dates(read).where("complete").select("trading_date")
    return read.where("is_trading_day").join(complete, "trading_date", "left_semi")


def incomplete_dates(spark: SparkSession, path: str, read: DataFrame | None = None) -> DataFrame:
    """Trading days that ``scan`` leaves out although some of their lines can be read."""
    read = read_lines(spark, path) if read is None else read
    return dates(read.where("is_trading_day")).where("NOT complete").select("trading_date")


def quotes(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("trading_date", F.inline("quotes"))


def indices(snapshots: DataFrame) -> DataFrame:
    # The lines of one date repeat its index rows.
    return snapshots.select("trading_date", F.inline("market_indices")).distinct()


def dimension(snapshots: DataFrame) -> DataFrame:
    return latest_dimension(quotes(snapshots))


def write(daily: DataFrame, path: str, partition: str = "trading_date") -> None:
    """Idempotent: writing a partition again replaces it and nothing else.

    ``trading_date`` suits dates of many rows.  ``trading_month`` avoids a file
    per date when dates are small; then whole months must be written.
    The rebalance hint lets adaptive execution split a large partition over
    several tasks and merge small ones.
    """
    if partition == "trading_month":
        daily = daily.withColumn(partition, F.trunc("trading_date", "month"))
    (
        daily.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def write_day(daily: DataFrame, path: str, date: dt.date) -> None:
    """Replace one date of a table stored by month; the other dates of its month stay."""
    month = F.lit(date.replace(day=1))
    stored = daily.sparkSession.read.parquet(path)
    others = stored.where((F.col("trading_month") == month) & (F.col("trading_date") != F.lit(date)))
    fresh = daily.where(F.col("trading_date") == F.lit(date)).withColumn("trading_month", month)
    whole = materialize(others.unionByName(fresh.select(*stored.columns)), "month")
    write(whole.drop("trading_month"), path, "trading_month")


def day(spark: SparkSession, path: str, date: dt.date) -> DataFrame:
    """One date; only its partition is read."""
    stored = spark.read.parquet(path)
    wanted = F.col("trading_date") == F.lit(date)
    if "trading_month" in stored.columns:
        wanted = wanted & (F.col("trading_month") == F.lit(date.replace(day=1)))
    return stored.where(wanted)


def exists(spark: SparkSession, path: str, date: dt.date) -> bool:
    return not day(spark, path, date).isEmpty()
