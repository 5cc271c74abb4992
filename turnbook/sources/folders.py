"""Partition folders of stored tables, in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    if not hasattr(spark, "_jvm"):
        raise RuntimeError("folders can be listed and deleted by classic sessions only")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def partitions(spark: SparkSession, path: str, column: str) -> list[str]:
    """Folders of the values of a partition column, in the order of their names; none where there is no such path."""
    root, store = _store(spark, path)
    if not store.exists(root):
        return []
    found = [s.getPath() for s in store.listStatus(root)]
    return sorted(str(f.toString()) for f in found if f.getName().startswith(column + "="))


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at, store = _store(spark, path)
        store.delete(at, True)
