"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnbook import session

#: While a table is written: its shuffle files go once it is there, and Python gets Arrow batches of bounded size.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back; only the table is read again."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        conf.set(k, v)
    try:
        return session.materialize(df, label)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
