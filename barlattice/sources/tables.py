"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlattice.functions.epoch import epoch_ms
from barlattice.operators.ledger import window_guard


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns``, only those (pruned in the scan).

    TIMESTAMP_NTZ columns are read as UTC instants: event-time operators refuse NTZ.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    ntz = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(ntz) if ntz else df


def bars_until(spark: SparkSession, folder: str, last_allowed_ms: int, *columns: str) -> DataFrame:
    """The bars of ``folder``, if none opens after ``last_allowed_ms``; else it raises and nothing is handed on.

    The check reads one column and comes before any other use; a range that is allowed
    is cut out with ``align.in_range`` first where a table holds more.
    """
    ms = table(spark, folder, "bars", "timestamp_open").select(epoch_ms(F.col("timestamp_open")).alias("ms"))
    window_guard(ms, last_allowed_ms)
    return table(spark, folder, "bars", *columns)
