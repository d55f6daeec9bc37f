"""Kline archives, JSON lines, catalogs and small state files."""

from __future__ import annotations

import io
import json
import os
import tempfile
import time
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlattice.functions.epoch import epoch_ms

#: Columns of a kline CSV by position.
KLINE = (
    "open_time",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "close_time",
    "quote_volume",
    "trades_count",
    "taker_buy_volume",
    "taker_buy_quote_volume",
    "ignore",
)
_NUMERIC = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume", "taker_buy_quote_volume")


def _unzipped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of all CSV members of zipped files, one member at a time."""
    for files in frames:
        for path, content in zip(files["path"], files["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for name in sorted(n for n in archive.namelist() if n.endswith(".csv")):
                    with archive.open(name) as f:
                        for part in pd.read_csv(f, header=None, names=list(KLINE), dtype=str, chunksize=100_000):
                            yield part.assign(file=f"{path}#{name}")[["file", *KLINE]]


def read_kline_zips(spark: SparkSession, pattern: str, symbol: Column | None = None) -> DataFrame:
    """Zipped kline CSVs (``pattern``: a path with wildcards), header lines left out.

    ``open_time`` is in ms whatever its unit; rows without one (a header, a torn
    line) do not come out; numbers that do not parse are null.  ``symbol`` defaults
    to the part of the file name before the first ``-``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(pattern).select("path", "content")
    raw = files.mapInPandas(_unzipped, "file string, " + ", ".join(f"{c} string" for c in KLINE))
    name = F.regexp_extract("file", r"([^/#]+)#", 1)
    return (
        raw.withColumn("open_time", epoch_ms(F.col("open_time").try_cast("long")))
        .filter(F.col("open_time").isNotNull())
        .withColumns({c: F.col(c).try_cast("double") for c in _NUMERIC})
        .withColumns({"trades_count": F.col("trades_count").try_cast("long"), "close_time": epoch_ms(F.col("close_time").try_cast("long"))})
        .withColumn("symbol", symbol if symbol is not None else F.split(name, "-")[0])
    )


#: Columns that a kline archive must have.
REQUIRED = ("open_time", "open", "high", "low", "close", "volume")


def _first_member(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the first CSV member of zipped files by its header (or by position without one); a missing column raises."""
    for files in frames:
        for path, content in zip(files["path"], files["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = [n for n in archive.namelist() if n.endswith(".csv")]
                if not names:
                    raise FileNotFoundError(f"{path} holds no CSV")
                with archive.open(names[0]) as f:
                    headed = b"open" in f.readline().lower()
                with archive.open(names[0]) as f:
                    for part in pd.read_csv(f, header=0 if headed else None, names=None if headed else list(KLINE), dtype=str, chunksize=100_000):
                        part = part.rename(columns=lambda c: str(c).strip().lower())
                        if missing := [c for c in REQUIRED if c not in part]:
                            raise KeyError(f"{path} lacks {', '.join(missing)}")
                        yield part.assign(file=path)[["file", *REQUIRED]]


def read_required_columns(spark: SparkSession, pattern: str, strict: bool = False) -> DataFrame:
    """Zipped klines by the names in their header: ``file`` and the required columns, one row for each ``open_time`` of a file.

    Only the first CSV member of an archive is read; an archive without one, or without
    a required column, raises.  Values that do not parse are null, or raise if
    ``strict``; a row without ``open_time`` does not come out.  Of rows with equal times
    the smallest stays.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(pattern).select("path", "content")
    raw = files.mapInPandas(_first_member, "file string, " + ", ".join(f"{c} string" for c in REQUIRED))

    def typed(c: str, kind: str) -> Column:
        return F.col(c).cast(kind) if strict else F.col(c).try_cast(kind)

    rows = raw.select("file", epoch_ms(typed("open_time", "long")).alias("open_time"), *[typed(c, "double").alias(c) for c in REQUIRED[1:]])
    values = F.struct(*REQUIRED[1:])
    return rows.filter("open_time IS NOT NULL").groupBy("file", "open_time").agg(F.min(values).alias("__v")).select("file", "open_time", "__v.*")


def verify_checksums(spark: SparkSession, pattern: str, manifest: DataFrame) -> DataFrame:
    """``name``, ``ok`` of each file against a manifest (``name``, ``sha256``): computed where the files are read."""
    files = spark.read.format("binaryFile").load(pattern).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return files.join(manifest, "name", "left").select("name", F.coalesce(F.lower("sha256") == F.col("found"), F.lit(False)).alias("ok"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a schema: blank and torn lines are left out, unknown fields ignored."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Appends rows to a folder of JSON lines; nothing there is rewritten."""
    df.write.mode("append").json(path)


def write_universes(bars: DataFrame, path: str) -> None:
    """Parquet, a folder per universe, so that a universe is read without the others."""
    bars.write.mode("overwrite").partitionBy("universe_id").parquet(path)


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` latest rows by ``order`` (a report's limit)."""
    return df.orderBy(F.col(order).desc()).limit(n)


def save_state(path: str, state: dict) -> None:
    """Commits a small state: temporary file, sync, copy of the old one to ``.bak``, rename."""
    target = Path(path)
    handle, temporary = tempfile.mkstemp(dir=target.parent, suffix=".tmp")
    with os.fdopen(handle, "w") as f:
        json.dump(state, f)
        f.flush()
        os.fsync(f.fileno())
    if target.exists():
        backup = target.with_suffix(target.suffix + ".bak")
        backup.write_bytes(target.read_bytes())
    os.replace(temporary, target)


def load_state(path: str, default: dict | None = None) -> dict | None:
    """The state, else its backup, else ``default``; torn files are passed over."""
    for candidate in (Path(path), Path(path + ".bak")):
        try:
            return json.loads(candidate.read_text())
        except (OSError, ValueError):
            continue
    return default


def sweep_temporary(folder: str, older_s: float = 300) -> int:
    """Deletes temporary files left by writers that died; returns how many."""
    old = [p for p in Path(folder).glob("*.tmp") if time.time() - p.stat().st_mtime > older_s]
    for p in old:
        p.unlink(missing_ok=True)
    return len(old)
