"""Messages delivered more than once (problem 2).

The deliveries' identifiers go once into storage that is bucketed by time, in the
shared folder.  On the way each time bucket has a Bloom filter of the identifiers
that arrived in it, counting to two, in segments by the identifier's hash.  A
delivery whose identifier is once in its own bucket's filter and in no other
bucket's is definitely new.  The possible repeats are verified exactly against the
storage of the buckets that matched and no other: every copy of a repeated
identifier matches the bucket of each other copy.  False positives cost work and
change nothing; there are no false negatives.

There is one way for any size.  Copies that meet in a block of a task are told
apart there, so an identifier with any share of the rows reaches its segment at
most once for each block.  What is shuffled is the identifier, arrival and number
of a delivery, once; a segment's filters never leave the task that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.session import shared_folder

#: Seconds in a time bucket, at first; doubled until no more than MAX_BUCKETS are in use (one more holds rows without a time).
BUCKET_SECONDS = 7 * 86_400
MAX_BUCKETS = 16
#: Identifiers in a segment, bits of a filter for each, bits set by each.
SEGMENT_KEYS = 1 << 17
BITS_PER_KEY = 16
HASHES = 4
#: Rows that are looked at together in a task.
BLOCK_ROWS = 1 << 17
#: Parts that the copies of one identifier are spread over when they are ranked.
SALTS = 32


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    """A further hash of 64-bit hashes (finalising multiply and shift)."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) + np.uint64(by)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions of each hash, by double hashing."""
    a, b = _mix(h, 1), _mix(h, 2) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(HASHES)], axis=1).astype(np.int64)


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many identifiers: a power of two."""
    return 1 << max(10, math.ceil(math.log2(max(1, keys) * BITS_PER_KEY)))


def matches(bucket: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """For each row of a segment the buckets, as bits of a number, in which its identifier may have another delivery."""
    at = positions(h, bits)
    result = np.zeros(len(h), np.int64)
    for b in np.unique(bucket):
        own = bucket == b
        count = np.bincount(at[own].ravel(), minlength=bits)
        found = np.where(own, (count[at] > 1).all(axis=1), (count[at] > 0).all(axis=1))
        result |= np.where(found, np.int64(1) << np.int64(b), np.int64(0))
    return result


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS, whole: str | None = None) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows; rows of equal ``whole``, which come together, stay together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table, cut = pa.Table.from_batches(held), n
        if whole:
            of = table[whole].to_numpy()
            cut = int(np.searchsorted(of, of[-1]))  # sorted: the last group may go on in the next batch
        if cut:
            yield table.slice(0, cut).combine_chunks()
        table = table.slice(cut)
        held, n = table.to_batches(), table.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table[name].chunks)


def _local(keys: Sequence[str], arrived: str, tie: str) -> Callable:
    """Marks (``__sure``) the rows of a block that come after another row of their identifier in it."""
    order = [(c, "ascending") for c in ("__h", arrived, tie)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches):
            n = table.num_rows
            at = pc.sort_indices(table, sort_keys=order, null_placement="at_end")
            same = np.ones(n - 1, bool)
            for c in ("__h", *keys):
                x = _column(table, c).take(at)
                a, b = x.slice(1), x.slice(0, n - 1)
                equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                same &= equal.to_numpy(zero_copy_only=False)
            sure = np.zeros(n, bool)
            sure[at.to_numpy()[1:]] = same
            yield from table.append_column("__sure", pa.array(sure)).to_batches()

    return task


def _screen(bits: int) -> Callable:
    """Adds ``__seen`` (matching buckets) to whole segments; the rows come sorted by segment."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, whole="__segment"):
            segment = table["__segment"].to_numpy()
            bucket, h, sure = (_column(table, c).to_numpy(zero_copy_only=False) for c in ("__bucket", "__h", "__sure"))
            seen = np.zeros(len(h), np.int64)
            for s in np.split(np.arange(len(h)), np.flatnonzero(np.diff(segment)) + 1):
                rows = s[~sure[s]]
                if len(rows):
                    seen[rows] = matches(bucket[rows], h[rows], bits)
            yield from table.drop_columns(["__segment"]).append_column("__seen", pa.array(seen)).to_batches()

    return task


def bucket_of(arrived: str, seconds: int) -> Column:
    """Number of the time bucket; null where there is no time."""
    t = F.unix_seconds(arrived)
    return F.call_function("div", t - F.pmod(t, F.lit(seconds)), F.lit(seconds))


def stored_deliveries(rows: DataFrame, keys: Sequence[str], arrived: str, tie: str, bucket_seconds: int = BUCKET_SECONDS, segment_keys: int = SEGMENT_KEYS) -> DataFrame | None:
    """The storage: ``keys``, ``arrived``, ``tie`` of every row, in parquet partitioned by ``__bucket``.

    ``__sure``: the row comes after another of its identifier in its block, so it is
    surplus.  ``__seen``: buckets in which the identifier may have another delivery,
    as bits; 0 for rows that are definitely new.  None for an empty table.
    """
    spark = rows.sparkSession
    few = rows.select(*keys, arrived, tie)
    raw = bucket_of(arrived, bucket_seconds)
    # one number for each bucket of the calendar: they decide the width of a bucket and the number of segments
    counts = {r[0]: int(r[1]) for r in few.groupBy(raw.alias("b")).count().collect()}
    if not counts:
        return None
    timed = sorted(b for b in counts if b is not None)
    start, width = (timed[0] if timed else 0), 1
    while timed and (timed[-1] - start) // width >= MAX_BUCKETS:
        width *= 2
    load: dict[int, int] = {}
    for b, n in counts.items():
        k = 0 if b is None else 1 + (b - start) // width
        load[k] = load.get(k, 0) + n
    segments = max(1, -(-sum(load.values()) // segment_keys))
    bits = filter_bits(-(-max(load.values()) // segments))

    bucket = F.coalesce(F.call_function("div", raw - start, F.lit(width)) + 1, F.lit(0)).cast("int")
    marked = few.withColumns({"__h": F.xxhash64(*keys), "__bucket": bucket})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields)
    local = marked.mapInArrow(_local(keys, arrived, tie), f"{fields}, __sure boolean")
    # rows that are surplus for sure only wait in the storage of their bucket, in any segment
    at = F.pmod(F.when(F.col("__sure"), F.xxhash64(tie, arrived)).otherwise(F.xxhash64("__h")), F.lit(segments)).cast("int")
    placed = local.withColumn("__segment", at).repartition("__segment").sortWithinPartitions("__segment")
    screened = placed.mapInArrow(_screen(bits), f"{fields}, __sure boolean, __seen long")
    folder = shared_folder(spark, "deliveries")
    screened.write.partitionBy("__bucket").parquet(folder)
    return spark.read.schema(screened.schema).parquet(folder)


def possible_repeats(stored: DataFrame) -> DataFrame:
    """The rows of the storage that may repeat another, of the matching buckets only."""
    seen = stored.agg(F.bit_or("__seen")).first()[0] or 0
    buckets = [b for b in range(MAX_BUCKETS + 1) if seen >> b & 1]
    return stored.filter(F.col("__bucket").isin(buckets) & (F.col("__seen") != 0))


def surplus_deliveries(
    rows: DataFrame,
    keys: Sequence[str],
    arrived: str,
    tie: str,
    bucket_seconds: int = BUCKET_SECONDS,
    segment_keys: int = SEGMENT_KEYS,
) -> DataFrame:
    """The deliveries that are not the kept one of their identifier: ``keys``, ``arrived``, ``tie``.

    Kept is the earliest ``arrived`` (a null is after every time), at ties the
    smallest ``tie``; ``tie`` should be unique, rows equal in all of these are
    ranked in any order and exactly one stays.  A null in ``keys`` equals null.
    An empty table has no surplus.

    Exact verification ranks in two levels: within (identifier, salt), then among
    the firsts of each salt.
    """
    names = [*keys, arrived, tie]
    stored = stored_deliveries(rows, keys, arrived, tie, bucket_seconds, segment_keys)
    if stored is None:
        return rows.select(*names).limit(0)
    order = [F.col(arrived).asc_nulls_last(), F.col(tie).asc_nulls_last()]
    salted = possible_repeats(stored).select(*names).withColumn("__salt", F.pmod(F.xxhash64(tie, arrived), F.lit(SALTS)))
    local = salted.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order)))
    firsts = local.filter("__rank = 1").withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    parts = (stored.filter("__sure"), local.filter("__rank > 1"), firsts.filter("__rank > 1"))
    return parts[0].select(*names).unionByName(parts[1].select(*names)).unionByName(parts[2].select(*names))


def kept_deliveries(
    rows: DataFrame,
    keys: Sequence[str],
    arrived: str,
    tie: str,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """All columns of exactly one delivery per identifier; ``tie`` must be unique and not null.

    Removes the surplus (a small part of the rows) by an anti join on ``tie``.
    """
    surplus = surplus_deliveries(rows, keys, arrived, tie, bucket_seconds)
    return rows.join(surplus.select(tie), tie, "left_anti")
