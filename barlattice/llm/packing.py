"""Filling fixed-capacity containers (problem 9).

Token sizes are whole numbers of at most the capacity, so the sizes of all items
are a histogram bounded by the capacity, not by the data.  The packing is planned
on the histogram, in runs of equal containers: large items (above a third of the
capacity) are matched greedily, at most two to a container; smaller ones fill the
smallest gap that holds them.  Items then take their places by their rank among
the items of their size, which is computed in two levels: over the partitions of the
numbered rows, then within each.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.session import cut_lineage

#: Most kinds of containers, and most sizes of all kinds together: a plan's histogram is held by the driver.
MOST_PACKS, MOST_SIZES = 1000, 1 << 23


class _Gaps:
    """Runs of containers (first, count) by the room that is left in each."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.order: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if not self.runs[gap]:
                bisect.insort(self.order, gap)
            self.runs[gap].append((first, count))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """(gap, first, count) of a run with the smallest gap of at least ``size``."""
        i = bisect.bisect_left(self.order, size)
        if i == len(self.order):
            return None
        gap = self.order[i]
        first, count = self.runs[gap].pop()
        if not self.runs[gap]:
            self.order.pop(i)
        return gap, first, count


def plan(capacity: int, histogram: dict[int, int]) -> tuple[list[tuple[int, int, int, int]], int]:
    """(slots, containers) for items of whole sizes from 1 to ``capacity``.

    A slot (size, start, first, each) places the items of ``size`` with ranks from
    ``start`` (up to the next slot of that size) into containers from ``first`` on,
    ``each`` to a container.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must lie from 1 to the capacity")
    slots: list[tuple[int, int, int, int]] = []
    done: dict[int, int] = defaultdict(int)
    gaps, made = _Gaps(), 0

    def place(size: int, count: int, first: int, each: int) -> None:
        slots.append((size, done[size], first, each))
        done[size] += count
        left[size] -= count

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        # the largest partner that fits beside a
        i = bisect.bisect_right(large, capacity - a) - 1
        b = large[i] if i >= 0 else None
        if b is None or (b == a and left[a] == 1):
            if b == a and i > 0:
                b = large[i - 1]
            else:
                n = left[a] if b is None else 1
                place(a, n, made, 1)
                gaps.add(capacity - a, made, n)
                made += n
                large.pop()
                continue
        if b == a:
            n = left[a] // 2
            place(a, 2 * n, made, 2)
        else:
            n = min(left[a], left[b])
            place(a, n, made, 1)
            place(b, n, made, 1)
        gaps.add(capacity - a - b, made, n)
        made += n
        large = [s for s in large if left[s] > 0] if (left[a] == 0 or left[b] == 0) else large

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            got = gaps.take(size)
            if got is None:
                n = -(-left[size] // (capacity // size))
                gaps.add(capacity, made, n)
                made += n
                continue
            gap, first, count = got
            each = gap // size
            full = min(count, left[size] // each)
            if full:
                place(size, full * each, first, each)
                gaps.add(gap - each * size, first, full)
            if full < count and left[size]:
                n = left[size]
                place(size, n, first + full, n)
                gaps.add(gap - n * size, first + full, 1)
                gaps.add(gap, first + full + 1, count - full - 1)
            elif full < count:
                gaps.add(gap, first + full, count - full)
    return slots, made


def _ranked(items: DataFrame, group: list[str], amount: str | None = None) -> DataFrame:
    """``__rank``: how many items of the group (or how much ``amount``) come before each item.

    Counted by partition of the numbered rows, then within the partition, so a group
    may hold any share of the rows and a task holds no more than a partition did.
    """
    parted = items.withColumn("__part", F.shiftright("__row", 33))
    weight = F.col(amount) if amount else F.lit(1)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy(*group, "__part").agg(F.sum(weight).alias("__w")).select(
        *group, "__part", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy(*group, "__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parted.withColumn("__inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, [*group, "__part"])
        .withColumn("__rank", F.col("__offset") + F.col("__inside"))
        .drop("__part", "__inside", "__offset")
    )


def _placer(shared):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            pack = batch.column("pack_id").to_numpy()
            size = batch.column("__rest").to_numpy()
            rank = batch.column("__rank").to_numpy()
            container = np.zeros(len(pack), np.int64)
            for p in np.unique(pack):
                sizes, starts, firsts, each = slots[int(p)]
                mine = np.flatnonzero(pack == p)
                # slots are sorted by (size, start): the last one at or before (size, rank)
                width = np.int64(starts.max() + rank[mine].max() + 2)
                at = np.searchsorted(sizes * width + starts, size[mine] * width + rank[mine], side="right") - 1
                container[mine] = firsts[at] + (rank[mine] - starts[at]) // each[at]
            names = [*batch.schema.names, "container_id"]
            yield pa.record_batch([*batch.columns, pa.array(container)], names=names)

    return task


def pack(items: DataFrame, packs: DataFrame, identifier: str = "doc_id", size: str = "size") -> DataFrame:
    """Containers of every item for every kind of container in ``packs`` (``pack_id``, ``capacity``).

    Columns: ``pack_id``, ``identifier``, ``piece``, ``container_id``, ``n_tokens``.
    An item is one piece unless it exceeds the capacity: then it is cut into whole
    containers and one smaller piece, which is packed like an item.  Items of size
    0 (or null) lie in container 0.  Kinds with a null or non-positive capacity
    raise; of a repeated ``pack_id`` the smallest capacity holds.
    """
    spark = items.sparkSession
    kinds = {int(r[0]): int(r[1]) for r in packs.groupBy("pack_id").agg(F.min("capacity")).limit(MOST_PACKS + 1).collect()}
    if len(kinds) > MOST_PACKS or any(c < 1 for c in kinds.values()):
        raise ValueError("packs must be a small table of positive capacities")
    if sum(kinds.values()) > MOST_SIZES:
        raise ValueError("the capacities are too large for a histogram")
    schema_order = ["pack_id", identifier, "piece", "container_id", "n_tokens"]
    base = items.select(F.col(identifier), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size")).withColumn(
        "__row", F.monotonically_increasing_id()
    )
    # row numbers hold for one evaluation only, and several branches join by them
    base = cut_lineage(base)
    if not kinds:
        return base.select(F.lit(0).cast("long").alias("pack_id"), identifier, F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("container_id"), F.lit(0).cast("long").alias("n_tokens")).limit(0)
    each = F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in kinds.items()]))
    sized = base.withColumn("__k", each).select(identifier, "__row", "__size", "__k.pack_id", "__k.capacity")
    over = F.col("__size") > F.col("capacity")
    div = F.call_function("div", F.col("__size"), F.col("capacity"))
    sized = sized.withColumn("__full", F.when(over, div).otherwise(F.lit(0)).cast("long")).withColumn(
        "__rest", F.col("__size") - F.col("__full") * F.col("capacity")
    )
    # at most one row for each size up to the capacity
    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    for p, s, n in sized.filter("__rest > 0").groupBy("pack_id", "__rest").count().collect():
        histogram[int(p)][int(s)] = int(n)
    plans, made = {}, {}
    for p, c in kinds.items():
        slots, made[p] = plan(c, histogram[p])
        a = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)
        plans[p] = (a[:, 0].copy(), a[:, 1].copy(), a[:, 2].copy(), a[:, 3].copy())
    shared = spark.sparkContext.broadcast(plans)  # bounded by the capacities

    ranked = _ranked(sized.filter("__rest > 0"), ["pack_id", "__rest"]).select(identifier, "__full", "pack_id", "__rest", F.col("__rank").cast("long").alias("__rank"))
    fields = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    placed = ranked.mapInArrow(_placer(shared), ", ".join(f"`{n}` {t}" for n, t in fields.items()) + ", container_id long").select(
        "pack_id", identifier, F.col("__full").alias("piece"), "container_id", F.col("__rest").alias("n_tokens")
    )
    offset = F.create_map(*[x for p, n in made.items() for x in (F.lit(p).cast("long"), F.lit(n).cast("long"))])
    whole = (
        _ranked(sized.filter("__full > 0"), ["pack_id"], "__full")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__full") - 1)))
        .select("pack_id", identifier, "piece", (offset[F.col("pack_id")] + F.col("__rank") + F.col("piece")).alias("container_id"), F.col("capacity").alias("n_tokens"))
    )
    empty = sized.filter("__size = 0").select(
        "pack_id", identifier, F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("container_id"), F.lit(0).cast("long").alias("n_tokens")
    )
    return placed.unionByName(whole).unionByName(empty).select(*schema_order)


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """``pack_id``, ``containers``, ``tokens``, ``unused`` and the largest ``most`` in a container."""
    per = packed.groupBy("pack_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    totals = per.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("most"))
    kinds = packs.groupBy("pack_id").agg(F.min("capacity").alias("capacity"))
    return totals.join(F.broadcast(kinds), "pack_id").select(
        "pack_id", "containers", "tokens", (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused"), "most"
    )
