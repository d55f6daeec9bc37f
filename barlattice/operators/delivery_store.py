"""Messages delivered more than once, batch after batch (problem 2, incremental form).

The store keeps the identifiers seen so far in parquet, partitioned by time
bucket, with Bloom filters per bucket and segment beside them.  A new batch meets
the filters segment by segment: identifiers that are in none are definitely new.
The others are looked up exactly, in the partitions of the buckets whose filters
matched and nowhere else.

A batch becomes part of the store by one new state file, after its identifiers and
filters are written.  A batch that died before that left nothing behind that is
read; one that is given again after it gets the same answer as before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.operators.dedupe import BUCKET_SECONDS, HASHES, SEGMENT_KEYS, blocks, bucket_of, filter_bits, kept_deliveries, positions
from barlattice.session import cut_lineage

_FILTER = "bucket int, segment int, bits binary"


class _Files:
    """Small files of a folder of shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a file that must not exist yet; it appears as a whole."""
        target, draft = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise RuntimeError(f"another writer has made {name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class DeliveryStore:
    """Identifiers seen so far, in ``folder`` (shared storage); one writer at a time.

    ``keys`` identify a message, ``arrived`` is its timestamp, ``tie`` a unique id of
    the delivery, not null.  A bucket's filters have ``segments`` segments, each made
    for ``segment_keys`` identifiers; more only raise the share of false positives.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        keys: Sequence[str],
        arrived: str,
        tie: str,
        bucket_seconds: int = BUCKET_SECONDS,
        segments: int = 64,
        segment_keys: int = SEGMENT_KEYS,
    ):
        self.spark, self.folder, self.keys, self.arrived, self.tie = spark, folder, [*keys], arrived, tie
        self.seconds, self.segments, self.bits = bucket_seconds, segments, filter_bits(segment_keys)
        self.files = _Files(spark, folder)

    # -- state

    def _state(self) -> tuple[int, dict]:
        """(version, {batches: identifier of a batch to its folder, filters: folders})."""
        versions = [int(n.split(".")[0]) for n in self.files.names("state") if n.endswith(".json")]
        if not versions:
            return 0, {"batches": {}, "filters": []}
        return max(versions), json.loads(self.files.read(f"state/{max(versions):012d}.json"))

    def _commit(self, version: int, state: dict) -> None:
        self.files.publish(f"state/{version:012d}.json", json.dumps(state))

    def _table(self, folders: Sequence[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        # one scan of all batches, however many
        kind = folders[0].split("/")[0]
        found = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{f}" for f in folders])
        return found.drop("batch")

    # -- operations

    def _segment(self) -> Column:
        return F.pmod(F.xxhash64("h"), F.lit(self.segments)).cast("int")

    def _known(self, marked: DataFrame, state: dict, schema: str) -> DataFrame:
        """Ties of the rows whose identifier is stored."""
        filters = self._table(state["filters"], _FILTER)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields)
        # a segment's filters come before its rows
        both = marked.withColumns({"bits": F.lit(None).cast("binary"), "bucket": F.lit(None).cast("int")}).unionByName(filters, allowMissingColumns=True)
        met = both.repartition("segment").sortWithinPartitions("segment", F.col("bits").isNull())
        matched = cut_lineage(met.mapInArrow(_meet(self.bits), f"{fields}, bucket int"))
        buckets = [r[0] for r in matched.select("bucket").distinct().collect()]  # at most the buckets there are
        stored = self._table([*state["batches"].values()], schema).filter(F.col("bucket").isin(buckets))
        on = (matched["h"] == stored["h"]) & (matched["bucket"] == stored["bucket"])
        for k in self.keys:
            on = on & matched[k].eqNullSafe(stored[f"k_{k}"])
        return matched.join(stored, on, "left_semi").select(self.tie).distinct()

    def ingest(self, batch: DataFrame, batch_id: str) -> DataFrame:
        """The rows of ``batch`` that are the first delivery of their identifier; they are stored.

        Of copies within the batch the earliest stays (ties: smallest ``tie``).  A
        ``batch_id`` that is stored already gets the rows it got then.
        """
        version, state = self._state()
        kinds = {f.name: f.dataType.simpleString() for f in batch.schema.fields}
        schema = f"h long, bucket int, `tie` {kinds[self.tie]}, " + ", ".join(f"`k_{k}` {kinds[k]}" for k in self.keys)
        if batch_id not in state["batches"]:
            once = kept_deliveries(batch, self.keys, self.arrived, self.tie)
            bucket = F.coalesce(bucket_of(self.arrived, self.seconds).cast("int"), F.lit(-1))
            marked = once.select(*self.keys, self.tie, F.xxhash64(*self.keys).alias("h")).withColumn("segment", self._segment())
            fresh = once.join(self._known(marked, state, schema), self.tie, "left_anti") if state["batches"] else once
            name = f"batch={uuid.uuid4().hex}"
            new = fresh.select(F.xxhash64(*self.keys).alias("h"), bucket.alias("bucket"), F.col(self.tie).alias("tie"), *[F.col(k).alias(f"k_{k}") for k in self.keys])
            new.repartition("bucket", F.pmod("h", F.lit(self.segments))).write.partitionBy("bucket").parquet(f"{self.folder}/ids/{name}")
            written = self._table([f"ids/{name}"], schema).select("bucket", "h").withColumn("segment", self._segment())
            grouped = written.repartition("bucket", "segment").sortWithinPartitions("bucket", "segment")
            grouped.mapInArrow(_fill(self.bits), _FILTER).write.parquet(f"{self.folder}/filters/{name}")
            state["batches"][batch_id] = f"ids/{name}"
            state["filters"].append(f"filters/{name}")
            self._commit(version + 1, state)
        stored = self._table([state["batches"][batch_id]], schema).select(F.col("tie").alias(self.tie))
        return batch.join(stored, self.tie, "left_semi")

    def compact(self) -> None:
        """One filter for each bucket and segment again, instead of one for each batch too."""
        version, state = self._state()
        name = f"filters/batch={uuid.uuid4().hex}"
        merged = self._table(state["filters"], _FILTER).repartition("bucket", "segment").sortWithinPartitions("bucket", "segment")
        merged.mapInArrow(_merge, _FILTER).write.parquet(f"{self.folder}/{name}")
        self._commit(version + 1, {**state, "filters": [name]})

    def vacuum(self) -> None:
        """Removes folders that no state needs: of batches that died and of filters that were merged."""
        version, state = self._state()
        live = {*state["batches"].values(), *state["filters"]}
        for kind in ("ids", "filters"):
            for name in self.files.names(kind):
                if f"{kind}/{name}" not in live:
                    self.files.delete(f"{kind}/{name}")
        for name in self.files.names("state"):
            if name != f"{version:012d}.json":
                self.files.delete(f"state/{name}")


_FILTER_ARROW = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("bits", pa.binary())])


def _filters(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())], schema=_FILTER_ARROW)


def _fill(bits: int):
    """The filter of each bucket and segment; the rows come sorted by them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(bits // 8, np.uint8)
        for table in blocks(batches):
            bucket, segment, h = (table[c].to_numpy() for c in ("bucket", "segment", "h"))
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(segment) != 0)) + 1
            for rows in np.split(np.arange(len(h)), cuts):
                now = int(bucket[rows[0]]), int(segment[rows[0]])
                if at is not None and now != at:
                    yield _filters([(*at, held)])
                    held = np.zeros(bits // 8, np.uint8)
                at, places = now, positions(h[rows], bits).ravel()
                np.bitwise_or.at(held, places >> 3, (1 << (places & 7)).astype(np.uint8))
        if at is not None:
            yield _filters([(*at, held)])

    return task


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of one bucket and segment from several batches, by OR; they come sorted by them."""
    at, held = None, None
    for batch in batches:
        for bucket, segment, bits in zip(*(c.to_pylist() for c in batch.columns)):
            more = np.frombuffer(bits, np.uint8)
            if (bucket, segment) != at:
                if at is not None:
                    yield _filters([(*at, held)])
                at, held = (bucket, segment), more
            else:
                held = held | more
    if at is not None:
        yield _filters([(*at, held)])


def _meet(bits: int):
    """Each row once for each bucket whose filter holds its identifier; a segment's filters come before its rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, known = None, {}
        for batch in batches:
            of, is_row = batch.column("segment").to_numpy(), batch.column("bits").is_null().to_numpy(zero_copy_only=False)
            h = batch.column("h")
            for rows in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                if not len(rows):
                    continue
                if of[rows[0]] != segment:
                    segment, known = of[rows[0]], {}
                for i in rows[~is_row[rows]]:
                    bucket, more = batch.column("bucket")[int(i)].as_py(), np.frombuffer(batch.column("bits")[int(i)].as_py(), np.uint8)
                    known[bucket] = known[bucket] | more if bucket in known else more
                mine = rows[is_row[rows]]
                if not len(mine) or not known:
                    continue
                places = positions(h.take(pa.array(mine)).to_numpy(), bits)
                for bucket, held in known.items():
                    hit = np.ones(len(mine), bool)
                    for k in range(HASHES):
                        hit &= held[places[:, k] >> 3] >> (places[:, k] & 7).astype(np.uint8) & 1 > 0
                    if hit.any():
                        found = batch.take(pa.array(mine[hit])).drop_columns(["bits", "bucket"])
                        yield found.append_column("bucket", pa.array(np.full(found.num_rows, bucket, np.int32)))

    return task
