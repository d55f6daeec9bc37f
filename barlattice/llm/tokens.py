"""Encoding a corpus with a public tokenizer through a table of distinct words (problem 8).

Spark splits the texts into words with the tokenizer's own pattern; each distinct
word is encoded once; the ids come back by a join on the word and are put in
order by position.  Decoding joins ids with the pieces of the vocabulary.

The join has two parts.  The most frequent words, as many as fit a fixed size, go
to the workers and are looked up where the documents are.  Of the others only the
distinct ones of a block of documents are shuffled to the table; their ids return
to the block and fill the gaps.  A block is at most one Arrow batch.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.session import cut_lineage, shared_folder

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("BARLATTICE_TOKENIZERS", "/opt/tokenizers")
#: The pre-tokenizer's words, as a Java pattern: contractions, letters, numbers, other signs, white space.
_WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD = r"(?U)" + _WORD
#: The same for texts with signs that Java's Unicode tables do not know: what is between white space and holds one stays whole.
WORD_OR_UNKNOWN = r"(?U) ?(?=\S*\p{Cn})\S+|" + _WORD
#: The most frequent words go to the workers up to this size.
HOT_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """The words of a text; null and empty texts have none.

    What is between white space and holds a character that Java's Unicode tables do
    not know yet stays whole: the tokenizer, which may know it as a letter, splits
    it itself.  No word of the tokenizer reaches across that white space.
    """
    given = F.coalesce(text, F.lit(""))
    pattern = F.when(given.rlike(r"\p{Cn}"), F.regexp_extract_all(given, F.lit(WORD_OR_UNKNOWN), F.lit(0)))
    return pattern.otherwise(F.regexp_extract_all(given, F.lit(WORD), F.lit(0)))


def _encode(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            ids = [e.ids for e in tokenizer.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(1)], names=["word", "ids", "n"])

    return task


def word_table(words: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``word``, ``ids``, ``n`` (occurrences) of each distinct word of column ``words`` (array), kept in the checkpoint folder.

    Words are counted before they are shuffled, so a word of any frequency is one row of each task.
    """
    counted = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(counted.mapInArrow(_encode(f"{folder}/{tokenizer}.json"), "word string, ids array<int>, n long"))


def _hot(table: DataFrame, limit: int) -> tuple[int, bool]:
    """(least frequency of a hot word, whether there are others), so that hot words take at most ``limit`` bytes."""
    size = F.octet_length("word") + 8 * F.size("ids") + 64
    # at most one row for each power of two
    sizes = {int(r[0]): int(r[1]) for r in table.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.sum(size)).collect()}
    taken, least = 0, None
    for e in sorted(sizes, reverse=True):
        if taken + sizes[e] > limit:
            return (1 << 62 if least is None else 1 << least), True
        taken, least = taken + sizes[e], e
    return 1, False


def _shared(table: DataFrame):
    """The hot words as one Arrow buffer for the workers; their size was checked."""
    arrow = table.select("word", "ids").toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, arrow.schema) as writer:
        writer.write_table(arrow)
    return table.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


class _Table:
    """Words with their values (ids, or how many), for looking up the distinct words of a batch."""

    def __init__(self, words: pa.Array, ids: pa.Array, counts_only: bool):
        self.place = dict(zip(words.to_pylist(), range(len(words))))
        lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = lengths.astype(np.int32) if counts_only else ids.flatten().to_numpy()
        self.lengths = np.ones(len(words), np.int64) if counts_only else lengths
        self.starts = np.cumsum(self.lengths) - self.lengths


def _expand(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def _lookup(shared, counts_only: bool, others: bool):
    """Rows (id, words) to (id, ids, block, rare).

    Words that are not hot leave a gap: -1 less their place among the distinct rare
    words of the block, which come out in a row of their own (``rare``).  A row
    without gaps has no block.  For counts ``ids`` holds a count for each word.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hot = pa.ipc.open_stream(shared.value).read_all()
        words, ids = (pa.concat_arrays(hot[c].chunks) if hot[c].num_chunks else pa.array([], hot[c].type) for c in ("word", "ids"))
        table = _Table(words, ids, counts_only)
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
            coded = lists.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            at = np.fromiter((table.place.get(w, -1) for w in distinct), np.int64, len(distinct))
            gaps = np.flatnonzero(at < 0)
            if len(gaps) and not others:
                raise ValueError("a word is missing in the word table")
            # the gaps follow the table's values, one place each
            values = np.concatenate([table.values, -1 - np.arange(len(gaps), dtype=np.int32)])
            starts, lengths = np.empty(len(distinct), np.int64), np.ones(len(distinct), np.int64)
            known = at >= 0
            starts[known], lengths[known] = table.starts[at[known]], table.lengths[at[known]]
            starts[gaps] = len(table.values) + np.arange(len(gaps))
            of = coded.indices.to_numpy()
            size = lengths[of]
            found = _lists(_expand(values, starts[of], size), np.concatenate([[0], np.cumsum(size)])[ends])
            if not others:
                yield pa.record_batch([batch.column(0), found], names=["id", "ids"])
                continue
            open_ = np.diff(np.concatenate([[0], np.cumsum(~known[of])])[ends]) > 0
            block = pa.array(np.full(len(open_), first + number), pa.int64(), mask=~open_)
            yield pa.record_batch([batch.column(0), found, block, pa.nulls(len(open_), pa.list_(pa.string()))], names=["id", "ids", "block", "rare"])
            if len(gaps):
                rare = pa.array([[distinct[i] for i in gaps]], pa.list_(pa.string()))
                yield pa.record_batch([pa.nulls(1, batch.column(0).type), pa.nulls(1, found.type), pa.array([first + number], pa.int64()), rare], names=["id", "ids", "block", "rare"])

    return task


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, ids, block, found) to (id, ids) without gaps; a block's ``found`` comes before its rows."""
    block, values, starts, lengths = None, None, None, None
    for batch in batches:
        of = batch.column("block").to_numpy()
        for rows in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
            if not len(rows):
                continue
            a, n = int(rows[0]), len(rows)
            if of[a] != block:
                block, told = of[a], pa.concat_arrays([batch.column("found").slice(a, 1).flatten()])
                order = np.argsort(told.field("k").to_numpy(zero_copy_only=False))
                ids = told.field("ids").take(pa.array(order))
                lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
                values, starts = ids.flatten().to_numpy(), np.cumsum(lengths) - lengths
                a, n = a + 1, n - 1
            if not n:
                continue
            lists = batch.column("ids").slice(a, n)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
            flat = lists.flatten().to_numpy()
            gap = flat < 0
            size, at = np.ones(len(flat), np.int64), np.arange(len(flat))
            size[gap], at[gap] = lengths[-1 - flat[gap]], len(flat) + starts[-1 - flat[gap]]
            found = _lists(_expand(np.concatenate([flat, values]), at, size), np.concatenate([[0], np.cumsum(size)])[ends])
            yield pa.record_batch([batch.column("id").slice(a, n), found], names=["id", "ids"])


def _encoded(documents: DataFrame, identifier: str, text: str, tokenizer: str, folder: str, hot_bytes: int, counts_only: bool) -> DataFrame:
    """``id`` and ``ids`` (or a count for each word) of each row."""
    rows = documents.select(F.col(identifier).alias("id"), words_of(F.col(text)).alias("words"))
    table = word_table(rows, tokenizer, folder)
    least, others = _hot(table, hot_bytes)
    kind = documents.schema[identifier].dataType.simpleString()
    lookup = _lookup(_shared(table.filter(F.col("n") >= least)), counts_only, others)
    if not others:
        return rows.mapInArrow(lookup, f"id {kind}, ids array<int>")
    # what the blocks hold and ask for is written once; both branches read the same
    kept = shared_folder(documents.sparkSession, "encoded")
    rows.mapInArrow(lookup, f"id {kind}, ids array<int>, block long, rare array<string>").write.parquet(kept)
    stored = documents.sparkSession.read.schema(f"id {kind}, ids array<int>, block long, rare array<string>").parquet(kept)
    asked = stored.filter(F.col("rare").isNotNull()).select("block", F.posexplode("rare").alias("k", "word"))
    values = F.array(F.size("ids")) if counts_only else F.col("ids")
    told = asked.join(table.filter(F.col("n") < least).select("word", values.alias("ids")).hint("shuffle_hash"), "word")
    found = told.groupBy("block").agg(F.collect_list(F.struct("k", "ids")).alias("found"))  # at most the distinct words of a block
    done = stored.filter(F.col("block").isNull() & F.col("rare").isNull()).select("id", "ids")
    gaps = stored.filter(F.col("block").isNotNull() & F.col("rare").isNull()).select("id", "ids", "block", F.lit(None).cast("array<struct<k:int,ids:array<int>>>").alias("found"))
    both = gaps.unionByName(found, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.col("found").isNull())
    return done.unionByName(both.mapInArrow(_fill, f"id {kind}, ids array<int>"))


def encode_documents(
    documents: DataFrame,
    identifier: str,
    text: str,
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """``identifier`` and ``ids`` (array of int) of each row, without special tokens.

    Null and empty texts have the empty list.  Rows with equal identifiers stay
    apart.  Whole texts are encoded; strings of special tokens are ordinary text.

    A text without rare words is done where it is.  Of the others the ids found so
    far are shuffled once by block, and so are the distinct rare words of a block.
    """
    return _encoded(documents, identifier, text, tokenizer, folder, hot_bytes, False).select(F.col("id").alias(identifier), "ids")


def token_counts(
    documents: DataFrame,
    identifier: str,
    text: str,
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """``identifier`` and ``size`` (tokens) of each row; null and empty texts have 0."""
    encoded = _encoded(documents, identifier, text, tokenizer, folder, hot_bytes, True)
    size = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return encoded.select(F.col("id").alias(identifier), size.alias("size"))


def pieces(spark: SparkSession, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``id`` and ``piece`` (bytes) of the vocabulary: a table of fixed size."""
    with open(f"{folder}/{tokenizer}.tiktoken", "rb") as f:
        rows = [(int(rank), bytearray(base64.b64decode(piece))) for piece, rank in map(bytes.split, f)]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_documents(encoded: DataFrame, identifier: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``identifier`` and ``text`` from column ``ids``: the pieces of the ids, joined in order.

    The empty list is the empty text; an id without a piece makes the text null.
    """
    spark = encoded.sparkSession
    rows = encoded.select(identifier, F.monotonically_increasing_id().alias("__row"), "ids").repartition("__row")
    exploded = rows.select(identifier, "__row", F.posexplode_outer("ids").alias("pos", "id"))
    found = exploded.join(F.broadcast(pieces(spark, tokenizer, folder)), "id", "left")  # bounded by the vocabulary
    placed = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", F.hex("piece").alias("h")))))
    lost = F.count_if(F.col("id").isNotNull() & F.col("piece").isNull())
    text = F.decode(F.unhex(F.concat_ws("", F.transform(placed, lambda p: p["h"]))), "UTF-8")
    return found.groupBy("__row", identifier).agg(F.when(lost == 0, text).alias("text")).select(identifier, "text")
