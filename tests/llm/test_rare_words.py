"""Words beyond the hot ones: gaps of many blocks are filled; one unknown sign does not hide the words of its text."""

import random
from collections import Counter

import pytest

pytest.importorskip("barlattice.llm")
from pyspark.sql import functions as F  # noqa: E402

from barlattice.llm import packing, tokens  # noqa: E402


def test_gaps_of_many_blocks(spark):
    from tokenizers import Tokenizer

    random.seed(3)
    words = [f"w{random.randrange(10**9):x}" for _ in range(400)]
    texts = [" ".join(random.choice(words) if random.random() < 0.2 else random.choice(("the", "ledger", "of")) for _ in range(random.randrange(30))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    want = {i: tuple(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        for limit in (0, 600, 20_000):
            assert {r.doc_id: tuple(r.ids) for r in tokens.encode_documents(df, "doc_id", "text", hot_bytes=limit).collect()} == want
        assert {r.doc_id: r.size for r in tokens.token_counts(df, "doc_id", "text", hot_bytes=600).collect()} == {i: len(x) for i, x in want.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_an_unknown_sign_leaves_the_other_words(spark):
    text = "one two\U00012fb1x three͸͸ four ͸ five's it's\n\n͸"
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tokens.words_of(F.col("text")).alias("w")).first().w == ["one", " two\U00012fb1x", " three͸͸", " four", " ͸", " five", "'s", " it", "'s", "\n", "\n", "͸"]


def test_hot_words_fit_the_size(spark):
    table = spark.createDataFrame([(f"w{i}", [1], n) for i, n in enumerate([1] * 50 + [2] * 20 + [9] * 5)], "word string, ids array<int>, n long")
    size = [r.s for r in table.select((F.octet_length("word") + 8 + 64).alias("s")).collect()]
    assert tokens._hot(table, sum(size)) == (1, False)
    assert tokens._hot(table, sum(size) - 1) == (2, True)
    assert tokens._hot(table, sum(size[70:])) == (8, True)
    assert tokens._hot(table, 10) == (1 << 62, True)


def test_ranks_are_numbers_without_gaps_in_each_size(spark):
    rows = [(i, 5 if i % 3 else 30) for i in range(500)]
    items = spark.createDataFrame(rows, "doc_id long, size long").repartition(7)
    packs = spark.createDataFrame([(1, 12), (2, 30)], "pack_id long, capacity long")
    used = Counter()
    for r in packing.pack(items, packs).collect():
        used[r.pack_id, r.container_id] += r.n_tokens
    assert max(v for (p, _), v in used.items() if p == 1) == 12 and sum(v for (p, _), v in used.items() if p == 2) == sum(s for _, s in rows)
    with pytest.raises(ValueError):
        packing.pack(items, packs.withColumn("capacity", F.lit(1 << 40)))


def test_the_fill_report_counts_what_the_containers_hold(spark):
    rows = [(i, s) for i, s in enumerate([12, 7, 5, 5, 3, 40, 0, 11])]
    items = spark.createDataFrame(rows, "doc_id long, size long").repartition(3)
    packs = spark.createDataFrame([(1, 12), (2, 30)], "pack_id long, capacity long")
    packed = packing.pack(items, packs)
    used = Counter()
    for r in packed.collect():
        used[r.pack_id, r.container_id] += r.n_tokens
    got = {r.pack_id: r for r in packing.fill_report(packed, packs).collect()}
    for p, capacity in ((1, 12), (2, 30)):
        mine = [v for (q, _), v in used.items() if q == p]
        assert (got[p].containers, got[p].tokens, got[p].most) == (len(mine), 83, max(mine))
        assert got[p].unused == len(mine) * capacity - 83 and max(mine) <= capacity
