"""Statistics and the sample of problem 10: whole tokens count, the sample is bounded and does not depend on partitions."""

import pytest

pytest.importorskip("barlattice.llm")
from barlattice.llm import sentences  # noqa: E402


def test_long_tokens_are_types_of_their_own():
    a, b = "w" * 60 + "a", "w" * 60 + "b"
    assert sentences._kind(a) != sentences._kind(b) and len(sentences._kind(a * 1000)) <= 48
    assert sentences._word(a) != sentences._word(b)
    text = "x" * 5000 + ". Next one"
    assert sentences._token_before(text, 5000, 0) == "x" * 5000 and sentences._word_after("a. " + "y" * 500, 2, 503) == "y" * 500


def test_counts_by_hand():
    counts = sentences._Counts()
    counts.add("Dr. Foo went. It was 12.5 pts. in all! Yes.\n\n. odd ... end.")
    rows = counts.rows()
    assert rows["dr"][:2] == [1, 0] and rows["went"][:2] == [1, 0] and rows["yes"][:2] == [1, 1] and rows["end"][:2] == [1, 1] and rows["pts"][:2] == [1, 0]
    assert rows["^Dr"][2:] == [1, 0, 0] and rows["^Foo"][2:] == [0, 0, 1] and rows["^It"][2:] == [0, 0, 1] and rows["^Yes"][2:] == [1, 0, 0]
    assert "" not in rows


def test_the_sample_is_bounded_and_the_same_in_any_partitioning(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    stats = sentences.corpus_stats(documents, "text")
    weights = [sentences.train(d, "doc_id", "text", stats, 60, 100_000) for d in (documents.repartition(1), documents.repartition(5))]
    assert weights[0].any() and abs(weights[0] - weights[1]).max() < 1e-6


def test_every_candidate_is_classified_by_the_model(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    stats = sentences.corpus_stats(documents, "text")
    model = sentences.Model(stats, sentences.train(documents, "doc_id", "text", stats))
    for (text,) in documents.select("text").collect():
        if text:
            sentences.sentences(text, model)
    told = {d: t for d, t in model.layouts.items() if t is not None}
    fitted = {d for d in told if model.weights[sentences._indices(sentences.layout_features(d))[0]]}
    assert len(fitted) >= 0.9 * len(told) > 20
    reliable = {d: sentences.reliable_space(d) if d[0] == "space" else sentences.reliable(d) for d in told}
    assert told == reliable and {True, False} <= set(told.values())
    # the weights decide: turned round they say the opposite, and a layout that was not seen is told by itself
    turned = sentences.Model(stats, -model.weights)
    assert all(turned.tells(d) != told[d] for d in fitted)
    unseen = sentences.Model(stats, model.weights * 0)
    assert all(unseen.tells(d) == reliable[d] for d in told)
