"""A case in which sentences once did less than the whole job."""

import pytest

pytest.importorskip("regex")
from barlattice.llm import sentences  # noqa: E402


def test_types_beyond_the_broadcast_count_as_well(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    few, all_types = sentences.corpus_stats(documents, "text", 20), sentences.corpus_stats(documents, "text")
    assert len(few.rows) == 20 < len(all_types.rows) and few.rest.count() == len(all_types.rows)
    assert (few.base, few.start) == (all_types.base, all_types.start)
    units = [sorted(map(tuple, sentences.sentence_units(documents, "doc_id", "text", n).collect())) for n in (20, sentences.MAX_TYPES)]
    assert units[0] == units[1]
