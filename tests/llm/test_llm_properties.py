"""Properties of the text operators that hold for any input."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("barlattice.llm")

from barlattice.llm import canonical, packing, sentences  # noqa: E402

MODEL = sentences.Model(sentences.Stats({}), np.zeros(sentences.WEIGHTS + 1))
anything = st.text(alphabet=st.sampled_from("aAbB1 .!?\n\r\t\"'“”„«»()-*。！？“”…ไทยक।د؟🙂  "), max_size=120)


@given(anything)
@settings(max_examples=300)
def test_sentences_cover_every_sign_once(text):
    spans = sentences.sentences(text, MODEL)
    assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    inside = {i for a, b in spans for i in range(a, b)}
    assert all(i in inside for i, ch in enumerate(text) if not ch.isspace())
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


@given(st.integers(3, 200), st.data())
@settings(max_examples=100)
def test_no_container_overflows(capacity, data):
    sizes = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    slots, made = packing.plan(capacity, dict(Counter(sizes)))
    by, used = defaultdict(list), Counter()
    for s, start, first, each in slots:
        by[s].append((start, first, each))
    for s, n in Counter(sizes).items():
        for rank in range(n):
            start, first, each = max(x for x in by[s] if x[0] <= rank)
            used[first + (rank - start) // each] += s
    assert len(used) == made and all(u <= capacity for u in used.values()) and sum(used.values()) == sum(sizes)


@given(st.text(max_size=60))
def test_squashing_twice_changes_nothing(text):
    once = canonical.squash(text)
    assert canonical.squash(once) == once


@given(st.dictionaries(st.sampled_from(["fast", "slow", "gain", "cap"]), st.integers(0, 99), min_size=1), st.randoms())
def test_order_and_layout_of_fields_do_not_matter(fields, random):
    items = list(fields.items())
    a = "{" + ", ".join(f'"{k}": {v}' for k, v in items) + "}"
    random.shuffle(items)
    b = ";\n".join(f"{k.upper()} = {v}" for k, v in items)
    assert canonical.canonical_code(a) == canonical.canonical_code(b)
