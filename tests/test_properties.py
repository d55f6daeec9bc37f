"""Properties that hold for any input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barlattice.functions import stats
from barlattice.operators import anomalies, dedupe, nulls, rejects

returns = st.lists(st.floats(-0.9, 2.0), min_size=1, max_size=60)


@given(returns)
def test_a_drawdown_lies_between_minus_one_and_zero(r):
    assert -1 <= stats.max_drawdown(r) <= 0


@given(returns, st.floats(-0.9, -0.05))
@settings(max_examples=50)
def test_the_exposure_found_keeps_the_budget(r, budget):
    g = stats.gross_for_drawdown(r, budget)
    assert 0 <= g <= 1 and stats.max_drawdown(g * np.asarray(r)) >= budget - 1e-12


@given(st.integers(1, 12), st.integers(0, 10**6), st.floats(0.1, 0.99))
def test_effective_trials_stay_within_bounds(k, seed, threshold):
    m = np.corrcoef(np.random.default_rng(seed).normal(size=(k, 30))).reshape(k, k)
    assert 1 <= stats.cluster_count(m, threshold) <= k and 1 <= stats.effective_rank(m) <= k


@given(st.integers(0, 200), st.floats(1, 50), st.integers(0, 10**6))
def test_blocks_stay_inside_and_go_on(n, length, seed):
    at = nulls.block_indices(n, length, np.random.default_rng(seed))
    assert len(at) == n and all(0 <= x < n for x in at)


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300), st.integers(1, 4))
@settings(max_examples=40)
def test_filters_never_miss_a_repeat(ids, buckets):
    h = np.array(ids, np.int64)
    bucket = np.arange(len(h)) % buckets
    found = dedupe.matches(bucket, h, dedupe.filter_bits(len(h))) != 0
    values, counts = np.unique(h, return_counts=True)
    assert found[np.isin(h, values[counts > 1])].all()


@given(st.integers(1, 700), st.integers(0, 10**6))
@settings(max_examples=25)
def test_posteriors_are_probabilities_in_any_chunking(n, seed):
    rng = np.random.default_rng(seed)
    group = np.sort(rng.integers(0, 4, n))
    p, moves = anomalies.posteriors(group, rng.normal(0, 3, (n, anomalies.STATES)), np.stack([anomalies.TRANSITIONS] * 4))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert np.isclose(moves.sum(), n - len(np.unique(group)))


@given(st.text(alphabet='a1,". \t', max_size=40))
def test_a_record_is_split_as_the_grammar_says(line):
    fields = rejects.split_record(line)
    if fields is not None:
        again = ",".join('"' + f.replace('"', '""') + '"' if any(c in f for c in '",') else f for f in fields)
        assert rejects.split_record(again) == fields
    else:
        assert '"' in line
