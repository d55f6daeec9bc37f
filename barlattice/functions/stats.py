"""Scalar statistics of the referee: closed forms that need a normal distribution or a small matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np

EULER = 0.5772156649015329
_NORMAL = NormalDist()


def expected_max_sharpe(trials: float, deviation: float, benchmark: float = 0.0) -> float:
    """Expected best of ``trials`` Sharpe ratios without skill; one trial is the benchmark."""
    if trials <= 1:
        return benchmark
    a, b = _NORMAL.inv_cdf(1 - 1 / trials), _NORMAL.inv_cdf(1 - 1 / (trials * math.e))
    return benchmark + deviation * ((1 - EULER) * a + EULER * b)


def probabilistic_sharpe(sharpe: float, benchmark: float, n: int, skew: float, kurtosis: float) -> float:
    """Probability that the true (per period) Sharpe ratio exceeds ``benchmark``; ``kurtosis`` is Pearson's."""
    if n < 2:
        raise ValueError("at least two returns are needed")
    variance = max(1e-12, (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (n - 1))
    return _NORMAL.cdf((sharpe - benchmark) / math.sqrt(variance))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: float, deviation: float | None = None) -> float:
    """Probabilistic Sharpe ratio against the expected best of ``trials``.

    Without the trials' own ``deviation`` the estimate's standard error is used.
    Per-period ratios only: a ratio above 3 in size raises, as it must be annualised.
    """
    if abs(sharpe) > 3:
        raise ValueError("the Sharpe ratio must be per period")
    if deviation is None:
        deviation = math.sqrt(max(1e-12, (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (n - 1)))
    return probabilistic_sharpe(sharpe, expected_max_sharpe(trials, deviation), n, skew, kurtosis)


#: How the spread of the trials' ratios is known.
VARIANCES = ("empirical", "null", "fixed")


def deflated_sharpe_by(
    method: str | None, sharpe: float, n: int, skew: float, kurtosis: float, trials: float, ratios: Sequence[float] = (), deviation: float | None = None, benchmark: float = 0.0
) -> dict[str, float | str]:
    """Deflated Sharpe ratio with the trials' deviation by ``method``.

    ``empirical``: sample deviation of the trials' own ``ratios`` (at least two; the number
    of trials is then at least theirs); ``null``: 1 / sqrt(n - 1); ``fixed``: the given
    ``deviation``.  Without a method the first of empirical, fixed and null that can be
    had.  Result: ``dsr``, ``psr``, ``trials``, ``deviation``, ``expected_max``, ``z`` and ``method``.
    """
    if n < 2 or trials < 1:
        raise ValueError("at least two returns and one trial are needed")
    if method is None:
        method = "empirical" if len(ratios) >= 2 else "null" if deviation is None else "fixed"
    if method == "empirical":
        if len(ratios) < 2:
            raise ValueError("the ratios of at least two trials are needed")
        spread, trials = float(np.std(np.asarray(ratios, float), ddof=1)), max(trials, len(ratios))
    elif method == "null":
        spread = 1 / math.sqrt(n - 1)
    elif method == "fixed":
        if deviation is None:
            raise ValueError("a deviation is needed")
        spread = deviation
    else:
        raise ValueError(f"the method is one of {', '.join(VARIANCES)}")
    best = expected_max_sharpe(trials, spread, benchmark)
    error = math.sqrt(max(1e-12, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (n - 1))
    z = (sharpe - best) / error
    return {"dsr": _NORMAL.cdf(z), "psr": _NORMAL.cdf((sharpe - benchmark) / error), "trials": float(trials), "deviation": spread, "expected_max": best, "z": z, "method": method}


def effective_trials(matrix: np.ndarray, estimator: str = "cluster", threshold: float = 0.95) -> float:
    """Effective number of the trials that a correlation matrix compares: by ``cluster`` count, ``rho_avg`` or ``rank``."""
    c = np.nan_to_num(np.asarray(matrix, float))
    k = len(c)
    if k <= 1:
        return float(k)
    if estimator == "cluster":
        return float(cluster_count(c, threshold))
    if estimator == "rank":
        return effective_rank(c)
    if estimator == "rho_avg":
        mean = min(0.999, max(0.0, float(c[np.triu_indices(k, 1)].mean())))
        return min(float(k), max(1.0, k / (1 + (k - 1) * mean)))
    raise ValueError(f"unknown estimator {estimator}")


def drawdown_by(convention: str, returns: Sequence[float]) -> float:
    """Largest drawdown by the ``nav`` (compounded) or the ``cumsum`` convention (of summed returns, from their first value)."""
    if convention == "nav":
        return max_drawdown(returns)
    if convention != "cumsum":
        raise ValueError(f"unknown convention {convention}")
    path = np.cumsum(np.asarray(returns, float))
    return float((path - np.maximum.accumulate(path)).min()) if len(path) else 0.0


def effective_rank(matrix: np.ndarray) -> float:
    """k squared over the sum of squared correlations; NaN counts as 0; within 1 to k."""
    c = np.nan_to_num(np.asarray(matrix, float))
    k = len(c)
    return float(min(k, max(1.0, k * k / max(1e-12, float((c * c).sum()))))) if k else 0.0


def cluster_count(matrix: np.ndarray, threshold: float = 0.95) -> int:
    """Clusters of complete linkage: two merge while their worst correlation is at least ``threshold``."""
    c = np.nan_to_num(np.asarray(matrix, float))
    groups = [[i] for i in range(len(c))]
    while len(groups) > 1:
        worst = np.full((len(groups), len(groups)), -np.inf)
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                worst[i, j] = c[np.ix_(groups[i], groups[j])].min()
        i, j = np.unravel_index(int(worst.argmax()), worst.shape)
        if worst[i, j] < threshold:
            break
        groups[i] += groups.pop(j)
    return len(groups)


def max_drawdown(returns: Sequence[float]) -> float:
    """Compounded drawdown, peak from 1, equity at least 1e-12; 0 for no returns."""
    if not len(returns):
        return 0.0
    equity = np.maximum(np.cumprod(1 + np.asarray(returns, float)), 1e-12)
    peak = np.maximum.accumulate(np.concatenate([[1.0], equity]))[1:]
    return float(min(0.0, ((equity - peak) / peak).min()))


def gross_for_drawdown(returns: Sequence[float], budget: float = -0.30, tolerance: float = 1e-4) -> float:
    """Largest exposure in 0 to 1 whose drawdown stays within ``budget``, by bisection (the safe end)."""
    r = np.asarray(returns, float)
    if max_drawdown(r) >= budget:
        return 1.0
    low, high = 0.0, 1.0
    while high - low > tolerance:
        middle = (low + high) / 2
        low, high = (middle, high) if max_drawdown(middle * r) >= budget else (low, middle)
    return low
