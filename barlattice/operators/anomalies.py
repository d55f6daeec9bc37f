"""Implausible bars (problem 7): a hidden Markov model per source and hard bounds.

A bar is observed as its two-sided excursion (in units of the usual move of its own
series), its volume against the traded bars around it, whether it repeats the
preceding bar, and whether it breaks a bound.  The states are normal (calm or
busy), spike (first and second bar), stuck and out of range: a busy spell may last,
a spike cannot outlast two bars.  Emissions and transitions start from the same
values for all sources and are fitted to each source by expectation and
maximisation; the forward-backward posteriors of the fitted model decide.  A
broken bound and the length of a stuck run are checked exactly beside them.

Series are cut into time shards, so one source may hold any share of the rows.
The bars nearest to a shard on both sides travel to it as a halo, enough of each
kind that is looked at, whatever lies between.  A shard's observations are one row,
kept in the checkpoint folder; its expected counts are added up over the shards of
its source.  All shards of a batch are computed together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.functions.epoch import epoch_ms, floor_div
from barlattice.session import cut_lineage

#: Length of a time shard and bars on each side of it that a shard sees.
SHARD_MS = 8192 * 3_600_000
HALO = 16
#: Traded bars on each side that tell the usual volume; least of them that can.
AROUND, AROUND_LEAST = 12, 3
#: Bars of each kind in a halo, from as far away as they are: any, usable close, high and low, all three prices, traded.
HALO_LEAST = (HALO, HALO, HALO, HALO, HALO, AROUND)
#: Repeats in a row that make a stuck run.
STUCK_RUN = 5
#: Chunk and margin of the forward-backward passes.
CHUNK, MARGIN = 256, 32
#: Rows taken together.
BLOCK_ROWS = 1 << 17
#: Fitting steps, and the weight of the starting values beside a source's own bars: a share of them, and some bars more.
EM_STEPS, PRIOR_SHARE, PRIOR_BARS = 2, 0.5, 200.0

CALM, BUSY, SPIKE, SECOND, STUCK, RANGE = range(6)
STATES = 6
#: Transitions to start from: from calm, busy, spike, its second bar, stuck, out of range.
TRANSITIONS = np.array(
    [
        [0.9890, 0.0060, 0.0020, 0.0, 0.0020, 0.0010],
        [0.1000, 0.8840, 0.0100, 0.0, 0.0030, 0.0030],
        [0.4300, 0.2500, 0.0, 0.2700, 0.0200, 0.0300],
        [0.6595, 0.2800, 0.0005, 0.0, 0.0300, 0.0300],
        [0.1000, 0.0030, 0.0010, 0.0, 0.8950, 0.0010],
        [0.8700, 0.0300, 0.0300, 0.0, 0.0500, 0.0200],
    ]
)
#: Chance of repeating the preceding bar, to start from; the chances of spikes and broken bars are not fitted.
REPEAT = np.array([0.005, 0.005, 0.02, 0.02, 0.99, 0.005])
#: Spread of excursions and of log volume ratios above 0 in calm and in busy bars (half-normal), to start from.
SPREAD = {CALM: (0.7, 0.5), BUSY: (2.5, 0.7)}
#: A spike is about this many usual moves, or times the usual volume, or more: below it its
#: likelihood falls by this power of the ratio, above it as a Pareto tail.
PRICE_TIMES, VOLUME_TIMES, SHARPNESS = 15.0, 20.0, 20.0
#: A volume spike (of a bar or a pair) stands out from the traded bars on both sides by this share of its log ratio:
#: the bars of a longer busy spell do not.  Busy bars reach the spike's numbers at this many spreads only.
STANDS_OUT, SPREADS = 1 / 3, 4.0
IMPOSSIBLE = -60.0


def _shift(x: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """x of the row k before (k < 0: after) in the same group, else NaN."""
    out = np.full(len(x), np.nan)
    if 0 < abs(k) < len(x):
        a, b = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
        out[a] = np.where(group[a] == group[b], x[b], np.nan)
    return out


def _both(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Signed distance from the nearer side, where x is off both in the same direction; else 0."""
    a, b = x - before, x - after
    with np.errstate(invalid="ignore"):
        off = np.sign(a) == np.sign(b)
        return np.where(off, np.sign(a) * np.minimum(np.abs(a), np.abs(b)), 0.0)


def _nanmedian(stack: np.ndarray, least: int) -> np.ndarray:
    """Median along axis 0 without NaN; NaN where fewer than ``least`` values."""
    n = np.isfinite(stack).sum(axis=0)
    s = np.sort(stack, axis=0)  # NaN last
    cols = np.arange(stack.shape[1])
    lo, hi = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, stack.shape[0] - 1)
    return np.where(n >= least, (s[lo, cols] + s[hi, cols]) / 2, np.nan)


def _excursion(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How far a bar, or the pair it is in, is off the bars on both sides; 0 where not."""
    p1, p2, n1, n2 = (_shift(x, group, k) for k in (1, 2, -1, -2))
    one = _both(x, p1, n1)
    first, second = _both(x, p1, n2), _both(x, p2, n1)

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(np.sign(a) == np.sign(b), np.minimum(np.abs(a), np.abs(b)), 0.0)

    pairs = np.fmax(pair(first, _shift(second, group, -1)), pair(second, _shift(first, group, 1)))
    score = np.fmax(np.abs(one), pairs)
    level = _nanmedian(np.stack([_shift(x, group, k) for k in (3, 2, 1, -1, -2, -3)]), 2)
    return np.fmin(score, np.abs(x - level))


def observe(group, close, high, low, volume, scale):
    """(excursion, log volume ratio, repeats, bound broken, stuck run) of rows in order of time by group.

    Missing readings are NaN.  Bars without prices are as if they were not there;
    readings that break a bound are not compared with.
    """
    n = len(group)
    with np.errstate(invalid="ignore"):
        prices = (close <= 0) | (high <= 0) | (low <= 0) | (high < low) | (close < low) | (close > high)
        broken = prices | (volume < 0)
    score = np.zeros(n)
    with np.errstate(invalid="ignore", divide="ignore"):
        for values in (close, high, low):
            at = np.flatnonzero(np.isfinite(values) & (values > 0) & ~prices)
            got = _excursion(np.log(values[at]), group[at]) / scale[at]
            score[at] = np.fmax(score[at], np.where(np.isfinite(got), got, 0.0))

    ratio = np.zeros(n)
    with np.errstate(invalid="ignore"):
        at = np.flatnonzero(np.isfinite(volume) & (volume > 0))
    v, g = np.log(volume[at]), group[at]
    usual = _nanmedian(np.stack([_shift(v, g, k) for k in range(-AROUND, AROUND + 1) if k]), AROUND_LEAST) if len(at) else v
    ratio[at] = np.where(np.isfinite(usual), v - usual, 0.0)

    repeat, run = np.zeros(n, bool), np.zeros(n, bool)
    at = np.flatnonzero(np.isfinite(close) & np.isfinite(high) & np.isfinite(low))
    g = group[at]
    with np.errstate(invalid="ignore"):
        same = (volume[at] > 0) & (g == np.concatenate([[-1], g[:-1]]) if len(at) else False)
        for x in (close[at], high[at], low[at]):
            same &= x == _shift(x, g, 1)
    repeat[at] = same
    block = np.cumsum(~same)  # a run of repeats shares the number of the row before it
    if len(at):
        run[at] = same & (np.bincount(block, weights=same)[block] >= STUCK_RUN)
    return score, ratio, repeat, broken, run


def stands_out(group, volume, ratio) -> np.ndarray:
    """Whether a bar's volume, or that of the pair it is in, is off the traded bars on both sides, too."""
    out = np.zeros(len(group), bool)
    with np.errstate(invalid="ignore"):
        at = np.flatnonzero(np.isfinite(volume) & (volume > 0))
    off = _excursion(np.log(volume[at]), group[at])
    out[at] = ~(off < STANDS_OUT * ratio[at])  # without neighbours nothing is known
    return out


class Parameters:
    """Transitions and emissions of each of some sources."""

    #: Sums that a source is fitted from: transitions; weight, squared excursion and volume of calm and busy bars; repeats of these; weight and repeats of stuck bars; bars.
    SUMS = STATES * STATES + 6 + 1 + 2 + 1

    def __init__(self, sums: np.ndarray):
        """``sums``: one row of sums for each source; zeros give the values to start from."""
        n = len(sums)
        weight = PRIOR_SHARE * sums[:, -1] + PRIOR_BARS
        usual = np.linalg.matrix_power(TRANSITIONS, 64)[0]
        moves = sums[:, : STATES * STATES].reshape(n, STATES, STATES) + (weight[:, None] * usual)[:, :, None] * TRANSITIONS
        self.transitions = moves / moves.sum(axis=2, keepdims=True)
        at = STATES * STATES
        self.spread = np.empty((n, 2, 2))
        for state in (CALM, BUSY):
            bars = weight * usual[state]
            for k in range(2):
                self.spread[:, state, k] = np.sqrt((bars * SPREAD[state][k] ** 2 + sums[:, at + 3 * state + 1 + k]) / (bars + sums[:, at + 3 * state]))
        self.spread = np.minimum(self.spread, np.array([PRICE_TIMES, np.log(VOLUME_TIMES)]) / SPREADS)
        self.spread[:, BUSY] = np.maximum(self.spread[:, BUSY], self.spread[:, CALM])  # busy bars are not calmer
        normal, stuck = weight * (usual[CALM] + usual[BUSY]), weight * usual[STUCK]
        self.repeat = np.tile(REPEAT, (n, 1))
        common = (normal * REPEAT[CALM] + sums[:, at + 6]) / (normal + sums[:, at] + sums[:, at + 3])
        self.repeat[:, CALM] = self.repeat[:, BUSY] = common
        self.repeat[:, STUCK] = (stuck * REPEAT[STUCK] + sums[:, at + 8]) / (stuck + sums[:, at + 7])

    def emissions(self, group, score, ratio, repeat, broken, alone=None) -> np.ndarray:
        """Log likelihood of each row in each state; ``group`` is the number of its source, ``alone`` tells ``stands_out``."""
        up = np.maximum(ratio, 0.0)
        spread = self.spread[group]
        with np.errstate(divide="ignore"):
            x, y = np.log(score / PRICE_TIMES), up - np.log(VOLUME_TIMES)
        price = -np.log(PRICE_TIMES) + np.where(x < 0, np.maximum(SHARPNESS * x, 2 * IMPOSSIBLE), -2.0 * x)
        volume = np.log(0.5) + np.where(y < 0, SHARPNESS * y, -0.5 * y)
        if alone is not None:
            volume = np.where(alone, volume, 2 * IMPOSSIBLE)

        def half_normal(v: np.ndarray, sigma: np.ndarray) -> np.ndarray:
            return 0.5 * np.log(2 / np.pi) - np.log(sigma) - 0.5 * (v / sigma) ** 2

        moved = {s: half_normal(score, spread[:, s, 0]) for s in (CALM, BUSY)}
        traded = {s: half_normal(up, spread[:, s, 1]) for s in (CALM, BUSY)}
        out = np.empty((len(score), STATES))
        out[:, CALM] = out[:, STUCK] = moved[CALM] + traded[CALM]
        out[:, BUSY] = moved[BUSY] + traded[BUSY]
        # in price, in volume or in both
        out[:, SPIKE] = np.logaddexp(np.logaddexp(price + traded[BUSY], volume + moved[BUSY]), price + volume) - np.log(3.0)
        out[:, SECOND] = out[:, SPIKE]
        chance = self.repeat[group]
        out += np.where(repeat[:, None], np.log(chance), np.log(1 - chance))
        out[:, RANGE] = IMPOSSIBLE
        out[broken] = IMPOSSIBLE
        out[broken, RANGE] = 0.0
        return out


def posteriors(group: np.ndarray, logs: np.ndarray, transitions: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors of the rows, expected transitions of each group into its rows marked in ``count``).

    Sequences are rows of equal ``group`` (0, 1, ...; in order), each with its own ``transitions``.
    Long sequences are cut into chunks with a margin of neighbours on both sides;
    chunks of like length are computed together.
    """
    n = len(group)
    result, moves = np.zeros((n, STATES)), np.zeros((len(transitions), STATES, STATES))
    if not n:
        return result, moves
    count = np.ones(n, bool) if count is None else count
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    ends = np.concatenate([starts[1:], [n]])
    pieces = [(max(s, c - MARGIN), c, min(c + CHUNK, e), min(e, c + CHUNK + MARGIN)) for s, e in zip(starts, ends) for c in range(s, e, CHUNK)]
    pieces.sort(key=lambda p: p[3] - p[0])
    shifted = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -300.0))
    i = 0
    while i < len(pieces):
        longest = pieces[i][3] - pieces[i][0]
        j = i
        while j < len(pieces) and pieces[j][3] - pieces[j][0] <= longest * 1.25 + 8 and j - i < 512:
            j += 1
        part = np.array(pieces[i:j])
        length = part[:, 3] - part[:, 0]
        t = int(length.max())
        at = part[:, :1] + np.minimum(np.arange(t), length[:, None] - 1)
        inside = np.arange(t) < length[:, None]
        core = inside & (at >= part[:, 1:2]) & (at < part[:, 2:3])
        into = core & count[at]
        e = np.where(inside[:, :, None], shifted[at], 1.0)
        of = group[part[:, 0]]
        move = transitions[of]
        forward = np.empty((j - i, t, STATES))
        now = np.linalg.matrix_power(move, 64)[:, 0] * e[:, 0]
        forward[:, 0] = now = now / now.sum(axis=1, keepdims=True)
        for k in range(1, t):
            now = (now[:, None, :] @ move)[:, 0] * e[:, k]
            now /= now.sum(axis=1, keepdims=True)
            forward[:, k] = now
        back, seen = np.ones((j - i, STATES)), np.zeros((j - i, STATES, STATES))
        for k in range(t - 1, -1, -1):
            if k:
                ahead = back * e[:, k]
                pair = forward[:, k - 1, :, None] * move * ahead[:, None, :]
                seen += pair * (into[:, k] / pair.sum(axis=(1, 2)))[:, None, None]
            forward[:, k] *= back
            if k:
                back = (move @ ahead[:, :, None])[:, :, 0]
                back /= back.sum(axis=1, keepdims=True)
        got = forward[core]
        result[at[core]] = got / got.sum(axis=1, keepdims=True)
        np.add.at(moves, of, seen)
        i = j
    return result, moves


_OUT = pa.schema(
    [
        ("universe_id", pa.string()),
        ("symbol", pa.string()),
        ("open_ms", pa.int64()),
        ("p_spike", pa.float64()),
        ("p_stuck", pa.float64()),
        ("flag", pa.string()),
    ]
)
_OUT_DDL = "universe_id string, symbol string, open_ms long, p_spike double, p_stuck double, flag string"
_SERIES = ("u", "un", "s", "sn")
_KEYS = (*_SERIES, "shard")
_NUMBERS = ("close", "high", "low", "volume")


def _doubles(column) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def _named(block: pa.RecordBatch, name: str, null: str) -> pa.Array:
    """A key column with its nulls."""
    # by way of a dictionary: a new array without offsets into the sliced batches
    coded = pa.concat_arrays([block.column(name).cast(pa.string())]).dictionary_encode()
    return coded.dictionary.take(pa.array(coded.indices.to_numpy(), mask=block.column(null).to_numpy(zero_copy_only=False)))


_OBSERVED_DDL = "u string, un boolean, s string, sn boolean, shard long, first int, ms binary, score binary, ratio binary, bits binary"
_REPEAT_BIT, _BROKEN_BIT, _RUN_BIT, _ALONE_BIT = 1, 2, 4, 8


def _observe(table: pa.Table) -> pa.RecordBatch:
    """One row for each shard: the observations of its halo and its bars in order of time; ``first`` is the place of its first bar."""
    table = table.combine_chunks()
    n = table.num_rows
    change = np.zeros(n, bool)
    change[0] = True
    for name in _KEYS:
        c = table[name]
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy()
    group = np.cumsum(change) - 1
    ms = table["ms"].to_numpy().astype(np.int64)
    data = {c: _doubles(table[c]) for c in _NUMBERS}
    scale = _doubles(table["scale"])[np.flatnonzero(change)]  # on the first row of its shard
    own = np.ones(n, bool)

    halo_group, halo = [], []
    for side in ("before", "after"):
        lists = table[side]
        for i in np.flatnonzero(pc.fill_null(pc.list_value_length(lists), 0).to_numpy() > 0):
            for r in lists[int(i)].as_py():
                halo_group.append(group[i])
                halo.append([r["ms"], *[np.nan if r[c] is None else r[c] for c in _NUMBERS]])
    if halo:
        extra = np.array(halo, dtype=np.float64)
        group = np.concatenate([group, np.array(halo_group, dtype=group.dtype)])
        ms = np.concatenate([ms, extra[:, 0].astype(np.int64)])
        for k, c in enumerate(_NUMBERS):
            data[c] = np.concatenate([data[c], extra[:, k + 1]])
        own = np.concatenate([own, np.zeros(len(halo), bool)])
    order = np.lexsort((ms, group))
    group, own, ms = group[order], own[order], ms[order]
    data = {c: x[order] for c, x in data.items()}

    score, ratio, repeat, broken, run = observe(group, *[data[c] for c in _NUMBERS], scale[group])
    alone = stands_out(group, data["volume"], ratio)
    bits = (repeat * _REPEAT_BIT + broken * _BROKEN_BIT + run * _RUN_BIT + alone * _ALONE_BIT).astype(np.uint8)
    score, ratio = score.astype(np.float32), ratio.astype(np.float32)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    columns: dict[str, list] = {"first": [], "ms": [], "score": [], "ratio": [], "bits": []}
    for a, b in zip(starts, starts[1:]):
        columns["first"].append(int(np.argmax(own[a:b])))
        columns["ms"].append(ms[a:b][own[a:b]].tobytes())
        for name, values in (("score", score), ("ratio", ratio), ("bits", bits)):
            columns[name].append(values[a:b].tobytes())
    keys = [pa.concat_arrays(table[k].chunks).take(pa.array(np.flatnonzero(change))) for k in _KEYS]
    return pa.record_batch([*keys, pa.array(columns["first"], pa.int32()), *[pa.array(columns[c], pa.binary()) for c in ("ms", "score", "ratio", "bits")]], names=[*_KEYS, *columns])


def _observe_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Observes whole shards, a block of rows at a time; the rows come sorted by shard."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        # the last shard may go on in the next batch: keep it
        starts = np.flatnonzero(table["rn"].to_numpy() == 1)
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield _observe(table.slice(0, cut))
            table = table.slice(cut)
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield _observe(pa.Table.from_batches(held))


class _Shards:
    """The observations of some shards, with the parameters of their sources."""

    def __init__(self, batch: pa.RecordBatch):
        def joined(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(x.as_py() for x in batch.column(name)), kind)

        self.ms, bits = joined("ms", np.int64), joined("bits", np.uint8)
        self.score, self.ratio = joined("score", np.float32).astype(float), joined("ratio", np.float32).astype(float)
        self.repeat, self.broken, self.run, self.alone = (bits & b > 0 for b in (_REPEAT_BIT, _BROKEN_BIT, _RUN_BIT, _ALONE_BIT))
        length = pc.binary_length(batch.column("bits")).to_numpy(zero_copy_only=False).astype(np.int64)
        self.bars = pc.binary_length(batch.column("ms")).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        self.group = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(self.group)) - np.repeat(np.cumsum(length) - length, length)
        first = np.repeat(batch.column("first").to_numpy(), length)
        self.own = (place >= first) & (place < first + np.repeat(self.bars, length))
        sums = batch.column("sums")
        if sums.null_count:
            self.sums = np.zeros((len(length), Parameters.SUMS))
        else:
            self.sums = sums.flatten().to_numpy().reshape(len(length), Parameters.SUMS)

    def posteriors(self) -> tuple[np.ndarray, np.ndarray]:
        p = Parameters(self.sums)
        logs = p.emissions(self.group, self.score, self.ratio, self.repeat, self.broken, self.alone)
        return posteriors(self.group, logs, p.transitions, self.own)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK_ROWS bars."""
    for batch in batches:
        length = pc.binary_length(batch.column("bits")).to_numpy(zero_copy_only=False)
        block = np.cumsum(length) // BLOCK_ROWS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.slice(a, b - a)


_SUMS = [f"s{i}" for i in range(Parameters.SUMS)]
_SUMS_DDL = "u string, un boolean, s string, sn boolean, shard long, " + ", ".join(f"{c} double" for c in _SUMS)


def _expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The expected counts of each shard, of its own bars."""
    for block in _blocks(batches):
        shards = _Shards(block)
        p, moves = shards.posteriors()
        p = p * shards.own[:, None]
        n = block.num_rows

        def total(weight: np.ndarray) -> np.ndarray:
            return np.bincount(shards.group, weights=weight, minlength=n)

        up = np.maximum(shards.ratio, 0.0)
        of = [x for s in (CALM, BUSY) for x in (total(p[:, s]), total(p[:, s] * shards.score**2), total(p[:, s] * up**2))]
        of += [total((p[:, CALM] + p[:, BUSY]) * shards.repeat), total(p[:, STUCK]), total(p[:, STUCK] * shards.repeat), total(shards.own)]
        sums = np.concatenate([moves.reshape(n, -1), np.stack(of, axis=1)], axis=1)
        yield pa.record_batch([*[block.column(k) for k in _KEYS], *[pa.array(c) for c in sums.T]], names=[*_KEYS, *_SUMS])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posteriors and flags of each bar, by the fitted parameters of its source."""
    for block in _blocks(batches):
        shards = _Shards(block)
        p = shards.posteriors()[0][shards.own]
        spike = p[:, SPIKE] + p[:, SECOND]
        flag = np.full(len(p), None, dtype=object)
        flag[spike > 0.5] = "spike"
        flag[(p[:, STUCK] > 0.5) & shards.run[shards.own]] = "stuck"  # an exact check: the length of the run
        flag[p[:, RANGE] > 0.5] = "range"
        at = pa.array(np.repeat(np.arange(block.num_rows), shards.bars))
        names = [_named(block, name, null).take(at) for name, null in (("u", "un"), ("s", "sn"))]
        yield pa.record_batch([*names, pa.array(shards.ms), pa.array(spike), pa.array(p[:, STUCK]), pa.array(flag.tolist(), pa.string())], schema=_OUT)


_HALO = pa.struct([("ms", pa.int64()), *[(c, pa.float64()) for c in _NUMBERS]])
_HALO_ROWS = "array<struct<ms:bigint," + ",".join(f"{c}:double" for c in _NUMBERS) + ">>"
_HALO_DDL = f"u string, un boolean, s string, sn boolean, shard long, before {_HALO_ROWS}, after {_HALO_ROWS}"


def _series_halos(table: pa.Table) -> pa.RecordBatch:
    """The halo of each shard of whole series, given the edges of their shards in order of time."""
    table = table.combine_chunks()
    n = table.num_rows

    def changes(names: tuple[str, ...]) -> np.ndarray:
        new = np.zeros(n, bool)
        new[0] = True
        for name in names:
            c = table[name]
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy()
        return np.flatnonzero(new)

    series, shards = np.append(changes(_SERIES), n), np.append(changes(_KEYS), n)
    first = np.searchsorted(series, shards[:-1], side="right") - 1
    at = [np.flatnonzero(table[f"k{i}"].to_numpy()) for i in range(len(HALO_LEAST))]
    found: dict[str, list[np.ndarray]] = {"before": [], "after": []}
    for low, high, begin, end in zip(shards[:-1], shards[1:], series[first], series[first + 1]):
        for side, a, b in (("before", begin, low), ("after", high, end)):
            parts = []
            for p, least in zip(at, HALO_LEAST) if a < b else ():
                i, j = np.searchsorted(p, (a, b))
                parts.append(p[max(i, j - least) : j] if side == "before" else p[i : min(j, i + least)])
            found[side].append(np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64))
    rows = pa.StructArray.from_arrays([table[f.name].combine_chunks().cast(f.type) for f in _HALO], fields=list(_HALO))
    lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found[side])]), pa.int32()), rows.take(pa.array(np.concatenate(found[side]), pa.int64()))) for side in found]
    own = [table[k].combine_chunks().take(pa.array(shards[:-1], pa.int64())) for k in _KEYS]
    return pa.record_batch([*own, *lists], names=[*_KEYS, "before", "after"])


def _halos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Halos of whole series, a block of rows at a time; the rows come sorted by series and time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < BLOCK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        # the last series may go on in the next batch: keep it
        new = np.zeros(rows, bool)
        for name in _SERIES:
            c = table[name].combine_chunks()
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield _series_halos(table.slice(0, cut))
            table = table.slice(cut)
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield _series_halos(pa.Table.from_batches(held))


def judged_bars(bars: DataFrame, shard_ms: int = SHARD_MS, steps: int = EM_STEPS) -> DataFrame:
    """One row per bar (universe, symbol, instant): ``open_ms``, ``p_spike``, ``p_stuck``, ``flag``.

    ``flag`` is ``range`` for an impossible reading, ``stuck`` for a repeat in a
    stuck run, ``spike`` for a spike of one or two bars in price or volume, else
    null.  Copies of a bar count once (the largest of unequal numbers holds);
    NaN counts as null; null readings are not judged; bars without an instant do
    not come out; null universes and symbols form series of their own.  A series
    whose close never moves has no usual move: its prices cannot spike.

    The bars are shuffled once, by shard.  Each of the ``steps`` of the fit reads the
    kept observations and adds one small row for each shard up over its source.
    """
    ms = epoch_ms(F.col("timestamp_open"))
    # keys without nulls (the flags tell null from empty), so that joins keep the partitioning
    keys = [*_KEYS]
    named = [F.coalesce("universe_id", F.lit("")).alias("u"), F.col("universe_id").isNull().alias("un"), F.coalesce("symbol", F.lit("")).alias("s"), F.col("symbol").isNull().alias("sn")]
    numbers = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in _NUMBERS]
    base = (
        bars.filter(F.col("timestamp_open").isNotNull())
        .select(*named, floor_div(ms, shard_ms).alias("shard"), ms.alias("ms"), *numbers)
        .repartition(*keys)
        .groupBy(*keys, "ms")
        .agg(*[F.max(c).alias(c) for c in _NUMBERS])
    )
    within = Window.partitionBy(*keys)
    timed = within.orderBy("ms")
    base = base.withColumn("rn", F.row_number().over(timed))

    good = (F.col("close") > 0) & ~(F.col("close") > F.col("high")) & ~(F.col("close") < F.col("low"))
    move = F.abs(F.ln("close") - F.lag(F.ln("close")).over(timed))
    scales = (
        base.filter(F.col("close").isNotNull() & F.coalesce(good, F.col("close") > 0))
        .select(*_SERIES, move.alias("move"))
        .filter("move > 0")
        .groupBy(*_SERIES)
        .agg(F.percentile_approx("move", 0.5, 1000).alias("scale"))
    )
    finite = {c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in _NUMBERS}
    broken = F.coalesce((F.least("close", "high", "low") <= 0) | (F.col("high") < F.col("low")) | (F.col("close") < F.col("low")) | (F.col("close") > F.col("high")), F.lit(False))
    kinds = [F.lit(True), *[finite[c] & (F.col(c) > 0) & ~broken for c in _NUMBERS[:3]], finite["close"] & finite["high"] & finite["low"], finite["volume"] & (F.col("volume") > 0)]
    edge = base.select(*keys, "ms", *_NUMBERS, *[k.alias(f"k{i}") for i, k in enumerate(kinds)])
    inside = F.lit(False)
    for i, least in enumerate(HALO_LEAST):
        before = F.count_if(f"k{i}").over(timed.rowsBetween(Window.unboundedPreceding, 0))
        inside = inside | (F.col(f"k{i}") & ((before <= least) | (F.count_if(f"k{i}").over(within) - before < least)))
    edge = edge.withColumn("edge", inside).filter("edge").drop("edge")
    ends = edge.repartition(*_SERIES).sortWithinPartitions(*_SERIES, "ms").mapInArrow(_halos, _HALO_DDL)
    aux = ends.join(scales, [*_SERIES], "left").select(*[F.col(k).alias(f"__{k}") for k in keys], "before", "after", "scale")
    on = F.col("rn") == 1
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    joined = base.join(aux, on, "left").select(*keys, "ms", *_NUMBERS, "rn", "scale", "before", "after")
    observed = cut_lineage(joined.sortWithinPartitions(*keys, "ms").mapInArrow(_observe_task, _OBSERVED_DDL))
    given = observed.withColumn("sums", F.lit(None).cast("array<double>"))
    for _ in range(steps):
        source = Window.partitionBy(*_SERIES)
        counted = given.mapInArrow(_expect, _SUMS_DDL)
        sums = counted.select(*keys, F.array(*[F.sum(c).over(source) for c in _SUMS]).alias("sums"))
        given = observed.join(sums, [*keys])
    return given.mapInArrow(_decide, _OUT_DDL)


def implausible_bars(bars: DataFrame) -> DataFrame:
    """The flagged bars: ``universe_id``, ``symbol``, ``open_ms``, ``flag``."""
    return judged_bars(bars).filter(F.col("flag").isNotNull()).select("universe_id", "symbol", "open_ms", "flag")
