"""Sentence boundaries across languages and scripts (problem 10).

Blank lines, headings and list items cut a text into blocks.  Marks that could end
a sentence, and spaces in Thai, are candidates; each is classified by one
maximum-entropy model.  Its features are the neighbouring tokens, case, length,
digits and script, and the layout of the place (mark, space, quotes, what follows).
It is trained on reliable boundaries of the corpus itself: full stops at the end of
a block are boundaries, those before a small letter and places inside a sentence are
none, and so are places whose layout alone tells.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlattice.session import cut_lineage

#: Documents and labelled places that the model is fitted on, at most.
SAMPLE_DOCUMENTS = 4_000
SAMPLE_PLACES = 100_000
#: Token types whose statistics go to the workers, at most: the most frequent; those of the others are joined to the texts that ask for them.
MAX_TYPES = 50_000
#: Weights of the model.
WEIGHTS = 1 << 14

# Signs by their part in a sentence.
MARKS = ".!?…。！？｡．؟।॥۔‼⁇⁈⁉"
WIDE = "。！？｡．"
CLOSERS = "\"'”’“‘»›)]}」』】）》〉"
QUOTES = "\"'”’“‘»›」』"
HIGH = chr(0x201C) + chr(0x2018)
_GO_ON = ",;:،؛、，；：)]}—–-…"

_BLANK = regex.compile(r"(?:\r\n|\n|\r| |\u0085)[^\S\r\n \u0085 ]*(?:(?:\r\n|\n|\r| |\u0085)[^\S\r\n \u0085 ]*)+| \s*")
_LINE = regex.compile(r"[^\r\n \u0085]+")
_ITEM = regex.compile(r"[^\S\r\n]*(?:[-*•‣▪◦·]|(\d{1,3})[.)]|[(](\d{1,3})[)])[^\S\r\n]+\S")
_CJK_CLASS = rf"\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}{chr(0x3000)}-{chr(0x303F)}{chr(0xFF00)}-{chr(0xFFEF)}"
#: Marks that could end a sentence: wide ones, and others before white space, the end or a CJK sign.
_MARK = regex.compile(
    rf"[{regex.escape(MARKS)}]*[{WIDE}][{regex.escape(MARKS)}]*"
    rf"|[{regex.escape(MARKS)}]+(?=[{regex.escape(CLOSERS)}]*(?:\s|\Z|[{_CJK_CLASS}]))"
)
#: A high-low quote closes only where no word follows: elsewhere it opens.
_CLOSE = regex.compile(rf"(?:[{regex.escape(''.join(c for c in CLOSERS if c not in HIGH))}]|[{HIGH}](?!\w)|[^\S\r\n]?[»›](?!\w))*")
_THAI_SPACE = regex.compile(r"(?<=(\S))[^\S\r\n \u0085]+(?=(\S))")
_BEFORE = regex.compile(r"(?r)[^\s(\[{\"'“”‘’„«»‚‹›—–/]*")
_NEXT = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.'’][\p{L}\p{N}]+)*")
_OPENERS = "\"'“‘„«»‚‹(¿¡[「『（"


_THAI = regex.compile(r"\p{Thai}")
_CJK = regex.compile(rf"[{_CJK_CLASS}]")
_LATIN_DIGIT = regex.compile(r"\p{Latin}|\p{Nd}")
_UPPER, _LOWER = regex.compile(r"[\p{Lu}\p{Lt}]"), regex.compile(r"\p{Ll}")
_WORDLIKE = regex.compile(r"[\p{L}\p{N}]")
_DIGITS = re.compile(r"\d+")
#: Types up to this length are written out, longer ones end in a hash.
_WRITTEN = 48
_SCRIPTS = tuple((name, regex.compile(rf"\p{{{name}}}")) for name in ("Latin", "Cyrillic", "Arabic", "Devanagari", "Thai", "Han"))


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): parts between blank lines; a list item is whole, with its mark."""
    at = 0
    spans = []
    for m in _BLANK.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    for a, b in spans:
        lines = [(m.start(), m.end()) for m in _LINE.finditer(text, a, b) if m[0].strip()]
        marks = [_ITEM.match(text, x, y) for x, y in lines]
        if not lines:
            continue
        numbers = [int(m[1] or m[2]) for m in marks if m and (m[1] or m[2])]
        numbered = numbers and numbers == list(range(numbers[0], numbers[0] + len(numbers))) and len(numbers) == len(lines)
        # a lone numbered line may be a sentence that begins with an ordinal
        if marks[0] and (numbered and (len(lines) > 1 or numbers[0] == 1) or not numbers):
            starts = [i for i, m in enumerate(marks) if m]
            for i, j in zip(starts, [*starts[1:], len(lines)]):
                yield lines[i][0], lines[j - 1][1], True
        else:
            yield a, b, False


def _short(kind: str) -> str:
    """A name of a type, of bounded length."""
    return kind if len(kind) <= _WRITTEN else kind[: _WRITTEN // 2] + hashlib.blake2b(kind.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


@lru_cache(maxsize=1 << 16)
def _kind(token: str) -> str:
    """Type of a token: small letters, digits as #."""
    return _short(_DIGITS.sub("#", token.casefold()))


def _token_before(text: str, at: int, low: int) -> str:
    """The token that ends at ``at``, read backwards."""
    return _BEFORE.match(text, low, at)[0]


@lru_cache(maxsize=1 << 16)
def _token_of(stop: str) -> str:
    """The token of a piece between white space that ends in a full stop."""
    return _token_before(stop, len(stop) - 1, 0)


def _word_after(text: str, at: int, high: int) -> str:
    if at < high and text[at] not in ascii_letters:
        while at < high and (text[at].isspace() or text[at] in _OPENERS):
            at += 1
    if text[at : at + 1] in (".", ",") and text[at + 1 : at + 2].isdigit():
        at += 1
    m = _NEXT.match(text, at, high)
    return m[0] if m else text[at : at + 1]


@lru_cache(maxsize=1 << 16)
def _word(word: str) -> str:
    """Type of a word as a beginning: its capitals count."""
    return "^" + _short(_DIGITS.sub("#", word))


def _shape(c: str) -> str:
    if not c:
        return "end"
    if c.islower():
        return "lower"
    if c.isupper() or c.istitle():
        return "upper"
    if c.isdigit():
        return "digit"
    if c in _OPENERS:
        return "open"
    return "letter" if c.isalpha() else "sign"


def _script(c: str) -> str:
    return next((name for name, pattern in _SCRIPTS if pattern.match(c)), "other")


class Candidate:
    """A mark with its closers in a block: ``end`` is after the closers, ``at`` the next sign."""

    __slots__ = ("mark", "dot", "end", "at", "quoted", "spaced")

    def __init__(self, text: str, m: regex.Match, high: int):
        end = m.end()
        self.mark, self.dot, self.quoted = m[0], m.start(), False
        # most marks are followed by a blank and a letter: no closers to look for
        if end < high and not (text[end].isspace() and text[end + 1 : end + 2] not in ("»", "›")):
            closers = _CLOSE.match(text, end, high)[0]
            end += len(closers)
            self.quoted = any(c in QUOTES for c in closers)
        self.end = at = end
        while at < high and text[at].isspace():
            at += 1
        self.spaced, self.at = at > self.end, at


Layout = tuple  # what is seen of a candidate without its words


def describe(text: str, c: Candidate, high: int, small: bool) -> Layout:
    """The mark's class, and what follows it: its shape, quotes, space, whether it goes on with the sentence, scripts.

    ``small``: the document has no capitals, so a small letter tells nothing.
    """
    if c.mark == "." and c.spaced and not c.quoted and c.at < high and text[c.at] in ascii_letters:  # most places
        return ".", "upper" if text[c.at] <= "Z" else "lower", True, False, small, 0, False, False, False
    mark = "." if c.mark == "." else "…" if not c.mark.strip(".…") else "wide" if any(x in WIDE for x in c.mark) else "!"
    if c.at >= high:
        return mark, "end"
    after = text[c.at]
    wide = mark == "wide"
    on = 0 if after not in _GO_ON else 2 if after in "-—–" else 1
    cjk = after > "\u10ff" and _CJK.match(after) is not None
    before = wide and _CJK.match(text[c.dot - 1 : c.dot]) is not None
    return mark, _shape(after), c.spaced, c.quoted, small, on, cjk, before, mark == "…" and small and c.at - c.end > 1


def reliable(d: Layout) -> bool | None:
    """Whether a layout alone tells that a sentence ends, or that none does; None where the words must tell."""
    mark, shape = d[:2]
    if shape == "end":
        return True
    _, _, spaced, quoted, small, on, cjk, before, apart = d
    wide = mark == "wide"
    if not spaced:
        if mark in (".", "…") or not (wide or cjk) or quoted:  # after a quotation the sentence goes on
            return False
        return not on
    if on and not (on == 2 and wide):
        return False
    if before:
        return True
    if mark == ".":
        if shape == "lower" and not small:
            return False
        if quoted and (small or shape in ("upper", "open", "digit")) or cjk:  # another script begins
            return True
        return None
    if mark == "…":
        return apart if small else shape != "lower"
    if shape == "lower":
        return small and not quoted
    return not (quoted and shape == "letter")


def reliable_space(d: Layout) -> bool:
    """The same for a space in Thai text: ``thai`` on a side, a Latin letter or digit on a side, a mark after it."""
    _, thai, latin, mark = d
    return thai and not latin and not mark


def layout_features(d: Layout) -> list[str]:
    """The whole layout first, then its parts."""
    names = ["L*" + "|".join(map(str, d)), f"Lm{d[0]},{d[1]}"]
    if len(d) == 9:
        mark, shape, spaced, quoted, small, on, cjk, before, _ = d
        names += [f"Lq{mark},{shape},{quoted},{small}", f"Lo{mark},{spaced},{on}", f"Lc{mark},{spaced},{cjk},{before}"]
    return names


class Stats:
    """What the corpus tells of token types.

    Tokens: (with a stop, of these at a block's end); words: (at a block's start or
    after a question or exclamation mark, inside, after a stop).
    """

    def __init__(self, rows: dict[str, tuple[int, int, int, int, int]], sums: tuple[int, ...] | None = None, rest: DataFrame | None = None):
        """``rows``: all types, or the most frequent beside the ``sums`` over all and ``rest``, the table of all."""
        self.rows, self.rest = rows, rest
        self.rare: dict[str, tuple[int, int, int, int, int]] = {}  # those of the present text that ``rows`` lacks
        self.named: dict[tuple, list[str]] = {}
        self.sums = tuple(sums) if sums else tuple(sum(r[i] for r in rows.values()) for i in range(5))
        stops, final, starts, _, after = self.sums
        self.base = self._share(final, stops)
        self.start = self._share(starts, starts + after)

    def names(self, make: Callable[..., list[str]], *key) -> list[str]:
        """The features that ``make`` gives for a key, kept for the next time where no rare types matter."""
        if self.rare or self.rest is not None:
            return make(*key, self)
        found = self.named.get((make, *key))
        if found is None:
            if len(self.named) > 200_000:
                self.named.clear()
            found = self.named[(make, *key)] = make(*key, self)
        return found

    def _of(self, kind: str) -> tuple[int, int, int, int, int]:
        return self.rows.get(kind) or self.rare.get(kind, (0, 0, 0, 0, 0))

    @staticmethod
    def _share(k: int, n: int) -> float:
        return min(0.5, max(0.02, k / max(1, n)))

    @staticmethod
    def _ratio(k: int, n: int, base: float, never: float = 0.004) -> int:
        """Bucket of the log likelihood ratio of ``k`` in ``n``: by chance ``base``, or hardly ever."""
        ratio = k * math.log(base / never) + (n - k) * math.log((1 - base) / (1 - never))
        return int(max(-5.0, min(5.0, ratio / 1.5)))

    def final(self, kind: str) -> str:
        """How far the type's stops are found at the end of blocks, against chance."""
        n, k, *_ = self._of(kind)
        return str(self._ratio(k, n, self.base))

    def starter(self, word: str) -> int:
        """How far a word that comes after stops is one that begins sentences."""
        _, _, k, _, m = self._of(word)
        return self._ratio(k, k + m, self.start)

    def begins(self, word: str) -> str:
        _, _, k, n, _ = self._of(word)
        if k + n < 2:
            return "rare"
        share = (k + 0.1) / (k + n + 0.2)
        return str(int(max(-8.0, min(0.0, math.log(share) * 1.5))))


def _token_shape(token: str, kind: str) -> str:
    letters = kind.strip(".")
    if kind == "#":
        return "int2" if len(token) <= 2 else "int"
    if not letters:
        return "sign"
    if "#" in letters:
        return "number"
    if "." in letters:
        return "inner"
    return "one" if len(letters) == 1 else "short" if len(letters) <= 3 else "word"


def before_features(kind: str, shape: str, early: bool, tail: str, stats: Stats) -> list[str]:
    """What lies before a full stop: token type, how often its stops are final, shape, script, length so far."""
    final = stats.final(kind)
    return [
        "k=" + kind,
        "f=" + final,
        "s=" + shape,
        f"sf={shape},{final}",
        "b=" + _script(tail),
        f"es={early},{shape}",
        f"closed={tail in tuple(')%]')}",
    ]


def after_features(word: str, near: bool, stats: Stats) -> list[str]:
    """What lies after it: how often the word begins sentences; ``near``: after a short token or a number."""
    begins, starter = stats.begins(word), stats.starter(word)
    return ["g=" + begins, f"n={starter}", f"d={word[1:2] == '#'}", f"gs={begins},{near}", f"ns={starter},{near}"]


def place(text: str, dot: int, at: int, low: int, high: int, begun: int) -> tuple[str, str, bool, str, str, bool]:
    """(type, shape, early, last sign, next word, near) of a full stop at ``dot``; ``begun``: start of the sentence."""
    kind, shape, tail, near = _token_seen(_BEFORE.match(text, low, dot)[0])
    early = dot - begun < 60 and len(text[begun:dot].split()) <= 3
    return kind, shape, early, tail, _word(_word_after(text, at, high)), near


@lru_cache(maxsize=1 << 16)
def _token_seen(token: str) -> tuple[str, str, str, bool]:
    """(type, shape, last sign, near) of a token."""
    kind = _kind(token)
    shape = _token_shape(token, kind)
    return kind, shape, token[-1:], shape in ("int2", "one", "short", "inner")


def features(text: str, dot: int, at: int, low: int, high: int, begun: int, stats: Stats) -> tuple[list[str], list[str]]:
    """(of what lies before, of what lies after) a full stop."""
    kind, shape, early, tail, word, near = place(text, dot, at, low, high, begun)
    return stats.names(before_features, kind, shape, early, tail), stats.names(after_features, word, near)


class Model:
    """Statistics and weights; sums of weights are kept by what they depend on."""

    def __init__(self, stats: Stats, weights: np.ndarray):
        self.stats, self.weights = stats, weights
        self.layouts: dict[Layout, bool | None] = {}
        self.before: dict[tuple, float] = {}
        self.after: dict[tuple, tuple[float, int]] = {}

    def _sum(self, names: list[str]) -> float:
        return float(self.weights[_indices(names)].sum())

    def tells(self, d: Layout) -> bool | None:
        """Whether a candidate of a reliable layout is a boundary; None for a layout that needs its words."""
        if d not in self.layouts:
            told = reliable_space(d) if d[0] == "space" else reliable(d)
            if told is not None:
                at = _indices(layout_features(d))
                # an exact check: a layout that was not in the sample is told by itself
                told = bool(self.weights[at].sum() + self.weights[-1] > 0) if self.weights[at[0]] else told
            self.layouts[d] = told
        return self.layouts[d]

    def ends(self, text: str, c: Candidate, low: int, high: int, begun: int, small: bool) -> bool:
        """Whether a full stop ends a sentence; a document without capitals is judged by what lies before."""
        kind, shape, early, tail, word, near = place(text, c.dot, c.at, low, high, begun)
        key = (kind, shape, early, tail)
        if (score := self.before.get(key)) is None:
            if len(self.before) > 200_000:
                self.before.clear()
            score = self.before[key] = self._sum(before_features(*key, self.stats))
        if small:
            return score + self.weights[-1] > 0
        if (found := self.after.get((word, near))) is None:
            if len(self.after) > 200_000:
                self.after.clear()
            found = self.after[word, near] = self._sum(after_features(word, near, self.stats)), self.stats.starter(word)
        # an exact check: a number of one or two digits before a word that never begins a sentence is an ordinal
        return score + found[0] + self.weights[-1] > 0 and not (shape == "int2" and found[1] <= -2)


@lru_cache(maxsize=1 << 17)
def _index(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WEIGHTS


def _indices(names: list[str]) -> list[int]:
    return [_index(n) for n in names]


_CAPITAL = regex.compile(r"(?<=[\p{Ll}\p{M}]) (?=\p{Lu})")


def _small(text: str) -> bool:
    return not _UPPER.search(text) and bool(_LOWER.search(text))


def describe_space(m: regex.Match) -> Layout:
    a, b = m[1], m[2]
    return "space", bool(_THAI.match(a) or _THAI.match(b)), bool(_LATIN_DIGIT.match(a) or _LATIN_DIGIT.match(b)), b in MARKS


def split_block(text: str, low: int, high: int, small: bool, thai: bool, model: Model) -> list[tuple[int, int]]:
    """Sentences of a block, with outer white space."""
    ends = set()
    begun = low
    for m in _MARK.finditer(text, low, high):
        c = Candidate(text, m, high)
        if c.end <= begun:
            continue
        told = model.tells(describe(text, c, high, small))
        if told is None:
            told = model.ends(text, c, low, high, begun, small)
        if told:
            ends.add(c.end)
            begun = c.end
    if thai:
        for m in _THAI_SPACE.finditer(text, low, high):
            if model.tells(describe_space(m)):
                ends.add(m.start())
    cuts = [low, *sorted(ends), high]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def sentences(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, without outer white space."""
    if not _WORDLIKE.search(text):  # a few signs are one unit
        a, b = len(text) - len(text.lstrip()), len(text.rstrip())
        return [(a, b)] if a < b else []
    small, thai = _small(text), bool(_THAI.search(text))
    out = []
    for low, high, whole in blocks(text):
        for a, b in [(low, high)] if whole else split_block(text, low, high, small, thai, model):
            part = text[a:b]
            a, b = a + len(part) - len(part.lstrip()), b - (len(part) - len(part.rstrip()))
            if a < b:
                out.append((a, b))
    return out


_COUNTED = ("stops", "final", "starts", "inside", "after")


_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}#]+(?:[.'’][\p{L}\p{N}#]+)*")
_AFTER_MARK = regex.compile(rf"([{regex.escape(MARKS)}]+)[{regex.escape(CLOSERS)}]*\s+[\s{regex.escape(_OPENERS)}]*({_WORDS.pattern})")


class _Counts:
    """Counts of tokens with a stop (anywhere, at the end of a block) and of words (all, starting, after a stop).

    Pieces between white space are counted as they are; their tokens and words are
    looked for once for each distinct piece.
    """

    def __init__(self) -> None:
        self.pieces, self.final, self.starts, self.after = (Counter() for _ in range(4))

    def add(self, text: str) -> None:
        for low, high, whole in blocks(text):
            if whole:
                continue
            block = _DIGITS.sub("#", text[low:high].strip())
            pieces = block.split()
            self.pieces.update(pieces)
            if pieces[0] == ".":  # a lone stop at the start has no token
                self.pieces["."] -= 1
            if pieces[-1][-1] == "." and (len(pieces) > 1 or pieces[0] != "."):
                self.final[pieces[-1]] += 1
            if first := _WORDS.search(block):
                self.starts[first[0]] += 1
            for mark, word in _AFTER_MARK.findall(block):
                (self.after if mark.strip("!?؟") else self.starts)[word] += 1

    def __len__(self) -> int:
        return len(self.pieces)

    def rows(self) -> dict[str, list[int]]:
        """The counts by type, in the order of ``_COUNTED``."""
        rows: dict[str, list[int]] = {}

        def row(kind: str) -> list[int]:
            return rows.setdefault(kind, [0, 0, 0, 0, 0])

        for counter, at in ((self.pieces, 0), (self.final, 1)):
            for piece, n in counter.items():
                if n and piece[-1] == "." and piece[-2:-1] != ".":
                    row(_kind(_token_of(piece)))[at] += n
        for piece, n in self.pieces.items():
            for word in _WORDS.findall(piece):
                row("^" + _short(word))[3] += n
        for counter, at in ((self.starts, 2), (self.after, 4)):
            for word, n in counter.items():
                found = row("^" + _short(word))
                found[at] += n
                found[3] -= n
        return rows


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(counts: _Counts) -> pa.RecordBatch:
        rows = list(counts.rows().items())
        return pa.record_batch(
            [pa.array([k for k, _ in rows], pa.string()), *(pa.array([r[i] for _, r in rows], pa.int64()) for i in range(5))],
            names=["kind", *_COUNTED],
        )

    counts = _Counts()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.add(text)
        if len(counts) > 200_000:
            yield flush(counts)
            counts = _Counts()
    if len(counts):
        yield flush(counts)


def corpus_stats(documents: DataFrame, text: str, max_types: int = MAX_TYPES) -> Stats:
    """Statistics of all token types over all texts; of more than ``max_types`` types the rarer stay in a table."""
    counted = cut_lineage(
        documents.select(F.col(text))
        .mapInArrow(_count_task, "kind string, " + ", ".join(f"{c} long" for c in _COUNTED))
        .groupBy("kind")
        .agg(*[F.sum(c).alias(c) for c in _COUNTED])
        .filter("stops > 0 OR starts > 0 OR after > 0 OR inside > 1")  # the others say as much as none
    )
    level = F.floor(F.log2(F.col("stops") + F.col("starts") + F.col("after") + 1))
    taken, least = 0, None
    levels = {int(r[0]): int(r[1]) for r in counted.groupBy(level.alias("level")).count().collect()}  # at most one row for each power of two
    for e in sorted(levels, reverse=True):
        if taken + levels[e] > max_types:
            break
        taken, least = taken + levels[e], e
    found = counted.filter(level >= least).collect() if least is not None else []
    if taken < sum(levels.values()):  # any of the next level: what is left out is joined where it is asked for
        found += counted.filter(level == max(e for e in levels if least is None or e < least)).limit(max_types - taken).collect()
    rows = {r[0]: tuple(r[1:]) for r in found}
    if len(rows) == sum(levels.values()):
        return Stats(rows)
    return Stats(rows, tuple(counted.agg(*[F.sum(c) for c in _COUNTED]).first()), counted)


_RARE = "array<struct<" + ", ".join(["kind: string", *[f"{c}: bigint" for c in _COUNTED]]) + ">>"


def _with_rare(rows: DataFrame, text: str, kinds: Callable[[str], set[str]], stats: Stats) -> DataFrame:
    """``rows`` and, in ``__rare``, the statistics of those of the ``kinds`` of a text that are not in ``stats.rows``.

    Only rare types are joined, so none of them is hot.
    """
    if stats.rest is None:
        return rows.withColumn("__rare", F.lit(None).cast(_RARE))
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(stats.rows))
    held = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(r, k) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for k in kinds(t) - shared.value]
            yield pa.record_batch([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], names=["__row", "kind"])

    wanted = held.select("__row", text).mapInArrow(task, "__row long, kind string")
    found = wanted.join(stats.rest, "kind").groupBy("__row").agg(F.collect_list(F.struct("kind", *_COUNTED)).alias("__rare"))
    return held.join(found, "__row", "left").drop("__row")


def _rare(found: list[dict] | None) -> dict[str, tuple[int, int, int, int, int]]:
    return {r["kind"]: tuple(r[c] for c in _COUNTED) for r in found or ()}


def _asked(text: str) -> set[str]:
    """The types that the model asks for where rules do not decide."""
    small, out = _small(text), set()
    for low, high, whole in blocks(text):
        for m in () if whole else _MARK.finditer(text, low, high):
            c = Candidate(text, m, high)
            if reliable(describe(text, c, high, small)) is None:
                kind, _, _, _, word, _ = place(text, c.dot, c.at, low, high, low)
                out |= {kind, word}
    return out


def _asked_in_training(text: str) -> set[str]:
    out: set[str] = set()

    class Asked(Stats):
        def _of(self, kind: str) -> tuple[int, int, int, int, int]:
            out.add(kind)
            return (0, 0, 0, 0, 0)

    for _ in _labelled(text, Asked({})):
        pass
    return out


def _labelled(text: str, stats: Stats) -> Iterator[tuple[list[str], bool, float]]:
    """(features, boundary, weight) of the reliable places of a text."""
    small = _small(text)
    parts = [(a, b) for a, b, whole in blocks(text) if not whole]
    layouts: set[Layout] = set()
    if _THAI.search(text):
        layouts |= {describe_space(m) for low, high in parts for m in _THAI_SPACE.finditer(text, low, high)}
    for i, (low, high) in enumerate(parts):
        begun = low
        end = len(text[:high].rstrip())
        for m in _MARK.finditer(text, low, high):
            c = Candidate(text, m, high)
            layouts.add(describe(text, c, high, small))
            if m[0] == "." and c.end >= end:
                # the end of a block: what comes after is the next block
                at = parts[i + 1][0] if i + 1 < len(parts) else len(text)
                before, after = features(text, c.dot, at, low, len(text), begun, stats)
                yield before + (after if at < len(text) else []), True, 1.0
            elif m[0] == "." and c.spaced and not c.quoted and not small:
                before, after = features(text, c.dot, c.at, low, high, begun, stats)
                if "।" in text[low:high] and "b=Devanagari" in before:  # a danda ends the sentences here
                    yield before, False, 1.0
                elif text[c.at].islower():
                    yield before, False, 1.0
                    yield [x for x in after if x[0] == "n"], False, 0.25
                elif text[c.at].isdigit() and len(before[0]) <= 8:
                    yield before, False, 0.2
            elif m[0].strip(".…") and c.spaced and c.at < high and text[c.at].isupper() and not small:
                _, after = features(text, c.dot, c.at, low, high, begun, stats)
                yield after, True, 0.5
            if c.spaced and c.at < high and (m[0] != "." or text[c.at].isupper()):
                begun = c.end
        # inside a sentence: a word before a capital without any mark between
        for k, m in enumerate(_CAPITAL.finditer(text, low, high)):
            if k % 4 == 0:
                _, after = features(text, m.start(), m.end(), low, high, low, stats)
                yield after, False, 0.25
    for d in sorted(layouts, key=str):
        told = reliable_space(d) if d[0] == "space" else reliable(d)
        if told is not None:
            yield layout_features(d), told, 0.2


def fit(places: list[tuple[list[int], float, float]], rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Maximum-entropy weights (the last is the bias) by full-batch Adagrad."""
    weights = np.zeros(WEIGHTS + 1)
    if not places:
        return weights
    rows = np.repeat(np.arange(len(places)), [len(p[0]) for p in places])
    columns = np.concatenate([np.array(p[0], np.int64) for p in places])
    y = np.array([p[1] for p in places])
    importance = np.array([p[2] for p in places])
    for label in (0.0, 1.0):  # both labels weigh the same
        share = importance[y == label].sum()
        if share:
            importance[y == label] *= 0.5 / share
    seen = np.full(WEIGHTS + 1, 1e-12)
    for _ in range(rounds):
        score = np.bincount(rows, weights=weights[columns], minlength=len(places)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * importance
        gradient = np.append(np.bincount(columns, weights=error[rows], minlength=WEIGHTS), error.sum()) + decay * weights / len(places)
        seen += gradient**2
        weights -= 0.3 * gradient / np.sqrt(seen)
    return weights


def train(documents: DataFrame, identifier: str, text: str, stats: Stats, sample_documents: int = SAMPLE_DOCUMENTS, sample_places: int = SAMPLE_PLACES) -> np.ndarray:
    """Weights fitted on the reliable places of at most ``sample_documents`` documents (by the hash of their id)."""
    shared = documents.sparkSession.sparkContext.broadcast((stats.rows, stats.sums))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stats(*shared.value)
        for batch in batches:
            got = []
            for t, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    known.rare = _rare(found)
                    got += [(_indices(f), float(y), w) for f, y, w in _labelled(t, known)]
                if len(got) >= sample_places:  # the sample is in one partition, in order
                    break
            yield pa.record_batch(
                [pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())],
                names=["at", "label", "weight"],
            )

    number = F.xxhash64(identifier)
    order = (number, identifier)
    rows, total = documents.select(F.col(identifier), F.col(text)), documents.count()
    if total > sample_documents:  # a bound on the hash leaves a few less than the sample may hold, so little is sorted
        rows = rows.filter(number < int(-(1 << 63) + (0.95 * sample_documents / total) * (1 << 64)))
    sample = rows.orderBy(*order).limit(sample_documents)
    sample = _with_rare(sample, text, _asked_in_training, stats)
    if stats.rest is not None:
        sample = sample.orderBy(*order).limit(sample_documents)  # the join lost the order
    sample = sample.select(text, "__rare")
    rows = sample.mapInArrow(task, "at array<int>, label double, weight double").limit(sample_places).collect()
    return fit([(list(r[0]), r[1], r[2]) for r in rows])


def sentence_units(documents: DataFrame, identifier: str, text: str, max_types: int = MAX_TYPES) -> DataFrame:
    """``identifier``, ``start_char``, ``end_char`` of each sentence: code points, end excluded.

    Null, empty and blank texts have none; a text of a word or a few signs is one
    unit; rows with equal identifiers are split each.  Statistics cover all texts
    and all their token types (beyond ``max_types`` by a join), the model is fitted on a bounded sample, and every text is split as a whole.
    An empty table gives an empty result.
    """
    stats = corpus_stats(documents, text, max_types)
    weights = train(documents, identifier, text, stats)
    shared = documents.sparkSession.sparkContext.broadcast((stats.rows, stats.sums, weights))  # bounded by MAX_TYPES and WEIGHTS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums, w = shared.value
        model = Model(Stats(rows, sums), w)
        for batch in batches:
            ids = batch.column(0)
            at, starts, ends = [], [], []
            for i, (t, found) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                model.stats.rare = _rare(found)
                for a, b in sentences(t, model) if t else ():
                    at.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.record_batch(
                [ids.take(pa.array(at, pa.int32())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=[identifier, "start_char", "end_char"],
            )

    kind = documents.schema[identifier].dataType.simpleString()
    ready = _with_rare(documents.select(F.col(identifier), F.col(text)), text, _asked, stats)
    return ready.select(identifier, text, "__rare").mapInArrow(task, f"`{identifier}` {kind}, start_char long, end_char long")
