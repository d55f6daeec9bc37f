"""Duplicates hidden by formatting differences (problem 6).

Each record is reduced to a canonical form; equal forms are one record.  Hot
forms are found exactly from partial counts; they are counted in two levels over
salts, the rest in one shuffle.  The representative is the smallest identifier.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.session import cut_lineage

#: A form is hot from this share of all rows on (so there are at most 1/share of them), if it has that many rows.
HOT_SHARE = 1 / 5000
HOT_ROWS = 16
#: Parts that the rows of a hot form are spread over.
SALTS = 64

# ASCII punctuation that computes in code, so that it is content there.
OPERATORS = "*/%&@#-=!"


def _is_mark(c: str) -> bool:
    return unicodedata.category(c)[0] == "P"


class _Loose(dict):
    """Characters to themselves; to None what does not count: white space, punctuation, controls, ``=`` and backtick."""

    def __missing__(self, point: int) -> int | None:
        c = chr(point)
        self[point] = kept = point if c == "." or not (c.isspace() or c in "=`" or unicodedata.category(c)[0] in "PCZ") else None
        return kept


class _Exact(_Loose):
    """The same, but operators count; dashes of any kind are minus signs."""

    def __missing__(self, point: int) -> int | None:
        c = chr(point)
        if c in OPERATORS or unicodedata.category(c) == "Pd":
            self[point] = ord("-") if unicodedata.category(c) == "Pd" else point
            return self[point]
        return super().__missing__(point)


_LOOSE, _EXACT = _Loose(), _Exact()
_POINT = re.compile(r"(?<![0-9])\.|\.(?![0-9])")
_STRAY_POINT = re.compile(r"(?<=\w)\.(?![0-9])|(?<=[^0-9\s(\[{,:;=<>+*/%&|^~-])\.(?=[0-9])|(?<!\w)\.(?![0-9])")
_HYPHEN = re.compile(r"(?<=\w)-(?=\w)")
_NOT = re.compile(r"!(?!=)")
_DEF = re.compile(r"\bdef\s+(\w+)\s*\(", re.I)
_BRACKET = re.compile(r"[()\[\]{}]")
_PARTS = re.compile(r"[()\[\]{}]|[,;\n\r]")
_MARKS = "".join(re.escape(c) for c in map(chr, range(0x20000)) if _is_mark(c) and c not in "([{")
_NAMED = re.compile(rf"[\s{_MARKS}]*?[^\W\d][\w \-]*(?:(?!:)[\s{_MARKS}])*?[:=](?!=)")


def squash(text: str) -> str:
    """Letters, digits and symbols in lower case; a point only where it is inside a number.

    White space, punctuation marks (Unicode P), control characters and the signs
    ``=`` and backtick, which only tie names to values and quote, are dropped.
    """
    text = text.casefold()
    return (_POINT.sub("", text) if "." in text else text).translate(_LOOSE)


def squash_code(text: str) -> str:
    """Like ``squash``, but operators count: ``* / % & @ # - =`` and ``!=``, and the point that begins a number."""
    text = text.casefold()
    text = (_STRAY_POINT.sub("", text) if "." in text else text).translate(_EXACT)
    return _NOT.sub("", text) if "!" in text else text


def squash_value(text: str) -> str:
    """Like ``squash_code`` for the value of a named field; a hyphen within a word (or a date) does not count."""
    return squash_code(_HYPHEN.sub("", text) if "-" in text else text)


#: The same for names of fields and parameters, of which there are few.
_squash_name = lru_cache(maxsize=1 << 14)(squash)


def _top_level(text: str, separators: str) -> list[str]:
    """Parts of ``text`` between separators outside all brackets."""
    parts, depth, start = [], 0, 0
    for m in _PARTS.finditer(text):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif depth == 0 and c in separators:
            parts.append(text[start : m.start()])
            start = m.end()
    return [*parts, text[start:]]


def _closing(text: str, start: int) -> int:
    """Index of the bracket that closes the one just before ``start``."""
    depth = 1
    for m in _BRACKET.finditer(text, start):
        depth += 1 if m[0] in "([{" else -1
        if depth == 0:
            return m.start()
    return len(text)


def _field(text: str) -> str:
    m = _NAMED.match(text)
    if not m:
        return squash_value(text)
    return _squash_name(text[: m.end() - 1]) + "=" + squash_value(text[m.end() :])


def _parameter(text: str) -> str:
    name, _, value = text.partition("=")
    return _squash_name(name) + "=" + squash_code(value)


def canonical_code(code: str) -> str:
    """Canonical form of a Python function or of a list of named fields.

    Two texts have the same form if they differ only in white space, letter case,
    punctuation and the order of the named fields: in Python code, the parameters
    with a default of the first function; else the top-level ``name: value`` or
    ``name = value`` parts between commas, semicolons or line breaks.  Operators and
    the signs of numbers are no punctuation: ``a * b``, ``a / b`` and ``-a`` differ.
    """
    m = _DEF.search(code)
    if m:
        end = _closing(code, m.end())
        given = [p for p in _top_level(code[m.end() : end], ",") if not p.isspace() and squash(p)]
        named = sorted(_parameter(p) for p in given if "=" in p)
        plain = [squash_code(p) for p in given if "=" not in p]
        head = squash_code(code[: m.start()]) + "def" + _squash_name(m[1])
        return "\x1e".join(["code", head, *plain, "", *named, "", squash_code(code[end:])])
    body = code.strip()
    if body[:1] == "{" and _closing(body, 1) == len(body) - 1:
        body = body[1:-1]
    fields: list[str] = []
    for part in _top_level(body, ",;\n\r"):
        if _NAMED.match(part) or not fields:
            fields.append(part)
        else:
            fields[-1] += " " + part
    return "\x1e".join(["fields", *sorted(f for f in map(_field, fields) if f)])


def canonical_key(code: str | None, name: str | None) -> bytes:
    """16 bytes that tell canonical forms apart; a null equals only a null."""
    parts = ["\x00" if code is None else "\x01" + canonical_code(code), "\x00" if name is None else "\x01" + squash(name)]
    return hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, codes, names = batch.columns
        keys = [canonical_key(c, n) for c, n in zip(codes.to_pylist(), names.to_pylist())]
        yield pa.record_batch([ids, pa.array(keys, pa.binary())], names=["id", "key"])


def canonical_keys(records: DataFrame, identifier: str, code: str, name: str) -> DataFrame:
    """``id`` and ``key`` of each record."""
    return records.select(F.col(identifier).cast("long").alias("id"), F.col(code), F.col(name)).mapInArrow(_keys, "id long, key binary")


def _split_hot(keyed: DataFrame, share: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(rows of hot keys, the other rows); all keys are counted exactly, with partial counts."""
    counts = keyed.groupBy("key").count()
    total = keyed.count()
    hot = counts.filter(F.col("count") >= max(least, int(total * share) + 1)).select("key")
    found = [bytes(r[0]) for r in hot.collect()]  # at most 1 / share keys of 16 bytes
    is_hot = F.col("key").isin(found) if found else F.lit(False)
    return keyed.filter(is_hot), keyed.filter(~is_hot)


def collapse(
    records: DataFrame,
    identifier: str,
    code: str,
    name: str,
    hot_share: float = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of records that differ in formatting only.

    groups: ``key``, ``representative`` (smallest identifier), ``copies`` (rows).
    members: ``representative``, ``id`` for every row that is not the
    representative (a repeated identifier counts as a copy but is listed only if
    it differs from the representative).  The keys are computed once and kept in
    the shared checkpoint folder.  An empty table gives empty results; rows with
    a null identifier count as copies and can only represent a group alone.
    """
    keyed = cut_lineage(canonical_keys(records, identifier, code, name))
    hot, cold = _split_hot(keyed, hot_share, hot_rows)
    salted = hot.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    hot_groups = salted.groupBy("key").agg(F.min("low").alias("representative"), F.sum("n").alias("copies"))
    cold_groups = cold.groupBy("key").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("copies"))

    # few hot groups (at most 1 / share): their rows stay where they are
    hot_members = hot.join(F.broadcast(hot_groups), "key").select("representative", "id")
    # a cold group has at most a share of the rows, less than its task would have of other groups
    low = F.min("id").over(Window.partitionBy("key"))
    cold_members = cold.withColumn("representative", low).select("representative", "id")
    members = hot_members.unionByName(cold_members).filter("id <> representative")
    return hot_groups.unionByName(cold_groups), members
