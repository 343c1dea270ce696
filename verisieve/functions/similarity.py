"""Sequence similarity (``difflib``'s ratio, argument order kept) as an Arrow UDF, and its containment variant."""

from __future__ import annotations

import difflib
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize


def similarity(left: Column, right: Column) -> Column:
    """Ratio of each pair."""
    return F.pandas_udf(_ratios, "double")(left, right)


def similarities(left: Column, rights: Column) -> Column:
    """Ratios of one string with each of an array."""
    return F.pandas_udf(_ratios_each, "array<double>")(left, rights)


#: From this length on ``difflib`` leaves frequent characters of the second text out.
_AUTOJUNK = 200
#: The longest first text whose table of equal characters is made: with a second text below ``_AUTOJUNK`` it has 100 KB.
_LONGEST = 4096


def _ones(rows: int, wide: int) -> int:
    """A bit at the start of each row."""
    return int.from_bytes((b"\1" + bytes(wide // 8 - 1)) * rows, "little")


class _Bits:
    """``difflib``'s ratio for a second text below ``_AUTOJUNK`` characters.

    Which characters are equal is one integer, a row of bits for each character of the first text, so a run of equal characters is a run on a
    diagonal, and one shift makes all runs a character longer.
    """

    def __init__(self, b: str):
        self.n, self.wide = len(b), len(b) // 8 + 1  # a row ends with a zero
        at: dict[str, int] = {}
        for j, c in enumerate(b):
            at[c] = at.get(c, 0) | 1 << j
        self.rows = {c: x.to_bytes(self.wide, "little") for c, x in at.items()}

    def ratio(self, a: str) -> float:
        none = bytes(self.wide)
        return 2.0 * self._matched(int.from_bytes(b"".join([self.rows.get(c, none) for c in a]), "little"), len(a)) / (len(a) + self.n)

    def _matched(self, equal: int, rows: int) -> int:
        """Characters in matching blocks: the longest block, of equal ones the first in the first text, then in the second; then what is before and after it."""
        wide, total, todo = 8 * self.wide, 0, [(equal, rows, 0, self.n)] if equal else []
        while todo:
            equal, rows, low, high = todo.pop()
            size, starts = 1, equal
            while longer := starts & (equal >> size * (wide + 1)):
                size, starts = size + 1, longer
            total += size
            i, j = divmod((starts & -starts).bit_length() - 1, wide)
            if i and j > low:
                ones = _ones(i, wide)
                if before := equal & ((ones << j) - ones):
                    todo.append((before, i, low, j))
            rows -= i + size
            if rows and j + size < high:
                ones = _ones(rows, wide)
                if after := (equal >> (i + size) * wide) & ((ones << high) - (ones << j + size)):
                    todo.append((after, rows, j + size, high))
        return total


def _known_ratios() -> Callable[[str | None, str | None], float]:
    """``ratio`` for a batch: a pair that repeats is computed once, and what a matcher learns of its second text is kept for the next rows."""
    known: dict[tuple, float] = {}
    matcher = functools.lru_cache(256)(lambda b: difflib.SequenceMatcher(None, "", b))
    bits = functools.lru_cache(256)(_Bits)

    def ratio(a: str, b: str) -> float:
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        if len(b) < _AUTOJUNK and len(a) <= _LONGEST:
            return bits(b).ratio(a)
        m = matcher(b)
        m.set_seq1(a)
        return m.ratio()

    def one(a: str | None, b: str | None) -> float:
        p = a or "", b or ""
        if p not in known:
            known[p] = ratio(*p)
        return known[p]

    return one


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    one = _known_ratios()
    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def _ratios_each(left: pd.Series, rights: pd.Series) -> pd.Series:
    one = _known_ratios()
    return pd.Series([[] if bs is None else [one(a, b) for b in bs] for a, bs in zip(left, rights, strict=True)])


def containment_similarity(left: Column, right: Column) -> Column:
    """On normalised texts: 0 if one is empty, 1 if one contains the other, else their ratio."""
    a, b = normalize(left), normalize(right)
    within = b.contains(a) | a.contains(b)
    return F.when((a == "") | (b == ""), 0.0).when(within, 1.0).otherwise(similarity(a, b))
