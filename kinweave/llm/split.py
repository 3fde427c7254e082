"""Splitting oversized items at natural boundaries.

Every position of a text has a boundary strength. A sparse table over (strength, position) answers range-maximum
queries; each piece ends at the strongest cut of its permissible window, the rightmost of equal ones, and the next
piece steps back by the overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a piece may end after, weakest first; a later rule overrides an earlier one.
BOUNDARIES = (
    (1, re.compile(r"\s(?=\S)")),
    (2, re.compile(r",\s+")),
    (3, re.compile(r"[;:]\s+")),
    (4, re.compile(r"[.!?…][\"'»”)\]]*\s+")),
    (5, re.compile(r"\s/\s|[\r\n \u0085]+")),
    (6, re.compile(r"(?:\r?\n[ \t]*){2,}| ")),
)


def strengths(text: str) -> np.ndarray:
    """Strength of the cut before each position 0..n; -1 where a letter and its marks would part."""
    s = np.zeros(len(text) + 1, dtype=np.int64)
    for strength, rule in BOUNDARIES:
        for m in rule.finditer(text):
            s[m.end()] = strength
    if not text.isascii():
        for i, c in enumerate(text):
            if c > "˿" and (unicodedata.combining(c) or c in "‍️"):
                s[i] = -1
    return s


class RangeMax:
    """Sparse table for the rightmost maximum in a window; levels are built as far as windows reach."""

    def __init__(self, values: np.ndarray, widest: int):
        n = len(values)
        level = (values + 1) * (n + 1) + np.arange(n)
        self.n, self.levels = n, [level]
        k = 1
        while 2 * k <= min(widest, n):
            level = np.maximum(level[: len(level) - k], level[k:])
            self.levels.append(level)
            k *= 2

    def query(self, lo: int, hi: int) -> int:
        """Position of the strongest cut in lo..hi (inclusive), the rightmost of equal ones."""
        k = (hi - lo + 1).bit_length() - 1
        best = max(int(self.levels[k][lo]), int(self.levels[k][hi - (1 << k) + 1]))
        return best % (self.n + 1)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; one piece if it fits the limit.

    Ends lie in the second half of what the limit allows, so pieces are never needlessly short. A text without any
    boundary is cut at the limit.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit // 2 - 1))
    index = RangeMax(s := strengths(text), limit)
    out, start = [], 0
    while n - start > limit:
        lo = start + max(limit // 2, overlap + 1)
        end = index.query(lo, start + limit)
        out.append((start, end))
        back = end - overlap
        while back > start + 1 and s[back] < 0:  # a letter keeps its marks: as near to the overlap as that allows
            back -= 1
        start = back
    out.append((start, n))
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int, keep_short: bool = False) -> DataFrame:
    """(key, piece_no, start, stop, piece): the texts over limit in pieces, numbered from 1.

    NULL and empty texts give no piece; texts within the limit give one only with keep_short; a record loaded twice
    counts once. Lengths are code points of the text as stored; start and stop count from 0.
    """

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[] if not t else [{"piece_no": i, "start": a, "stop": b, "piece": t[a:b]} for i, (a, b) in enumerate(pieces(t, limit, overlap), 1)] for t in s])

    cutter = F.pandas_udf(cut, "array<struct<piece_no:int,start:int,stop:int,piece:string>>")
    base = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    base = base.where(F.length("t") > (0 if keep_short else limit)).distinct()
    return base.select(F.col("k").alias(key), F.explode(cutter("t")).alias("p")).select(key, "p.*")
