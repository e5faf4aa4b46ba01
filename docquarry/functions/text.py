"""Analyzer functions: folding, word splitting, edit distance, highlighting, number text.

Each exists as a Spark column expression; those that also run on query strings have a Python twin.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import unicodedata
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

_SPLIT = r"[^\p{L}\p{N}]+"
_MARKS = r"\p{Mn}+"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def fold(text: str) -> str:
    """Lower case, without combining marks."""
    parts = unicodedata.normalize("NFD", text.lower())
    return unicodedata.normalize("NFC", "".join(c for c in parts if unicodedata.category(c) != "Mn"))


def words(text: str) -> list[str]:
    """Maximal runs of letters and numbers of the folded text."""
    out, run = [], []
    for c in fold(text):
        if unicodedata.category(c)[0] in "LN":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return [*out, "".join(run)] if run else out


@functools.cache
def _folding() -> tuple[str, str]:
    """Characters that fold to one other character, and what they fold to."""
    source, target = [], []
    for code in range(128, min(sys.maxunicode, 0xFFFF) + 1):
        c = chr(code)
        if unicodedata.decomposition(c) and not 0xAC00 <= code <= 0xD7A3:
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            bare = unicodedata.normalize("NFC", bare)
            if len(bare) == 1 and bare != c:
                source.append(c)
                target.append(bare)
    return "".join(source), "".join(target)


def fold_column(text: Column) -> Column:
    source, target = _folding()
    return F.regexp_replace(F.translate(F.lower(text), source, target), _MARKS, "")


def words_column(text: Column) -> Column:
    """Array of words; null for a null text."""
    return F.filter(F.split(fold_column(text), _SPLIT), lambda w: w != "")


def bigrams_column(term: Column) -> Column:
    """Distinct two-character substrings; a one-character term stands for itself."""
    places = F.sequence(F.lit(1), F.greatest(F.length(term) - 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(term, i, F.lit(2))))


def osa(a: str, b: str) -> int:
    """Edits between two strings, where swapping neighbours is one and no place is edited twice."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def osa_many(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``osa`` of many pairs, those of equal lengths at once."""
    out = np.zeros(len(pairs), np.int32)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(pairs):
        groups.setdefault((len(a), len(b)), []).append(i)
    for (n, m), at in groups.items():
        a, b = (np.array([[ord(c) for c in pairs[i][side]] for i in at], np.int32).reshape(len(at), size) for side, size in ((0, n), (1, m)))
        before, row = None, np.tile(np.arange(m + 1, dtype=np.int32), (len(at), 1))
        for i in range(1, n + 1):
            new = np.empty_like(row)
            new[:, 0] = i
            differ = a[:, i - 1 : i] != b
            for j in range(1, m + 1):
                best = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + differ[:, j - 1])
                if i > 1 and j > 1:
                    swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                    best = np.where(swapped, np.minimum(best, before[:, j - 2] + 1), best)
                new[:, j] = best
            before, row = row, new
        out[at] = row[:, m]
    return out


@F.pandas_udf(IntegerType())
def _osa_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(osa_many(list(zip(a, b, strict=True))), dtype="int32")


def _swapped(a: Column, b: Column) -> Column:
    """Whether two strings of one length differ by one swap of neighbours."""
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i, j = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    at = lambda s, p: F.substring(s, p, F.lit(1))
    return (F.length(a) == F.length(b)) & (F.size(differ) == 2) & (j == i + 1) & (at(a, i) == at(b, j)) & (at(a, j) == at(b, i))


def osa_within_one(a: Column, b: Column) -> Column:
    """Whether at most one edit lies between; built-in functions alone."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & ((F.levenshtein(a, b, 1) >= 0) | _swapped(a, b))


def osa_column(a: Column, b: Column) -> Column:
    """The distance itself, in Arrow batches; for pairs that a native test has let through."""
    return _osa_batch(a, b)


def osa_possible(a: Column, b: Column, most: int) -> Column:
    """A lossless native test: an alignment of k edits is at most 2k without swaps."""
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b, 2 * most) >= 0)


def parse_number(text: str) -> float | None:
    return float(text) if re.match(_NUMBER, text) else {"inf": float("inf"), "+inf": float("inf"), "-inf": float("-inf"), "nan": float("nan")}.get(text.lower())


def number_of_text(text: Column) -> Column:
    """The number that a string spells, else null."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def number_text(x: Column) -> Column:
    """A double as shown in facets and compared in sorts: whole numbers without a fraction."""
    small = F.when(F.abs(x) < 1e15, x)  # nothing larger is made an integer
    return F.when(small == F.floor(small), F.floor(small).cast("string")).otherwise(x.cast("string"))


def filter_text_of_number(x: Column) -> Column:
    """A number as a filter's text comparison sees it: fixed notation without zeros at its end, those of whole numbers included."""
    text = F.abs(x).cast("string")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1)
    whole, part = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"^\d+\.(\d+)", 1)
    e, digits = F.coalesce(power.try_cast("int"), F.lit(0)), F.concat(whole, part)
    point = F.length(whole) + e
    fixed = (
        F.when(power == "", F.regexp_replace(text, r"\.0$", ""))
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), digits)
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )
    short = F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))
    odd = F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("+Inf")).when(x == float("-inf"), F.lit("-Inf"))
    return F.coalesce(odd, F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), short))


def filter_text(x: float) -> str:
    """The same of one number."""
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else f"{x:+.0f}".replace("inf", "Inf")
    return format(Decimal(repr(x + 0.0)), "f").removesuffix(".0").rstrip("0").rstrip(".")


def highlight(text: str, terms: list[str]) -> str:
    """The first occurrence of each term, in turn, between <em> and </em>; case is ignored."""
    for term in terms:
        at = text.lower().find(term.lower())
        if term and at >= 0:
            text = f"{text[:at]}<em>{text[at : at + len(term)]}</em>{text[at + len(term) :]}"
    return text


def highlight_column(text: Column, terms: Column) -> Column:
    def mark(done: Column, term: Column) -> Column:
        at, n = F.instr(F.lower(done), F.lower(term)), F.length(term)
        marked = F.concat(F.substring(done, F.lit(1), at - 1), F.lit("<em>"), F.substring(done, at, n), F.lit("</em>"), F.substring(done, at + n, F.length(done)))
        return F.when((at > 0) & (n > 0), marked).otherwise(done)

    return F.aggregate(terms, text, mark)
