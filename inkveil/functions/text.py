"""Text normalisation and fuzzy scores (Arrow functions where Catalyst has none)."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = re.compile(r"[^\w\s]|_")
_ZERO = re.compile(r"(?<=[a-z])0(?=[a-z])")


@lru_cache(1)
def _combining() -> re.Pattern:
    """All combining characters, as one class."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k == len(codes) - 1 or codes[k + 1] != c + 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]+")


def normalize(text: str | None) -> str | None:
    """Lower case, without accents and punctuation, single spaces, a zero between letters read as o."""
    if text is None:
        return None
    text = text.lower()
    if not text.isascii():
        text = _combining().sub("", unicodedata.normalize("NFKD", text))
    return _ZERO.sub("o", " ".join(_MARKS.sub("", text).split()))


@F.pandas_udf(T.StringType())
def _normalize_any(texts: pd.Series) -> pd.Series:
    return texts.map(normalize, na_action="ignore")


def normalize_ascii(text: Column) -> Column:
    """The same on ASCII text, inside whole-stage code generation."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))
    return F.regexp_replace(plain, r"(?<=[a-z])0(?=[a-z])", "o")


def normalize_text(text: Column | str) -> Column:
    """The normaliser of any text: ASCII rows natively, only the others in Arrow batches."""
    text = F.col(text) if isinstance(text, str) else text
    # A text with a byte for each character is ASCII; the Arrow function sees null for it.
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, normalize_ascii(text)).otherwise(_normalize_any(F.when(~plain, text)))


def normalize_list(texts: Column) -> Column:
    """Every ASCII text of an array, normalised."""
    return F.transform(texts, normalize_ascii)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per 64 characters of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * LCS / total length; two empty strings are equal."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer, windows cut at its ends included."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    n = len(a)
    best = max(ratio(a, b[max(0, k) : k + n]) for k in range(1 - n, len(b)))
    if len(b) == n:
        best = max(best, *(ratio(b, a[max(0, k) : k + n]) for k in range(1 - n, n)))
    return best


def _common(a: Column, b: Column) -> Column:
    """Number of characters of ``a`` that occur in ``b``: no subsequence can be longer."""
    return F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))


def can_ratio(a: Column, b: Column, least: float) -> Column:
    """Whether ratio(a, b) can reach ``least``; native, so other pairs never reach the Arrow score.

    The characters of a subsequence are common to both, and the edit distance is at most the
    number of characters outside it.
    """
    total = F.length(a) + F.length(b)
    return (200 * _common(a, b) >= F.lit(least) * total) & (F.levenshtein(a, b) <= (1 - least / 100) * total + 1e-9)


def can_partial(a: Column, b: Column, least: float) -> Column:
    """Whether partial_ratio(a, b) can reach ``least``."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    m = _common(short, long)
    return 200 * m >= F.lit(least) * (F.length(short) + m)


def _scorer(score):
    @F.pandas_udf(T.DoubleType())
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return apply


fuzz_ratio = _scorer(ratio)
fuzz_partial_ratio = _scorer(partial_ratio)


def token_ratio(text: str, term: str) -> float:
    """Best ratio of a word of ``text`` with the whole ``term``."""
    return max((ratio(w, term) for w in text.split()), default=0.0)


def run_matches(run: str, term: str) -> bool:
    """Whether joined texts spell a term: whole, without spaces, as a part, or after leading words are dropped."""
    if len(run) < 0.6 * len(term):
        return False
    if ratio(run, term) >= 85 or ratio(run.replace(" ", ""), term) >= 85:
        return True
    if len(run) <= 1.3 * len(term) and partial_ratio(run, term) >= 90:
        return True
    words = run.split()
    for k in range(1, len(words)):
        tail = " ".join(words[k:])
        if len(tail) < 0.6 * len(term):
            return False
        bare = tail.replace(" ", "")
        if ratio(tail, term) >= 85 or (len(bare) >= 0.85 * len(term) and ratio(bare, term) >= 85):
            return True
    return False


def member_ratio(text: str, term: str) -> float:
    """How well a text, as it is or without spaces, is part of a term."""
    return max(partial_ratio(text, term), partial_ratio(text.replace(" ", ""), term) if " " in text else 0.0)


_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("part", "whole", "word")])


@F.pandas_udf(_SCORES)
def pair_scores(texts: pd.Series, terms: pd.Series, part: pd.Series, word: pd.Series) -> pd.DataFrame:
    """Partial and whole ratio where ``part``, the best word's ratio where ``word``; else 0."""
    rows = [(partial_ratio(a, b) if p else 0.0, ratio(a, b) if p and len(a) <= 5 else 0.0, token_ratio(a, b) if w else 0.0) for a, b, p, w in zip(texts, terms, part, word)]
    return pd.DataFrame(rows, columns=["part", "whole", "word"], dtype="float64")


@F.pandas_udf(T.BooleanType())
def run_spells(runs: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([run_matches(a, b) for a, b in zip(runs, terms)], dtype=bool)


@F.pandas_udf(T.DoubleType())
def member_score(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """``member_ratio``; 0 for null."""
    return pd.Series([0.0 if a is None else member_ratio(a, b) for a, b in zip(texts, terms)], dtype="float64")


def register(spark: SparkSession) -> None:
    """Makes the scores and the normaliser callable from SQL."""
    for name, f in (("fuzz_ratio", fuzz_ratio), ("fuzz_partial_ratio", fuzz_partial_ratio), ("normalize_text", _normalize_any)):
        spark.udf.register(name, f)


def max_edits(length: Column) -> Column:
    """Edits allowed to a name by the shorter length: 0 to 3, 1 to 5, 2 to 9, else 3."""
    return F.when(length <= 3, 0).when(length <= 5, 1).when(length <= 9, 2).otherwise(3)
