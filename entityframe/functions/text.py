"""Text functions."""

from __future__ import annotations

import functools
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def concat(*parts: Column) -> Column:
    """Concatenation of the parts as text; null if any part is."""
    return F.concat(*[p.cast("string") for p in parts])


def concat_ws(sep: str, *parts: Column, skip_nulls: bool = True) -> Column:
    """With a separator: skipping nulls, or null if any part is (as a chain of || gives)."""
    if skip_nulls:
        return F.concat_ws(sep, *[p.cast("string") for p in parts])
    woven: list[Column] = []
    for p in parts:
        woven += [F.lit(sep), p.cast("string")] if woven else [p.cast("string")]
    return F.concat(*woven)


def length(text: Column) -> Column:
    """Characters of a text."""
    return F.char_length(text)


def regexp_substr(text: Column, pattern: str) -> Column:
    """The first match, null without one."""
    return F.regexp_substr(text, F.lit(pattern))


def words(text: Column) -> Column:
    """The words of a text; blanks separate, none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def field_position(value: Column, *choices) -> Column:
    """1-based place of the value among the choices, 0 if absent or null: an order by an explicit list."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in choices]), value), F.lit(0)).cast("int")


def fulltext_score(text: Column, query: str) -> Column:
    """How many distinct words of the query occur in the text, case-insensitively; null text scores 0."""
    wanted = F.array_distinct(F.array(*[F.lit(w) for w in query.lower().split()]).cast("array<string>"))
    return F.coalesce(F.size(F.array_intersect(words(F.lower(text)), wanted)), F.lit(0))


def fulltext_matches(text: Column, query: str) -> Column:
    """Boolean mode: `+word` has to be there and `-word` not; without a `+`, one of the plain words has to be; `word*` is a
    beginning of a word. Case-insensitive; null text and a query without words to be there match nothing."""
    have = words(F.lower(text))

    def has(word: str) -> Column:
        return F.exists(have, lambda x: x.startswith(word[:-1])) if word.endswith("*") else F.array_contains(have, word)

    tokens = query.lower().split()
    must, never = ([has(w[1:]) for w in tokens if w[0] == sign] for sign in "+-")
    any_of = [has(w) for w in tokens if w[0] not in "+-"]
    wanted = must or [functools.reduce(operator.or_, any_of, F.lit(False))]
    return F.coalesce(functools.reduce(operator.and_, wanted + [~x for x in never]), F.lit(False))


def _jaro_winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    turned = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used, strict=True) if u), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts from 0 to 1; null if either is. Not built into Spark."""
    return pd.Series([_jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
