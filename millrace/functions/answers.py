"""Answers in texts: boxed spans, loose extraction, coercion to numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def last_boxed(text: str | None) -> str | None:
    r"""The last balanced \boxed{...}; None if there is none or its braces do not balance."""
    if text is None:
        return None
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth, i = 1, at + 7
    start = i
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start:i].strip()
        i += 1
    return None


def boxed(c: Column) -> Column:
    """last_boxed as a vectorised function: nested braces are not regular."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(last_boxed)

    return run(c)


def loose(c: Column, *patterns: str) -> Column:
    """The first pattern's first group that is found, else the last line."""
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.element_at(F.split(c, "\n", -1), -1))


def whole_number(c: Column, low: int, high: int) -> Column:
    """Integer text, or integral decimals, within a range; anything else is null."""
    t = F.trim(c)
    n = F.when(t.rlike(r"^[+-]?\d+(\.0+)?$"), t.cast("double"))
    return F.when(n.between(low, high), n.cast("long"))
