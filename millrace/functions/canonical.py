"""Canonical forms of values: JSON with sorted keys, answers as numbers or fractions."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys and no spaces."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def canonical_answer(text: str | None) -> str | None:
    """Integers without sign or zeros to spare, decimals without trailing zeros, fractions reduced, else lower case."""
    if text is None:
        return None
    s = text.strip().replace(",", "")
    try:
        f = Fraction(s)
    except (ValueError, ZeroDivisionError):
        return " ".join(s.lower().split())
    if f.denominator == 1:
        return str(f.numerator)
    return f"{f.numerator}/{f.denominator}" if "/" in s else f"{float(f):g}"


def answer(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(canonical_answer)

    return run(c)


#: LaTeX commands and their plain forms.
_LATEX = ((r"\\(?:left|right|,|;|!|quad|displaystyle)", ""), (r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"\1/\2"), (r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)"), (r"\\(?:cdot|times)", "*"), (r"\\binom\{([^{}]*)\}\{([^{}]*)\}", r"C(\1,\2)"), (r"\^\{([^{}]*)\}", r"^\1"), (r"[\s$]", ""))


def latex_plain(text: str | None) -> str | None:
    """Fractions, roots, products, binomials and powers in plain signs; inner ones first, eight rounds at most."""
    if text is None:
        return None
    for _ in range(8):
        before = text
        for pattern, by in _LATEX:
            text = re.sub(pattern, by, text)
        if text == before:
            break
    return text


def latex(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(latex_plain)

    return run(c)
