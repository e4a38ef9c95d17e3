"""Text as Column builders: normal forms, masks, templates, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    """Lower case, trimmed, white space runs as one space."""
    return F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")


def text_hash(c: Column) -> Column:
    return F.sha2(normalised(c), 256)


def masked(c: Column, *masks: tuple[str, str]) -> Column:
    """c with each (pattern, replacement) applied in order."""
    for pattern, by in masks:
        c = F.regexp_replace(c, pattern, by)
    return c


#: Word edges in ASCII terms, so that accented letters are no word characters on any engine.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: The masks of a prompt's template, in the order they apply.
TEMPLATE_MASKS = ((_B + "[01]{4,}" + _E, "<BIN>"), (_B + "[IVXLCDM]{2,}" + _E, "<ROMAN>"), (r'"[^"]*"', "<PHRASE>"), (r"[-+]?\d+(?:\.\d+)?", "<NUM>"), (r"[@#$%^&*]+", "<SYM>"))
SURFACE_MASKS = ((r"<[^>]+>", "<tag>"), (r"\d+(?:\.\d+)?", "<num>"), (_B + "[01]+" + _E, "<bin>"))


def template_hash(c: Column) -> Column:
    return F.sha2(normalised(masked(c, *TEMPLATE_MASKS)), 256)


def surface(c: Column) -> Column:
    return normalised(masked(c, *SURFACE_MASKS))


def word_template(c: Column) -> Column:
    """The surface with words of four ASCII letters or more masked, as a short digest."""
    return F.substring(F.sha2(F.regexp_replace(surface(c), r"[a-z]{4,}", "<word>"), 256), 1, 12)


def digit_masked_hash(c: Column) -> Column:
    return F.sha2(F.regexp_replace(trimmed(F.regexp_replace(c, r"\d+", "<NUM>")), r"\s+", " "), 256)


def char_template(c: Column, most: int = 300) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"\d", "0"), r"\p{L}", "a"), 1, most)


def tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_]+)"), F.lit(1))


def token_template(c: Column, most: int = 30) -> Column:
    """The first tokens, those that hold a digit as N."""
    parts = F.slice(F.split(normalised(c), " "), 1, most)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"\d"), F.lit("N")).otherwise(x)), " ")


def numeric_template(c: Column, most: int = 24) -> Column:
    parts = F.slice(F.split(normalised(c), " "), 1, most)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^[-+]?\d+(\.\d+)?$"), F.lit("0")).otherwise(x)), " ")


def minted_id(prefix: str, c: Column) -> Column:
    """An id of safe characters: others as one underscore, 160 characters at most, no underscores at the ends."""
    return F.concat(F.lit(prefix), F.btrim(F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_]+", "_"), 1, 160), F.lit("_")))


#: Words for digits of Roman numerals by place.
_ROMAN = (("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "M", "MM", "MMM"))


def roman(n: Column) -> Column:
    """1 to 3999 in Roman numerals, else null."""
    digit = lambda k: F.element_at(F.array(*[F.lit(x) for x in _ROMAN[k]]), (F.floor(n / 10**k) % 10 + 1).cast("int"))
    return F.when((n >= 1) & (n <= 3999), F.concat(*[digit(k) for k in (3, 2, 1, 0)]))


def first_match(c: Column, *cases: tuple[str, str], default: str) -> Column:
    """The name of the first pattern found in c."""
    out = None
    for pattern, name in cases:
        hit = c.rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
