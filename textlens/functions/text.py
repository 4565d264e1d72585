"""Scalar text functions as native Spark column expressions.

All of these are built-in JVM expressions (higher-order functions are interpreted, the rest compiles); none is a Python UDF.  Each one
has a DuckDB twin in ``textlens.plans.oracle`` built from the same patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must match the reference's Python semantics).
# Python's `\s` class (29 code points), written out explicitly because Java's
# and RE2's `\s` both differ from it.
WS_CLASS = (
    "[\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
)
# Word tokens of the 1-2-gram vectoriser: two or more letters / digits / '_'
# (combining marks split words, as Python's `\w` does).
TOKEN_PATTERN = "[\\p{L}\\p{N}_]{2,}"
# Same tokens but keeping combining marks inside words (opt-in).
TOKEN_PATTERN_MARKS = "[\\p{L}\\p{M}\\p{N}_]{2,}"
# Script classes: (name, character class); first match in this order wins,
# text with two or more classes is "Mixed", none is "Other".
DEVANAGARI = "[\\x{0900}-\\x{097F}]"
ASCII_LETTER = "[A-Za-z]"
# Preview length and ellipsis of the log view.
PREVIEW_CHARS = 28
ELLIPSIS = "…"
# Sequence cap of the scorer input.
MAX_TOKENS = 128


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """collapse whitespace runs to one space, strip ends, keep case."""
    return F.trim(F.regexp_replace(_c(col), WS_CLASS, " "))


def normalize_text(col) -> Column:
    """lower-case, then F1."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), WS_CLASS, " "))


def char_length(col) -> Column:
    """length in code points."""
    return F.length(_c(col))


def detect_script(col, a_class: str = DEVANAGARI, b_class: str = ASCII_LETTER,
                  a_name: str = "Devanagari", b_name: str = "Latin") -> Column:
    """Mixed / <a_name> / <b_name> / Other by presence of two character classes."""
    c = _c(col)
    has_a = c.rlike(a_class)
    has_b = c.rlike(b_class)
    return (F.when(has_a & has_b, F.lit("Mixed"))
            .when(has_a, F.lit(a_name))
            .when(has_b, F.lit(b_name))
            .otherwise(F.lit("Other")))


def has_char_range(col, lo: int, hi: int) -> Column:
    """true if any code point lies in [lo, hi]."""
    return _c(col).rlike(f"[\\x{{{lo:04X}}}-\\x{{{hi:04X}}}]")


def has_damage(col, marker: str = "?") -> Column:
    """encoding-damage marker present."""
    return F.contains(_c(col), F.lit(marker))


def is_blank(col) -> Column:
    """F7 helper: null or only whitespace."""
    return _c(col).isNull() | (clean_text(col) == F.lit(""))


def pct(col, digits: int = 2) -> Column:
    """F8: ratio -> percent, rounded half away from zero."""
    return F.round(_c(col) * F.lit(100.0), digits)


def clamp(col, lo: float = 0.0, hi: float = 100.0) -> Column:
    """F8: clamp into [lo, hi]."""
    return F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi))


def join_list(col, sep: str = ", ") -> Column:
    """array of strings -> text."""
    return F.array_join(_c(col), sep)


def preview(col, n: int = PREVIEW_CHARS) -> Column:
    """first n characters, ellipsis when longer."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


def clock_text(col=None) -> Column:
    """timestamp as 'yyyy-MM-dd HH:mm:ss' text."""
    ts = F.current_timestamp() if col is None else _c(col)
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def keyword_weight(col) -> Column:
    """phrase weight = number of words, capped at 3 (>=3 -> 3, 2 -> 2, else 1)."""
    n = F.size(F.split(F.trim(_c(col)), WS_CLASS))
    return F.least(F.greatest(n, F.lit(1)), F.lit(3))


def tokens(col, keep_marks: bool = False) -> Column:
    """V1: lower-case word tokens of two or more word characters, in order."""
    pattern = TOKEN_PATTERN_MARKS if keep_marks else TOKEN_PATTERN
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(pattern), 0)


def cap_tokens(col, n: int = MAX_TOKENS) -> Column:
    """keep the first n tokens of a token array (model-input cap only)."""
    return F.slice(_c(col), 1, n)


def bigrams(tok) -> Column:
    """Adjacent token pairs ('a b') of a token array, in order."""
    t = _c(tok)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def unigrams_bigrams(tok) -> Column:
    """V1: unigrams followed by adjacent bigrams ('a b'); 0/1-token rows give no bigram.

    The token array is only ever an argument of the array functions (never
    captured inside a lambda), so it is evaluated once per row, not per element.
    """
    t = _c(tok)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    bigrams = F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(t, bigrams)
