"""Company-name functions, Column -> Column, all JVM-side built-ins (no UDF).

normalize_company is the shared key contract: filings and postings both go through it exactly once
(it is not idempotent: one leading "the" is dropped per pass).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lcarank.constants import (GENERIC_TOKENS, LEGAL_SUFFIXES, MIN_FUZZY_TOKEN_LEN,
                               MIN_SUBSET_TOKEN_LEN, RATING_TAIL_PATTERN, SITE_TAIL_PATTERN)

# Python's str.strip()/\s treat U+001C..U+001F as whitespace; Java's Unicode \s does not.
_WS = r"[\s\x1c-\x1f]"
# FIXED VALUES — the characters Python's str.isspace() accepts (what str.strip() removes).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
_SUFFIX_TAIL = "(?: (?:" + "|".join(LEGAL_SUFFIXES) + "))+$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: Column | str) -> Column:
    """Python-style strip: removes Unicode whitespace at both ends (Spark's trim only removes
    U+0020). A character-set trim, no regex."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def normalize_company(col: Column | str) -> Column:
    """Raw employer name -> matching key.

    lower -> every non-[a-z0-9] run becomes one space -> trim -> join runs of 1-char tokens
    ("j p morgan" -> "jp morgan") -> drop one leading "the" if more tokens follow -> drop trailing
    legal suffixes while more than one token remains. Null/empty -> "".
    """
    c = _c(col)
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    # a space whose both neighbours are single-character tokens disappears
    s = F.regexp_replace(s, r"(?<=\b[a-z0-9]) (?=[a-z0-9]\b)", "")
    s = F.regexp_replace(s, "^the ", "")
    s = F.regexp_replace(s, _SUFFIX_TAIL, "")
    return F.when(c.isNull(), F.lit("")).otherwise(s)


def clean_company_name(col: Column | str) -> Column:
    """Posting-side noise removal: job-board tail ("- Glassdoor 4.1", "via LinkedIn") and a
    trailing decimal rating; surrounding whitespace stripped. Null -> ""."""
    c = _c(col)
    s = F.regexp_replace(py_strip(c), "(?iU)" + SITE_TAIL_PATTERN.replace(r"\s", _WS), "")
    s = F.regexp_replace(s, "(?U)" + RATING_TAIL_PATTERN.replace(r"\s", _WS), "")
    return F.when(c.isNull(), F.lit("")).otherwise(py_strip(s))


def company_key(col: Column | str) -> Column:
    """Posting company -> key used for matching: clean, then normalise."""
    return normalize_company(clean_company_name(col))


def token_sort(col: Column | str) -> Column:
    """Tokens sorted and re-joined with single spaces (input of the order-insensitive score)."""
    return F.array_join(F.array_sort(F.split(_c(col), " ")), " ")


def despaced_variant(col: Column | str) -> Column:
    """Run-together form for initial-style names ("jp morgan" -> "jpmorgan"): only when there are
    at least two tokens, the first has at most 3 characters and the joined form has 4+; else null."""
    c = _c(col)
    t = F.split(c, " ")
    joined = F.array_join(t, "")
    ok = (F.size(t) >= 2) & (F.length(t.getItem(0)) <= 3) & (F.length(joined) >= 4) & (c != "")
    return F.when(ok, joined)


def _generic_array() -> Column:
    return F.array(*[F.lit(t) for t in GENERIC_TOKENS])


def is_distinctive(tok: Column, min_len: int) -> Column:
    return (~F.array_contains(_generic_array(), tok)) & (F.length(tok) >= min_len)


def has_fuzzy_anchor(col: Column | str) -> Column:
    """Gate of both fuzzy stages: one token that is not generic and has 3+ characters."""
    return F.exists(F.split(_c(col), " "), lambda t: is_distinctive(t, MIN_FUZZY_TOKEN_LEN))


def subset_anchors(col: Column | str) -> Column:
    """Tokens that may anchor a containment match: not generic, 4+ characters."""
    return F.filter(F.array_distinct(F.split(_c(col), " ")),
                    lambda t: is_distinctive(t, MIN_SUBSET_TOKEN_LEN))
