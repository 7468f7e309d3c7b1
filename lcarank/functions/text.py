"""Text functions, Column -> Column: PII stripping, whole-token phrase patterns, ISO dates,
HTML entity decoding, title-phrase extraction and search-query building."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lcarank.constants import (BROAD_QUERY, EMAIL_PATTERN, EXCLUDED_TITLE_TOKENS,
                               MAX_QUERIES, MAX_TITLE_MODIFIERS, PHONE_PATTERN, ROLE_NOUNS,
                               TITLE_MODIFIERS, URL_PATTERN)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_pii(col: Column | str) -> Column:
    """Email, then phone, then URL, each replaced by one space (Unicode classes as in Python)."""
    s = F.regexp_replace(_c(col), "(?U)" + EMAIL_PATTERN, " ")
    s = F.regexp_replace(s, "(?U)" + PHONE_PATTERN, " ")
    return F.regexp_replace(s, "(?U)" + URL_PATTERN.replace(r"\S", r"[^\s\x1c-\x1f]"), " ")


def phrase_pattern(phrase: Column | str) -> Column:
    """Regex for a literal phrase that is not glued to a letter or digit on either side."""
    escaped = F.regexp_replace(_c(phrase), r"([^a-z0-9 ])", r"\\$1")
    return F.concat(F.lit("(?<![a-z0-9])"), escaped, F.lit("(?![a-z0-9])"))


def contains_phrase(text: Column | str, phrase: Column | str) -> Column:
    """Whole-token, symbol-aware containment ("c++", "ci/cd", ".net", "spring boot")."""
    return F.regexp_like(_c(text), phrase_pattern(phrase))


def words(text: Column | str) -> Column:
    """Distinct [a-z0-9] runs of a (lowercased) text."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit("[a-z0-9]+"), 0))


_ISO_DATE = (r"^\d{4}-\d{2}-\d{2}"
             r"(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?"
             r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d{1,6})?)?)?)?)?$")


def iso_date(col: Column | str) -> Column:
    """Calendar date of an ISO-8601 timestamp string as written (no zone shift); null when
    missing or not of the form YYYY-MM-DD[Thh[:mm[:ss[.f]]][zone]]."""
    c = _c(col)
    d = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    return F.when(c.rlike(_ISO_DATE), d)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else html.unescape(v))


def html_unescape(col: Column | str) -> Column:
    """HTML entity decoding (full HTML5 entity table). The UDF sees null for texts without '&', so plain
    texts do not travel to Python."""
    c = _c(col)
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def _lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _any_of(words: list[str]) -> str:
    """Pattern of any of the words as a whole [a-z]+ token, by first letter."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by_first.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")(?![a-z])"


_TITLE_WORD = _any_of(ROLE_NOUNS + TITLE_MODIFIERS)
# Possessive: a run of any length is matched in a loop, without recursion.
_TITLE_RUN = f"(?<![a-z]){_TITLE_WORD}(?:[^a-z]++{_TITLE_WORD})++"
#: Stands between two runs; its token is neither a role noun nor a modifier.
_RUN_BREAK = " x "


def extract_titles(text: Column | str) -> Column:
    """Ordered distinct title phrases: at every role noun among the [a-z]+ tokens of the lowercased
    text, take up to MAX_TITLE_MODIFIERS (3) contiguous preceding modifiers; a role noun without
    modifiers gives nothing. Phrases may overlap ("lead" is both a noun and a modifier).

    A phrase stands within a run of two or more role nouns and modifiers, so one pattern cuts these runs out of
    the text and only they are looked at token by token."""
    runs = F.regexp_extract_all(F.lower(_c(text)), F.lit(_TITLE_RUN), 0)
    # the lambda's variable is worked out once, however often it is named
    return F.get(F.transform(F.array(F.array_join(runs, _RUN_BREAK)), _titles_of_runs), F.lit(0))


def _titles_of_runs(runs: Column) -> Column:
    """The token array is zipped once with its copies shifted by 1..3, so the per-token lambda only
    sees its own struct (referring to the array inside the lambda would re-tokenise per token)."""
    tk = F.regexp_extract_all(runs, F.lit("[a-z]+"), 0)
    n = F.size(tk)

    def shifted(k: int) -> Column:
        pad = F.array_repeat(F.lit(None).cast("string"), k)
        return F.when(n > k, F.concat(pad, F.slice(tk, 1, F.greatest(n - k, F.lit(1))))).otherwise(
            F.array_repeat(F.lit(None).cast("string"), n))

    roles, mods = _lit_array(ROLE_NOUNS), _lit_array(TITLE_MODIFIERS)
    depth = range(1, MAX_TITLE_MODIFIERS + 1)
    zipped = F.arrays_zip(tk.alias("t"), *[shifted(k).alias(f"p{k}") for k in depth])

    def at(e: Column) -> Column:
        is_mod = lambda c: F.coalesce(F.array_contains(mods, c), F.lit(False))
        # run[k]: the k tokens before this one are all modifiers (contiguous run)
        run, acc = {}, F.lit(True)
        for k in depth:
            acc = acc & is_mod(e[f"p{k}"])
            run[k] = acc
        words_before = [F.when(run[k], e[f"p{k}"]) for k in reversed(depth) if k > 1]
        phrase = F.concat_ws(" ", *words_before, e["p1"], e["t"])
        return F.when(F.array_contains(roles, e["t"]) & run[1], phrase)

    found = F.transform(F.when(n > 0, zipped), at)
    return F.coalesce(F.array_distinct(F.filter(found, lambda p: p.isNotNull())),
                      F.array().cast("array<string>"))


def build_queries(titles: Column | str) -> Column:
    """Search set: the broad query first, then titles in order that hold no excluded token,
    without duplicates, at most six."""
    excluded = _lit_array(EXCLUDED_TITLE_TOKENS)
    kept = F.filter(_c(titles), lambda t: ~F.arrays_overlap(F.split(t, " "), excluded))
    return F.slice(F.array_distinct(F.concat(F.array(F.lit(BROAD_QUERY)), kept)), 1, MAX_QUERIES)
