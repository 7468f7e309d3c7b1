"""Scoring and labelling expressions, Column -> Column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lcarank.constants import (BOOST_RECENCY_SHARE, BOOST_VOLUME_SHARE, DESC_WEIGHT,
                               MAX_BOOST, NO_OVERLAP_WHY, RECENCY_DECAY_PER_YEAR, TITLE_WEIGHT,
                               VOLUME_REF, WHY_MAX_SKILLS)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sponsor_boost(filings: Column | str, latest_year: Column | str, newest_year: Column | str) -> Column:
    """Small capped employer boost: 3 * (0.7 * volume + 0.3 * recency).

    volume = min(1, log10(1 + filings) / log10(1 + 5000)); recency = max(0, 1 - 0.25 * years
    behind the newest matched year), or 1 when either year is unknown (0). No sponsor or no
    filings -> 0."""
    f, ly, ny = _c(filings), _c(latest_year), _c(newest_year)
    volume = F.least(F.lit(1.0), F.log10(F.lit(1.0) + f) / F.lit(math.log10(1 + VOLUME_REF)))
    behind = F.greatest(F.lit(0), ny - ly)
    recency = F.when((ny != 0) & (ly != 0),
                     F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(RECENCY_DECAY_PER_YEAR) * behind)
                     ).otherwise(F.lit(1.0))
    boost = F.lit(MAX_BOOST) * (F.lit(BOOST_VOLUME_SHARE) * volume + F.lit(BOOST_RECENCY_SHARE) * recency)
    return F.when(f.isNull() | (f <= 0), F.lit(0.0)).otherwise(boost)


def fit_score(n_title: Column | str, n_desc_only: Column | str, boost: Column | str) -> Column:
    """5 per title hit + 1 per description-only hit + boost, rounded half-even to 2 places."""
    raw = (F.lit(TITLE_WEIGHT) * _c(n_title) + F.lit(DESC_WEIGHT) * _c(n_desc_only)) + _c(boost)
    return F.bround(raw, 2)


def why_text(title_terms: Column | str, desc_only_terms: Column | str) -> Column:
    """'Matches N resume terms — title: a, b; skills: c, d' (terms sorted, at most 8 skills)."""
    t, d = F.array_sort(_c(title_terms)), F.array_sort(_c(desc_only_terms))
    total = F.size(t) + F.size(d)
    parts = F.concat_ws(
        "; ",
        F.when(F.size(t) > 0, F.concat(F.lit("title: "), F.array_join(t, ", "))),
        F.when(F.size(d) > 0, F.concat(F.lit("skills: "), F.array_join(F.slice(d, 1, WHY_MAX_SKILLS), ", "))),
    )
    return F.when(total == 0, F.lit(NO_OVERLAP_WHY)).otherwise(
        F.concat(F.lit("Matches "), total.cast("string"), F.lit(" resume terms — "), parts))


def match_label(method: Column | str, confidence: Column | str, markdown: bool = False) -> Column:
    """'exact company match (verified)' or '<method> match, confidence NN — ⚠ UNVERIFIED — confirm'
    (confidence printed with no decimals, ties to even as Python's format does)."""
    flag = "**⚠ UNVERIFIED — confirm**" if markdown else "⚠ UNVERIFIED — confirm"
    conf = F.bround(_c(confidence), 0).cast("bigint").cast("string")
    return F.when(_c(method) == "exact", F.lit("exact company match (verified)")).otherwise(
        F.concat(_c(method), F.lit(" match, confidence "), conf, F.lit(" — " + flag)))

