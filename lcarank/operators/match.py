"""Employer resolution: posting company names -> allowlist keys.

Cascade per name string (later stages only see names with no earlier hit):

    length gate (3+ chars, applies even to exact) -> exact key join -> fuzzy gate (a non-generic
    token of 3+ chars) -> similarity join (token-sorted, >= threshold) -> containment join ->
    none

Near-tie choice (both fuzzy stages): candidates within 1.0 point of the best score, then most
filings, then higher score, then earliest key (first_ord) — two aggregates on one shuffle.

Each distinct raw name is decided once (``distinct`` + join back). A run-together variant
("jp morgan" -> "jpmorgan") is tried only when the plain name is not an exact hit; the better of
the two wins by method rank, then (confidence, filings) strictly greater, else plain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcarank.constants import FUZZY_THRESHOLD, METHOD_RANK, MIN_NAME_LEN, TIE_BAND
from lcarank.functions.names import company_key, despaced_variant, has_fuzzy_anchor
from lcarank.operators.containment import containment_pairs
from lcarank.operators.similarity import similarity_pairs
from lcarank.session import materialize

DECISION_SCHEMA = "v string, norm_name string, confidence double, method string"


def best_candidate(pairs: DataFrame, allow: DataFrame, band: float = TIE_BAND) -> DataFrame:
    """pairs(v, norm_name, score) -> one (v, norm_name, score) per name: within ``band`` of the
    top score, most filings, then higher score, then earliest key.

    Of candidates with equal scores only the best can win, whatever the top score is, so the state of a name
    is one candidate for each score that it has (a score is made of two lengths and a distance: a few
    hundred at most). Both aggregates use the one shuffle by name."""
    ranked = pairs.join(allow.select("norm_name", "filings", "first_ord"), "norm_name").repartition("v")
    alike = ranked.groupBy("v", "score").agg(F.min(F.struct(
        (-F.col("filings")).alias("f"), F.col("first_ord").alias("o"), F.col("norm_name").alias("key"))).alias("b"))
    state = alike.groupBy("v").agg(F.max("score").alias("top"), F.collect_list(F.struct("score", "b")).alias("c"))
    near = F.filter("c", lambda x: x["score"] >= F.col("top") - F.lit(band))
    first = F.array_min(F.transform(near, lambda x: F.struct(x["b"]["f"].alias("f"), (-x["score"]).alias("s"), x["b"]["o"].alias("o"), x["b"]["key"].alias("key"))))
    return state.select("v", first.alias("w")).select("v", F.col("w.key").alias("norm_name"), (-F.col("w.s")).alias("score"))


def decide(strings: DataFrame, allow: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """strings(v) -> (v, norm_name, confidence, method) for every v with a hit; names without a
    row decided 'none'.

    Exact hits leave the cascade before the expensive similarity join. Both fuzzy stages then run
    on the remaining names and the stage order is applied by one aggregate (fuzzy before
    fuzzy-subset), so every stage result is consumed once."""
    keys = allow.select("norm_name")
    s = strings.select("v").filter(F.length("v") >= MIN_NAME_LEN)
    exact = (s.join(keys, s.v == keys.norm_name)
             .select("v", "norm_name", F.lit(100.0).alias("confidence"), F.lit("exact").alias("method"),
                     F.lit(3).alias("_stage")))
    rest = s.join(keys, s.v == keys.norm_name, "left_anti").filter(has_fuzzy_anchor(F.col("v")))
    fuzzy = (best_candidate(similarity_pairs(rest, keys, threshold), allow)
             .select("v", "norm_name", F.col("score").alias("confidence"), F.lit("fuzzy").alias("method"),
                     F.lit(2).alias("_stage")))
    subset = (best_candidate(containment_pairs(rest, keys, threshold), allow)
              .select("v", "norm_name", F.col("score").alias("confidence"),
                      F.lit("fuzzy-subset").alias("method"), F.lit(1).alias("_stage")))
    staged = fuzzy.unionByName(subset)
    first = (staged.groupBy("v").agg(F.max_by(F.struct("norm_name", "confidence", "method"), F.col("_stage")).alias("d"))
             .select("v", "d.norm_name", "d.confidence", "d.method"))
    return exact.drop("_stage").unionByName(first)


def method_rank(method: Column) -> Column:
    expr = F.lit(0)
    for name, rank in METHOD_RANK.items():
        expr = F.when(method == name, F.lit(rank)).otherwise(expr)
    return expr


def match_names(raw_names: DataFrame, allow: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """raw_names(company_raw) -> company_raw, norm_used, norm_name (null if none), confidence,
    method — one row per distinct raw name."""
    # the distinct names are read by every stage of the cascade: written once (a small table,
    # one row per distinct company string) so the postings are scanned and cleaned a single time
    names = materialize(raw_names.select("company_raw").distinct()
                        .withColumn("v0", company_key(F.col("company_raw"))))
    keys = allow.select(F.col("norm_name").alias("_k"))
    gated = names.join(keys, (names.v0 == keys._k) & (F.length(names.v0) >= MIN_NAME_LEN), "left")
    plain_exact = (gated.filter(F.col("_k").isNotNull())
                   .select("company_raw", F.col("v0").alias("norm_used"), F.col("_k").alias("norm_name"),
                           F.lit(100.0).alias("confidence"), F.lit("exact").alias("method")))
    open_names = gated.filter(F.col("_k").isNull()).select("company_raw", "v0")
    variants = (open_names.select("company_raw", "v0", F.lit(0).alias("variant"), F.col("v0").alias("v"))
                .unionByName(open_names.select("company_raw", "v0", F.lit(1).alias("variant"),
                                               despaced_variant(F.col("v0")).alias("v"))
                             .filter(F.col("v").isNotNull())))
    # filings are joined to the decided names only: undecided ones would all meet at the null key
    decided = decide(variants.select("v").distinct(), allow, threshold).join(allow.select("norm_name", "filings"), "norm_name")
    joined = variants.join(decided, "v", "left")
    order = F.struct(method_rank(F.coalesce(F.col("method"), F.lit("none"))).alias("rk"),
                     F.coalesce(F.col("confidence"), F.lit(0.0)).alias("c"),
                     F.coalesce(F.col("filings"), F.lit(-1)).alias("f"),
                     (-F.col("variant")).alias("pv"))
    picked = (joined.groupBy("company_raw").agg(
        F.first("v0").alias("norm_used"),
        F.max_by(F.struct("norm_name", "confidence", "method"), order).alias("b"))
        .select("company_raw", "norm_used", F.col("b.norm_name").alias("norm_name"),
                F.coalesce(F.col("b.confidence"), F.lit(0.0)).alias("confidence"),
                F.coalesce(F.col("b.method"), F.lit("none")).alias("method")))
    return plain_exact.unionByName(picked)


def match_postings(postings: DataFrame, allow: DataFrame, threshold: float = FUZZY_THRESHOLD,
                   keep_unmatched: bool = False) -> DataFrame:
    """Postings with their sponsor: adds norm_used, emp_key (matched key), raw_name, filings,
    latest_year, confidence, method. Unmatched postings are dropped unless ``keep_unmatched``."""
    decisions = match_names(postings.select("company_raw"), allow, threshold)
    sponsor = allow.select("norm_name", "raw_name", "filings", "latest_year")
    # sponsors meet the names, one row per company, and not the postings; names without one bypass the join
    known = decisions.filter(F.col("norm_name").isNotNull()).join(sponsor, "norm_name")
    if keep_unmatched:
        known = known.unionByName(decisions.filter(F.col("norm_name").isNull()), allowMissingColumns=True)
    else:
        known = known.filter(F.col("method") != "none")
    return postings.join(known.withColumnRenamed("norm_name", "emp_key"), "company_raw")
