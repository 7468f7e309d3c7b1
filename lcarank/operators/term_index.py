"""Which terms of a dictionary stand in which texts, as whole tokens: an index by first words.

A word is a run of [a-z0-9]. A term stands in a text where its characters do, with no letter or digit next to
it on either side ("c++", "ci/cd", ".net", "spring boot"). Then the text has the term's first word among its
words, so terms are looked up by it: the distinct words of a text meet a *table* of terms, of any size, in an
equi-join, and nothing of the table is in the plan. Terms of one word are found by that alone; others are
looked for in the text, few per text. Terms without a word ("++") are looked for in every text.

Up to FEW_HEADS first words of FEW_TERMS terms, a text's words are first intersected with them (one array for the whole
job, from a scalar subquery) and the terms are broadcast, so a text is looked at for the few terms that it may hold and
nothing moves. With more, only keys and words move, and texts with terms of several words are met again by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcarank.constants import SKILLS
from lcarank.functions.text import contains_phrase

#: First words that a text's words are intersected with, and terms that are broadcast to the texts.
FEW_HEADS, FEW_TERMS = 2000, 50_000


def skill_table(spark) -> DataFrame:
    """(canonical, variant) of the curated skill dictionary."""
    return spark.createDataFrame([(c, v) for c, vs in SKILLS.items() for v in vs], "canonical string, variant string")


def _words(low: Column) -> Column:
    """Words of a text, with repeats, and the empty string, which terms without a word have as theirs."""
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0), F.array(F.lit("")))


def find_terms(texts: DataFrame, terms: DataFrame, term: str, places: list[str], few_heads: int = FEW_HEADS, few_terms: int = FEW_TERMS) -> DataFrame:
    """``texts``: other columns (a key) and lower-case texts in the columns ``places``; ``terms``: distinct strings in
    ``term``, other columns as they like. -> key, the columns of ``terms``, ``place`` (number of the column), a row for each
    term that stands in a place. Null texts hold nothing; an empty term stands nowhere."""
    keys = [c for c in texts.columns if c not in places]
    own = [c for c in terms.columns]
    listed = terms.where(F.col(term) != "").withColumn("_head", F.regexp_extract(term, "[a-z0-9]+", 0)).withColumn("_one", F.col("_head") == F.col(term))
    heads = listed.select("_head").distinct()
    each = F.array(*(F.struct(F.lit(i).alias("place"), F.col(p).alias("low")) for i, p in enumerate(places)))
    # explode_outer: from a plain explode Spark derives a filter on the array's size, which makes the array twice
    placed = texts.select(*keys, F.explode_outer(each).alias("p")).select(*keys, "p.place", "p.low") if len(places) > 1 else \
        texts.select(*keys, F.lit(0).alias("place"), F.col(places[0]).alias("low"))
    stands = F.col("_one") | (F.contains("low", term) & contains_phrase("low", term))
    sizes = listed.agg(F.count_distinct("_head").alias("heads"), F.count(F.lit(1)).alias("terms")).first()
    if sizes["heads"] <= few_heads and sizes["terms"] <= few_terms:
        known = heads.agg(F.collect_list("_head")).scalar()
        words = placed.select(*keys, "place", "low", F.explode_outer(F.array_intersect(_words(F.col("low")), known)).alias("_head"))
        return words.join(F.broadcast(listed), "_head").where(stands).select(*keys, *own, "place")
    words = placed.select(*keys, "place", F.explode_outer(F.array_distinct(_words(F.col("low")))).alias("_head"))
    near = words.join(listed, "_head")
    several = near.where(~F.col("_one")).join(placed, [*keys, "place"]).where(stands)
    return near.where("_one").select(*keys, *own, "place").unionByName(several.select(*keys, *own, "place"))
