"""The index of terms against a pattern for every (text, term) pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lcarank.constants import SKILLS
from lcarank.operators.term_index import find_terms, skill_table
from lcarank.operators.vocab import resume_keywords, resume_terms

SKILL_NAMES = sorted({v for vs in SKILLS.values() for v in vs})


def _holds(text, term):
    return re.search(f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", text) is not None


def _texts(n=120):
    rng = random.Random(4)
    parts = [*SKILL_NAMES, "x", "java2", "net", "+", "#", "é", "\n", "  ", "a.b", "asp", "日本", "😀", "spring  boot", "c", "r&d"]
    glue = [" ", " ", " ", ", ", "", ".", "/", "-", "\t", "_"]
    return ["".join(p + rng.choice(glue) for p in rng.choices(parts, k=rng.randint(0, 40))) for _ in range(n)] + ["", None, " ", "c++", ".net", "asp.net .net", "a" * 5000]


@pytest.mark.parametrize("few_heads", [2000, 5])
def test_equal_to_patterns(spark, few_heads):
    """With words intersected, and with words joined and texts met again."""
    terms = sorted({*SKILL_NAMES, "++", "r&d", "日本", "😀", "x", "a.b", "spring boot x", " ", "-", "not there at all, ever"})
    texts = _texts()
    td = spark.createDataFrame(list(enumerate(texts)), "id int, low string").repartition(3)
    dictionary = spark.createDataFrame([(t, len(t)) for t in terms], "term string, own int")
    out = find_terms(td, dictionary, "term", ["low"], few_heads)
    assert out.columns == ["id", "term", "own", "place"]
    got = [(r.id, r.term) for r in out.collect()]
    want = {(i, t) for i, x in enumerate(texts) for t in terms if x is not None and _holds(x, t)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_places(spark):
    td = spark.createDataFrame([(1, "java and c++", "java java", None), (2, None, "", "c++")], "id int, a string, b string, c string")
    terms = spark.createDataFrame([("java",), ("c++",), ("",), (None,)], "term string")
    got = sorted((r.id, r.term, r.place) for r in find_terms(td, terms, "term", ["a", "b", "c"]).collect())
    assert got == [(1, "c++", 0), (1, "java", 0), (1, "java", 1), (2, "c++", 2)]


def test_empty_dictionary_and_texts(spark):
    td = spark.createDataFrame([(1, "java")], "id int, low string")
    none = spark.createDataFrame([], "term string")
    assert find_terms(td, none, "term", ["low"]).count() == 0
    assert find_terms(td.limit(0), td.select(F.col("low").alias("term")), "term", ["low"]).count() == 0


def test_large_dictionary_is_joined(spark):
    """A dictionary beyond the broadcast threshold is shuffled with the words; the result is the same."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    terms = spark.range(200_000).select(F.concat(F.lit("t"), "id", F.lit(" of "), F.col("id") % 7).alias("term"))
    texts = spark.range(300).select("id", F.concat(F.lit("see t"), F.col("id") * 601, F.lit(" of "), F.col("id") % 7, F.lit("!")).alias("low"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = sorted((r.id, r.term) for r in find_terms(texts, terms, "term", ["low"]).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == sorted((i, f"t{i * 601} of {i % 7}") for i in range(300) if i * 601 < 200_000 and (i * 601) % 7 == i % 7)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plan_does_not_grow_with_the_dictionary(spark):
    resumes = spark.createDataFrame([(1, "Senior Java Engineer, c++")], "resume_id bigint, text string")
    table = lambda rows: spark.createDataFrame(rows, "canonical string, variant string")
    few = table([("java", "java"), ("c++", "c++"), ("a", "a b")])
    many = table([(f"s{i}", f"s{i}" + ("++" if i % 2 else " x")) for i in range(1900)])
    assert len(_plan(resume_keywords(resumes, many)).splitlines()) == len(_plan(resume_keywords(resumes, few)).splitlines())
    # the PII strip (three patterns) is in the plan once, however many expressions read it; one more makes a term's pattern
    assert len(re.findall(r"regexp_replace", _plan(resume_keywords(resumes)))) == 4
    assert {r.kw for r in resume_keywords(resumes, few).collect()} == {"java", "c++"}


@pytest.mark.parametrize("text,want", [("Senior Java Engineer at x", (["java"], [])), (None, ([], [])), ("", ([], [])),
                                       ("Lead Engineer, golang", (["go", "lead engineer"], ["lead engineer"]))])
def test_resume_terms(spark, text, want):
    r = resume_terms(spark.createDataFrame([(1, text)], "resume_id bigint, text string")).first()
    assert (r.kws, r.titles) == want


def test_curated_skills_are_a_table(spark):
    assert skill_table(spark).count() == sum(map(len, SKILLS.values()))


def test_few_terms_move_no_text(spark):
    """Texts with hot words would else meet at the word: a task would read all of them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(i, f"java and spring boot {i}") for i in range(50)], "id int, low string")
        terms = spark.createDataFrame([(t,) for t in ("java", "spring boot", "spring", "boots", "7")], "kw string")
        got = find_terms(texts, terms, "kw", ["low"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        want = sorted((i, t) for i in range(50) for t in ["java", "spring boot", "spring"] + ["7"] * (i == 7))
        assert sorted((r.id, r.kw) for r in got.collect()) == want
        for few in ({"few_terms": 2}, {"few_heads": 1}):
            assert sorted((r.id, r.kw) for r in find_terms(texts, terms, "kw", ["low"], **few).collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
