"""Scoring, ranking and the per-employer capped digest against windows over all pairs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lcarank.functions.scoring import fit_score, match_label, sponsor_boost, why_text
from lcarank.operators.rank import best_pairs, rank_vocabularies, with_boost
from lcarank.sources.postings import dedupe, ingest, page_limit


def test_boost_and_score(spark):
    # filings, year, newest -> worked out by hand: 2.1 * log10(1 + f) / log10(5001) + 0.9 * recency
    rows = [(5000, 2024, 2024, 3.0), (5000, 2020, 2024, 2.1), (5000, 2023, 2024, 2.775), (5000, 2021, 2024, 2.325), (0, 2024, 2024, 0.0),
            (None, 0, 2024, 0.0), (100000, 2010, 2024, 2.1), (70, 2024, 2024, 1.9509820976), (1, 0, 2024, 1.0708984251)]
    df = spark.createDataFrame(rows, "f bigint, ly int, ny int, want double")
    for r in df.select(sponsor_boost("f", "ly", "ny").alias("b"), "want").collect():
        assert abs(r.b - r.want) < 1e-9
    s = spark.range(1).select(fit_score(F.lit(2), F.lit(1), F.lit(0.125)).alias("a"),
                              fit_score(F.lit(0), F.lit(0), F.lit(2.675)).alias("b")).first()
    assert s.a == 11.12 and s.b == 2.68       # half-even on the decimal value


def test_why_and_label(spark):
    df = spark.createDataFrame([(["kafka", "java"], ["sql", "aws", "b", "c", "d", "e", "f", "g", "h", "i"]),
                                ([], [])], "t array<string>, d array<string>")
    got = [r[0] for r in df.select(why_text("t", "d")).collect()]
    assert got[0] == ("Matches 12 resume terms — title: java, kafka; skills: aws, b, c, d, e, f, g, h")
    assert got[1] == "No direct resume-term overlap; surfaced by your title search."
    lab = spark.createDataFrame([("exact", 100.0), ("fuzzy", 93.5), ("fuzzy-subset", 94.5)], "m string, c double")
    got = [r[0] for r in lab.select(match_label("m", "c")).collect()]
    assert got == ["exact company match (verified)", "fuzzy match, confidence 94 — ⚠ UNVERIFIED — confirm",
                   "fuzzy-subset match, confidence 94 — ⚠ UNVERIFIED — confirm"]


MATCHED = ("posting_id string, fetch_ord bigint, title string, description string, emp_key string, "
           "filings bigint, latest_year int")


def _brute(spark, matched, vocabs, top_n, cap):
    """Every vocabulary with every posting, scored from plain patterns, ranked by windows."""
    terms = spark.createDataFrame([(v, k) for v, ks in vocabs.items() for k in [*ks, "\x00"]], "vocab_id bigint, kw string")
    has = lambda c: F.expr(f"regexp_like(lower({c}), concat('(?<![a-z0-9])', regexp_replace(kw, '([^a-z0-9 ])', '[$1]'), '(?![a-z0-9])'))")
    hits = with_boost(matched).crossJoin(terms).withColumns({"t": has("title"), "d": has("description")})
    scored = hits.groupBy("vocab_id", "fetch_ord", "emp_key", "boost").agg(
        F.sum(F.when(F.col("t"), 5).when(F.col("d"), 1).otherwise(0)).alias("points")) \
        .withColumn("score", F.bround(F.col("points") * F.lit(1.0) + F.col("boost"), 2))
    order = [F.col("score").desc(), F.col("fetch_ord")]
    first = scored.withColumn("er", F.row_number().over(Window.partitionBy("vocab_id", "emp_key").orderBy(*order))).where(F.col("er") <= cap)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("vocab_id").orderBy(*order))).where(F.col("rank") <= top_n)
    return sorted((r.vocab_id, r["rank"], r.fetch_ord, r.score) for r in ranked.collect())


def _matched(spark, rng, n, employers, words):
    rows = []
    for i in range(n):
        name, filings, year = employers[0] if i % 3 == 0 else rng.choice(employers)
        rows.append((str(i), i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))),
                     " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), name, filings, year))
    return spark.createDataFrame(rows, MATCHED)


WORDS = ["java", "kafka", "python", "sql", "golang", "c++", "lead", "data", "engineer", "senior", "other", "words"]
VOCABS = {1: ["java", "kafka"], 2: ["c++", "data engineer", "senior engineer"], 3: [], 4: ["rust"], 5: ["java", "python", "sql", "kafka", "c++"]}


@pytest.mark.parametrize("top_n,cap,n", [(25, 2, 240), (3, 1, 400), (2, 2, 60)])
def test_ranking_equals_windows_over_all_pairs(spark, top_n, cap, n):
    rng = random.Random(top_n * 10 + cap)
    # boosts that end in a half cent (2.775, 2.325), equal boosts, and a hot employer
    employers = [("hot", 4000, 2024), ("h1", 5000, 2023), ("h2", 5000, 2021), ("h3", 9000, 2023)] + [
        (f"e{i}", rng.choice([7, 7, 80, rng.randint(1, 900)]), rng.choice([2021, 2023, 2024])) for i in range(40)]
    matched = _matched(spark, rng, n, employers, WORDS)
    ids = spark.createDataFrame([(v,) for v in VOCABS], "vocab_id bigint")
    terms = spark.createDataFrame([(v, k) for v, ks in VOCABS.items() for k in ks], "vocab_id bigint, kw string")
    out = rank_vocabularies(matched, ids, terms, top_n, cap).collect()
    assert sorted((r.vocab_id, r["rank"], r.fetch_ord, r.score) for r in out) == _brute(spark, matched, VOCABS, top_n, cap)


def test_ranking_of_many_employers(spark):
    n = 100_000
    matched = spark.range(n, numPartitions=8).selectExpr(
        "cast(id as string) posting_id", "id fetch_ord", "case when id % 5 = 0 then 'Java engineer' when id % 7 = 0 then 'senior data engineer' else 'x' end title",
        "case when id % 11 = 0 then 'kafka, sql' else '' end description", "concat('e', id % 50021) emp_key", "1 + id * 37 % 6001 filings", "cast(2020 + id % 5 as int) latest_year")
    vocabs = {1: ["java", "kafka"], 2: ["senior data engineer"], 3: []}
    ids = spark.createDataFrame([(v,) for v in vocabs], "vocab_id bigint")
    terms = spark.createDataFrame([(v, k) for v, ks in vocabs.items() for k in ks], "vocab_id bigint, kw string")
    out = rank_vocabularies(matched, ids, terms, 40, 1).collect()
    assert sorted((r.vocab_id, r["rank"], r.fetch_ord, r.score) for r in out) == _brute(spark, matched, vocabs, 40, 1)


@pytest.mark.parametrize("held", [7, 100, 10**6])
def test_best_pairs_equal_windows(spark, held):
    """Cut down in the tasks, then ranked: the same as ranking all pairs; ties in score, hot employers, few rows held."""
    rng = random.Random(held)
    pairs = [(rng.randint(1, 6), rng.choice(["hot", "hot", *"abcdefgh"]), i, float(rng.choice([1, 2, 2, 3, 5, 5.25])), f"p{i % 5}") for i in range(1500)]
    df = spark.createDataFrame(pairs, "vocab_id long, emp_key string, fetch_ord long, score double, profile string").repartition(4)
    left = best_pairs(df, 9, 2, held)
    order = [F.col("score").desc(), F.col("fetch_ord")]

    def ranked(x):
        first = x.withColumn("er", F.row_number().over(Window.partitionBy("vocab_id", "emp_key").orderBy(*order))).where("er <= 2")
        return sorted(map(tuple, first.withColumn("r", F.row_number().over(Window.partitionBy("vocab_id").orderBy(*order))).where("r <= 9").collect()))

    assert ranked(left) == ranked(df)
    assert left.count() <= (400 if held > 1500 else 1500) and best_pairs(df.limit(0), 9, 2).count() == 0


def test_ranking_of_three_employers(spark):
    """Few employers, many vocabularies: those that share a term with nearly every posting find the rare free ones
    of an employer, and all rows are never paired with all vocabularies."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(600):
        free = i in (3, 250, 555, 599)
        rows.append((str(i), i, "free" if free else "java " + rng.choice(words), "" if free else rng.choice(words), f"e{i % 3}", [10, 4000, 10][i % 3], 2024))
    matched = spark.createDataFrame(rows, MATCHED)
    vocabs = {k: ["java", words[k % 30]] if k % 2 else sorted({words[k % 30], words[(7 * k) % 30]}) for k in range(1, 41)} | {50: [], 51: ["java"], 52: ["nothing"]}
    ids = spark.createDataFrame([(v,) for v in vocabs], "vocab_id bigint")
    terms = spark.createDataFrame([(v, k) for v, ks in vocabs.items() for k in ks], "vocab_id bigint, kw string")
    for top_n, cap in ((25, 2), (4, 2)):
        out = rank_vocabularies(matched, ids, terms, top_n, cap).collect()
        assert sorted((r.vocab_id, r["rank"], r.fetch_ord, r.score) for r in out) == _brute(spark, matched, vocabs, top_n, cap)


def test_no_postings_and_no_vocabularies(spark):
    matched = spark.createDataFrame([("1", 1, "java", "", "acme", 3, 2024)], MATCHED)
    ids, terms = spark.createDataFrame([(1,)], "vocab_id bigint"), spark.createDataFrame([(1, "java")], "vocab_id bigint, kw string")
    assert rank_vocabularies(matched.limit(0), ids, terms).count() == 0
    assert rank_vocabularies(matched, ids.limit(0), terms.limit(0)).count() == 0


def test_extras_and_note(spark):
    posts = [(str(i), i, "Engineer", "java", "acme", 10, 2024) for i in range(5)]
    matched = spark.createDataFrame(posts, MATCHED)
    ids = spark.createDataFrame([(1,)], "vocab_id bigint")
    terms = spark.createDataFrame([(1, "java")], "vocab_id bigint, kw string")
    out = rank_vocabularies(matched, ids, terms, 1, 2).collect()
    assert len(out) == 1 and out[0].extra == 4
    assert out[0].note == "+4 more opening(s) at this employer"
    out = sorted(rank_vocabularies(matched, ids, terms, 25, 2).collect(), key=lambda r: r["rank"])
    assert [r.extra for r in out] == [3, 3] and out[0].note is None and out[1].note.startswith("+3")


RAW = ("posting_id string, fetch_ord bigint, title string, company_raw string, location string, "
       "created string, url string, description string")


def test_ingest_dedupe_and_page_limit(spark):
    raw = spark.createDataFrame([
        ("7", 1, " R&amp;D Lead ", " Acme ", "Austin, TX", "2024-01-05T23:30:00-05:00", "u1", "d"),
        ("7", 2, "dup", "Acme", "Austin, TX", "2024-01-06", "u2", "d"),
        ("", 3, "blank a", "Acme", None, "not-a-date", "u3", None),
        ("", 4, "blank b", None, "SF", None, None, "d"),
        ("8", 5, None, "Initech", "SF", "2024-01-07", "u5", "d"),
    ], RAW)
    got = {r.fetch_ord: r for r in dedupe(ingest(raw)).collect()}
    assert sorted(got) == [1, 3, 4, 5]                        # first id wins; blanks all kept
    assert got[1].title == "R&D Lead" and got[1].company_raw == "Acme"
    assert str(got[1].posted) == "2024-01-05" and got[3].posted is None
    assert got[4].company_raw == "" and got[4].url == "" and got[5].title == ""
    lim = page_limit(raw, "company_raw", pages=1, page_size=1).collect()
    assert sorted(r.fetch_ord for r in lim) == [1, 2, 4, 5]   # one per raw company value


def test_read_posting_pages(spark):
    import json
    import os
    import tempfile

    from lcarank.sources.postings import read_posting_pages

    d = tempfile.mkdtemp(prefix="lcarank-pages-")
    p1 = {"results": [
        {"id": 11, "title": " Data Engineer ", "company": {"display_name": "Acme Inc"},
         "location": {"display_name": "Austin, TX"}, "created": "2026-07-01T12:00:00Z",
         "redirect_url": "u1", "description": "java"},
        {"title": "No id"},
    ]}
    p2 = {"results": [{"id": "11", "title": "dup", "company": {"display_name": "Acme Inc"}}]}
    for name, page in [("page_001.json", p1), ("page_002.json", p2)]:
        with open(os.path.join(d, name), "w") as fh:
            json.dump(page, fh)
    raw = read_posting_pages(spark, d)
    rows = sorted(raw.collect(), key=lambda r: r.fetch_ord)
    assert [r.posting_id for r in rows] == ["11", None, "11"]
    assert rows[0].company_raw == "Acme Inc" and rows[1].company_raw is None
    got = dedupe(ingest(raw)).collect()
    assert sorted((r.posting_id, r.title) for r in got) == [("", "No id"), ("11", "Data Engineer")]


def test_resume_variants_posting_canonical(spark):
    """Resume side matches skill variants, posting side only the canonical term (T9)."""
    from lcarank.operators.rank import posting_hits
    from lcarank.operators.vocab import resume_keywords

    resumes = spark.createDataFrame([(1, "Senior Backend Engineer. Golang, cards; k8s.\nme@x.io")],
                                    "resume_id bigint, text string")
    kws = {r.kw for r in resume_keywords(resumes).collect()}
    assert {"go", "cards", "kubernetes", "senior backend engineer"} <= kws
    assert "golang" not in kws and "k8s" not in kws
    posts = spark.createDataFrame([(1, "Go developer", "cards"), (2, "Golang developer", "card")],
                                  "fetch_ord bigint, title string, description string")
    terms = spark.createDataFrame([(k,) for k in sorted(kws)], "kw string")
    hits = {(r.fetch_ord, r.kw, r.in_title, r.in_desc) for r in posting_hits(posts, terms).collect()}
    assert hits == {(1, "go", True, False), (1, "cards", False, True)}
