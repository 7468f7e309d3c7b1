"""Employer resolution cascade: golden rows for the traps (length gate, de-spaced variant,
near-tie band) and the allowlist build."""

from pyspark.sql import functions as F

from lcarank.operators.allowlist import allowlist_stats, build_allowlist, spot_check
from lcarank.operators.match import match_names, match_postings

ALLOW_SCHEMA = ("norm_name string, raw_name string, filings bigint, latest_year int, "
                "first_ord struct<file:string,row:bigint,raw:string>")


def _allow(spark, rows):
    return spark.createDataFrame(
        [(k, k, f, 2024, (f"f{i}", i, k)) for i, (k, f) in enumerate(rows)], ALLOW_SCHEMA)


def _decide(spark, allow_rows, names):
    allow = _allow(spark, allow_rows)
    raw = spark.createDataFrame([(n,) for n in names], "company_raw string")
    return {r.company_raw: (r.norm_name, r.confidence, r.method) for r in match_names(raw, allow).collect()}


def test_length_gate_beats_exact(spark):
    got = _decide(spark, [("3m", 10), ("acme", 1)], ["3M Co", "Acme Inc"])
    assert got["3M Co"] == (None, 0.0, "none")
    assert got["Acme Inc"] == ("acme", 100.0, "exact")


def test_despaced_exact_is_exact(spark):
    got = _decide(spark, [("jpmorgan", 9)], ["J.P. Morgan"])
    assert got["J.P. Morgan"] == ("jpmorgan", 100.0, "exact")


def test_despaced_not_tried_after_plain_exact(spark):
    got = _decide(spark, [("jp morgan", 1), ("jpmorgan", 9)], ["J.P. Morgan"])
    assert got["J.P. Morgan"] == ("jp morgan", 100.0, "exact")


def test_band_prefers_filings_over_score(spark):
    rows = [("northwind tradings supply partners", 1),      # 98.51
            ("northwind trading suply partners", 9),        # 98.46, within 1.0 and more filings
            ("northwinds tradings supply partners", 50)]    # 97.06, outside the band
    got = _decide(spark, rows, ["Northwind Trading Supply Partners LLC"])
    key, conf, method = got["Northwind Trading Supply Partners LLC"]
    assert (key, method) == ("northwind trading suply partners", "fuzzy")
    assert abs(conf - 200 * 32 / 65) < 1e-9                 # the chosen key's own score


def test_token_order_is_fuzzy_100(spark):
    got = _decide(spark, [("acme widget works", 3)], ["Widget Works Acme"])
    assert got["Widget Works Acme"] == ("acme widget works", 100.0, "fuzzy")


def test_subset_stage_and_generic_gate(spark):
    rows = [("stark industries holdings", 3), ("stark industries robotics", 7),
            ("global tech solutions", 100)]
    got = _decide(spark, rows, ["Stark", "Global Tech Solutions Group", "Red Rod"])
    assert got["Stark"] == ("stark industries robotics", 100.0, "fuzzy-subset")   # most filings
    assert got["Global Tech Solutions Group"][2] == "none"                       # generic words only
    assert got["Red Rod"][2] == "none"


def test_match_postings_drops_unmatched_unless_audit(spark):
    allow = _allow(spark, [("acme", 4)])
    posts = spark.createDataFrame([("1", 1, "Acme LLC"), ("2", 2, "Nobody Here")],
                                  "posting_id string, fetch_ord bigint, company_raw string")
    kept = match_postings(posts, allow)
    assert [r.posting_id for r in kept.collect()] == ["1"]
    audit = {r.posting_id: r.method for r in match_postings(posts, allow, keep_unmatched=True).collect()}
    assert audit == {"1": "exact", "2": "none"}


FILINGS = "source_file string, row_ord bigint, employer_name string, case_status string"


def test_build_allowlist_first_seen_and_counts(spark):
    rows = [
        ("LCA_FY2021.parquet", 5, "ACME LLC", "Certified"),
        ("LCA_FY2020.parquet", 9, "Acme, Inc.", " CERTIFIED - WITHDRAWN "),
        ("LCA_FY2020.parquet", 3, "Acme Corp ", "certified"),
        ("LCA_FY2022.parquet", 1, "Acme", "Denied"),
        ("LCA_FY2022.parquet", 2, None, "Certified"),
        ("LCA_FY2022.parquet", 4, "", "Certified"),
        ("LCA_FY2022.parquet", 6, "!!!", "Certified"),
        ("LCA_1999.parquet", 7, "Initech", "Certified"),
        ("LCA_FY2022.parquet", 8, "Initech", None),
    ]
    f = spark.createDataFrame(rows, FILINGS)
    got = {r.norm_name: r for r in build_allowlist(f).collect()}
    assert set(got) == {"acme", "initech"}
    assert got["acme"].filings == 3 and got["acme"].latest_year == 2021
    assert got["acme"].raw_name == "Acme Corp"               # earliest (file, row), stripped
    assert got["initech"].latest_year == 0                   # 19xx files carry no fiscal year
    stats = allowlist_stats(f).first()
    assert (stats.files, stats.rows_total, stats.rows_certified, stats.employers_unique) == (4, 9, 7, 2)


def test_spot_check(spark):
    allow = _allow(spark, [("google", 12)])
    names = spark.createDataFrame([("full", "Google LLC"), ("bare", "Meta")], "kind string, name string")
    got = {r.name: (r.norm_key, r.hit, r.filings) for r in spot_check(allow, names).collect()}
    assert got == {"Google LLC": ("google", True, 12), "Meta": ("meta", False, None)}


def test_best_candidate_equals_sorting_all(spark):
    """One aggregate state per name against sorting all of its candidates; no window, one shuffle by name."""
    import random

    from lcarank.operators.match import best_candidate

    rng = random.Random(9)
    keys = [(f"k{i}", rng.choice([1, 5, 5, 9, 40]), (rng.choice(["a", "b"]), rng.randint(0, 5), f"raw{i}")) for i in range(60)]
    allow = spark.createDataFrame(keys, "norm_name string, filings long, first_ord struct<file:string,row:long,raw:string>")
    pairs = [(f"v{n}", k, rng.choice([93.0, 93.4, 94.0, 94.2, 95.0, 99.9, 100.0, 98.95])) for n in range(40) for k, _, _ in rng.sample(keys, rng.randint(1, 25))]
    df = spark.createDataFrame(pairs, "v string, norm_name string, score double").repartition(5)
    own = {k: (f, o) for k, f, o in keys}
    want = {}
    for v in {p[0] for p in pairs}:
        mine = [(k, s) for n, k, s in pairs if n == v]
        top = max(s for _, s in mine)
        want[v] = min(((-own[k][0], -s, own[k][1], k, s) for k, s in mine if s >= top - 1.0))[3:]
    out = best_candidate(df, allow)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {r.v: (r.norm_name, r.score) for r in out.collect()} == want
    assert "Window" not in plan and plan.count("REPARTITION_BY_COL") == 1 and plan.count("Exchange hashpartitioning(v") == 1
    assert best_candidate(df.limit(0), allow).count() == 0
