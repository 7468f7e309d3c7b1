"""Input tables derived from the driver's test tables.

The test tables hold no filings, postings or resumes, so those three inputs are derived from
``lineitem``/``part`` (filings), ``documents``/``part``/``events`` (postings) and ``documents``
(resumes). Every document is used and every text is taken whole. The same derivations are
written as SQL in ``lcarank.oracle_sql`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESUME_HEADER = "Pat Doe pat.doe@example.com +1 (555) 010-0199 https://example.com/java"
RESUME_ROLE_LINES = [
    "Senior Backend Engineer. Java, Spring Boot, Kafka, k8s, CI/CD.",
    "Staff Data Engineer; system analyst. Python, SQL, Apache Spark, Golang.",
    "Lead Full Stack Software Engineer. C++, C#, .NET, payments, cards.",
]
POSTING_TITLES = [
    "Senior Java Backend Engineer", " R&amp;D Data Engineer ", "Software Engineer, Payments",
    "C++ Developer", "Mechanical Staff Engineer", "CI/CD Platform Lead",
]
POSTING_TAILS = [" Java, Kafka, AWS and CI/CD.", " Python; SQL; Google cloud.", " Golang or C++/C#, REST.", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, values: list[Column]) -> Column:
    """CASE key WHEN 0 THEN values[0] ... (last value is the ELSE branch)."""
    expr = values[-1]
    for i in range(len(values) - 2, -1, -1):
        expr = F.when(key == i, values[i]).otherwise(expr)
    return expr


def lca_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, row_ord, employer_name, case_status — one row per filing."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey)
    base = F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"))
    employer = _pick(F.col("l_orderkey") % 5, [
        F.concat(F.upper(base), F.lit(" LLC")),
        F.concat(base, F.lit(", Inc.")),
        F.concat(F.lit("The "), base, F.lit(" Co., L.L.C.")),
        F.concat(F.col("p_name"), F.lit("-"), F.col("p_type")),
        F.when(F.col("l_linenumber") == 1, F.lit(None).cast("string"))
         .otherwise(F.concat(base, F.lit(" Corporation"))),
    ])
    status = (F.when(F.col("l_returnflag") == "A", "Certified")
              .when(F.col("l_returnflag") == "N", " CERTIFIED - WITHDRAWN ")
              .when(F.col("l_linestatus") == "O", "Withdrawn")
              .otherwise("Denied"))
    return j.select(
        F.concat(F.lit("LCA_Disclosure_Data_FY"), F.year("l_shipdate").cast("string"),
                 F.lit(".parquet")).alias("source_file"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_ord"),
        employer.alias("employer_name"),
        status.alias("case_status"),
    )


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting feed as fetched (flattened JSON fields, before ingest cleaning)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    # part and events are lookups: a document without a partner stays, with empty fields
    j = docs.join(part, part.p_partkey == docs.doc_id, "left").join(ev, ev.event_id == docs.doc_id, "left")
    d = F.col("doc_id")
    name, ptype = F.col("p_name"), F.col("p_type")
    base = F.concat(name, F.lit(" "), ptype)
    company = _pick(d % 8, [
        F.concat(base, F.lit(" Inc")),
        F.concat(F.lower(base), F.lit(", L.L.C.")),
        F.concat(ptype, F.lit(" "), name),
        name,
        F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1 << 30), F.lit(" "), ptype),
        F.concat(base, F.lit(" - Glassdoor 4.1")),
        F.lit("Global Tech Solutions LLC"),
        F.lit("3M Co"),
    ])
    return j.select(
        F.when(d % 50 == 49, F.lit("")).when(d % 5 == 4, (d - 1).cast("string"))
         .otherwise(d.cast("string")).alias("posting_id"),
        d.alias("fetch_ord"),
        _pick(d % 6, [F.lit(t) for t in POSTING_TITLES]).alias("title"),
        company.alias("company_raw"),
        F.when(d % 3 == 0, F.lit("San Francisco, CA")).otherwise(F.lit("Austin, TX")).alias("location"),
        F.when(d % 11 == 10, F.lit("not-a-date"))
         .otherwise(F.concat(F.col("ts").cast("date").cast("string"), F.lit("T23:30:00-05:00"))).alias("created"),
        F.concat(F.lit("https://example.com/apply/"), d.cast("string")).alias("url"),
        F.concat(F.col("text"), _pick(d % 4, [F.lit(t) for t in POSTING_TAILS])).alias("description"),
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resume_id, text — every document becomes one resume (contact header + role line + text)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = F.col("doc_id")
    return docs.select(
        d.alias("resume_id"),
        F.concat(F.lit(RESUME_HEADER + "\n"), _pick(d % 3, [F.lit(t) for t in RESUME_ROLE_LINES]),
                 F.lit("\n"), F.col("text")).alias("text"),
    )
