"""Employer allowlist: certified filings grouped by normalised employer key.

Two aggregates: first per (raw employer string, file) — plain hash aggregate over the raw columns,
combined map-side — then per normalised key over those (far fewer) groups: filings = sum,
latest_year = max fiscal year, first_ord = earliest (file, row, raw name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcarank.functions.names import PY_WHITESPACE, normalize_company, py_strip
from lcarank.sources.filings import fiscal_year

ALLOWLIST_COLUMNS = ["norm_name", "raw_name", "filings", "latest_year", "first_ord"]

# FIXED VALUES — known-sponsor spot check names (full legal names, then bare brands).
SPOT_CHECK_NAMES = [
    ("full", "Google LLC"), ("full", "Amazon.com Services LLC"),
    ("full", "Cognizant Technology Solutions US Corp"), ("full", "Infosys Limited"),
    ("full", "Microsoft Corporation"), ("full", "Meta Platforms, Inc."),
    ("bare", "Meta"), ("bare", "Stripe"), ("bare", "Nvidia"), ("bare", "Databricks"),
    ("bare", "Google"), ("bare", "Amazon"),
]


def is_certified(status) -> F.Column:
    """Status, stripped and lowercased, starts with 'certified' (null -> false). As one anchored pattern: no
    other letters than A-Z and a-z are lowercased to those of the word."""
    return F.coalesce(F.rlike(status, F.lit(rf"\A[{PY_WHITESPACE}]*(?i:certified)")), F.lit(False))


def _named(c: F.Column) -> F.Column:
    return c.isNotNull() & (c != "")


def raw_groups(filings: DataFrame) -> DataFrame:
    """One row per (raw employer string, source file): all rows, certified rows, certified rows
    with a non-empty employer, and the earliest certified row. Pure hash aggregate on the raw
    columns, combined map-side, so a hot employer collapses in every task before the shuffle and
    the costly name normalisation below runs once per distinct string instead of once per row."""
    cert = F.col("_cert")  # as a column: worked out once for the three
    return filings.withColumn("_cert", is_certified(F.col("case_status"))).groupBy("employer_name", "source_file").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(cert).alias("n_cert"),
        F.count_if(cert & _named(F.col("employer_name"))).alias("n_keep"),
        F.min(F.when(cert, F.col("row_ord"))).alias("first_row"),
    )


def keyed_filings(filings: DataFrame) -> DataFrame:
    """Per (raw employer, file) with certified filings and a non-empty key: norm_name, fiscal
    year, filing count and the (file, row, raw) ordinal of its first certified row."""
    g = raw_groups(filings).filter(F.col("n_keep") > 0)
    return (g.select(
        normalize_company(F.col("employer_name")).alias("norm_name"),
        fiscal_year(F.col("source_file")).alias("fy"),
        F.col("n_keep").alias("n"),
        F.struct(F.col("source_file").alias("file"), F.col("first_row").alias("row"),
                 F.col("employer_name").alias("raw")).alias("ord"))
        # not "norm_name != ''": Spark would move that below the aggregate and normalise the name of every row
        .filter(F.length("norm_name") * F.col("n") > 0))


def build_allowlist(filings: DataFrame) -> DataFrame:
    """norm_name, raw_name, filings, latest_year, first_ord — one row per employer key.

    first_ord = earliest (file, row, raw name): the ordinal that stands in for "first seen" (Spark
    has no row order); raw_name = that row's stripped raw name."""
    agg = keyed_filings(filings).groupBy("norm_name").agg(
        F.sum("n").alias("filings"),
        F.max("fy").alias("latest_year"),
        F.min("ord").alias("first_ord"),
    )
    return agg.select("norm_name", py_strip(F.col("first_ord.raw")).alias("raw_name"),
                      "filings", "latest_year", "first_ord")


def allowlist_stats(filings: DataFrame) -> DataFrame:
    """One row: files, rows_total, rows_certified (counted before the empty-employer test) and
    employers_unique — from the per-(raw name, file) groups, so keys are computed per distinct
    raw string."""
    g = raw_groups(filings)
    key = F.when(F.col("n_keep") > 0, normalize_company(F.col("employer_name")))
    return g.agg(
        F.count_distinct("source_file").alias("files"),
        F.sum("n_rows").alias("rows_total"),
        F.sum("n_cert").alias("rows_certified"),
        F.count_distinct(F.when(key != "", key)).alias("employers_unique"),
    )


def filing_accounts(filings: DataFrame) -> DataFrame:
    """Per file of ``read_filings(..., short_rows=True)``: rows (all), short_rows (they end before the employer or the
    status and count as nothing else), rows_certified, and rows_named, the certified with an employer."""
    cert = is_certified(F.col("case_status")) & ~F.col("short")
    return filings.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("short").alias("short_rows"), F.count_if(cert).alias("rows_certified"),
        F.count_if(cert & _named(F.col("employer_name"))).alias("rows_named"))


def allowlist_sample(allow: DataFrame, n: int = 20) -> DataFrame:
    """A reproducible inspection sample: the n keys first in md5 order (a top-k)."""
    return (allow.withColumn("_h", F.md5("norm_name")).orderBy("_h").limit(n)
            .select("norm_name", "raw_name", "filings", "latest_year"))


def spot_check(allow: DataFrame, names: DataFrame) -> DataFrame:
    """names(kind, name) -> name, key, hit, filings, latest_year (exact key lookup)."""
    probe = names.select("kind", "name", normalize_company(F.col("name")).alias("norm_key"))
    hit = probe.join(allow.select("norm_name", "filings", "latest_year"),
                     probe.norm_key == allow.norm_name, "left")
    return hit.select("kind", "name", "norm_key", F.col("norm_name").isNotNull().alias("hit"),
                      "filings", "latest_year")
