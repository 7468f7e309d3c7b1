"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator of the inventory.

Every query reads the driver's tables (through ``lcarank.sources.views``) in full; column names
match the DuckDB oracle statements in ``lcarank.oracle_sql``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcarank.constants import FUZZY_THRESHOLD, MIN_NAME_LEN
from lcarank.functions.names import (clean_company_name, company_key, despaced_variant,
                                     has_fuzzy_anchor, token_sort)
from lcarank.functions.text import strip_pii
from lcarank.operators import allowlist as AL
from lcarank.operators.containment import containment_pairs
from lcarank.operators.match import match_names, match_postings
from lcarank.operators.rank import posting_hits, profile_scores, profiles_of, vocabularies, with_boost, with_terms
from lcarank.operators.similarity import similarity_pairs
from lcarank.operators.vocab import resume_keywords, resume_report
from lcarank.plans import digest as D
from lcarank.sources import views
from lcarank.sources import filings as FI
from lcarank.sources.filings import fiscal_year, read_filings
from lcarank.session import ensure_checkpoint_dir, materialize
from lcarank.sources.postings import dedupe, in_location, ingest, page_limit, read_posting_pages, recent, write_posting_pages

AS_OF = "2024-01-31"          # run date used by the recency query (the feed spans January 2024)
LOCATION = "san francisco"
FILTERED_AS_OF, FILTERED_PAGES, FILTERED_LOCATION = "2024-01-24", 3, "austin"    # of the filtered digest
GENERATED_ON = "2024-01-31"


def _allow(spark, sf):
    return D.allowlist(spark, sf)


def _postings(spark, sf):
    return D.materialize(dedupe(ingest(views.raw_postings(spark, sf))))


def _open_names(spark, sf):
    """Distinct plain keys of posting companies that are not exact hits and pass both gates."""
    allow = _allow(spark, sf)
    names = _postings(spark, sf).select(company_key("company_raw").alias("v")).distinct()
    names = names.filter((F.length("v") >= MIN_NAME_LEN) & has_fuzzy_anchor(F.col("v")))
    return names.join(allow, names.v == allow.norm_name, "left_anti"), allow


def filings_scan(spark, sf):
    f = views.lca_filings(spark, sf)
    return f.select("source_file", "row_ord", "employer_name", "case_status",
                    fiscal_year(F.col("source_file")).alias("fiscal_year"))


# FIXED VALUES — header layouts of the staged yearly filing files (rotated by file), drifting the way
# yearly disclosure files do: renamed columns, extra columns, an employer_city column first.
FILE_LAYOUTS = [
    {"employer_name": "EMPLOYER_NAME", "case_status": "CASE_STATUS"},
    {"employer_name": "LCA_CASE_EMPLOYER_NAME", "case_status": "STATUS", "_city": "EMPLOYER_CITY"},
    {"_city": "employer_city", "employer_name": "Employer Name", "case_status": "Case Status"},
]


def _stage_by_file(spark, rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` written once, by source_file, so that each file is then written from its own partition without deriving
    the filings again; and the names of the files, one per fiscal year: a handful of rows, not data."""
    path = _staging(spark)
    rows.write.partitionBy("source_file").parquet(path)
    staged = spark.read.parquet(path)
    return staged, sorted(r[0] for r in staged.select("source_file").distinct().collect())


def _stage_filing_files(spark, sf):
    """Write the derived filings as one parquet dataset per fiscal-year file name, each with its own
    header layout, plus an editor lock entry that the reader must skip; returns the directory.
    Staged under the session's shared checkpoint directory."""
    base = _staging(spark)
    staged, names = _stage_by_file(spark, views.lca_filings(spark, sf))
    for i, name in enumerate(names):
        layout = FILE_LAYOUTS[i % len(FILE_LAYOUTS)]
        cols = [(F.lit("n/a") if c == "_city" else F.col(c)).alias(h) for c, h in layout.items()]
        staged.where(F.col("source_file") == name).select(*cols).write.parquet(f"{base}/{name}")  # reads one partition
    staged.limit(0).select(F.lit(1).alias("x")).write.parquet(f"{base}/~$lock.parquet")
    return base


def filings_files(spark, sf):
    """Allowlist read back from yearly files with drifting headers (O1-O5 + O40)."""
    a = AL.build_allowlist(read_filings(spark, _stage_filing_files(spark, sf)))
    return a.select("norm_name", "filings", "latest_year")


def filings_files_stats(spark, sf):
    return AL.allowlist_stats(read_filings(spark, _stage_filing_files(spark, sf)))


def header_map(spark, sf):
    """Positions of the employer and status columns in each staged file (O2, O3)."""
    files = FI.list_filing_files(spark, _stage_filing_files(spark, sf), "parquet")
    return FI.header_map(FI.header_rows(spark, FI.file_headers(spark, files, "parquet")))


def _staging(spark) -> str:
    """A new folder for staged files under the session's shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/staging/{uuid.uuid4().hex}"


def _headed(head: str):
    """For ``mapInArrow`` over lines: the header line before the first of every part file."""

    def run(batches):
        import pyarrow as pa

        for k, batch in enumerate(batches):
            line = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([head], line.type), line]) if k == 0 else line], names=["line"])

    return run


def filings_csv(spark, sf):
    """Allowlist from CSV files in which every seventh row breaks off after the employer (O1, O5)."""
    base = _staging(spark)
    f = views.lca_filings(spark, sf)
    name = F.coalesce("employer_name", F.lit("")).alias("name")  # a row of one null field has no CSV text
    line = F.when(F.col("row_ord") % 7 == 0, F.to_csv(F.struct(name))).otherwise(F.to_csv(F.struct(name, "case_status", F.lit("x"))))
    lines, names = _stage_by_file(spark, f.select("source_file", line.alias("line")))
    for name in names:
        lines.where(F.col("source_file") == name).select("line").mapInArrow(_headed("EMPLOYER_NAME,CASE_STATUS,NOTE"), "line string") \
            .write.text(f"{base}/{name.replace('.parquet', '.csv')}")
    read = FI.read_filings(spark, base, "csv")
    return AL.build_allowlist(read).select("norm_name", "filings", "latest_year")


def filings_csv_accounts(spark, sf):
    """Accounts of ragged CSV files: every seventh row breaks off after its first cell, which is the employer in
    every other file and the status in the others (O5, O41)."""
    base = _staging(spark)
    f, names = _stage_by_file(spark, views.lca_filings(spark, sf))
    name = F.coalesce("employer_name", F.lit("")).alias("name")
    for i, file in enumerate(names):
        cells = [name, F.col("case_status")] if i % 2 == 0 else [F.col("case_status"), name]
        head = "EMPLOYER_NAME,CASE_STATUS,NOTE" if i % 2 == 0 else "CASE_STATUS,EMPLOYER_NAME,NOTE"
        line = F.when(F.col("row_ord") % 7 == 0, F.to_csv(F.struct(cells[0]))).otherwise(F.to_csv(F.struct(*cells, F.lit("x").alias("note"))))
        f.where(F.col("source_file") == file).select(line.alias("line")).mapInArrow(_headed(head), "line string") \
            .write.text(f"{base}/{file.replace('.parquet', '.csv')}")
    return AL.filing_accounts(FI.read_filings(spark, base, "csv", short_rows=True))


def allowlist(spark, sf):
    a = AL.build_allowlist(views.lca_filings(spark, sf))
    return a.select("norm_name", "raw_name", "filings", "latest_year",
                    F.col("first_ord.file").alias("first_file"), F.col("first_ord.row").alias("first_row"))


def allowlist_stats(spark, sf):
    return AL.allowlist_stats(views.lca_filings(spark, sf))


def allowlist_sample(spark, sf):
    return AL.allowlist_sample(_allow(spark, sf))


def allowlist_spot_check(spark, sf):
    names = spark.createDataFrame(AL.SPOT_CHECK_NAMES, "kind string, name string")
    return AL.spot_check(_allow(spark, sf), names)


def postings_ingest(spark, sf):
    return ingest(views.raw_postings(spark, sf))


def postings_pages(spark, sf):
    """The feed written as fetched, nested JSON pages of 50 postings with missing fields, and read back (O6); fetch_ord is
    the page times 2 ** 20 and the place in it."""
    base = _staging(spark)
    write_posting_pages(views.raw_postings(spark, sf), base)
    return ingest(read_posting_pages(spark, base))


def postings_dedupe(spark, sf):
    return dedupe(ingest(views.raw_postings(spark, sf)))


def postings_recent(spark, sf):
    return recent(dedupe(ingest(views.raw_postings(spark, sf))), AS_OF)


def postings_location(spark, sf):
    return in_location(dedupe(ingest(views.raw_postings(spark, sf))), LOCATION)


def postings_page_limit(spark, sf):
    return page_limit(views.raw_postings(spark, sf), "title", 1).select("posting_id", "fetch_ord", "title")


def company_keys(spark, sf):
    raw = ingest(views.raw_postings(spark, sf)).select("company_raw").distinct()
    k = raw.withColumn("norm_key", company_key("company_raw"))
    return k.select("company_raw", clean_company_name("company_raw").alias("cleaned"), "norm_key",
                    token_sort("norm_key").alias("sorted_key"),
                    despaced_variant("norm_key").alias("despaced"))


def exact_match(spark, sf):
    allow = _allow(spark, sf)
    names = _postings(spark, sf).select("company_raw").distinct().withColumn("v", company_key("company_raw"))
    hit = names.join(allow, (names.v == allow.norm_name) & (F.length(names.v) >= MIN_NAME_LEN))
    return hit.select("company_raw", "norm_name")


def similarity_join(spark, sf):
    names, allow = _open_names(spark, sf)
    return similarity_pairs(names, allow.select("norm_name"), FUZZY_THRESHOLD)


def containment_join(spark, sf):
    names, allow = _open_names(spark, sf)
    return containment_pairs(names, allow.select("norm_name"), FUZZY_THRESHOLD).select("v", "norm_name")


def match_decisions(spark, sf):
    return match_names(_postings(spark, sf).select("company_raw"), _allow(spark, sf))


def match_audit(spark, sf):
    m = match_postings(_postings(spark, sf), _allow(spark, sf), keep_unmatched=True)
    return m.groupBy("method").agg(F.count(F.lit(1)).alias("postings"))


def matched_postings(spark, sf):
    m = match_postings(_postings(spark, sf), _allow(spark, sf))
    return m.select("posting_id", "fetch_ord", "company_raw", "emp_key", "raw_name", "filings",
                    "latest_year", "confidence", "method")


def employer_openings(spark, sf):
    m = match_postings(_postings(spark, sf), _allow(spark, sf))
    return m.groupBy("emp_key").agg(F.count(F.lit(1)).alias("openings"))


def sponsor_boost(spark, sf):
    m = with_boost(match_postings(_postings(spark, sf), _allow(spark, sf)))
    return m.select("fetch_ord", "emp_key", F.bround("boost", 6).alias("boost"), "zscore")


def resume_pii_strip(spark, sf):
    r = views.resumes(spark, sf)
    return r.select("resume_id", strip_pii(F.lower("text")).alias("stripped"))


def resume_vocabulary(spark, sf):
    return resume_report(views.resumes(spark, sf))


def posting_term_hits(spark, sf):
    m = D.materialize(match_postings(_postings(spark, sf), _allow(spark, sf)))
    terms = resume_keywords(views.resumes(spark, sf)).select("kw").distinct()
    return posting_hits(m, terms)


def overlap_scores(spark, sf):
    """Score without boost and reasons of every distinct vocabulary (named by its smallest resume; ``resumes`` have it) and
    every distinct profile of postings (named by its first posting; ``postings`` have it) that share a term."""
    from lcarank.functions.scoring import fit_score, why_text
    resumes = views.resumes(spark, sf)
    resume_vocab, _, terms = vocabularies(resumes, D.materialize(resume_keywords(resumes)))
    sizes = resume_vocab.groupBy("vocab_id").agg(F.count(F.lit(1)).alias("resumes"))
    postings = D.materialize(match_postings(_postings(spark, sf), _allow(spark, sf)))
    profiles = D.materialize(profiles_of(with_terms(postings, terms)))
    scored = profile_scores(terms, profiles).join(profiles.select("profile", "first_ord", "postings"), "profile").join(sizes, "vocab_id")
    return scored.select("vocab_id", "first_ord", "resumes", "postings", fit_score(F.size("title_terms"), F.size("desc_terms"), F.lit(0.0)).alias("score"),
                         why_text(F.col("title_terms"), F.col("desc_terms")).alias("why"))


def _digest_cols(rows: DataFrame) -> DataFrame:
    return rows.select("resume_id", "rank", "posting_id", "fetch_ord", "emp_key", "method", "confidence",
                       "score", "why", "extra", "note")


def digest(spark, sf):
    return _digest_cols(D.digest_rows(spark, sf))


def digest_dry_run(spark, sf):
    return _digest_cols(D.digest_rows(spark, sf, D.RunParams(dry_run=True)))


def digest_filtered(spark, sf):
    """The digest over postings that the resumes' search queries find, three pages of each, dated
    within two weeks before the run, in one location."""
    return _digest_cols(D.digest_rows(spark, sf, D.RunParams(as_of=FILTERED_AS_OF, location=FILTERED_LOCATION, pages=FILTERED_PAGES, by_queries=True)))


def digest_markdown(spark, sf):
    rows = D.digest_rows(spark, sf)
    return D.digest_markdown(rows, views.resumes(spark, sf), GENERATED_ON)


def digest_files(spark, sf):
    """The markdown digests written as text files, a bucket of resumes each, and read back (O12)."""
    base = _staging(spark)
    resumes = views.resumes(spark, sf)
    lines = D.digest_markdown(D.digest_rows(spark, sf), resumes, GENERATED_ON)
    D.write_digests(lines, base, max(1, -(-resumes.count() // D.RESUMES_PER_FILE)))
    return D.read_digests(spark, base)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "filings_scan": filings_scan,
    "allowlist": allowlist,
    "filings_files": filings_files,
    "filings_files_stats": filings_files_stats,
    "header_map": header_map,
    "filings_csv": filings_csv,
    "allowlist_stats": allowlist_stats,
    "allowlist_sample": allowlist_sample,
    "allowlist_spot_check": allowlist_spot_check,
    "postings_ingest": postings_ingest,
    "postings_dedupe": postings_dedupe,
    "postings_recent": postings_recent,
    "postings_location": postings_location,
    "postings_page_limit": postings_page_limit,
    "company_keys": company_keys,
    "exact_match": exact_match,
    "similarity_join": similarity_join,
    "containment_join": containment_join,
    "match_decisions": match_decisions,
    "match_audit": match_audit,
    "matched_postings": matched_postings,
    "employer_openings": employer_openings,
    "sponsor_boost": sponsor_boost,
    "resume_pii_strip": resume_pii_strip,
    "resume_vocabulary": resume_vocabulary,
    "posting_term_hits": posting_term_hits,
    "overlap_scores": overlap_scores,
    "digest": digest,
    "digest_dry_run": digest_dry_run,
    "digest_filtered": digest_filtered,
    "digest_markdown": digest_markdown,
    "digest_files": digest_files,
    "postings_pages": postings_pages,
    "filings_csv_accounts": filings_csv_accounts,
}
