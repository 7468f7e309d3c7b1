"""End-to-end plans: allowlist, posting intake, employer resolution, ranking and the digest.

Intermediates that the plan reads many times (the allowlist, the cleaned postings, the matched
postings, the resume keywords) are materialised as parquet tables in the session's shared
checkpoint directory, so the sources are not re-scanned for every use and a lost executor does not
send the plan back to them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcarank.constants import (FUZZY_THRESHOLD, MAX_DAYS_OLD, PER_EMPLOYER_CAP,
                               RESULTS_PER_PAGE, TOP_N)
from lcarank.functions.scoring import match_label
from lcarank.functions.text import build_queries, contains_phrase
from lcarank.operators.allowlist import build_allowlist
from lcarank.operators.match import match_postings
from lcarank.operators.rank import rank_resumes
from lcarank.operators.term_index import find_terms
from lcarank.operators.vocab import resume_keywords, resume_titles
from lcarank.session import materialize
from lcarank.sources import views
from lcarank.sources.postings import dedupe, in_location, ingest, page_limit, recent


@dataclass(frozen=True)
class RunParams:
    """User-level parameters of one run."""
    threshold: float = FUZZY_THRESHOLD
    top_n: int = TOP_N
    cap: int = PER_EMPLOYER_CAP
    as_of: dt.date | str | None = None      # None: the feed is already recency-filtered
    max_days: int = MAX_DAYS_OLD
    location: str | None = None
    pages: int | None = None                # None: every fetched page is kept
    dry_run: bool = False                   # one query, one page
    query: str | None = None                # search for this phrase only
    by_queries: bool = False                # search for the resumes' query sets


def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(build_allowlist(views.lca_filings(spark, sf_dir)))


def intake(spark: SparkSession, sf_dir: str, p: RunParams = RunParams()) -> DataFrame:
    """Fetched postings after page limits, cleaning, de-duplication and filters."""
    raw = views.raw_postings(spark, sf_dir)
    if p.dry_run:
        first = raw.orderBy("fetch_ord").select("title").limit(1)  # the first query's label
        raw = page_limit(raw.join(first, "title", "left_semi"), "title", 1, RESULTS_PER_PAGE)
    elif p.pages is not None:
        raw = page_limit(raw, "title", p.pages, RESULTS_PER_PAGE)
    posts = dedupe(ingest(raw))
    if p.as_of is not None:
        posts = recent(posts, p.as_of, p.max_days)
    posts = in_location(posts, p.location)
    if p.query is None and not p.by_queries:
        return posts
    if p.query is not None:
        return posts.where(contains_phrase(F.lower("title"), F.lit(p.query.lower())))
    titles = resume_titles(views.resumes(spark, sf_dir))
    queries = materialize(titles.select(F.explode_outer(build_queries(F.col("titles"))).alias("query")).distinct())
    hits = find_terms(posts.select("fetch_ord", F.lower("title").alias("title")), queries, "query", ["title"])
    return posts.join(hits.select("fetch_ord").distinct(), "fetch_ord", "left_semi")


def matched_postings(spark: SparkSession, sf_dir: str, p: RunParams = RunParams(),
                     keep_unmatched: bool = False) -> DataFrame:
    allow = allowlist(spark, sf_dir)
    posts = materialize(intake(spark, sf_dir, p))
    return match_postings(posts, allow, p.threshold, keep_unmatched)


def digest_rows(spark: SparkSession, sf_dir: str, p: RunParams = RunParams()) -> DataFrame:
    """One row per kept posting per resume: resume_id, rank, posting, sponsor, match, score, why,
    extra, note."""
    matched = materialize(matched_postings(spark, sf_dir, p))
    resumes = views.resumes(spark, sf_dir)
    keywords = materialize(resume_keywords(resumes))
    rows = rank_resumes(matched, resumes, keywords, p.top_n, p.cap)
    return rows.select(
        "resume_id", F.col("rank").cast("bigint").alias("rank"), "posting_id", "fetch_ord", "title",
        "company_raw", "emp_key", "raw_name", "filings", "latest_year", "method", "confidence",
        "location", "posted", "url", "score", "why", "extra", "note")


# FIXED VALUES — digest text.
DIGEST_TITLE = "# H-1B-transfer job matches"
DIGEST_INTRO = ("> Employers below appear in **certified DOL H-1B (LCA) filings**, so they are able to file "
                "an H-1B transfer. Entries flagged **⚠ UNVERIFIED** are fuzzy company-name matches — confirm "
                "the employer identity before relying on them.")
DIGEST_EMPTY = ("**No jobs at transfer-capable employers were found for this run.** "
                "Try a broader `--query`, more `--pages`, or a wider `--location`.")


def digest_markdown(rows: DataFrame, resumes: DataFrame, generated_on: str) -> DataFrame:
    """Markdown digest as rows (resume_id, line_no, line); line_no orders the lines of a resume."""
    s = lambda c: F.col(c).cast("string")
    n_kept = rows.groupBy("resume_id").agg(F.count(F.lit(1)).alias("n"))
    head = resumes.select("resume_id").join(n_kept, "resume_id", "left").select(
        "resume_id", F.coalesce("n", F.lit(0)).alias("n"))
    head_lines = F.array(
        F.lit(DIGEST_TITLE), F.lit(""),
        F.concat(F.lit("_Resume: `resume_"), s("resume_id"), F.lit("` · "), s("n"),
                 F.lit(" openings at transfer-capable employers · generated " + generated_on + "_")),
        F.lit(""), F.lit(DIGEST_INTRO), F.lit(""))
    head_lines = F.when(F.col("n") == 0, F.concat(head_lines, F.array(F.lit(DIGEST_EMPTY)))).otherwise(head_lines)
    header = head.select("resume_id", F.lit(0).cast("bigint").alias("rank"),
                         F.posexplode(head_lines).alias("pos", "line"))
    na = lambda c: F.when(F.col(c).isNull() | (s(c) == ""), F.lit("n/a")).otherwise(s(c))
    block = F.array(
        F.concat(F.lit("## "), s("rank"), F.lit(". "), F.col("title")),
        F.lit(""),
        F.concat(F.lit("- **Company:** "), F.col("company_raw"), F.lit(" → **"), F.col("raw_name"),
                 F.lit("** — "), s("filings"), F.lit(" certified H-1B LCAs (FY"), s("latest_year"), F.lit(")")),
        F.concat(F.lit("- **H-1B match:** "), match_label(F.col("method"), F.col("confidence"), markdown=True)),
        F.concat(F.lit("- **Location:** "), na("location"), F.lit(" · **Posted:** "), na("posted")),
        F.concat(F.lit("- **Apply:** [Apply →]("), F.col("url"), F.lit(")")),
        F.concat(F.lit("- **Why it fits:** "), F.col("why")),
        F.concat(F.lit("- **Score:** "), s("score")),
    )
    block = F.when(F.col("note").isNotNull(),
                   F.concat(block, F.array(F.concat(F.lit("- _"), F.col("note"), F.lit("_")), F.lit("")))
                   ).otherwise(F.concat(block, F.array(F.lit(""))))
    body = rows.select("resume_id", "rank", F.posexplode(block).alias("pos", "line"))
    both = header.unionByName(body)
    return both.select("resume_id", (F.col("rank") * 100 + F.col("pos")).cast("bigint").alias("line_no"), "line")


#: Resumes in a file of digests, on average.
RESUMES_PER_FILE = 1000


def write_digests(lines: DataFrame, path: str, files: int) -> None:
    """Digest lines (resume_id, line_no, line) as text: ``files`` folders ``bucket=N``, dealt by a hash of the resume, each
    one file in which every resume's digest stands as a whole, by resume. Line breaks in a line become spaces."""
    text = F.regexp_replace("line", "[\\r\\n]+", " ")
    dealt = lines.withColumn("bucket", F.pmod(F.xxhash64("resume_id"), F.lit(files)).cast("int")).repartition(files, "bucket")
    dealt.sortWithinPartitions("bucket", "resume_id", "line_no").select("bucket", text.alias("line")).write.partitionBy("bucket").text(path)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(resume_id, line_no from 0, line) of the digests in the files that ``write_digests`` wrote."""
    files = spark.read.text(path, wholetext=True).select("value")
    start = "(?m)(?=^\\Q" + DIGEST_TITLE + "\\E$)"
    blocks = files.select(F.explode(F.split("value", start)).alias("block")).where("block != ''")
    lines = F.split(F.regexp_replace("block", "\\n\\z", ""), "\n")
    # before the lines are dealt out: what stands beside a generator is worked out for every line
    whole = blocks.select(F.regexp_extract("block", "\n_Resume: `resume_(-?\\d+)`", 1).cast("bigint").alias("resume_id"), lines.alias("lines"))
    return whole.select("resume_id", F.posexplode("lines").alias("line_no", "line")).select("resume_id", F.col("line_no").cast("bigint").alias("line_no"), "line")
