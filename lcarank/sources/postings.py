"""Posting feed: nested JSON pages -> flat postings, cleaning, de-duplication and fetch limits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lcarank.constants import MAX_DAYS_OLD, MAX_PAGES, RESULTS_PER_PAGE
from lcarank.functions.names import py_strip
from lcarank.functions.text import html_unescape, iso_date

POSTING_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StructType([T.StructField("display_name", T.StringType())])),
    T.StructField("location", T.StructType([T.StructField("display_name", T.StringType())])),
    T.StructField("created", T.StringType()),
    T.StructField("redirect_url", T.StringType()),
    T.StructField("description", T.StringType()),
])
PAGE_SCHEMA = T.StructType([T.StructField("fetch_page", T.LongType()), T.StructField("results", T.ArrayType(POSTING_SCHEMA))])

RAW_COLUMNS = ["posting_id", "fetch_ord", "title", "company_raw", "location", "created", "url",
               "description"]


#: Postings of a page at most, for the order of fetching.
PAGE_SPAN = 1 << 20

#: Ends a page in a file of many (RFC 7464). JSON has no bare record separators, so a file without them is one page whatever its
#: lines; two, so that text in UTF-16 has none either.
PAGE_END = "\n\x1e\x1e\n"

#: Pages of a file at most: a compressed file is read by one task.
PAGES_PER_FILE = 1000


def page_number(path: Column) -> Column:
    """Number of a page from its path: a folder ``page=N``, else the last number in the file's name, else 0."""
    folder = F.regexp_extract(path, r"/page=(\d+)/", 1)
    name = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"(\d+)\D*$", 1)
    return F.coalesce(folder.try_cast("bigint"), name.try_cast("bigint"), F.lit(0).cast("bigint"))


def read_posting_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of ``{"results": [...]}`` JSON -> raw postings. A file holds one page, numbered by file name or by folder (see
    ``page_number``) in the order of fetching, or pages that end in ``PAGE_END`` and give their own number as ``fetch_page``.
    fetch_ord orders by (page, position in it); it comes from the page and its file's path, so no file needs to know of the
    others. Files that are no JSON hold no postings."""
    pages = spark.read.schema(PAGE_SCHEMA).option("lineSep", PAGE_END).option("recursiveFileLookup", True).json(path)
    page = F.coalesce("fetch_page", page_number(F.col("_metadata.file_path")))
    flat = pages.select(page.alias("_page"), F.posexplode("results").alias("_pos", "r"))
    return flat.select(
        F.col("r.id").alias("posting_id"),
        (F.col("_page") * PAGE_SPAN + F.col("_pos")).alias("fetch_ord"),
        F.col("r.title").alias("title"),
        F.col("r.company.display_name").alias("company_raw"),
        F.col("r.location.display_name").alias("location"),
        F.col("r.created").alias("created"),
        F.col("r.redirect_url").alias("url"),
        F.col("r.description").alias("description"),
    )


def write_posting_pages(raw: DataFrame, path: str, page_size: int = RESULTS_PER_PAGE) -> None:
    """Raw postings as fetched: a JSON page ``{"fetch_page": N, "results": [...]}`` for each ``page_size`` values of fetch_ord,
    its postings in that order; page 0 also for a null or negative fetch_ord. Null fields and empty ids are left out, as a
    provider does. Every task writes its pages to a file, or one for every ``PAGES_PER_FILE``, each ending in ``PAGE_END``: a
    file or folder per page would be made, moved and listed one by one."""
    named = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("display_name")))
    posting = F.struct(
        "fetch_ord", F.struct(
            F.nullif(F.col("posting_id"), F.lit("")).alias("id"), "title", named("company_raw").alias("company"), named("location").alias("location"),
            "created", F.col("url").alias("redirect_url"), "description").alias("r"))
    pages = raw.select(F.floor(F.col("fetch_ord") / page_size).cast("bigint").alias("page"), posting.alias("p")) \
        .groupBy("page").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["r"]).alias("results"))
    number = F.when(F.col("page") >= 0, F.col("page")).otherwise(0)
    pages.select(number.alias("fetch_page"), "results") \
        .write.option("lineSep", PAGE_END).option("compression", "lz4").option("maxRecordsPerFile", PAGES_PER_FILE).json(path)


def ingest(raw: DataFrame) -> DataFrame:
    """Missing fields -> ''; title stripped then entity-decoded; company and location stripped;
    url and description untouched; created -> posted (date as written, null if unparsable)."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        e("posting_id").alias("posting_id"),
        F.col("fetch_ord"),
        html_unescape(py_strip(e("title"))).alias("title"),
        py_strip(e("company_raw")).alias("company_raw"),
        py_strip(e("location")).alias("location"),
        iso_date(F.col("created")).alias("posted"),
        e("url").alias("url"),
        e("description").alias("description"),
    )


def dedupe(postings: DataFrame) -> DataFrame:
    """First posting per id in fetch order wins; blank ids are never de-duplicated.

    The first fetch_ord per id is a hash aggregate of two short columns, combined map-side, and the
    postings meet it in a semi-join, which splits a hot id; blank ids bypass the shuffle."""
    keyed = postings.filter(F.col("posting_id") != "")
    first = keyed.groupBy("posting_id").agg(F.min("fetch_ord").alias("fetch_ord"))
    blanks = postings.filter(F.col("posting_id") == "")
    return keyed.join(first, ["posting_id", "fetch_ord"], "left_semi").select(*postings.columns).unionByName(blanks)


def recent(postings: DataFrame, as_of: dt.date | str, max_days: int = MAX_DAYS_OLD) -> DataFrame:
    """Keep postings dated within ``max_days`` before ``as_of``; undated postings are kept."""
    lo = F.date_sub(F.lit(as_of).cast("date"), max_days)
    return postings.filter(F.col("posted").isNull() | (F.col("posted") >= lo))


def in_location(postings: DataFrame, location: str | None) -> DataFrame:
    """Optional case-insensitive substring filter on the location."""
    if not location:
        return postings
    return postings.filter(F.lower(F.col("location")).contains(location.lower()))


def page_limit(postings: DataFrame, query_col: str = "title", pages: int = MAX_PAGES,
               page_size: int = RESULTS_PER_PAGE) -> DataFrame:
    """At most pages * page_size postings per search query, in fetch order (a per-group top-k:
    Spark applies it partially before the shuffle)."""
    w = Window.partitionBy(query_col).orderBy("fetch_ord")
    return (postings.withColumn("_n", F.row_number().over(w))
            .filter(F.col("_n") <= pages * page_size).drop("_n"))
