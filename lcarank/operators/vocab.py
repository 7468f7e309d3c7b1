"""Resume vocabulary: skills of a dictionary found in the PII-stripped text, and title phrases. Texts are
not shuffled unless the dictionary is too large to broadcast, and then as n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcarank.functions.text import build_queries, extract_titles, strip_pii
from lcarank.operators.term_index import find_terms, skill_table


def resume_skills(resumes: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """(resume_id, skills): distinct canonical skills with a variant in the text, of resumes that have any.
    ``skills``: (canonical, variant), by default the curated ones."""
    skills = skill_table(resumes.sparkSession) if skills is None else skills.distinct()
    low = resumes.select("resume_id", strip_pii(F.lower("text")).alias("low"))
    return find_terms(low, skills, "variant", ["low"]).groupBy("resume_id").agg(F.collect_set("canonical").alias("skills"))


def resume_terms(resumes: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """resume_id, titles (ordered distinct title phrases of the unstripped text), kws (sorted skills and
    title phrases)."""
    titles = resumes.select("resume_id", extract_titles(F.col("text")).alias("titles"))
    both = titles.join(resume_skills(resumes, skills), "resume_id", "left")
    kws = F.concat(F.coalesce("skills", F.array().cast("array<string>")), "titles")
    return both.select("resume_id", "titles", F.array_sort(F.array_distinct(kws)).alias("kws"))


def resume_titles(resumes: DataFrame) -> DataFrame:
    return resumes.select("resume_id", extract_titles(F.col("text")).alias("titles"))


def resume_keywords(resumes: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """(resume_id, kw): skills union title phrases."""
    # explode_outer: see term_index.find_terms
    return resume_terms(resumes, skills).select("resume_id", F.explode_outer("kws").alias("kw")).where("kw is not null")


def resume_report(resumes: DataFrame) -> DataFrame:
    """resume_id, titles, queries, keywords (sorted), keyword_count — strings joined with ' | '."""
    return resume_terms(resumes).select(
        "resume_id",
        F.array_join("titles", " | ").alias("titles"),
        F.array_join(build_queries(F.col("titles")), " | ").alias("queries"),
        F.array_join("kws", " | ").alias("keywords"),
        F.size("kws").cast("bigint").alias("keyword_count"),
    )
