"""Resume-fit scoring and the per-employer capped top-n, for many resumes at once.

score(resume, posting) = round_half_even(5 * |title hits| + 1 * |description-only hits| + boost, 2)
where hits are the resume's vocabulary terms found (whole-token) in the posting, and boost depends
on the posting's employer only. Ranking: score descending, then fetch order. The digest walks the
ranking keeping at most ``cap`` postings per employer until ``top_n`` are kept, which equals
"employer rank <= cap, then the first top_n".

Resumes with one vocabulary rank identically, and so do, for any vocabulary, postings with one
*profile* (terms in the title, terms in the description only) but for their boost. So vocabularies
are scored against profiles, and only a few postings of a profile can be kept:

* of one profile and employer all scores are equal, so the first ``cap`` in fetch order suffice;
* if LEAST = 2 * top_n postings that are within the cap come before a posting, it is not kept:
  of them at most top_n fail because their employer is full (top_n / cap employers can be full, each
  with cap of them), so top_n others are kept before it. This bounds a profile's postings, a
  vocabulary's overlapping postings and its postings without overlap alike.

Within a profile the order is that of the rounded boost, then fetch order: adding whole points
leaves rounding as it is, except next to a half cent, where floating point may round to either
side. Boosts that close to a half cent are ranked among their equals only.

Pairs of vocabularies and postings are cut down where they arise: every task keeps the best ``cap`` of an
employer and LEAST of a vocabulary of what it has seen (``best_pairs``), and only these are shuffled and ranked.

Postings that share no term with a vocabulary score their boost alone. They matter only if fewer than
LEAST overlapping postings score higher than any boost. A boost depends on the employer only, so they come
from a list of employers by boost, the first few postings of each; both grow for the vocabularies that may
still miss one (``without_overlap``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcarank.constants import PER_EMPLOYER_CAP, TOP_N
from lcarank.functions.scoring import fit_score, sponsor_boost, why_text
from lcarank.operators.skew import fan_out
from lcarank.operators.term_index import find_terms
from lcarank.session import materialize

#: Postings of the list of employers are broadcast up to this many rows; more of them are joined by shuffle.
HEAD_BROADCAST = 20_000
#: Pairs that a task holds before it cuts them down.
HELD_PAIRS = 200_000
#: Resumes that a task of the last join deals their rows to, about, and the most such tasks (with more resumes each beyond).
RESUMES_PER_TASK, MOST_TASKS = 5_000, 10_000


def _empty():
    return F.array().cast("array<string>")


def with_boost(matched: DataFrame) -> DataFrame:
    """Adds newest_year (max latest_year over all matched sponsors), boost and zscore (score with
    no term overlap)."""
    newest = matched.agg(F.coalesce(F.max("latest_year"), F.lit(0))).scalar()  # scalar subquery
    out = matched.withColumn("newest_year", newest)
    out = out.withColumn("boost", sponsor_boost(F.col("filings"), F.col("latest_year"), F.col("newest_year")))
    return out.withColumn("zscore", fit_score(F.lit(0), F.lit(0), F.col("boost")))


def vocabularies(resumes: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> (resume_vocab(resume_id, vocab_id), vocab_ids(vocab_id), vocab_terms(vocab_id, kw)). Resumes with the same
    term set share a vocab_id (the smallest resume_id of the set); resumes without terms get one
    too."""
    sets = keywords.groupBy("resume_id").agg(F.array_sort(F.collect_set("kw")).alias("vocab"))
    all_sets = (resumes.select("resume_id").join(sets, "resume_id", "left")
                .select("resume_id", F.coalesce(F.col("vocab"), _empty()).alias("vocab")))
    ids = all_sets.groupBy("vocab").agg(F.min("resume_id").alias("vocab_id"))
    resume_vocab = fan_out(all_sets, ids, "vocab", "resume_id").select("resume_id", "vocab_id")
    terms = ids.select("vocab_id", F.explode("vocab").alias("kw"))
    return resume_vocab, ids.select("vocab_id"), terms


def with_terms(matched: DataFrame, terms: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Adds title_terms and desc_terms (those not in the title), sorted, of the terms that some vocabulary
    holds, and their profile. ``texts`` has the texts
    if ``matched`` has not. Only ids and terms move."""
    hits = posting_hits(matched if texts is None else texts, terms).groupBy("fetch_ord").agg(
        F.array_sort(F.collect_list(F.when(F.col("in_title"), F.col("kw")))).alias("title_terms"),
        F.array_sort(F.collect_list(F.when(~F.col("in_title"), F.col("kw")))).alias("desc_terms"))
    none = [F.coalesce(F.col(c), _empty()).alias(c) for c in ("title_terms", "desc_terms")]
    found = matched.join(hits, "fetch_ord", "left").select(*matched.columns, *none)
    return found.withColumn("profile", F.concat(F.array_join("title_terms", "\x1f"), F.lit("\x1e"), F.array_join("desc_terms", "\x1f")))


def posting_hits(matched: DataFrame, terms: DataFrame) -> DataFrame:
    """(fetch_ord, kw, in_title, in_desc) for every vocabulary term found in a posting; only ids and
    terms move."""
    low = matched.select("fetch_ord", F.lower("title").alias("title"), F.lower("description").alias("description"))
    found = find_terms(low, terms.select("kw").distinct(), "kw", ["title", "description"])
    return found.groupBy("fetch_ord", "kw").agg(F.bool_or(F.col("place") == 0).alias("in_title"), F.bool_or(F.col("place") == 1).alias("in_desc"))


def profile_scores(terms: DataFrame, profiles: DataFrame) -> DataFrame:
    """(vocab_id, profile, title_terms, desc_terms): the shared terms of every vocabulary and profile that
    share one. ``profiles``: profile, title_terms, desc_terms, one row each."""
    kws = profiles.select("profile", F.explode("title_terms").alias("kw"), F.lit(True).alias("in_title")) \
        .unionByName(profiles.select("profile", F.explode("desc_terms").alias("kw"), F.lit(False).alias("in_title")))
    return terms.join(kws, "kw").groupBy("vocab_id", "profile").agg(
        F.collect_list(F.when(F.col("in_title"), F.col("kw"))).alias("title_terms"),
        F.collect_list(F.when(~F.col("in_title"), F.col("kw"))).alias("desc_terms"))


def profiles_of(scored: DataFrame) -> DataFrame:
    return scored.groupBy("profile").agg(F.first("title_terms").alias("title_terms"), F.first("desc_terms").alias("desc_terms"),
                                         F.count(F.lit(1)).alias("postings"), F.min("fetch_ord").alias("first_ord"))


def eligible(scored: DataFrame, top_n: int, cap: int) -> DataFrame:
    """(fetch_ord, emp_key, boost, zscore, profile) of the postings that a capped top_n may keep."""
    rows = scored.select("fetch_ord", "emp_key", "boost", "zscore", "profile")
    own = Window.partitionBy("profile", "emp_key").orderBy("fetch_ord")
    rows = rows.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= cap)
    cents = F.col("boost") * 100
    edge = F.when(F.abs(cents - F.floor(cents) - 0.5) < 1e-6, F.col("boost"))
    alike = Window.partitionBy("profile", "_edge").orderBy(F.col("zscore").desc(), "fetch_ord")
    return rows.withColumn("_edge", edge).withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= 2 * top_n).drop("_n", "_edge")


def _within_cap(cands: DataFrame, most: int, cap: int) -> DataFrame:
    """Per vocabulary, the first ``most`` by (score desc, fetch_ord) of its first ``cap`` per employer."""
    order = [F.col("score").desc(), F.col("fetch_ord").asc()]
    first = cands.withColumn("_n", F.row_number().over(Window.partitionBy("vocab_id", "emp_key").orderBy(*order))).where(F.col("_n") <= cap)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("vocab_id").orderBy(*order))).where(F.col("rank") <= most).drop("_n")


def _best(pairs: pa.Table, most: int, cap: int) -> pa.Table:
    """Of (vocab_id, emp_key, fetch_ord, score, ...): per vocabulary the first ``most`` by (score desc, fetch_ord) of its
    first ``cap`` per employer."""
    v, o, s = (pairs.column(c).to_numpy() for c in ("vocab_id", "fetch_ord", "score"))
    e = pairs.column("emp_key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)

    def first(rows: np.ndarray, n: int, *keys: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((o[rows], -s[rows], *(k[rows] for k in keys)))]
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[rows[1:]] != k[rows[:-1]]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        return rows[np.arange(len(rows)) - begin < n]

    return pairs.take(pa.array(first(first(np.arange(len(v)), cap, e, v), most, v)))


def best_pairs(pairs: DataFrame, most: int, cap: int, held_most: int = HELD_PAIRS) -> DataFrame:
    """``pairs`` (vocab_id, emp_key, fetch_ord, score, others) without those that cannot be among the first ``most``
    of their vocabulary within ``cap`` per employer, as far as a task sees. What is left of all tasks merges
    to the same result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= held_most:
                table = _best(pa.Table.from_batches(held), most, cap)
                if table.num_rows > held_most // 2:  # many vocabularies: these go on as they are
                    yield from table.to_batches()
                    held, n = [], 0
                else:
                    held, n = table.combine_chunks().to_batches(), table.num_rows
        if n:
            yield from _best(pa.Table.from_batches(held), most, cap).to_batches()

    return pairs.mapInArrow(run, pairs.schema)


def without_overlap(todo: DataFrame, shared: DataFrame, rows: DataFrame, top_n: int, cap: int) -> DataFrame:
    """(vocab_id, fetch_ord, emp_key, score): enough postings that share no term with the vocabularies
    ``todo``. ``shared``: (vocab_id, profile) that do share one.

    Employers stand by (boost score, first posting); of the first ``n_emp`` the first ``depth`` postings are looked
    at. What is not looked at begins at a bound: the next employer's first posting, or the next posting of an
    employer of whom fewer than ``cap`` free ones were found. A vocabulary is done when 2 * top_n of its
    postings stand before its bound, or nothing is left to look at."""
    columns, most, parts = ("vocab_id", "fetch_ord", "emp_key", "score"), 2 * top_n, []
    listed = materialize(rows.withColumn("er", F.row_number().over(Window.partitionBy("emp_key").orderBy("fetch_ord"))))
    employers = materialize(listed.groupBy("emp_key").agg(F.max("zscore").alias("z"), F.min("fetch_ord").alias("first_ord")))
    n_emp, depth = most, 2 * cap
    while True:
        by_boost = [F.col("z").desc(), F.col("first_ord")]
        head = employers.orderBy(*by_boost).limit(n_emp + 1).withColumn("place", F.row_number().over(Window.orderBy(*by_boost)))  # over the head only
        next_one = F.col("place") == n_emp + 1
        near = listed.join(head.select("emp_key", "z", "place"), "emp_key").where(F.when(next_one, F.col("er") == 1).otherwise(F.col("er") <= depth + 1))
        near = materialize(near.select("emp_key", "z", "fetch_ord", "profile", next_one.alias("outside"), (F.col("er") > depth).alias("beyond"),
                                       F.row_number().over(Window.orderBy("place", "er")).cast("bigint").alias("pos")))
        total = near.count()
        grid = todo.select("vocab_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(max(1, total)).cast("bigint"))).alias("pos")) \
            .join(F.broadcast(near) if total <= HEAD_BROADCAST else near, "pos") \
            .join(shared.select("vocab_id", "profile", F.lit(True).alias("hit")), ["vocab_id", "profile"], "left")
        free = F.col("hit").isNull() & ~F.col("outside") & ~F.col("beyond")
        per = grid.groupBy("vocab_id", "emp_key", "z").agg(
            F.slice(F.sort_array(F.collect_list(F.when(free, F.col("fetch_ord")))), 1, cap).alias("ords"),
            F.min(F.when(F.col("beyond"), F.col("fetch_ord"))).alias("beyond"), F.min(F.when(F.col("outside"), F.col("fetch_ord"))).alias("outside"))
        unseen = F.coalesce("outside", F.when(F.size("ords") < cap, F.col("beyond")))
        per = materialize(per.select("vocab_id", "emp_key", "z", "ords", F.when(unseen.isNotNull(), F.struct((-F.col("z")).alias("z"), unseen.alias("o"))).alias("unseen")))
        bound = per.groupBy("vocab_id").agg(F.min("unseen").alias("bound"))
        found = per.select("vocab_id", "emp_key", "z", F.explode_outer("ords").alias("fetch_ord")).where("fetch_ord is not null")
        before = F.struct((-F.col("z")).alias("z"), F.col("fetch_ord").alias("o")) < F.col("bound")
        enough = bound.join(found, "vocab_id", "left").groupBy("vocab_id").agg(F.count_if(before).alias("n"), F.first("bound").alias("bound")) \
            .where(F.col("bound").isNull() | (F.col("n") >= most)).select("vocab_id")
        enough = materialize(enough)
        taken = found.join(enough, "vocab_id", "left_semi").select("vocab_id", "fetch_ord", "emp_key", F.col("z").alias("score"))
        parts.append(_within_cap(taken, most, cap).select(*columns))
        if not total:
            break
        todo = materialize(todo.join(enough, "vocab_id", "left_anti"))
        if todo.isEmpty():
            break
        n_emp, depth = 8 * n_emp, 8 * depth
    return reduce(DataFrame.unionByName, parts)


def rank_vocabularies(matched: DataFrame, vocab_ids: DataFrame, terms: DataFrame,
                      top_n: int = TOP_N, cap: int = PER_EMPLOYER_CAP) -> DataFrame:
    """Kept rows per vocabulary: vocab_id, rank, fetch_ord, score, why, extra, note + posting cols."""
    most = 2 * top_n
    boosted = with_boost(matched)
    scored = materialize(with_terms(boosted.drop("description"), terms, boosted.select("fetch_ord", "title", "description")))
    rows = materialize(eligible(scored, top_n, cap))
    shared = materialize(profile_scores(terms, profiles_of(scored)))
    pairs = shared.join(rows, "profile").select("vocab_id", "emp_key", "fetch_ord", "profile",
                                                fit_score(F.size("title_terms"), F.size("desc_terms"), F.col("boost")).alias("score"))
    overlapping = materialize(_within_cap(best_pairs(pairs, most, cap), most, cap).drop("rank"))
    # Vocabularies with enough overlapping postings above any boost need no other postings.
    highest = rows.agg(F.coalesce(F.max("zscore"), F.lit(0.0))).scalar()
    enough = overlapping.where(F.col("score") > highest).groupBy("vocab_id").count().where(F.col("count") >= most)
    todo = materialize(vocab_ids.join(enough, "vocab_id", "left_anti"))
    others = without_overlap(todo, shared, rows, top_n, cap).withColumn("profile", F.lit(None).cast("string"))
    kept = _within_cap(overlapping.unionByName(others), top_n, cap)
    reasons = shared.select("vocab_id", "profile", "title_terms", "desc_terms")
    kept = kept.join(reasons, ["vocab_id", "profile"], "left").withColumns({c: F.coalesce(c, _empty()) for c in ("title_terms", "desc_terms")}).drop("profile")
    total = matched.groupBy("emp_key").agg(F.count(F.lit(1)).alias("_total"))
    w = Window.partitionBy("vocab_id", "emp_key")
    kept = (kept.join(total, "emp_key")
            .withColumn("extra", F.col("_total") - F.count(F.lit(1)).over(w))
            .withColumn("note", F.when((F.col("rank") == F.max("rank").over(w)) & (F.col("extra") > 0),
                                       F.concat(F.lit("+"), F.col("extra").cast("string"),
                                                F.lit(" more opening(s) at this employer"))))
            .withColumn("why", why_text(F.col("title_terms"), F.col("desc_terms")))
            .drop("_total", "title_terms", "desc_terms", "emp_key"))
    return kept.join(scored.drop("boost", "zscore", "newest_year", "title_terms", "desc_terms", "profile"), "fetch_ord")


def rank_resumes(matched: DataFrame, resumes: DataFrame, keywords: DataFrame,
                 top_n: int = TOP_N, cap: int = PER_EMPLOYER_CAP) -> DataFrame:
    """Digest rows per resume: resume_id, rank, posting and sponsor columns, score, why, extra,
    note."""
    resume_vocab, vocab_ids, terms = vocabularies(resumes, keywords)
    # a resume's row becomes up to top_n wide ones
    tasks = max(resumes.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, -(-resumes.count() // RESUMES_PER_TASK)))
    kept = rank_vocabularies(matched, materialize(vocab_ids), materialize(terms), top_n, cap)
    return fan_out(resume_vocab, kept, "vocab_id", "resume_id", per_salt=RESUMES_PER_TASK // 5, tasks=tasks).drop("vocab_id")
