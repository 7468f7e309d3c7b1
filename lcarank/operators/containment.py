"""Containment join: keys whose token set holds every token of a name.

A name qualifies against a key when its tokens are a subset of the key's tokens and the shared
tokens include a distinctive one (not generic, 4+ characters). With a subset and a non-empty
overlap the order-free set score is always 100, so no scorer runs; the threshold only matters when
it exceeds 100 (then nothing qualifies).

Plan: inverted index (key, token); each name probes the index only with its *rarest* distinctive
token (document frequency over the keys). Every qualifying key holds all of the name's tokens, so
probing one of them is lossless, and the rarest keeps the candidate list shortest.

Hot tokens. Where even the rarest is in more than HEAVY keys, a name of several tokens probes with it and
its next rarest token as one key, and the index lists heavy tokens a second time with every other token of
their keys. Only a name of one token, which every key that holds the token contains, probes with it alone;
these lists, all of them results, are dealt out over salts of about HEAVY keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcarank.functions.names import subset_anchors

#: Keys that may hold a token before it is probed together with another one.
HEAVY = 1000


def probes(names: DataFrame, frequency: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """names(v), frequency(tok, df) -> v, toks, tok (the rarest distinctive token), tok2 (the next rarest of all,
    where tok is heavy; else null), salts. A name with a token that no key holds qualifies nowhere and is left out."""
    nt = (names.select("v", F.array_distinct(F.split("v", " ")).alias("toks"), subset_anchors(F.col("v")).alias("anchors"))
          .filter(F.size("anchors") > 0))
    known = (nt.select("v", "toks", "anchors", F.explode("toks").alias("tok")).join(frequency, "tok")
             .groupBy("v", "toks", "anchors").agg(F.array_sort(F.collect_set(F.struct("df", "tok"))).alias("found"))
             .where(F.size("found") == F.size("toks")))
    rarest = F.filter("found", lambda x: F.array_contains("anchors", x["tok"]))[0]
    picked = known.select("v", "toks", rarest.alias("a"), "found")
    other = F.get(F.filter("found", lambda x: x["tok"] != F.col("a.tok")), F.lit(0))
    hot = F.col("a.df") > heavy
    return picked.select("v", "toks", F.col("a.tok").alias("tok"), F.when(hot, other["tok"]).alias("tok2"),
                         F.when(hot & (F.size("toks") == 1), F.ceil(F.col("a.df") / F.lit(heavy)).cast("int")).otherwise(1).alias("salts"))


def containment_pairs(names: DataFrame, keys: DataFrame, threshold: float, heavy: int = HEAVY) -> DataFrame:
    """names(v), keys(norm_name) -> (v, norm_name, score=100.0) for every containing key."""
    if threshold > 100:
        return names.sparkSession.createDataFrame([], "v string, norm_name string, score double")
    index = keys.select("norm_name", F.array_distinct(F.split("norm_name", " ")).alias("ktoks"))
    postings = index.select("norm_name", "ktoks", F.explode("ktoks").alias("tok"))
    frequency = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    asked = probes(names, frequency, heavy)

    alone = asked.where("tok2 is null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = frequency.where(F.col("df") > heavy).select("tok", F.ceil(F.col("df") / F.lit(heavy)).cast("int").alias("salts"))
    # heavy tokens meet names of that one token only, so their lists are salted; names ask every salt
    listed = postings.join(salted, "tok", "left").withColumn("salt", F.pmod(F.xxhash64("norm_name"), F.coalesce("salts", F.lit(1))).cast("int"))
    by_one = alone.drop("salts", "tok2").join(listed.drop("salts"), ["tok", "salt"]).select("v", "toks", "norm_name", "ktoks")

    pairs = (postings.join(salted, "tok", "left_semi")
             .select("norm_name", "ktoks", "tok", F.explode("ktoks").alias("tok2")).where("tok != tok2"))
    by_two = asked.where("tok2 is not null").join(pairs, ["tok", "tok2"]).select("v", "toks", "norm_name", "ktoks")
    ok = by_one.unionByName(by_two).filter(F.size(F.array_except("toks", "ktoks")) == 0)
    return ok.select("v", "norm_name", F.lit(100.0).alias("score"))
