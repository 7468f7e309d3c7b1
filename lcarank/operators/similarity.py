"""Similarity join: every (name, key) pair whose token-sorted Indel similarity reaches a threshold.

score(s, r) = 100 * (1 - D / (|s| + |r|)) with D = |s| + |r| - 2 * LCS(s, r) (insert/delete edit
distance) on the token-sorted forms. A pair qualifies when 200 * LCS >= t * (|s| + |r|).

Plan (no cross join; lossless):

1. Length filter. A pair can only qualify when 200 * min(|s|, |r|) >= t * (|s| + |r|).
2. Segment blocking (pigeonhole, after PassJoin). A key r of length l is cut into tau(l) + 1
   segments, tau(l) being the largest distance any admissible partner may have. If D(s, r) <= tau
   then at most tau segments are touched by an edit and one survives whole in s, displaced by delta
   with |delta| + |(|s| - l) - delta| <= D. Keys explode to (l, segment no, segment); names explode
   to the substrings at the admissible displacements; an equi-join on (l, segment no, text) yields
   every qualifying pair (plus some that are not).
3. Hot segments. A segment that more than HEAVY keys of one length share ("international") would meet every
   name that holds it with all of them. Keys with such a segment are cut finer, into FINER times as many
   pieces in turn: of K pieces at least K - tau survive, so if at least tau + 1 of them are light, a light
   one survives, and only the light ones are listed. Keys that are never left with tau + 1 light pieces
   differ from each other in a few characters only; their lists are dealt out over salts of about
   HEAVY keys each. Where no segment is hot, all this is one count.
4. Verify: exact LCS by the bit-parallel pandas UDF, integer test above.

For thresholds at or below 66 the segment count would exceed the key length; such keys are
paired by shared characters instead (still an equi-join, still lossless, just less selective).
Thresholds above 100 qualify nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcarank.functions.lcs import lcs_udf
from lcarank.functions.names import token_sort
from lcarank.session import materialize


#: Thresholds are taken in thousandths of a point, so that all bounds are whole-number arithmetic.
SCALE = 1000
#: Keys of one length that may share a segment in one place before it counts as hot; how much finer they are cut then.
HEAVY, FINER = 1000, (2, 3, 4)


def _scaled(threshold: float) -> int:
    t = int(round(threshold * SCALE))
    if abs(t - threshold * SCALE) > 1e-6 or t <= 0:
        raise ValueError(f"threshold must be above 0 with at most three decimals (at 0 all pairs qualify), got {threshold}")
    return t


def _longest(t: int, length):
    """Largest length of a partner of a string of this length."""
    return F.floor(length * F.lit(200 * SCALE - t).cast("bigint") / F.lit(t))


def _tau(t: int, total):
    """Largest admissible distance of two strings with this sum of lengths."""
    return F.floor(F.lit(100 * SCALE - t).cast("bigint") * total / F.lit(100 * SCALE)).cast("int")


def _tau_max(t: int, length):
    """Largest admissible distance for a key of this length over all admissible partners."""
    return _tau(t, length + _longest(t, length))


def _segments(t: int, length, k):
    """Per segment i of an even cut of ``length`` characters into k parts: (i, start, len)."""
    base = F.floor(length / k).cast("int")
    rem = (length - base * k).cast("int")
    return F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.struct(
            i.alias("i"),
            (i * base + F.greatest(F.lit(0), i - (k - rem))).alias("start"),
            (base + F.when(i >= k - rem, 1).otherwise(0)).alias("len")))


def _shifts(start, length):
    """First and last displacement of a segment in a name, from tau, delta_n and the name's length m."""
    first = F.greatest(F.ceil((F.col("delta_n") - F.col("tau")) / F.lit(2.0)).cast("int"), -start)
    last = F.least(F.floor((F.col("delta_n") + F.col("tau")) / F.lit(2.0)).cast("int"), F.col("m") - length - start)
    return first, last


def _names_by_length(t: int, ns: DataFrame) -> DataFrame:
    """names(v, s, m) -> a row for every admissible key length l, with its bounds tau and delta_n and the number
    k of segments."""
    lo = F.ceil(F.col("m") * F.lit(t).cast("bigint") / F.lit(200 * SCALE - t).cast("bigint")).cast("int")
    hi = _longest(t, F.col("m")).cast("int")
    return (ns.filter(F.col("m") > 0)
            .select("v", "s", "m", F.explode(F.sequence(F.greatest(lo, F.lit(1)), hi)).alias("l"))
            .withColumn("k", _tau_max(t, F.col("l")) + 1)
            .filter(F.col("k") <= F.col("l"))
            .withColumn("tau", _tau(t, F.col("m") + F.col("l")))
            .withColumn("delta_n", (F.col("m") - F.col("l")).cast("int")))


def _probes(t: int, per_len: DataFrame, finer: int) -> DataFrame:
    """(v, s, l, i, seg): the substrings of names that may be piece i of a key of length l."""
    per_seg = per_len.where(F.col("k") * finer <= F.col("l")).select(
        "v", "s", "m", "l", "tau", "delta_n", F.explode(_segments(t, F.col("l"), F.col("k") * finer)).alias("g"))
    first, last = _shifts(F.col("g.start"), F.col("g.len"))
    return (per_seg.filter(first <= last)
            .select("v", "s", "l", F.col("g.i").alias("i"), F.col("g.start").alias("start"),
                    F.col("g.len").alias("len"), F.explode(F.sequence(first, last)).alias("d"))
            .select("v", "s", "l", "i", F.expr("substring(s, start + d + 1, len)").alias("seg")))


_LIST = ["l", "i", "seg"]


def _pieces(t: int, ks: DataFrame, finer: int) -> DataFrame:
    """(norm_name, r, l, k, i, seg) of the keys that are long enough for finer * k pieces."""
    return (ks.where(F.col("k") * finer <= F.col("l"))
            .select("norm_name", "r", "l", "k", F.explode(_segments(t, F.col("l"), F.col("k") * finer)).alias("g"))
            .select("norm_name", "r", "l", "k", F.col("g.i").alias("i"), F.expr("substring(r, g.start + 1, g.len)").alias("seg")))


def _list_sizes(pieces: DataFrame, heavy: int) -> DataFrame:
    return pieces.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy)


def _with_light_pieces(pieces: DataFrame, hot: DataFrame) -> DataFrame:
    """The keys of ``pieces`` with their light pieces (i, seg) in ``light``."""
    known = pieces.join(hot.select(*_LIST, F.lit(True).alias("hot")), _LIST, "left")
    return known.groupBy("norm_name", "r", "l", "k").agg(F.collect_list(F.when(F.col("hot").isNull(), F.struct("i", "seg"))).alias("light"))


def _met(probes: DataFrame, lists: DataFrame, on: list[str]) -> DataFrame:
    return probes.join(lists, on).select("v", "s", "norm_name", "r")


def _blocked(t: int, ns: DataFrame, ks: DataFrame, heavy: int) -> DataFrame:
    """(v, s, norm_name, r), with repeats, of the pairs that share a surviving segment."""
    per_len = _names_by_length(t, ns)
    pieces = _pieces(t, ks, 1)
    hot = _list_sizes(pieces, heavy)
    if hot.isEmpty():
        return _met(_probes(t, per_len, 1), pieces, _LIST)
    met, rest = [], None
    for finer in (1, *FINER):
        pieces = _pieces(t, ks if rest is None else rest, finer)
        cut = materialize(_with_light_pieces(pieces, _list_sizes(pieces, heavy)))
        enough = F.size("light") >= F.col("k")
        lists = cut.where(enough).select("norm_name", "r", "l", F.explode_outer("light").alias("x")).select("norm_name", "r", "l", "x.i", "x.seg")
        asked = per_len.join(cut.where(enough).select("l").distinct(), "l", "left_semi")
        met.append(_met(_probes(t, asked, finer), lists, _LIST))
        left = cut.where(~enough).drop("light")
        # keys too short for finer pieces stay as they are
        rest = left if rest is None else left.unionByName(rest.where(F.col("k") * finer > F.col("l")))
    rest = materialize(rest)
    pieces = _pieces(t, rest, 1)
    salts = _list_sizes(pieces, heavy).select(*_LIST, F.ceil(F.col("n") / F.lit(heavy)).cast("int").alias("salts"))
    count = F.coalesce("salts", F.lit(1))
    dealt = pieces.join(salts, _LIST, "left").withColumn("salt", F.pmod(F.xxhash64("norm_name"), count).cast("int")).drop("salts")
    asked = _probes(t, per_len.join(rest.select("l").distinct(), "l", "left_semi"), 1)
    every = asked.join(salts, _LIST, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("salts")
    met.append(_met(every, dealt, [*_LIST, "salt"]))
    return reduce(DataFrame.unionByName, met)


def candidate_pairs(names: DataFrame, keys: DataFrame, threshold: float, heavy: int = HEAVY) -> DataFrame:
    """names(v), keys(norm_name) -> distinct (v, s, norm_name, r) pairs that may qualify."""
    t = _scaled(threshold)
    ns = names.select("v", token_sort("v").alias("s")).withColumn("m", F.length("s"))
    ks = keys.select("norm_name", token_sort("norm_name").alias("r")).withColumn("l", F.length("r"))
    ks = ks.withColumn("k", _tau_max(t, F.col("l")) + 1)
    pairs = _blocked(t, ns, ks, heavy)
    if t <= 66 * SCALE + 999:
        # keys too short to cut into tau + 1 segments: pair by a shared character
        short = ks.filter(F.col("k") > F.col("l"))
        kc = short.select("norm_name", "r", F.explode(F.array_distinct(F.split("r", ""))).alias("ch"))
        nc = ns.select("v", "s", F.explode(F.array_distinct(F.split("s", ""))).alias("ch"))
        pairs = pairs.unionByName(nc.join(kc, "ch").select("v", "s", "norm_name", "r"))
    return pairs.distinct()


def similarity_pairs(names: DataFrame, keys: DataFrame, threshold: float, heavy: int = HEAVY) -> DataFrame:
    """(v, norm_name, score) for every pair with token-sorted similarity >= threshold."""
    t = _scaled(threshold)
    if t > 100 * SCALE:
        return names.sparkSession.createDataFrame([], "v string, norm_name string, score double")
    cand = candidate_pairs(names, keys, threshold, heavy)
    m, l = F.length("s"), F.length("r")
    # Equal strings need no look; the others must be within the bound in edits already, since an edit costs
    # at most two insertions or deletions and never more than they do.
    same = F.col("s") == F.col("r")
    tau = _tau(t, m + l)
    close = cand.filter(same | ((m + l > 0) & (F.levenshtein("s", "r") <= tau)))
    scored = close.withColumn("lcs", F.coalesce(lcs_udf(F.when(~same, F.col("s")), F.when(~same, F.col("r"))), F.lit(0))) \
        .withColumn("lcs", F.when(same, m).otherwise(F.col("lcs")))
    ok = scored.filter(F.lit(200 * SCALE) * F.col("lcs").cast("bigint") >= F.lit(t).cast("bigint") * (m + l))
    dist = (m + l - F.lit(2) * F.col("lcs")).cast("double")
    return ok.select("v", "norm_name", ((F.lit(1.0) - dist / (m + l).cast("double")) * F.lit(100.0)).alias("score"))
