"""Similarity and containment joins equal brute force over every (name, key) pair."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lcarank.functions.lcs import lcs_length
from lcarank.operators.containment import containment_pairs, probes
from lcarank.operators.similarity import candidate_pairs, similarity_pairs
from lcarank.constants import GENERIC_TOKENS


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc d", max_size=30), st.text("abcd ", max_size=30))
def test_lcs_bit_parallel_equals_dp(a, b):
    assert lcs_length(a, b) == lcs_dp(a, b)


def test_lcs_long_strings():
    rng = random.Random(3)
    for _ in range(50):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(60, 150)))
        b = "".join(rng.choice("abcde ") for _ in range(rng.randint(60, 150)))
        assert lcs_length(a, b) == lcs_dp(a, b)


def _sorted(s):
    return " ".join(sorted(s.split(" ")))


def _brute_similarity(names, keys, t):
    out = set()
    for v in names:
        for k in keys:
            s, r = _sorted(v), _sorted(k)
            if s and r and 200 * lcs_dp(s, r) >= t * (len(s) + len(r)):
                out.add((v, k))
    return out


def _names(rng, n):
    words = ["acme", "acmes", "acne", "blue", "bleu", "widget", "widgets", "nord", "north", "wind",
             "winds", "tool", "tools", "co", "x"]
    out = set()
    while len(out) < n:
        out.add(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))))
    return sorted(out)


@pytest.mark.parametrize("t", [66, 67, 80, 93, 93.5, 100])
def test_similarity_join_equals_brute_force(spark, t):
    rng = random.Random(str(t))
    names, keys = _names(rng, 60), _names(rng, 80)
    nd = spark.createDataFrame([(v,) for v in names], "v string")
    kd = spark.createDataFrame([(k,) for k in keys], "norm_name string")
    got = {(r.v, r.norm_name) for r in similarity_pairs(nd, kd, t).collect()}
    assert got == _brute_similarity(names, keys, t)


@pytest.mark.parametrize("t,heavy", [(80, 1), (93, 1), (93, 4), (85, 10), (70, 3)])
def test_similarity_join_with_hot_segments(spark, t, heavy):
    """Keys with lists of more than ``heavy`` keys are found by finer pieces, those left over by salted lists."""
    rng = random.Random(f"{t} {heavy}")
    names, keys = _names(rng, 50), _names(rng, 70)
    names += [f"acme {x} international" for x in ("a", "ab", "abc", "b", "bc", "blue", "nord wind")]
    keys += [f"acme {x} international" for x in ("c", "abd", "ac", "b", "blu", "bleu", "nord winds", "north wind")]
    nd = spark.createDataFrame([(v,) for v in names], "v string")
    kd = spark.createDataFrame([(k,) for k in keys], "norm_name string")
    got = {(r.v, r.norm_name) for r in similarity_pairs(nd, kd, t, heavy).collect()}
    assert got == _brute_similarity(names, keys, t)


def test_hot_segment_gives_no_large_list(spark):
    """Half of 6,000 keys end alike. Their names meet lists of at most 100 keys, where one list would pair each
    with half of them; and rows are even over the tasks that verify them."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hot = sorted({f"{word(12)} zz international" for _ in range(3000)})
    keys = hot + sorted({f"{word(12)} {word(13)}" for _ in range(3000)})
    names = [k[:3] + k[4:] for k in hot[::10]]
    nd = spark.createDataFrame([(v,) for v in names], "v string")
    kd = spark.createDataFrame([(k,) for k in keys], "norm_name string")
    light = candidate_pairs(nd, kd, 93, heavy=100).select("v", "norm_name").cache()
    assert light.count() * 5 < candidate_pairs(nd, kd, 93, heavy=10**6).count()  # no list of over 100 keys is met
    got = {(r.v, r.norm_name) for r in similarity_pairs(nd, kd, 93, heavy=100).collect()}
    assert {(k[:3] + k[4:], k) for k in hot[::10]} <= got
    tasks = sorted(r["count"] for r in light.repartition(8, "v").groupBy(F.spark_partition_id()).count().collect())
    assert tasks[-1] <= 4 * tasks[len(tasks) // 2]


def test_similarity_join_low_threshold_short_keys(spark):
    names, keys = ["ab", "abc", "xyz", "abd"], ["ab", "ba", "abcd", "q"]
    nd = spark.createDataFrame([(v,) for v in names], "v string")
    kd = spark.createDataFrame([(k,) for k in keys], "norm_name string")
    got = {(r.v, r.norm_name) for r in similarity_pairs(nd, kd, 50).collect()}
    assert got == _brute_similarity(names, keys, 50)


def test_similarity_score_values(spark):
    nd = spark.createDataFrame([("meta",)], "v string")
    kd = spark.createDataFrame([("meta platforms",), ("meta",)], "norm_name string")
    got = {r.norm_name: r.score for r in similarity_pairs(nd, kd, 40).collect()}
    assert got["meta"] == 100.0
    assert abs(got["meta platforms"] - 200 * 4 / 18) < 1e-9     # ~44, as the docs say


@pytest.mark.parametrize("t", [0, -1, 93.00005])
def test_similarity_threshold_out_of_range(spark, t):
    nd = spark.createDataFrame([("acme",)], "v string")
    with pytest.raises(ValueError, match="threshold"):
        similarity_pairs(nd, nd.withColumnRenamed("v", "norm_name"), t)


def test_similarity_threshold_above_100_is_empty(spark):
    nd = spark.createDataFrame([("acme",)], "v string")
    kd = spark.createDataFrame([("acme",)], "norm_name string")
    assert similarity_pairs(nd, kd, 101).count() == 0


def _brute_containment(names, keys):
    gen = set(GENERIC_TOKENS)
    out = set()
    for v in names:
        vt = set(v.split(" "))
        for k in keys:
            kt = set(k.split(" "))
            if vt <= kt and any(x not in gen and len(x) >= 4 for x in vt & kt):
                out.add((v, k))
    return out


def test_containment_join_equals_brute_force(spark):
    rng = random.Random(11)
    names, keys = _names(rng, 50), _names(rng, 120)
    names += ["global tech", "data acme"]
    keys += ["global tech acme", "data acme tools"]
    nd = spark.createDataFrame([(v,) for v in names], "v string")
    kd = spark.createDataFrame([(k,) for k in keys], "norm_name string")
    got = {(r.v, r.norm_name) for r in containment_pairs(nd, kd, 93).collect()}
    assert got == _brute_containment(names, keys)
    assert containment_pairs(nd, kd, 101).count() == 0


@pytest.mark.parametrize("heavy", [1, 3, 10])
def test_containment_join_with_hot_tokens(spark, heavy):
    rng = random.Random(heavy)
    names, keys = _names(rng, 50), _names(rng, 120)
    keys = sorted({f"acme {k}" for k in keys} | set(keys))  # one token in more than half of the keys
    names += ["acme", "acme tools", "widget", "acme nowhere", "x", "acme acme tools"]
    nd = spark.createDataFrame([(v,) for v in names], "v string")
    kd = spark.createDataFrame([(k,) for k in keys], "norm_name string")
    got = [(r.v, r.norm_name) for r in containment_pairs(nd, kd, 93, heavy).collect()]
    assert set(got) == _brute_containment(names, keys) and len(got) == len(set(got))


def test_a_token_of_every_key_is_no_probe_alone(spark):
    frequency = spark.createDataFrame([("acme", 5000), ("tools", 9000), ("blue", 20), ("co", 7000)], "tok string, df long")
    nd = spark.createDataFrame([("acme tools",), ("acme co tools",), ("acme blue",), ("acme",), ("acme gone",)], "v string")
    got = {r.v: (r.tok, r.tok2, r.salts) for r in probes(nd, frequency, 1000).collect()}
    assert got == {"acme tools": ("acme", "tools", 1), "acme co tools": ("acme", "co", 1), "acme blue": ("blue", None, 1), "acme": ("acme", None, 5)}
