"""Joins with hot keys: whole results, and rows spread over tasks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lcarank.operators.rank import rank_resumes, vocabularies
from lcarank.operators.skew import fan_out


@pytest.fixture()
def shuffled(spark):
    """Nothing is broadcast unless a plan says so, and partitions stay as they are dealt."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _tasks(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_fan_out_equals_a_join(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("unused", 5), (None, 6)], "k string, v int")
    got = Counter(map(tuple, fan_out(rows, table, "k", "id", per_salt=100).select("id", "k", "v").collect()))
    assert got == Counter(map(tuple, rows.join(table, "k").select("id", "k", "v").collect())) and len(got) > 3000
    assert fan_out(rows.limit(0), table, "k", "id").count() == 0 and fan_out(rows, table.limit(0), "k", "id").count() == 0


def test_hot_key_is_spread_over_tasks(shuffled):
    rows = shuffled.range(100_000).select("id", F.when(F.col("id") < 90_000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    table = rows.select("k").distinct().withColumn("v", F.lit(1))
    assert _tasks(rows.join(table, "k"))[-1] > 80_000
    tasks = _tasks(fan_out(rows, table, "k", "id", per_salt=1000))
    assert sum(tasks) == 100_000 and tasks[-1] <= 4 * tasks[len(tasks) // 2]


def test_resumes_of_one_vocabulary(shuffled):
    """100,000 resumes share one vocabulary, a few have others: ids, ranks and the spread of the last join."""
    n = 100_000
    resumes = shuffled.range(n, numPartitions=8).select(F.col("id").alias("resume_id"))
    keywords = resumes.select("resume_id", F.explode(F.when(F.col("resume_id") % 10_000 == 7, F.array(F.lit("sql"), F.concat(F.lit("t"), "resume_id")))
                                                     .otherwise(F.array(F.lit("java"), F.lit("kafka")))).alias("kw"))
    resume_vocab, ids, terms = vocabularies(resumes, keywords)
    assert ids.count() == 11 and terms.count() == 22
    assert resume_vocab.groupBy("vocab_id").count().where("count > 1").first() == (0, n - 10)
    posts = shuffled.createDataFrame([(str(i), i, t, "", f"e{i}", 10, 2024) for i, t in enumerate(["Java lead", "SQL", "Kafka and Java"])],
                                     "posting_id string, fetch_ord long, title string, description string, emp_key string, filings long, latest_year int")
    out = rank_resumes(posts, resumes, keywords, top_n=2, cap=1)
    assert out.groupBy("resume_id").count().where("count = 2").count() == n
    first = out.where("rank = 1").groupBy("fetch_ord").count().collect()
    assert {r.fetch_ord: r["count"] for r in first} == {2: n - 10, 1: 10}
    tasks = _tasks(out)
    assert tasks[-1] <= 4 * tasks[len(tasks) // 2]


def test_last_join_is_dealt_by_its_result(spark):
    """Resumes are a few bytes, their digests are not: left to Spark, 40,000 resumes meet their rows in one task."""
    resumes = spark.range(40_000, numPartitions=4).select(F.col("id").alias("resume_id"))
    keywords = resumes.select("resume_id", F.lit("java").alias("kw"))
    posts = spark.createDataFrame([("1", 1, "Java lead", "", "e", 10, 2024)],
                                  "posting_id string, fetch_ord long, title string, description string, emp_key string, filings long, latest_year int")
    tasks = _tasks(rank_resumes(posts, resumes, keywords, top_n=2, cap=1))
    assert sum(tasks) == 40_000 and len(tasks) >= 4 and tasks[-1] <= 20_000
