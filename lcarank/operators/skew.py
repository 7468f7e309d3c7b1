"""A join whose hot keys are dealt out by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that go together, and the most keys that are treated as hot (these are broadcast, key and number).
PER_SALT, MOST_HOT = 10_000, 10_000


def fan_out(rows: DataFrame, table: DataFrame, key: str, spread_by: str, per_salt: int = PER_SALT, tasks: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``key`` (inner), where a key may have any number of rows and a few in ``table``.
    Keys of more than ``per_salt`` rows (or than a MOST_HOT-th of all, if that is more: so there are MOST_HOT of
    them at most) get a salt for each such number: their rows are dealt over the salts by ``spread_by``, and
    what ``table`` has of them is copied to every salt. ``tasks``: in so many tasks at least, for results much larger than
    ``rows``, by whose bytes Spark would else put them together."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.lit(float(per_salt)), F.coalesce(sizes.agg(F.sum("_n") / F.lit(float(MOST_HOT))).scalar(), F.lit(0.0)))
    hot = sizes.where(F.col("_n") > share).select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int")).drop("_salts")
    copied = table.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    if tasks is not None:
        dealt, copied = (x.repartition(tasks, key, "_salt") for x in (dealt, copied))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
