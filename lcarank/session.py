"""SparkSession construction and the few session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here assumes: AQE re-plans joins at run time (broadcast only when the
# measured side is small, split skewed partitions), zone-free dates, Arrow for the two pandas UDFs.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "lcarank") -> SparkSession:
    """Return the active session, or build a local one with the engine settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LCARANK_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable engine settings to an existing session (e.g. the driver's)."""
    for k, v in ENGINE_CONF.items():
        if k == "spark.ui.enabled":
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # noqa: BLE001 - static conf on a shared session; keep the caller's value
            pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: what the context was given, else ``spark.checkpoint.dir``. A local
    master without either gets a temporary folder (tests); on a cluster executors would each write to
    their own disk, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not configured and not _is_local(sc.master):
            raise RuntimeError(f"master {sc.master}: set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lcarank-ckpt-"))
    return sc.getCheckpointDir()


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table under the session's shared checkpoint directory and read it
    back. Cuts lineage like ``checkpoint()`` (a lost executor does not send the plan back to the
    sources), but the result stays columnar: later reads prune columns and push filters into the
    scan, where a checkpointed RDD would deserialise every column (e.g. whole posting texts) on
    every use."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
