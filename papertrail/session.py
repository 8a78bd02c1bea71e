"""Session construction and the shared scratch/checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  ANSI stays on (Spark 4 default); operators use
# try_cast / try_divide where the reference tolerates bad input.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, shuffle_partitions: int | None = None,
                  app: str = "papertrail") -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    b = b.config("spark.driver.memory", os.environ.get("PAPERTRAIL_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The value of ``spark.checkpoint.dir`` wins.  A local session without it (tests) gets
    a fresh private folder; on a cluster its absence is an error, since no other node
    would see a folder made here.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        d = tempfile.mkdtemp(prefix="papertrail-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/papertrail/{name}-{uuid.uuid4().hex[:12]}"


def shared_uri(spark: SparkSession, path: str) -> str:
    """``path`` for pyarrow's file systems; without a scheme it is in Spark's default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toString()


def materialize(df, name: str):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor recomputes from the written files, not from
    the sources), keeps size statistics for the planner, and stops iterative
    plans from growing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)
