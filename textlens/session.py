"""Session helpers: local sessions for tests/bench, checkpoint-dir resolution."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "textlens", driver_memory: str = "8g") -> SparkSession:
    """Build (or return) a session tuned for local runs.

    On a cluster the caller's own session is used instead; these settings only
    matter for tests and the bench.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Only a local-mode
    session (tests, bench) may fall back to a fresh folder under /tmp; on a
    cluster a machine-local folder would not survive executor loss, so we
    refuse instead.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="textlens-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS)")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark):
    """What is written in here leaves no shuffle files behind.  Spark drops them otherwise when the driver happens to
    collect its garbage, and until then the shuffles of every step lie on the executors' disks."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df, name: str = "table"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used where one intermediate feeds several branches of a plan: it is computed
    exactly once, the lineage is cut, and a lost executor re-reads the files
    instead of recomputing upstream work.
    """
    import uuid

    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    with shuffles_dropped(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_bucketed(df, name: str, buckets: int, column: str, dealt: bool = False):
    """``materialize``, dealt into ``buckets`` by ``column``: joins and groupings by it read the table without
    a shuffle.  ``dealt``: the rows already lie together by ``column``, so they are not shuffled for it.
    The files lie where those of the other tables do."""
    import uuid

    spark, unique = df.sparkSession, f"{name}_{uuid.uuid4().hex[:12]}"
    path = os.path.join(checkpoint_dir(spark), "tables", unique)
    df = df if dealt else df.repartition(buckets, column)
    with shuffles_dropped(spark):
        (df.write.mode("overwrite").format("parquet").bucketBy(buckets, column)
         .option("path", path).saveAsTable(unique))
    return spark.table(unique)
