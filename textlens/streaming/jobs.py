"""Structured Streaming jobs.

T1 scores a stream of texts and appends the scored rows to a parquet table;
T2 keeps running per-category totals over the scored stream.  Both use a file
source with a fixed schema, checkpoints in the shared ``spark.checkpoint.dir``
(exactly-once file sink; restart after executor or driver loss resumes from
the last committed batch) and ``availableNow`` triggers so that a drained
stream equals the batch answer.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.session import checkpoint_dir


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


def text_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file source over a table (one file or a folder of files) with a fixed schema
    (no inference on a stream); all new files of a trigger form one batch unless limited."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], spark: SparkSession,
                 name: str = "scores") -> DataFrame:
    """Stateless scoring of each micro-batch, appended to a parquet table.

    Returns the table as a batch DataFrame once the stream is drained.
    """
    out, ckpt = _paths(spark, name)
    scored = scorer(stream)
    q = (scored.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out))
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(scored.schema).parquet(out)  # known schema: an empty stream writes no file


def score_batches(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], spark: SparkSession, schema,
                  name: str = "scores") -> DataFrame:
    """T1 for scorers that shuffle: each micro-batch is scored as a batch and written to a folder of its
    own, overwritten when the batch is run again, so every row is in the table once.  The folder's name
    is the batch's number, which the checkpoint repeats after a restart."""
    out, ckpt = _paths(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))

    q = stream.writeStream.option("checkpointLocation", ckpt).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    # known schema: an empty stream writes no folder
    names = [f.name for f in schema.fields]
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out).select(*names) if _has_epochs(spark, out) else spark.createDataFrame([], schema)


def _has_epochs(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def running_totals(scored_stream: DataFrame, spark: SparkSession, name: str = "totals",
                   hybrid_marker: str = "hybrid") -> DataFrame:
    """Per-category count, mean percent confidence and hybrid share, kept as
    streaming state (one row per category) and written in complete mode."""
    hundredths = F.round(F.col("confidence") * 10000.0).cast("long")  # percent to 2 places, exact
    agg = (scored_stream.groupBy("category")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(hundredths).alias("_conf_sum"),
                F.count_if(F.contains(F.col("method"), F.lit(hybrid_marker))).alias("_hybrid")))
    out, ckpt = _paths(spark, name)
    table = f"textlens_{name}_{uuid.uuid4().hex[:8]}"

    last = {}

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # complete-mode snapshot in a folder of its own per epoch; the last finished one is read
        batch.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))
        last["path"] = os.path.join(out, f"epoch={epoch}")

    q = (agg.writeStream.outputMode("complete").option("checkpointLocation", ckpt)
         .foreachBatch(write_batch).trigger(availableNow=True).queryName(table).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    res = spark.read.schema(agg.schema).parquet(last["path"]) if last else spark.createDataFrame([], agg.schema)
    return res.select("category", "n", (F.col("_conf_sum") / (F.col("n") * 100.0)).alias("avg_confidence_pct"),
                      (F.col("_hybrid") * 100.0 / F.col("n")).alias("hybrid_share_pct"))


# ---------------------------------------------------------------- T2 that can be stopped and taken up again

def resumable_totals(scored_stream: DataFrame, spark: SparkSession, folder: str, id_col: str | None = None, ts_col: str | None = None,
                     watermark: str = "1 hour", hybrid_marker: str = "hybrid", after_batch: Callable[[int], None] | None = None) -> DataFrame:
    """T2 in update mode, in a ``folder`` that the caller names and passes again after a stop.

    State is one row a category.  Each batch writes the categories that it changed to ``epoch=<number>``, replacing
    what an earlier attempt at the same batch left, before Spark's checkpoint records the batch; a run that dies in
    between repeats the batch and its folder, so nothing counts twice.  With ``id_col`` and ``ts_col``, rows that
    arrive again within ``watermark`` are dropped first.  ``after_batch`` is called after each folder is written.
    Returns ``latest_totals(folder)`` once the stream is drained.
    """
    s = scored_stream
    if id_col and ts_col:
        s = s.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([id_col])
    changed = s.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("confidence") * 10000.0).cast("long")).alias("conf_sum"),
        F.count_if(F.contains(F.col("method"), F.lit(hybrid_marker))).alias("hybrid"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(folder, "totals", f"epoch={epoch}"))
        if after_batch:
            after_batch(epoch)

    q = (changed.writeStream.outputMode("update").option("checkpointLocation", os.path.join(folder, "checkpoint"))
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return latest_totals(spark, folder)


def latest_totals(spark: SparkSession, folder: str) -> DataFrame:
    """(category, n, avg_confidence_pct, hybrid_share_pct, epoch): each category as its last batch left it."""
    path = os.path.join(folder, "totals")
    schema = "category string, n long, conf_sum long, hybrid long, epoch long"
    rows = spark.read.schema(schema).parquet(path) if _has_epochs(spark, path) else spark.createDataFrame([], schema)
    last = rows.groupBy("category").agg(F.max(F.struct("epoch", "n", "conf_sum", "hybrid")).alias("t"))
    return last.select("category", "t.n", (F.col("t.conf_sum") / (F.col("t.n") * 100.0)).alias("avg_confidence_pct"),
                       (F.col("t.hybrid") * 100.0 / F.col("t.n")).alias("hybrid_share_pct"), "t.epoch")
