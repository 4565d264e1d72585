"""Sinks: result CSV, append-only scored log, log truncation.

The log is a parquet table in a shared folder; appends are atomic per job
(Spark's commit protocol), so a lost executor never leaves half a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.functions.text import join_list

LOG_SCHEMA = T.StructType([
    T.StructField("complaint", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("method", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, UTF-8; array columns are joined to text first."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(join_list(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    df.select(*cols).write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def append_log(scored: DataFrame, path: str, text_col: str = "complaint") -> None:
    """Append scored rows with a timestamp to the log table."""
    out = scored.select(
        F.col(text_col).alias("complaint"), F.col("category"), F.col("confidence").cast("double"),
        F.col("method"), F.current_timestamp().alias("timestamp"))
    out.write.mode("append").parquet(path)


def truncate_log(spark: SparkSession, path: str) -> None:
    """Replace the log with an empty version of the same schema."""
    spark.createDataFrame([], LOG_SCHEMA).write.mode("overwrite").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


# ---------------------------------------------------------------- the log by day

DAY = "day"


def replace_days(scored: DataFrame, path: str, ts_col: str = "timestamp") -> None:
    """S8 for a log partitioned by day: write the rows' days, each instead of what it held (dynamic partition
    overwrite), so a batch of whole days may be written again without doubling a row.  Other days stay.

    Rows without a timestamp go to a partition of their own.
    """
    (scored.withColumn(DAY, F.to_date(ts_col)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(DAY).parquet(path))


def append_days(scored: DataFrame, path: str, ts_col: str = "timestamp") -> None:
    """Add rows to their days."""
    scored.withColumn(DAY, F.to_date(ts_col)).write.mode("append").partitionBy(DAY).parquet(path)


def truncate_day(spark: SparkSession, path: str, day: str, schema: T.StructType) -> None:
    """S9 of one day (``yyyy-MM-dd``): its partition is overwritten by an empty one; the others are not touched."""
    rows = [f for f in schema.fields if f.name != DAY]
    spark.createDataFrame([], T.StructType(rows)).write.mode("overwrite").parquet(f"{path}/{DAY}={day}")


def read_days(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The log with its ``day`` column, which filters prune by folder."""
    rows = [f for f in schema.fields if f.name != DAY]
    return spark.read.schema(T.StructType([*rows, T.StructField(DAY, T.DateType())])).parquet(path)


def recent_days(log: DataFrame, n: int) -> DataFrame:
    """The days that hold the ``n`` latest rows, whole: older days are pruned.  Rows a day are counted from the
    files' footers; only that table, one row a day, meets the driver."""
    days = sorted(((r[DAY], r["n"]) for r in log.filter(F.col(DAY).isNotNull()).groupBy(DAY).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    first, seen = None, 0
    for day, rows in days:
        first, seen = day, seen + rows
        if seen >= n:
            break
    return log.filter(F.col(DAY) >= F.lit(first)) if first is not None else log.limit(0)
