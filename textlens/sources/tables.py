"""Scans: parquet driver tables and labelled / user CSV files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schema of a labelled text table (the reference's complaint table).
LABELLED_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("category", T.StringType()),
])
# Evaluation CSV: two named columns; a trailing comma adds a nameless empty third one.
EVAL_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("_extra", T.StringType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """Parquet scan of one driver table; Catalyst prunes columns and pushes filters.

    ``partitions``: a caller's layout hint for small one-file tables; none by default.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.repartition(partitions) if partitions else df


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType = LABELLED_SCHEMA,
                      encoding: str = "UTF-8") -> DataFrame:
    """Header CSV with quoted multi-line fields, fixed schema (no inference pass)."""
    df = (spark.read.schema(schema).option("header", True).option("escape", '"')
          .option("multiLine", True).option("encoding", encoding).option("mode", "PERMISSIVE")
          .csv(path))
    keep = [f.name for f in schema.fields if not f.name.startswith("_")]
    return df.select(*keep)


def read_user_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Any CSV with a header, all columns as text; a row with too many or too few cells is
    kept whole in ``_corrupt_record`` (null for good rows).

    ``multi_line`` allows line breaks inside quoted cells and reads each file in one task;
    switch it off for large files without such cells.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE"}
    names = spark.read.options(**options).csv(path).columns
    fields = [T.StructField(c, T.StringType()) for c in [*names, "_corrupt_record"]]
    return spark.read.schema(T.StructType(fields)).options(**options, columnNameOfCorruptRecord="_corrupt_record").csv(path)


def text_column(df: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """S3: pick the text column by name and cast it to string; keep an id if given."""
    if text_col not in df.columns:
        raise ValueError(f"column {text_col!r} not in {df.columns}")
    cols = [F.col(text_col).cast("string").alias("text")]
    if id_col:
        cols.insert(0, F.col(id_col))
    return df.select(*cols)
