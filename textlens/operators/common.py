"""Skew-safe building blocks shared by several operators.

A plain ``row_number() over (partition by category ...)`` sends every row of a
category to one task; with one category holding a third of 100 TB that task
never finishes.  The helpers below give the same exact answers while keeping
every task bounded:

* ``rank_within_group``: exact 1-based rank by a hash order inside each group.
  Rows are spread over (group, hash-bucket) windows; each bucket's starting
  offset comes from a histogram (groups x buckets rows, not rows) aggregated
  map-side and joined back on the same keys the window partitions by.
* ``top_k_per_group``: exact top-k via a salted first round (top-k per
  (group, salt)) and a second round over at most k x salts rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the md5 order key used as bucket (16 bits -> 65,536 buckets per group).
BUCKET_HEX_DIGITS = 4


def seeded_hash(id_col, seed: int) -> Column:
    """Repeatable pseudo-random order key: md5 of '<id>:<seed>' as hex (same in DuckDB)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def rank_within_group(df: DataFrame, group_cols: list[str], key_col: str, tie_col: str,
                      out_col: str = "rn", hex_digits: int = BUCKET_HEX_DIGITS,
                      size_col: str | None = None) -> DataFrame:
    """Add ``out_col`` = row_number() over (partition by group_cols order by key_col, tie_col).

    ``key_col`` must be a lower-case hex string (an md5), so its first digits are
    a bucket that is monotone in the order.  ``size_col`` adds the rows of the group,
    taken from the same histogram.
    """
    bucket = F.conv(F.substring(F.col(key_col), 1, hex_digits), 16, 10).cast("int")
    with_b = df.withColumn("_bucket", bucket)
    hist = with_b.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    if size_col:
        offsets = offsets.withColumn(size_col, F.sum("_n").over(Window.partitionBy(*group_cols)))
    offsets = offsets.drop("_n")
    # No broadcast hint: the window below needs rows clustered by (group, bucket)
    # anyway, so a shuffle join on those keys costs no extra exchange, and AQE
    # still turns it into a broadcast when the measured histogram is small.
    inner = Window.partitionBy(*group_cols, "_bucket").orderBy(F.col(key_col), F.col(tie_col))
    return (with_b.join(offsets, on=[*group_cols, "_bucket"], how="inner")
            .withColumn(out_col, (F.col("_offset") + F.row_number().over(inner)).cast("long"))
            .drop("_bucket", "_offset"))


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    salt: Column, salts: int = 64, out_col: str = "rank") -> DataFrame:
    """Exact top-k rows per group by ``order`` (which must be a total order).

    Round 1 ranks within (group, salt % salts) and keeps k per salt; round 2 ranks
    the surviving <= k*salts rows per group.
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    first = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return first.withColumn(out_col, F.row_number().over(w2)).filter(F.col(out_col) <= k)


def dense_index(df: DataFrame, order: list[Column], out_col: str = "index") -> DataFrame:
    """Add ``out_col`` = 0, 1, 2 ... over all rows by ``order`` (a total order), without a single-task window.

    Range-partitioned, sorted inside the partitions and written once; a row's number is its place in
    its partition plus the rows of the partitions before, which are counted: one number a partition.
    """
    from textlens.session import materialize

    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                        .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "dense_index")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = (dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
             .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(parts, "_part").select(*df.columns, number.cast("long").alias(out_col))
