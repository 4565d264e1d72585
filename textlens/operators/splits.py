"""Leak-free splits.

Random permutations are replaced by a repeatable order key md5('<id>:<seed>')
(identical hex in Spark and DuckDB), so a split is exact, reproducible by seed
and checkable by SQL.  Ranks inside a class use the skew-safe
``rank_within_group`` (a class holding a third of the rows is ranked by many
tasks, not one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.operators.common import rank_within_group, seeded_hash

SEED = 42
TEST_SIZE = 0.2
N_FOLDS = 5


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_size: float = TEST_SIZE,
                     seed: int = SEED) -> DataFrame:
    """Per class, the first round(test_size * n_class) rows in hash order are 'test'."""
    keyed = df.withColumn("_key", seeded_hash(id_col, seed))
    ranked = rank_within_group(keyed, [label_col], "_key", id_col, out_col="_rn", size_col="_n_class")
    cut = F.round(F.col("_n_class") * F.lit(test_size), 0)
    return (ranked.withColumn("split", F.when(F.col("_rn") <= cut, F.lit("test")).otherwise(F.lit("train")))
            .drop("_key", "_rn", "_n_class"))


def kfold_assign(df: DataFrame, id_col: str, label_col: str, k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """D3: stratified k-fold; fold = (rank in class - 1) mod k over the hash order."""
    keyed = df.withColumn("_key", seeded_hash(id_col, seed))
    ranked = rank_within_group(keyed, [label_col], "_key", id_col, out_col="_rn")
    return ranked.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_key", "_rn")


def group_split(df: DataFrame, group_col: str, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """The first ceil(test_size * G) distinct groups in hash order are 'test';
    a group never crosses sides."""
    groups = df.select(F.col(group_col).alias("_g")).distinct().withColumn("_one", F.lit(0))
    n_groups = groups.count()  # a scalar
    groups = groups.withColumn("_key", seeded_hash("_g", seed))
    ranked = rank_within_group(groups, ["_one"], "_key", "_g", out_col="_rn")
    cut = F.ceil(F.lit(float(n_groups)) * F.lit(float(test_size)))
    side = ranked.withColumn("split", F.when(F.col("_rn") <= cut, "test")
                             .otherwise("train")).select(F.col("_g").alias(group_col), "split")
    return df.join(side, group_col, "left")


def balanced_group_split(df: DataFrame, id_col: str, group_col: str, label_col: str, test_size: float = TEST_SIZE,
                         seed: int = SEED) -> DataFrame:
    """D2 with classes in balance: no group crosses sides, and each class has ``test_size`` of its rows in
    'test', as nearly as its groups allow and never more.

    A group counts for the class of its smallest id (no label is a class of its own).  Per class the groups
    are taken from the largest size down, as many of each size as still fit; equal sizes are interchangeable, so
    this greedy assignment runs on the (class, size) histogram: at most sqrt(2 * rows) sizes a class.  Which
    groups of a size are taken follows from the hash order, ranked by the skew-safe window.
    """
    from textlens.session import materialize

    label = F.coalesce(F.col(label_col).cast("string"), F.lit(""))
    groups = materialize(df.groupBy(F.col(group_col).alias("_g")).agg(F.min_by(label, F.col(id_col)).alias("_class"),
                                                                     F.count(F.lit(1)).alias("_size")), "split_groups")
    hist = groups.groupBy("_class", "_size").agg(F.count(F.lit(1)).alias("_m"))

    def greedy(rows):
        rows = rows.sort_values("_size", ascending=False)
        # half away from zero, as the other splits round
        left, take = int(test_size * int((rows["_size"] * rows["_m"]).sum()) + 0.5), []
        for size, m in zip(rows["_size"], rows["_m"]):
            take.append(min(int(m), left // int(size)))
            left -= take[-1] * int(size)
        return rows.assign(_take=take)[["_class", "_size", "_take"]]

    takes = hist.groupBy("_class").applyInPandas(greedy, "_class string, _size long, _take long")
    ranked = rank_within_group(groups.withColumn("_key", seeded_hash("_g", seed)), ["_class", "_size"], "_key", "_g", out_col="_rn")
    side = ranked.join(takes, ["_class", "_size"]).select(
        F.col("_g").alias(group_col), F.when(F.col("_rn") <= F.col("_take"), "test").otherwise("train").alias("split"))
    return df.join(side, group_col, "left")


def leaks(split_df: DataFrame, id_col: str, pairs: DataFrame, members: DataFrame, split_col: str = "split") -> DataFrame:
    """One row: how far a split keeps likeness on one side.

    ``pairs`` (i, j) are similar texts by their representatives, ``members`` (id, rid) gives every row
    its representative.  ``copies_across``: texts with rows on both sides; ``pairs_across``: similar pairs of
    texts with a row of one on either side of a row of the other.
    """
    sides = (split_df.select(F.col(id_col).alias("id"), split_col).join(members.select("id", "rid"), "id")
             .groupBy("rid").agg(F.bit_or(F.when(F.col(split_col) == "test", 1).otherwise(2)).alias("s")))
    i, j = (sides.select(F.col("rid").alias(c), F.col("s").alias(f"s{c}")) for c in ("i", "j"))
    both = (F.col("si").bitwiseOR(F.col("sj")) == 3)
    across = pairs.select("i", "j").join(i, "i").join(j, "j").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(both).alias("pairs_across"))
    copies = sides.agg(F.count_if(F.col("s") == 3).alias("copies_across"))
    return across.withColumn("_k", F.lit(0)).join(copies.withColumn("_k", F.lit(0)), "_k").select("n_pairs", "pairs_across", "copies_across")


def split_report(split_df: DataFrame, label_col: str, split_col: str = "split") -> DataFrame:
    """Rows per (split, class)."""
    return split_df.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("n"))


def rows_of_split(df: DataFrame, split_df: DataFrame, id_col: str, side: str) -> DataFrame:
    """The rows of ``df`` whose id is on ``side`` of the split (semi join on id)."""
    ids = split_df.filter(F.col("split") == side).select(id_col)
    return df.join(ids, id_col, "left_semi")
