"""The skew-safe helpers equal plain window functions."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from textlens.operators.common import rank_within_group, seeded_hash, top_k_per_group


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from(["a", "b"]), min_size=1, max_size=80), st.integers(1, 3))
def test_rank_equals_row_number(spark, groups, digits):
    df = spark.createDataFrame(list(enumerate(groups)), "id long, g string").withColumn("k", seeded_hash("id", 7))
    got = {r["id"]: r["rn"] for r in rank_within_group(df, ["g"], "k", "id", hex_digits=digits).collect()}
    w = Window.partitionBy("g").orderBy("k", "id")
    want = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 5)), min_size=1, max_size=60),
       st.integers(1, 4))
def test_salted_top_k_equals_window(spark, rows, k):
    df = spark.createDataFrame([(g, f"t{i}", v) for i, (g, v) in enumerate(rows)], "g string, term string, v int")
    order = [F.col("v").desc(), F.col("term").asc()]
    got = sorted(tuple(r) for r in top_k_per_group(df, ["g"], order, k, salt=F.xxhash64("term"), salts=4)
                 .select("g", "term", "rank").collect())
    w = Window.partitionBy("g").orderBy(*order)
    want = sorted(tuple(r) for r in df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                  .select("g", "term", "rank").collect())
    assert got == want
