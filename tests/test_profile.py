"""Profiling over rows with nulls, duplicates and conflicting labels."""

from pyspark.sql import functions as F

from textlens.operators import profile as P
from textlens.operators.splits import stratified_split


def test_counts_with_nulls_duplicates_and_conflicts(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "a", "x"), (4, "b", "x"), (5, "b", "x"), (6, None, "x"), (7, None, "y"), (8, "c", None), (9, "  ", "z")]
    d = spark.createDataFrame(rows, "id long, text string, category string")
    r = P.label_conflicts(d, "text", "category").first()
    assert (r["conflicting_texts"], r["rows_in_conflict"]) == (2, 5)  # null is a text of its own
    assert P.empty_after_cleaning(d, "text").first()["empty_after_clean"] == 1
    assert {x["category"]: x["n"] for x in P.distribution(d, "category").collect() if x["category"]} == {"x": 5, "y": 2, "z": 1}


def test_stratified_sizes(spark):
    d = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 < 7 THEN 'hot' ELSE 'rest' END AS category")
    out = stratified_split(d, "id", "category")
    n = {(r["category"], r["split"]): r["count"] for r in out.groupBy("category", "split").count().collect()}
    assert n == {("hot", "test"): 140, ("hot", "train"): 560, ("rest", "test"): 60, ("rest", "train"): 240}
    assert sorted(out.columns) == ["category", "id", "split"]


def summary_of(xs, quantiles=(0.25, 0.5, 0.75)):
    import numpy as np
    return [float(np.quantile(xs, q)) for q in quantiles] if xs else [None] * len(quantiles)


def test_numeric_summary_equals_a_sort(spark, monkeypatch):
    """Several shapes of columns at once, with few ranges a round so that it takes many."""
    import math
    import random

    from textlens.operators import profile as P

    rng = random.Random(1)
    n = 400
    columns = {
        "even": [rng.random() for _ in range(n)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(n)],
        "extreme": [rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324]) for _ in range(n)],
        "hot": [7.5 if rng.random() < 0.4 else rng.uniform(7, 8) for _ in range(n)],
        "holes": [rng.choice([None, float("nan"), rng.random()]) for _ in range(n)],
        "none": [None] * n,
        "one": [3.0] + [None] * (n - 1),
        "whole": [float(rng.randrange(5)) for _ in range(n)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).withColumn(
        "whole", F.col("whole").cast("int")).withColumn("c", F.lit("x"))
    for buckets in (60, 1024):
        monkeypatch.setattr(P, "SELECT_BUCKETS", buckets)
        got = {r["column_name"]: r for r in P.numeric_summary(df, list(columns)).collect()}
        for c, xs in columns.items():
            xs = sorted(x for x in xs if x is not None and not math.isnan(x))
            assert got[c]["count"] == len(xs)
            if c != "extreme":  # numpy's interpolation overflows there
                assert all(a == b or math.isclose(a, b, rel_tol=1e-12) for a, b in zip([got[c][q] for q in ("q25", "q50", "q75")], summary_of(xs))), c
            assert (got[c]["min"], got[c]["max"]) == ((xs[0], xs[-1]) if xs else (None, None))
    values = df.select(F.lit(0).alias("c"), F.col("extreme").alias("x"))
    own = sorted(columns["extreme"])
    ranks = {(0, r): (own[0], own[-1]) for r in (0, 99, 250, n - 1)}
    assert P.select_ranks(values, ranks) == {k: own[k[1]] for k in ranks}


def test_sketches_unite(spark):
    from textlens.operators import profile as P

    df = spark.createDataFrame([(d, (d * 700 + i) % 2500 if i % 50 else None) for d in range(5) for i in range(1000)], "day int, v int")
    stored = P.distinct_sketches(df, "v", ["day"])
    for r in P.distinct_of_sketches(stored, ["day"]).collect():
        exact = df.filter(F.col("day") == r["day"]).select("v").dropna().distinct().count()
        assert r["n"] == 1000 and abs(r["approx_distinct"] - exact) <= 0.08 * exact
    exact = df.select("v").dropna().distinct().count()
    assert abs(P.distinct_of_sketches(stored).first()["approx_distinct"] - exact) <= 0.08 * exact
    assert P.distinct_of_sketches(P.distinct_sketches(df.limit(0), "v", ["day"]), ["day"]).count() == 0
