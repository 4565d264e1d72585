"""Streams over folder tables: several files, several batches, and an empty table."""

from pyspark.sql import functions as F

from textlens.streaming import jobs as T
from textlens.streaming.jobs import running_totals, score_stream, text_stream


def _scored(s):
    return s.select("id", F.lit("a").alias("category"), F.lit(0.5).alias("confidence"), F.lit("hybrid").alias("method"))


def test_folder_table_in_several_batches(spark, tmp_path):
    table = str(tmp_path / "t.parquet")
    spark.range(100).repartition(5).write.parquet(table)
    schema = spark.read.parquet(table).schema
    out = score_stream(text_stream(spark, table, schema, max_files_per_trigger=2), _scored, spark, "folder")
    assert sorted(r["id"] for r in out.collect()) == list(range(100))
    totals = running_totals(_scored(text_stream(spark, table, schema, max_files_per_trigger=1)), spark, "folder").collect()
    assert [(r["category"], r["n"], r["avg_confidence_pct"], r["hybrid_share_pct"]) for r in totals] == [("a", 100, 50.0, 100.0)]


def test_empty_table(spark, tmp_path):
    table = str(tmp_path / "e.parquet")
    spark.range(0).write.parquet(table)
    schema = spark.read.parquet(table).schema
    assert score_stream(text_stream(spark, table, schema), _scored, spark, "empty").count() == 0
    assert running_totals(_scored(text_stream(spark, table, schema)), spark, "empty").count() == 0


def test_totals_are_taken_up_again(spark, tmp_path):
    """Stopped in each batch once, between its folder and its record: nothing is lost and nothing counts twice."""
    import collections

    import pytest

    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", "abc"[i % 3], 0.5 + (i % 7) / 20, "hybrid_strong" if i % 4 == 0 else "model") for i in range(90)]
    df = spark.createDataFrame(rows, "id int, ts string, category string, confidence double, method string").selectExpr(
        "id", "to_timestamp(ts) AS ts", "category", "confidence", "method")
    for k in range(3):
        df.filter(f"id % 3 = {k} OR id = 5").coalesce(1).write.mode("append").parquet(source)  # row 5 comes with every file
    seen, stopped = collections.Counter(), set()

    def after(epoch):
        seen[epoch] += 1
        if len(stopped) < 3 and epoch not in stopped:
            stopped.add(epoch)
            raise InterruptedError("stop")

    run = lambda: T.resumable_totals(T.text_stream(spark, source, df.schema, 1), spark, folder, "id", "ts", after_batch=after)
    for _ in range(3):
        with pytest.raises(Exception, match="stop"):
            run()
    got = {r["category"]: r for r in run().collect()}
    assert len(stopped) == 3 and all(seen[e] == 2 for e in stopped)
    assert {c: r["n"] for c, r in got.items()} == dict(collections.Counter(r[2] for r in rows))
    for c, r in got.items():
        own = [x for x in rows if x[2] == c]
        assert abs(r["avg_confidence_pct"] - sum(round(x[3] * 10000) for x in own) / len(own) / 100) < 1e-9
        assert abs(r["hybrid_share_pct"] - 100 * sum("hybrid" in x[4] for x in own) / len(own)) < 1e-9
    assert run().count() == 3  # nothing new
    assert T.latest_totals(spark, str(tmp_path / "none")).count() == 0
