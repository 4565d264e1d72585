import os
import tempfile

from pyspark.sql import functions as F

from textlens.sources import append_log, read_labelled_csv, read_log, read_user_csv, text_column, truncate_log, write_csv
from textlens.sources.tables import EVAL_SCHEMA


def test_eval_csv_with_trailing_comma(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "eval.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write('text,category,\n"water, no supply",Water,\nbijli nahi,Electricity,\n')
    df = read_labelled_csv(spark, p, EVAL_SCHEMA)
    assert df.columns == ["text", "category"]
    assert sorted(tuple(r) for r in df.collect()) == [("bijli nahi", "Electricity"), ("water, no supply", "Water")]


def test_user_csv_text_column_and_sinks(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "up.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("n,complaint\n1,road broken\n2,no water\n")
    df = read_user_csv(spark, p)
    t = text_column(df, "complaint", id_col="n")
    assert [r["text"] for r in t.orderBy("n").collect()] == ["road broken", "no water"]
    out = os.path.join(d, "res")
    scored = t.select(F.col("text").alias("complaint"), F.lit("Roads").alias("category"),
                      F.lit(0.5).alias("confidence"), F.lit("model").alias("method"),
                      F.array(F.lit("road"), F.lit("broken")).alias("matched_keywords"))
    write_csv(scored, out)
    back = spark.read.option("header", True).csv(out)
    assert sorted(r["matched_keywords"] for r in back.collect()) == ["road, broken", "road, broken"]
    log = os.path.join(d, "log")
    append_log(scored, log)
    append_log(scored, log)
    assert read_log(spark, log).count() == 4
    truncate_log(spark, log)
    assert read_log(spark, log).count() == 0


def test_user_csv_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,text\n1,fine\n2,too,many,cells\n3\n", encoding="utf-8")
    rows = {r["id"]: r["_corrupt_record"] for r in read_user_csv(spark, str(tmp_path / "u.csv")).collect()}
    assert rows["1"] is None and rows["2"] == "2,too,many,cells" and rows["3"] == "3"


def test_log_by_day(spark, tmp_path):
    """Write, write again, append, truncate and read back; recent rows read the last days only."""
    from datetime import datetime

    from pyspark.sql import functions as F

    from textlens.sources import sinks as S

    path = str(tmp_path / "log")
    rows = [(i, datetime(2024, 1, 1 + i // 10, 1, i % 10), "x") for i in range(40)]
    log = spark.createDataFrame(rows, "id int, timestamp timestamp, method string")
    S.replace_days(log, path)
    read = lambda: S.read_days(spark, path, log.schema)
    count = lambda: {str(r["day"]): r["n"] for r in read().groupBy("day").agg(F.count("id").alias("n")).collect()}
    assert count() == {f"2024-01-0{d}": 10 for d in range(1, 5)}
    S.replace_days(log.filter("id < 15"), path)  # the second day now holds five rows
    assert count() == {"2024-01-01": 10, "2024-01-02": 5, "2024-01-03": 10, "2024-01-04": 10}
    S.append_days(log.filter("id = 39"), path)
    S.truncate_day(spark, path, "2024-01-03", log.schema)
    assert count() == {"2024-01-01": 10, "2024-01-02": 5, "2024-01-04": 11}
    last = S.recent_days(read(), 12)
    assert {str(r["day"]) for r in last.select("day").distinct().collect()} == {"2024-01-02", "2024-01-04"}
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-02" in plan
    assert S.recent_days(read(), 1000).count() == 26
    empty = str(tmp_path / "none")
    S.replace_days(log.limit(0), empty)
    S.truncate_day(spark, empty, "2024-01-01", log.schema)
    assert S.recent_days(S.read_days(spark, empty, log.schema), 5).count() == 0
