import math

from textlens.operators import metrics as E
from textlens.operators.report import log_summary


def test_macro_scores_and_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "y string, p string")
    s = E.summary(df, "y", "p").first()
    assert math.isclose(s["accuracy"], 1 / 3)
    assert math.isclose(s["precision"], 1 / 3)
    assert math.isclose(s["recall"], 1 / 6)
    assert math.isclose(s["macro_f1"], 2 / 9)
    cm = E.confusion_matrix(df, "y", "p").collect()
    assert len(cm) == 9 and sum(r["n"] for r in cm) == 3
    rep = {r["class"]: r for r in E.class_report(df, "y", "p").collect()}
    assert rep["c"]["support"] == 0 and rep["accuracy"]["f1"] == 1 / 3


def test_balanced_recall_equals_accuracy(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("c", "c")]
    s = E.summary(spark.createDataFrame(rows, "y string, p string"), "y", "p").first()
    assert math.isclose(s["recall"], s["accuracy"])


def test_hybrid_share(spark):
    log = spark.createDataFrame([("x", 0.5, m) for m in ["model", "agreement", "hybrid_strong", "hybrid_assisted"]],
                                "category string, confidence double, method string")
    r = log_summary(log).first()
    assert r["total"] == 4 and r["hybrid_share_pct"] == 50.0 and r["avg_confidence_pct"] == 50.0
