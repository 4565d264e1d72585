"""Scoring and the hybrid decision.

The base scorer is pluggable: anything that yields a probability array in
label-id order.  Two Spark-native scorers are provided (class centroids over an
embedding column, and the closed-form naive Bayes in ``models``); a foreign
Python model enters through ``python_scorer`` (Arrow batches via mapInPandas).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.functions.arrays import argmax, dot, softmax, top_k
from textlens.operators.keywords import with_keyword_result
from textlens.sources.lexicon import Lexicon

# The reference's decision thresholds (defaults, all parameters).
STRONG_SCORE = 3
STRONG_CONF = 0.45
ASSISTED_SCORE = 2
ASSISTED_CONF = 0.25
# Neutral method labels for the five ladder rungs.
METHOD_MODEL = "model"
METHOD_AGREEMENT = "agreement"
METHOD_STRONG = "hybrid_strong"
METHOD_ASSISTED = "hybrid_assisted"
# Rows that carry no base probabilities: keywords alone decide, or nothing does.
METHOD_KEYWORD = "keyword_only"
METHOD_NONE = "none"
UNCLASSIFIED = "unclassified"

# Largest class-centroid model (classes x dims values) carried inline in a plan.
MAX_MODEL_VALUES = 1_000_000


class CentroidModel:
    """Class means of an embedding column; logits = <x, mean_c> / temperature.

    Fitting is one distributed aggregate (partial per map task) whose output is
    classes x dims numbers, size-checked before it is brought to the driver the
    way any Spark ML model's coefficients are.
    """

    def __init__(self, labels: list, centroids: list[list[float]]):
        self.labels = labels
        self.centroids = centroids

    @classmethod
    def fit(cls, df: DataFrame, vec_col: str, label_col: str) -> "CentroidModel":
        per = (df.select(F.col(label_col).alias("label"), F.posexplode(vec_col).alias("pos", "x"))
               .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
        # one job: fetch at most MAX_MODEL_VALUES + 1 values, refuse if the limit is hit
        flat = per.orderBy("label", "pos").limit(MAX_MODEL_VALUES + 1).collect()
        if len(flat) > MAX_MODEL_VALUES:
            raise ValueError(f"centroid model has more than {MAX_MODEL_VALUES} values")
        by_label: dict = {}
        for r in flat:
            by_label.setdefault(r["label"], []).append(float(r["m"]))
        rows = [{"label": k, "v": v} for k, v in sorted(by_label.items())]
        return cls([r["label"] for r in rows], [r["v"] for r in rows])

    def logits(self, vec_col: str) -> Column:
        x = F.col(vec_col)
        return F.array(*[dot(x, F.array(*[F.lit(v) for v in c])) for c in self.centroids])

    def transform(self, df: DataFrame, vec_col: str, temperature: float = 1.0,
                  out_col: str = "probs") -> DataFrame:
        return df.withColumn(out_col, softmax(self.logits(vec_col), temperature))


def with_prediction(df: DataFrame, prob_col: str, labels: list, prefix: str = "base_") -> DataFrame:
    """M2: arg-max (lowest label id on ties) decoded through the label list, and its probability; null without probabilities."""
    lab = F.array(*[F.lit(str(x)) for x in labels])
    idx = argmax(F.col(prob_col))
    known = F.col(prob_col).isNotNull()  # element_at over literals is typed as never null
    return (df.withColumn(f"{prefix}label_id", F.when(known, idx))
            .withColumn(f"{prefix}category", F.when(known, F.element_at(lab, idx + 1)))
            .withColumn(f"{prefix}confidence", F.array_max(F.col(prob_col))))


def with_top_k(df: DataFrame, prob_col: str, labels: list, k: int = 3, out_col: str = "top") -> DataFrame:
    """M3: top-k (label, probability, percent) per row."""
    lab = F.array(*[F.lit(str(x)) for x in labels])
    return df.withColumn(out_col, F.transform(
        top_k(F.col(prob_col), k),
        lambda e: F.struct(F.element_at(lab, e["label_id"] + 1).alias("label"), e["prob"].alias("prob"),
                           F.round(e["prob"] * 100.0, 2).alias("pct"))))


def hybrid_decision(df: DataFrame, base_cat: str = "base_category", base_conf: str = "base_confidence",
                    kw_cat: str = "kw_category", kw_score: str = "kw_score", kw_matches: str = "kw_matches",
                    strong_score: int = STRONG_SCORE, strong_conf: float = STRONG_CONF,
                    assisted_score: int = ASSISTED_SCORE, assisted_conf: float = ASSISTED_CONF) -> DataFrame:
    """M4: the five-rung ladder, first match wins; confidence is always the model's.

    A row without a base category still gets a result: its keywords' category (rung 6) or
    ``UNCLASSIFIED`` (rung 7), with confidence 0.
    """
    kc, ks, conf, bc = F.col(kw_cat), F.col(kw_score), F.col(base_conf), F.col(base_cat)
    empty = F.array().cast("array<string>")
    rung = (F.when(bc.isNull(), F.when(kc.isNull(), F.lit(7)).otherwise(F.lit(6)))
            .when(kc.isNull(), F.lit(1))
            .when(kc == bc, F.lit(2))
            .when((ks >= strong_score) & (conf < strong_conf), F.lit(3))
            .when((ks >= assisted_score) & (conf < assisted_conf), F.lit(4))
            .otherwise(F.lit(5)))
    kw_wins = rung.isin(3, 4, 6)
    method = (F.when(rung == 6, F.lit(METHOD_KEYWORD)).when(rung == 7, F.lit(METHOD_NONE))
              .when(rung == 2, F.lit(METHOD_AGREEMENT)).when(rung == 3, F.lit(METHOD_STRONG))
              .when(rung == 4, F.lit(METHOD_ASSISTED)).otherwise(F.lit(METHOD_MODEL)))
    return (df.withColumn("rule", rung)
            .withColumn("category", F.when(kw_wins, kc).when(rung == 7, F.lit(UNCLASSIFIED)).otherwise(bc))
            .withColumn("confidence", F.coalesce(conf, F.lit(0.0)))
            .withColumn("method", method)
            .withColumn("matched_keywords", F.when(rung.isin(2, 3, 4, 6), F.col(kw_matches)).otherwise(empty)))


def score(df: DataFrame, text_col: str, prob_col: str, labels: list, lexicon: Lexicon,
          base: DataFrame | None = None, on: str | None = None, **ladder) -> DataFrame:
    """M5/M6: batch scoring of any text table that already carries base probabilities.

    One projection per row (arg-max, keyword match, ladder): no shuffle, order kept.  With ``base``, the
    probabilities are a table of their own, left-joined by ``on``: the texts are dealt by it once, since a
    table may come in few splits, and meet their keywords there; the join carries a text only if it is read later.
    """
    if base is None:
        out = with_keyword_result(with_prediction(df, prob_col, labels), text_col, lexicon)
    else:
        out = with_keyword_result(df.repartition(on), text_col, lexicon)
        out = out.join(with_prediction(base, prob_col, labels), on, "left")
    return hybrid_decision(out, **ladder)


def python_scorer(df: DataFrame, text_col: str, predict: Callable[[list[str]], list[list[float]]],
                  n_labels: int, keep: list[str] | None = None, out_col: str = "probs") -> DataFrame:
    """M5 hook for a foreign model: ``predict`` maps a list of texts to probability rows.

    Runs inside Arrow batches (mapInPandas); batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.  The model should be loaded
    once per Python worker inside ``predict`` (e.g. a module-level cache).
    """
    import pandas as pd

    keep = keep or [c for c in df.columns]
    in_schema = df.select(*keep).schema
    schema = T.StructType(list(in_schema.fields) + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            probs = predict(pdf[text_col].astype(object).where(pdf[text_col].notna(), None).tolist())
            if any(len(p) != n_labels for p in probs):
                raise ValueError("predict returned a probability row of the wrong length")
            pdf = pdf.copy()
            pdf[out_col] = [list(map(float, p)) for p in probs]
            yield pdf

    return df.select(*keep).mapInPandas(run, schema)
