import math

from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlens.functions.arrays import argmax, softmax, top_k
from textlens.operators.scoring import hybrid_decision, score
from textlens.sources.lexicon import Lexicon


def test_softmax_uniform_and_argmax_tie(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0], [0.4, 0.4, 0.2])], "l array<double>, p array<double>")
    r = df.select(softmax("l").alias("s"), argmax("p").alias("a"), top_k("p", 2).alias("t")).first()
    assert r["s"] == [0.25] * 4
    assert r["a"] == 0
    assert [(x["label_id"], x["prob"]) for x in r["t"]] == [(0, 0.4), (1, 0.4)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-50, max_value=50), min_size=1, max_size=8))
def test_softmax_sums_to_one(spark, logits):
    df = spark.createDataFrame([(logits,)], "l array<double>")
    s = df.select(softmax("l", 0.5).alias("s")).first()["s"]
    assert math.isclose(sum(s), 1.0, rel_tol=1e-9)
    top = sorted(logits, reverse=True)
    # the arg-max is preserved when the best logit is separated by more than rounding noise
    assume(len(top) == 1 or top[0] - top[1] > 1e-6)
    assert s.index(max(s)) == logits.index(max(logits))


LADDER = [  # (kw_cat, score, conf, base) -> (category, method, matched)
    ((None, 0, 0.10, "b"), ("b", "model", [])),
    (("b", 1, 0.99, "b"), ("b", "agreement", ["k"])),
    (("k", 3, 0.44, "b"), ("k", "hybrid_strong", ["k"])),
    (("k", 3, 0.45, "b"), ("b", "model", [])),
    (("k", 2, 0.24, "b"), ("k", "hybrid_assisted", ["k"])),
    (("k", 2, 0.25, "b"), ("b", "model", [])),
    (("k", 1, 0.10, "b"), ("b", "model", [])),
]


def test_hybrid_ladder(spark):
    rows = [(i, kc, s, c, b, ["k"]) for i, ((kc, s, c, b), _) in enumerate(LADDER)]
    df = spark.createDataFrame(rows, "i int, kw_category string, kw_score int, base_confidence double, "
                                     "base_category string, kw_matches array<string>")
    out = {r["i"]: r for r in hybrid_decision(df).collect()}
    for i, (inp, (cat, method, matched)) in enumerate(LADDER):
        r = out[i]
        assert (r["category"], r["method"], r["matched_keywords"]) == (cat, method, matched), inp
        assert r["confidence"] == inp[2]  # always the model's confidence


def test_python_scorer_hook(spark):
    from textlens.operators.scoring import python_scorer, score
    from textlens.sources.lexicon import Lexicon

    def predict(texts):  # a stand-in foreign model: longer text -> class 1
        return [[0.9, 0.1] if (t or "") and len(t) < 10 else [0.2, 0.8] for t in texts]

    df = spark.createDataFrame([(1, "short"), (2, "a much longer text"), (3, None)], "id long, text string")
    probs = python_scorer(df, "text", predict, n_labels=2)
    out = {r["id"]: r for r in score(probs, "text", "probs", ["neg", "pos"], Lexicon.from_mapping({"neg": ["short"]})).collect()}
    assert out[1]["category"] == "neg" and out[1]["method"] == "agreement"
    assert out[2]["category"] == "pos" and out[2]["method"] == "model"
    assert out[3]["kw_category"] is None and out[3]["category"] == "pos"


def _scoring_rows(spark):
    texts = spark.createDataFrame(
        [(1, "The cat of the house"), (2, None), (3, "no hit"), (3, "and  IN\tthe end"), (None, "les"), (4, "les und")], "id long, text string")
    base = spark.createDataFrame([(1, [0.9, 0.1]), (3, [0.2, 0.8]), (4, None), (None, [0.5, 0.5])], "id long, probs array<double>")
    return texts, base, Lexicon.from_mapping({"0": ["the", "of the", "in the"], "1": ["les", "und", "und"]})


def test_a_filter_on_the_decision_folds_a_text_once(spark):
    texts, base, lexicon = _scoring_rows(spark)
    out = score(texts.join(base, "id", "left"), "text", "probs", ["0", "1"], lexicon).filter("category IS NOT NULL").select("category")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_scores_from_a_table_of_their_own(spark):
    texts, base, lexicon = _scoring_rows(spark)
    names = ["id", "base_category", "kw_category", "kw_score", "kw_matches", "rule", "category", "confidence", "method", "matched_keywords"]
    joined = score(texts.join(base, "id", "left"), "text", "probs", ["0", "1"], lexicon).select(names)
    apart = score(texts, "text", "probs", ["0", "1"], lexicon, base=base, on="id").select(names)
    key = lambda r: str(tuple(r))
    assert sorted(apart.collect(), key=key) == sorted(joined.collect(), key=key)
    assert apart.count() == 6
    assert {r["kw_category"]: (r["kw_score"], r["kw_matches"]) for r in apart.filter("id = 1 OR id = 4").collect()} == {
        "0": (3, ["the", "of the"]), "1": (3, ["les", "und", "und"])}
    # The join carries no text that nothing reads.
    plan = apart.select("category")._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan[:plan.index("Generate")]
