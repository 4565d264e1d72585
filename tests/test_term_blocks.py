"""Blocks of documents: what leaves a block, and naive Bayes with repeated rows against a plain computation."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from textlens.operators import models as MD
from textlens.operators.term_blocks import TermBlocks


def grams(text):
    t = (text or "").split()
    return Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])


def test_one_row_for_each_block_and_term(spark):
    """400 documents of the same 60 terms are 60 rows a block, not 400 times 60 postings."""
    text = " ".join(f"word{i}" for i in range(30)) + " end"
    rows = spark.createDataFrame([(i, text) for i in range(400)], "id long, text string").withColumn("counts", F.array(F.lit(1), F.lit(0), F.lit(0)))
    blocks = TermBlocks(rows, 1, 1, [400])
    sums = blocks.class_sums().collect()
    assert len(sums) == blocks.n_blocks * 61 and len({r["term"] for r in sums}) == 61
    assert {r["df0"] for r in sums} == {400} and blocks.n_terms[0] == 61
    assert abs(sum(r["w0"] for r in sums) - 400 * math.sqrt(61)) < 1e-6


def test_repeated_rows_null_labels_and_empty_texts(spark):
    rows = [(1, "aa bb cc", "x"), (1, "aa bb cc", "x"), (2, "bb cc dd", "y"), (3, "aa aa ee", "x"), (4, "dd ee bb", None),
            (5, "aa cc zz", "x"), (5, "aa cc zz", "x"), (6, "", "y"), (7, None, "x"), (None, "aa bb", "x"), (8, "dd bb cc", "y")]
    sides = {1: "train", 2: "train", 3: "train", 4: "train", 5: "test", 6: "test", 7: "train", 8: "test"}
    docs = spark.createDataFrame(rows, "id long, text string, category string")
    assign = spark.createDataFrame([(0, i, s) for i, s in sides.items()], "key int, id long, side string")
    got = MD.naive_bayes_keyed(docs, assign, "id", "text", "category").collect()

    tf = defaultdict(Counter)
    for i, t, _ in rows:
        tf[i] += grams(t)
    train = [(i, c) for i, _, c in rows if sides.get(i) == "train"]
    df = Counter(t for i, _ in train for t in tf[i])
    idf = {t: math.log((1 + len(train)) / (1 + d)) + 1 for t, d in df.items()}
    W = {c: Counter() for c in ("x", "y")}

    def weights(i, copies):
        raw = {t: n * idf[t] for t, n in tf[i].items() if t in idf}
        norm = math.sqrt(copies * sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()}

    for i, c in train:
        if c is not None:
            for t, v in weights(i, sum(1 for j, _ in train if j == i)).items():
                W[c][t] += v
    want = {}
    for i, copies in ((5, 2), (6, 1), (8, 1)):
        w = weights(i, copies)
        z = [math.log(sum(1 for _, k in train if k == c) / len(train)) + copies * sum(
            v * math.log((W[c][t] + 1) / (sum(W[c].values()) + len(df))) for t, v in w.items()) for c in ("x", "y")]
        e = [math.exp(v - max(z)) for v in z]
        want[i] = ([v / sum(e) for v in e], "xy"[z.index(max(z))])
    assert Counter(r["id"] for r in got) == {5: 4, 6: 1, 8: 1}
    for r in got:
        assert all(abs(a - b) < 1e-9 for a, b in zip(r["probs"], want[r["id"]][0])) and r["predicted"] == want[r["id"]][1]
        assert abs(r["confidence"] - max(r["probs"])) < 1e-12
