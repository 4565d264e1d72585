"""Toxic passages by maximum-scoring segments over token log-odds.

Fit (labelled rows, a bounded sample of at most about ``MAX_LABELLED`` of them):

* Features are words and their prefixes of ``PREFIXES`` letters, lower-cased.
* A feature's score is its log-odds between toxic and other labelled texts (in how many
  texts it occurs, so repetition inside one text proves nothing) with an informative
  Dirichlet prior, whose mass follows the feature's share of *all* documents;
  the score used is the lower confidence bound (``Z_BOUND`` standard errors down), so thin
  evidence counts for little.  Features whose bound stays under ``MIN_SCORE`` are dropped.
* Every other word costs ``GAP``.  With the background probabilities of the scores this
  fixes Karlin and Altschul's lambda (sum of p * exp(lambda * s) = 1).

Score (every document, whole text): one linear scan finds all maximal-scoring segments
(Ruzzo and Tompa).  A segment of score S in a text of n words has the extreme-value
expectation n * exp(-lambda * S); segments expected at most ``PASSAGE_E`` times by chance
are reported as passages.  The best sum over the top r segments of (lambda * S - ln n), plus
ln r! for their order, is the document's statistic, and a one-dimensional logistic curve
fitted on the labelled sample turns it into a probability.

Only the sample's features travel (their number is bounded by the sample); counts over
the corpus are partial sums per task, then one aggregate.

Defined results: null and blank texts have no words and get the lowest score; repeated
rows are scored alike; labels with a null doc_id or null toxic are ignored; with no toxic
or no clean labelled text nothing is learned and every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.session import materialize

MAX_LABELLED = 20_000
PREFIXES = (4, 5, 6)
MIN_TEXTS = 3        # toxic texts of the sample that a feature must occur in
PRIOR_SHARE = 0.02   # prior mass as a share of the sample's texts
PRIOR_LEAST = 0.2    # least prior mass of a feature
Z_BOUND = 1.0
MIN_SCORE = 1.0
GAP = 0.3
PASSAGE_E = 0.05
NOTHING, SURE = -12.0, 5.0  # ends of the statistic; the first is that of a text without any scoring word
CACHE = 200_000      # cached words per task
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    slope: float = 0.0
    intercept: float = -50.0


class _WordScores(dict):
    """word -> score of its best feature, 0 if none; emptied when full."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[word] = s = max(self.scores.get(f, 0.0) for f in features(word))
        return s


def segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score) of a sequence whose words
    score as in ``hits`` (position, score) and -GAP elsewhere; Ruzzo and Tompa's linear scan."""
    out: list[list] = []  # [first, last, sum before, sum after]
    total, at = 0.0, 0
    for i, s in hits:
        total -= GAP * (i - at)
        at = i + 1
        cur = [i, i, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= cur[2]:
                j -= 1
            if j < 0 or out[j][3] >= cur[3]:
                out.append(cur)
                break
            cur = [out[j][0], cur[1], out[j][2], cur[3]]
            del out[j:]
    return [(a, b, after - before) for a, b, before, after in out]


def statistic(found: list[tuple[int, int, float]], n: int, lam: float) -> float:
    """Extreme-value statistic of a text's segments."""
    if not found:
        return NOTHING
    best, run = -math.inf, 0.0
    for r, s in enumerate(sorted((s for _, _, s in found), reverse=True), 1):
        # ln r grows with r, so the sums can fall first and rise later: all of them count.
        run += lam * s - math.log(max(n, 1)) + math.log(r)
        best = max(best, run)
    return max(NOTHING, min(SURE, best))


def _scan(text: str, word_scores: _WordScores):
    """(words, hits) of a text."""
    words = WORD.findall(text.lower())
    values = list(map(word_scores.__getitem__, words))
    return len(words), [(i, v) for i, v in enumerate(values) if v] if any(values) else []


def held_out(key: str = "doc_id", folds: int = 4, test: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the test fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == test, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled documents, chosen by a hash of the id."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > bound:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * bound / n))
    # About ``bound`` rows of two numbers: small enough to broadcast whatever the input.
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select(
        "text", F.col("toxic").cast("int").alias("toxic"))


DOCS, WORDS = "", "#"  # counters beside the features: texts, and words in them


class _WordFeatures(dict):
    """word -> its features among ``keep`` (all if None); emptied when full."""

    def __init__(self, keep: set[str] | None):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = f = features(word) if self.keep is None else [f for f in features(word) if f in self.keep]
        return f


def _counts(df: DataFrame, keep: set[str] | None) -> DataFrame:
    """(feature, toxic, n) per batch: in how many texts a feature occurs; ``keep`` limits the features."""
    def run(batches):
        import pyarrow as pa

        own = _WordFeatures(keep)
        for batch in batches:
            rows = Counter()
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                words = WORD.findall((text.as_py() or "").lower())
                rows[DOCS, y] += 1
                rows[WORDS, y] += len(words)
                for f in {f for w in set(words) for f in own[w]}:
                    rows[f, y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32()),
                                              pa.array(rows.values(), pa.int64())], ["feature", "toxic", "n"])

    return df.mapInArrow(run, "feature string, toxic int, n long")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn scores, lambda and calibration from ``labels`` (doc_id, toxic) and all ``docs``."""
    sample = materialize(labelled_sample(docs, labels), "toxicity_sample")
    bad = F.col("toxic") > 0
    both = _counts(sample, None).groupBy("feature").agg(F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("t"),
                                                        F.sum(F.when(bad, 0).otherwise(F.col("n"))).alias("c"))
    both = materialize(both, "toxicity_counts")
    size = {r["feature"]: r for r in both.filter(F.col("feature").isin(DOCS, WORDS)).collect()}
    nt, nc = (size[DOCS]["t"], size[DOCS]["c"]) if size else (0, 0)
    if not nt or not nc:
        return Model()
    length = max(1.0, (size[WORDS]["t"] + size[WORDS]["c"]) / (nt + nc))
    # Features of the bounded sample that its toxic texts prefer.
    rows = both.filter(f"t >= {MIN_TEXTS} AND t * {float(nc)} > 3 * c * {float(nt)}").collect()
    rows = [r for r in rows if r["feature"] not in (DOCS, WORDS)]
    keep = {r["feature"] for r in rows}
    corpus = _counts(docs.select("text", F.lit(0).alias("toxic")), keep).groupBy("feature").agg(F.sum("n").alias("n"))
    share = {r["feature"]: r["n"] for r in corpus.collect()}
    mass, total = PRIOR_SHARE * (nt + nc), max(1, share.get(DOCS, 1))
    scores, background = {}, {}
    for r in rows:
        f, t, c = r["feature"], r["t"], r["c"]
        a = max(PRIOR_LEAST, mass * share.get(f, 0) / total)
        delta = math.log((t + a) / (nt + a)) - math.log((c + a) / (nc + a))
        bound = delta - Z_BOUND * math.sqrt(1 / (t + a) + 1 / (c + a))
        if bound >= MIN_SCORE:
            scores[f], background[f] = bound, (c + a) / (nc + mass) / length
    model = Model(scores, _lambda(scores, background))
    if scores:
        model.intercept, model.slope = _calibrate(_statistics(sample, model))
    return model


def _lambda(scores: dict[str, float], background: dict[str, float]) -> float:
    """Positive root of sum p * exp(lambda * s) = 1; words (not prefixes) carry the probabilities."""
    pairs = [(background[f], s) for f, s in scores.items() if not f.endswith("*")] or [(background[f], s) for f, s in scores.items()]
    other = max(0.0, 1 - sum(p for p, _ in pairs))
    excess = lambda x: sum(p * math.exp(min(700.0, x * s)) for p, s in pairs) + other * math.exp(-GAP * x) - 1
    low, high = 1e-3, 1e-3
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _statistics(sample: DataFrame, model: Model) -> dict[tuple[float, int], int]:
    """Histogram {(statistic rounded to a tenth, label): rows} of the sample."""
    def run(batches):
        import pyarrow as pa

        own = _WordScores(model.scores)
        for batch in batches:
            x = []
            for text in batch.column(0):
                n, hits = _scan(text.as_py() or "", own)
                x.append(round(statistic(segments(hits), n, model.lam), 1))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    got = sample.mapInArrow(run, "x double, toxic int").groupBy("x", (F.col("toxic") > 0).cast("int").alias("y")).count()
    return {(r["x"], r["y"]): r["count"] for r in got.collect()}  # at most 171 steps times two labels


def _calibrate(histogram: dict[tuple[float, int], int], ridge: float = 0.01) -> tuple[float, float]:
    """(intercept, slope) of P(toxic | x) by Newton steps on the histogram."""
    import numpy as np

    x, y, n = (np.array(v, float) for v in zip(*((x, y, n) for (x, y), n in histogram.items())))
    X, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        grad = X.T @ (n * (p - y)) + ridge * w * [0, 1]
        hess = X.T @ (X * (n * p * (1 - p))[:, None]) + np.diag([1e-6, ridge])
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score, n_words, passages) per row; ``passages`` are array<struct<start, end, e_value>>
    in code points, the significant segments in text order."""
    def run(batches):
        import pyarrow as pa

        own = _WordScores(model.scores)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("e_value", pa.float64())]))
        for batch in batches:
            probs, sizes, spans = [], [], []
            for item in batch.column(1):
                text = item.as_py() or ""
                n, hits = _scan(text, own)
                found = segments(hits)
                z = model.intercept + model.slope * statistic(found, n, model.lam)
                probs.append(1 / (1 + math.exp(min(700.0, -z))) if model.scores else 0.0)
                sizes.append(n)
                sure = [(a, b, e) for a, b, s in found if (e := n * math.exp(-model.lam * s)) <= PASSAGE_E]
                if sure:
                    # Lower-casing can change a text's length, so places are found in the text itself.
                    at = [m.span() for m in WORD.finditer(text)]
                    sure = [(at[a][0], at[b][1], e) for a, b, e in sure if b < len(at)]
                spans.append([{"start": a, "end": b, "e_value": e} for a, b, e in sure])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probs, pa.float64()), pa.array(sizes, pa.int32()),
                                              pa.array(spans, span)], ["doc_id", "score", "n_words", "passages"])

    d = docs.select(F.col(id_col).alias("doc_id"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, score double, n_words int, passages array<struct<start:int,end:int,e_value:double>>")
