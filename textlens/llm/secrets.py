"""Secret scan: fixed patterns plus a log-likelihood ratio of two character Markov models.

Base spans come from three patterns.  The method then scores every other long token with
two first-order character chains, one of random strings and one of ordinary identifiers,
and adds the tokens whose log-likelihood ratio says "random".

The chains are trained from labelled samples over all documents: the values of the base
spans are labelled random, every other token of at least ``MIN_TRAIN`` characters is
labelled ordinary.  Training counts (label, character pair) with map-side aggregates; the
model is one number per pair of a fixed alphabet, at most ``len(ALPHABET)`` squared values
whatever the corpus size, and travels as a literal array.  Scoring is one pass without a
join or a shuffle.

Defined results: a null text is empty and has no spans; rows are judged one by one, so
repeated rows and repeated ids repeat their result; without any labelled token all pair
weights are zero and no span is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.arrays import let
from textlens.llm.common import joined_spans, matches, replace_spans

KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?"
          r"([A-Za-z0-9+/_.=-]++)")
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
MIN_VALUE = 6     # shortest value of an assignment

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_TRAIN = 12    # shortest token that trains the chains
MIN_SECRET = 16   # shortest token that the chains may call a secret
MIN_LLR = 12.0    # nats in favour of "random" over the whole token
MIN_MEAN_LLR = 0.5  # and per character pair
BACK_OFF = 1000.0  # observations of a character that weigh as much as the single-character frequencies
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the three fixed patterns; the value of an assignment needs MIN_VALUE characters."""
    value = lambda h: F.length(F.regexp_extract(h, ASSIGN, 2)) >= MIN_VALUE
    return {"assign": matches(text, ASSIGN, keep=value), "access": matches(text, ACCESS, F.contains(text, F.lit("AKIA"))),
            "hex": matches(text, HEX)}


def samples(docs: DataFrame) -> DataFrame:
    """Labelled samples (token, random) of all documents, from the base patterns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(text.alias("text")).withColumns(base_spans(F.col("text")))
    values = F.concat(F.transform("assign", lambda s: F.regexp_extract(s["hit"], ASSIGN, 2)),
                      F.transform("access", lambda s: s["hit"]), F.transform("hex", lambda s: s["hit"]))
    d = d.select(F.array_distinct(values).alias("secret"),
                 F.regexp_extract_all("text", F.lit(TOKEN % MIN_TRAIN), F.lit(0)).alias("long"))
    secret = d.select(F.explode("secret").alias("token"), F.lit(1).alias("random"))
    plain = d.select(F.explode(F.array_except("long", "secret")).alias("token"), F.lit(0).alias("random"))
    # A stretch that contains a base value ("token=abc...") is no ordinary identifier.
    return secret.unionByName(plain.filter(~F.col("token").rlike(HEX) & ~F.col("token").rlike(ACCESS)
                                           & ~F.col("token").rlike(ASSIGN)))


def pair_weights(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio ln P(b|a, random) - ln P(b|a, ordinary) of every pair (a, b) of the
    alphabet, row by row; zeros if either label is missing."""
    codes = let(_codes(F.col("token")), lambda c: F.transform(
        F.slice(c, 2, F.size(c)), lambda b, i: F.get(c, i) * F.lit(len(ALPHABET)) + b))
    clean = labelled.select("random", F.regexp_replace("token", "[^A-Za-z0-9+/_=-]", "").alias("token"))
    counts = (clean.select("random", F.explode_outer(codes).alias("pair")).filter("pair IS NOT NULL")
              .groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")))
    n = len(ALPHABET)
    pairs, seen = {0: [0] * (n * n), 1: [0] * (n * n)}, set()
    for r in counts.collect():  # at most 2 * len(ALPHABET) ** 2 rows
        pairs[r["random"]][r["pair"]] = r["n"]
        seen.add(r["random"])
    if seen != {0, 1}:
        return [0.0] * (n * n)

    def chain(k: int) -> list[float]:
        """P(b|a), backed off to P(b) where a is rare; half of a random string is uniform."""
        ends = [sum(pairs[k][b::n]) + 0.5 for b in range(n)]
        single = [e / sum(ends) for e in ends]
        uniform = k * 0.5
        return [uniform / n + (1 - uniform) * (c + BACK_OFF * single[b]) / (sum(pairs[k][a * n:a * n + n]) + BACK_OFF)
                for a in range(n) for b, c in enumerate(pairs[k][a * n:a * n + n])]

    return [math.log(p) - math.log(q) for p, q in zip(chain(1), chain(0))]


def _codes(token: Column) -> Column:
    """Places of a token's characters in the alphabet, from 0; one pass over the token."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def is_random(token: Column, weights: list[float]) -> Column:
    """Whether the chains call a token (of alphabet characters) random."""
    w, n = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>"), len(ALPHABET)
    step = lambda a, b: F.struct((a["sum"] + F.when(a["last"] < 0, F.lit(0.0)).otherwise(
        F.get(w, a["last"] * F.lit(n) + b))).alias("sum"), b.alias("last"))
    total = F.aggregate(_codes(token), F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")), step, lambda a: a["sum"])
    return let(total, lambda t: (t >= MIN_LLR) & (t >= MIN_MEAN_LLR * (F.length(token) - 1)))


def scan(docs: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """``docs`` with four span columns (assign, access, hex, markov); null texts become empty.

    ``weights`` are trained over ``docs`` if not given.
    """
    if weights is None:
        weights = pair_weights(samples(docs))
    d = docs.withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumns(base_spans(F.col("text")))
    base = F.concat("assign", "access", "hex")
    added = F.filter(matches(F.col("text"), TOKEN % MIN_SECRET, keep=lambda t: is_random(t, weights)),
                     lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return d.withColumn("markov", added)


def all_spans(kinds=KINDS) -> Column:
    """One array of (start, kind's place, end, kind), by start and then kind."""
    def placed(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("place"),
                                                    s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.sort_array(F.concat(*[placed(i, k) for i, k in enumerate(kinds)]))


def redact(docs: DataFrame, weights: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans become one mark.

    Texts without a secret, null ones too, stay as they are.
    """
    names = docs.columns
    d = scan(docs.withColumn("_was", F.col("text")), weights).withColumn("_spans", all_spans())

    marked = F.transform("_spans", lambda s: F.struct(s["start"], s["end"], F.lit(mark).alias("mark")))
    text = replace_spans(F.col("text"), marked)
    return d.withColumn("text", F.when(F.size("_spans") > 0, text).otherwise(F.col("_was"))).select(*names)


def digest(docs: DataFrame) -> DataFrame:
    """The result columns of query op6."""
    d = scan(docs).select("doc_id", *KINDS)
    base = joined_spans(all_spans(KINDS[:3]))
    return d.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                    F.sha2(base, 256).alias("base_sha256"), joined_spans(all_spans()).alias("spans"),
                    F.size("markov").cast("long").alias("n_markov"))
