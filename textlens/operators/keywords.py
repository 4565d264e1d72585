"""Keyword layer.

Matching is by **substring** of the normalised text (so `treatment` contains
`atm`), phrase weight is its word count capped at 3, and the dictionary is a
multiset keyed by ``kw_id``.  The lexicon is bounded and rides along in the plan
as a literal array, so scoring is a pure per-row projection: no join, no
shuffle, whole texts; the fold is interpreted on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.arrays import let
from textlens.functions.text import normalize_text, tokens, unigrams_bigrams
from textlens.operators.common import top_k_per_group
from textlens.sources.lexicon import Lexicon, lexicon_literal


def _in_category(i):
    """Predicate on a hit struct (one-argument lambda: PySpark reads a second one as the index)."""
    return lambda h: h["cat_order"] == (F.lit(i) if isinstance(i, int) else i)


def _hits_of(norm: Column, lex: Column, lower_keyword: bool = False, finish=None) -> Column:
    """Fold over the lexicon with the text as the fold's start value: the (regex)
    normalisation runs once per row, and every later step reads the matched
    entries from the accumulator instead of re-deriving them.  Catalyst cannot
    duplicate work that lives inside one fold, whatever it inlines or pushes down.
    """
    empty = F.filter(lex, lambda e: F.lit(False))
    start = F.struct(norm.alias("t"), empty.alias("hits"))

    def step(acc, e):
        kw = F.lower(e["keyword"]) if lower_keyword else e["keyword"]
        return F.struct(acc["t"].alias("t"),
                        F.when(F.contains(acc["t"], kw), F.concat(acc["hits"], F.array(e)))
                        .otherwise(acc["hits"]).alias("hits"))

    return F.aggregate(lex, start, step, lambda acc: finish(acc["hits"]) if finish else acc["hits"])


def _scores(hits: Column, k: int) -> Column:
    """Per-category weighted score array (category order) from a hit list."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda c: F.aggregate(F.filter(hits, _in_category(c)), F.lit(0),
                                             lambda acc, h: acc + h["weight"]))


def _category_scores(hits: Column, categories: list[str]) -> Column:
    """ARRAY<STRUCT<category, cat_order, score, matches>> in dictionary category order."""
    out = []
    for i, cat in enumerate(categories):
        mine = F.filter(hits, _in_category(i))
        out.append(F.struct(
            F.lit(cat).alias("category"), F.lit(i).alias("cat_order"),
            F.aggregate(mine, F.lit(0), lambda acc, h: acc + h["weight"]).alias("score"),
            F.transform(mine, lambda h: h["keyword"]).alias("matches")))
    return F.array(*out)


def _decide(hits: Column, categories: list[str]) -> Column:
    """K2+K3 from a hit list: STRUCT<category, score, matches>; null category on
    no hit or on a tie (score then is the tied best), matches of the winner only."""
    names = F.array(*[F.lit(c) for c in categories])

    def decided(scores, best):
        unique = (best > 0) & (F.size(F.filter(scores, lambda s: s == best)) == 1)
        # The winner's place, null without one: then no hit is the winner's.
        return let(F.when(unique, (F.array_position(scores, best) - 1).cast("int")), lambda win: F.struct(
            F.when(win.isNotNull(), F.element_at(names, win + 1)).alias("category"),
            best.alias("score"),
            F.transform(F.filter(hits, _in_category(win)), lambda h: h["keyword"]).alias("matches")))

    # Scores and winner are read by lambdas, which would derive them again for every element.
    return let(_scores(hits, len(categories)), lambda scores: let(F.array_max(scores), lambda best: decided(scores, best)))


def keyword_hits(text: Column, lexicon: Lexicon, normalize: bool = True) -> Column:
    """Matched lexicon entries, in dictionary order (repeats kept)."""
    norm = normalize_text(text) if normalize else F.lower(text)
    return _hits_of(norm, lexicon_literal(lexicon, lower=True))


def keyword_result(text: Column, lexicon: Lexicon) -> Column:
    """K1-K3 as one per-row expression: STRUCT<category, score, matches>."""
    cats = lexicon.categories
    return _hits_of(normalize_text(text), lexicon_literal(lexicon, lower=True),
                    finish=lambda hits: _decide(hits, cats))


def with_keyword_result(df: DataFrame, text_col: str, lexicon: Lexicon, prefix: str = "kw_") -> DataFrame:
    """K1-K3 per row: adds ``kw_category`` (null on no hit or tie), ``kw_score``
    (best score; the tied best score on ties; 0 on no hit) and ``kw_matches``
    (phrases of the winner in dictionary order; empty otherwise).
    """
    # A generator's output: a filter on what is derived from it stays above, and does not fold the text again.
    return df.select("*", F.inline(F.array(keyword_result(F.col(text_col), lexicon))).alias(
        f"{prefix}category", f"{prefix}score", f"{prefix}matches"))


def keyword_scores(df: DataFrame, id_col: str, text_col: str, lexicon: Lexicon) -> DataFrame:
    """K1: (id, category, score, n_matches) for every category with a positive score."""
    cats = lexicon.categories
    per_cat = _hits_of(normalize_text(F.col(text_col)), lexicon_literal(lexicon, lower=True),
                       finish=lambda hits: _category_scores(hits, cats))
    per = df.select(F.col(id_col), F.explode(per_cat).alias("s"))
    return (per.filter(F.col("s.score") > 0)
            .select(F.col(id_col), F.col("s.category").alias("category"), F.col("s.score").alias("score"),
                    F.size("s.matches").alias("n_matches")))


def keyword_scores_join(df: DataFrame, id_col: str, text_col: str, lexicon_df: DataFrame) -> DataFrame:
    """K1 for a large lexicon given as a table (kw_id, category, keyword).

    Theta join on ``contains``; the lexicon side is broadcast only after its row
    count is checked, and the aggregate is partial per map task.
    """
    from textlens.sources.lexicon import MAX_INLINE_PHRASES
    from textlens.functions.text import keyword_weight

    n = lexicon_df.count()
    if n > 20 * MAX_INLINE_PHRASES:
        raise ValueError(f"lexicon of {n} phrases is too large for a broadcast theta join; "
                         "index it by words and use mode='word'")
    lex = lexicon_df.select("kw_id", "category", F.trim(F.lower("keyword")).alias("keyword"),
                            keyword_weight(F.lower("keyword")).alias("weight"))
    docs = df.select(F.col(id_col), normalize_text(text_col).alias("_norm"))
    hits = docs.join(F.broadcast(lex), F.contains(F.col("_norm"), F.col("keyword")))
    return (hits.groupBy(id_col, "category")
            .agg(F.sum("weight").cast("int").alias("score"), F.count(F.lit(1)).cast("int").alias("n_matches")))


def with_first_generation(df: DataFrame, text_col: str, lexicon: Lexicon, prefix: str = "kw1_") -> DataFrame:
    """K4: unweighted hit count per category over the lower-cased (not
    whitespace-normalised) text; the best category is the first in dictionary
    order among the highest counts (also when every count is 0).
    """
    cats = lexicon.categories

    def finish(hits):
        counts = F.array(*[
            F.struct(F.size(F.filter(hits, _in_category(i))).alias("score"),
                     F.lit(-i).alias("neg_order"), F.lit(c).alias("category"))
            for i, c in enumerate(cats)])
        # max by (score, -order): the highest score, earliest category on ties
        return F.array_max(counts)

    r = f"_{prefix}r"
    best = _hits_of(F.lower(F.col(text_col)), lexicon_literal(lexicon, lower=False), lower_keyword=True,
                    finish=finish)
    return (df.withColumn(r, best)
            .withColumn(f"{prefix}category", F.col(r)["category"])
            .withColumn(f"{prefix}score", F.col(r)["score"]).drop(r))


def first_generation_decision(df: DataFrame, base_category: str, base_conf: str,
                              prefix: str = "kw1_") -> DataFrame:
    """K5: any keyword hit overrides the model; confidence stays the model's."""
    hit = F.col(f"{prefix}score") > 0
    return (df.withColumn("category", F.when(hit, F.col(f"{prefix}category")).otherwise(F.col(base_category)))
            .withColumn("confidence", F.col(base_conf))
            .withColumn("method", F.when(hit, F.lit("keyword_override")).otherwise(F.lit("model"))))


def class_top_terms(df: DataFrame, text_col: str, label_col: str, k: int = 15, salts: int = 64) -> DataFrame:
    """K6: per class, the k 1-2-grams with the highest total count (ties: term asc).

    (class, term) counts are partially aggregated map-side; the top-k is exact
    and salted so that a huge class is ranked by many tasks.
    """
    tok = df.select(F.col(label_col).alias("category"), tokens(F.col(text_col)).alias("tk"))
    grams = tok.select("category", F.explode(unigrams_bigrams("tk")).alias("term"))
    counts = grams.groupBy("category", "term").agg(F.count(F.lit(1)).alias("tf"))
    top = top_k_per_group(counts, ["category"], [F.col("tf").desc(), F.col("term").asc()], k,
                          salt=F.xxhash64("term"), salts=salts)
    return top.select("category", "term", "tf", "rank")
