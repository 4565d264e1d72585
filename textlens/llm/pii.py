"""Personal data: fixed patterns, and terms that give a protected entity away.

Base spans (email, ip, card, phone) come from patterns.  Every distinct value is a
protected entity c.  The method removes what would still disclose it: a term t of the
corpus discloses c as far as knowing t tells c, measured by

    disclosure(c, t) = PMI(c, t) / IC(c) = 1 + ln P(c | t) / -ln P(c)

with probabilities from document counts over the whole corpus (1: t occurs only with c;
0: independent).  A term at ``GENERALISE`` or above is generalised (``[TERM]``), at
``REMOVE`` or above removed, wherever it occurs.

Counts would be fooled by copies: all words of a text that was copied ten times "occur
with" its e-mail address ten times.  So entities and terms need at least ``MIN_TEXTS``
different texts, and at least ``MIN_CONTEXTS`` of these must show them between different
neighbours; copies and near copies repeat the neighbours too.

Everything is DataFrame code.  Documents with a base span are written once; pairs (c, t)
are formed only for entities that pass the test above; term counts are one map-side
aggregate over the corpus; risky terms are broadcast only up to ``BROADCAST_TERMS`` rows.

Defined results: a null text is empty and has no spans; repeated rows and repeated ids
keep their own rows; without any entity nothing is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import joined_spans, matches, replace_spans, settled
from textlens.session import materialize

KINDS = ["email", "ip", "card", "phone"]
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SMALL_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
TERM = r"\p{L}[\p{L}\p{N}]{3,}+"

MIN_TEXTS = 3
MIN_CONTEXTS = 0.5
GENERALISE = 0.85
REMOVE = 0.95
BROADCAST_TERMS = 100_000


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def term(i):
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i))
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the four fixed patterns."""
    def card(h):
        n = F.length(_digits(h))
        return F.when(n.between(13, 19), luhn(_digits(h))).otherwise(F.lit(False))

    return {"email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
            "ip": matches(text, IP, keep=lambda h: h.rlike(SMALL_PARTS)),
            "card": matches(text, CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), keep=card),
            "phone": matches(text, PHONE, F.contains(text, F.lit("+")), keep=lambda h: F.length(_digits(h)).between(9, 15))}


def _entities() -> Column:
    """array<struct<value, ctx>> of the base spans: the normalised value and a hash of its neighbours."""
    def of(kind: str) -> Column:
        value = (lambda h: F.lower(h)) if kind == "email" else (lambda h: h) if kind == "ip" else _digits
        near = lambda s: F.xxhash64(F.substring(F.col("text"), F.greatest(s["start"] - 12, F.lit(0)) + 1, F.least(s["start"], F.lit(12))),
                                    F.substring(F.col("text"), s["end"] + 1, F.lit(12)))
        return F.transform(kind, lambda s: F.struct(F.concat(F.lit(kind + ":"), value(s["hit"])).alias("value"), near(s).alias("ctx")))

    return F.concat(*[of(k) for k in KINDS])


def _several(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): rows per key, for keys seen in MIN_TEXTS texts and enough different contexts.

    ``df`` has keys, copy (a hash of the text), row and ctx.  Every step is a partial aggregate.
    """
    rows = df.groupBy(*keys, "copy", "row").agg(F.min("ctx").alias("ctx"))
    texts = rows.groupBy(*keys, "copy").agg(F.min("ctx").alias("ctx"), F.count(F.lit(1)).alias("n"))
    near = texts.groupBy(*keys, "ctx").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    out = near.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("contexts"))
    return out.filter((F.col("texts") >= MIN_TEXTS) & (F.col("contexts") >= MIN_CONTEXTS * F.col("texts"))).select(*keys, "n")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def disclosures(docs: DataFrame) -> DataFrame:
    """(term, disclosure) of the terms that disclose some entity at GENERALISE or above."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row"), text.alias("text"))
    found = settled(d.withColumns(base_spans(F.col("text"))).select("row", "text", _entities().alias("entities")))
    hits = materialize(found.filter(F.size("entities") > 0).withColumn("copy", F.xxhash64("text")), "pii_hits")
    mentions = hits.select("row", "copy", F.explode("entities").alias("e")).select("row", "copy", "e.value", "e.ctx")
    entities = materialize(_several(mentions, ["value"]).withColumnRenamed("n", "n_c"), "pii_entities")
    inside = mentions.join(entities.select("value"), "value").select("row", "copy", "value").distinct()
    w = F.col("w")
    near = F.transform(w, lambda t, i: F.struct(t.alias("term"), F.xxhash64(F.get(w, i - 1), F.get(w, i + 1)).alias("ctx")))
    words = hits.join(inside.select("row").distinct(), "row", "left_semi").select("row", terms(F.col("text")).alias("w"))
    words = words.select("row", F.inline(near))
    pairs = materialize(_several(inside.join(words, "row"), ["value", "term"]).withColumnRenamed("n", "n_ct"), "pii_pairs")
    total = F.lit(float(max(1, docs.count())))
    counts = (d.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term")
              .agg(F.count(F.lit(1)).alias("n_t")))
    known = pairs.join(counts, "term").join(entities, "value")
    risk = 1 + F.log(F.least(F.lit(1.0), F.col("n_ct") / F.col("n_t"))) / F.greatest(F.log(total / F.col("n_c")), F.lit(1e-9))
    return known.groupBy("term").agg(F.max(risk).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)


def scan(docs: DataFrame, risky: DataFrame | None = None) -> DataFrame:
    """``docs`` with four base span columns and ``term`` (array<struct<start,end,hit,disclosure>>);
    null texts become empty.  ``risky`` are ``disclosures(docs)`` if not given."""
    risky = materialize(disclosures(docs) if risky is None else risky, "pii_terms")
    side = F.broadcast(risky) if risky.count() <= BROADCAST_TERMS else risky
    names = docs.columns
    d = docs.withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumn("_copy", F.xxhash64("text"))
    # Texts are matched to their risky terms by content, once per distinct text.
    has = (d.select("_copy", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(side, "term")
           .groupBy("_copy").agg(F.array_sort(F.collect_set(F.struct("term", "disclosure"))).alias("_terms")))
    d = d.join(has, "_copy", "left").withColumns(base_spans(F.col("text")))

    def places(t):
        found = matches(F.col("text"), F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), t["term"], F.lit(r"\E(?![\p{L}\p{N}])")))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"),
                                                     t["disclosure"].alias("disclosure")))

    empty = F.array().cast("array<struct<start:int,end:int,hit:string,disclosure:double>>")
    base = F.concat(*KINDS)
    free = F.filter(F.flatten(F.transform("_terms", places)), lambda s: ~F.exists(
        base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return d.withColumn("term", F.when(F.col("_terms").isNull(), empty).otherwise(F.sort_array(free))).select(*names, *KINDS, "term")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans replaced by ``[KIND]``, risky terms generalised or removed.

    Texts without a span, null ones too, stay as they are.
    """
    names = docs.columns
    d = scan(docs.withColumn("_was", F.col("text")))

    def marked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark")))

    loose = F.transform("term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                   F.when(s["disclosure"] >= REMOVE, "").otherwise("[TERM]").alias("mark")))
    d = d.withColumn("_spans", F.sort_array(F.concat(*[marked(k) for k in KINDS], loose)))
    out = F.when(F.size("_spans") > 0, replace_spans(F.col("text"), F.col("_spans"))).otherwise(F.col("_was"))
    return d.withColumn("text", out).select(*names)


def digest(docs: DataFrame) -> DataFrame:
    """The result columns of query op2."""
    def kind(k: str) -> Column:
        return F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    d = scan(docs).select("doc_id", *KINDS, "term")
    base = F.concat(*[kind(k) for k in KINDS])
    return d.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                    F.sha2(joined_spans(base), 256).alias("base_sha256"),
                    joined_spans(F.concat(base, kind("term"))).alias("spans"), F.size("term").cast("long").alias("n_term"))
