"""Benchmark decontamination with spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; positions marked 0 are ignored, so a
window still hits after a substitution there.  All mask windows of all benchmark items are
hashed; every window of every document is hashed with the same masks and tested against a
fixed-size bitmap of the benchmark hashes, so only likely hits leave the document as rows.
Those join the benchmark hashes, and every hit (document, item, diagonal) is verified: item
and document tokens are compared position by position along the diagonal, and the stretch
with the best score (+1 per equal token, -2 per different one) decides.

The masks have five ones each and were chosen by enumeration: whatever was substituted, a
best stretch of at least ``MIN_MATCHED`` equal tokens holds a window of one of them, in items
of any length.

The benchmark is the small side.  Its hashes are broadcast only up to ``BROADCAST_ROWS``
rows; beyond that the likely hits join them by a shuffle.  The bitmap's size is fixed; a
larger benchmark fills it and costs work, never results.

Tokens are the lower-cased runs of letters and digits.  Defined results: null and blank
texts have no tokens; items with fewer tokens than the shortest mask cannot be hit; rows
with the same doc_id (null is an id too) are one document; equal items keep their own
rows; a document that shares several stretches with an item gives one row, its best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.session import materialize

MASKS = ["111101", "110011001"]
BITMAP_BITS = 1 << 20
BROADCAST_ROWS = 500_000
MIN_MATCHED = 8      # equal tokens in the best stretch; all of them in a shorter item
MIN_SHARE = 0.5      # of the item's tokens, and
LONG_MATCH = 20      # or this many equal tokens whatever the item's length


def tokens(text: Column) -> Column:
    """Array of tokens: lower-cased runs of letters and digits."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.when(F.length(bare) > 0, F.split(bare, r"[^\p{L}\p{N}]+")).otherwise(F.array().cast("array<string>"))


def seeds(codes: Column) -> Column:
    """array<struct<m, at, h>>: every mask window of an array of token codes."""
    def windows(m: int, mask: str) -> Column:
        on = [i for i, c in enumerate(mask) if c == "1"]
        at = F.when(F.size(codes) >= len(mask), F.sequence(F.lit(0), F.size(codes) - len(mask))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(
            i.alias("at"), F.xxhash64(F.lit(m), *[F.get(codes, i + k) for k in on]).alias("h")))

    return F.concat(*[windows(m, mask) for m, mask in enumerate(MASKS)])


def _slots(h: Column) -> list[Column]:
    """Two bit positions of a hash."""
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(BITMAP_BITS - 1)).cast("int") for k in (0, 32)]


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _coded(df: DataFrame, key: str) -> DataFrame:
    """(key, content, codes): a hash of the text, and one 64-bit code per token."""
    d = df.select(key, text_hash().alias("content"), tokens(F.col("text")).alias("w"))
    return d.select(key, "content", F.transform("w", lambda w: F.xxhash64(w)).alias("codes"))


def bitmap(item_seeds: DataFrame) -> Column:
    """Literal array of 64-bit words with two bits set per benchmark hash; a fixed size."""
    slot = item_seeds.select(F.explode(F.array(*_slots(F.col("h")))).alias("slot"))
    bit = F.expr("shiftleft(1L, slot & 63)")
    got = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    out = [0] * (BITMAP_BITS // 64)
    for r in got.collect():  # at most BITMAP_BITS / 64 rows
        out[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, out))), ",").cast("array<bigint>")


def _best_stretch(equal: Column) -> Column:
    """Best-scoring stretch of an array of booleans: struct(score, start, end, matched)."""
    zero = F.struct(F.lit(0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("hits"), F.lit(0).alias("at"),
                    F.struct(F.lit(0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("end"),
                             F.lit(0).alias("matched")).alias("best"))

    def step(a, ok):
        fresh = a["score"] <= 0
        score = F.when(fresh, 0).otherwise(a["score"]) + F.when(ok, 1).otherwise(-2)
        start = F.when(fresh, a["at"]).otherwise(a["start"])
        hits = F.when(fresh, 0).otherwise(a["hits"]) + F.when(ok, 1).otherwise(0)
        now = F.struct(score.alias("score"), start.alias("start"), (a["at"] + 1).alias("end"), hits.alias("matched"))
        best = F.when(score > a["best"]["score"], now).otherwise(a["best"])
        return F.struct(score.alias("score"), start.alias("start"), hits.alias("hits"), (a["at"] + 1).alias("at"),
                        best.alias("best"))

    return F.aggregate(equal, zero, step, lambda a: a["best"])


def overlaps(docs: DataFrame, bench: DataFrame, by_text: bool = False) -> DataFrame:
    """Verified overlaps (doc_id, item_id, item_words, matched, item_start, item_end, doc_start, doc_end),
    the best per doc_id and item_id; token positions, end exclusive.  ``by_text`` tells documents
    apart by doc_id and ``content``, a hash of the text, which is then a column after doc_id."""
    side = _coded(bench, "item_id").select(
        "item_id", F.col("codes").alias("item_codes"), F.inline_outer(seeds(F.col("codes")))).filter(
        "h IS NOT NULL").withColumnRenamed("at", "item_at")
    facts = side.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("item_codes")).alias("longest")).first()
    bits, reach = bitmap(side), F.lit(int(facts["longest"] or 0))

    def likely(s):
        set_in = lambda slot: F.getbit(F.get(bits, F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))) == 1
        one, two = _slots(s["h"])
        return set_in(one) & set_in(two)

    d = _coded(docs, "doc_id")
    d = d.select("doc_id", "content", "codes", F.filter(seeds(F.col("codes")), likely).alias("hits"))
    # inline_outer, then a filter on its output: a filter on the array itself (inferred for
    # inline) would be pushed below and evaluate every window twice.
    d = d.select("doc_id", "content", "codes", F.inline_outer("hits")).filter("h IS NOT NULL")
    # Only the stretch that an item through this hit can cover travels on.
    first = F.greatest(F.col("at") - reach, F.lit(0))
    d = d.select("doc_id", "content", "h", "at", first.alias("first"),
                 F.slice("codes", first + 1, F.col("at") + reach - first).alias("near"))
    hit = d.join(F.broadcast(side) if facts["n"] <= BROADCAST_ROWS else side, "h")
    hit = hit.withColumn("shift", F.col("at") - F.col("item_at"))
    # All hits on one diagonal see the same aligned tokens; one of them is verified.
    hit = hit.groupBy("doc_id", "content", "item_id", "shift").agg(
        F.any_value(F.struct("first", "near", "item_codes")).alias("v"))
    equal = F.transform("v.item_codes", lambda c, j: F.coalesce(
        F.get(F.col("v.near"), F.col("shift") + j - F.col("v.first")) == c, F.lit(False)))
    best = hit.select("doc_id", "content", "item_id", "shift", F.size("v.item_codes").alias("item_words"),
                      _best_stretch(equal).alias("b"))
    document = ["doc_id", "content"] if by_text else ["doc_id"]
    found = best.groupBy(*document, "item_id").agg(F.max(F.struct(
        F.col("b.matched").alias("matched"), F.col("item_words"), F.col("b.start").alias("item_start"),
        F.col("b.end").alias("item_end"), (F.col("shift") + F.col("b.start")).alias("doc_start"),
        (F.col("shift") + F.col("b.end")).alias("doc_end"))).alias("x"))
    return found.select(*document, "item_id", "x.*")


def contaminated(overlap: DataFrame) -> DataFrame:
    """The overlaps that count as a leak."""
    return overlap.filter((F.col("matched") >= LONG_MATCH)
                          | ((F.col("matched") >= F.least(F.lit(MIN_MATCHED), F.col("item_words"))) & (F.col("matched") >= MIN_SHARE * F.col("item_words"))))


def clean_documents(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns as they were."""
    bad = contaminated(overlaps(docs, bench)).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_leak"]), "left_anti")


def clean_rows(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the rows whose own text leaks; rows of other texts that share a doc_id, null too, stay.

    The leaks are written first.  A row whose (doc_id, text) misses their bitmap is clean and stays where
    it is; only the rows that hit it, the leaks and a few more, are shuffled to the exact anti join.
    """
    bad = materialize(contaminated(overlaps(docs, bench, by_text=True)).select(
        F.col("doc_id").alias("_id"), F.col("content").alias("_leak")).distinct(), "leaks")
    bits = bitmap(bad.select(F.xxhash64("_id", "_leak").alias("h")))
    one, two = _slots(F.xxhash64("doc_id", "_text"))
    set_in = lambda slot: F.getbit(F.get(bits, F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))) == 1
    marked = docs.withColumn("_text", text_hash()).withColumn("_hit", set_in(one) & set_in(two))
    hit = marked.filter("_hit").join(bad, F.col("_text").eqNullSafe(F.col("_leak")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti")
    return marked.filter("NOT _hit").unionByName(hit).select(*docs.columns)
