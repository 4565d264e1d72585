"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps one bit per failed rule
(``bits``) and the measurements behind them, so a policy - a named, versioned set of
rules - is a mask: a document passes if ``bits & mask = 0``.  Ablations never touch a
text again: they count distinct bit patterns once (a map-side aggregate of at most
2^rules rows) and answer "what would come back without rule r" with bitwise tests.

Defined results: a null text has no words, so it fails ``few_words``; blank texts the
same; repeated documents are judged row by row; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.arrays import let
from textlens.llm.common import SPACES, settled, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits"]

# Rule name -> failure condition over the measurements; its place in this list is its bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "100 * n_dup_lines > 35 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("digits", "100 * n_digits > 30 * word_chars"),
]
# Policy version -> the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeat_words"),
    "v1": ("few_words", "repeat_words", "symbols", "dup_lines"),
    "v2": tuple(name for name, _ in RULES),
}
CURRENT = "v2"


def mask(rules) -> int:
    """Bit mask of a set of rule names."""
    place = {name: i for i, (name, _) in enumerate(RULES)}
    return sum(1 << place[r] for r in set(rules))


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, each word once.

    Window hashes are sorted with their positions; equal neighbours mark repeated
    windows, and the union of [p, p + 3) over their sorted positions is summed gap by
    gap: n log n per document, no shuffle.
    """
    tri = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                      lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def cover(p: Column) -> Column:
        steps = F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def again(s: Column) -> Column:
        same = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), cover)

    def count(t: Column) -> Column:
        ranked = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) < F.size(t), let(ranked, again)).otherwise(F.lit(0))

    return F.when(F.size(w) > 3, let(tri, count)).otherwise(F.lit(0))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, bits) for every row of ``docs``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("doc_id", "text", words(F.col("text")).alias("w"),
                 F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0).alias("lines"))
    cut = lambda rx: F.length("text") - F.length(F.regexp_replace("text", rx, ""))
    d = d.select("doc_id", F.size("w").cast("long").alias("n_words"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 cut(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
                 F.size("lines").cast("long").alias("n_lines"), cut("[0-9]+").cast("long").alias("n_digits"))
    bits = sum((F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, cond) in enumerate(RULES)), F.lit(0))
    return d.withColumn("bits", bits.cast("long"))


def apply_policy(led: DataFrame, version: str = CURRENT, out: str = "kept") -> DataFrame:
    """Add ``out``: true where no rule of the policy failed."""
    return led.withColumn(out, F.col("bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0)


def ablation(led: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents failing it, failing only it (they come back without
    the rule), and the words those hold.  One aggregate by bit pattern, then bitwise tests."""
    m = mask(POLICIES[version])
    patterns = led.groupBy("bits").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                      for i, (n, _) in enumerate(RULES) if (m >> i) & 1])
    e = patterns.select("bits", "n", "words", F.inline(rules))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits").bitwiseAND(F.lit(m)) == F.col("bit")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return e.groupBy("rule").agg(zero(F.when(fails, F.col("n"))).alias("failed"),
                                 zero(F.when(alone, F.col("n"))).alias("only_this"),
                                 zero(F.when(alone, F.col("words"))).alias("words_back"))


def kept_documents(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass the policy, all columns as they were.

    The ledger is evaluated beside each row (no join), so repeated and null ids are safe.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    led = settled(apply_policy(ledger(whole, "row", "text"), version).select("doc_id", "kept"))
    return led.filter("kept").select("doc_id.*")
