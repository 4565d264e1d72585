"""Keyword layer for dictionaries of any size.

The small lexicons of ``keywords`` travel inside the plan and are tried one after another on every
text.  Here the dictionary is a table (kw_id, category, cat_order, keyword) and is met through an
inverted phrase index instead, with the same semantics: substrings of the normalised text, weights
by word count, a multiset keyed by ``kw_id``, and results per input row.

Index.  Each phrase is keyed by one of its character grams, of the largest size of ``SIZES`` that
fits into it; among those, by the gram that the fewest phrases of the dictionary hold.  A text that
contains the phrase contains that gram.  The keys also go into a bitmap of fixed size.

Texts are hashed gram by gram (64 bits, vectorised over code points in Arrow batches, linear in the
text, slices of bounded size), and only grams whose bit is set go on.  Every candidate is settled by
comparing the strings themselves, so collisions of the hash or the bitmap cost time and change no result.

Two physical forms give the same rows, chosen by the measured bytes of the index:

* up to ``BROADCAST_BYTES`` the index is sent once to every executor as sorted arrays; a gram found
  there names its phrases and where they would begin, and the text is compared in place.  Nothing
  but hits leaves the task, and with ``in_rows`` they stay in one record a text, so that K1-K5 need no shuffle;
* beyond, (row, hash) pairs are shuffled to the index in an equi-join and candidates back to the texts,
  which are written once and shuffled once; a hash that many texts emit is split by AQE's skew handling.

Nothing is capped: neither phrases, nor hits of a text, nor texts of a phrase.
Defined results: a null text has no hits; an empty phrase is in every text that is not null, as any
substring test has it; rows are told apart by position, so repeated rows keep their own results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.functions.text import keyword_weight, normalize_text
from textlens.operators.common import top_k_per_group
from textlens.operators.tfidf import gram_counts
from textlens.session import materialize

SIZES = (8, 6, 4, 3, 2, 1)       # characters in a gram, largest first
BITMAP_BITS = 23                 # 2^23 bits: 1 MB
BROADCAST_BYTES = 32 << 20       # an index up to here is broadcast
SLICE = 1_000_000                # code points hashed at a time
ROWS = 1_000                     # texts whose hits are held at a time
ENTRY = ["kw_id", "category", "cat_order", "keyword", "weight"]
EMPTY = 0                        # key of phrases without a character
_MULTIPLIER, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd 64-bit constants


# ---------------------------------------------------------------- grams

def _hashes(code, size: int):
    """64-bit hash of every run of ``size`` code points (a polynomial, mixed so that its high bits serve the bitmap)."""
    import numpy as np

    n = len(code) - size + 1
    h = np.full(n, size, "u8")
    for k in range(size):
        h = h * np.uint64(_MULTIPLIER) + code[k:k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def _in_bitmap(h, words):
    """Which hashes have their bit set; the bit's number is the hash's first ``BITMAP_BITS`` bits."""
    import numpy as np

    bit = h >> np.uint64(64 - BITMAP_BITS)
    return (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _lists(values):
    """Arrow list array of one list of longs a row."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, values)]).astype("i4")
    flat = np.concatenate(values) if values else np.empty(0, "i8")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view("i8")))


def _mapped(df: DataFrame, source: str, target: str, function, drop: bool = False) -> DataFrame:
    """``df`` with a column ``target`` of longs: ``function()`` applied to a batch's strings in ``source``,
    which stays unless ``drop`` is set."""
    keep = [f for f in df.schema.fields if not (drop and f.name == source)]
    names = [f.name for f in keep]

    def run(batches):
        import pyarrow as pa

        apply = function()
        for batch in batches:
            values = _lists(apply(batch.column(source).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), values], [*names, target])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return df.mapInArrow(run, f"{fields}, `{target}` array<bigint>")


def _phrase_grams(phrases: list[str]) -> list:
    """Of each phrase the hashes of its grams of the largest size that fits, in order; of an empty phrase ``EMPTY``."""
    import numpy as np

    out = []
    for p in phrases:
        size = next((s for s in SIZES if s <= len(p)), 0)
        code = np.frombuffer(p.encode("utf-32-le"), "<u4").astype("u8")
        out.append(_hashes(code, size) if size else np.full(1, EMPTY, "u8"))
    return out


def _text_grams(words, sizes):
    """Function from texts to their distinct hashes that are in the bitmap ``words``."""
    def emit(texts: list[str]) -> list:
        import numpy as np

        out = []
        for t in texts:
            found = [] if t is None or 0 not in sizes else [np.full(1, EMPTY, "u8")]
            code = np.frombuffer((t or "").encode("utf-32-le"), "<u4")
            for at in range(0, len(code), SLICE):
                part = code[at:at + SLICE + SIZES[0] - 1].astype("u8")
                for size in sizes:
                    if len(part) >= size > 0:
                        h = _hashes(part, size)
                        found.append(h[_in_bitmap(h, words)])
            out.append(np.unique(np.concatenate(found)) if found else np.empty(0, "u8"))
        return out

    return emit


class _Lookup:
    """The index as sorted arrays: texts -> the numbers of the phrases in them."""

    def __init__(self, table, words, sizes):
        import numpy as np

        order = np.argsort(table.column("h").to_numpy().view("u8"), kind="stable")
        self.table = table = table.take(order)
        self.words, self.sizes = words, [s for s in sizes if s]
        self.h = table.column("h").to_numpy().view("u8")
        self.at, self.kw_id = table.column("at").to_numpy(), table.column("kw_id").to_numpy().astype("i8")
        self.keywords = table.column("keyword").to_pylist()
        self.length = np.array([len(k) for k in self.keywords], "i8")
        self.empty = np.flatnonzero(self.length == 0).tolist()
        self.last = np.array([ord(k[-1]) if k else 0 for k in self.keywords], "u8")

    def candidates(self, part):
        """(place, phrase) for the grams of a run of code points: where the phrase would begin."""
        import numpy as np

        for size in self.sizes:
            if len(part) < size:
                continue
            h = _hashes(part, size)
            p = np.flatnonzero(_in_bitmap(h, self.words))
            lo, hi = np.searchsorted(self.h, h[p]), np.searchsorted(self.h, h[p], side="right")
            n = hi - lo
            place = np.repeat(p, n)
            phrase = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            yield place - self.at[phrase], phrase

    def places(self, text: str):
        """Places in the sorted arrays of the phrases in a text, in the order of their numbers."""
        import numpy as np

        code, keywords, out = np.frombuffer(text.encode("utf-32-le"), "<u4"), self.keywords, set(self.empty)
        for start in range(0, len(code), SLICE):
            for place, phrase in self.candidates(code[start:start + SLICE + SIZES[0] - 1].astype("u8")):
                place = place + start
                end = place + self.length[phrase]
                may = (place >= 0) & (end <= len(code)) & (self.length[phrase] > 0)
                may[may] = code[end[may] - 1] == self.last[phrase[may]]
                for i, j, k in zip(place[may].tolist(), end[may].tolist(), phrase[may].tolist()):
                    if k not in out and text[i:j] == keywords[k]:
                        out.add(k)
        at = np.array(sorted(out), "i8")
        return at[np.argsort(self.kw_id[at], kind="stable")]

    def found(self, text: str):
        return self.kw_id[self.places(text)]

    def __call__(self, texts: list) -> list:
        import numpy as np

        return [np.empty(0, "i8") if t is None else self.found(t) for t in texts]


# ---------------------------------------------------------------- index

@dataclass(frozen=True)
class PhraseIndex:
    """A dictionary made ready for texts.

    ``table`` is (h, at, kw_id, category, cat_order, keyword, weight), written once: the key gram, its
    place in the phrase, and the phrase.  The driver holds the
    bitmap, the gram sizes in use (0 for empty phrases), the category that comes first and the size of
    the table: nothing that grows.
    """

    table: DataFrame
    bitmap: object
    sizes: tuple[int, ...]
    first_category: str | None
    bytes: int
    squeezed: bool

    @classmethod
    def build(cls, dictionary: DataFrame, squeeze: bool = True) -> "PhraseIndex":
        """``dictionary`` is (kw_id, category, cat_order, keyword), ``kw_id`` unique and in dictionary order.

        ``squeeze``: phrases are trimmed and texts normalised (second generation); without it both are
        only lower-cased (first generation).
        """
        import numpy as np

        low = F.lower("keyword")
        phrases = dictionary.filter(F.col("keyword").isNotNull()).select(
            "kw_id", "category", "cat_order", (F.trim(low) if squeeze else low).alias("keyword"), keyword_weight(low).alias("weight"))
        grams = materialize(_mapped(phrases, "keyword", "grams", lambda: _phrase_grams), "phrase_grams")
        each = grams.select("kw_id", F.posexplode("grams").alias("at", "h"))
        held = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        rarest = each.join(held, "h").groupBy("kw_id").agg(F.min(F.struct("n", "h", "at")).alias("g")).select("kw_id", "g.h", "g.at")
        table = materialize(grams.drop("grams").join(rarest, "kw_id"), "phrase_index").select(
            "h", "at", "kw_id", "category", "cat_order", "keyword", "weight")

        bit = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
        words = (table.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITMAP_BITS}) & 63 as int))").alias("bit"))
                 .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())  # at most 2^BITMAP_BITS / 64 rows
        bitmap = np.zeros(1 << (BITMAP_BITS - 6), "i8")
        for r in words:
            bitmap[r["word"]] = r["bits"]
        length = F.char_length("keyword")
        size = F.coalesce(*[F.when(length >= s, F.lit(s)) for s in SIZES], F.lit(0))
        facts = table.agg(F.collect_set(size).alias("sizes"), F.sum(F.octet_length("keyword") + F.octet_length("category") + 64).alias("bytes")).first()
        first = phrases.agg(F.min_by("category", "cat_order")).first()[0]
        return cls(table, bitmap.view("u8"), tuple(sorted(facts["sizes"])), first, facts["bytes"] or 0, squeeze)


def _entries_in_rows(df: DataFrame, keep: list[str], index: PhraseIndex) -> DataFrame:
    """(keep..., _found ARRAY<STRUCT<kw_id, category, cat_order, keyword, weight>>) of (keep..., _norm), by ``kw_id``."""
    entry, words, sizes = ENTRY, index.bitmap, index.sizes
    sent = df.sparkSession.sparkContext.broadcast(index.table.select("h", "at", *entry).toArrow())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        lookup = _Lookup(sent.value, words, sizes)
        columns = [lookup.table.column(c).combine_chunks() for c in entry]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                at = [np.empty(0, "i8") if t is None else lookup.places(t) for t in part.column("_norm").to_pylist()]
                flat = pa.array(np.concatenate(at))
                found = pa.StructArray.from_arrays([c.take(flat) for c in columns], entry)
                ends = pa.array(np.cumsum([0, *map(len, at)]).astype("i4"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(ends, found)], [*keep, "_found"])

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    fields = ", ".join(f"{c}: {index.table.schema[c].dataType.simpleString()}" for c in entry)
    return df.mapInArrow(run, f"{kept}`_found` array<struct<{fields}>>")


def hits(df: DataFrame, text_col: str, index: PhraseIndex, keep: list[str], broadcast_bytes: int = BROADCAST_BYTES,
         in_rows: bool = False) -> DataFrame:
    """(_row, keep..., kw_id, category, cat_order, keyword, weight): every phrase in every row's text, and
    for every row one further record whose phrase columns are null, so that rows without hits stay.

    With ``in_rows`` an index that is broadcast gives one record a row instead, (keep..., _found): its phrases as
    an array in the order of ``kw_id``.  The texts are dealt to all cores first, since a table may come in few splits.
    """
    norm = normalize_text(F.col(text_col)) if index.squeezed else F.lower(F.col(text_col))
    entry = ENTRY
    words, sizes = index.bitmap, index.sizes
    if in_rows and index.bytes <= broadcast_bytes:
        spark = df.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = df.select(*keep, F.col(text_col).alias("_text")).repartition(parts)
        norm = normalize_text(F.col("_text")) if index.squeezed else F.lower(F.col("_text"))
        return _entries_in_rows(dealt.select(*keep, norm.alias("_norm")), keep, index)
    rows = df.select(F.monotonically_increasing_id().alias("_row"), *keep, norm.alias("_norm"))
    if index.bytes <= broadcast_bytes:
        sent = df.sparkSession.sparkContext.broadcast(index.table.select("h", "at", "kw_id", "keyword").toArrow())
        found = _mapped(rows, "_norm", "_kw", lambda: _Lookup(sent.value, words, sizes), drop=True)
        each = found.select("_row", *keep, F.explode(F.concat("_kw", F.array(F.lit(None).cast("long")))).alias("_id"))
        phrases = index.table.select(F.col("kw_id").cast("long").alias("_id"), *entry)
        return each.join(F.broadcast(phrases), "_id", "left").select("_row", *keep, *entry)
    # Row numbers are used twice, so they are written with their texts.
    emitted = materialize(_mapped(rows, "_norm", "_hashes", lambda: _text_grams(words, sizes)), "phrase_texts")
    pairs = emitted.select("_row", F.explode("_hashes").alias("h")).join(index.table, "h").select("_row", *entry)
    hit = (pairs.join(emitted.select("_row", *keep, "_norm"), "_row").filter(F.contains(F.col("_norm"), F.col("keyword")))
           .select("_row", *keep, *entry))
    none = [F.lit(None).cast(index.table.schema[c].dataType).alias(c) for c in entry]
    return hit.unionByName(emitted.select("_row", *keep, *none))


# ---------------------------------------------------------------- K1-K5 on hits

def _per_category(each) -> Column:
    """``each(category, its entries)`` for the distinct (category, cat_order) of a row's ``_found``."""
    kinds = F.array_distinct(F.transform("_found", lambda e: F.struct(e["category"].alias("category"), e["cat_order"].alias("cat_order"))))
    return F.transform(kinds, lambda k: each(k, F.filter("_found", lambda e: e["category"].eqNullSafe(k["category"]) & e["cat_order"].eqNullSafe(k["cat_order"]))))


def _weight(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0), lambda acc, e: (acc + e["weight"]).cast("int"))


def scores(found: DataFrame, keep: list[str]) -> DataFrame:
    """K1: (keep..., category, score, n_matches) of every row and category with a hit; summed in the row or map-side."""
    if "_found" in found.columns:
        per = _per_category(lambda k, es: F.struct(k["category"].alias("category"), _weight(es).alias("score"), F.size(es).alias("n_matches")))
        return found.select(*keep, F.inline(per))
    return (found.filter("kw_id IS NOT NULL").groupBy("_row", *keep, "category")
            .agg(F.sum("weight").cast("int").alias("score"), F.count(F.lit(1)).cast("int").alias("n_matches")).drop("_row"))


def best(found: DataFrame, keep: list[str], prefix: str = "kw_") -> DataFrame:
    """K2, K3: (keep..., category, score, matches) of every row; null category and no matches on a tie or without hits.

    One shuffle by row serves both groupings, none if the hits are in the row; the lists are the row's own matches.
    """
    if "_found" in found.columns:
        none = F.struct(F.lit(0).alias("score"), F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("matches"))
        per = _per_category(lambda k, es: F.struct(_weight(es).alias("score"), k["category"].alias("category"), F.transform(es, lambda e: e["keyword"]).alias("matches")))
        row = found.select(*keep, F.sort_array(F.concat(per, F.array(none)), asc=False).alias("c"))
        return _best_of(row, keep, prefix)
    per = (found.repartition("_row", *keep).groupBy("_row", *keep, "category")
           .agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("int").alias("score"),
                F.array_sort(F.collect_list(F.when(F.col("kw_id").isNotNull(), F.struct("kw_id", "keyword")))).alias("m")))
    named = F.struct(F.col("score"), F.col("category"), F.transform("m", lambda e: e["keyword"]).alias("matches"))
    return _best_of(per.groupBy("_row", *keep).agg(F.sort_array(F.collect_list(named), asc=False).alias("c")), keep, prefix)


def _best_of(row: DataFrame, keep: list[str], prefix: str) -> DataFrame:
    """From (keep..., c), the (score, category, matches) of each row from the highest down."""
    first, second = F.element_at("c", 1), F.try_element_at("c", F.lit(2))
    unique = (first["score"] > 0) & (F.coalesce(second["score"], F.lit(-1)) != first["score"])
    return row.select(*keep, F.when(unique, first["category"]).alias(f"{prefix}category"), first["score"].alias(f"{prefix}score"),
                      F.when(unique, first["matches"]).otherwise(F.array().cast("array<string>")).alias(f"{prefix}matches"))


def first_generation(found: DataFrame, keep: list[str], index: PhraseIndex, prefix: str = "kw1_") -> DataFrame:
    """K4: (keep..., category, score): the category with most hits, the first in dictionary order on ties and without hits."""
    if "_found" in found.columns:
        named = _per_category(lambda k, es: F.struct(F.size(es).alias("score"), (-k["cat_order"]).alias("neg"), k["category"].alias("category")))
        top = found.select(*keep, F.array_max(named).alias("t"))
        score = F.coalesce(F.col("t.score"), F.lit(0))
        return top.select(*keep, F.when(score > 0, F.col("t.category")).otherwise(F.lit(index.first_category)).alias(f"{prefix}category"),
                          score.alias(f"{prefix}score"))
    per = found.groupBy("_row", *keep, "category", "cat_order").agg(F.count("kw_id").cast("int").alias("score"))
    top = per.groupBy("_row", *keep).agg(F.max(F.struct("score", (-F.col("cat_order")).alias("neg"), "category")).alias("t"))
    return top.select(*keep, F.when(F.col("t.score") > 0, F.col("t.category")).otherwise(F.lit(index.first_category)).alias(f"{prefix}category"),
                      F.col("t.score").alias(f"{prefix}score"))


# ---------------------------------------------------------------- dictionaries drawn from labelled texts

def learned_dictionary(df: DataFrame, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """(kw_id, category, cat_order, keyword): per class its ``per_class`` most frequent two-word phrases.

    Counted where the texts are, summed by a partial aggregate and ranked by the salted top-k; ties go to the smaller phrase.
    """
    texts = df.filter(F.col(label_col).isNotNull()).select(F.col(label_col).alias("category"), text_col)
    counts = (gram_counts(texts, text_col, ["category"], "keyword", "n", unigrams=False, together=True)
              .groupBy("category", "keyword").agg(F.sum("n").alias("n")))
    # Of the histogram of counts: the count of a class's last phrase.  Rarer phrases are not sorted.
    above = Window.partitionBy("category").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = (counts.groupBy("category", "n").agg(F.count(F.lit(1)).alias("m"))
             .withColumn("above", F.coalesce(F.sum("m").over(above), F.lit(0))).filter(F.col("above") < per_class)
             .groupBy("category").agg(F.min("n").alias("least")))
    frequent = counts.join(F.broadcast(least), "category").filter(  # one row a class
        F.col("n") >= F.col("least")).drop("least")
    top = materialize(top_k_per_group(frequent, ["category"], [F.col("n").desc(), F.col("keyword").asc()], per_class, salt=F.xxhash64("keyword")),
                      "phrase_dictionary")
    labels = top.select("category").distinct().select("category", (F.dense_rank().over(Window.orderBy("category")) - 1).alias("cat_order"))
    return top.join(labels, "category").select((F.col("cat_order").cast("long") * per_class + F.col("rank") - 1).alias("kw_id"),
                                               "category", "cat_order", "keyword")
