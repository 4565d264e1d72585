"""Keyword dictionary source.

A lexicon is an ordered multiset of (category, phrase): order and repeats both
matter (matches are listed in dictionary order; a repeated phrase counts twice).
It is small and bounded by construction, so it travels as a literal array in
the plan (or as a broadcast table) and never needs a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bound on phrases carried inline in a plan; above it use the broadcast-join path.
MAX_INLINE_PHRASES = 5000

LEXICON_SCHEMA = T.StructType([
    T.StructField("kw_id", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("keyword", T.StringType()),
])


@dataclass(frozen=True)
class Lexicon:
    """Ordered (category, phrase) entries; categories keep first-seen order."""

    entries: tuple[tuple[str, str], ...]

    @classmethod
    def from_mapping(cls, mapping: dict[str, list[str]]) -> "Lexicon":
        return cls(tuple((cat, kw) for cat, kws in mapping.items() for kw in kws))

    @classmethod
    def from_json(cls, path: str) -> "Lexicon":
        with open(path, encoding="utf-8") as fh:
            return cls.from_mapping(json.load(fh))

    @property
    def categories(self) -> list[str]:
        seen: list[str] = []
        for cat, _ in self.entries:
            if cat not in seen:
                seen.append(cat)
        return seen

    def rows(self) -> list[tuple[int, str, str]]:
        """(kw_id, category, keyword) with kw_id in dictionary order."""
        return [(i, cat, kw) for i, (cat, kw) in enumerate(self.entries)]

    def __len__(self) -> int:
        return len(self.entries)


def lexicon_frame(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """The lexicon as a small DataFrame (kw_id, category, cat_order, keyword)."""
    order = {c: i for i, c in enumerate(lexicon.categories)}
    rows = [(i, cat, order[cat], kw) for i, cat, kw in lexicon.rows()]
    schema = "kw_id INT, category STRING, cat_order INT, keyword STRING"
    return spark.createDataFrame(rows, schema)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file ``{category: [phrase, ...], ...}`` as a table (kw_id, category, cat_order, keyword).

    Read by Spark, so the path may be in any store; order and repeats are kept.  One file is one JSON
    value and so one task, which only unfolds it; a dictionary that outgrows this belongs in a table
    of the same columns.
    """
    groups = F.map_entries(F.from_json("value", "map<string,array<string>>"))
    entries = F.flatten(F.transform(groups, lambda g, i: F.transform(g["value"], lambda k: F.struct(
        g["key"].alias("category"), i.cast("int").alias("cat_order"), k.alias("keyword")))))
    each = spark.read.text(path, wholetext=True).select(F.posexplode(entries).alias("kw_id", "e"))
    return each.select("kw_id", "e.category", "e.cat_order", "e.keyword")


def lexicon_literal(lexicon: Lexicon, lower: bool = True):
    """The lexicon as one literal ARRAY<STRUCT<kw_id, category, cat_order, keyword, weight>>.

    Size-checked: a plan may only carry a bounded dictionary inline.
    """
    if len(lexicon) > MAX_INLINE_PHRASES:
        raise ValueError(f"lexicon has {len(lexicon)} phrases > {MAX_INLINE_PHRASES}; use the join path")
    order = {c: i for i, c in enumerate(lexicon.categories)}
    items = []
    for i, cat, kw in lexicon.rows():
        k = kw.lower().strip() if lower else kw
        words = len(k.split())
        weight = 3 if words >= 3 else (2 if words == 2 else 1)
        items.append(F.struct(F.lit(i).alias("kw_id"), F.lit(cat).alias("category"),
                              F.lit(order[cat]).alias("cat_order"), F.lit(k).alias("keyword"),
                              F.lit(weight).alias("weight")))
    return F.array(*items)
