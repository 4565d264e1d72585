"""Helpers shared by the training-data operators: scans, words, regex spans with positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.functions.arrays import let

# Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPAN = "array<struct<start:int,end:int,hit:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one whole table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` as it is, computed once per row before anything that follows.

    Catalyst pushes a filter on computed columns below their projection and substitutes
    their expressions, also inside lambdas, where they would run once per array element.
    A filter on a generator's output stays above it.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null and blank texts."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, "[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def matches(text: Column, pattern: str | Column, gate: Column | None = None,
            keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches with positions, as array<struct<start,end,hit>>.

    Positions are code points, end exclusive.  They follow from the text between the
    matches (``split``) and the matches themselves, folded into running offsets; only
    texts that pass ``gate`` (a cheap necessary condition) and match at all pay for it.
    ``keep`` filters matches by their string after all of them were placed.
    """
    def place(hits: Column) -> Column:
        parts = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits,
                           lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("len"), h.alias("hit")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc, x):
            start = acc["at"] + x["gap"]
            return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), (start + x["len"]).alias("end"), x["hit"].alias("hit")))).alias("out"))

        return F.aggregate(parts, zero, step, lambda acc: acc["out"])

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), place)
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["hit"]))
    test = F.rlike(text, pattern) if gate is None else gate & F.rlike(text, pattern)
    return F.when(test, found).otherwise(F.array().cast(SPAN))


def replace_spans(text: Column, spans: Column) -> Column:
    """``text`` with every span (start, end, mark; sorted by start) replaced by its mark.

    A span that begins inside an earlier one adds no mark, but its own end still counts.
    """
    def cut(acc, s):
        before = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["mark"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], before).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
