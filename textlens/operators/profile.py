"""Profiling aggregates.

Each function is one pass (or one pass plus a small second aggregate) with
map-side partial aggregation, so a hot key collapses to one row per map task
before any shuffle.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.functions.text import clean_text, detect_script


def shape(df: DataFrame) -> DataFrame:
    """Row count, column count and per-column non-null counts in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count(F.col(c)).alias(f"nonnull_{c}") for c in df.columns]
    return df.agg(*aggs).withColumn("n_cols", F.lit(len(df.columns)))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count, non_null) for every column, one scan, unpivoted with stack."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(cols)],
                  F.count(F.lit(1)).alias("_rows"))
    pairs = ", ".join(f"'{c}', n_{i}" for i, c in enumerate(cols))
    return (wide.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, null_count)", "_rows")
            .select("column_name", F.col("null_count").cast("long").alias("null_count"),
                    (F.col("_rows") - F.col("null_count")).cast("long").alias("non_null")))


def duplicate_counts(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """P3/P4/P5 in long form (metric, value): rows, duplicate rows (every copy after the
    first, nulls equal), duplicate texts, duplicate (text, label) pairs, distinct texts.

    One scan and one chain of aggregates from the finest key to the coarsest
    (all columns -> (text, label) -> text -> total), each partial per map task.
    Texts are keyed by their SHA-256 (32 bytes) rather than shuffled whole.
    """
    others = [c for c in df.columns if c not in (text_col, label_col)]
    h = F.sha2(F.col(text_col), 256).alias("_h")
    rows = df.groupBy(h, F.col(label_col), *others).agg(F.count(F.lit(1)).alias("c1"))
    pairs = rows.groupBy("_h", label_col).agg(F.sum("c1").alias("c2"), F.sum(F.col("c1") - 1).alias("d_rows"))
    texts = pairs.groupBy("_h").agg(F.sum("c2").alias("c3"), F.sum("d_rows").alias("d_rows"),
                                    F.sum(F.col("c2") - 1).alias("d_tl"))
    total = texts.agg(F.sum("c3").alias("n_rows"), F.sum("d_rows").alias("dup_rows"),
                      F.sum(F.col("c3") - 1).alias("dup_texts"), F.sum("d_tl").alias("dup_text_label"),
                      F.count_if(F.col("_h").isNotNull()).alias("distinct_texts"))
    cols = ["n_rows", "dup_rows", "dup_texts", "distinct_texts", "dup_text_label"]
    pairs_sql = ", ".join(f"'{c}', cast(coalesce({c}, 0) as bigint)" for c in cols)
    return total.selectExpr(f"stack({len(cols)}, {pairs_sql}) as (metric, value)")


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """P5: distinct non-null values (exact, or HyperLogLog++ when approx)."""
    f = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(f.alias(f"distinct_{col}"))


def distribution(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Value counts (nulls dropped) with share of the non-null total.

    Meant for label-like columns (categories, scripts, methods): the share uses a
    window over the counts table, one row per distinct value.
    """
    name = out_col or col
    counts = (df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias(name))
              .agg(F.count(F.lit(1)).alias("n")))
    # counts has one row per distinct value, so a global window over it is bounded
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share_pct", F.round(F.col("n") * 100.0 / total, 4))


def integer_summary(df: DataFrame, value: Column, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample std, min, linear-interpolated quartiles, max of an
    integer-valued column, exact.

    Everything is derived from the value histogram (one row per distinct value,
    bounded by the value range, not the row count), so no task ever holds all
    values and the global windows below run over that small table only.
    """
    hist = (df.select(value.cast("long").alias("v")).filter(F.col("v").isNotNull())
            .groupBy("v").agg(F.count(F.lit(1)).alias("c")))
    everything = Window.partitionBy()
    h = (hist.withColumn("cum", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("n", F.sum("c").over(everything))
         .withColumn("mean", F.sum(F.col("v") * F.col("c")).over(everything) / F.col("n")))
    aggs = [F.first("n").alias("count"), F.first("mean").alias("mean"),
            F.sqrt(F.sum(F.col("c") * (F.col("v") - F.col("mean")) ** 2) / (F.first("n") - 1)).alias("std"),
            F.min("v").alias("min")]
    for p in probs:
        pos = (F.col("n") - 1) * F.lit(p)
        lo = F.min(F.when(F.col("cum") > F.floor(pos), F.col("v")))
        hi = F.min(F.when(F.col("cum") > F.ceil(pos), F.col("v")))
        frac = F.first(pos - F.floor(pos))
        aggs.append((lo + (hi - lo) * frac).alias(f"q{int(round(p * 100))}"))
    aggs.append(F.max("v").alias("max"))
    return h.agg(*aggs)


def label_conflicts(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Texts that carry more than one label, and the rows holding them."""
    # Texts travel as hashes; two labels differ exactly if the smallest and the largest do.
    per_text = df.select(F.sha2(text_col, 256).alias("h"), F.col(label_col).alias("v")).groupBy("h").agg(
        F.min("v").alias("a"), F.max("v").alias("b"), F.count(F.lit(1)).alias("n_rows"))
    bad = per_text.filter(F.col("a") != F.col("b"))
    return bad.agg(F.count(F.lit(1)).alias("conflicting_texts"),
                   F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("rows_in_conflict"))


def empty_after_cleaning(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text is empty after F1."""
    return df.agg(F.count_if(clean_text(text_col) == "").alias("empty_after_clean"))


def script_distribution(df: DataFrame, text_col: str) -> DataFrame:
    """P10: P6 over F4."""
    return distribution(df.select(detect_script(text_col).alias("script")), "script")


# ---------------------------------------------------------------- P7 for any numeric column

SELECT_BUCKETS = 1024  # ranges that a round splits the values between two bounds into


def _buckets(values: DataFrame, ranges: list[tuple[int, float, float]], curved: bool) -> dict:
    """{range number: [(bucket, count, least, largest)]} of ``values`` (c, x); at most ``SELECT_BUCKETS`` a range.

    ``curved``: the ranges are equal on a logarithmic scale of either sign, over fifteen powers of ten.
    """
    def unit(lo, hi):
        most = max(abs(lo), abs(hi))
        return most * 1e-15 if most > 1e-290 else most

    table = F.array(*[F.struct(F.lit(i).alias("r"), F.lit(c).alias("c"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(unit(lo, hi)).alias("m"))
                      for i, (c, lo, hi) in enumerate(ranges)])

    def scale(name):
        x = F.col(name)
        return F.signum(x) * F.log1p(F.abs(x) / F.col("m")) if curved else x / 2  # halves: a width cannot overflow

    mine = F.filter(table, lambda t: (t["c"] == F.col("c")) & (t["lo"] <= F.col("x")) & (F.col("x") <= t["hi"]))
    # The bounds go to the first and the last range, so every round parts them.
    share = F.try_divide(scale("x") - scale("lo"), scale("hi") - scale("lo"))
    inner = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * SELECT_BUCKETS), F.lit(SELECT_BUCKETS - 1))
    each = values.select("x", F.inline(mine)).select("r", "x", F.when(F.col("x") == F.col("hi"), SELECT_BUCKETS - 1).otherwise(inner).alias("b"))
    out: dict = {}
    for r in each.groupBy("r", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        out.setdefault(r["r"], []).append((r["b"], r["n"], r["lo"], r["hi"]))
    return {k: sorted(v) for k, v in out.items()}


def select_ranks(values: DataFrame, ranks: dict[tuple[int, int], tuple[float, float]]) -> dict[tuple[int, int], float]:
    """Exact order statistics of ``values`` (c, x), by refinement of the value range.

    ``ranks`` maps (column number, rank from 0) to bounds of the column.  A round counts the values between
    the bounds in equal ranges (a partial aggregate, no sort, no window), and goes on inside the range
    that holds the rank, between the least and the largest value there.  It ends where these are equal, so
    a value that a third of the rows have ends at once; where at most ``SELECT_BUCKETS`` values
    are left, they are fetched and sorted.  Rounds of equal and of logarithmic ranges alternate, so values of
    very different size take few.  All columns and ranks share the rounds.
    """
    open_ = {k: (lo, hi, 0) for k, (lo, hi) in ranks.items()}
    found, curved = {k: lo for k, (lo, hi, _) in open_.items() if lo == hi}, False
    while len(found) < len(open_):
        todo = {k: v for k, v in open_.items() if k not in found}
        ranges = sorted({(k[0], lo, hi) for k, (lo, hi, _) in todo.items()})
        got, curved = _buckets(values, ranges, curved), not curved
        few = {}
        for k, (lo, hi, below) in todo.items():
            for _, n, least, largest in got[ranges.index((k[0], lo, hi))]:
                if k[1] < below + n:
                    open_[k] = (least, largest, below)
                    if least == largest:
                        found[k] = least
                    elif n <= SELECT_BUCKETS:
                        few[k] = (least, largest, below)
                    break
                below += n
        if few:
            spans = sorted({(k[0], lo, hi) for k, (lo, hi, _) in few.items()})
            inside = [(F.col("c") == c) & F.col("x").between(lo, hi) for c, lo, hi in spans]
            rows = values.filter(functools.reduce(lambda a, b: a | b, inside)).collect()  # at most SELECT_BUCKETS a span
            for k, (lo, hi, below) in few.items():
                own = sorted(r["x"] for r in rows if r["c"] == k[0] and lo <= r["x"] <= hi)
                found[k] = own[k[1] - below]
    return found


def numeric_summary(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column_name, count, mean, std, min, q25, q50, q75, max) of numeric columns of any type; exact quartiles,
    interpolated between neighbours.

    Nulls and NaN are not counted; a column without values has nulls, its count is 0; std needs two values.
    The driver holds a few numbers a column.
    """
    def value(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    aggs = [f(value(c)) for c in columns for f in (F.count, F.avg, F.stddev_samp, F.min, F.max)]
    flat = list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first())
    facts = [flat[5 * i:5 * i + 5] for i in range(len(columns))]
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), value(c).alias("x")) for i, c in enumerate(columns)])).alias("v"))
    values = values.select("v.c", "v.x").filter("x IS NOT NULL")
    places = {(i, q): q * (f[0] - 1) for i, f in enumerate(facts) if f[0] for q in quantiles}
    ranks = {(i, int(r)): (facts[i][3], facts[i][4]) for (i, _), at in places.items() for r in (math.floor(at), math.ceil(at))}
    found = select_ranks(values, ranks) if ranks else {}
    rows = []
    for i, (c, (n, mean, std, low, high)) in enumerate(zip(columns, facts)):
        cuts = []
        for q in quantiles:
            at = places.get((i, q))
            if at is None:
                cuts.append(None)
                continue
            a, b = found[i, math.floor(at)], found[i, math.ceil(at)]
            cuts.append(a + (b - a) * (at - math.floor(at)))
        rows.append((c, n, mean, std, low, *cuts, high))
    names = [f"q{round(100 * q)}" for q in quantiles]
    schema = "column_name string, count long, mean double, std double, min double, " + ", ".join(f"{x} double" for x in names) + ", max double"
    return df.sparkSession.createDataFrame(rows, schema)


# ---------------------------------------------------------------- P5, approximate and mergeable

HLL_BITS = 12  # 2^12 registers: a standard error of about 1.6 %


def distinct_sketches(df: DataFrame, col: str, by: list[str], bits: int = HLL_BITS) -> DataFrame:
    """(by..., n, sketch): rows and a HyperLogLog sketch of the distinct values of each group, to be stored.

    A partial aggregate; a sketch has a fixed size, so a group of any size is one small row.  Nulls do not count.
    """
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(col, F.lit(bits)).alias("sketch"))


def distinct_of_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, approx_distinct) of the union of stored sketches, without the rows they came from."""
    return sketches.groupBy(*(by or [])).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"))
