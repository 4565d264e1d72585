"""Log analytics over a scored log (category, confidence, method, timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.text import preview


def log_summary(log: DataFrame, hybrid_marker: str = "hybrid") -> DataFrame:
    """A1, A3, A4 in one pass: total, mean of the percent confidences (each already
    rounded to 2 places), and the share of hybrid decisions in percent.  A2 (most
    common category) is ``top_category``."""
    # Each percent is rounded to 2 places first (as the reference shows them), kept
    # as an exact integer of 1/100 percent; the mean is one integer ratio, so it
    # is the same double in any engine (rounding the mean itself can hit exact halves).
    hundredths = F.round(F.col("confidence") * 10000.0).cast("long")
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("total"),
        (F.sum(hundredths) / (n * 100.0)).alias("avg_confidence_pct"),
        (F.count_if(F.contains(F.col("method"), F.lit(hybrid_marker))) * 100.0 / n).alias("hybrid_share_pct"))


def top_category(log: DataFrame) -> DataFrame:
    """A2: most common category (ties: smallest name). A top-1 report, so the limit is the feature."""
    return (log.filter(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("category").asc()).limit(1))


def recent_rows(log: DataFrame, n: int = 10, ts_col: str = "timestamp", id_col: str | None = None,
                text_col: str = "complaint") -> DataFrame:
    """Latest n rows by timestamp (ties: id), with a short text preview.
    Spark plans orderBy+limit as a per-partition top-n, never a full sort."""
    order = [F.col(ts_col).desc()] + ([F.col(id_col).asc()] if id_col else [])
    keep = ([id_col] if id_col else []) + [ts_col, "category", "confidence", "method"]
    return (log.orderBy(*order).limit(n)
            .select(*keep, preview(text_col).alias("preview"),
                    F.round(F.col("confidence") * 100.0, 2).alias("confidence_pct")))


def head(df: DataFrame, n: int = 5, order_col: str = "id") -> DataFrame:
    """First n rows in id order (a preview; the limit is the feature)."""
    return df.orderBy(order_col).limit(n)
