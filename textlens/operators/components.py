"""Connected components of an edge table by large-star / small-star
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Each round is two groupBy-and-emit passes over the edge list; the number of
rounds is logarithmic in practice, and the loop stops when a round leaves the
edge set unchanged (a scalar count per round).  Edges are checkpointed into the
shared ``spark.checkpoint.dir`` every round, so lineage stays one round deep and
a lost executor recomputes at most one round.  Labels are the smallest vertex
id of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.session import checkpoint_dir

MAX_ROUNDS = 100


def _norm(e: DataFrame) -> DataFrame:
    """Undirected edge set as (a, b) with a > b, no loops, no repeats."""
    return (e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct())


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    d = _both(e)
    m = d.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _norm(d.filter(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    d = _both(e).filter(F.col("v") < F.col("u"))
    m = d.groupBy("u").agg(F.min("v").alias("m"))
    j = d.join(m, "u")
    return _norm(j.select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .unionByName(m.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def components(vertices: DataFrame, edges: DataFrame, vertex_col: str = "id") -> DataFrame:
    """(vertex, group_id) for every vertex; vertices without edges are their own group.

    ``edges`` has columns (a, b) (undirected; any orientation).
    """
    spark = edges.sparkSession
    checkpoint_dir(spark)
    e = _norm(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).checkpoint()
    n = e.count()
    for _ in range(MAX_ROUNDS):
        nxt = _small_star(_large_star(e)).checkpoint()
        n_next = nxt.count()
        changed = n_next != n or nxt.exceptAll(e).limit(1).count() > 0
        e, n = nxt, n_next
        if not changed:
            break
    else:
        raise RuntimeError(f"connected components did not converge in {MAX_ROUNDS} rounds")
    # converged: every component is a star around its smallest vertex
    label = _both(e).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("group_id"))
    return (vertices.select(F.col(vertex_col).cast("long").alias(vertex_col))
            .join(label.withColumnRenamed("u", vertex_col), vertex_col, "left")
            .select(vertex_col, F.coalesce(F.col("group_id"), F.col(vertex_col)).alias("group_id")))
