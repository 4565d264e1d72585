"""Array functions over class-probability vectors.

Probabilities are ARRAY<DOUBLE> in label-id order; everything here is a
higher-order function evaluated per row (interpreted, on the JVM), no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value, body):
    """Per-row let-binding: evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst freely inlines a computed column into a lambda that reads it, which
    re-evaluates it for every array element.  A one-step fold whose start value
    is ``value`` pins it to a single evaluation per row.
    """
    return F.aggregate(F.array(F.lit(0)), _c(value), lambda acc, _x: acc, body)


def softmax(logits, temperature: float = 1.0) -> Column:
    """M1: numerically stable softmax of an array of logits (each value read once)."""
    scaled = F.transform(_c(logits), lambda v: v.cast("double") / F.lit(float(temperature)))

    def body(s):
        return let(F.array_max(s), lambda mx: let(
            F.transform(s, lambda v: F.exp(v - mx)),
            lambda e: let(F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v),
                          lambda total: F.transform(e, lambda v: v / total))))

    return let(scaled, body)


def argmax(probs) -> Column:
    """M2: 0-based index of the largest value; lowest index on ties."""
    return let(probs, lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def top_k(probs, k: int = 3) -> Column:
    """M3: first k (label_id, prob) structs by prob desc, label_id asc."""
    def body(p):
        idx = F.sequence(F.lit(0), F.size(p) - 1)
        pairs = F.transform(idx, lambda i: F.struct(i.cast("int").alias("label_id"),
                                                    F.element_at(p, i + 1).alias("prob")))
        ordered = F.array_sort(
            pairs,
            lambda a, b: F.when(a["prob"] > b["prob"], -1).when(a["prob"] < b["prob"], 1)
            .when(a["label_id"] < b["label_id"], -1).when(a["label_id"] > b["label_id"], 1).otherwise(0),
        )
        return F.slice(ordered, 1, k)

    return let(probs, body)


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)
