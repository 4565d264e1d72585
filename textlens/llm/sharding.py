"""Sharding by extendible hashing.

A document hashes to 60 bits.  A bucket is a hash prefix; a bucket over the byte limit
splits on the next bit, the others stay, until every shard fits.  The splits are decided
on a histogram of cells (hash prefixes a few bits longer than the expected depth), never
on rows: the bytes of all prefixes of all cells are one small aggregate, and the shards
are the prefixes that fit while their parents do not.  Cells that are still too large
(several large documents in one cell) are opened again, they alone, with longer prefixes.

Rows move once, in ``write_shards``; assigning them only joins (cell -> shard) to (id,
hash, bytes).  The hash covers id and text, so repeated ids and null ids spread.  Nothing
but a total and a depth reaches the driver.

Defined results: a null text has 0 bytes; a document larger than the limit is a shard of
its own and marked ``oversize``; rows equal in id and text cannot be told apart by any
hash, and if they exceed the limit together their shard is marked ``oversize`` too; an
empty table gives no rows; a table within the limit is one shard with the empty prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.session import materialize

BITS = 60
AHEAD = 4   # cells are this many bits longer than a perfectly even split would need
MORE = 8    # bits added when a cell is opened again
LIMIT = 1 << 20


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, bytes): 60 hash bits of id and text, and the text's size."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), hash_bits(F.col(id_col), text).alias("h"),
                       F.octet_length(text).cast("long").alias("bytes"))


def hash_bits(key: Column, text: Column) -> Column:
    """The first 60 bits of md5('<id>:<md5 of the text>')."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: int):
    return F.shiftright(F.col("h"), BITS - depth)


def _plan(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth, shard_bytes, shard_docs): the shard of every cell, null if it does not fit at ``high``.

    ``cells`` has (cell, bytes, docs) with cells of ``high`` bits; depths from ``low`` on are tried.
    """
    each = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d"))
    each = each.withColumn("p", F.expr(f"shiftright(cell, {high} - d)"))
    sums = each.groupBy("d", "p").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    last = BITS == high
    fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") <= 1) | (F.lit(last) & (F.col("d") == high)))
    best = each.join(fits, ["d", "p"]).groupBy("cell").agg(
        F.min(F.struct("d", "shard_bytes", "shard_docs")).alias("s"))
    return cells.select("cell").join(best, "cell", "left").select("cell", F.col("s.d").alias("depth"),
                                                                  "s.shard_bytes", "s.shard_docs")


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, shard_docs, oversize) for every row of ``docs``.

    ``shard`` is the hash prefix as a string of 0 and 1, empty for a single shard.
    """
    rows = materialize(hashed(docs, id_col, text_col), "sharding_rows")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + AHEAD)
    done, rest = [], rows
    while True:
        cell = _prefix(high).alias("cell")
        cells = rest.groupBy(cell).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        plan = materialize(_plan(cells, low, high, limit), "sharding_cells")
        joined = rest.withColumn("cell", _prefix(high)).join(plan, "cell").drop("cell")
        done.append(joined.filter(F.col("depth").isNotNull()))
        if high == BITS or plan.filter("depth IS NULL").isEmpty():
            break
        rest = materialize(joined.filter(F.col("depth").isNull()).drop("depth", "shard_bytes", "shard_docs"), "sharding_rows")
        low, high = high + 1, min(BITS, high + MORE)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.lpad(F.conv(F.col("h").cast("string"), 10, 2), BITS, "0")
    return out.select("doc_id", "h", "bytes", F.substring(bits, F.lit(1), F.col("depth")).alias("shard"), F.col("depth").cast("int").alias("depth"),
                      "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversize"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write ``docs`` as one parquet folder per shard under ``path``, the text moving once.

    Rows meet their shard by hash; a shard holds at most ``limit`` bytes of text (or is
    marked oversize), so one task writes it.
    """
    shards = assign(docs, limit).select("h", "shard").distinct().withColumnRenamed("h", "_h")
    whole = docs.withColumn("_h", hash_bits(F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))))
    out = whole.join(shards.withColumnRenamed("shard", "_shard"), "_h").drop("_h")
    out.repartition("_shard").write.partitionBy("_shard").parquet(path)
