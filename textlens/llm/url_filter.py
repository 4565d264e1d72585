"""URL filter: host and path rules, and gradient-boosted trees for URLs without a rule.

The trees see lexical features only: lengths, depth, digit ratio, entropy of the host,
parameter counts, and suffix statistics (how often labelled URLs with the same top-level
label, the same last two host labels, or the same first path segment were blocked).
Suffix statistics cover all labelled URLs; they are kept in ``BUCKETS`` hash buckets, so
their size is fixed.  The trees are fitted on a bounded sample of at most about
``MAX_LABELLED`` labelled URLs, chosen by a hash of the URL.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule, and is judged by the trees like any other; repeated rows are judged alike; if the
labels hold one class only, that class is the verdict of every other URL, and without any
label the verdict is allow.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import ascii_lower
from textlens.session import materialize

MAX_LABELLED = 20_000
BUCKETS = 1024
SUFFIXES = ["top", "domain", "segment"]
NUMBERS = ["url_len", "host_len", "path_len", "depth", "digits", "entropy", "params", "labels", "hyphens", "fragment"]
TREES = dict(maxIter=12, maxDepth=4, stepSize=0.3, maxBins=32, seed=7)


@dataclass(frozen=True)
class Rule:
    """``action`` (block or allow) for a host, its subdomains, and paths that start with ``path``."""
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add host, path, rule and ruled (the longest fitting rule's name and action, else null)."""
    host, path = split_url(F.col("url"))
    d = pages.withColumns({"host": host, "path": path})
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        name, action = F.when(fits, r.name).otherwise(name), F.when(fits, r.action).otherwise(action)
    return d.withColumns({"rule": name, "ruled": action})


def lexical(d: DataFrame) -> DataFrame:
    """Add the numeric features and the three suffix buckets; needs url, host and path."""
    url = F.coalesce("url", F.lit(""))
    many = lambda c, ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    seen = F.filter(F.array_distinct(F.split("host", "")), lambda c: F.length(c) > 0)
    share = lambda c: (F.length("host") - F.length(F.replace(F.col("host"), c, F.lit("")))) / F.length("host")
    entropy = F.aggregate(seen, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    digits = F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    return d.withColumns({
        "url_len": F.length(url), "host_len": F.length("host"), "path_len": F.length("path"),
        "depth": many(F.col("path"), "/"), "digits": F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0),
        "entropy": entropy, "params": many(url, "&") + F.contains(url, F.lit("?")).cast("int"),
        "labels": many(F.col("host"), "."), "hyphens": many(F.col("host"), "-"),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "top": bucket(F.substring_index("host", ".", -1)), "domain": bucket(F.substring_index("host", ".", -2)),
        "segment": bucket(F.regexp_extract("path", "^/([^/]*)", 1))})


class UrlModel:
    """Fitted filter: suffix statistics, and trees or a single verdict."""

    def __init__(self, rates: dict[str, list[float]], trees, only: str | None):
        self.rates, self.trees, self.only = rates, trees, only

    def vectors(self, d: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        def rate(s: str) -> Column:
            known = F.split(F.lit(",".join(map(repr, self.rates[s]))), ",").cast("array<double>")
            return F.get(known, F.col(s))

        d = lexical(d).withColumns({f"{s}_rate": rate(s) for s in SUFFIXES})
        return VectorAssembler(inputCols=[*NUMBERS, *(f"{s}_rate" for s in SUFFIXES)], outputCol="_features").transform(d)

    def verdict(self, d: DataFrame) -> DataFrame:
        """Add ``judged`` (block or allow); needs url, host and path."""
        if self.trees is None:
            return d.withColumn("judged", F.lit(self.only))
        names = d.columns
        return self.trees.transform(self.vectors(d)).select(
            *names, F.when(F.col("_verdict") > 0.5, "block").otherwise("allow").alias("judged"))


def fit(labelled: DataFrame, bound: int = MAX_LABELLED) -> UrlModel:
    """Train from labelled URLs: ``labelled`` has url, host, path and ``label`` (1 block, 0 allow)."""
    each = lexical(labelled).select(F.col("label").cast("double").alias("label"), F.explode(F.array(
        F.struct(F.lit("").alias("s"), F.lit(0).alias("b")),
        *[F.struct(F.lit(s).alias("s"), F.col(s).alias("b")) for s in SUFFIXES])).alias("x"))
    rows = each.groupBy("x.s", "x.b").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).collect()  # 3 * BUCKETS + 1 at most
    total = next(((r["n"], r["k"]) for r in rows if r["s"] == ""), (0, 0))
    if not 0 < total[1] < total[0]:
        return UrlModel({}, None, "block" if total[0] and total[1] else "allow")
    prior = total[1] / total[0]
    odds = lambda n, k: math.log((k + 4 * prior) / (n - k + 4 * (1 - prior)))
    rates = {s: [odds(0, 0)] * BUCKETS for s in SUFFIXES}
    for r in rows:
        if r["s"]:
            rates[r["s"]][r["b"]] = odds(r["n"], r["k"])
    if total[0] > bound:
        labelled = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 40)) < int((1 << 40) * bound / total[0]))
    from pyspark.ml.classification import GBTClassifier

    model = UrlModel(rates, None, None)
    sample = materialize(labelled.select("url", "host", "path", "label"), "url_sample")
    gbt = GBTClassifier(labelCol="label", featuresCol="_features", predictionCol="_verdict", **TREES)
    model.trees = gbt.fit(model.vectors(sample).select("_features", F.col("label").cast("double").alias("label")))
    return model


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` with host, path, rule and verdict; the rules' own URLs are the training labels."""
    d = with_rule(pages, rules)
    labelled = d.filter("ruled IS NOT NULL").select("url", "host", "path", (F.col("ruled") == "block").cast("int").alias("label"))
    out = fit(labelled).verdict(d)
    return out.withColumn("verdict", F.coalesce("ruled", "judged")).drop("ruled")
