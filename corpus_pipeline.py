"""Corpus pipeline: documents -> quality rules -> one of each near-duplicate group -> no benchmark
leaks -> no secrets -> packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents`` (and any extra ones they were given).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlens.llm import decontaminate, ngram_join, packing, quality_rules, secrets
from textlens.llm.common import table
from textlens.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current rule policy; the others go."""
    return quality_rules.kept_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_per_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; the others go, told apart by doc_id and text."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark, ``n_chars`` brought up to date."""
    from pyspark.sql import functions as F

    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", deduplicate), ("decontamination", decontaminated),
          ("secret_scan", without_secrets), ("best_fit_packing", pack)]
# The last stage tokenises, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline_{name}")
    return docs
