"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlens.llm.common import table


def op1_url_filter(spark, sf_dir):
    """Verdict of every page's URL."""
    from textlens.llm import url_filter as U
    rules = [U.Rule("net", "/", "block"), U.Rule("example.net", "/en/", "allow"),
             U.Rule("example.com", "/de/", "block"), U.Rule("org", "/fr/", "allow")]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return U.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict", "judged")


def op2_pii(spark, sf_dir):
    """Personal data of every document."""
    from textlens.llm import pii
    return pii.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality_rules(spark, sf_dir):
    """Ledger of every document and the current policy's verdict."""
    from textlens.llm import quality_rules as Q
    led = Q.apply_policy(Q.ledger(table(spark, sf_dir, "documents")))
    failed = F.col("bits").bitwiseAND(F.lit(Q.mask(Q.POLICIES["base"]))) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), "kept", "bits")


def op6_secret_scan(spark, sf_dir):
    from textlens.llm import secrets
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark, sf_dir):
    """Near-duplicate component of every document."""
    from textlens.llm import ngram_join
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_extendible_sharding(spark, sf_dir):
    """Shard of every document."""
    from textlens.llm import sharding
    return sharding.assign(table(spark, sf_dir, "documents")).drop("h")


def op9_decontamination(spark, sf_dir):
    """One row per document and benchmark item that it leaks."""
    from textlens.llm import decontaminate as D
    return D.contaminated(D.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_chat_format(spark, sf_dir):
    """Digest of all formatted conversations and of one that holds control strings."""
    from textlens.llm import chat_format as C
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    return C.digest(C.format_conversations(rows.unionByName(more)))


def op4_toxicity(spark, sf_dir):
    """Toxicity of every document, learned outside the held-out fold."""
    from textlens.llm import toxicity as X
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~X.held_out())
    s = X.score(docs, X.fit(docs, labels))
    return s.select("doc_id", X.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
                    F.size("passages").cast("long").alias("n_passages"))


def op5_best_fit_packing(spark, sf_dir):
    """Every piece of every document with its place in a training sequence."""
    import public_tokenizers
    from textlens.llm import packing
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_sentencepiece(spark, sf_dir):
    """Digests of every document's ids and of their decoded text."""
    import public_tokenizers
    from textlens.llm import piece_table as S
    out = S.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", S.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_importance_resampling(spark, sf_dir):
    """Weight, score and rank of every document in a draw towards the benchmark's texts."""
    from textlens.llm import importance
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_spelling_variants(spark, sf_dir):
    """Form and root of every word of the documents' vocabulary."""
    from textlens.llm import spelling
    return spelling.group_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_pii, op3_quality_rules, op4_toxicity, op5_best_fit_packing, op6_secret_scan, op7_ngram_jaccard,
    op8_extendible_sharding, op9_decontamination, op10_chat_format, op11_sentencepiece, op12_importance_resampling,
    op13_spelling_variants)}
