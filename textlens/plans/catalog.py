"""Registered queries: each maps (spark, sf_dir) -> DataFrame over the driver tables.

Stand-ins for the reference's data (SURVEY 7.2): ``documents`` is the labelled
text table with category := ``lang``; ``embeddings`` joined to ``documents`` on
``doc_id = vec_id`` is the hybrid-scoring task; ``events`` is the scored log.
Every query reads whole tables and whole texts.  Floating outputs are rounded
to 6 places so that they hash equally to their DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.functions.text import (char_length, clean_text, detect_script, join_list, normalize_text)
from textlens.operators import keywords as K
from textlens.operators import metrics as E
from textlens.operators import profile as P
from textlens.plans.lexicons import LANG_LEXICON, LANG_LEXICON_V1
from textlens.sources.tables import read_table

R = 6  # rounding digits of floating outputs


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = spark.conf.get("textlens.scan.partitions", None)
    return read_table(spark, sf_dir, "documents", int(hint) if hint else None)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled text table: (id, text, category)."""
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("category"))


def _round(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.round(F.col(c), R).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- profiling

def q_null_counts(spark, sf_dir):
    return P.null_counts(docs(spark, sf_dir))


def q_duplicate_counts(spark, sf_dir):
    d = labelled(spark, sf_dir)
    return P.duplicate_counts(d, "text", "category")


def q_label_conflicts(spark, sf_dir):
    return P.label_conflicts(labelled(spark, sf_dir), "text", "category")


def q_category_distribution(spark, sf_dir):
    return P.distribution(labelled(spark, sf_dir), "category")


def q_length_summary(spark, sf_dir):
    out = P.integer_summary(labelled(spark, sf_dir), char_length("text"))
    return _round(out, ["mean", "std", "q25", "q50", "q75"])


def q_clean_text(spark, sf_dir):
    d = labelled(spark, sf_dir)
    c = clean_text("text")
    return d.select("id", c.alias("clean_text"), normalize_text("text").alias("norm_text"),
                    char_length("text").alias("text_length"), char_length(c).alias("clean_length"),
                    (c != F.col("text")).alias("changed"), (c == F.lit("")).alias("is_empty"))


def q_script_distribution(spark, sf_dir):
    return P.script_distribution(labelled(spark, sf_dir), "text")


def q_label_encode(spark, sf_dir):
    from textlens.operators.models import label_index
    d = labelled(spark, sf_dir)
    return label_index(d, "category").select("id", "category", "label_id")


# ---------------------------------------------------------------- keyword layer

def keyword_predictions(spark, sf_dir) -> DataFrame:
    d = labelled(spark, sf_dir)
    return K.with_keyword_result(d, "text", LANG_LEXICON)


def q_keyword_scores(spark, sf_dir):
    return K.keyword_scores(labelled(spark, sf_dir), "id", "text", LANG_LEXICON)


def q_keyword_best(spark, sf_dir):
    out = keyword_predictions(spark, sf_dir)
    return out.select("id", "kw_category", "kw_score", join_list("kw_matches").alias("kw_matches"))


def q_keyword_matches(spark, sf_dir):
    d = labelled(spark, sf_dir)
    hits = d.select("id", F.explode(K.keyword_hits(F.col("text"), LANG_LEXICON)).alias("h"))
    return hits.select("id", F.col("h.kw_id").alias("kw_id"), F.col("h.category").alias("category"),
                       F.col("h.keyword").alias("keyword"), F.col("h.weight").alias("weight"))


def q_keyword_v1(spark, sf_dir):
    d = labelled(spark, sf_dir)
    return K.with_first_generation(d, "text", LANG_LEXICON_V1).select("id", "kw1_category", "kw1_score")


def q_class_top_terms(spark, sf_dir):
    return K.class_top_terms(labelled(spark, sf_dir), "text", "category", k=15)


# ---------------------------------------------------------------- evaluation of the keyword classifier

def q_accuracy_macro(spark, sf_dir):
    out = keyword_predictions(spark, sf_dir)
    return _round(E.summary(out, "category", "kw_category"), ["accuracy", "precision", "recall", "macro_f1"])


def q_class_report(spark, sf_dir):
    out = keyword_predictions(spark, sf_dir)
    return _round(E.class_report(out, "category", "kw_category"), ["precision", "recall", "f1"])


def q_confusion_matrix(spark, sf_dir):
    out = keyword_predictions(spark, sf_dir).withColumn(
        "pred", F.coalesce(F.col("kw_category"), F.lit("none")))
    return E.confusion_matrix(out, "category", "pred")


def q_error_rows(spark, sf_dir):
    out = keyword_predictions(spark, sf_dir)
    return E.error_rows(out, "category", "kw_category",
                        ["id", F.col("category").alias("actual"), F.col("kw_category").alias("predicted"),
                         "kw_score"])


QUERIES = {
    "null_counts": q_null_counts,
    "duplicate_counts": q_duplicate_counts,
    "label_conflicts": q_label_conflicts,
    "category_distribution": q_category_distribution,
    "length_summary": q_length_summary,
    "clean_text": q_clean_text,
    "script_distribution": q_script_distribution,
    "label_encode": q_label_encode,
    "keyword_scores": q_keyword_scores,
    "keyword_best": q_keyword_best,
    "keyword_matches": q_keyword_matches,
    "keyword_v1": q_keyword_v1,
    "class_top_terms": q_class_top_terms,
    "accuracy_macro": q_accuracy_macro,
    "class_report": q_class_report,
    "confusion_matrix": q_confusion_matrix,
    "error_rows": q_error_rows,
}


# ---------------------------------------------------------------- TF-IDF, splits, naive Bayes

from textlens.operators import splits as D  # noqa: E402
from textlens.operators import tfidf as V  # noqa: E402
from textlens.operators.models import naive_bayes_keyed  # noqa: E402


def q_ngram_df(spark, sf_dir):
    tf = V.term_counts(labelled(spark, sf_dir), "id", "text")
    return V.document_frequency(tf, "id")


def q_tfidf_weights(spark, sf_dir):
    w = V.tfidf(labelled(spark, sf_dir), "id", "text")
    return w.select("id", "term", "tf", "df", F.round("w", R).alias("w"))


def q_vocab_size(spark, sf_dir):
    tf = V.term_counts(labelled(spark, sf_dir), "id", "text")
    return V.shape(tf, "id")


def split_frame(spark, sf_dir) -> DataFrame:
    return D.stratified_split(labelled(spark, sf_dir).select("id", "category"), "id", "category")


def q_stratified_split(spark, sf_dir):
    return split_frame(spark, sf_dir).select("id", "category", "split")


def q_kfold_assign(spark, sf_dir):
    return D.kfold_assign(labelled(spark, sf_dir).select("id", "category"), "id", "category")


def q_group_split(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source")
    return D.group_split(d, "source").select("id", "source", "split")


def q_split_report(spark, sf_dir):
    return D.split_report(split_frame(spark, sf_dir), "category")


def q_tfidf_transform_test(spark, sf_dir):
    d = labelled(spark, sf_dir)
    s = split_frame(spark, sf_dir)
    train, test = D.rows_of_split(d, s, "id", "train"), D.rows_of_split(d, s, "id", "test")
    w = V.fit_transform(train, test, "id", "text")
    return w.select("id", "term", "tf", "df", F.round("w", R).alias("w"))


def nb_holdout(spark, sf_dir) -> DataFrame:
    d = labelled(spark, sf_dir)
    assign = split_frame(spark, sf_dir).select(F.lit(0).alias("key"), "id", F.col("split").alias("side"))
    return naive_bayes_keyed(d, assign, "id", "text", "category")


def q_nb_predict(spark, sf_dir):
    p = nb_holdout(spark, sf_dir)
    return p.select("id", "actual", "predicted", F.round("confidence", R).alias("confidence"))


def q_nb_cv_macro_f1(spark, sf_dir):
    d = labelled(spark, sf_dir)
    folds = D.kfold_assign(d.select("id", "category"), "id", "category")
    assign = folds.select("id", "fold", F.explode(F.sequence(F.lit(0), F.lit(D.N_FOLDS - 1))).alias("key"))
    assign = assign.select("key", "id", F.when(F.col("fold") == F.col("key"), "test").otherwise("train").alias("side"))
    pred = naive_bayes_keyed(d, assign, "id", "text", "category")
    per_fold = E.summary(pred, "actual", "predicted", by=["key"])
    return per_fold.agg(F.round(F.avg("macro_f1"), R).alias("mean_macro_f1"),
                        F.round(F.stddev_pop("macro_f1"), R).alias("std_macro_f1"),
                        F.count(F.lit(1)).alias("folds"))


def q_model_comparison(spark, sf_dir):
    """Keyword matcher (both generations) and naive Bayes on the same hold-out rows."""
    nb = nb_holdout(spark, sf_dir)
    test_ids = nb.select("id")
    d = labelled(spark, sf_dir).join(test_ids, "id", "left_semi")
    kw = K.with_keyword_result(d, "text", LANG_LEXICON)
    kw1 = K.with_first_generation(d, "text", LANG_LEXICON_V1)
    table = E.comparison([
        E.summary(nb, "actual", "predicted", model="naive_bayes"),
        E.summary(kw, "category", "kw_category", model="keyword_weighted"),
        E.summary(kw1, "category", "kw1_category", model="keyword_first_gen"),
    ])
    return table


QUERIES.update({
    "ngram_df": q_ngram_df,
    "tfidf_weights": q_tfidf_weights,
    "vocab_size": q_vocab_size,
    "stratified_split": q_stratified_split,
    "kfold_assign": q_kfold_assign,
    "group_split": q_group_split,
    "split_report": q_split_report,
    "tfidf_transform_test": q_tfidf_transform_test,
    "nb_predict": q_nb_predict,
    "nb_cv_macro_f1": q_nb_cv_macro_f1,
    "model_comparison": q_model_comparison,
})


# ---------------------------------------------------------------- base scorer, hybrid decision, log report

from textlens.functions.text import clock_text, preview  # noqa: E402
from textlens.operators import report as A  # noqa: E402
from textlens.operators import scoring as M  # noqa: E402
from textlens.plans.lexicons import EMBED_LEXICON  # noqa: E402

TEMPERATURE = 0.05


def centroid_scored(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Every embedding scored by the class-centroid base model: probs in label order."""
    emb = read_table(spark, sf_dir, "embeddings")
    model = M.CentroidModel.fit(emb, "embedding", "label")
    labels = [str(x) for x in model.labels]
    return model.transform(emb, "embedding", temperature=TEMPERATURE), labels


def hybrid_scored(spark, sf_dir) -> DataFrame:
    """M5: every document, scored by base model (where it has an embedding) and keyword ladder (whole texts)."""
    scored, labels = centroid_scored(spark, sf_dir)
    d = docs(spark, sf_dir).select("doc_id", "text")
    base = scored.select(F.col("vec_id").alias("doc_id"), "label", "probs")
    return M.score(d, "text", "probs", labels, EMBED_LEXICON, base=base, on="doc_id")


def q_softmax_argmax(spark, sf_dir):
    scored, labels = centroid_scored(spark, sf_dir)
    out = M.with_prediction(scored, "probs", labels)
    return out.select("vec_id", F.col("label").cast("string").alias("label"), "base_category",
                      F.round("base_confidence", R).alias("confidence"),
                      F.round(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x), R).alias("prob_sum"))


def q_top3_classes(spark, sf_dir):
    scored, labels = centroid_scored(spark, sf_dir)
    out = M.with_top_k(scored, "probs", labels, k=3)
    return out.select("vec_id", F.posexplode("top").alias("pos", "t")).select(
        "vec_id", (F.col("pos") + 1).alias("rank"), F.col("t.label").alias("label"),
        F.round("t.prob", R).alias("prob"), F.col("t.pct").alias("pct"))


def q_hybrid_predict(spark, sf_dir):
    out = hybrid_scored(spark, sf_dir)
    return out.select("doc_id", F.col("label").cast("string").alias("actual"), "base_category",
                      F.round("base_confidence", R).alias("base_confidence"), "kw_category", "kw_score",
                      "rule", "category", F.round("confidence", R).alias("confidence"), "method",
                      join_list("matched_keywords").alias("matched_keywords"))


def q_keyword_v1_decision(spark, sf_dir):
    """K4+K5 on the hybrid task: any first-generation hit overrides the base model."""
    scored, labels = centroid_scored(spark, sf_dir)
    d = docs(spark, sf_dir).select("doc_id", "text")
    j = d.join(scored.select(F.col("vec_id").alias("doc_id"), "probs"), "doc_id", "left")
    j = M.with_prediction(j, "probs", labels)
    j = K.with_first_generation(j, "text", EMBED_LEXICON)
    out = K.first_generation_decision(j, "base_category", "base_confidence")
    nothing = F.col("category").isNull()
    return out.select("doc_id", "kw1_category", "kw1_score", F.coalesce("category", F.lit(M.UNCLASSIFIED)).alias("category"),
                      F.round(F.coalesce("confidence", F.lit(0.0)), R).alias("confidence"),
                      F.when(nothing, M.METHOD_NONE).otherwise(F.col("method")).alias("method"))


def hybrid_labelled(spark, sf_dir) -> DataFrame:
    """The scored documents that have a label to be measured against."""
    return hybrid_scored(spark, sf_dir).filter("label IS NOT NULL").withColumn("actual", F.col("label").cast("string"))


def hybrid_comparison(spark, sf_dir) -> DataFrame:
    out = hybrid_labelled(spark, sf_dir)
    return E.comparison([E.summary(out, "actual", "base_category", model="base"),
                         E.summary(out, "actual", "category", model="hybrid")])


def q_hybrid_comparison(spark, sf_dir):
    return hybrid_comparison(spark, sf_dir)


def q_hybrid_improvement(spark, sf_dir):
    return E.improvement(hybrid_comparison(spark, sf_dir), "base", "hybrid")


def q_hybrid_confusion(spark, sf_dir):
    return E.confusion_matrix(hybrid_labelled(spark, sf_dir), "actual", "category")


def scored_log(spark, sf_dir) -> DataFrame:
    """The scored rows as a log: each scoring stamped with the time of the event of the same id."""
    ev = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("timestamp"))
    return (hybrid_scored(spark, sf_dir).join(ev, "doc_id")
            .select("doc_id", F.col("text").alias("complaint"), "category", "confidence", "method", "timestamp"))


def q_log_summary(spark, sf_dir):
    return A.log_summary(scored_log(spark, sf_dir))


def q_top_category(spark, sf_dir):
    return A.top_category(scored_log(spark, sf_dir))


def q_log_distribution(spark, sf_dir):
    return P.distribution(scored_log(spark, sf_dir), "category")


def q_recent_rows(spark, sf_dir):
    out = A.recent_rows(scored_log(spark, sf_dir), n=10, id_col="doc_id")
    return out.select("doc_id", clock_text("timestamp").alias("timestamp"), "category",
                      F.round("confidence", R).alias("confidence"), "method", "preview", "confidence_pct")


QUERIES.update({
    "softmax_argmax": q_softmax_argmax,
    "top3_classes": q_top3_classes,
    "hybrid_predict": q_hybrid_predict,
    "keyword_v1_decision": q_keyword_v1_decision,
    "hybrid_comparison": q_hybrid_comparison,
    "hybrid_improvement": q_hybrid_improvement,
    "hybrid_confusion": q_hybrid_confusion,
    "log_summary": q_log_summary,
    "top_category": q_top_category,
    "log_distribution": q_log_distribution,
    "recent_rows": q_recent_rows,
})


# ---------------------------------------------------------------- near duplicates and template groups

from textlens.operators import components as G  # noqa: E402
from textlens.operators import similarity as S  # noqa: E402

PAIR_THRESHOLD = 0.80
SWEEP = (0.70, 0.80, 0.90, 0.95)


def q_similar_pairs(spark, sf_dir):
    pairs, _ = S.corpus_pairs(labelled(spark, sf_dir), "id", "text", PAIR_THRESHOLD)
    return pairs.select("i", "j", F.round("sim", R).alias("sim"), "n_i", "n_j")


def q_threshold_sweep(spark, sf_dir):
    pairs, groups = S.corpus_pairs(labelled(spark, sf_dir), "id", "text", min(SWEEP))
    return S.threshold_sweep(pairs, groups, SWEEP)


def q_copy_groups(spark, sf_dir):
    """Every row of a text that occurs more than once, with its group's smallest id and size:
    with ``similar_pairs`` this gives every row pair without expanding the copies."""
    d = labelled(spark, sf_dir).select("id", F.sha2("text", 256).alias("h"))
    g = d.groupBy("h").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    return d.join(g, "h").select("id", "group_id", "n_copies")


def q_pair_preview(spark, sf_dir):
    d = labelled(spark, sf_dir)
    pairs, _ = S.corpus_pairs(d, "id", "text", PAIR_THRESHOLD)
    first = pairs.orderBy("i", "j").limit(10)  # the preview is the feature
    t = d.select("id", "text")
    return (first.join(t.select(F.col("id").alias("i"), F.col("text").alias("text_i")), "i")
            .join(t.select(F.col("id").alias("j"), F.col("text").alias("text_j")), "j")
            .select("i", "j", F.round("sim", 3).alias("sim"), "text_i", "text_j"))


def template_groups(spark, sf_dir, found=None) -> DataFrame:
    """V8: connected components of the >= 0.80 graph over all rows; copies of a
    text with terms join their representative by one edge each (a star).
    ``found``: the (pairs, groups) of ``corpus_pairs``, if the caller has them; links do."""
    d = labelled(spark, sf_dir)
    pairs, groups = found or S.corpus_links(d, "id", "text", PAIR_THRESHOLD)
    mem = S.members(d, "id", "text").join(groups.filter("has_terms").select("rid"), "rid")
    edges = (pairs.select(F.col("i").alias("a"), F.col("j").alias("b"))
             .unionByName(mem.filter(F.col("id") != F.col("rid")).select(F.col("id").alias("a"), F.col("rid").alias("b"))))
    return G.components(d.select("id"), edges, "id")


def q_template_groups(spark, sf_dir):
    return template_groups(spark, sf_dir)


def q_template_group_split(spark, sf_dir):
    """D2 over V8: 20 % of template groups (not rows) go to test; no group crosses."""
    grp = template_groups(spark, sf_dir)
    return D.group_split(grp, "group_id").select("id", "group_id", "split")


QUERIES.update({
    "similar_pairs": q_similar_pairs,
    "threshold_sweep": q_threshold_sweep,
    "pair_preview": q_pair_preview,
    "copy_groups": q_copy_groups,
    "template_groups": q_template_groups,
    "template_group_split": q_template_group_split,
})


# ---------------------------------------------------------------- streaming twins

from textlens.streaming import jobs as T  # noqa: E402


def _scored_doc_stream(spark, sf_dir):
    schema = docs(spark, sf_dir).schema
    # A pattern, since a plain path must be a folder and the table may be a single file.
    stream = T.text_stream(spark, f"{sf_dir}/documents.parque[t]", schema)
    scored, labels = centroid_scored(spark, sf_dir)
    base = scored.select(F.col("vec_id").alias("doc_id"), "label", "probs")

    def scorer(s: DataFrame) -> DataFrame:
        j = s.select("doc_id", "text").join(base, "doc_id", "left")  # stream-static join
        out = M.score(j, "text", "probs", labels, EMBED_LEXICON)
        return out.select("doc_id", F.col("label").cast("string").alias("actual"), "base_category",
                          "base_confidence", "kw_category", "kw_score", "rule", "category", "confidence",
                          "method", join_list("matched_keywords").alias("matched_keywords"))

    return stream, scorer


def q_stream_scores(spark, sf_dir):
    stream, scorer = _scored_doc_stream(spark, sf_dir)
    out = T.score_stream(stream, scorer, spark)
    return out.select("doc_id", "actual", "base_category", F.round("base_confidence", R).alias("base_confidence"),
                      "kw_category", "kw_score", "rule", "category", F.round("confidence", R).alias("confidence"),
                      "method", "matched_keywords")


def q_stream_counts(spark, sf_dir):
    stream, scorer = _scored_doc_stream(spark, sf_dir)
    return T.running_totals(scorer(stream), spark)


QUERIES.update({
    "stream_scores": q_stream_scores,
    "stream_counts": q_stream_counts,
})


# ---------------------------------------------------------------- linear models on the full vocabulary (T-LR, T-SVM, T-CV)

from textlens.operators import linear as LN  # noqa: E402


def _linear_fit(spark, sf_dir, kind: str) -> LN.Fit:
    assign = split_frame(spark, sf_dir).select(F.lit(0).alias("key"), "id", F.col("split").alias("side"))
    return LN.fit(labelled(spark, sf_dir), assign, "id", "text", "category", kind)


def _linear_predict(spark, sf_dir, kind: str) -> DataFrame:
    p = _linear_fit(spark, sf_dir, kind).predictions().select("id", "predicted")
    return p.join(labelled(spark, sf_dir).select("id", F.col("category").alias("actual")), "id").select("id", "actual", "predicted")


def q_lr_predict(spark, sf_dir):
    """T-LR: multinomial logistic regression, trained on one side of the split and applied to the other."""
    return _linear_predict(spark, sf_dir, "lr")


def q_svm_predict(spark, sf_dir):
    """T-SVM: one-against-the-rest SVM with squared hinge loss on the same split."""
    return _linear_predict(spark, sf_dir, "svm")


def q_lr_cv_macro_f1(spark, sf_dir):
    """T-CV: five folds of logistic regression, all trained in the same passes."""
    d = labelled(spark, sf_dir)
    folds = D.kfold_assign(d.select("id", "category"), "id", "category")
    side = F.when(F.col("fold") == F.col("key"), "test").otherwise("train").alias("side")
    assign = folds.select("id", "fold", F.explode(F.sequence(F.lit(0), F.lit(D.N_FOLDS - 1))).alias("key")).select("key", "id", side)
    pred = LN.fit(d, assign, "id", "text", "category").predictions().join(d.select("id", F.col("category").alias("actual")), "id")
    per_fold = E.summary(pred, "actual", "predicted", by=["key"])
    return per_fold.agg(F.round(F.avg("macro_f1"), R).alias("mean_macro_f1"),
                        F.round(F.stddev_pop("macro_f1"), R).alias("std_macro_f1"),
                        F.count(F.lit(1)).alias("folds"))


def q_lr_fit_report(spark, sf_dir):
    """What the logistic regression was trained on, and whether its solver ended as it should."""
    f = _linear_fit(spark, sf_dir, "lr")
    values = [h["objective"] for h in f.history]
    sides = split_frame(spark, sf_dir).agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    n_terms = f.terms.count()  # a number
    return sides.select(
        "n_train", "n_test", F.lit(n_terms).cast("long").alias("n_terms"), F.lit(len(f.labels)).cast("long").alias("n_classes"), F.lit(all(f.converged)).alias("converged"),
        F.lit(all(a >= b for a, b in zip(values, values[1:]))).alias("objective_falls"))


def q_linear_comparison(spark, sf_dir):
    """Both linear models and naive Bayes on the same hold-out rows."""
    return E.comparison([E.summary(_linear_predict(spark, sf_dir, "lr"), "actual", "predicted", model="logistic_regression"),
                         E.summary(_linear_predict(spark, sf_dir, "svm"), "actual", "predicted", model="linear_svm"),
                         E.summary(nb_holdout(spark, sf_dir), "actual", "predicted", model="naive_bayes")])


QUERIES.update({
    "lr_predict": q_lr_predict,
    "svm_predict": q_svm_predict,
    "lr_cv_macro_f1": q_lr_cv_macro_f1,
    "lr_fit_report": q_lr_fit_report,
    "linear_comparison": q_linear_comparison,
})

# Queries without an exact SQL oracle.
ROWS_ONLY: set[str] = set()


# ---------------------------------------------------------------- shape, text flags, head, error totals

from textlens.functions.text import has_char_range, has_damage, is_blank  # noqa: E402


def q_table_shape(spark, sf_dir):
    """Rows, columns and non-null counts of the labelled table."""
    return P.shape(labelled(spark, sf_dir))


def q_text_flags(spark, sf_dir):
    """F5-F7 + P5 in one pass: rows with Devanagari, with the damage marker, blank, distinct texts."""
    d = labelled(spark, sf_dir)
    return d.agg(F.count_if(has_char_range("text", 0x0900, 0x097F)).alias("n_devanagari"),
                 F.count_if(has_damage("text")).alias("n_damaged"),
                 F.count_if(is_blank("text")).alias("n_blank"),
                 F.count_distinct(F.sha2("text", 256)).alias("distinct_texts"))


def q_head(spark, sf_dir):
    """First 5 rows in id order with a short preview (the limit is the feature)."""
    from textlens.operators.report import head
    return head(labelled(spark, sf_dir), 5, "id").select("id", "category", preview("text").alias("preview"))


def q_error_totals(spark, sf_dir):
    """E5 totals for the keyword classifier."""
    return E.error_totals(keyword_predictions(spark, sf_dir), "category", "kw_category")


QUERIES.update({
    "table_shape": q_table_shape,
    "text_flags": q_text_flags,
    "head": q_head,
    "error_totals": q_error_totals,
})


# ---------------------------------------------------------------- dictionaries of any size

from textlens.operators import phrases as PH  # noqa: E402

PHRASES_PER_CLASS = 12_500  # of four classes: a dictionary of 50,000 phrases


def phrase_dictionary(spark, sf_dir) -> DataFrame:
    return PH.learned_dictionary(labelled(spark, sf_dir), "text", "category", PHRASES_PER_CLASS)


def _phrase_hits(spark, sf_dir, squeeze: bool = True):
    index = PH.PhraseIndex.build(phrase_dictionary(spark, sf_dir), squeeze)
    return PH.hits(labelled(spark, sf_dir), "text", index, ["id"], in_rows=True), index


def q_phrase_dictionary(spark, sf_dir):
    """The dictionary of the most frequent two-word phrases of each class."""
    return phrase_dictionary(spark, sf_dir)


def q_phrase_scores(spark, sf_dir):
    """K1 over that dictionary."""
    found, _ = _phrase_hits(spark, sf_dir)
    return PH.scores(found, ["id"])


def q_phrase_best(spark, sf_dir):
    """K2, K3 over that dictionary."""
    found, _ = _phrase_hits(spark, sf_dir)
    return PH.best(found, ["id"]).select("id", "kw_category", "kw_score", join_list("kw_matches").alias("kw_matches"))


def q_phrase_first_gen(spark, sf_dir):
    """K4 over that dictionary."""
    found, index = _phrase_hits(spark, sf_dir, squeeze=False)
    return PH.first_generation(found, ["id"], index)


def q_phrase_first_gen_decision(spark, sf_dir):
    """K5 over that dictionary: a hit overrides the small lexicon's answer."""
    found, index = _phrase_hits(spark, sf_dir, squeeze=False)
    kw1 = PH.first_generation(found, ["id"], index)
    base = keyword_predictions(spark, sf_dir).select("id", "kw_category", F.col("kw_score").alias("base_score"))
    return K.first_generation_decision(base.join(kw1, "id"), "kw_category", "base_score").select(
        "id", "kw1_category", "kw1_score", "category", F.col("confidence").alias("base_score"), "method")


QUERIES.update({
    "phrase_dictionary": q_phrase_dictionary,
    "phrase_scores": q_phrase_scores,
    "phrase_best": q_phrase_best,
    "phrase_first_gen": q_phrase_first_gen,
    "phrase_first_gen_decision": q_phrase_first_gen_decision,
})


# ---------------------------------------------------------------- a base model that reads the text (T-base, M4, M5, T1)

from textlens.operators.text_model import TextModel  # noqa: E402


def _text_model(spark, sf_dir) -> TextModel:
    """Naive Bayes on the training side of the stratified split."""
    train = D.rows_of_split(labelled(spark, sf_dir), split_frame(spark, sf_dir), "id", "train")
    return TextModel.naive_bayes(train, "id", "text", "category")


def _ladder(model: TextModel, rows: DataFrame) -> DataFrame:
    out = M.score(model.score(rows, "text"), "text", "probs", model.labels, LANG_LEXICON)
    return out.select("id", F.col("category_true").alias("actual"), "base_category", F.round("base_confidence", R).alias("base_confidence"),
                      "kw_category", "kw_score", "rule", "category", F.round("confidence", R).alias("confidence"), "method",
                      join_list("matched_keywords").alias("matched_keywords"))


def _test_rows(d: DataFrame, spark, sf_dir) -> DataFrame:
    return D.rows_of_split(d, split_frame(spark, sf_dir), "id", "test").withColumnRenamed("category", "category_true")


def q_hybrid_nb_predict(spark, sf_dir):
    """M4, M5: the ladder over naive Bayes, trained on one side of the split and applied to the other."""
    return _ladder(_text_model(spark, sf_dir), _test_rows(labelled(spark, sf_dir), spark, sf_dir))


def q_hybrid_nb_comparison(spark, sf_dir):
    """E6, E7 out of sample: the base model and the hybrid on the held-out side, scored once."""
    from textlens.session import materialize

    out = materialize(q_hybrid_nb_predict(spark, sf_dir), "hybrid_nb")
    return E.comparison([E.summary(out, "actual", "base_category", model="base"),
                         E.summary(out, "actual", "category", model="hybrid")])


def q_stream_nb_scores(spark, sf_dir):
    """The same rows from a stream of documents, the model looked up inside the row."""
    stream = T.text_stream(spark, f"{sf_dir}/documents.parque[t]", docs(spark, sf_dir).schema)
    rows = stream.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("category"))
    model = _text_model(spark, sf_dir)

    def scorer(s: DataFrame) -> DataFrame:
        return _ladder(model, _test_rows(s, spark, sf_dir))  # stream-static join

    if model.fits_broadcast():
        return T.score_stream(rows, scorer, spark, "nb_scores")
    sample = _ladder(model, _test_rows(labelled(spark, sf_dir), spark, sf_dir)).schema
    return T.score_batches(rows, scorer, spark, sample, "nb_scores")


QUERIES.update({
    "hybrid_nb_predict": q_hybrid_nb_predict,
    "hybrid_nb_comparison": q_hybrid_nb_comparison,
    "stream_nb_scores": q_stream_nb_scores,
})


# ---------------------------------------------------------------- leak control: V8 -> D2 -> V3 -> T-NB -> E3

def _template_split(spark, sf_dir, found=None) -> DataFrame:
    """(id, category, group_id, split): template groups kept on one side, classes in balance."""
    from textlens.session import materialize

    grp = template_groups(spark, sf_dir, found)
    rows = materialize(labelled(spark, sf_dir).select("id", "category").join(grp, "id"), "template_rows")
    return materialize(D.balanced_group_split(rows, "id", "group_id", "category").select("id", "category", "group_id", "split"), "template_split")


def q_template_balanced_split(spark, sf_dir):
    """D2 over V8 with the classes in balance."""
    return _template_split(spark, sf_dir)


def q_template_split_report(spark, sf_dir):
    """D4 of that split."""
    return D.split_report(_template_split(spark, sf_dir), "category")


def q_template_leaks(spark, sf_dir):
    """Similar pairs and copies across the sides of the plain and of the template-aware split."""
    d = labelled(spark, sf_dir)
    pairs, groups = S.corpus_pairs(d, "id", "text", PAIR_THRESHOLD)
    from textlens.session import materialize

    pairs, members = materialize(pairs.select("i", "j"), "leak_pairs"), materialize(S.members(d, "id", "text"), "leak_members")
    out = [D.leaks(s, "id", pairs, members).select(F.lit(name).alias("split"), "*")
           for name, s in (("stratified", split_frame(spark, sf_dir)), ("template_aware", _template_split(spark, sf_dir, (pairs, groups))))]
    return out[0].unionByName(out[1])


def q_nb_template_report(spark, sf_dir):
    """E3 of naive Bayes trained and measured on the template-aware split."""
    assign = _template_split(spark, sf_dir).select(F.lit(0).alias("key"), "id", F.col("split").alias("side"))
    p = naive_bayes_keyed(labelled(spark, sf_dir), assign, "id", "text", "category")
    return _round(E.class_report(p, "actual", "predicted"), ["precision", "recall", "f1"])


QUERIES.update({
    "template_balanced_split": q_template_balanced_split,
    "template_split_report": q_template_split_report,
    "template_leaks": q_template_leaks,
    "nb_template_report": q_nb_template_report,
})


# ---------------------------------------------------------------- P7 of doubles, P5 from stored sketches

LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def q_numeric_summary(spark, sf_dir):
    """P7 with exact quartiles of the numeric columns of lineitem."""
    out = P.numeric_summary(read_table(spark, sf_dir, "lineitem"), LINEITEM_NUMBERS)
    return _round(out, ["mean", "std", "min", "q25", "q50", "q75", "max"])


def q_distinct_sketches(spark, sf_dir):
    """P5, approximate: distinct orders by month and over all months, from stored sketches of the months; the
    exact counts beside, and whether the estimate is within five standard errors."""
    from textlens.session import materialize

    d = read_table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_orderkey").alias("o"))
    stored = materialize(P.distinct_sketches(d, "o", ["month"]), "sketches")
    approx = P.distinct_of_sketches(stored, ["month"]).unionByName(P.distinct_of_sketches(stored).withColumn("month", F.lit("all")))
    exact = d.groupBy("month").agg(F.count_distinct("o").alias("distinct")).unionByName(
        d.agg(F.count_distinct("o").alias("distinct")).withColumn("month", F.lit("all")))
    bound = 5 * 1.04 / (1 << P.HLL_BITS) ** 0.5
    return approx.join(exact, "month").select("month", "n", "distinct", (
        F.abs(F.col("approx_distinct") - F.col("distinct")) <= F.col("distinct") * bound).alias("within_bound"))


QUERIES.update({
    "numeric_summary": q_numeric_summary,
    "distinct_sketches": q_distinct_sketches,
})


# ---------------------------------------------------------------- the log by day

from textlens.sources import sinks as SK  # noqa: E402


def _dated_log(spark, sf_dir) -> DataFrame:
    """The scored log written by day, its first day written a second time, its second day truncated, read back."""
    import os
    import uuid

    from textlens.session import checkpoint_dir, materialize

    path = os.path.join(checkpoint_dir(spark), "logs", uuid.uuid4().hex[:12])
    log = materialize(scored_log(spark, sf_dir).drop("complaint"), "scored_log")
    SK.replace_days(log, path)
    days = [r[0] for r in log.select(F.to_date("timestamp").alias("d")).distinct().orderBy("d").limit(2).collect()]  # the first two
    if days:
        SK.replace_days(log.filter(F.to_date("timestamp") == F.lit(days[0])), path)
    if len(days) > 1:
        SK.truncate_day(spark, path, str(days[1]), log.schema)
    return SK.read_days(spark, path, log.schema)


def q_dated_log_days(spark, sf_dir):
    """A1, A3 by day of that log."""
    hundredths = F.round(F.col("confidence") * 10000.0).cast("long")
    return (_dated_log(spark, sf_dir).groupBy(F.col("day").cast("string").alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(hundredths).alias("confidence_hundredths")))


def q_dated_log_recent(spark, sf_dir):
    """A6 of that log: the last ten rows, from the days that hold them (the ten are the feature)."""
    last = SK.recent_days(_dated_log(spark, sf_dir), 10)
    return (last.orderBy(F.col("timestamp").desc(), "doc_id").limit(10)
            .select("doc_id", clock_text("timestamp").alias("timestamp"), "category", F.round("confidence", R).alias("confidence"), "method"))


QUERIES.update({
    "dated_log_days": q_dated_log_days,
    "dated_log_recent": q_dated_log_recent,
})


# ---------------------------------------------------------------- T2 taken up again

def q_stream_totals_resumed(spark, sf_dir):
    """T2 stopped after its first batch and taken up again from the same folder: the totals of the whole stream."""
    import os
    import uuid

    from textlens.session import checkpoint_dir

    folder = os.path.join(checkpoint_dir(spark), "streams", uuid.uuid4().hex[:12])
    stopped = []

    def stop(epoch: int) -> None:
        if not stopped:
            stopped.append(epoch)
            raise InterruptedError("stopped between the batch's folder and its record")

    def run() -> DataFrame:
        stream, scorer = _scored_doc_stream(spark, sf_dir)
        return T.resumable_totals(scorer(stream), spark, folder, after_batch=stop)

    try:
        run()
    except Exception:  # the stop above, as Spark reports it; anything else is raised again by the second run
        if not stopped:
            raise
    return run().drop("epoch")


QUERIES.update({"stream_totals_resumed": q_stream_totals_resumed})
