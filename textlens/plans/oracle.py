"""DuckDB oracle SQL for every registered query (same semantics, written as SQL).

Patterns (whitespace class, token class) and lexicons are the same fixed values
the Spark side uses, rendered into SQL text.
"""

from __future__ import annotations

from textlens.functions.text import TOKEN_PATTERN, WS_CLASS
from textlens.plans.lexicons import LANG_LEXICON, LANG_LEXICON_V1
from textlens.sources.lexicon import Lexicon

R = 6


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm_sql(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), {q(WS_CLASS)}, ' ', 'g'))"


def clean_sql(col: str) -> str:
    return f"trim(regexp_replace({col}, {q(WS_CLASS)}, ' ', 'g'))"


def lexicon_values(lex: Lexicon, lower: bool = True) -> str:
    """VALUES (kw_id, category, cat_order, keyword) of a lexicon; weight computed in SQL."""
    order = {c: i for i, c in enumerate(lex.categories)}
    rows = []
    for i, cat, kw in lex.rows():
        rows.append(f"({i}, {q(cat)}, {order[cat]}, {q(kw)})")
    kw = "trim(lower(keyword))" if lower else "keyword"
    return (f"(SELECT kw_id, category, cat_order, {kw} AS keyword, "
            f"CAST(least(3, len(string_split(trim(lower(keyword)), ' '))) AS INTEGER) AS weight "
            f"FROM (VALUES {', '.join(rows)}) AS t(kw_id, category, cat_order, keyword))")


LABELLED = "(SELECT doc_id AS id, text, lang AS category FROM documents)"


def keyword_best_sql(lex: Lexicon) -> str:
    """Per id: kw_category (null on tie / no hit), kw_score, kw_matches (', '-joined)."""
    return f"""
WITH lex AS {lexicon_values(lex)},
d AS (SELECT id, category, {norm_sql('text')} AS norm FROM {LABELLED}),
hits AS (SELECT d.id, lex.kw_id, lex.category AS kcat, lex.keyword, lex.weight
         FROM d JOIN lex ON contains(d.norm, lex.keyword)),
cs AS (SELECT id, kcat, sum(weight) AS score, string_agg(keyword, ', ' ORDER BY kw_id) AS matches
       FROM hits GROUP BY id, kcat),
agg AS (SELECT id, max(score) AS best FROM cs GROUP BY id),
w AS (SELECT cs.id, count(*) AS n_at, min(cs.kcat) AS cat, min(cs.matches) AS matches
      FROM cs JOIN agg ON cs.id = agg.id AND cs.score = agg.best GROUP BY cs.id)
SELECT d.id, d.category,
       CASE WHEN w.n_at = 1 THEN w.cat END AS kw_category,
       CAST(coalesce(agg.best, 0) AS INTEGER) AS kw_score,
       CASE WHEN w.n_at = 1 THEN w.matches ELSE '' END AS kw_matches
FROM d LEFT JOIN agg ON d.id = agg.id LEFT JOIN w ON d.id = w.id"""


def per_class_sql(p: str, keyed: bool = False) -> str:
    """Per (key, class) tp / n_pred / support / precision / recall / f1 over the label union
    of relation ``p`` (key, actual, predicted); ``key`` is 0 when not keyed."""
    k = "key" if keyed else "0 AS key"
    return f"""
SELECT key, class, tp, n_pred, support, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
FROM (
  SELECT cl.key, cl.class, coalesce(tp.tp, 0) AS tp, coalesce(np.n_pred, 0) AS n_pred,
         coalesce(ns.support, 0) AS support,
         CASE WHEN coalesce(np.n_pred, 0) > 0 THEN coalesce(tp.tp, 0)::DOUBLE / np.n_pred ELSE 0.0 END AS precision,
         CASE WHEN coalesce(ns.support, 0) > 0 THEN coalesce(tp.tp, 0)::DOUBLE / ns.support ELSE 0.0 END AS recall
  FROM (SELECT DISTINCT {k}, actual AS class FROM {p} WHERE actual IS NOT NULL
        UNION SELECT DISTINCT {k}, predicted FROM {p} WHERE predicted IS NOT NULL) cl
  LEFT JOIN (SELECT {k}, actual AS class, count(*) AS tp FROM {p} WHERE actual = predicted GROUP BY ALL) tp
         ON tp.key = cl.key AND tp.class = cl.class
  LEFT JOIN (SELECT {k}, predicted AS class, count(*) AS n_pred FROM {p} GROUP BY ALL) np
         ON np.key = cl.key AND np.class = cl.class
  LEFT JOIN (SELECT {k}, actual AS class, count(*) AS support FROM {p} GROUP BY ALL) ns
         ON ns.key = cl.key AND ns.class = cl.class)"""


def summary_sql(pred: str, actual: str = "actual", predicted: str = "predicted", model: str | None = None,
                digits: int = R) -> str:
    """E1+E2 over a relation with (actual, predicted) columns."""
    m = f"{q(model)} AS model, " if model else ""
    return f"""
WITH p AS (SELECT {actual} AS actual, {predicted} AS predicted FROM ({pred})),
pc AS ({per_class_sql('p')})
SELECT {m}round(sum(tp) / sum(support), {digits}) AS accuracy, round(avg(precision), {digits}) AS precision,
       round(avg(recall), {digits}) AS recall, round(avg(f1), {digits}) AS macro_f1, CAST(sum(support) AS BIGINT) AS n
FROM pc"""


def class_report_sql(pred: str) -> str:
    return f"""
WITH p AS (SELECT actual, predicted FROM ({pred})),
pc AS ({per_class_sql('p')})
SELECT class, round(precision, {R}) AS precision, round(recall, {R}) AS recall, round(f1, {R}) AS f1,
       CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), {R}), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'macro avg', round(avg(precision), {R}), round(avg(recall), {R}), round(avg(f1), {R}),
       CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), {R}),
       round(sum(recall * support) / sum(support), {R}), round(sum(f1 * support) / sum(support), {R}),
       CAST(sum(support) AS BIGINT) FROM pc"""


def confusion_sql(pred: str) -> str:
    return f"""
WITH p AS (SELECT actual, predicted FROM ({pred})),
l AS (SELECT actual AS label FROM p WHERE actual IS NOT NULL UNION SELECT predicted FROM p WHERE predicted IS NOT NULL),
c AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY ALL)
SELECT a.label AS actual, b.label AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.label AND c.predicted = b.label"""


KW_PRED = f"SELECT category AS actual, kw_category AS predicted FROM ({keyword_best_sql(LANG_LEXICON)})"


def keyword_v1_sql(lex: Lexicon) -> str:
    return f"""
WITH lex AS {lexicon_values(lex, lower=False)},
d AS (SELECT id, lower(text) AS low FROM {LABELLED}),
cats AS (SELECT DISTINCT category, cat_order FROM lex),
sc AS (SELECT d.id, cats.category, cats.cat_order,
              (SELECT count(*) FROM lex WHERE lex.category = cats.category AND contains(d.low, lower(lex.keyword))) AS score
       FROM d CROSS JOIN cats)
SELECT id, arg_max(category, score * 1000 - cat_order) AS kw1_category, CAST(max(score) AS INTEGER) AS kw1_score
FROM sc GROUP BY id"""


SQL = {
    "null_counts": """
SELECT column_name, null_count, n - null_count AS non_null FROM (
  SELECT count(*) AS n,
         count(*) FILTER (WHERE doc_id IS NULL) AS c_doc_id, count(*) FILTER (WHERE text IS NULL) AS c_text,
         count(*) FILTER (WHERE lang IS NULL) AS c_lang, count(*) FILTER (WHERE source IS NULL) AS c_source,
         count(*) FILTER (WHERE n_chars IS NULL) AS c_n_chars FROM documents)
UNPIVOT (null_count FOR column_name IN (c_doc_id AS 'doc_id', c_text AS 'text', c_lang AS 'lang',
                                         c_source AS 'source', c_n_chars AS 'n_chars'))""",
    "duplicate_counts": f"""
WITH d AS {LABELLED}
SELECT 'n_rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM d
UNION ALL SELECT 'dup_rows', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) c FROM d GROUP BY id, text, category)
UNION ALL SELECT 'dup_texts', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) c FROM d GROUP BY text)
UNION ALL SELECT 'distinct_texts', CAST(count(DISTINCT text) AS BIGINT) FROM d
UNION ALL SELECT 'dup_text_label', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) c FROM d GROUP BY text, category)""",
    "label_conflicts": f"""
SELECT CAST(count(*) AS BIGINT) AS conflicting_texts, CAST(coalesce(sum(n_rows), 0) AS BIGINT) AS rows_in_conflict
FROM (SELECT text, count(DISTINCT category) AS n_labels, count(*) AS n_rows FROM {LABELLED} GROUP BY text)
WHERE n_labels > 1""",
    "category_distribution": f"""
SELECT category, CAST(count(*) AS BIGINT) AS n,
       round(count(*)::DOUBLE * 100 / sum(count(*)) OVER (), 4) AS share_pct
FROM {LABELLED} WHERE category IS NOT NULL GROUP BY category""",
    "length_summary": f"""
SELECT CAST(count(*) AS BIGINT) AS count, round(avg(l), {R}) AS mean, round(stddev_samp(l), {R}) AS std,
       CAST(min(l) AS BIGINT) AS min, round(quantile_cont(l, 0.25), {R}) AS q25,
       round(quantile_cont(l, 0.5), {R}) AS q50, round(quantile_cont(l, 0.75), {R}) AS q75,
       CAST(max(l) AS BIGINT) AS max
FROM (SELECT length(text) AS l FROM {LABELLED} WHERE text IS NOT NULL)""",
    "clean_text": f"""
SELECT id, {clean_sql('text')} AS clean_text, {norm_sql('text')} AS norm_text,
       CAST(length(text) AS INTEGER) AS text_length, CAST(length({clean_sql('text')}) AS INTEGER) AS clean_length,
       {clean_sql('text')} <> text AS changed, {clean_sql('text')} = '' AS is_empty
FROM {LABELLED}""",
    "script_distribution": f"""
SELECT script, CAST(count(*) AS BIGINT) AS n, round(count(*)::DOUBLE * 100 / sum(count(*)) OVER (), 4) AS share_pct
FROM (SELECT CASE WHEN regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') AND regexp_matches(text, '[A-Za-z]') THEN 'Mixed'
                  WHEN regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') THEN 'Devanagari'
                  WHEN regexp_matches(text, '[A-Za-z]') THEN 'Latin' ELSE 'Other' END AS script
      FROM {LABELLED}) GROUP BY script""",
    "label_encode": f"""
SELECT id, category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS label_id
FROM {LABELLED} WHERE category IS NOT NULL
UNION ALL SELECT id, category, NULL FROM {LABELLED} WHERE category IS NULL""",
    "keyword_scores": f"""
WITH lex AS {lexicon_values(LANG_LEXICON)},
d AS (SELECT id, {norm_sql('text')} AS norm FROM {LABELLED})
SELECT d.id, lex.category, CAST(sum(weight) AS INTEGER) AS score, CAST(count(*) AS INTEGER) AS n_matches
FROM d JOIN lex ON contains(d.norm, lex.keyword) GROUP BY d.id, lex.category""",
    "keyword_best": f"SELECT id, kw_category, kw_score, kw_matches FROM ({keyword_best_sql(LANG_LEXICON)})",
    "keyword_matches": f"""
WITH lex AS {lexicon_values(LANG_LEXICON)},
d AS (SELECT id, {norm_sql('text')} AS norm FROM {LABELLED})
SELECT d.id, CAST(lex.kw_id AS INTEGER) AS kw_id, lex.category, lex.keyword, lex.weight
FROM d JOIN lex ON contains(d.norm, lex.keyword)""",
    "keyword_v1": keyword_v1_sql(LANG_LEXICON_V1),
    "class_top_terms": f"""
WITH tok AS (SELECT category, regexp_extract_all(lower(text), {q(TOKEN_PATTERN)}) AS t FROM {LABELLED}),
grams AS (SELECT category, unnest(t) AS term FROM tok
          UNION ALL SELECT category, t[i] || ' ' || t[i + 1] FROM tok, range(1, len(t)) r(i)),
c AS (SELECT category, term, count(*) AS tf FROM grams GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY tf DESC, term) AS rank FROM c)
SELECT category, term, CAST(tf AS BIGINT) AS tf, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""",
    "accuracy_macro": summary_sql(KW_PRED),
    "class_report": class_report_sql(KW_PRED),
    "confusion_matrix": confusion_sql(
        f"SELECT category AS actual, coalesce(kw_category, 'none') AS predicted FROM ({keyword_best_sql(LANG_LEXICON)})"),
    "error_rows": f"""
SELECT id, category AS actual, kw_category AS predicted, kw_score
FROM ({keyword_best_sql(LANG_LEXICON)}) WHERE kw_category IS DISTINCT FROM category""",
}


# ---------------------------------------------------------------- TF-IDF, splits, naive Bayes

def tf_ctes(src: str) -> str:
    """CTEs tok, grams, tf(id, term, tf) over relation ``src`` (id, text)."""
    return f"""tok AS (SELECT id, regexp_extract_all(lower(text), {q(TOKEN_PATTERN)}) AS t FROM {src}),
grams AS (SELECT id, unnest(t) AS term FROM tok
          UNION ALL SELECT id, t[i] || ' ' || t[i + 1] FROM tok, range(1, len(t)) r(i)),
tf AS (SELECT id, term, count(*) AS tf FROM grams GROUP BY ALL)"""


SPLIT = f"""(SELECT id, category,
        CASE WHEN rn <= round(n_c * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
 FROM (SELECT id, category,
              row_number() OVER (PARTITION BY category ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS rn,
              count(*) OVER (PARTITION BY category) AS n_c FROM {LABELLED}))"""

KFOLD = f"""(SELECT id, category,
        CAST((row_number() OVER (PARTITION BY category ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) - 1) % 5
             AS INTEGER) AS fold
 FROM {LABELLED})"""


def nb_sql(assign: str) -> str:
    """One TF-IDF + multinomial NB model per key of ``assign`` (key, id, side);
    returns (key, id, actual, predicted, confidence) for the test rows."""
    return f"""
WITH d AS {LABELLED},
asg AS {assign},
{tf_ctes('d')},
a AS (SELECT asg.key, asg.id, asg.side, d.category FROM asg JOIN d ON d.id = asg.id),
tr AS (SELECT a.key, tf.id, tf.term, tf.tf, a.category FROM tf JOIN a ON a.id = tf.id WHERE a.side = 'train'),
te AS (SELECT a.key, tf.id, tf.term, tf.tf FROM tf JOIN a ON a.id = tf.id WHERE a.side = 'test'),
n AS (SELECT key, count(*) AS n FROM a WHERE side = 'train' GROUP BY key),
idf AS (SELECT tr.key, tr.term, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf
        FROM tr JOIN n ON n.key = tr.key GROUP BY tr.key, tr.term),
wtr AS (SELECT tr.key, tr.id, tr.term, tr.category,
               tr.tf * idf.idf / sqrt(sum((tr.tf * idf.idf) * (tr.tf * idf.idf)) OVER (PARTITION BY tr.key, tr.id)) AS w
        FROM tr JOIN idf ON idf.key = tr.key AND idf.term = tr.term),
wte AS (SELECT te.key, te.id, te.term,
               te.tf * idf.idf / sqrt(sum((te.tf * idf.idf) * (te.tf * idf.idf)) OVER (PARTITION BY te.key, te.id)) AS w
        FROM te JOIN idf ON idf.key = te.key AND idf.term = te.term),
ct AS (SELECT key, category, term, sum(w) AS W FROM wtr GROUP BY ALL),
voc AS (SELECT key, count(DISTINCT term) AS V FROM wtr GROUP BY key),
cls AS (SELECT a.key, a.category, ln(count(*)::DOUBLE / any_value(n.n)) AS prior
        FROM a JOIN n ON n.key = a.key WHERE a.side = 'train' GROUP BY a.key, a.category),
den AS (SELECT ct.key, ct.category, ln(sum(ct.W) + any_value(voc.V)) AS logden
        FROM ct JOIN voc ON voc.key = ct.key GROUP BY ct.key, ct.category),
sp AS (SELECT wte.key, wte.id, ct.category, sum(wte.w * ln(ct.W + 1)) AS s
       FROM wte JOIN ct ON ct.key = wte.key AND ct.term = wte.term GROUP BY ALL),
l1 AS (SELECT key, id, sum(w) AS l1 FROM wte GROUP BY ALL),
tst AS (SELECT key, id, category AS actual FROM a WHERE side = 'test'),
sc AS (SELECT t.key, t.id, t.actual, c.category,
              c.prior - coalesce(l1.l1, 0) * den.logden + coalesce(sp.s, 0) AS score
       FROM tst t JOIN cls c ON c.key = t.key
       JOIN den ON den.key = c.key AND den.category = c.category
       LEFT JOIN l1 ON l1.key = t.key AND l1.id = t.id
       LEFT JOIN sp ON sp.key = t.key AND sp.id = t.id AND sp.category = c.category),
sc2 AS (SELECT *, max(score) OVER (PARTITION BY key, id) AS mx FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY score DESC, category) AS r,
              exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY key, id) AS prob FROM sc2)
SELECT key, id, actual, category AS predicted, prob AS confidence FROM rk WHERE r = 1"""


NB_HOLDOUT = nb_sql(f"(SELECT 0 AS key, id, split AS side FROM {SPLIT})")
NB_CV = nb_sql(f"""(SELECT f.key, k.id, CASE WHEN k.fold = f.key THEN 'test' ELSE 'train' END AS side
                    FROM {KFOLD} k CROSS JOIN (SELECT range AS key FROM range(5)) f)""")


def keyword_on(ids: str, lex_sql: str, pred_col: str) -> str:
    return f"SELECT category AS actual, {pred_col} AS predicted FROM ({lex_sql}) WHERE id IN (SELECT id FROM {ids})"


SQL.update({
    "ngram_df": f"""
WITH d AS {LABELLED}, {tf_ctes('d')}
SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term""",
    "tfidf_weights": f"""
WITH d AS {LABELLED}, {tf_ctes('d')},
n AS (SELECT count(*) AS n FROM d),
dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT tf.id, tf.term, tf.tf, dfr.df, tf.tf * (ln((1 + n.n) / (1 + dfr.df)) + 1) AS x
        FROM tf JOIN dfr ON dfr.term = tf.term, n)
SELECT id, term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df,
       round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), {R}) AS w FROM raw""",
    "vocab_size": f"""
WITH d AS {LABELLED}, {tf_ctes('d')}
SELECT CAST(count(DISTINCT id) AS BIGINT) AS n_docs, CAST(count(DISTINCT term) AS BIGINT) AS n_terms,
       CAST(count(*) AS BIGINT) AS n_postings FROM tf""",
    "stratified_split": f"SELECT id, category, split FROM {SPLIT}",
    "kfold_assign": f"SELECT id, category, fold FROM {KFOLD}",
    "group_split": """
WITH g AS (SELECT DISTINCT source FROM documents),
r AS (SELECT source, row_number() OVER (ORDER BY md5(CAST(source AS VARCHAR) || ':42'), source) AS rn,
             count(*) OVER () AS G FROM g)
SELECT d.doc_id AS id, d.source, CASE WHEN r.rn <= ceil(r.G * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM documents d LEFT JOIN r ON r.source = d.source""",
    "split_report": f"SELECT split, category, CAST(count(*) AS BIGINT) AS n FROM {SPLIT} GROUP BY ALL",
    "tfidf_transform_test": f"""
WITH d AS {LABELLED}, s AS {SPLIT}, {tf_ctes('d')},
tr AS (SELECT tf.* FROM tf JOIN s ON s.id = tf.id WHERE s.split = 'train'),
te AS (SELECT tf.* FROM tf JOIN s ON s.id = tf.id WHERE s.split = 'test'),
n AS (SELECT count(*) AS n FROM s WHERE split = 'train'),
dfr AS (SELECT term, count(*) AS df FROM tr GROUP BY term),
raw AS (SELECT te.id, te.term, te.tf, dfr.df, te.tf * (ln((1 + n.n) / (1 + dfr.df)) + 1) AS x
        FROM te JOIN dfr ON dfr.term = te.term, n)
SELECT id, term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df,
       round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), {R}) AS w FROM raw""",
    "nb_predict": f"SELECT id, actual, predicted, round(confidence, {R}) AS confidence FROM ({NB_HOLDOUT})",
    "nb_cv_macro_f1": f"""
WITH p AS (SELECT key, actual, predicted FROM ({NB_CV})),
pc AS ({per_class_sql('p', keyed=True)}),
f AS (SELECT key, avg(f1) AS macro_f1 FROM pc GROUP BY key)
SELECT round(avg(macro_f1), {R}) AS mean_macro_f1, round(stddev_pop(macro_f1), {R}) AS std_macro_f1,
       CAST(count(*) AS BIGINT) AS folds FROM f""",
    "model_comparison": f"""
SELECT model, accuracy, precision, recall, macro_f1 FROM (
SELECT * FROM ({summary_sql(f"SELECT actual, predicted FROM ({NB_HOLDOUT})", model="naive_bayes", digits=4)})
UNION ALL
SELECT * FROM ({summary_sql(keyword_on(f"(SELECT id FROM {SPLIT} WHERE split = 'test')", keyword_best_sql(LANG_LEXICON), "kw_category"), model="keyword_weighted", digits=4)})
UNION ALL
SELECT * FROM ({summary_sql(f"SELECT l.category AS actual, v.kw1_category AS predicted FROM ({keyword_v1_sql(LANG_LEXICON_V1)}) v JOIN {LABELLED} l ON l.id = v.id WHERE v.id IN (SELECT id FROM {SPLIT} WHERE split = 'test')", model="keyword_first_gen", digits=4)})
)""",
})


# ---------------------------------------------------------------- base scorer, hybrid decision, log report

from textlens.plans.lexicons import EMBED_LEXICON  # noqa: E402

CENTROID = """
x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos
      FROM embeddings),
cen AS (SELECT label AS cls, pos, avg(v) AS m FROM x GROUP BY ALL),
lg AS (SELECT x.vec_id, cen.cls, sum(x.v * cen.m) / CAST(0.05 AS DOUBLE) AS logit
       FROM x JOIN cen ON cen.pos = x.pos GROUP BY ALL),
pr AS (SELECT vec_id, cls, exp(logit - max(logit) OVER (PARTITION BY vec_id))
              / sum(exp(logit - max(logit) OVER (PARTITION BY vec_id))) OVER (PARTITION BY vec_id) AS p FROM lg),
base AS (SELECT vec_id, arg_max(cls, p * 1e6 - cls * 1e-9) AS cls_id, max(p) AS conf, sum(p) AS psum FROM pr GROUP BY vec_id)"""

# DuckDB forbids a window inside a window: compute the max first.
CENTROID = CENTROID.replace("""pr AS (SELECT vec_id, cls, exp(logit - max(logit) OVER (PARTITION BY vec_id))
              / sum(exp(logit - max(logit) OVER (PARTITION BY vec_id))) OVER (PARTITION BY vec_id) AS p FROM lg),""",
"""lg2 AS (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS mx FROM lg),
pr AS (SELECT vec_id, cls, exp(logit - mx) / sum(exp(logit - mx)) OVER (PARTITION BY vec_id) AS p FROM lg2),""")
CENTROID = CENTROID.replace("""base AS (SELECT vec_id, arg_max(cls, p * 1e6 - cls * 1e-9) AS cls_id, max(p) AS conf, sum(p) AS psum FROM pr GROUP BY vec_id)""",
"""rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls) AS r,
             sum(p) OVER (PARTITION BY vec_id) AS psum FROM pr),
base AS (SELECT vec_id, cls AS cls_id, p AS conf, psum FROM rk WHERE r = 1)""")

KW_EMB = keyword_best_sql(EMBED_LEXICON)

HYBRID = f"""
WITH {CENTROID},
kw AS ({KW_EMB}),
j AS (SELECT d.doc_id, CAST(e.label AS VARCHAR) AS actual, CAST(b.cls_id AS VARCHAR) AS base_category,
             b.conf AS base_confidence, kw.kw_category, kw.kw_score, kw.kw_matches
      FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN base b ON b.vec_id = d.doc_id
      JOIN kw ON kw.id = d.doc_id),
r AS (SELECT *, CASE WHEN base_category IS NULL THEN CASE WHEN kw_category IS NULL THEN 7 ELSE 6 END
                     WHEN kw_category IS NULL THEN 1 WHEN kw_category = base_category THEN 2
                     WHEN kw_score >= 3 AND base_confidence < 0.45 THEN 3
                     WHEN kw_score >= 2 AND base_confidence < 0.25 THEN 4 ELSE 5 END AS rule FROM j)
SELECT doc_id, actual, base_category, base_confidence, kw_category, kw_score, rule,
       CASE WHEN rule IN (3, 4, 6) THEN kw_category WHEN rule = 7 THEN 'unclassified' ELSE base_category END AS category,
       coalesce(base_confidence, 0) AS confidence,
       CASE rule WHEN 6 THEN 'keyword_only' WHEN 7 THEN 'none' WHEN 2 THEN 'agreement' WHEN 3 THEN 'hybrid_strong' WHEN 4 THEN 'hybrid_assisted' ELSE 'model' END AS method,
       CASE WHEN rule IN (2, 3, 4, 6) THEN kw_matches ELSE '' END AS matched_keywords
FROM r"""

LOG = f"""(SELECT h.doc_id, d.text AS complaint, h.category, h.confidence, h.method, e.ts AS timestamp
          FROM ({HYBRID}) h JOIN events e ON e.event_id = h.doc_id JOIN documents d ON d.doc_id = h.doc_id)"""


SQL.update({
    "softmax_argmax": f"""
WITH {CENTROID}
SELECT e.vec_id, CAST(e.label AS VARCHAR) AS label, CAST(b.cls_id AS VARCHAR) AS base_category,
       round(b.conf, {R}) AS confidence, round(b.psum, {R}) AS prob_sum
FROM embeddings e JOIN base b ON b.vec_id = e.vec_id""",
    "top3_classes": f"""
WITH {CENTROID}
SELECT vec_id, CAST(r AS INTEGER) AS rank, CAST(cls AS VARCHAR) AS label, round(p, {R}) AS prob,
       round(p * 100, 2) AS pct FROM rk WHERE r <= 3""",
    "hybrid_predict": f"""
SELECT doc_id, actual, base_category, round(base_confidence, {R}) AS base_confidence, kw_category, kw_score,
       rule, category, round(confidence, {R}) AS confidence, method, matched_keywords FROM ({HYBRID})""",
    "keyword_v1_decision": f"""
WITH {CENTROID},
v1 AS ({keyword_v1_sql(EMBED_LEXICON)})
SELECT d.doc_id, v1.kw1_category, v1.kw1_score,
       CASE WHEN v1.kw1_score > 0 THEN v1.kw1_category ELSE coalesce(CAST(b.cls_id AS VARCHAR), 'unclassified') END AS category,
       round(coalesce(b.conf, 0), {R}) AS confidence,
       CASE WHEN v1.kw1_score > 0 THEN 'keyword_override' WHEN b.cls_id IS NULL THEN 'none' ELSE 'model' END AS method
FROM documents d LEFT JOIN base b ON b.vec_id = d.doc_id JOIN v1 ON v1.id = d.doc_id""",
    "hybrid_comparison": f"""
SELECT model, accuracy, precision, recall, macro_f1 FROM (
SELECT * FROM ({summary_sql(f"SELECT actual, base_category AS predicted FROM ({HYBRID}) WHERE actual IS NOT NULL", model="base", digits=4)})
UNION ALL
SELECT * FROM ({summary_sql(f"SELECT actual, category AS predicted FROM ({HYBRID}) WHERE actual IS NOT NULL", model="hybrid", digits=4)}))""",
    "hybrid_improvement": f"""
WITH t AS (SELECT * FROM ({summary_sql(f"SELECT actual, base_category AS predicted FROM ({HYBRID}) WHERE actual IS NOT NULL", model="base", digits=4)})
           UNION ALL
           SELECT * FROM ({summary_sql(f"SELECT actual, category AS predicted FROM ({HYBRID}) WHERE actual IS NOT NULL", model="hybrid", digits=4)}))
SELECT round((max(accuracy) FILTER (WHERE model = 'hybrid') - max(accuracy) FILTER (WHERE model = 'base')) * 100, 2)
         AS accuracy_points,
       round(max(macro_f1) FILTER (WHERE model = 'hybrid') - max(macro_f1) FILTER (WHERE model = 'base'), 4)
         AS macro_f1_gain FROM t""",
    "hybrid_confusion": confusion_sql(f"SELECT actual, category AS predicted FROM ({HYBRID}) WHERE actual IS NOT NULL"),
    "log_summary": f"""
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS DOUBLE) / (count(*) * CAST(100 AS DOUBLE)) AS avg_confidence_pct,
       count(*) FILTER (WHERE contains(method, 'hybrid')) * CAST(100 AS DOUBLE) / count(*) AS hybrid_share_pct
FROM {LOG}""",
    "top_category": f"""
SELECT category, CAST(count(*) AS BIGINT) AS n FROM {LOG} WHERE category IS NOT NULL
GROUP BY category ORDER BY n DESC, category LIMIT 1""",
    "log_distribution": f"""
SELECT category, CAST(count(*) AS BIGINT) AS n, round(count(*)::DOUBLE * 100 / sum(count(*)) OVER (), 4) AS share_pct
FROM {LOG} WHERE category IS NOT NULL GROUP BY category""",
    "recent_rows": f"""
SELECT doc_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, category, round(confidence, {R}) AS confidence,
       method, CASE WHEN length(complaint) > 28 THEN substr(complaint, 1, 28) || '…' ELSE complaint END AS preview,
       round(confidence * 100, 2) AS confidence_pct
FROM {LOG} ORDER BY timestamp DESC, doc_id LIMIT 10""",
})


# ---------------------------------------------------------------- near duplicates and template groups

def pairs_sql(threshold: float) -> str:
    """Naive all-pairs cosine over distinct texts (representative = smallest id), with copy counts."""
    return f"""
WITH d AS {LABELLED},
g AS (SELECT text, min(id) AS rid, count(*) AS n FROM d GROUP BY text),
nn AS (SELECT count(*) AS n FROM d),
{tf_ctes('(SELECT rid AS id, text FROM g)')},
dfr AS (SELECT tf.term, sum(g.n) AS df FROM tf JOIN g ON g.rid = tf.id GROUP BY tf.term),
raw AS (SELECT tf.id, tf.term, tf.tf * (ln((1 + nn.n) / (1 + dfr.df)) + 1) AS x FROM tf JOIN dfr ON dfr.term = tf.term, nn),
w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM raw),
p AS (SELECT a.id AS i, b.id AS j, sum(a.w * b.w) AS sim FROM w a JOIN w b ON a.term = b.term AND a.id < b.id
      GROUP BY ALL HAVING sum(a.w * b.w) >= CAST({threshold} AS DOUBLE)),
ht AS (SELECT DISTINCT id AS rid FROM w)
SELECT p.i, p.j, p.sim, gi.n AS n_i, gj.n AS n_j,
       (SELECT CAST(coalesce(sum(g.n * (g.n - 1) / 2), 0) AS BIGINT) FROM g JOIN ht ON ht.rid = g.rid) AS copy_pairs
FROM p JOIN g gi ON gi.rid = p.i JOIN g gj ON gj.rid = p.j"""


def groups_sql() -> str:
    return f"""
WITH RECURSIVE
pp AS ({pairs_sql(0.8)}),
d AS {LABELLED},
g AS (SELECT text, min(id) AS rid FROM d GROUP BY text),
{tf_ctes('(SELECT rid AS id, text FROM g)')},
ht AS (SELECT DISTINCT id AS rid FROM tf),
mem AS (SELECT d.id, g.rid FROM d JOIN g ON g.text = d.text JOIN ht ON ht.rid = g.rid WHERE d.id <> g.rid),
e AS (SELECT i AS a, j AS b FROM pp UNION ALL SELECT id, rid FROM mem),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(src, dst) AS (SELECT id, id FROM d UNION SELECT reach.src, e2.b FROM reach JOIN e2 ON e2.a = reach.dst)
SELECT src AS id, min(dst) AS group_id FROM reach GROUP BY src"""


SQL.update({
    "similar_pairs": f"SELECT i, j, round(sim, {R}) AS sim, n_i, n_j FROM ({pairs_sql(0.8)})",
    "threshold_sweep": f"""
WITH p AS ({pairs_sql(0.7)}),
c AS (SELECT any_value(copy_pairs) AS c FROM p),
t AS (SELECT unnest([0.70, 0.80, 0.90, 0.95]::DOUBLE[]) AS threshold)
SELECT t.threshold, CAST(count(p.i) AS BIGINT) AS text_pairs,
       CAST(coalesce(sum(p.n_i * p.n_j), 0) + coalesce((SELECT c FROM c), (SELECT CAST(coalesce(sum(x.n * (x.n - 1) / 2), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM documents GROUP BY text) x)) AS BIGINT) AS row_pairs,
       CAST(2 * (coalesce(sum(p.n_i * p.n_j), 0) + coalesce((SELECT c FROM c), 0)) AS BIGINT) AS ordered_pairs
FROM t LEFT JOIN p ON p.sim >= t.threshold GROUP BY t.threshold""",
    "pair_preview": f"""
WITH p AS (SELECT i, j, sim FROM ({pairs_sql(0.8)}) ORDER BY i, j LIMIT 10)
SELECT p.i, p.j, round(p.sim, 3) AS sim, a.text AS text_i, b.text AS text_j
FROM p JOIN documents a ON a.doc_id = p.i JOIN documents b ON b.doc_id = p.j""",
    "template_groups": f"SELECT id, group_id FROM ({groups_sql()})",
    "template_group_split": f"""
WITH tg AS ({groups_sql()}),
gs AS (SELECT DISTINCT group_id FROM tg),
r AS (SELECT group_id, row_number() OVER (ORDER BY md5(CAST(group_id AS VARCHAR) || ':42'), group_id) AS rn,
             count(*) OVER () AS G FROM gs)
SELECT tg.id, tg.group_id, CASE WHEN r.rn <= ceil(r.G * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM tg JOIN r ON r.group_id = tg.group_id""",
})

SQL["copy_groups"] = f"""
SELECT id, min(id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS n_copies FROM {LABELLED}
QUALIFY count(*) OVER (PARTITION BY text) > 1"""

SQL.update({
    "stream_scores": SQL["hybrid_predict"],
    "stream_counts": f"""
SELECT category, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS DOUBLE) / (count(*) * CAST(100 AS DOUBLE)) AS avg_confidence_pct,
       count(*) FILTER (WHERE contains(method, 'hybrid')) * CAST(100 AS DOUBLE) / count(*) AS hybrid_share_pct
FROM ({HYBRID}) GROUP BY category""",
})

SQL.update({
    "table_shape": f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(id) AS BIGINT) AS nonnull_id,
       CAST(count(text) AS BIGINT) AS nonnull_text, CAST(count(category) AS BIGINT) AS nonnull_category,
       CAST(3 AS INTEGER) AS n_cols FROM {LABELLED}""",
    "text_flags": f"""
SELECT CAST(count(*) FILTER (WHERE regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]')) AS BIGINT) AS n_devanagari,
       CAST(count(*) FILTER (WHERE contains(text, '?')) AS BIGINT) AS n_damaged,
       CAST(count(*) FILTER (WHERE text IS NULL OR {clean_sql('text')} = '') AS BIGINT) AS n_blank,
       CAST(count(DISTINCT text) AS BIGINT) AS distinct_texts FROM {LABELLED}""",
    "head": f"""
SELECT id, category, CASE WHEN length(text) > 28 THEN substr(text, 1, 28) || '…' ELSE text END AS preview
FROM {LABELLED} ORDER BY id LIMIT 5""",
    "error_totals": f"""
SELECT CAST(count(*) FILTER (WHERE kw_category IS NOT DISTINCT FROM category) AS BIGINT) AS correct,
       CAST(count(*) FILTER (WHERE kw_category IS DISTINCT FROM category) AS BIGINT) AS wrong
FROM ({keyword_best_sql(LANG_LEXICON)})""",
})


# ---------------------------------------------------------------- dictionaries of any size (brute force: every phrase in every text)

PHRASES_PER_CLASS = 12_500

DICTIONARY = f"""
tok AS (SELECT category, regexp_extract_all(lower(text), {q(TOKEN_PATTERN)}) AS t FROM {LABELLED} WHERE category IS NOT NULL),
ph AS (SELECT category, t[i] || ' ' || t[i + 1] AS keyword, count(*) AS n FROM tok, range(1, len(t)) r(i) GROUP BY ALL),
dict AS MATERIALIZED (
  SELECT (dense_rank() OVER (ORDER BY category) - 1)::INTEGER AS cat_order, category, keyword,
         row_number() OVER (PARTITION BY category ORDER BY n DESC, keyword) AS r FROM ph
  QUALIFY r <= {PHRASES_PER_CLASS}),
lex AS MATERIALIZED (SELECT cat_order::BIGINT * {PHRASES_PER_CLASS} + r - 1 AS kw_id, category, cat_order, keyword, 2 AS weight FROM dict)"""

PHRASE_BEST = f"""
WITH {DICTIONARY},
d AS MATERIALIZED (SELECT id, {norm_sql('text')} AS norm FROM {LABELLED}),
hits AS MATERIALIZED (SELECT d.id, lex.kw_id, lex.category AS kcat, lex.keyword, lex.weight FROM d JOIN lex ON contains(d.norm, lex.keyword)),
cs AS (SELECT id, kcat, sum(weight) AS score, count(*) AS n, string_agg(keyword, ', ' ORDER BY kw_id) AS matches FROM hits GROUP BY id, kcat),
top AS (SELECT id, max(score) AS best FROM cs GROUP BY id),
w AS (SELECT cs.id, count(*) AS n_at, min(cs.kcat) AS cat, min(cs.matches) AS matches
      FROM cs JOIN top ON cs.id = top.id AND cs.score = top.best GROUP BY cs.id)"""

PHRASE_V1 = f"""
WITH {DICTIONARY},
d AS MATERIALIZED (SELECT id, lower(text) AS low FROM {LABELLED}),
h AS MATERIALIZED (SELECT d.id, lex.category, count(*) AS n FROM d JOIN lex ON contains(d.low, lex.keyword) GROUP BY ALL),
sc AS (SELECT d.id, c.category, c.cat_order, coalesce(h.n, 0) AS score
       FROM d CROSS JOIN (SELECT DISTINCT category, cat_order FROM lex) c LEFT JOIN h ON h.id = d.id AND h.category = c.category)
SELECT id, arg_max(category, score * 1000 - cat_order) AS kw1_category, CAST(max(score) AS INTEGER) AS kw1_score FROM sc GROUP BY id"""

SQL.update({
    "phrase_dictionary": f"WITH {DICTIONARY} SELECT kw_id, category, cat_order, keyword FROM lex",
    "phrase_scores": f"{PHRASE_BEST} SELECT id, kcat AS category, CAST(score AS INTEGER) AS score, CAST(n AS INTEGER) AS n_matches FROM cs",
    "phrase_best": f"""{PHRASE_BEST}
SELECT d.id, CASE WHEN w.n_at = 1 THEN w.cat END AS kw_category, CAST(coalesce(top.best, 0) AS INTEGER) AS kw_score,
       CASE WHEN w.n_at = 1 THEN w.matches ELSE '' END AS kw_matches
FROM d LEFT JOIN top ON d.id = top.id LEFT JOIN w ON d.id = w.id""",
    "phrase_first_gen": PHRASE_V1,
    "phrase_first_gen_decision": f"""
SELECT v.id, kw1_category, kw1_score, CASE WHEN kw1_score > 0 THEN kw1_category ELSE b.kw_category END AS category,
       b.kw_score AS base_score, CASE WHEN kw1_score > 0 THEN 'keyword_override' ELSE 'model' END AS method
FROM ({PHRASE_V1}) v JOIN ({keyword_best_sql(LANG_LEXICON)}) b ON b.id = v.id""",
})


# ---------------------------------------------------------------- linear models on the full vocabulary

def linear_sql(assign: str, kind: str, steps: int) -> str:
    """(key, id, predicted) of the held-out rows: another solver for the same optimum.

    Accelerated gradient descent on the coefficients of the training rows, over the kernel matrix
    (row -1 is the intercept), with step sizes from row sums.
    """
    curve = 0.5 if kind == "lr" else 2
    resid = {"lr": "e / sum(e) OVER (PARTITION BY key, i) - (c = y)::INT",
             "svm": "-2 * (CASE WHEN c = y THEN 1 ELSE -1 END) * greatest(0, 1 - (CASE WHEN c = y THEN 1 ELSE -1 END) * z)"}[kind]
    pen = 0 if kind == "lr" else 1
    return f"""
WITH RECURSIVE d AS {LABELLED},
asg AS {assign},
{tf_ctes('d')},
lab AS (SELECT category, (dense_rank() OVER (ORDER BY category) - 1)::INT AS c FROM (SELECT DISTINCT category FROM d WHERE category IS NOT NULL)),
a AS MATERIALIZED (SELECT asg.key, asg.id, asg.side, lab.c AS y FROM asg JOIN d ON d.id = asg.id LEFT JOIN lab ON lab.category = d.category),
tt AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY term)::INT AS t, tf FROM tf),
n AS (SELECT key, count(*) AS n FROM a WHERE side = 'train' GROUP BY key),
idf AS (SELECT a.key, t, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf
        FROM tt JOIN a ON a.id = tt.id AND a.side = 'train' JOIN n ON n.key = a.key GROUP BY a.key, t),
raw AS (SELECT a.key, a.side, tt.id, t, tf * idf AS x FROM tt JOIN a ON a.id = tt.id JOIN idf USING (key, t)),
w AS MATERIALIZED (SELECT key, side, id, t, x / sqrt(sum(x * x) OVER (PARTITION BY key, id)) AS w FROM raw),
kern AS MATERIALIZED (SELECT l.key, l.id AS i, l.side, r.id AS j, sum(l.w * r.w) AS v
                      FROM w l JOIN w r ON l.key = r.key AND l.t = r.t AND r.side = 'train' GROUP BY ALL
                      UNION ALL SELECT key, id, side, -1, 1.0 FROM a),
ktr AS MATERIALIZED (SELECT key, i, j, v FROM kern WHERE side = 'train'),
lip AS MATERIALIZED (SELECT key, 1 + {2 * curve} * max(s) AS l, {2 * curve} * count(*) AS lb
                     FROM (SELECT k.key, i, sum(v) AS s FROM ktr k WHERE j >= 0 GROUP BY k.key, i) GROUP BY key),
it(k, key, id, c, a, v) AS (
  SELECT 0, a.key, a.id, lab.c, 0::DOUBLE, 0::DOUBLE FROM a, lab WHERE side = 'train'
  UNION ALL SELECT DISTINCT 0, a.key, -1, lab.c, 0::DOUBLE, 0::DOUBLE FROM a, lab
  UNION ALL (
  WITH z AS (SELECT it.key, ktr.i, it.c, sum(ktr.v * it.v) AS z FROM it JOIN ktr ON ktr.key = it.key AND ktr.j = it.id GROUP BY ALL),
  zy AS (SELECT z.*, a.y, exp(z - max(z) OVER (PARTITION BY z.key, z.i)) AS e FROM z JOIN a ON a.key = z.key AND a.id = z.i),
  r AS (SELECT key, i, c, {resid} AS r FROM zy),
  g AS (SELECT key, i AS id, c, r, 1 AS pen FROM r UNION ALL SELECT key, -1, c, sum(r), {pen} FROM r GROUP BY key, c),
  s AS (SELECT it.k, it.key, it.id, it.c, it.a, it.v - (g.pen * it.v + g.r) / CASE WHEN it.id = -1 THEN lip.lb ELSE lip.l END AS n
        FROM it JOIN g ON g.key = it.key AND g.id = it.id AND g.c = it.c JOIN lip ON lip.key = it.key)
  SELECT k + 1, key, id, c, n, n + k / (k + 3.0) * (n - a) FROM s WHERE k < {steps})),
fin AS (SELECT key, id, c, a FROM it WHERE k = {steps}),
m AS (SELECT kern.key, kern.i AS id, fin.c, sum(kern.v * fin.a) AS z FROM kern JOIN fin ON fin.key = kern.key AND fin.id = kern.j
      WHERE kern.side = 'test' GROUP BY ALL)
SELECT m.key, m.id, arg_max(lab.category, z) AS predicted FROM m JOIN lab ON lab.c = m.c GROUP BY m.key, m.id"""


HOLDOUT = f"(SELECT 0 AS key, id, split AS side FROM {SPLIT})"
FOLDS = f"""(SELECT f.key, k.id, CASE WHEN k.fold = f.key THEN 'test' ELSE 'train' END AS side
             FROM {KFOLD} k CROSS JOIN (SELECT range AS key FROM range(5)) f)"""
LINEAR_STEPS, CV_STEPS = 150, 80  # of the solver in SQL; the labels no longer change there
LR_PRED = f"SELECT p.id, l.category AS actual, p.predicted FROM ({linear_sql(HOLDOUT, 'lr', LINEAR_STEPS)}) p JOIN {LABELLED} l ON l.id = p.id"
SVM_PRED = f"SELECT p.id, l.category AS actual, p.predicted FROM ({linear_sql(HOLDOUT, 'svm', LINEAR_STEPS)}) p JOIN {LABELLED} l ON l.id = p.id"

SQL.update({
    "lr_predict": LR_PRED,
    "svm_predict": SVM_PRED,
    "lr_cv_macro_f1": f"""
WITH p AS (SELECT p.key, l.category AS actual, p.predicted FROM ({linear_sql(FOLDS, 'lr', CV_STEPS)}) p JOIN {LABELLED} l ON l.id = p.id),
pc AS ({per_class_sql('p', keyed=True)}),
f AS (SELECT key, avg(f1) AS macro_f1 FROM pc GROUP BY key)
SELECT round(avg(macro_f1), {R}) AS mean_macro_f1, round(stddev_pop(macro_f1), {R}) AS std_macro_f1,
       CAST(count(*) AS BIGINT) AS folds FROM f""",
    "lr_fit_report": f"""
WITH d AS {LABELLED}, s AS {SPLIT}, {tf_ctes('d')}
SELECT CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_test,
       (SELECT CAST(count(DISTINCT term) AS BIGINT) FROM tf JOIN s ON s.id = tf.id WHERE split = 'train') AS n_terms,
       CAST(count(DISTINCT category) AS BIGINT) AS n_classes, TRUE AS converged, TRUE AS objective_falls FROM s""",
    "linear_comparison": f"""
SELECT model, accuracy, precision, recall, macro_f1 FROM (
SELECT * FROM ({summary_sql(LR_PRED, model="logistic_regression", digits=4)})
UNION ALL
SELECT * FROM ({summary_sql(SVM_PRED, model="linear_svm", digits=4)})
UNION ALL
SELECT * FROM ({summary_sql(f"SELECT actual, predicted FROM ({NB_HOLDOUT})", model="naive_bayes", digits=4)}))""",
})


# ---------------------------------------------------------------- the ladder over a base model that reads the text

HYBRID_NB = f"""
WITH nb AS ({NB_HOLDOUT}),
kw AS ({keyword_best_sql(LANG_LEXICON)}),
j AS (SELECT nb.id, nb.actual, nb.predicted AS base_category, nb.confidence AS base_confidence, kw.kw_category, kw.kw_score, kw.kw_matches
      FROM nb JOIN kw ON kw.id = nb.id),
r AS (SELECT *, CASE WHEN kw_category IS NULL THEN 1 WHEN kw_category = base_category THEN 2
                     WHEN kw_score >= 3 AND base_confidence < 0.45 THEN 3
                     WHEN kw_score >= 2 AND base_confidence < 0.25 THEN 4 ELSE 5 END AS rule FROM j)
SELECT id, actual, base_category, round(base_confidence, {R}) AS base_confidence, kw_category, kw_score, rule,
       CASE WHEN rule IN (3, 4) THEN kw_category ELSE base_category END AS category, round(base_confidence, {R}) AS confidence,
       CASE rule WHEN 2 THEN 'agreement' WHEN 3 THEN 'hybrid_strong' WHEN 4 THEN 'hybrid_assisted' ELSE 'model' END AS method,
       CASE WHEN rule IN (2, 3, 4) THEN kw_matches ELSE '' END AS matched_keywords
FROM r"""

SQL.update({
    "hybrid_nb_predict": HYBRID_NB,
    "stream_nb_scores": HYBRID_NB,
    "hybrid_nb_comparison": f"""
SELECT model, accuracy, precision, recall, macro_f1 FROM (
SELECT * FROM ({summary_sql(f"SELECT actual, base_category AS predicted FROM ({HYBRID_NB})", model="base", digits=4)})
UNION ALL
SELECT * FROM ({summary_sql(f"SELECT actual, category AS predicted FROM ({HYBRID_NB})", model="hybrid", digits=4)}))""",
})


# ---------------------------------------------------------------- leak control

TEMPLATE_SPLIT = f"""
WITH RECURSIVE tg AS MATERIALIZED ({groups_sql()}),
rows AS MATERIALIZED (SELECT tg.id, tg.group_id, l.category FROM tg JOIN {LABELLED} l ON l.id = tg.id),
gr AS MATERIALIZED (SELECT group_id, arg_min(coalesce(category, ''), id) AS cls, count(*) AS size FROM rows GROUP BY group_id),
hist AS MATERIALIZED (SELECT cls, size, count(*) AS m, row_number() OVER (PARTITION BY cls ORDER BY size DESC) AS r FROM gr GROUP BY cls, size),
take AS (
  SELECT cls, 0::BIGINT AS r, 0::BIGINT AS size, 0::BIGINT AS take, floor(sum(size * m) * CAST(0.2 AS DOUBLE) + 0.5)::BIGINT AS rest FROM hist GROUP BY cls
  UNION ALL SELECT h.cls, h.r, h.size, least(h.m, t.rest // h.size), (t.rest - least(h.m, t.rest // h.size) * h.size)::BIGINT
  FROM take t JOIN hist h ON h.cls = t.cls AND h.r = t.r + 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY cls, size ORDER BY md5(CAST(group_id AS VARCHAR) || ':42'), group_id) AS rn FROM gr)
SELECT rows.id, rows.category, rows.group_id, CASE WHEN rk.rn <= take.take THEN 'test' ELSE 'train' END AS split
FROM rows JOIN rk ON rk.group_id = rows.group_id JOIN take ON take.cls = rk.cls AND take.size = rk.size"""


def leaks_sql(name: str, split: str) -> str:
    return f"""
WITH p AS MATERIALIZED (SELECT i, j FROM ({pairs_sql(0.8)})),
sides AS MATERIALIZED (SELECT text, min(l.id) AS rid, bit_or(CASE WHEN s.split = 'test' THEN 1 ELSE 2 END) AS s
          FROM ({split}) s JOIN {LABELLED} l ON l.id = s.id GROUP BY text)
SELECT {q(name)} AS split, count(*)::BIGINT AS n_pairs, count(*) FILTER (WHERE (a.s | b.s) = 3)::BIGINT AS pairs_across,
       (SELECT count(*) FROM sides WHERE s = 3)::BIGINT AS copies_across
FROM p JOIN sides a ON a.rid = p.i JOIN sides b ON b.rid = p.j"""


SQL.update({
    "template_balanced_split": TEMPLATE_SPLIT,
    "template_split_report": f"SELECT split, category, CAST(count(*) AS BIGINT) AS n FROM ({TEMPLATE_SPLIT}) GROUP BY ALL",
    "template_leaks": f"SELECT * FROM ({leaks_sql('stratified', f'SELECT id, split FROM {SPLIT}')}) UNION ALL SELECT * FROM ({leaks_sql('template_aware', TEMPLATE_SPLIT)})",
    "nb_template_report": class_report_sql(f"SELECT actual, predicted FROM ({nb_sql(f'(SELECT 0 AS key, id, split AS side FROM ({TEMPLATE_SPLIT}))')})"),
})


# ---------------------------------------------------------------- P7 of doubles, P5 from stored sketches

def _numbers(c: str) -> str:
    return f"""SELECT {q(c)} AS column_name, count({c}) AS count, round(avg({c}), {R}) AS mean, round(stddev_samp({c}), {R}) AS std,
       round(min({c})::DOUBLE, {R}) AS min, round(quantile_cont({c}::DOUBLE, 0.25), {R}) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), {R}) AS q50,
       round(quantile_cont({c}::DOUBLE, 0.75), {R}) AS q75, round(max({c})::DOUBLE, {R}) AS max FROM lineitem"""


SQL.update({
    "numeric_summary": " UNION ALL ".join(_numbers(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")),
    "distinct_sketches": """
SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT l_orderkey) AS distinct, TRUE AS within_bound FROM lineitem GROUP BY 1
UNION ALL SELECT 'all', count(*), count(DISTINCT l_orderkey), TRUE FROM lineitem""",
})


# ---------------------------------------------------------------- the log by day

DATED_LOG = f"""(SELECT l.*, l.timestamp::DATE AS day FROM {LOG} l
  WHERE l.timestamp::DATE NOT IN (SELECT d FROM (SELECT DISTINCT timestamp::DATE AS d FROM {LOG}) ORDER BY d LIMIT 1 OFFSET 1))"""

SQL.update({
    "dated_log_days": f"""SELECT day::VARCHAR AS day, count(*) AS n, sum(CAST(round(confidence * 10000) AS BIGINT))::BIGINT AS confidence_hundredths
FROM {DATED_LOG} GROUP BY day""",
    "dated_log_recent": f"""SELECT doc_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, category, round(confidence, {R}) AS confidence, method
FROM {DATED_LOG} ORDER BY dl_order DESC, doc_id LIMIT 10""".replace("dl_order", '"timestamp"'),
})

SQL["stream_totals_resumed"] = SQL["stream_counts"]
