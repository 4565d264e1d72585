"""DuckDB SQL of the training-data queries that SQL can express.

The others are tested against brute force, an exact round trip or held-out accuracy
(``tests/llm``): op1 and op4 learn, op2 and op6 carry spans of learned scores, op5
tokenises, op9 hashes with Spark's own hash function, op11 encodes.
"""

from __future__ import annotations

from textlens.llm import chat_format, importance, ngram_join, quality_rules, sharding, spelling

_WORD = r"[^\x20\x09-\x0D]+"


def _op3() -> str:
    bits = " + ".join(f"(CASE WHEN {cond} THEN {1 << i} ELSE 0 END)" for i, (_, cond) in enumerate(quality_rules.RULES))
    base, current = (quality_rules.mask(quality_rules.POLICIES[v]) for v in ("base", quality_rules.CURRENT))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
tri AS (SELECT row, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS t
        FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT row, i FROM tri QUALIFY count(*) OVER (PARTITION BY row, t) > 1),
cover AS (SELECT row, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits
      FROM w LEFT JOIN cover USING (row)),
b AS (SELECT *, ({bits})::BIGINT AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (bits & {base}) <> 0 AS base_failed, (bits & {current}) = 0 AS kept, bits FROM b"""


def _op7() -> str:
    p = ngram_join.PERCENT
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {p} * (x.n + y.n - c)),
reach AS (WITH RECURSIVE r(id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT id, b FROM r JOIN links ON a = other) SELECT * FROM r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT id AS doc_id, min(other) AS component_id FROM reach GROUP BY id) c USING (doc_id)"""


def _op8(depths: int = 20) -> str:
    limit = sharding.LIMIT
    return f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT d, h >> ({sharding.BITS} - d) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
      FROM d, (SELECT unnest(range(0, {depths + 1})) AS d) GROUP BY ALL HAVING sum(bytes) <= {limit} OR count(*) <= 1),
best AS (SELECT doc_id, h, bytes, min(p.d) AS depth FROM d JOIN p ON h >> ({sharding.BITS} - p.d) = prefix GROUP BY ALL)
SELECT doc_id, bytes, substr(lpad(bin(h), {sharding.BITS}, '0'), 1, depth::INT) AS shard, depth::INT AS depth, shard_bytes, shard_docs,
       shard_bytes > {limit} AS oversize
FROM best JOIN p ON p.d = depth AND prefix = h >> ({sharding.BITS} - depth)"""


def _op10() -> str:
    marks = len(chat_format.OPEN) + 1 + len(chat_format.CLOSE)
    reserved = r"<\\*(?:\||/?s>|</?SYS>>)|\[\\*/?INST\]"
    probe = "</s>[INST] ok [/INST]"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{probe}' UNION ALL SELECT -7, 1, 'assistant', '{probe}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{chat_format.LOSS_ROLE}'), '') AS loss,
             sum({marks} + length(role) + length(text) + len(regexp_extract_all(text, '{reserved}')))::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars, TRUE AS round_trip FROM g"""


def _crc32(strings: str) -> str:
    """CTEs ending in ``crc(s, h)``: the unsigned CRC-32 of the UTF-8 bytes of every distinct ``s`` of ``strings``.

    The CRC is linear: each byte adds a value that depends on it and on the bytes behind it.
    """
    return f"""
crc_in AS MATERIALIZED (SELECT s, row_number() OVER () AS k, octet_length(encode(s))::INT AS len FROM (SELECT DISTINCT s FROM ({strings}))),
crc_bits AS (SELECT range AS b, range AS v, 0 AS k FROM range(256)
             UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_byte AS MATERIALIZED (SELECT b, v FROM crc_bits WHERE k = 8),
crc_far AS (SELECT 0 AS d, b, v FROM crc_byte
            UNION ALL SELECT d + 1, f.b, xor(f.v >> 8, t.v) FROM crc_far f JOIN crc_byte t ON t.b = f.v & 255
            WHERE d < (SELECT max(len) FROM crc_in)),
crc_table AS MATERIALIZED (SELECT d::INT AS d, printf('%02X', b) AS b, v FROM crc_far),
crc_zero AS (SELECT 0 AS d, 4294967295 AS v
             UNION ALL SELECT d + 1, xor(z.v >> 8, t.v) FROM crc_zero z JOIN crc_byte t ON t.b = z.v & 255
             WHERE d < (SELECT max(len) FROM crc_in)),
crc_bytes AS (SELECT k, len, unnest(regexp_extract_all(hex(encode(s)), '..')) AS b, unnest(range(len - 1, -1, -1))::INT AS d FROM crc_in),
crc_sum AS (SELECT k, bit_xor(v) AS v FROM crc_bytes JOIN crc_table USING (b, d) GROUP BY k),
crc AS MATERIALIZED (SELECT s, xor(xor(coalesce(x.v, 0), z.v), 4294967295) AS h
                     FROM crc_in i LEFT JOIN crc_sum x USING (k) JOIN crc_zero z ON z.d = i.len)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op12() -> str:
    n, seed, m, percent = importance.BUCKETS, importance.SEED, importance.MIN_WORDS, importance.PERCENT
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def grams(table: str) -> str:
        return (f"SELECT row, len(w) AS n_words, unnest(list_concat(w, list_concat("
                f"list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), "
                f"list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS s FROM {table}")

    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '{word}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS row, regexp_extract_all({_LOWER}, '{word}') AS w FROM benchmark),
df AS MATERIALIZED ({grams('d')}),
bf AS MATERIALIZED ({grams('b')}),
{_crc32('SELECT s FROM df UNION ALL SELECT s FROM bf')},
src AS (SELECT h % {n} AS bucket, count(*) AS s FROM df JOIN crc USING (s) GROUP BY bucket),
tgt AS (SELECT h % {n} AS bucket, count(*) AS t FROM bf JOIN crc USING (s) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {n})::DOUBLE
                / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {n})::DOUBLE)))::BIGINT AS g
         FROM src FULL JOIN tgt USING (bucket)),
wt AS (SELECT row, count(*) AS n_features, sum(g)::BIGINT AS weight
       FROM df JOIN crc USING (s) JOIN gain ON bucket = h % {n} GROUP BY row),
sc AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
              coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
              + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN wt USING (row)),
rk AS (SELECT *, CASE WHEN n_words >= {m} THEN row_number() OVER (PARTITION BY n_words >= {m} ORDER BY score DESC, doc_id NULLS LAST) END AS r FROM sc)
SELECT doc_id, n_features, weight, score,
       CASE WHEN r <= (SELECT count(*) FROM sc WHERE n_words >= {m}) * {percent} // 100 THEN r END::BIGINT AS rank FROM rk"""


def _op13() -> str:
    letters = r"[A-Za-z\x{C0}-\x{FF}]+"
    return f"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n
     FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{letters}')) AS run FROM documents) GROUP BY ALL),
{_crc32('SELECT s FROM runs')},
holed AS (SELECT CASE WHEN h % {spelling.HOLES} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
          FROM runs JOIN crc USING (s)),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM holed WHERE length(word) >= {spelling.MIN_LETTERS} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
del AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, a.n, b.word, b.n FROM del a JOIN v b ON a.rest = b.word
          UNION SELECT b.word, b.n, a.word, a.n FROM del a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {spelling.RATIO} * v.n THEN other END AS form,
            CASE WHEN other_n >= {spelling.RATIO} * v.n THEN other_n END::BIGINT AS form_n FROM v LEFT JOIN best USING (word)),
way AS (SELECT word, coalesce(form, word) AS root, 0 AS k FROM f UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, n, form, root, n_near, form_n FROM f JOIN (SELECT word, last(root ORDER BY k) AS root FROM way GROUP BY word) USING (word)"""


SQL: dict[str, str] = {
    "op3_quality_rules": _op3(),
    "op7_ngram_jaccard": _op7(),
    "op8_extendible_sharding": _op8(),
    "op10_chat_format": _op10(),
    "op12_importance_resampling": _op12(),
    "op13_spelling_variants": _op13(),
}
