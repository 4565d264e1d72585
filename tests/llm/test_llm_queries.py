"""The registered queries against their DuckDB oracles, and their column contracts."""

import duckdb
import pytest

from textlens.llm.catalog import QUERIES
from textlens.llm.oracle import SQL
from tools.oracle_check import TABLES, table_hash

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op2_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op3_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op5_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op6_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7_ngram_jaccard": {"doc_id", "n_shingles", "component_id"},
    "op8_extendible_sharding": {"doc_id", "shard"},
    "op9_decontamination": {"doc_id", "item_id"},
    "op10_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op11_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op12_importance_resampling": {"doc_id", "n_features", "weight", "score", "rank"},
    "op13_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    out = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in out.collect()]
    cur = con.execute(SQL[name])
    columns, expected = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(out.columns) == sorted(columns)
    assert len(rows) == len(expected)
    assert table_hash(out.columns, rows)[0] == table_hash(columns, expected)[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_with_its_columns(spark, name):
    out = QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(out.columns)
    table = "pages" if name.startswith("op1_") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert (out.count() == n) if name not in ("op5_best_fit_packing", "op9_decontamination") else out.count() >= 0


def test_all_are_registered():
    import __spark_entry__ as entry

    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
