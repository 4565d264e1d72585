"""Dictionaries of any size against brute force (every phrase in every text), in both physical forms."""

import collections
import random

import numpy as np
import pytest

from textlens.operators import keywords as K
from textlens.operators import phrases as P
from textlens.sources.lexicon import Lexicon, lexicon_frame, read_lexicon

ALPHABET = "ab cé漢🙂"


def weight(k):
    return max(1, min(3, len(k.split())))


def brute_hits(texts, entries, squeeze=True):
    """Per row: (kw_id, category, phrase, weight) of the phrases in it."""
    out = []
    for t in texts:
        norm = "" if t is None else " ".join(t.lower().split()) if squeeze else t.lower()
        out.append([(i, c, k.lower().strip() if squeeze else k.lower(), weight(k)) for i, (c, k) in enumerate(entries)
                    if t is not None and (k.lower().strip() if squeeze else k.lower()) in norm])
    return out


def brute_best(found):
    score, words = collections.Counter(), collections.defaultdict(list)
    for _, c, k, w in found:
        score[c] += w
        words[c].append(k)
    top = max(score.values(), default=0)
    winners = [c for c in score if score[c] == top]
    return (winners[0], top, tuple(words[winners[0]])) if top and len(winners) == 1 else (None, top, ())


def brute_first(found, entries):
    order = list(dict.fromkeys(c for c, _ in entries))
    n = collections.Counter(c for _, c, *_ in found)
    return max(order, key=lambda c: (n[c], -order.index(c))), max(n.values(), default=0)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choices(ALPHABET, k=n))
    entries = [(rng.choice("XYZ"), text(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 14]))) for _ in range(400)]
    entries += [("X", "Ab"), ("X", "ab"), ("Y", "ab"), ("Z", " é "), ("Y", "")]
    texts = [text(rng.choice([0, 1, 5, 30, 200])).upper() for _ in range(60)]
    texts += [None, "", " \n\t ", texts[7], texts[7], "a  b\nc", "x" * 3000 + entries[-3][1] + "x" * 3000]
    return entries, texts


@pytest.mark.parametrize("limit", [0, P.BROADCAST_BYTES])
def test_both_forms_equal_brute_force(spark, case, limit):
    entries, texts = case
    dictionary = lexicon_frame(spark, Lexicon(tuple(entries)))
    # repeated and null ids: rows are told apart by position
    rows = spark.createDataFrame([(i % 9 or None, t, "x") for i, t in enumerate(texts)], "id int, text string, keyword string")
    ids = [i % 9 or None for i in range(len(texts))]

    index = P.PhraseIndex.build(dictionary)
    assert 0 in index.sizes and 8 in index.sizes
    found = P.hits(rows, "text", index, ["id"], broadcast_bytes=limit)
    want = brute_hits(texts, entries)
    got = collections.Counter((r["id"], r["kw_id"], r["category"], r["keyword"], r["weight"]) for r in found.collect() if r["kw_id"] is not None)
    assert got == collections.Counter((i, *h) for i, hs in zip(ids, want) for h in hs)

    got = collections.Counter((r["id"], r["kw_category"], r["kw_score"], tuple(r["kw_matches"])) for r in P.best(found, ["id"]).collect())
    assert got == collections.Counter((i, *brute_best(h)) for i, h in zip(ids, want))

    per = collections.Counter()
    for i, h in zip(ids, want):
        for c in {x[1] for x in h}:
            mine = [x for x in h if x[1] == c]
            per[i, c, sum(x[3] for x in mine), len(mine)] += 1
    assert collections.Counter(tuple(r) for r in P.scores(found, ["id"]).select("id", "category", "score", "n_matches").collect()) == per

    index = P.PhraseIndex.build(dictionary, squeeze=False)
    found = P.hits(rows, "text", index, ["id"], broadcast_bytes=limit)
    want = brute_hits(texts, entries, squeeze=False)
    got = collections.Counter((r["id"], r["kw1_category"], r["kw1_score"]) for r in P.first_generation(found, ["id"], index).collect())
    assert got == collections.Counter((i, *brute_first(h, entries)) for i, h in zip(ids, want))


def test_equal_to_the_inline_lexicon(spark):
    lex = Lexicon.from_mapping({"en": ["the", "of the", "The", "and"], "de": ["der", "und", "in der", "the"]})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["Of  the\nthe", "und der", "the", "", None, "x", "Theodor in  der"])], "id int, text string")
    a = K.with_keyword_result(rows.filter("text IS NOT NULL"), "text", lex)
    b = P.best(P.hits(rows.filter("text IS NOT NULL"), "text", P.PhraseIndex.build(lexicon_frame(spark, lex)), ["id"]), ["id"])
    pick = lambda d: sorted((r["id"], r["kw_category"] or "", r["kw_score"], r["kw_matches"]) for r in d.collect())
    assert pick(a) == pick(b)
    flat = {"en": ["The", "the"], "de": ["der"]}
    v1 = Lexicon.from_mapping(flat)
    index = P.PhraseIndex.build(lexicon_frame(spark, v1), squeeze=False)
    a = K.with_first_generation(rows.filter("text IS NOT NULL"), "text", v1)
    b = P.first_generation(P.hits(rows.filter("text IS NOT NULL"), "text", index, ["id"]), ["id"], index)
    pick = lambda d: sorted((r["id"], r["kw1_category"], r["kw1_score"]) for r in d.collect())
    assert pick(a) == pick(b)


def test_grams_across_slices(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices(ALPHABET, k=300))
    everything = np.full(1 << (P.BITMAP_BITS - 6), -1, "i8").view("u8")
    whole = P._text_grams(everything, (1, 2, 3, 4, 6, 8))([text, None, ""])
    monkeypatch.setattr(P, "SLICE", 7)
    assert [x.tolist() for x in P._text_grams(everything, (1, 2, 3, 4, 6, 8))([text, None, ""])] == [x.tolist() for x in whole]
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8")
    assert set(P._hashes(codes, 8).tolist()) <= set(whole[0].tolist()) and not len(whole[1]) and not len(whole[2])


def test_a_phrase_is_keyed_by_a_gram_that_few_phrases_hold(spark):
    entries = [("a", f"common prefix {w}") for w in ("one", "two", "six")]
    table = P.PhraseIndex.build(lexicon_frame(spark, Lexicon(tuple(entries)))).table
    assert table.select("h").distinct().count() == 3  # none is keyed by a gram of the common part


def test_empty_dictionary_and_empty_table(spark):
    schema = "kw_id int, category string, cat_order int, keyword string"
    index = P.PhraseIndex.build(spark.createDataFrame([], schema))
    rows = spark.createDataFrame([(1, "text"), (2, None)], "id int, text string")
    found = P.hits(rows, "text", index, ["id"])
    assert {tuple(r) for r in P.best(found, ["id"]).select("id", "kw_category", "kw_score").collect()} == {(1, None, 0), (2, None, 0)}
    assert P.first_generation(found, ["id"], index).select("kw1_category").distinct().collect()[0][0] is None
    index = P.PhraseIndex.build(spark.createDataFrame([(0, "a", 0, "text"), (1, "b", 1, None)], schema))
    assert P.best(P.hits(rows.limit(0), "text", index, ["id"]), ["id"]).count() == 0
    assert {r["kw_id"] for r in P.hits(rows, "text", index, ["id"]).collect()} == {0, None}


def test_broadcast_form_shuffles_sums_only(spark, case):
    entries, _ = case
    index = P.PhraseIndex.build(lexicon_frame(spark, Lexicon(tuple(entries))))
    rows = spark.createDataFrame([(1, "a b")], "id int, text string")
    plan = P.scores(P.hits(rows, "text", index, ["id"]), ["id"])._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and len(shuffles) == 1


def test_lookup_across_slices(spark, case, monkeypatch):
    entries, texts = case
    index = P.PhraseIndex.build(lexicon_frame(spark, Lexicon(tuple(entries))))
    table = index.table.select("h", "at", "kw_id", "keyword").toArrow()
    whole = [x.tolist() for x in P._Lookup(table, index.bitmap, index.sizes)(texts)]
    assert sum(map(len, whole)) > 1000
    monkeypatch.setattr(P, "SLICE", 5)
    assert [x.tolist() for x in P._Lookup(table, index.bitmap, index.sizes)(texts)] == whole


def test_learned_dictionary_equals_plain_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["b", "a", None]), " ".join(rng.choices(["one", "two", "three", "x", "four"], k=rng.randint(0, 9)))) for _ in range(80)]
    n = collections.defaultdict(collections.Counter)
    for c, t in rows:
        w = [x for x in t.split() if len(x) > 1]
        n[c].update(f"{x} {y}" for x, y in zip(w, w[1:]))
    for k in (1, 3, 7, 100):
        want = [(o * k + r, c, o, p) for o, c in enumerate("ab") for r, (p, _) in enumerate(sorted(n[c].items(), key=lambda e: (-e[1], e[0]))[:k])]
        got = P.learned_dictionary(spark.createDataFrame(rows, "category string, text string"), "text", "category", k)
        assert [tuple(r) for r in got.orderBy("kw_id").collect()] == want


def test_dictionary_read_by_spark(spark, tmp_path):
    (tmp_path / "lexicon.json").write_text('{"b": ["two words", "x"], "a": ["x", "é"], "empty": []}', encoding="utf-8")
    got = [tuple(r) for r in read_lexicon(spark, str(tmp_path / "lexicon.json")).orderBy("kw_id").collect()]
    assert got == [(0, "b", 0, "two words"), (1, "b", 0, "x"), (2, "a", 1, "x"), (3, "a", 1, "é")]


def test_hits_in_rows_equal_brute_force_without_a_shuffle_of_hits(spark, case):
    entries, texts = case
    dictionary = lexicon_frame(spark, Lexicon(tuple(entries)))
    rows = spark.createDataFrame([(i % 9 or None, t) for i, t in enumerate(texts)], "id int, text string")
    ids = [i % 9 or None for i in range(len(texts))]
    for squeeze in (True, False):
        index = P.PhraseIndex.build(dictionary, squeeze)
        found = P.hits(rows, "text", index, ["id"], in_rows=True)
        want = brute_hits(texts, entries, squeeze)
        got = collections.Counter((r["id"], tuple((e["kw_id"], e["category"], e["keyword"], e["weight"]) for e in r["_found"])) for r in found.collect())
        assert got == collections.Counter((i, tuple(h)) for i, h in zip(ids, want))
        for out in (P.scores(found, ["id"]), P.best(found, ["id"]), P.first_generation(found, ["id"], index)):
            assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        if squeeze:
            got = collections.Counter((r["id"], r["kw_category"], r["kw_score"], tuple(r["kw_matches"])) for r in P.best(found, ["id"]).collect())
            assert got == collections.Counter((i, *brute_best(h)) for i, h in zip(ids, want))
            per = collections.Counter((i, c, sum(x[3] for x in h if x[1] == c), sum(x[1] == c for x in h)) for i, h in zip(ids, want) for c in {x[1] for x in h})
            assert collections.Counter(tuple(r) for r in P.scores(found, ["id"]).collect()) == per
        else:
            got = collections.Counter(tuple(r) for r in P.first_generation(found, ["id"], index).collect())
            assert got == collections.Counter((i, *brute_first(h, entries)) for i, h in zip(ids, want))
