"""Rule ledger, extendible hashing and decontamination on small cases."""

import collections
import itertools
import random
import re

from textlens.llm import decontaminate as D
from textlens.llm import quality_rules as Q
from textlens.llm import sharding


def repeat(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    return len({i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for k in range(3)})


def test_ledger_measures_and_edge_rows(docs_of):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 30)))) for i in range(300)]
    rows += [(500, None), (501, ""), (501, ""), (502, "a b a b a b"), (503, "x\n\nx\n \nx \ny"), (504, "word " * 50_000), (None, "# $ a")]
    got = collections.defaultdict(list)
    for r in Q.ledger(docs_of(rows)).collect():
        got[r["doc_id"]].append(r)
    for i, t in rows:
        assert {r["n_repeat_words"] for r in got[i]} == {repeat(t or "")}, (i, t)
    assert got[500][0]["n_words"] == 0 and len(got[501]) == 2 and got[503][0]["n_dup_lines"] == 1 and got[None][0]["n_symbols"] == 2
    assert Q.ledger(docs_of([])).count() == 0


def test_policies_and_ablation(docs_of):
    good = " ".join("word" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(80))
    rows = [(1, good), (2, "few words"), (3, " ".join(["a b c"] * 30)), (4, good + " #" * 20), (5, "#" * 40)]
    led = Q.ledger(docs_of(rows))
    kept = {v: {r["doc_id"] for r in Q.apply_policy(led, v).filter("kept").collect()} for v in Q.POLICIES}
    assert kept["base"] == {1, 4} and kept["v1"] == {1} and kept["v2"] == {1}
    back = {r["rule"]: (r["failed"], r["only_this"]) for r in Q.ablation(led, "v1").collect()}
    assert back["symbols"] == (2, 1) and back["few_words"] == (2, 1)
    d = docs_of(rows)
    assert [tuple(r) for r in Q.kept_documents(d).collect()] == [tuple(d.collect()[0])]


def test_shards_fit_and_split_only_where_needed(docs_of, tmp_path):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(600)] + [(900, "y" * 5000), (None, "z"), (None, None), (901, "same"), (901, "same")]
    out = sharding.assign(docs_of(rows), limit=2000).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    for s, rs in by.items():
        assert sum(r["bytes"] for r in rs) == rs[0]["shard_bytes"] and len(rs) == rs[0]["shard_docs"]
        assert rs[0]["shard_bytes"] <= 2000 or (len(rs) == 1 and rs[0]["oversize"])
        if s:  # the parent prefix would not have fitted
            assert sum(r["bytes"] for t, q in by.items() if t.startswith(s[:-1]) for r in q) > 2000
        assert not any(t != s and t.startswith(s) for t in by)
    sharding.write_shards(docs_of(rows, extra=False), str(tmp_path / "s"), limit=2000)
    assert docs_of([]).sparkSession.read.parquet(str(tmp_path / "s")).count() == len(rows)
    assert sharding.assign(docs_of([])).count() == 0
    assert {r["shard"] for r in sharding.assign(docs_of(rows[:5])).collect()} == {""}


def test_identical_rows_over_the_limit_are_marked(docs_of):
    out = sharding.assign(docs_of([(1, "x" * 100)] * 50), limit=1000).collect()
    assert len(out) == 50 and all(r["oversize"] for r in out)


def test_leaks_with_substitutions(spark, docs_of):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    items = [[word() for _ in range(rng.randint(16, 50))] for _ in range(20)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "too short")], "item_id long, text string")
    rows, want = [(0, None), (1, ""), (2, "one")], set()
    for i in range(60):
        w = list(rng.choice(items)) if i % 2 else []
        if w:
            want.add((100 + i, items.index(w)))
            for _ in range(len(w) // 12):
                w[rng.randrange(len(w))] = word()
        rows.append((100 + i, " ".join([word() for _ in range(rng.randint(0, 200))] + [x.upper() + "," for x in w] + [word() for _ in range(30)])))
    rows.append((100 + 1, "an unrelated row with the same id as a leak"))
    found = D.contaminated(D.overlaps(docs_of(rows), bench))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    kept = D.clean_documents(docs_of(rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert D.overlaps(docs_of([]), bench).count() == 0 and D.overlaps(docs_of(rows), bench.limit(0)).count() == 0


def best_stretch(equal):
    """Equal tokens of the first stretch with the best score."""
    score = hits = top = matched = 0
    for ok in equal:
        if score <= 0:
            score = hits = 0
        score, hits = score + (1 if ok else -2), hits + ok
        if score > top:
            top, matched = score, hits
    return matched


def test_every_accepted_substitution_has_a_hit():
    on = [[k for k, c in enumerate(m) if c == "1"] for m in D.MASKS]
    for n in range(6, 21):
        for away in (a for r in range(6) for a in itertools.combinations(range(n), r)):
            equal = [i not in away for i in range(n)]
            matched = best_stretch(equal)
            if matched >= min(D.MIN_MATCHED, n) and matched >= D.MIN_SHARE * n:
                assert any(all(equal[i + k] for k in ks) for m, ks in zip(D.MASKS, on) for i in range(n - len(m) + 1)), (n, away)


def test_leaks_of_short_items(spark, docs_of):
    item = {n: [f"t{n}x{i}" for i in range(n)] for n in (5, 6, 7, 8, 15)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in item.items()], "item_id long, text string")
    spot = ["other" if i in (1, 6, 10) else w for i, w in enumerate(item[15])]
    part = item[7][:6] + ["other"]
    rows = [(n, " ".join(["so", *w, "on"])) for n, w in item.items()] + [(20, " ".join(spot)), (21, " ".join(part))]
    found = {(r["doc_id"], r["item_id"]) for r in D.contaminated(D.overlaps(docs_of(rows), bench)).collect()}
    assert found == {(6, 6), (7, 7), (8, 8), (15, 15), (20, 15)}


def test_a_leak_takes_no_row_of_another_text(spark, docs_of, monkeypatch):
    import corpus_pipeline as P

    item = " ".join(f"t{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(P, "table", lambda *_: bench)
    rows = [(None, item), (None, "clean"), (None, None), (5, "so " + item), (5, "clean as well"), (6, "alone")]
    d = docs_of(rows)
    out = P.decontaminated(spark, d, "")
    assert out.columns == d.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in out.collect())) == [(0, ""), (0, "clean"), (5, "clean as well"), (6, "alone")]
