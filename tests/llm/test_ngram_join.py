"""Near-duplicate components against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from textlens.llm import ngram_join as J


def shingles(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            c = len(a & b)
            if c and 100 * c >= 80 * (len(a) + len(b) - c):
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, s in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out.append((rows[i][0], len(s), min(rows[k][0] for k in seen)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 12, 40, 90, 300]))
        for _ in range(rng.choice([1, 2, 3, 8, 25])):
            t = list(base)
            for _ in range(rng.randint(0, len(t) // 40 + 1)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < .2:
                t += rng.choices(vocabulary, k=len(t) // 10)
            rows.append((len(rows), "  \n".join(t).upper() if rng.random() < .1 else " ".join(t)))
    passage = rng.choices(vocabulary, k=60)
    rows += [(1000 + i, " ".join(rng.choices(vocabulary, k=20) + passage + rng.choices(vocabulary, k=rng.randint(1, 20)))) for i in range(60)]
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "ONE"), (2005, "é É a"), (2006, "É é a"), (2007, "x " * 60_000)]


@pytest.mark.parametrize("group", [2_000, 7])
def test_components_equal_brute_force(docs_of, monkeypatch, group):
    monkeypatch.setattr(J, "GROUP", group)  # 7: keys are dealt to several tasks as pairs of blocks
    rows = corpus(group)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs_of(rows)).collect())
    assert got == brute(rows)


def test_without_the_shipped_ids(docs_of, monkeypatch):
    monkeypatch.setattr(J, "SHIP", 0)  # survivors meet their sets by a join
    rows = corpus(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs_of(rows)).collect())
    assert got == brute(rows)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, rng.integers(5, 200))
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > .08], rng.integers(0, 1 << 62, 2)])) for _ in range(rng.integers(1, 6))]
    marks = [(s.astype("uint64") >> np.uint64(16)).astype("uint16").tobytes() for s in sets]
    n = np.array([len(s) for s in sets])
    i, j = J.Tree(n, J.bitmaps(marks), np.arange(len(sets))).pairs()
    ok = J.close(i, j, n, marks)
    i, j = i[ok], j[ok]
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            c = len(np.intersect1d(sets[a], sets[b]))
            if 100 * c >= 80 * (n[a] + n[b] - c):
                assert (a, b) in got
    assert len(got) < len(sets) ** 2 / 20


def test_one_of_each_group_stays(docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (3, text), (3, "another text with the same id but no copy of it"), (9, text + " more"), (None, "alone"), (7, None)]
    d = docs_of(rows)
    out = J.one_per_group(d)
    assert out.columns == d.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"]) == sorted(
        [(3, text), (3, rows[2][1]), (7, None)], key=lambda r: (r[0], r[1] or ""))
    assert out.filter("doc_id IS NULL").count() == 1
    assert J.near_duplicates(docs_of([])).count() == 0


def test_repeated_rows_stay_once(docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(None, text)] * 40 + [(None, text + " more")] * 5 + [(4, other)] * 3 + [(4, "short")] * 2 + [(8, other)] * 2 + [(6, "alone"), (7, None), (7, None)]
    d = docs_of(rows)
    out = J.one_per_group(d)
    assert out.columns == d.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    null = [t for i, t in got if i == 0]
    assert len(null) == 1 and null[0] in (text, text + " more")
    assert got[1:] == sorted([(4, other), (4, "short"), (6, "alone"), (7, ""), (7, "")])


def test_keys_with_the_same_sets_stay_once(spark):
    """Three keys over one group of sets, one of them with a further set, one key of a single component."""
    k = spark.createDataFrame([(t, s) for t in (1, 2, 3) for s in (10, 11, 12)] + [(4, s) for s in (10, 11, 12, 13)] + [(5, 10), (5, 14)],
                              "token long, sid long")
    comp = spark.createDataFrame([(10, 10), (11, 11), (12, 10), (13, 13), (14, 10)], "sid long, comp long")
    full = spark.createDataFrame([(s, 5, bytearray(b"ab")) for s in range(10, 15)], "sid long, n int, marks binary")
    got = {}
    for r in J._members(k, comp, full).collect():
        got.setdefault(r["token"], set()).add(r["sid"])
    assert sorted(map(sorted, got.values())) == [[10, 11, 12], [10, 11, 12, 13]]


def test_sets_are_read_by_sid_without_a_shuffle(docs_of, monkeypatch):
    kept = []
    monkeypatch.setattr(J, "links", lambda full, links=J.links: kept.append(full) or links(full))
    text = " ".join(f"w{i}" for i in range(50))
    assert J.near_duplicates(docs_of([(1, text), (2, text + " more"), (3, "alone")])).count() == 3
    by_sid = kept[0].groupBy("sid").count()
    assert "Exchange" not in by_sid._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_mark_are_not_shuffled(spark, docs_of, monkeypatch):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, f"alone {i}") for i in range(20)] + [(30, text), (31, text + " more"), (32, text), (32, text), (None, "alone 3"), (33, None)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J.one_per_group(docs_of(rows))
        parts = out._jdf.queryExecution().sparkPlan().children()
        assert parts.size() == 3
        assert "SortMergeJoin" not in parts.apply(0).toString() and "SortMergeJoin" in parts.apply(1).toString()
        got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(got) == 22 and (30, text) in got and not {31, 32} & {i for i, _ in got}
    monkeypatch.setattr(J, "SLOTS", 1)  # a bitmap that many rows hit by chance
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in J.one_per_group(docs_of(rows)).collect()) == got
