from hypothesis import given, settings
from hypothesis import strategies as st

from textlens.operators import splits as D


def test_kfold_sizes(spark):
    df = spark.createDataFrame([(i, "a") for i in range(7)], "id long, c string")
    sizes = sorted((r["fold"], r["count"]) for r in D.kfold_assign(df, "id", "c").groupBy("fold").count().collect())
    assert [n for _, n in sizes] == [2, 2, 1, 1, 1]


def test_group_split_whole_groups(spark):
    rows = [(i, f"g{g}") for g, size in enumerate([1, 2, 3, 4, 5]) for i in range(g * 10, g * 10 + size)]
    out = D.group_split(spark.createDataFrame(rows, "id long, grp string"), "grp").collect()
    test_groups = {r["grp"] for r in out if r["split"] == "test"}
    assert len(test_groups) == 1
    by_group = {}
    for r in out:
        by_group.setdefault(r["grp"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by_group.values())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=60))
def test_stratified_disjoint_complete(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "id long, c string")
    out = D.stratified_split(df, "id", "c").collect()
    assert sorted(r["id"] for r in out) == list(range(len(labels)))
    for c in set(labels):
        n = labels.count(c)
        n_test = sum(1 for r in out if r["c"] == c and r["split"] == "test")
        assert n_test == int(n * 0.2 + 0.5)


def test_balanced_group_split(spark):
    """Against the same greedy assignment in plain Python."""
    import collections
    import hashlib
    import random

    from textlens.operators.splits import balanced_group_split

    rng = random.Random(1)
    rows, i = [], 0
    for g in range(120):
        c = rng.choice(["a", "b", None])
        for _ in range(rng.choice([1, 1, 1, 2, 3, 8, 40])):
            rows.append((i, g, c if rng.random() < 0.9 else "b"))
            i += 1
    rows += [(i + k, 999, "a") for k in range(800)]  # a group of more than half the rows
    df = spark.createDataFrame(rows, "id long, grp int, label string").repartition(5)
    got = {r["id"]: r["split"] for r in balanced_group_split(df, "id", "grp", "label").collect()}
    assert len(got) == len(rows)

    members = collections.defaultdict(list)
    for r in rows:
        members[r[1]].append(r)
    cls = {g: min(m)[2] or "" for g, m in members.items()}
    test = set()
    for c in set(cls.values()):
        own = [g for g in members if cls[g] == c]
        left = int(0.2 * sum(len(members[g]) for g in own) + 0.5)
        for size in sorted({len(members[g]) for g in own}, reverse=True):
            same = sorted((g for g in own if len(members[g]) == size), key=lambda g: (hashlib.md5(f"{g}:42".encode()).hexdigest(), g))
            k = min(len(same), left // size)
            test.update(same[:k])
            left -= k * size
        assert left == 0 or c == "a"
    assert {g for g in members if got[members[g][0][0]] == "test"} == test
    assert all(len({got[r[0]] for r in m}) == 1 for m in members.values())
    assert balanced_group_split(df.limit(0), "id", "grp", "label").count() == 0


def test_leaks_are_found(spark):
    from textlens.operators.splits import leaks

    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)], "id int, rid int")
    pairs = spark.createDataFrame([(1, 3), (3, 4), (4, 5)], "i int, j int")
    side = {1: "train", 2: "test", 3: "train", 4: "train", 5: "test"}
    split = spark.createDataFrame(list(side.items()), "id int, split string")
    assert tuple(leaks(split, "id", pairs, members).first()) == (3, 2, 1)
    clean = split.withColumn("split", split["split"].substr(100, 1))
    assert tuple(leaks(clean, "id", pairs, members).first()) == (3, 0, 0)
