from hypothesis import given, settings
from hypothesis import strategies as st

from textlens.operators.components import components


def naive(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for v in range(n):
        groups.setdefault(find(v), []).append(v)
    return {v: min(g) for g in groups.values() for v in g}


def run(spark, n, edges):
    vs = spark.createDataFrame([(i,) for i in range(n)], "id long")
    es = spark.createDataFrame(edges or [(0, 0)], "a long, b long")
    return {r["id"]: r["group_id"] for r in components(vs, es).collect()}


def test_fixture(spark):
    vs = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    es = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    got = {r["id"]: r["group_id"] for r in components(vs, es).collect()}
    assert [got[i] for i in range(1, 8)] == [1, 1, 1, 4, 5, 5, 7]


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=2, max_value=25).flatmap(
    lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=30))))
def test_matches_naive_closure(spark, case):
    n, edges = case
    assert run(spark, n, edges) == naive(n, edges)


def test_long_chain(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n - 1)]
    assert set(run(spark, n, edges).values()) == {0}
