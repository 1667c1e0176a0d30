from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tarnlight.operators.components import connected_components
from tarnlight.operators.graph import communities
from tarnlight.operators.relational import numbered


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def run(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r.node: r.component for r in connected_components(df, "a", "b").collect()}


def test_chain_star_loop_null_repeat(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 120)] + [(5, 5), (None, 3), (7, None), (0, 1), (1, 0)]
    assert run(spark, edges) == brute(edges)


def test_empty(spark):
    assert run(spark, []) == {}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_any(spark, edges):
    assert run(spark, edges) == brute(edges)


def test_numbered_in_one_hot_group(spark):
    rows = [("hot", i * 7 % 101) for i in range(101)] + [("b", 3), ("b", 1), (None, 5)]
    got = {(r.g, r.v): r.n for r in numbered(spark.createDataFrame(rows, "g string, v long"), "g", ["v"]).collect() if r.g}
    assert all(got["hot", v] == v + 1 for v in range(101)) and got["b", 1] == 1 and got["b", 3] == 2


def test_communities(spark):
    edges = [(a, b) for g in ("abc", "xyz") for a in g for b in g if a < b]
    got = {r.node: r.label for r in communities(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert len({got[x] for x in "abc"}) == 1 and len({got[x] for x in "xyz"}) == 1 and got["a"] != got["x"]
