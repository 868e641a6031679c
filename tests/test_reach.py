"""Range joins and density clusters by tiles against plain versions: ties at the limit, copies, lengths, nulls, far places."""

import numpy as np
import pytest

from millrace.functions import columns as C
from millrace.operators import graph, reach


def distances(x):
    far = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        far += (x[:, None, j] - x[None, :, j]) ** 2
    return np.sqrt(far)


def clusters(x, eps, least):
    near = distances(x) <= eps
    core = (near.sum(1) >= least) & near.any(1)
    label, n = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = n
                    stack += [k for k in np.flatnonzero(near[j] & core) if label[k] < 0]
            n += 1
    for i in np.flatnonzero(~core):
        label[i] = min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)
    return {i: (bool(core[i]), int(label[i])) for i in range(len(x))}


def cases():
    r = np.random.default_rng(5)
    lattice = r.integers(0, 7, (150, 3)).astype(float)  # many distances equal the limit, many vectors are equal
    yield "lattice", lattice, 1.0, 7
    yield "far lattice", lattice + 1e9, 1.0, 7
    yield "line", r.integers(0, 400, (160, 1)).astype(float), 1.0, 3
    yield "plane of unequal density", r.normal(size=(250, 2)) ** 3, 0.15, 5
    yield "long vectors", np.repeat(r.normal(size=(6, 12)), 25, 0) + r.normal(size=(150, 12)) * 0.2, 1.0, 5
    yield "equal only", lattice, 0.0, 2
    yield "none", lattice, -1.0, 1
    yield "none, and no limit", lattice, -1.0, 0


@pytest.mark.parametrize("x, eps, least", [c[1:] for c in cases()], ids=[c[0] for c in cases()])
def test_density_clusters_equal_a_plain_version(spark, monkeypatch, x, eps, least):
    monkeypatch.setattr(graph, "range_join", None)  # no row for each pair in reach
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = clusters(x, eps, least)
    assert {r.id: (r.core, r.label) for r in graph.dbscan(d, "id", "v", eps, least).collect()} == want
    monkeypatch.setattr(graph, "components", None)
    assert {r.id: r.core for r in graph.cores(d, "id", "v", eps, least).collect()} == {i: core for i, (core, _) in want.items()}


def test_dense_rows_are_not_paired(spark, monkeypatch):
    """40,000 rows in reach of each other, half of them equal, are 1.6 billion pairs."""
    monkeypatch.setattr(graph, "range_join", None)
    d = spark.range(40000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN array(0D, 0D, 0D) WHEN id = 39999 THEN array(5D, 0D, 0D) ELSE array(id / 1e6, 0.01D, 0D) END AS v")
    got = graph.dbscan(d, "id", "v", 0.06, 5).groupBy("core", "label").count().collect()
    assert {(r.core, r.label): r["count"] for r in got} == {(True, 0): 39999, (False, -1): 1}


def test_density_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0]), (3, [-0.0]), (4, [1.0, None]), (5, None), (6, [nan, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [inf, 1.0]), (10, []), (11, [])]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: (r.core, r.label) for r in graph.dbscan(d, "id", "v", 0.5, 2).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (True, 1), 3: (True, 1), 10: (True, 2), 11: (True, 2), **{i: (False, -1) for i in range(4, 10)}}
    d = spark.createDataFrame([(None, [0.0]), ("b", [0.1]), ("a", [9.0]), ("c", [9.1])], "id string, v array<float>")
    assert sorted((str(r.id), r.core, r.label) for r in graph.dbscan(d, "id", "v", 0.5, 2).collect()) == [("None", True, 1), ("a", True, 0), ("b", True, 1), ("c", True, 0)]


def test_a_forest_links_what_a_plain_walk_links():
    r = np.random.default_rng(6)
    for n, w, eps in ((3000, 2, 0.02), (2000, 3, 0.08), (1500, 6, 0.35)):
        x, node = r.random((n, w)), np.arange(n)
        forest = reach.Forest(node, x, eps)
        got = np.array([forest._find(i) for i in range(n)])
        near, root = distances(x) <= eps, np.arange(n)
        while True:
            least = np.where(near, root[None], n).min(1)
            if (least == root).all():
                break
            root = least
        assert len(set(zip(got.tolist(), root.tolist()))) == len(set(got.tolist())) == len(set(root.tolist())) > 1
        assert len(forest.edges) == n - len(set(root.tolist()))


@pytest.mark.parametrize("x, eps", [c[1:3] for c in cases()], ids=[c[0] for c in cases()])
def test_range_join_equals_a_plain_version(spark, x, eps):
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    far = distances(x)
    df = graph.range_join(d, "id", "v", eps)
    assert dict(df.dtypes) == {"a": "int", "b": "int", "distance": "double"}
    assert sorted(map(tuple, df.collect())) == [(int(a), int(b), float(far[a, b])) for a, b in zip(*np.nonzero(far <= eps))]


def test_range_join_makes_no_row_for_a_pair_out_of_reach(spark):
    d = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.3, 0.4]), ("c", [0.0]), ("d", [0.4]), ("e", [None, 0.0]), ("f", None), (None, [9.0, 9.0]), ("g", [float("nan"), 0.0])], "id string, v array<float>")
    df = graph.range_join(d, "id", "v", 0.51)
    assert "Join" not in df._jdf.queryExecution().toString()
    got = sorted((str(r.a), str(r.b), round(r.distance, 6)) for r in df.collect())
    assert got == sorted([(i, i, 0.0) for i in ("a", "b", "c", "d", "None")] + [(*p, 0.5) for p in ("ab", "ba")] + [(*p, 0.4) for p in ("cd", "dc")])
    plain = {(r.a, r.b) for r in graph.range_join(d.filter("size(v) = 2"), "id", "v", 0.51, C.manhattan).collect()}
    assert plain == {("a", "a"), ("b", "b"), (None, None)}
