"""Estimators against plain numpy results and on separable rows."""

import numpy as np

from millrace.operators import estimators as E


def rows(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(300, 2))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    data = [(i, float(a), float(b), [float(a), float(b)], int(c), float(3 * a - 2 * b)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return x, spark.createDataFrame(data, "id long, a double, b double, v array<double>, y int, t double")


def test_least_squares(spark):
    x, d = rows(spark)
    t = 3 * x[:, 0] - 2 * x[:, 1]
    assert np.allclose(E.least_squares(d, ["a", "b"], "t"), [3, -2])
    assert np.allclose(E.least_squares(d, ["a", "b"], "t", 5.0), np.linalg.solve(x.T @ x + 5 * np.eye(2), x.T @ t))
    assert np.allclose(E.descent(d, ["a", "b"], "t", 0.0), [3, -2])
    assert np.allclose(E.descent(d, ["a", "b"], "t", 1e9), [0, 0])


def test_classifiers(spark):
    _, d = rows(spark)
    for kind in ("logistic", "tree", "forest", "svm"):
        assert E.classify(d, "v", "y", kind).filter("y = prediction").count() > 255, kind
    for kind in ("tree", "forest"):
        e = E.regress(d, ["a", "b"], "t", kind).selectExpr("avg(abs(t - prediction)) e").first().e
        assert e < 1.5, kind


def test_kmeans_and_components(spark):
    x, d = rows(spark)
    far = d.selectExpr("id", "transform(v, z -> z + 50 * y) v", "y")
    found, centres = E.kmeans(far, "id", "v", 2)
    assert len({(r.y, r.cluster) for r in found.join(far, "id").collect()}) == 2 and centres.shape == (2, 2)
    p = np.array([r.projection for r in E.principal(d, "v", 2).orderBy("id").collect()])
    c = x - x.mean(0)
    assert np.allclose(np.abs(p), np.abs(c @ np.linalg.svd(c, full_matrices=False)[2].T), atol=1e-8)


def test_grid_search():
    assert E.grid_search({"a": [1, 2], "b": [3]}, lambda a, b: a * b)[0] == ({"a": 2, "b": 3}, 6)
