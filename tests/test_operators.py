"""Operators against plain versions, and on nulls, ties, empty tables and wrong shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.functions import text as T
from millrace.operators import estimators as E
from millrace.operators import frame as O
from millrace.operators import graph, trees
from millrace.operators import machines as M
from millrace.sources import tables


def test_order_statistics(spark):
    for values in ([3.0, 1.0, None, 2.0, 2.0], [5.0], [None, None], list(map(float, range(1000)))):
        d = spark.createDataFrame([(v,) for v in values], "v double")
        known = sorted(v for v in values if v is not None)
        whole = known + [None] * (len(values) - len(known))
        assert O.median(d, "v").first().value == whole[len(values) // 2]
        for q in (0.0, 0.3, 1.0):
            assert O.quantile(d, "v", q).first().value == (known[min(int(q * len(values)), len(known) - 1)] if known else None)


def test_split_has_exact_sizes(spark):
    d = spark.range(100).withColumnRenamed("id", "k")
    assert {r.split: r["count"] for r in O.split(d, "k", (0.7, 0.3)).groupBy("split").count().collect()} == {"train": 70, "test": 30}
    assert {r.split: r["count"] for r in O.split(d, "k", (0.5, 0.25, 0.25)).groupBy("split").count().collect()} == {"train": 50, "test": 25, "eval": 25}
    assert O.part(O.split(d, "k", (1.0, 0.0)), "train").count() == 100
    with pytest.raises(ValueError):
        O.split(d, "k", (0.5, 0.4))


def test_frame(spark):
    d = spark.createDataFrame([(1, "b", None), (2, "a", 1.0), (3, None, 2.0), (4, "c", None)], "k long, s string, v double")
    assert O.drop_null_columns(d).columns == ["k"] and O.drop_null_columns(d, 2).columns == ["k", "s"]
    assert [tuple(r) for r in O.one_hot(d).orderBy("k").select("k", "s_b", "s_c").collect()] == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    assert O.first_non_null(d, "v", "k").first().value == 1.0
    assert O.push_row(d, (5, "z", 0.5)).count() == 5
    with pytest.raises(ValueError):
        O.push_row(d, (5,))
    with pytest.raises(ValueError):
        O.one_hot(d, most=2)
    assert [r.v for r in O.fill(d, "v", "median").orderBy("k").collect()] == [None, 1.0, 2.0, None]  # nulls sort last
    assert O.quantile(d.limit(0), "v", 0.5).first().value is None
    assert [r.v for r in d.select(C.to_unsigned(F.col("s")).alias("v")).collect()] == [None] * 4


def test_metrics(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    assert [tuple(r) for r in O.averaged(d, "y", "p", "precision", "none").orderBy("label").collect()] == [(0, 1.0), (1, 1 / 3), (2, None)]
    assert O.averaged(d, "y", "p", "recall", "macro").first().value == 0.5
    assert abs(O.averaged(d, "y", "p", "precision", "weighted").first().value - (1 + 3 / 3) / 4) < 1e-12
    assert [tuple(r.predicted) for r in O.confusion_matrix(d, "y", "p").orderBy("truth").collect()] == [(1, 1, 0), (0, 1, 0), (0, 1, 0)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1;-2;x\n2; n/a ;y\n")
    d = tables.read_csv(spark, str(tmp_path / "a.csv"), header=False, sep=";")
    assert d.dtypes == [("Column0", "bigint"), ("Column1", "double"), ("Column2", "string")]
    assert [tuple(r) for r in d.collect()] == [(1, -2.0, "x"), (2, None, "y")]
    (tmp_path / "b.csv").write_text("w\n86.4\n74\n")
    assert [r.w for r in tables.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [86.4, 74.0]
    (tmp_path / "c.csv").write_text("a,b\n")
    with pytest.raises(tables.NoData):
        tables.read_csv(spark, str(tmp_path / "c.csv"))
    with pytest.raises(tables.ShapeMismatch):
        tables.from_rows(spark, [(1,)], ["a", "b"])
    assert tables.from_rows(spark, [], ["a"]).count() == 0


def test_vectorizer(spark):
    d = spark.createDataFrame([(1, "The cat, the CAT's hat"), (2, "a cat sat"), (3, None), (4, "")], "id long, text string")
    assert {(r.id, r.term, r.tf) for r in T.Vectorizer().counts(d, "id", "text").collect()} == {(1, "cat", 2), (1, "hat", 1), (2, "cat", 1), (2, "sat", 1)}
    assert [r.term for r in T.vocabulary(d, "id", "text").orderBy("index").collect()] == ["cat", "hat", "sat"]
    assert {r.term for r in T.Vectorizer(max_features=1).fit(d, "id", "text").collect()} == {"cat"}
    assert {r.term for r in T.Vectorizer(max_df=0.25).fit(d, "id", "text").collect()} == {"hat", "sat"}
    assert T.Vectorizer(min_df=0.4).df_limits(max_df=0.9).min_df == 0.0
    w = {(r.id, r.term): r.weight for r in T.Vectorizer(norm="l2", sublinear=True).weights(d, "id", "text").collect()}
    cat, hat = (np.log10(2) + 1) * (np.log10(5 / 3) + 1), np.log10(5 / 2) + 1
    assert abs(w[1, "cat"] - cat / np.hypot(cat, hat)) < 1e-9
    with pytest.raises(ValueError):
        T.Vectorizer(min_df=0.5, max_df=0.5).fit(d, "id", "text")


def points(spark, n=120, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    x[: n // 3] += 4
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None)], "id long, v array<double>")


def test_range_join_and_density_clusters(spark):
    x, d = points(spark)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert {(r.a, r.b) for r in graph.range_join(d, "id", "v", 0.6).collect()} == set(zip(*np.nonzero(far <= 0.6)))
    near = far <= 0.6
    core = near.sum(1) >= 4
    label, n = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = n
                    stack += [k for k in np.flatnonzero(near[j] & core) if label[k] < 0]
            n += 1
    for i in np.flatnonzero(~core):
        label[i] = min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)
    got = {r.id: (r.core, r.label) for r in graph.dbscan(d, "id", "v", 0.6, 4).collect()}
    assert got == {**{i: (bool(core[i]), int(label[i])) for i in range(len(x))}, len(x): (False, -1)}
    assert graph.dbscan(d.limit(0), "id", "v", 0.6, 4).count() == 0


def test_trees_try_every_split(spark):
    x, _ = points(spark, 60, 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    d = spark.createDataFrame([(i, float(a), float(b), int(c), float(3 * a)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y int, t double")

    def entropy(v):
        p = np.bincount(v) / len(v)
        return -(p[p > 0] * np.log2(p[p > 0])).sum()

    def gain(f, t, v, impurity):
        l = x[:, f] <= t
        return impurity(v) - l.mean() * impurity(v[l]) - (~l).mean() * impurity(v[~l])

    for v, impurity, classes, column in ((y, entropy, [0, 1], "y"), (3 * x[:, 0], np.var, None, "t")):
        want = max((round(gain(f, t, v, impurity), 10), -f, -t) for f in (0, 1) for t in np.sort(x[:, f])[:-1])
        r = trees.best_splits(d, ["a", "b"], column, classes).first()
        assert (round(r.gain, 10), r.feature, r.threshold) == (want[0], "ab"[-want[1]], -want[2])
    tree = trees.grow(d, ["a", "b"], "y", "id", max_depth=8, min_samples=2)
    assert tree.predict(d).filter("prediction = y").count() == 60 and "<=" in tree.show()
    tree = trees.grow(d, ["a", "b"], "t", "id", "number", max_depth=6, min_samples=2)
    assert tree.predict(d).selectExpr("avg(abs(prediction - t)) e").first().e < 0.3


def test_vector_machines(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = np.where((x**2).sum(1) < 1.2, 1.0, -1.0)
    k = M.kernel(x, x, "rbf", 1.0)
    q, p = k * y[:, None] * y[None], -np.ones(80)
    a, b = M.solve(q, p, y, 5.0, 1e-6)
    margin = y * (k @ (a * y) + b)  # the conditions of the optimum
    assert abs(a @ y) < 1e-8 and (a >= 0).all() and (a <= 5).all()
    assert (margin[a < 1e-9] >= 1 - 1e-4).all() and (margin[a > 5 - 1e-9] <= 1 + 1e-4).all() and np.allclose(margin[(a > 1e-6) & (a < 5 - 1e-6)], 1, atol=1e-4)
    assert M.objective(q, p, a) < 0
    d = spark.createDataFrame([(i, v.tolist(), int(c > 0), float(v[0] ** 2)) for i, (v, c) in enumerate(zip(x, y))] + [(80, None, None, None)], "id long, v array<double>, y int, t double")
    found = M.predict_classes(d, "v", M.fit_classes(d, "id", "v", "y", c=5.0, kind="rbf"), 0)
    assert found.filter("prediction = y").count() >= 78
    three = d.withColumn("y", F.when(F.col("v")[0] > 0.5, 2).otherwise(F.col("y")))
    assert M.predict_classes(three, "v", M.fit_classes(three, "id", "v", "y", c=50.0, kind="rbf")).filter("prediction = y").count() >= 72
    machine = M.fit_numbers(d, "id", "v", "t", c=50.0, eps=0.05, kind="rbf")
    got = M.predict_numbers(d, "v", machine).selectExpr("max(abs(prediction - t)) e").first().e
    assert got < 0.5
    with pytest.raises(ValueError):
        M.fit_classes(d.filter("y = 1"), "id", "v", "y")
    for kind, want in (("linear", x @ x.T), ("poly", (x @ x.T + 1) ** 3), ("sigmoid", np.tanh(x @ x.T + 1))):
        assert np.allclose(M.kernel(x, x, kind), want)


def test_clusters_and_covariance(spark):
    x, d = points(spark)
    centres = E.kmeans_plus(d, "id", "v", 3)
    assert np.allclose(centres[0], x[0]) and np.allclose(centres[1], x[np.argmax(((x - x[0]) ** 2).sum(1))])
    own = E.squared_distances(x, centres).argmin(1)
    assert np.allclose(E.kmeans_step(d, "v", centres), [x[own == k].mean(0) for k in range(3)])
    assert {r.id: r.cluster for r in E.kmeans_assign(d, "id", "v", centres).collect()} == {**dict(enumerate(own.tolist())), len(x): None}
    mean, c = E.covariance(d, "v", 2)
    assert np.allclose(mean, x.mean(0)) and np.allclose(c, np.cov(x.T))


def test_bayes_and_votes(spark):
    rows = [("x", "a"), ("x", "a"), ("x", "b"), ("y", "b"), (None, "c")]
    w = {(r.term, r.y): r.weight for r in E.naive_bayes(spark.createDataFrame(rows, "y string, term string"), "y").collect()}
    assert set(w) == {(t, y) for t in "ab" for y in "xy"} and np.isclose(w["a", "y"], np.log10(1 / 3)) and np.isclose(w["a", "x"], np.log10(3 / 5))
    counts = spark.createDataFrame([(1, "a", 2), (2, "b", 1), (3, "new", 1)], "id long, term string, tf long")
    got = {r.id: r.prediction for r in E.naive_bayes_predict(counts, E.naive_bayes(spark.createDataFrame(rows, "y string, term string"), "y"), "id", "y").collect()}
    assert got == {1: "x", 2: "y"}
    near = spark.createDataFrame([(9, 1, 0.5), (9, 2, 0.6), (9, 3, 0.6), (9, 4, 0.7), (8, 1, 0.0), (8, 2, 1.0)], "query long, id long, distance double")
    labels = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q"), (4, "p")], "id long, y string")
    assert {r.query: r.prediction for r in E.vote(near, labels, "id", "y").collect()} == {9: "p", 8: "p"}
    assert {r.query: r.prediction for r in E.vote(near, labels, "id", "y", True).collect()} == {9: "p", 8: "q"}
    assert {r.query: r.prediction for r in E.vote(near, labels, "id", "y", custom=lambda l, f: l[F.size(l) - 1]).collect()} == {9: "p", 8: "q"}
    with pytest.raises(ValueError):
        O.nearest(labels, labels, 1, "id", "y", lambda a, b: F.lit(0.0), most=2)


def test_bayes_predicts_every_text_whatever_the_order_of_sums(spark):
    """Sums that differ from one reading to the next, as those of partial sums in another order do, lose no text."""
    import random

    jitter = F.udf(lambda: 1 + random.random(), "double").asNondeterministic()
    counts = spark.createDataFrame([(i, t) for i in range(50) for t in "ab"], "id long, term string").withColumn("tf", jitter())
    weights = spark.createDataFrame([(t, y, w) for t in "ab" for y, w in (("x", -1.0), ("y", -9.0))], "term string, y string, weight double")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert {(r.id, r.prediction) for r in E.naive_bayes_predict(counts, weights, "id", "y").collect()} == {(i, "x") for i in range(50)}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_nearest_equals_the_plain_expression(spark):
    """Blocks, ties of equal vectors, repeated and null ids, null and ragged vectors, components that are not finite."""
    rng = np.random.default_rng(3)
    x = [v.astype(np.float32).tolist() for v in np.concatenate([rng.normal(size=(300, 5)), np.ones((60, 5)), rng.normal(size=(40, 5)) * 1e-9 + 1])]
    x += [None, [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] + [1.0] * 4, [1.0, 2.0], [2.0, 2.0], [3e200] * 5, [4e200] * 5]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(7, x[8]), (7, x[7]), (None, x[9])], "id long, v array<double>").repartition(3)
    q = d.filter("id % 7 = 0 OR id > 395")
    same = lambda a, b: C.euclidean(a, b)  # another function: the plain expression
    for k in (1, 4, 500):
        got, want = ([tuple(map(str, r)) for r in O.nearest(d, q.dropDuplicates(["id"]).filter("id <> 7"), k, "id", "v", how).select("query", "rank", "distance", "id").orderBy("query", "rank").collect()] for how in (C.euclidean, same))
        assert got == want and got


def test_nearest_makes_no_row_for_a_pair(spark):
    """What is shuffled are k rows a query and task."""
    d = spark.range(3000, numPartitions=2).selectExpr("id", "array(sin(id), cos(id * id)) AS v")
    found = O.nearest(d, d.filter("id % 10 = 0"), 5, "id", "v", C.euclidean)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString()
    from millrace.operators import search

    assert search.candidates(d, d.filter("id % 10 = 0"), 5, "id", "v").count() == 2 * 300 * 5 and found.count() == 300 * 5


def test_quantiles_of_tied_values_send_few_of_them(spark, monkeypatch):
    """Equal values are counted, not sorted on the driver; NaN is the greatest."""
    from pyspark.sql.classic.dataframe import DataFrame

    sent, offset = [], DataFrame.offset
    monkeypatch.setattr(DataFrame, "offset", lambda self, n: (sent.append(n), offset(self, n))[1])
    d = spark.range(60000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("v"), (F.col("id") * 7919 % 60000).alias("w"), F.when(F.col("id") < 100, float("nan")).otherwise(F.col("id") % 3.0).alias("x"))
    known = sorted(i % 7 for i in range(60000) if i % 7)
    for q in (0.0, 0.25, 0.5, 0.75, 1.0):
        at = min(int(q * 60000), len(known) - 1)
        assert O.quantile(d, "v", q).first().value == known[at] and O.quantile(d, "w", q).first().value == min(int(q * 60000), 59999)
    assert np.isnan(O.quantile(d, "x", 1.0).first().value) and O.quantile(d, "x", 0.9).first().value == 2.0
    assert all(n <= 10000 for n in sent)


def test_weights_of_frequent_and_rare_terms(spark):
    """Repeated and null ids, terms in more and in less than one text of 1000; no exchange of counts but those of rare terms."""
    import math
    from collections import Counter

    rows = [(i % 2400 if i % 50 else None, f"often{i % 3} rare{i} rare{i} common word{i % 900}") for i in range(2500)]
    d = spark.createDataFrame(rows, "id long, text string").repartition(3)
    counts = Counter((i, t) for i, text in rows for t in text.split())
    df = Counter(t for _, t in counts)
    w = {(i, t): n * (math.log10(2501 / (df[t] + 1)) + 1) for (i, t), n in counts.items()}
    size = Counter()
    for (i, _), x in w.items():
        size[i] += x * x
    found = T.tfidf(T.term_counts(d, "id", "text"), d.agg(F.count("*").alias("n")), "id", norm="l2")
    got = {(r.id, r.term): r.weight for r in found.collect()}
    assert set(got) == set(w) and all(abs(got[k] - w[k] / math.sqrt(size[k[0]])) < 1e-9 for k in w)
    fixed = T.Vectorizer(vocabulary=("common", "rare7")).counts(d, "id", "text")
    assert {(r.id, r.term): r.tf for r in fixed.collect()} == {k: n for k, n in counts.items() if k[1] in ("common", "rare7")}
    plan = fixed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")  # looked up before counting
