"""Queries of fitted models: linear, logistic, vector machines, trees, clusters and components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import estimators as E
from millrace.operators import frame as O
from millrace.operators import machines as M
from millrace.operators import trees
from millrace.plans.base import query, r
from millrace.plans.vectors import three

query("ols_predict", "part", lambda d: E.linear_predict(d, ["p_size"], E.least_squares(d, ["p_size"], "p_retailprice", bias=True)).select("p_partkey", r("prediction", 3).alias("prediction")), "SELECT p_partkey, round(regr_intercept(p_retailprice, p_size) OVER () + regr_slope(p_retailprice, p_size) OVER () * p_size, 3) AS prediction FROM part")
_THREE = "CAST(embedding[1:3] AS DOUBLE[])"
query("logreg_score", "embeddings", lambda d: three(d).select("vec_id", r(C.sigmoid(C.dot(F.col("v"), F.array(F.lit(1.0), F.lit(-2.0), F.lit(0.5))) + 0.25), 6).alias("p")), f"SELECT vec_id, round(1 / (1 + exp(-(list_dot_product({_THREE}, [1.0::DOUBLE, -2.0, 0.5]) + 0.25))), 6) AS p FROM embeddings")


def labelled(d: DataFrame) -> DataFrame:
    return O.split(d.withColumn("is_0", (F.col("label") == 0).cast("int")), "vec_id", (0.7, 0.3))


def held_out(d: DataFrame, kind: str, label: str) -> DataFrame:
    """Accuracy on the rows that a model was not fitted on."""
    rows = labelled(d)
    found = E.classify(rows.withColumn("_label", F.when(F.col("split") == "train", F.col(label))), "embedding", "_label", kind)
    return found.groupBy("split").agg(F.count("*").alias("n"), r(F.avg((F.col("prediction") == F.col(label)).cast("double"))).alias("accuracy"))


query("logreg_binary", "embeddings", lambda d: held_out(d, "logistic", "is_0"), None)
query("logreg_multi", "embeddings", lambda d: held_out(d, "logistic", "label"), None)
query("svc_linear", "embeddings", lambda d: held_out(d, "svm", "is_0"), None)


def kernel_classes(d: DataFrame) -> DataFrame:
    rows = labelled(d)
    machines = M.fit_classes(O.part(rows, "train"), "vec_id", "embedding", "is_0", c=10.0, kind="rbf", gamma=1.0)
    return M.predict_classes(O.part(rows, "test"), "embedding", machines, 0).select("vec_id", "prediction")


query("svc_kernel", "embeddings", kernel_classes, None)
query("svr_fit", "part", lambda d: M.predict_numbers(d.select("p_partkey", F.array(F.col("p_size") / 50.0).alias("x")), "x", M.fit_numbers(d.select("p_partkey", F.array(F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 1000).alias("y")), "p_partkey", "x", "y", eps=0.05, sample=500, kind="rbf", gamma=2.0)).select("p_partkey", r("prediction").alias("prediction")), None)
_VECTORS = np.array([[0.1, 0.2, 0.3], [-0.1, 0.0, 0.2]])
_RBF = [f"exp(-0.5 * pow(list_distance({_THREE}, [{', '.join(f'{x}::DOUBLE' for x in v)}]), 2))" for v in _VECTORS.tolist()]
_MACHINE = M.Machine(1, _VECTORS, np.array([1.5, -2.0]), 0.4, {"kind": "rbf", "gamma": 0.5})
query("svc_score", "embeddings", lambda d: M.predict_classes(three(d), "v", [_MACHINE], 0).select("vec_id", r(F.col("score")[0], 6).alias("score"), "prediction"), f"SELECT vec_id, round(s, 6) AS score, CASE WHEN s >= 0 THEN 1 ELSE 0 END AS prediction FROM (SELECT vec_id, 1.5 * {_RBF[0]} - 2.0 * {_RBF[1]} + 0.4 AS s FROM embeddings)")
query("svr_score", "embeddings", lambda d: M.predict_numbers(three(d), "v", _MACHINE).select("vec_id", r("prediction", 6).alias("prediction")), f"SELECT vec_id, round(1.5 * {_RBF[0]} - 2.0 * {_RBF[1]} + 0.4, 6) AS prediction FROM embeddings")


def flat(d: DataFrame) -> DataFrame:
    return d.select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(4)])


NAMES = [f"x{k}" for k in range(4)]
_LONG = "(SELECT label AS y, unnest([0, 1, 2, 3]) AS f, unnest(CAST(embedding[1:4] AS DOUBLE[])) AS v FROM embeddings)"


def _split_sql(sums: list[str], impurity) -> str:
    names = [f"s{k}" for k in range(len(sums))]
    cells = f"(SELECT f, v, count(*) AS n, {', '.join(f'{x} AS {k}' for k, x in zip(names, sums))} FROM {_LONG} GROUP BY f, v)"
    run = f"(SELECT f, v, {', '.join(f'sum({c}) OVER (PARTITION BY f ORDER BY v) AS {c}l, sum({c}) OVER (PARTITION BY f) AS {c}t' for c in ['n', *names])} FROM {cells})"
    gain = f"round({impurity([f'{k}t' for k in names], 'nt')} - nl / nt * {impurity([f'{k}l' for k in names], 'nl')} - (nt - nl) / nt * {impurity([f'({k}t - {k}l)' for k in names], '(nt - nl)')}, 12)"
    return f"SELECT 'x' || f AS feature, round(v, 9) AS threshold, round(gain, 9) AS gain FROM (SELECT f, v, {gain} AS gain FROM {run} WHERE nl < nt) ORDER BY gain DESC, f, v LIMIT 1"


query("ctree_best_split", "embeddings", lambda d: trees.best_splits(flat(d), NAMES, "label", list(range(10))).select("feature", r("threshold", 9).alias("threshold"), r("gain", 9).alias("gain")),
      _split_sql([f"sum(CAST(y = {k} AS INT))::DOUBLE" for k in range(10)], lambda s, n: "(" + " + ".join(f"CASE WHEN {x} > 0 THEN -({x} / {n}) * log2({x} / {n}) ELSE 0 END" for x in s) + ")"))
query("rtree_best_split", "embeddings", lambda d: trees.best_splits(flat(d), NAMES, "label").select("feature", r("threshold", 9).alias("threshold"), r("gain", 9).alias("gain")), _split_sql(["sum(y)::DOUBLE", "sum(y * y)::DOUBLE"], lambda s, n: f"greatest({s[1]} / {n} - pow({s[0]} / {n}, 2), 0)"))
query("ctree_fit_predict", "embeddings", lambda d: trees.grow(flat(d), NAMES, "label", "vec_id", max_depth=4, min_samples=20).predict(flat(d)).select("vec_id", "prediction"), None)
query("rtree_fit_predict", "part", lambda d: trees.grow(d, ["p_size"], "p_retailprice", "p_partkey", "number", max_depth=4, min_samples=20).predict(d).select("p_partkey", r("prediction").alias("prediction")), None)
_DRAWS = "(SELECT tree, draw, CAST('0x' || substr(md5(tree || ':' || draw || ':0'), 1, 8) AS BIGINT) % 25 AS n_nationkey FROM (SELECT unnest(range(3)) AS tree) a, (SELECT unnest(range(25)) AS draw) b)"
query("rf_bootstrap", "nation", lambda d: trees.bootstrap(d, "n_nationkey", 3).select("tree", "draw", "n_nationkey"), f"SELECT CAST(tree AS INT) AS tree, CAST(draw AS BIGINT) AS draw, n_nationkey FROM {_DRAWS}")
query("ensemble_vote", "events", lambda d: trees.ensemble_vote(d.select("user_id", F.col("event_id").alias("tree"), F.col("event_type").alias("vote")), "user_id"), "SELECT user_id, event_type AS prediction FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1")
CENTRES = np.array([[0.1, 0.0, 0.0], [-0.1, 0.1, 0.0], [0.0, -0.1, 0.1]])
_FAR = "[" + ", ".join(f"list_distance({_THREE}, [{', '.join(f'{x}::DOUBLE' for x in c)}])" for c in CENTRES.tolist()) + "]"
_ASSIGNED = f"(SELECT vec_id, {_THREE} AS v, list_position({_FAR}, list_min({_FAR})) - 1 AS cluster FROM embeddings)"
query("kmeans_assign", "embeddings", lambda d: E.kmeans_assign(three(d), "vec_id", "v", CENTRES), f"SELECT vec_id, CAST(cluster AS INT) AS cluster FROM {_ASSIGNED}")


def centres(d: DataFrame, found: np.ndarray) -> DataFrame:
    return d.sparkSession.createDataFrame([(i, j, round(float(x), 6)) for i, c in enumerate(found) for j, x in enumerate(c)], "cluster int, axis int, value double")


query("kmeans_step", "embeddings", lambda d: centres(d, E.kmeans_step(three(d), "v", CENTRES)), f"SELECT CAST(cluster AS INT) AS cluster, axis, round(avg(x), 6) AS value FROM (SELECT cluster, unnest([0, 1, 2]) AS axis, unnest(v) AS x FROM {_ASSIGNED}) GROUP BY 1, 2")
_EMB = f"(SELECT vec_id, {_THREE} AS v FROM embeddings)"
query("kmeanspp_init", "embeddings", lambda d: centres(d, E.kmeans_plus(three(d), "vec_id", "v", 2)), f"WITH e AS {_EMB}, a AS (SELECT v FROM e ORDER BY vec_id LIMIT 1), b AS (SELECT e.v FROM e, a ORDER BY round(list_distance(e.v, a.v), 12) DESC, vec_id LIMIT 1) SELECT cluster, axis, round(x, 6) AS value FROM (SELECT 0 AS cluster, unnest([0, 1, 2]) AS axis, unnest(v) AS x FROM a UNION ALL SELECT 1, unnest([0, 1, 2]), unnest(v) FROM b)")
query("kmeans", "embeddings", lambda d: E.kmeans(d, "vec_id", "embedding", 10)[0], None)
query("pca_mean_center", "embeddings", lambda d: centred(d), f"SELECT vec_id, round(v[1] - avg(v[1]) OVER (), 6) AS a, round(v[2] - avg(v[2]) OVER (), 6) AS b FROM {_EMB}")
query("pca_cov", "embeddings", lambda d: spread(d), "SELECT i, j, round(covar_samp(x, y), 8) AS value FROM (SELECT i, j, v[i + 1] AS x, v[j + 1] AS y FROM " + _EMB + " e, (SELECT unnest(range(3))::INT AS i) a, (SELECT unnest(range(3))::INT AS j) b) GROUP BY 1, 2")
query("pca", "embeddings", lambda d: E.principal(d, "embedding", 2).select("vec_id", F.transform("projection", lambda x: F.round(F.abs(x), 4)).alias("size")), None)


def centred(d: DataFrame) -> DataFrame:
    mean, _ = E.covariance(three(d), "v", 3)
    return three(d).select("vec_id", r(F.col("v")[0] - float(mean[0]), 6).alias("a"), r(F.col("v")[1] - float(mean[1]), 6).alias("b"))


def spread(d: DataFrame) -> DataFrame:
    _, c = E.covariance(three(d), "v", 3)
    return d.sparkSession.createDataFrame([(i, j, round(float(c[i, j]), 8)) for i in range(3) for j in range(3)], "i int, j int, value double")


def searched(d: DataFrame) -> DataFrame:
    """Held-out squared error of ridge fits by penalty."""
    rows = O.split(d, "p_partkey", (0.7, 0.3))
    train, test = O.part(rows, "train"), O.part(rows, "test")

    def score(penalty: float) -> float:
        w = E.least_squares(train, ["p_size"], "p_retailprice", penalty, True)
        return -O.regression_metrics(E.linear_predict(test, ["p_size"], w), F.col("p_retailprice"), F.col("prediction")).first().mse

    found = E.grid_search({"penalty": [0.0, 1.0, 100.0]}, score)
    return d.sparkSession.createDataFrame([(i, o["penalty"], round(s, 3)) for i, (o, s) in enumerate(found)], "rank int, penalty double, score double")


query("grid_search", "part", searched, None)
