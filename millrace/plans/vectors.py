"""Queries of vector functions, distances, kernels and joins by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import estimators as E
from millrace.operators import frame as O
from millrace.operators import graph
from millrace.plans.base import query, r

FOUR_SQL = "CAST(embedding[1:4] AS DOUBLE[])"
_LIT = "[0.1::DOUBLE, 0.2, 0.3, 0.4]"


def first() -> Column:
    return F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)])


def four() -> Column:
    return F.slice("embedding", 1, 4)


for _name, _spark, _sql in (
    ("dist_euclid", lambda: C.euclidean(four(), first()), f"list_distance({FOUR_SQL}, {_LIT})"),
    ("dist_manhattan", lambda: C.manhattan(four(), first()), f"list_sum(list_transform(list_zip({FOUR_SQL}, {_LIT}), lambda x: abs(x[1] - x[2])))"),
    ("kernel_linear", lambda: C.linear_kernel(four(), first()), f"list_dot_product({FOUR_SQL}, {_LIT})"),
    ("kernel_sigmoid", lambda: C.tanh_kernel(four(), first(), 0.5, 1.0), f"tanh(0.5 * list_dot_product({FOUR_SQL}, {_LIT}) + 1)"),
    ("norm_l1", lambda: C.norm(four(), 1), f"list_sum(list_transform({FOUR_SQL}, lambda x: abs(x)))"),
    ("norm_l2", lambda: C.norm(four(), 2), f"sqrt(list_dot_product({FOUR_SQL}, {FOUR_SQL}))"),
    ("outer_product", lambda: C.outer(F.transform(four(), lambda x: x.cast("double")), first())[1][2], "CAST(embedding[2] AS DOUBLE) * 0.3"),
):
    query(_name, "embeddings", lambda d, x=_spark: d.select("vec_id", r(x(), 6).alias("v")), f"SELECT vec_id, round({_sql}, 6) AS v FROM embeddings")
query("vec_argmax", "embeddings", lambda d: d.select("vec_id", C.argmax(F.col("embedding")).alias("most"), C.argmin(F.col("embedding")).alias("least")), "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS most, CAST(list_position(embedding, list_min(embedding)) - 1 AS INT) AS least FROM embeddings")
query("enet_threshold", "customer", lambda d: d.select("c_custkey", r(C.elastic_threshold(F.col("c_acctbal"), 100.0, 0.25)).alias("v")), "SELECT c_custkey, round(CASE WHEN c_acctbal < -25 THEN c_acctbal + 25 WHEN c_acctbal > 25 THEN c_acctbal - 25 ELSE 0.0 END / (1 + 100 * 0.75), 4) AS v FROM customer")


def gram(d: DataFrame) -> DataFrame:
    a, b = d.filter("vec_id < 20").select(F.col("vec_id").alias("a"), four().alias("va")), d.filter("vec_id < 30").select(F.col("vec_id").alias("b"), four().alias("vb"))
    both = a.join(F.broadcast(b), F.lit(True))  # 20 by 30 rows
    return both.select("a", "b", r(C.linear_kernel(F.col("va"), F.col("vb")), 6).alias("linear"), r(C.rbf(F.col("va"), F.col("vb"), 0.5), 6).alias("rbf"), r(C.polynomial(F.col("va"), F.col("vb"), 1.0, 2), 6).alias("poly"), r(C.tanh_kernel(F.col("va"), F.col("vb"), 0.5, 1.0), 6).alias("sigmoid"))


query("gram_matrix", "embeddings", gram, f"WITH e AS (SELECT vec_id, {FOUR_SQL} AS v FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.v, y.v), 6) AS linear, round(exp(-0.5 * pow(list_distance(x.v, y.v), 2)), 6) AS rbf, round(pow(list_dot_product(x.v, y.v) + 1, 2), 6) AS poly, round(tanh(0.5 * list_dot_product(x.v, y.v) + 1), 6) AS sigmoid FROM e x, e y WHERE x.vec_id < 20 AND y.vec_id < 30")
_THREE = "(SELECT vec_id, CAST(embedding[1:3] AS DOUBLE[]) AS v FROM embeddings)"


def three(d: DataFrame) -> DataFrame:
    return d.select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v"))


query("range_join", "embeddings", lambda d: graph.range_join(three(d), "vec_id", "v", 0.05).select("a", "b", r("distance", 6).alias("distance")), f"SELECT x.vec_id AS a, y.vec_id AS b, round(list_distance(x.v, y.v), 6) AS distance FROM {_THREE} x, {_THREE} y WHERE list_distance(x.v, y.v) <= 0.05")
_NEAR = f"near AS (SELECT x.vec_id AS a, y.vec_id AS b FROM {_THREE} x, {_THREE} y WHERE list_distance(x.v, y.v) <= 0.06), core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 5)"
query("dbscan_core", "embeddings", lambda d: graph.cores(three(d), "vec_id", "v", 0.06, 5), f"WITH {_NEAR} SELECT vec_id, vec_id IN (SELECT a FROM core) AS core FROM embeddings")
query("dbscan_labels", "embeddings", lambda d: graph.dbscan(three(d), "vec_id", "v", 0.06, 5).select("vec_id", "label"),
      f"WITH RECURSIVE {_NEAR}, links AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), reach(a, b) AS (SELECT a, a FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), roots AS (SELECT b AS i, min(a) AS root FROM reach GROUP BY b), named AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots), borders AS (SELECT n.a AS i, min(m.label) AS label FROM near n JOIN named m ON n.b = m.i GROUP BY n.a) SELECT e.vec_id, CAST(coalesce(m.label, b.label, -1) AS INT) AS label FROM embeddings e LEFT JOIN named m ON e.vec_id = m.i LEFT JOIN borders b ON e.vec_id = b.i")
query("solve_linear", "lineitem", lambda d: solved(d), "WITH s AS (SELECT sum(l_quantity * l_quantity) a, sum(l_quantity * l_discount) b, sum(l_discount * l_discount) c, sum(l_quantity * l_extendedprice) p, sum(l_discount * l_extendedprice) q FROM lineitem) SELECT 0 AS i, round((p * c - b * q) / (a * c - b * b), 3) AS x FROM s UNION ALL SELECT 1, round((a * q - b * p) / (a * c - b * b), 3) FROM s")


def solved(d: DataFrame) -> DataFrame:
    a, b = E.gram(d, ["l_quantity", "l_discount"], "l_extendedprice")
    return d.sparkSession.createDataFrame([(i, round(float(v), 3)) for i, v in enumerate(E.solve(a, b))], "i int, x double")


_QUERIED = "(SELECT q.vec_id AS query, e.vec_id AS id, e.label, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY d, e.vec_id) <= 5)"


def near(d: DataFrame) -> DataFrame:
    return O.nearest(d, d.filter("vec_id % 100 = 0"), 5, "vec_id", "embedding", C.euclidean)


query("knn_classify_uniform", "embeddings", lambda d: E.vote(near(d), d, "vec_id", "label"), f"SELECT query, label AS prediction FROM (SELECT query, label, count(*) AS n, min((d, id)) AS first FROM {_QUERIED} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, first) = 1")
query("knn_classify_distance", "embeddings", lambda d: E.vote(near(d), d, "vec_id", "label", True), f"SELECT query, label AS prediction FROM (SELECT query, label, round(sum(CASE WHEN d > 0 THEN 1 / d ELSE 0 END), 9) AS w FROM {_QUERIED} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query ORDER BY w DESC, label) = 1")
query("knn_classify_custom", "embeddings", lambda d: E.vote(near(d), d, "vec_id", "label", custom=lambda labels, far: labels[0]), f"SELECT query, arg_min(label, (d, id)) AS prediction FROM {_QUERIED} GROUP BY 1")
query("knn_regress_uniform", "embeddings", lambda d: E.average(near(d), d, "vec_id", "label").withColumn("prediction", r("prediction")), f"SELECT query, round(avg(label), 4) AS prediction FROM {_QUERIED} GROUP BY 1")
query("knn_regress_distance", "embeddings", lambda d: E.average(near(d), d, "vec_id", "label", True).withColumn("prediction", r("prediction")), f"SELECT query, round(coalesce(avg(CASE WHEN d = 0 THEN label END), sum(label / nullif(d, 0)) / sum(1 / nullif(d, 0))), 4) AS prediction FROM {_QUERIED} GROUP BY 1")
