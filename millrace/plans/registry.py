"""All queries of the core library by name, with equivalent SQL where it exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import estimators as E
from millrace.operators import frame as O
from millrace.plans import corpus, models, vectors  # noqa: F401  they add their queries
from millrace.plans.base import ORACLE, QUERIES, query, r


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["describe_by_flag"](spark, sf_dir)


query("describe_by_flag", "lineitem", lambda d: d.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("mean_quantity"), r(F.sum("l_extendedprice"), 2).alias("sum_price")),
      "SELECT l_returnflag, count(*) n, round(avg(l_quantity),4) mean_quantity, round(sum(l_extendedprice),2) sum_price FROM lineitem GROUP BY 1")
for _name, _spark, _sql in [
    ("agg_count", lambda: F.count("l_quantity"), "count(l_quantity)"),
    ("agg_mean", lambda: r(O.mean("l_extendedprice")), "round(sum(l_extendedprice)/count(*),4)"),
    ("agg_sum", lambda: r(F.sum("l_quantity")), "round(sum(l_quantity),4)"),
    ("agg_std", lambda: r(F.stddev_samp("l_extendedprice")), "round(stddev_samp(l_extendedprice),4)"),
    ("agg_variance", lambda: r(F.var_samp("l_quantity")), "round(var_samp(l_quantity),4)"),
    ("agg_min", lambda: F.min("l_shipdate"), "min(l_shipdate)"),
    ("agg_max", lambda: F.max("l_extendedprice"), "max(l_extendedprice)"),
    ("nunique", lambda: F.countDistinct("l_partkey"), "count(DISTINCT l_partkey)"),
    ("argmax", lambda: F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")), "arg_max(l_orderkey, (l_extendedprice, l_orderkey))"),
]:
    query(_name, "lineitem", lambda d, x=_spark: d.agg(x().alias("value")), f"SELECT {_sql} AS value FROM lineitem")
query("agg_mode", "lineitem", lambda d: d.agg(O.mode("l_quantity").alias("value")), "SELECT l_quantity AS value FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
query("value_counts", "customer", lambda d: O.value_counts(d, "c_mktsegment"), "SELECT c_mktsegment, count(*) n FROM customer GROUP BY 1")
query("unique", "orders", lambda d: d.select("o_orderpriority").distinct(), "SELECT DISTINCT o_orderpriority FROM orders")
query("select_col", "orders", lambda d: d.select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders")
query("drop_col", "part", lambda d: d.drop("p_name"), "SELECT * EXCLUDE (p_name) FROM part")
query("get_row", "orders", lambda d: d.filter("o_orderkey = 7").select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
query("astype", "customer", lambda d: d.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation")), "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) nation FROM customer")
query("abs_all", "customer", lambda d: d.select("c_custkey", F.abs("c_acctbal").alias("c_acctbal")), "SELECT c_custkey, abs(c_acctbal) c_acctbal FROM customer")
query("clip", "customer", lambda d: d.select("c_custkey", C.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("v")), "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 0.0::DOUBLE ELSE greatest(least(c_acctbal, 5000.0::DOUBLE), 0.0::DOUBLE) END v FROM customer")
query("merge_col", "orders", lambda d: d.select("o_orderkey", F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("v")), "SELECT o_orderkey, concat_ws('-', o_orderstatus, o_orderpriority) v FROM orders")
query("items_unpivot", "part", lambda d: d.select("p_partkey", F.col("p_size").cast("double"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "v"),
      "SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
query("dropna_rows", "documents", lambda d: O.drop_null_rows(d.select("doc_id", "lang", "source")), "SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND doc_id IS NOT NULL")
query("fillna_mode", "documents", lambda d: O.fill(d.select("doc_id", "lang"), "lang", "mode"), "SELECT doc_id, coalesce(lang, (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) lang FROM documents")
query("fillna_value", "documents", lambda d: O.fill(d.select("doc_id", "source"), "source", "value", "none"), "SELECT doc_id, coalesce(source, 'none') source FROM documents")
query("hstack_rows", "orders", lambda d: d.select("o_orderkey").union(d.select("o_custkey")), "SELECT o_orderkey FROM orders UNION ALL SELECT o_custkey FROM orders")
query("vstack_cols", "orders", lambda d: d.select("o_orderkey", "o_custkey").join(d.select("o_orderkey", "o_totalprice"), "o_orderkey"), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
query("head", "orders", lambda d: O.top_by(d.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], 5), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 1 LIMIT 5")
query("tail", "orders", lambda d: O.top_by(d.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey").desc()], 5), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 1 DESC LIMIT 5")
query("sigmoid", "events", lambda d: d.select("event_id", r(C.sigmoid(F.col("value") / 100), 6).alias("v")), "SELECT event_id, round(1/(1+exp(-(value/100))),6) v FROM events")
query("one_hot_scalar", "embeddings", lambda d: d.select("vec_id", C.one_hot(F.col("label"), 10)[3].alias("is_3")), "SELECT vec_id, CAST(label = 3 AS INT) is_3 FROM embeddings")
query("vec_dot", "embeddings", lambda d: d.select("vec_id", r(C.dot(F.col("embedding"), F.col("embedding"))).alias("v")), "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))),4) v FROM embeddings")
query("label_encode", "orders", lambda d: O.label_encode(d, "o_orderpriority", "o_orderkey"), "SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY min(o_orderkey), o_orderpriority) - 1 AS INT) code FROM orders GROUP BY 1")
query("scale_minmax", "part", lambda d: O.min_max(d.select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumn("p_retailprice", r("p_retailprice", 6)), "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) p_retailprice FROM part")
query("scale_zscore", "part", lambda d: O.z_score(d.select("p_partkey", "p_retailprice"), ["p_retailprice"]).withColumn("p_retailprice", r("p_retailprice")), "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 4) p_retailprice FROM part")
query("regression_metrics", "lineitem", lambda d: O.regression_metrics(d, F.col("l_extendedprice"), F.col("l_quantity") * 1500).select(*[r(c, 3).alias(c) for c in ("mae", "rmse", "r2", "msle")]),
      "SELECT round(avg(abs(y-p)),3) mae, round(sqrt(avg((y-p)*(y-p))),3) rmse, round(1 - sum((y-p)*(y-p)) / (var_pop(y)*count(y)),3) r2, round(avg(pow(ln(1+y)-ln(1+p),2)),3) msle FROM (SELECT l_extendedprice y, l_quantity*1500 p FROM lineitem)")
query("metric_confusion", "labels", lambda d: O.confusion(d, "quality", "toxic"), "SELECT quality truth, toxic predicted, count(*) n FROM labels GROUP BY 1, 2")
query("metric_classes", "labels", lambda d: O.class_metrics(d, "quality", "toxic").select("label", r("precision").alias("precision"), r("recall").alias("recall")),
      "SELECT l AS label, round(sum(CAST(quality=l AND toxic=l AS INT)) / nullif(sum(CAST(toxic=l AS INT)),0),4) AS precision, round(sum(CAST(quality=l AND toxic=l AS INT)) / nullif(sum(CAST(quality=l AS INT)),0),4) AS recall FROM labels, (SELECT quality l FROM labels UNION SELECT toxic FROM labels) GROUP BY l")
query("ols_fit", "lineitem", lambda d: O.ols(d, "l_quantity", "l_extendedprice").select(r("slope", 3).alias("slope"), r("intercept", 3).alias("intercept")), "SELECT round(regr_slope(l_extendedprice, l_quantity),3) slope, round(regr_intercept(l_extendedprice, l_quantity),3) intercept FROM lineitem")
query("knn_join", "embeddings", lambda d: O.nearest(d, d.filter("vec_id % 100 = 0"), 5, "vec_id", "embedding", C.euclidean).select("query", "id", "rank", r("distance").alias("distance")),
      "SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY d, id) AS INT) AS rank, round(d,4) distance FROM (SELECT q.vec_id query, e.vec_id id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, id) <= 5")
for _name, _spark, _sql in [
    ("argmin", lambda: F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")), "arg_min(l_orderkey, (l_extendedprice, l_orderkey))"),
    ("metric_mse", lambda: r(F.avg(F.pow(F.col("l_extendedprice") - F.col("l_quantity") * 1500, F.lit(2))), 2), "round(avg(pow(l_extendedprice - l_quantity * 1500, 2)), 2)"),
]:
    query(_name, "lineitem", lambda d, x=_spark: d.agg(x().alias("value")), f"SELECT {_sql} AS value FROM lineitem")
query("agg_product", "region", lambda d: d.agg(F.product(F.col("r_regionkey") + 1).alias("value")), "SELECT product(r_regionkey + 1) AS value FROM region")
query("metric_accuracy", "labels", lambda d: d.agg(r(F.avg((F.col("quality") == F.col("toxic")).cast("double"))).alias("value")), "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS value FROM labels")
query("modify_point", "part", lambda d: d.select("p_partkey", F.when(F.col("p_partkey") == 3, 0.0).otherwise(F.col("p_retailprice")).alias("v")), "SELECT p_partkey, CASE WHEN p_partkey = 3 THEN 0.0 ELSE p_retailprice END v FROM part")
query("push_col", "part", lambda d: d.select("p_partkey", "p_size", (F.col("p_size") * 2).alias("twice")), "SELECT p_partkey, p_size, p_size * 2 AS twice FROM part")
query("drop_row", "part", lambda d: d.filter("p_partkey <> 3").select("p_partkey"), "SELECT p_partkey FROM part WHERE p_partkey <> 3")
query("fillna_mean", "customer", lambda d: O.fill(d.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v")), "v", "mean").withColumn("v", r("v", 2)), "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE (SELECT sum(CASE WHEN c_acctbal > 0 THEN c_acctbal END) / count(*) FROM customer) END, 2) v FROM customer")
query("sort_by", "part", lambda d: d.select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").asc_nulls_last(), "p_partkey"), "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice NULLS LAST, p_partkey")
query("softmax", "part", lambda d: d.select("p_partkey", r(C.softmax(F.array(F.col("p_size") / 10, F.lit(1.0)))[0], 6).alias("v")), "SELECT p_partkey, round(1 / (1 + exp(1 - p_size / 10)), 6) v FROM part")
query("kernel_rbf", "part", lambda d: d.select("p_partkey", r(C.rbf(F.array("p_size"), F.array(F.lit(10)), 0.001), 6).alias("v")), "SELECT p_partkey, round(exp(-0.001 * (p_size - 10) * (p_size - 10)), 6) v FROM part")
query("kernel_poly", "part", lambda d: d.select("p_partkey", r(C.polynomial(F.array("p_size"), F.array(F.lit(0.5)), 1.0, 2)).alias("v")), "SELECT p_partkey, round(pow(p_size * 0.5 + 1, 2), 4) v FROM part")
query("soft_threshold", "customer", lambda d: d.select("c_custkey", r(C.soft_threshold(F.col("c_acctbal"), 500.0), 2).alias("v")), "SELECT c_custkey, round(CASE WHEN c_acctbal < -500 THEN c_acctbal + 500 WHEN c_acctbal > 500 THEN c_acctbal - 500 ELSE 0.0 END, 2) v FROM customer")
for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*")):
    query(f"matrix_{_name}", "orders", lambda d, how=_name: E.elementwise(d.select("o_orderkey", "o_custkey"), d.select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey")), "o_orderkey", how), f"SELECT o_orderkey, o_custkey {_op} (o_custkey + 1) AS o_custkey FROM orders")
def weights(d: DataFrame, w) -> DataFrame:
    return d.sparkSession.createDataFrame([(i, round(float(v), 3)) for i, v in enumerate(w)], "i int, weight double")


query("ridge_fit", "part", lambda d: weights(d, E.least_squares(d, ["p_size"], "p_retailprice", 10.0)), "SELECT 0 AS i, round(sum(p_size * p_retailprice) / (sum(p_size * p_size) + 10), 3) AS weight FROM part")
query("lasso_fit", "lineitem", lambda d: weights(d, E.descent(d, ["l_quantity", "l_discount"], "l_extendedprice", 100.0)), None)
query("elastic_net_fit", "lineitem", lambda d: weights(d, E.descent(d, ["l_quantity", "l_discount"], "l_extendedprice", 1.0, 0.5)), None)
for _kind in ("logistic", "tree", "forest", "svm"):
    query(f"{_kind}_classify", "embeddings", lambda d, kind=_kind: E.classify(d, "embedding", "label", kind, max_iters=20).select("vec_id", "label", "prediction"), None)
for _kind in ("tree", "forest"):
    query(f"{_kind}_regress", "part", lambda d, kind=_kind: E.regress(d, ["p_size"], "p_retailprice", kind).select("p_partkey", r("prediction").alias("prediction")), None)


def nulls(d: DataFrame) -> DataFrame:
    """lineitem with nulls in a column of numbers."""
    return d.select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("v"))


_NULLS = "(SELECT l_orderkey, nullif(l_linenumber, 3) AS v FROM lineitem)"
_SIZED = "(SELECT {c} AS v, row_number() OVER (ORDER BY {c} NULLS LAST) - 1 AS i, count(*) OVER () AS n, count({c}) OVER () AS k FROM {t})"
query("agg_median", "lineitem", lambda d: O.median(d, "l_extendedprice"), "SELECT v AS value FROM " + _SIZED.format(c="l_extendedprice", t="lineitem") + " WHERE i = n // 2")
query("agg_median_nulls", "lineitem", lambda d: O.median(nulls(d), "v"), "SELECT v AS value FROM " + _SIZED.format(c="v", t=_NULLS) + " WHERE i = n // 2")
for _q in (0.0, 0.25, 0.75, 1.0):
    query(f"agg_quantile{'' if _q == 0.75 else f'_{int(100 * _q)}'}", "lineitem", lambda d, q=_q: O.quantile(nulls(d), "v", q), "SELECT v AS value FROM " + _SIZED.format(c="v", t=_NULLS) + f" WHERE i = least(CAST(floor({_q} * n) AS BIGINT), k - 1)")
query("agg_min_max", "lineitem", lambda d: nulls(d).agg(F.min("v").alias("least"), F.max("v").alias("most")), f"SELECT min(v) AS least, max(v) AS most FROM {_NULLS}")
query("nunique_f64", "lineitem", lambda d: d.agg(F.countDistinct("l_discount").alias("value")), "SELECT count(DISTINCT l_discount) AS value FROM lineitem")
query("memory_usage", "lineitem", lambda d: d.agg((F.count("*") * len(d.columns) * 16).alias("value")), "SELECT (SELECT count(*) FROM lineitem) * (SELECT count(*) FROM (DESCRIBE lineitem)) * 16 AS value")
query("shape", "lineitem", lambda d: d.agg(F.count("*").alias("n_rows"), F.lit(len(d.columns)).cast("long").alias("n_cols")), "SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM (DESCRIBE lineitem)) AS n_cols")
query("scan_parquet", "nation", lambda d: d, "SELECT * FROM nation")
query("push_row", "region", lambda d: O.push_row(d.select("r_regionkey", "r_name"), (99, "NEW")), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'")
query("display_point", "orders", lambda d: d.filter("o_orderkey = 5").select(C.shown(F.col("o_totalprice").cast("int")).alias("v"), C.shown(F.nullif("o_orderkey", F.lit(5))).alias("missing")), "SELECT CAST(CAST(trunc(o_totalprice) AS INT) AS VARCHAR) AS v, 'NAN' AS missing FROM orders WHERE o_orderkey = 5")
query("first_non_null", "orders", lambda d: O.first_non_null(d.select("o_orderkey", F.when(F.col("o_orderkey") > 4, F.col("o_totalprice")).alias("v")), "v", "o_orderkey"), "SELECT o_totalprice AS value FROM orders WHERE o_orderkey > 4 ORDER BY o_orderkey LIMIT 1")
query("dropna_cols", "lineitem", lambda d: O.drop_null_columns(d.select("l_orderkey", "l_linenumber", F.nullif("l_linenumber", F.lit(3)).alias("holed"))), "SELECT l_orderkey, l_linenumber FROM lineitem")
query("assemble", "part", lambda d: E.with_features(d, ["p_size", "p_retailprice"]).select("p_partkey", r(E.vector_to_array("features")[1], 2).alias("second")), "SELECT p_partkey, round(p_retailprice, 2) AS second FROM part")
_HOLED = "(SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer)"
query("fillna_median", "customer", lambda d: O.fill(d.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v")), "v", "median"), f"SELECT c_custkey, coalesce(v, (SELECT v FROM {_SIZED.format(c='v', t=_HOLED)} WHERE i = n // 2)) AS v FROM {_HOLED}")
query("fillna_std", "customer", lambda d: O.fill(d.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v")), "v", "std").withColumn("v", r("v", 2)), f"SELECT c_custkey, round(coalesce(v, (SELECT stddev_samp(v) FROM {_HOLED})), 2) AS v FROM {_HOLED}")
_SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
query("one_hot_dataset", "customer", lambda d: O.one_hot(d.select("c_custkey", "c_name", "c_mktsegment"), ["c_name"]), "SELECT c_custkey, c_name, " + ", ".join(f"CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS c_mktsegment_{v}" for v in _SEGMENTS) + " FROM customer")
for _how, _sql in (("minmax", "(p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())"), ("zscore", "(p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER ()")):
    query(f"normalize_dataset_{_how}", "part", lambda d, how=_how: O.normalize(d.select("p_retailprice", "p_size"), "p_retailprice", how).withColumn("p_size", r("p_size", 6)), f"SELECT p_retailprice, round({_sql}, 6) AS p_size FROM part")
_RANKED = "(SELECT o_orderkey, count(*) OVER () AS n, row_number() OVER (ORDER BY md5(o_orderkey || ':0'), lpad(CAST(o_orderkey AS VARCHAR), 20, '0')) - 1 AS i FROM orders)"
query("train_test_split", "orders", lambda d: O.split(d.select("o_orderkey"), "o_orderkey", (0.75, 0.25)), f"SELECT o_orderkey, CASE WHEN i < floor(0.75 * n) THEN 'train' ELSE 'test' END AS split FROM {_RANKED}")
query("train_test_eval_split", "orders", lambda d: O.split(d.select("o_orderkey"), "o_orderkey", (0.5, 0.25, 0.25)), f"SELECT o_orderkey, CASE WHEN i < floor(0.5 * n) THEN 'train' WHEN i < floor(0.75 * n) THEN 'test' ELSE 'eval' END AS split FROM {_RANKED}")
query("shuffle", "orders", lambda d: O.top_by(O.shuffle(d.select("o_orderkey"), "o_orderkey"), [O.shuffle_key("o_orderkey", 0)], 20), "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':0') LIMIT 20")
_PREDICTED = "(SELECT l_extendedprice y, l_quantity * 1500 p FROM lineitem)"
for _name, _sql in (("mae", "avg(abs(y - p))"), ("rmse", "sqrt(avg((y - p) * (y - p)))"), ("r2", "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))"), ("msle", "avg(pow(ln(1 + y) - ln(1 + p), 2))")):
    query(f"metric_{_name}", "lineitem", lambda d, name=_name: O.regression_metrics(d, F.col("l_extendedprice"), F.col("l_quantity") * 1500).select(r(name, 3).alias("value")), f"SELECT round({_sql}, 3) AS value FROM {_PREDICTED}")
_CLASSES = "(SELECT l AS label, sum(CAST(quality = l AND toxic = l AS INT)) AS hit, sum(CAST(toxic = l AS INT)) AS predicted, sum(CAST(quality = l AS INT)) AS support FROM labels, (SELECT quality l FROM labels UNION SELECT toxic FROM labels) GROUP BY l)"
for _name, _of in (("precision", "predicted"), ("recall", "support")):
    for _how, _sql in (("macro", f"avg(hit / nullif({_of}, 0))"), ("weighted", f"sum(hit / nullif({_of}, 0) * {_of}) / sum({_of})")):
        query(f"metric_{_name}_{_how}", "labels", lambda d, name=_name, how=_how: O.averaged(d, "quality", "toxic", name, how).select(r("value").alias("value")), f"SELECT round({_sql}, 4) AS value FROM {_CLASSES}")
    query(f"metric_{_name}_none", "labels", lambda d, name=_name: O.averaged(d, "quality", "toxic", name, "none").select("label", r("value").alias("value")), f"SELECT label, round(hit / nullif({_of}, 0), 4) AS value FROM {_CLASSES}")
query("confusion_dense", "labels", lambda d: O.confusion_matrix(d, "quality", "toxic").select("truth", F.col("predicted")[0].alias("p0"), F.col("predicted")[1].alias("p1")), "SELECT quality AS truth, sum(CAST(toxic = 0 AS INT))::BIGINT AS p0, sum(CAST(toxic = 1 AS INT))::BIGINT AS p1 FROM labels GROUP BY 1")
query("udaf_metric", "labels", lambda d: O.evaluate(d, "quality", "toxic", lambda y, p: {"worst": F.max(F.abs(y - p)), "bias": r(F.avg((p - y).cast("double")))}), "SELECT max(abs(quality - toxic)) AS worst, round(avg(toxic - quality), 4) AS bias FROM labels")
query("udf_map", "customer", lambda d: d.select("c_custkey", C.applied(F.col("c_acctbal"), [lambda c: r(c * 2, 2)]).alias("v")), "SELECT c_custkey, round(c_acctbal * 2, 2) AS v FROM customer")
query("udf_pipe", "customer", lambda d: d.select("c_custkey", C.applied(F.col("c_acctbal"), [F.abs, lambda c: c + 1, lambda c: r(F.sqrt(c))]).alias("v")), "SELECT c_custkey, round(sqrt(abs(c_acctbal) + 1), 4) AS v FROM customer")
query("transpose", "nation", lambda d: E.transpose(d.select("n_nationkey", "n_regionkey"), "n_nationkey").select("name", "r0", "r7", "r24"), "SELECT 'n_regionkey' AS name, " + ", ".join(f"max(CASE WHEN n_nationkey = {i} THEN CAST(n_regionkey AS DOUBLE) END) AS r{i}" for i in (0, 7, 24)) + " FROM nation")
query("hstack_names", "orders", lambda d: O.hstack(d.select(F.col("o_orderkey").alias("k")), d.select("o_custkey")), "SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_custkey FROM orders")


def _csv(d: DataFrame, header: bool) -> DataFrame:
    from millrace.sources import tables

    lines = d.select(F.to_csv(F.struct(F.col("p_partkey"), F.concat(F.lit(" "), F.col("p_name")), F.when(F.col("p_size") % 5 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string")), "p_retailprice")).alias("line"))
    names = ["key", "name", "size", "price"]
    return tables.read_lines(lines, names if header else [f"Column{i}" for i in range(4)])


query("scan_csv", "part", lambda d: _csv(d, True), "SELECT p_partkey AS key, p_name AS name, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS BIGINT) END AS size, p_retailprice AS price FROM part")
query("scan_csv_noheader", "part", lambda d: _csv(d, False), "SELECT p_partkey AS Column0, p_name AS Column1, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS BIGINT) END AS Column2, p_retailprice AS Column3 FROM part")
_FIELDS = ["12", "-3", "4.5", "+7", "1e3", ".5", "abc", "n/a", "NaN", " NULL ", " 8 ", "N/a", "NAN", ""]


def field() -> Column:
    """One of the fields for each row of orders."""
    return F.element_at(F.array(*[F.lit(x) for x in _FIELDS]), (F.col("o_orderkey") % len(_FIELDS) + 1).cast("int"))


_FIELD_SQL = "[" + ", ".join(f"'{x}'" for x in _FIELDS) + f"][o_orderkey % {len(_FIELDS)} + 1]"
_NA_SQL = f"CASE WHEN trim({_FIELD_SQL}) NOT IN ({', '.join(repr(x) for x in C.NA_TOKENS)}) THEN trim({_FIELD_SQL}) END"
_KIND_SQL = f"CASE WHEN t IS NULL THEN 'null' WHEN regexp_full_match(t, '\\+?[0-9]+') THEN 'long' WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'double' ELSE 'string' END"
query("na_tokens", "orders", lambda d: d.select("o_orderkey", C.na_to_null(field()).alias("v")), f"SELECT o_orderkey, {_NA_SQL} AS v FROM orders")
query("infer_type", "orders", lambda d: d.select("o_orderkey", C.infer(field()).alias("kind")), f"SELECT o_orderkey, {_KIND_SQL} AS kind FROM (SELECT o_orderkey, {_NA_SQL} AS t FROM orders)")
query("infer_widen", "orders", lambda d: d.groupBy((F.col("o_orderkey") % 7).alias("part")).agg(C.widest(C.infer(field())).alias("kind")), f"SELECT part, ['null', 'long', 'double', 'string'][max(list_position(['null', 'long', 'double', 'string'], {_KIND_SQL}))] AS kind FROM (SELECT o_orderkey % 7 AS part, {_NA_SQL} AS t FROM orders) GROUP BY 1")
query("from_rows", "region", lambda d: d.sparkSession.createDataFrame([(1, "a"), (2, None)], "k long, v string"), "SELECT CAST(1 AS BIGINT) AS k, 'a' AS v UNION ALL SELECT 2, NULL")
query("dtype_arith", "customer", lambda d: d.select("c_custkey", r(F.col("c_acctbal") + F.col("c_nationkey"), 2).alias("plus"), r(F.col("c_acctbal") - 1, 2).alias("minus"), r(F.col("c_acctbal") * 2, 2).alias("times"), r(F.try_divide(F.col("c_acctbal"), F.col("c_nationkey") * 7), 5).alias("over")),
      "SELECT c_custkey, round(c_acctbal + c_nationkey, 2) AS plus, round(c_acctbal - 1, 2) AS minus, round(c_acctbal * 2, 2) AS times, round(c_acctbal / nullif(c_nationkey * 7, 0), 5) AS over FROM customer")
query("dtype_unary", "customer", lambda d: d.select("c_custkey", (-F.col("c_acctbal")).alias("negative"), C.to_unsigned(F.col("c_acctbal")).alias("unsigned"), F.nullif("c_nationkey", F.lit(3)).isNull().alias("missing"), C.shown(F.nullif("c_nationkey", F.lit(3))).alias("shown")),
      "SELECT c_custkey, -c_acctbal AS negative, greatest(0, CAST(trunc(c_acctbal) AS BIGINT)) AS unsigned, c_nationkey = 3 AS missing, CASE WHEN c_nationkey = 3 THEN 'NAN' ELSE CAST(c_nationkey AS VARCHAR) END AS shown FROM customer")
