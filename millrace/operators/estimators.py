"""Estimators: least squares with penalties, logistic, naive Bayes, neighbours' votes, trees, forests, linear machines, k-means and components.

Fits read the rows in aggregations; what reaches the driver is of the size of the model (k x k sums, k centres), never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import classification, feature, regression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import columns as C


def with_features(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """Adds the vector column features, of numeric columns or of one array column; rows with a null in them go."""
    columns = [columns] if isinstance(columns, str) else columns
    kept = df.dropna(subset=columns)
    if len(columns) == 1 and dict(df.dtypes)[columns[0]].startswith("array"):
        return kept.withColumn("features", array_to_vector(F.col(columns[0]).cast("array<double>")))
    return kept.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def gram(df: DataFrame, xs: list[str], y: str, bias: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y in one aggregation; with bias a column of ones comes first."""
    cols = ([F.lit(1.0)] if bias else []) + [F.col(x).cast("double") for x in xs]
    rows = df.dropna(subset=[*xs, y])
    k = len(cols)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(cols[i] * cols[j]) for i, j in upper] + [F.sum(c * F.col(y)) for c in cols]
    found = [v or 0.0 for v in rows.agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)]).first()]  # type: ignore[union-attr]
    a = np.zeros((k, k))
    for (i, j), v in zip(upper, found):
        a[i, j] = a[j, i] = v
    return a, np.array(found[len(upper) :])


def least_squares(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0, bias: bool = False) -> np.ndarray:
    """Weights; the penalty falls on the bias too."""
    a, b = gram(df, xs, y, bias)
    return np.linalg.lstsq(a + ridge * np.eye(len(a)), b, rcond=None)[0]


def descent(df: DataFrame, xs: list[str], y: str, l1: float, l2: float | None = None, sweeps: int = 100, bias: bool = False) -> np.ndarray:
    """Coordinate descent from weights of 1 on the sums of products: lasso, or with l2 (the mixing share) elastic net."""
    a, b = gram(df, xs, y, bias)
    w = np.ones(len(b))
    limit, shrink = (l1, 1.0) if l2 is None else (l1 * l2, 1 + l1 * (1 - l2))
    for _ in range(sweeps):
        for j in range(len(w)):
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - limit, 0.0) / shrink / a[j, j] if a[j, j] else 0.0
    return w


def linear_predict(df: DataFrame, xs: list[str], w: np.ndarray) -> DataFrame:
    """Adds the column prediction; one weight more than columns means a bias first."""
    bias, rest = (float(w[0]), w[1:]) if len(w) > len(xs) else (0.0, w)
    return df.withColumn("prediction", sum((F.col(x) * float(v) for x, v in zip(xs, rest)), F.lit(bias)))


def classify(df: DataFrame, columns: list[str] | str, label: str, kind: str, **options) -> DataFrame:
    """Fits logistic, tree, forest or (one against the rest) svm on the labelled rows; all rows with features come back with prediction."""
    rows = with_features(df, columns).persist()
    models = {
        "logistic": lambda: classification.LogisticRegression(maxIter=options.get("max_iters", 100)),
        "tree": lambda: classification.DecisionTreeClassifier(impurity="entropy", maxDepth=options.get("max_depth", 10), minInstancesPerNode=options.get("min_samples", 10)),
        "forest": lambda: classification.RandomForestClassifier(impurity="entropy", numTrees=options.get("trees", 30), maxDepth=options.get("max_depth", 10), seed=options.get("seed", 0)),
        "svm": lambda: classification.OneVsRest(classifier=classification.LinearSVC(maxIter=options.get("max_iters", 50), regParam=options.get("penalty", 0.01)), parallelism=8),
    }
    model = models[kind]().setFeaturesCol("features").setLabelCol("_y").setPredictionCol("prediction")
    return model.fit(rows.withColumn("_y", F.col(label).cast("double")).filter("_y IS NOT NULL")).transform(rows)


def regress(df: DataFrame, columns: list[str] | str, label: str, kind: str, **options) -> DataFrame:
    """Fits a tree or forest of means; all rows with features come back with prediction."""
    rows = with_features(df, columns)
    depth = options.get("max_depth", 10)
    if kind == "tree":
        model = regression.DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=options.get("min_samples", 10), labelCol="_y")
    else:
        model = regression.RandomForestRegressor(maxDepth=depth, numTrees=options.get("trees", 30), seed=options.get("seed", 0), labelCol="_y")
    return model.fit(rows.withColumn("_y", F.col(label).cast("double")).filter("_y IS NOT NULL")).transform(rows)


def naive_bayes(tokens: DataFrame, label: str, alpha: float = 1.0) -> DataFrame:
    """term, label and log10 likelihood, (count + alpha) / (class total + terms), for every term in every class. tokens: a row for each token (or with tf), with its label."""
    tf = tokens.filter(F.col(label).isNotNull()).groupBy("term", label).agg((F.sum("tf") if "tf" in tokens.columns else F.count("*")).alias("c"))
    totals = tf.groupBy(label).agg(F.sum("c").alias("total"))
    n = tf.agg(F.countDistinct("term").alias("terms"))
    grid = tf.select("term").distinct().crossJoin(F.broadcast(totals.crossJoin(n)))  # one row a class
    return grid.join(tf, ["term", label], "left").select("term", label, F.log10((F.coalesce("c", F.lit(0)) + alpha) / (F.col("total") + F.col("terms"))).alias("weight"))


def naive_bayes_predict(counts: DataFrame, weights: DataFrame, id: str, label: str) -> DataFrame:
    """id and prediction: the class with the greatest sum of weights over known terms, without priors; of ties the least class. counts: id, term, tf."""
    scores = counts.join(weights, "term").groupBy(id, label).agg(F.round(F.sum(F.col("tf") * F.col("weight")), 9).alias("s"))
    return scores.groupBy(id).agg(F.min_by(label, F.struct(-F.col("s"), F.col(label))).alias("prediction"))  # one reading of the scores: sums of another order differ


def vote(near: DataFrame, labels: DataFrame, id: str, label: str, weighted: bool = False, custom=None) -> DataFrame:
    """query and prediction from neighbours (query, id, distance): the majority, of ties that with the nearest member; or the greatest sum of 1 / distance (0 for an exact match), of ties the least label.

    custom: a function of the arrays of labels and distances, nearest first, to a column.
    """
    seen = near.join(labels.select(F.col(id).alias("id"), F.col(label).alias("_y")), "id")
    if custom is not None:
        lists = seen.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id", "_y"))).alias("l"))  # k neighbours
        return lists.select("query", custom(F.col("l._y"), F.col("l.distance")).alias("prediction"))
    weight = F.when(F.col("distance") > 0, 1 / F.col("distance")).otherwise(0.0) if weighted else F.lit(1.0)
    votes = seen.groupBy("query", "_y").agg(F.round(F.sum(weight), 9).alias("w"), F.min(F.struct("distance", "id")).alias("d"))
    first = F.struct(-F.col("w"), F.col("_y")) if weighted else F.struct(-F.col("w"), F.col("d"))
    return votes.groupBy("query").agg(F.min_by("_y", first).alias("prediction"))


def average(near: DataFrame, values: DataFrame, id: str, value: str, weighted: bool = False) -> DataFrame:
    """query and prediction: the mean of neighbours' values, or their 1 / distance mean (of exact matches alone where there are any)."""
    seen = near.join(values.select(F.col(id).alias("id"), F.col(value).cast("double").alias("_y")), "id")
    if not weighted:
        return seen.groupBy("query").agg(F.avg("_y").alias("prediction"))
    far = F.sum(F.try_divide(F.col("_y"), F.col("distance"))) / F.sum(F.try_divide(F.lit(1.0), F.col("distance")))
    return seen.groupBy("query").agg(F.coalesce(F.avg(F.when(F.col("distance") == 0, F.col("_y"))), far).alias("prediction"))


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def kmeans_plus(df: DataFrame, id: str, vector: str, k: int) -> np.ndarray:
    """The vector of the least id, then always the one farthest from those chosen; of ties that of the least id."""
    rows = df.select(id, F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    first = rows.agg(F.min_by("v", id)).first()
    if first is None or first[0] is None:
        return np.zeros((0, 0))
    centres = [list(first[0])]
    while len(centres) < k:
        far = F.array_min(F.array(*[C.euclidean(F.col("v"), F.array(*[F.lit(float(x)) for x in c])) for c in centres]))
        centres.append(list(rows.agg(F.max_by("v", F.struct(F.round(far, 12), -F.col(id)))).first()[0]))  # type: ignore[index]
    return np.array(centres, float)


def kmeans_assign(df: DataFrame, id: str, vector: str, centres: np.ndarray) -> DataFrame:
    """id and cluster: the nearest centre, of ties the last; null for a null vector."""

    def nearest(v: pd.Series) -> pd.Series:
        out, good = pd.Series([None] * len(v), dtype="Int32"), v.notna().to_numpy()
        if good.any() and len(centres):
            d = squared_distances(np.stack(v[good].to_list()).astype(float), centres)
            out[good] = (d.shape[1] - 1 - np.argmin(d[:, ::-1], axis=1)).astype(np.int32)
        return out

    return df.select(id, F.pandas_udf(nearest, "int")(F.col(vector).cast("array<double>")).alias("cluster"))


def kmeans_step(df: DataFrame, vector: str, centres: np.ndarray) -> np.ndarray:
    """The means of the vectors nearest to each centre; a centre without vectors stays. Each task sends k sums."""

    def sums(batches):
        total, n = np.zeros(centres.shape), np.zeros(len(centres), np.int64)
        for batch in batches:
            v = batch.column(0).drop_null()
            if len(v):
                x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                d = squared_distances(x, centres)
                own = d.shape[1] - 1 - np.argmin(d[:, ::-1], axis=1)
                np.add.at(total, own, x)
                n += np.bincount(own, minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "n", "s"])

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(sums, "i int, n long, s array<double>")
    found = parts.select("i", "n", F.posexplode("s").alias("j", "x")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # k vectors
    out = centres.copy()
    for r in found:
        if r.n:
            out[r.i, r.j] = r.x / r.n
    return out


def kmeans(df: DataFrame, id: str, vector: str, k: int, max_iters: int = 10) -> tuple[DataFrame, np.ndarray]:
    """id and cluster of every vector, and the centres: farthest first from the least id, then Lloyd's steps until nothing moves."""
    rows = df.select(id, F.col(vector).cast("array<double>").alias(vector)).persist()
    centres = kmeans_plus(rows, id, vector, k)
    for _ in range(max_iters if len(centres) else 0):
        moved = kmeans_step(rows, vector, centres)
        done, centres = np.allclose(moved, centres, atol=1e-12), moved
        if done:
            break
    return kmeans_assign(rows, id, vector, centres), centres


def covariance(df: DataFrame, vector: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean vector and the sample covariance, from one sum of products a task."""

    def sums(batches):
        s, p, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            v = batch.column(0).drop_null()
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            s, p, n = s + x.sum(0), p + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([[float(n), *s.tolist(), *p.ravel().tolist()]], pa.list_(pa.float64()))], names=["s"])

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(sums, "s array<double>")
    found = parts.select(F.posexplode("s").alias("j", "x")).groupBy("j").agg(F.sum("x").alias("x")).orderBy("j").collect()  # of the model's size
    x = np.array([r.x for r in found])
    n, mean = x[0], x[1 : width + 1] / max(x[0], 1)
    return mean, (x[width + 1 :].reshape(width, width) - n * np.outer(mean, mean)) / max(n - 1, 1)


def principal(df: DataFrame, vector: str, n: int) -> DataFrame:
    """Adds the array projection: centred rows on the n first principal directions."""
    rows = with_features(df, vector)
    centred = feature.StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_centred").fit(rows).transform(rows)
    model = feature.PCA(k=n, inputCol="_centred", outputCol="_projected").fit(centred)
    return model.transform(centred).withColumn("projection", vector_to_array("_projected")).drop("features", "_centred", "_projected")


def elementwise(a: DataFrame, b: DataFrame, id: str, how: str) -> DataFrame:
    """Sum, difference or product of two tables of the same columns, row by row of the id."""
    do = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y}[how]
    return a.alias("a").join(b.alias("b"), id).select(id, *[do(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in a.columns if c != id])


def transpose(df: DataFrame, id: str, most: int = 2000) -> DataFrame:
    """name, and a column r<id> for each row of df. A matrix of more than `most` rows is an error: rows become columns."""
    ids = [r[0] for r in df.select(id).orderBy(id).limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} rows")
    names = [c for c in df.columns if c != id]
    long = df.select(F.concat(F.lit("r"), F.col(id)).alias("_id"), *[F.col(c).cast("double") for c in names]).unpivot("_id", names, "name", "v")
    return long.groupBy("name").pivot("_id", [f"r{i}" for i in ids]).agg(F.first("v"))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a system of the size of a model, with pivoting."""
    return np.linalg.solve(a, b)


def grid_search(options: dict[str, list], score, reverse: bool = False, parallelism: int = 4) -> list[tuple[dict, float]]:
    """(options, score) of every combination, best first (or last); score fits and evaluates one combination. Several run at once."""
    from concurrent.futures import ThreadPoolExecutor
    from itertools import product

    tried = [dict(zip(options, v)) for v in product(*options.values())]
    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(lambda o: score(**o), tried))
    return sorted(zip(tried, found), key=lambda x: -x[1], reverse=reverse)
