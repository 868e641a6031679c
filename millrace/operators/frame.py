"""Operators on whole tables: statistics, missing values, reshaping, encoding, scaling, splitting and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import search


def mean(c: str) -> Column:
    """The sum of what is not null over all rows, nulls included."""
    return F.sum(c) / F.count(F.lit(1))


FEW = 10_000  # values that are sorted on the driver


def kth(df: DataFrame, c: str, index: int) -> object:
    """The value at a zero-based index of the ascending non-null values, or None beyond them.

    Approximate percentiles around the place, then the exact counts below, at and between them, in turns: the value is
    one of the two or lies in a part that leaves both out, until few values are left to sort. Equal values only count.
    """
    v = F.col("v")
    values = df.select(F.col(c).alias("v")).filter("v IS NOT NULL")
    if dict(values.dtypes)["v"] in ("float", "double"):
        n, plain = values.agg(F.count("*"), F.count(F.when(~F.isnan("v"), 1))).first()
        if plain <= index < n:
            return float("nan")  # the greatest
        values, n = values.filter(~F.isnan("v")), plain
    else:
        n = values.count()
    if not 0 <= index < n:
        return None
    while n > FEW:
        at, slack = index / n, 5e-4
        low, high = values.agg(F.percentile_approx("v", [max(0.0, at - slack), min(1.0, at + slack)], 10000)).first()[0]
        parts = [v < F.lit(low), v == F.lit(low), (v > F.lit(low)) & (v < F.lit(high)), (v == F.lit(high)) & (v > F.lit(low)), v > F.lit(high)]
        sizes = values.agg(*[F.count(F.when(x, 1)) for x in parts]).first()
        k = 0
        while index >= sizes[k]:
            index, k = index - sizes[k], k + 1
        if k in (1, 3):
            return (low, high)[k == 3]
        if sizes[k] == n:  # ends that are no values, as percentiles of numbers that a double rounds
            break
        values, n = values.filter(parts[k]), sizes[k]
    return values.orderBy("v").offset(index).first()[0]


def _value(df: DataFrame, c: str, found: object) -> DataFrame:
    return df.sparkSession.createDataFrame([(found,)], f"value {dict(df.dtypes)[c]}")


def median(df: DataFrame, c: str) -> DataFrame:
    """One row, value: the element at floor(n / 2) of all n rows, in ascending order with nulls last."""
    return _value(df, c, kth(df, c, df.count() // 2))


def quantile(df: DataFrame, c: str, q: float) -> DataFrame:
    """One row, value: the non-null element at floor(q * n) for n rows, nulls counted, or the last one."""
    n, known = df.agg(F.count("*"), F.count(c)).first()
    return _value(df, c, kth(df, c, min(int(q * n), known - 1)))


def mode(c: str) -> Column:
    """The most frequent value, of ties the least."""
    return F.mode(c, True)


def describe(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count(c).alias("n"), mean(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.stddev_samp(c).alias("std"), F.var_samp(c).alias("variance"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n"))


def drop_null_rows(df: DataFrame, least: int = 1) -> DataFrame:
    """Rows with fewer than `least` nulls."""
    return df.filter(sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0)) < least)


def drop_null_columns(df: DataFrame, least: int = 1) -> DataFrame:
    """Without the columns of `least` or more nulls."""
    n = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if n[i] < least])


def fill(df: DataFrame, c: str, how: str, value: object = None) -> DataFrame:
    """Nulls of c become its mean, median, mode, std, or a value."""
    if how == "value":
        return df.withColumn(c, F.coalesce(c, F.lit(value)))
    if how == "median":
        one = median(df, c).select(F.col("value").alias("_fill"))
    else:
        one = df.agg({"mean": mean(c), "mode": mode(c), "std": F.stddev_samp(c)}[how].alias("_fill"))
    return df.crossJoin(F.broadcast(one)).withColumn(c, F.coalesce(c, "_fill")).drop("_fill")  # one row


def first_non_null(df: DataFrame, c: str, id: str) -> DataFrame:
    """One row, value: that of the least id which has one."""
    return df.filter(F.col(c).isNotNull()).agg(F.min_by(c, id).alias("value"))


def push_row(df: DataFrame, row: tuple) -> DataFrame:
    """df with one more row, which must have a cell for each column."""
    if len(row) != len(df.columns):
        raise ValueError(f"a row of {len(df.columns)} cells is needed")
    return df.unionAll(df.sparkSession.createDataFrame([row], df.schema))


def hstack(df: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of both, by the place of columns; names are those of df."""
    return df.union(other)


def vstack(df: DataFrame, other: DataFrame, id: str) -> DataFrame:
    """The columns of both, row by row of the id."""
    return df.join(other, id)


def text_columns(df: DataFrame, exclude: list[str] = ()) -> list[str]:  # type: ignore[assignment]
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


def one_hot(df: DataFrame, exclude: list[str] = (), columns: list[str] | None = None, most: int = 10000) -> DataFrame:  # type: ignore[assignment]
    """Each text column (or the given ones) becomes dummy columns, in its place, for its sorted values but the first. More values than `most` are an error."""
    encoded = text_columns(df, exclude) if columns is None else columns
    values = {}
    for c in encoded:
        values[c] = [r[0] for r in df.select(c).distinct().filter(F.col(c).isNotNull()).orderBy(c).limit(most + 1).collect()]  # bounded
        if len(values[c]) > most:
            raise ValueError(f"{c} has more than {most} values")
    return df.select(*[x for k in df.columns for x in ([F.when(F.col(k) == v, 1).otherwise(0).alias(f"{k}_{v}") for v in values[k][1:]] if k in values else [F.col(k)])])


def label_encode(df: DataFrame, c: str, id: str) -> DataFrame:
    """Values by first appearance: value and code. Only the distinct values meet in one window."""
    first = df.groupBy(c).agg(F.min(id).alias("_first"))
    return first.select(c, (F.row_number().over(Window.orderBy("_first", c)) - 1).alias("code"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    limits = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(limits)).withColumns(scaled).drop(*limits.columns)  # one row


def z_score(df: DataFrame, columns: list[str], population: bool = True) -> DataFrame:
    std = F.stddev_pop if population else F.stddev_samp
    limits = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", std))])
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(limits)).withColumns(scaled).drop(*limits.columns)  # one row


def normalize(df: DataFrame, target: str, how: str) -> DataFrame:
    """Every column but the target scaled, by its range (minmax) or by mean() and the sample deviation (zscore)."""
    columns = [c for c in df.columns if c != target]
    if how == "minmax":
        return min_max(df, columns)
    limits = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", mean), ("s", F.stddev_samp))])
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(limits)).withColumns(scaled).drop(*limits.columns)  # one row


def shuffle(df: DataFrame, id: str, seed: int = 0) -> DataFrame:
    """The rows in the order of a seeded hash of the id."""
    return df.orderBy(shuffle_key(id, seed), id)


def shuffle_key(id: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(id).cast("string"), F.lit(seed)).cast("binary"))


def split(df: DataFrame, id: str, ratios: tuple[float, ...], names: tuple[str, ...] = ("train", "test", "eval"), seed: int = 0) -> DataFrame:
    """Adds split: of n rows in the order of a seeded hash of the unique id, the first floor(r1 * n) are the first part, and so on; the last part has the rest.

    The cuts are order statistics of the hash, so rows are neither moved nor sorted.
    """
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("the ratios must add up to 1")
    keyed = df.withColumn("_key", F.concat_ws(":", shuffle_key(id, seed), F.lpad(F.col(id).cast("string"), 20, "0")))
    n, part, before = df.count(), F.lit(names[len(ratios) - 1]), 0.0
    cuts = []
    for r in ratios[:-1]:
        before += r
        cuts.append(int(before * n + 1e-9))
    place = keyed.select(F.conv(F.substring("_key", 1, 15), 16, 10).cast("long").alias("k"), "_key")
    for name, cut in reversed(list(zip(names, cuts))):
        if cut >= n:
            part = F.lit(name)
            continue
        k = kth(place, "k", cut)
        tied = place.filter(F.col("k") == k).orderBy("_key")  # rows that share 60 bits of the hash
        at = tied.offset(cut - place.filter(F.col("k") < k).count()).first()[1]
        part = F.when(F.col("_key") < at, name).otherwise(part)
    return keyed.withColumn("split", part).drop("_key")


def part(df: DataFrame, name: str) -> DataFrame:
    """The rows of one part of a split()."""
    return df.filter(F.col("split") == name).drop("split")


def top_by(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def regression_metrics(df: DataFrame, y: Column, p: Column) -> DataFrame:
    rows = df.select(y.cast("double").alias("y"), p.cast("double").alias("p"))
    e = F.col("y") - F.col("p")
    return rows.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / (F.var_pop("y") * F.count("y"))).alias("r2"),
        F.avg(F.pow(F.log1p("y") - F.log1p("p"), F.lit(2))).alias("msle"),
    )


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("truth"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """label, precision, recall, support and predicted of each class, from the aggregated confusion counts."""
    cells = confusion(df, y, p)
    both = cells.select(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).alias("q")).unionByName(
        cells.select(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.col("n").alias("q"))
    )
    return both.groupBy("label").agg(F.try_divide(F.sum("tp"), F.sum("q")).alias("precision"), F.try_divide(F.sum("tp"), F.sum("t")).alias("recall"), F.sum("t").alias("support"), F.sum("q").alias("predicted"))


def averaged(df: DataFrame, y: str, p: str, metric: str, average: str = "macro") -> DataFrame:
    """precision or recall: of each class (none: label, value), or one value as the plain mean (macro) or weighted, precision by predicted and recall by true counts."""
    classes = class_metrics(df, y, p)
    if average == "none":
        return classes.select("label", F.col(metric).alias("value"))
    if average == "macro":
        return classes.agg(F.avg(metric).alias("value"))
    weight = "predicted" if metric == "precision" else "support"
    return classes.agg((F.sum(F.col(metric) * F.col(weight)) / F.sum(weight)).alias("value"))


def confusion_matrix(df: DataFrame, y: str, p: str) -> DataFrame:
    """truth, and predicted as an array of counts by ascending true label."""
    labels = [r[0] for r in df.select(y).distinct().orderBy(y).collect()]  # the classes
    return df.groupBy(F.col(y).alias("truth")).agg(F.array(*[F.count_if(F.col(p) == v) for v in labels]).alias("predicted"))


def evaluate(df: DataFrame, y: str, p: str, metric) -> DataFrame:
    """One row: metric(truth, prediction), a function of two columns that gives aggregates by name."""
    return df.agg(*[v.alias(k) for k, v in metric(F.col(y), F.col(p)).items()])


def ols(df: DataFrame, x: str, y: str, ridge: float = 0.0) -> DataFrame:
    """Slope and intercept of y on x in one aggregation."""
    sxx, sxy = F.var_pop(x) * F.count(x), F.covar_pop(x, y) * F.count(x)
    return df.agg((sxy / (sxx + ridge)).alias("slope"), (F.avg(y) - sxy / (sxx + ridge) * F.avg(x)).alias("intercept"))


def nearest(df: DataFrame, queries: DataFrame, k: int, id: str, vector: str, distance, most: int = 100_000) -> DataFrame:
    """query, id, distance and rank of the k nearest rows of df for each query but itself; ties by id, null distances last.

    Queries are sent to all tasks: more than `most` are an error. Each task keeps k rows a query before anything is shuffled.
    Euclidean distances of rows with whole ids are found by products of blocks (search.candidates), others by the expression for every pair.
    """
    if queries.select(id).limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries")
    if distance is C.euclidean and dict(df.dtypes)[id] in ("tinyint", "smallint", "int", "bigint"):
        pairs = search.candidates(df, queries, k, id, vector)
    else:
        q = queries.select(F.col(id).alias("query"), F.col(vector).alias("_q"))
        d = df.select(F.col(id).alias("id"), F.col(vector).alias("_v"))
        pairs = d.join(F.broadcast(q), F.col("id") != F.col("query")).select("query", "id", distance(F.col("_q"), F.col("_v")).alias("distance"))  # at most `most` rows
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
