"""Range joins of vectors, connected components and density clusters."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import reach


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder of spark.checkpoint.dir; where that is unset, in a temporary one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint()


def range_join(df: DataFrame, id: str, vector: str, eps: float, distance=C.euclidean, width: int | None = None, axes: int = 2) -> DataFrame:
    """a, b and distance of all ordered pairs of rows, a row with itself included, at most eps apart.

    Rows meet through tiles of space in the workers. For other distances than Euclid's, none of which may be shorter, they meet by an equi-join:
    projections on unit vectors do not lengthen distances, so it is one of the cells of a grid of projections.
    """
    if distance is C.euclidean:
        kind = dict(df.dtypes)[id]
        rows = df.select(F.col(id).alias("key"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("left"), F.col(vector).alias("v"))
        return reach.tiled(rows, eps, abs(eps) or 1.0, reach.all_pairs(eps), f"a {kind}, b {kind}, distance double")
    rows = df.select(F.col(id).alias("i"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    if width is None:
        width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    unit = np.linalg.qr(np.random.default_rng(0).standard_normal((width, min(axes, width))))[0].T
    cell = [F.floor(C.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in u])) / eps) for u in unit]
    here = rows.select("i", "v", *[c.alias(f"c{k}") for k, c in enumerate(cell)])
    around = here.toDF("j", "w", *[f"d{k}" for k in range(len(unit))])
    for k in range(len(unit)):
        around = around.withColumn(f"d{k}", F.explode(F.sequence(F.col(f"d{k}") - 1, F.col(f"d{k}") + 1)))
    keys: Column = F.lit(True)
    for k in range(len(unit)):
        keys = keys & (F.col(f"c{k}") == F.col(f"d{k}"))
    found = here.join(around, keys).select(F.col("i").alias("a"), F.col("j").alias("b"), distance(F.col("v"), F.col("w")).alias("distance"))
    return found.filter(F.col("distance") <= eps)


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node reachable, for the nodes of links (a, b): large-star and small-star steps until all point to their root."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while not (edges.groupBy("u").count().filter("count > 1").isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u > v").distinct())
    return edges.toDF("node", "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def dbscan(df: DataFrame, id: str, vector: str, eps: float, min_points: int, distance=C.euclidean) -> DataFrame:
    """id, core and label of every row: labels number the clusters by their least core row; a row near cores of several is of the least; noise is -1."""
    if distance is C.euclidean:
        return _by_tiles(df, id, vector, eps, min_points)
    near = cut(range_join(df, id, vector, eps, distance).select("a", "b"))
    core = cut(near.groupBy(F.col("a").alias("i")).agg((F.count("*") >= min_points).alias("core")))
    cores = core.filter("core").select("i")
    edges = near.join(cores.toDF("a"), "a", "left_semi").join(cores.toDF("b"), "b", "left_semi")
    roots = cores.join(components(edges).toDF("i", "root"), "i", "left").select("i", F.coalesce("root", "i").alias("root"))
    labels = roots.select("root").distinct().select("root", (F.row_number().over(Window.orderBy("root")) - 1).cast("int").alias("label"))  # one row a cluster
    roots = roots.join(labels, "root").select("i", "label")
    own = near.join(roots.toDF("b", "label"), "b").groupBy(F.col("a").alias("i")).agg(F.min("label").alias("near"))
    found = core.join(roots, "i", "left").join(own, "i", "left").select("i", "core", F.coalesce("label", "near", F.lit(-1)).alias("label"))
    return df.select(F.col(id)).join(found.withColumnRenamed("i", id), id, "left").select(id, F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("label", F.lit(-1)).alias("label"))


def _cell(eps: float) -> Column:
    """The cell of a grid in which all rows are in reach of each other; null where rounding could tell otherwise."""
    if not eps > 0:
        return F.lit(None).cast("array<bigint>")
    at = F.transform("v", lambda x: x / (F.lit(eps * (1 - 1e-5)) / F.sqrt(F.size("v"))))
    return F.when((F.size("v") > 0) & F.forall(at, lambda x: F.abs(x) < 2.0**30), F.transform(at, lambda x: F.floor(x)))


def _points(df: DataFrame, id: str, vector: str, eps: float, min_points: int) -> tuple[DataFrame, DataFrame]:
    """The rows, and their distinct finite vectors v with a key, the least id i, the number n of rows, a cell, core, and near, the keys in reach of one that is no core.

    Only points of cells with few rows, fewer than min_points, are compared with the tiles around; those of other cells are cores as such.
    """
    rows = df.select(F.col(id), F.col(vector).cast("array<double>").alias("v"))
    points = rows.filter(F.forall("v", lambda x: F.abs(x) < float("inf"))).groupBy("v").agg(F.min(id).alias("i"), F.count("*").alias("n")).withColumn("cell", _cell(eps))
    inside = points.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("inside"))
    dense = F.coalesce("inside", "n") >= min_points if eps >= 0 else F.lit(False)
    points = cut(points.join(inside, "cell", "left").select(F.monotonically_increasing_id().alias("key"), "i", "n", "v", "cell", dense.alias("dense")))
    around = reach.tiled(points.withColumn("left", ~F.col("dense")), eps, 2 * abs(eps) or 1.0, reach.few(eps, min_points), "key long, total long, near array<long>")
    around = around.groupBy("key").agg(F.sum("total").alias("total"), F.flatten(F.collect_list("near")).alias("near"))
    points = points.join(around, "key", "left").withColumn("core", F.col("dense") | F.coalesce(F.col("total") >= min_points, F.lit(False))).withColumn("near", F.when(~F.col("core"), F.col("near"))).drop("dense", "total")
    return rows, points


def cores(df: DataFrame, id: str, vector: str, eps: float, min_points: int, distance=C.euclidean) -> DataFrame:
    """id and core of every row, as dbscan() has them, without its clusters."""
    if distance is not C.euclidean:
        return dbscan(df, id, vector, eps, min_points, distance).select(id, "core")
    rows, points = _points(df, id, vector, eps, min_points)
    return rows.join(points.select("v", "core"), "v", "left").select(id, F.coalesce("core", F.lit(False)).alias("core"))


def _by_tiles(df: DataFrame, id: str, vector: str, eps: float, min_points: int) -> DataFrame:
    """dbscan() by Euclid's distance, without a row for each pair in reach.

    The cores of a cell are one node of the components. Points that are no cores have fewer than min_points in reach, which are kept to find their cluster.
    """
    rows, points = _points(df, id, vector, eps, min_points)
    points = cut(points)
    inner = points.filter("core")
    nodes = inner.filter("cell IS NOT NULL").groupBy("cell").agg(F.min("key").alias("node"))
    inner = inner.join(nodes, "cell", "left").withColumn("node", F.coalesce("node", "key"))
    linked = reach.tiled(inner.select(F.col("node").alias("key"), "n", F.lit(True).alias("left"), "v"), eps, 2 * abs(eps) or 1.0, reach.links(eps), "a long, b long", below=True)
    roots = inner.join(components(linked).toDF("node", "root"), "node", "left").select("key", "i", F.coalesce("root", "node").alias("root"))
    order = Window.orderBy(F.col("least").asc_nulls_last(), "root")  # one row a cluster
    labels = roots.groupBy("root").agg(F.min("i").alias("least")).select("root", (F.row_number().over(order) - 1).cast("int").alias("label"))
    roots = roots.join(labels, "root").select("key", "label")
    own = points.filter("NOT core").select("key", F.explode("near").alias("b")).join(roots.toDF("b", "label"), "b").groupBy("key").agg(F.min("label").alias("border"))
    found = points.join(roots, "key", "left").join(own, "key", "left").select("v", "core", F.coalesce("label", "border", F.lit(-1)).alias("label"))
    return rows.join(found, "v", "left").select(id, F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("label", F.lit(-1)).alias("label"))
