"""Decision trees that try every value as a threshold.

A level of the tree is one aggregation: sums of each (node, feature, value), running totals over the
values of a (node, feature), and of each node the split with the greatest gain. What reaches the driver
is the splits, at most one a node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _entropy(counts: list[Column], n: Column) -> Column:
    return sum((F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for c in counts), F.lit(0.0))


def _spread(sums: list[Column], n: Column) -> Column:
    return F.greatest(sums[1] / n - F.pow(sums[0] / n, F.lit(2)), F.lit(0.0))


def best_splits(rows: DataFrame, features: list[str], target: str, classes: list | None = None, node: str | None = None) -> DataFrame:
    """node, feature, threshold and gain: rows with a value of at most the threshold go left. Ties: the first feature, then the least threshold.

    classes: the labels, whose entropy is reduced; None: the target is a number, whose variance is.
    """
    own = [F.when(F.col(target) == v, 1.0).otherwise(0.0) for v in classes] if classes is not None else [F.col(target).cast("double"), F.pow(F.col(target).cast("double"), F.lit(2))]
    impurity = _entropy if classes is not None else _spread
    base = rows.select((F.col(node) if node else F.lit(0)).alias("node"), *[x.alias(f"s{k}") for k, x in enumerate(own)], *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    long = base.select("node", *[f"s{k}" for k in range(len(own))], F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"f{i}").alias("v")) for i in range(len(features))])).alias("x"))
    sums = long.groupBy("node", F.col("x.f").alias("f"), F.col("x.v").alias("v")).agg(F.count("*").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(own))])
    whole, left = Window.partitionBy("node", "f"), Window.partitionBy("node", "f").orderBy("v")
    run = sums.select("node", "f", "v", *[F.sum(c).over(w).alias(f"{c}{p}") for c in ("n", *[f"s{k}" for k in range(len(own))]) for w, p in ((left, "l"), (whole, "t"))])
    run = run.filter("nl < nt")
    part = {p: [F.col(f"s{k}{p}") for k in range(len(own))] for p in "lt"}
    right = [t - l for l, t in zip(part["l"], part["t"])]
    nl, nt = F.col("nl"), F.col("nt")
    gain = impurity(part["t"], nt) - nl / nt * impurity(part["l"], nl) - (nt - nl) / nt * impurity(right, nt - nl)
    scored = run.select("node", "f", "v", F.round(gain, 12).alias("gain"))
    best = scored.groupBy("node").agg(F.max_by(F.struct("f", "v", "gain"), F.struct("gain", -F.col("f"), -F.col("v"))).alias("b"))
    return best.select("node", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("b.f") + 1).alias("feature"), F.col("b.v").alias("threshold"), F.col("b.gain").alias("gain"))


@dataclass(frozen=True)
class Tree:
    """Splits by node: feature and threshold; the children of node k are 2k + 1 and 2k + 2. Values by leaf."""

    splits: dict[int, tuple[str, float]]
    values: dict[int, object]

    def leaf(self, node: int = 0) -> Column:
        if node not in self.splits:
            return F.lit(node)
        f, t = self.splits[node]
        return F.when(F.col(f) <= t, self.leaf(2 * node + 1)).otherwise(self.leaf(2 * node + 2))

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds prediction."""
        return df.withColumn("prediction", F.element_at(F.create_map(*[x for k, v in self.values.items() for x in (F.lit(k), F.lit(v))]), self.leaf()))

    def show(self, node: int = 0, indent: str = "") -> str:
        if node not in self.splits:
            return f"{indent}{self.values.get(node)}\n"
        f, t = self.splits[node]
        return f"{indent}{f} <= {t}\n" + self.show(2 * node + 1, indent + "  ") + self.show(2 * node + 2, indent + "  ")


def grow(df: DataFrame, features: list[str], target: str, id: str, kind: str = "class", max_depth: int = 10, min_samples: int = 10) -> Tree:
    """A tree of classes (a leaf's majority, of ties the class of the least id) or numbers (a leaf's mean). Nodes of fewer than min_samples rows are not split."""
    rows = df.dropna(subset=[*features, target])
    classes = [r[0] for r in rows.select(target).distinct().orderBy(target).collect()] if kind == "class" else None
    tree = Tree({}, {})
    open_ = [0]
    for _ in range(max_depth):
        at = rows.withColumn("_node", tree.leaf()).filter(F.col("_node").isin(open_))
        large = [r._node for r in at.groupBy("_node").count().filter(F.col("count") >= min_samples).collect()]
        if not large:
            break
        found = best_splits(at.filter(F.col("_node").isin(large)), features, target, classes, "_node").filter("gain > 0").collect()  # one row a node of this level
        tree = Tree(tree.splits | {r.node: (r.feature, r.threshold) for r in found}, {})
        open_ = [k for r in found for k in (2 * r.node + 1, 2 * r.node + 2)]
        if not open_:
            break
    at = rows.select(tree.leaf().alias("leaf"), F.col(target).alias("y"), F.col(id).alias("i"))
    if kind == "class":
        votes = at.groupBy("leaf", "y").agg(F.count("*").alias("n"), F.min("i").alias("i"))
        value = votes.groupBy("leaf").agg(F.max_by("y", F.struct("n", -F.col("i"))).alias("v"))
    else:
        value = at.groupBy("leaf").agg(F.avg("y").alias("v"))
    return Tree(tree.splits, {r.leaf: r.v for r in value.collect()})  # one row a leaf


def bootstrap(df: DataFrame, id: str, trees: int, seed: int = 0) -> DataFrame:
    """tree, draw and id: for each tree as many rows as df has, drawn with replacement by a hash of tree and draw from the rows in the order of the id."""
    n = df.count()
    numbered = df.select((F.row_number().over(Window.orderBy(id)) - 1).alias("place"), F.col(id))
    draws = df.sparkSession.range(trees * n).select((F.col("id") / n).cast("int").alias("tree"), (F.col("id") % n).alias("draw"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", "tree", "draw", F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
    return draws.withColumn("place", key % n).join(numbered, "place").select("tree", "draw", id)


def ensemble_vote(votes: DataFrame, id: str) -> DataFrame:
    """id and prediction from votes (id, tree, vote): the most frequent, of ties that of the least tree."""
    counted = votes.groupBy(id, "vote").agg(F.count("*").alias("n"), F.min("tree").alias("first"))
    return counted.groupBy(id).agg(F.max_by("vote", F.struct("n", -F.col("first"))).alias("prediction"))
