"""Support vector machines with kernels, for classes and for numbers.

The dual problems are solved with numpy in one task a machine, on at most `sample` rows (those of the
least hash of the id); scores of all rows are products of Arrow batches with the support vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kernel(a: np.ndarray, b: np.ndarray, kind: str = "linear", gamma: float = 1.0, constant: float = 1.0, degree: int = 3) -> np.ndarray:
    """The matrix of kernel values of the rows of a and b: linear, rbf, poly or sigmoid (tanh)."""
    if kind == "rbf":
        far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.exp(-gamma * np.maximum(far, 0))
    dot = a @ b.T
    return {"linear": lambda: dot, "poly": lambda: (dot + constant) ** degree, "sigmoid": lambda: np.tanh(gamma * dot + constant)}[kind]()


def solve(q: np.ndarray, p: np.ndarray, y: np.ndarray, c: float, tolerance: float = 1e-3, steps: int = 100_000) -> tuple[np.ndarray, float]:
    """Minimises a'qa / 2 + p'a for 0 <= a <= c and y'a = 0, always by the two variables that violate the conditions most; returns a and the offset."""
    a, g = np.zeros(len(p)), p.astype(float).copy()
    for _ in range(steps):
        score = -y * g
        up, low = ((y > 0) & (a < c)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        if not up.any() or not low.any():
            break
        i, j = int(np.argmax(np.where(up, score, -np.inf))), int(np.argmin(np.where(low, score, np.inf)))
        if score[i] - score[j] < tolerance:
            break
        curve = max(q[i, i] + q[j, j] - 2 * y[i] * y[j] * q[i, j], 1e-12)
        step = (score[i] - score[j]) / curve
        step = min(step, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += step * (y[i] * q[:, i] - y[j] * q[:, j])
    score = -y * g
    free = (a > 1e-9) & (a < c - 1e-9)
    if free.any():
        return a, float(score[free].mean())
    up, low = ((y > 0) & (a < c)) | ((y < 0) & (a > 0)), ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
    return a, float((score[up].max(initial=-1e9) + score[low].min(initial=1e9)) / 2)


def objective(q: np.ndarray, p: np.ndarray, a: np.ndarray) -> float:
    return float(a @ q @ a / 2 + p @ a)


@dataclass(frozen=True)
class Machine:
    """Scores are sums of weights times kernel values with the support vectors, and the offset."""

    label: object
    vectors: np.ndarray
    weights: np.ndarray
    offset: float
    options: dict

    def score(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.vectors, **self.options) @ self.weights + self.offset


def _bounded(df: DataFrame, id: str, vector: str, target: str, sample: int) -> DataFrame:
    rows = df.select(F.col(id).alias("i"), F.col(vector).cast("array<double>").alias("v"), F.col(target).alias("y")).dropna()
    return rows.orderBy(F.xxhash64("i"), "i").limit(sample)


def _machines(found: DataFrame, options: dict) -> list[Machine]:
    """One row a machine; each has at most `sample` vectors."""
    out = []
    for r in found.collect():
        out.append(Machine(r.label, np.array(r.vectors, float).reshape(len(r.weights), -1) if r.weights else np.zeros((0, 1)), np.array(r.weights, float), r.offset, options))
    return sorted(out, key=lambda m: str(m.label))


_MADE = "vectors array<array<double>>, weights array<double>, offset double"


def fit_classes(df: DataFrame, id: str, vector: str, label: str, c: float = 1.0, sample: int = 2000, **options) -> list[Machine]:
    """A machine for the greater of two classes, or one against the rest for each of more; each is fitted in a task of its own."""
    rows = _bounded(df, id, vector, label, sample)
    labels = [r[0] for r in rows.select("y").distinct().orderBy("y").collect()]
    if len(labels) < 2:
        raise ValueError("two classes at least are needed")
    own = labels[1:] if len(labels) == 2 else labels
    kind = rows.schema["y"].dataType.simpleString()

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        x, one = np.stack(group["v"].to_list()).astype(float), group["label"].iloc[0]
        y = np.where(group["y"].to_numpy() == one, 1.0, -1.0)
        a, offset = solve(kernel(x, x, **options) * y[:, None] * y[None], -np.ones(len(y)), y, c)
        held = a > 1e-9
        return pd.DataFrame({"label": [one], "vectors": [x[held].tolist()], "weights": [(a * y)[held].tolist()], "offset": [offset]})

    each = rows.withColumn("label", F.explode(F.array(*[F.lit(v).cast(kind) for v in own])))
    return _machines(each.groupBy("label").applyInPandas(fit, f"label {kind}, {_MADE}"), options)


def fit_numbers(df: DataFrame, id: str, vector: str, target: str, c: float = 1.0, eps: float = 0.1, sample: int = 2000, **options) -> Machine:
    """A machine whose error beyond eps is penalised by c."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        x, t = np.stack(group["v"].to_list()).astype(float), group["y"].to_numpy(float)
        k, y = kernel(x, x, **options), np.repeat([1.0, -1.0], len(t))
        a, offset = solve(np.tile(k, (2, 2)) * y[:, None] * y[None], np.concatenate([eps - t, eps + t]), y, c)
        w = a[: len(t)] - a[len(t) :]
        held = np.abs(w) > 1e-9
        return pd.DataFrame({"label": [0], "vectors": [x[held].tolist()], "weights": [w[held].tolist()], "offset": [offset]})

    rows = _bounded(df, id, vector, target, sample).withColumn("y", F.col("y").cast("double")).withColumn("label", F.lit(0))
    found = _machines(rows.groupBy("label").applyInPandas(fit, f"label int, {_MADE}"), options)
    return found[0] if found else Machine(0, np.zeros((0, 1)), np.zeros(0), 0.0, options)


def scores(df: DataFrame, vector: str, machines: list[Machine]) -> DataFrame:
    """Adds score, an array with each machine's value; null for a null vector."""
    held = df.sparkSession.sparkContext.broadcast(machines)  # at most `sample` vectors each

    def score(v: pd.Series) -> pd.Series:
        good, out = np.flatnonzero(v.notna().to_numpy()), [None] * len(v)
        if len(good):
            x = np.stack(v.iloc[good].to_list()).astype(float)
            both = np.column_stack([m.score(x) if len(m.weights) else np.full(len(x), m.offset) for m in held.value])
            for i, values in zip(good.tolist(), both.tolist(), strict=True):
                out[i] = values
        return pd.Series(out, dtype=object)

    return df.withColumn("score", F.pandas_udf(score, "array<double>")(F.col(vector).cast("array<double>")))


def predict_classes(df: DataFrame, vector: str, machines: list[Machine], other: object = None) -> DataFrame:
    """Adds prediction: the machine's class where its score is at least 0 and `other` elsewhere, or of several machines the class with the greatest score."""
    found = scores(df, vector, machines)
    if len(machines) == 1:
        return found.withColumn("prediction", F.when(F.col("score")[0] >= 0, F.lit(machines[0].label)).otherwise(F.lit(other)))
    names = F.array(*[F.lit(m.label) for m in machines])
    return found.withColumn("prediction", F.element_at(names, F.array_position("score", F.array_max("score")).cast("int")))


def predict_numbers(df: DataFrame, vector: str, machine: Machine) -> DataFrame:
    """Adds prediction."""
    return scores(df, vector, [machine]).withColumn("prediction", F.col("score")[0])
