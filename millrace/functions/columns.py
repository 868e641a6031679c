"""Column functions: cell arithmetic, vectors, kernels and distances. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens that stand for a missing field.
NA_TOKENS = ["na", "NA", "n/a", "N/A", "N/a", "nan", "NaN", "Nan", "", "NULL"]


def na_to_null(c: Column) -> Column:
    return F.when(F.trim(c).isin(NA_TOKENS), F.lit(None)).otherwise(F.trim(c))


def infer(c: Column) -> Column:
    """The name of the narrowest type that holds a field: null, long, double or string."""
    t = na_to_null(c)
    return F.when(t.isNull(), "null").when(t.rlike(r"^\+?[0-9]+$"), "long").when(F.try_to_number(t, F.lit("S999999999999999999.999999999")).isNotNull() | t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "double").otherwise("string")


def widest(kinds: Column) -> Column:
    """An aggregate: the widest of field types, null < long < double < string."""
    rank = F.max(F.when(kinds == "string", 3).when(kinds == "double", 2).when(kinds == "long", 1).when(kinds == "null", 0))
    return F.when(rank == 3, "string").when(rank == 2, "double").when(rank == 1, "long").when(rank == 0, "null")


def to_unsigned(c: Column) -> Column:
    """A whole number as a cast to an unsigned type gives it: cut towards zero, 0 for what is below or NaN, at most what a long holds; null for text that is no number."""
    x = c.try_cast("double")
    return F.when(F.isnan(x), F.lit(0).cast("long")).when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(9.2233720368547748e18)).cast("long"))


def shown(c: Column) -> Column:
    """As text; a missing value is NAN."""
    return F.coalesce(c.cast("string"), F.lit("NAN"))


def clip(c: Column, lower: float, upper: float) -> Column:
    """Within [lower, upper]; null becomes lower."""
    return F.when(c.isNull(), F.lit(lower)).otherwise(F.greatest(F.least(c, F.lit(upper)), F.lit(lower)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / total(e))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))))


def polynomial(a: Column, b: Column, constant: float, degree: int) -> Column:
    return F.pow(dot(a, b) + constant, F.lit(degree))


def tanh_kernel(a: Column, b: Column, alpha: float, constant: float) -> Column:
    return F.tanh(alpha * dot(a, b) + constant)


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (j == index).cast("int"))


def soft_threshold(rho: Column, limit: float) -> Column:
    return F.when(rho < -limit, rho + limit).when(rho > limit, rho - limit).otherwise(0.0)


def elastic_threshold(rho: Column, l1: float, l2: float) -> Column:
    """The soft threshold of an elastic net: the limit is l1 * l2, what is left shrinks by 1 + l1 * (1 - l2)."""
    return soft_threshold(rho, l1 * l2) / (1 + l1 * (1 - l2))


def norm(v: Column, p: int) -> Column:
    """The sum of magnitudes (p = 1) or the Euclidean length (p = 2) of a vector."""
    return total(F.transform(v, lambda x: F.abs(x.cast("double")))) if p == 1 else F.sqrt(dot(v, v))


def linear_kernel(a: Column, b: Column) -> Column:
    return dot(a, b)


def applied(c: Column, steps: list) -> Column:
    """The functions of steps, in order, each on what the one before gave."""
    for step in steps:
        c = step(c)
    return c


def last_position(v: Column, value: Column) -> Column:
    """The last zero-based index of value in an array."""
    return F.size(v) - F.array_position(F.reverse(v), value).cast("int")


def argmax(v: Column) -> Column:
    return last_position(v, F.array_max(v))


def argmin(v: Column) -> Column:
    return last_position(v, F.array_min(v))
