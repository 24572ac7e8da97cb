"""Matrices in long form (mat_id, i, j, a): products, systems, eigenproblems and their errors; discriminant axes. A matrix is one row while it is worked on."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import products


def product(a: DataFrame, b: DataFrame, turn_a: bool = False, turn_b: bool = False) -> DataFrame:
    """(mat_id, i, j, a): A B, either of them transposed, by one join on the inner index and a sum."""
    row, inner = ("j", "i") if turn_a else ("i", "j")
    left = a.select("mat_id", F.col(row).alias("i"), F.col(inner).alias("__k"), F.col("a").alias("__p"))
    inner, column = ("j", "i") if turn_b else ("i", "j")
    right = b.select("mat_id", F.col(inner).alias("__k"), F.col(column).alias("j"), F.col("a").alias("__q"))
    return left.join(right, ["mat_id", "__k"]).groupBy("mat_id", "i", "j").agg(F.sum(F.col("__p") * F.col("__q")).alias("a"))


def matrix(pdf: pd.DataFrame, columns: int | None = None) -> np.ndarray:
    out = np.zeros((int(pdf["i"].max()) + 1, columns or int(pdf["j"].max()) + 1)) if len(pdf) else np.zeros((0, 0))
    out[pdf["i"], pdf["j"]] = pdf["a"]
    return out


def paired(a: DataFrame, b: DataFrame, schema: str, run: Callable[[object, np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    """run on each matrix of a and the one of b that has its id."""
    kind = a.schema["mat_id"].dataType.simpleString()

    def each(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = run(key[0], matrix(left), matrix(right))
        found.insert(0, "mat_id", key[0])
        return found

    return a.groupBy("mat_id").cogroup(b.groupBy("mat_id")).applyInPandas(each, f"mat_id {kind}, {schema}")


def long(x: np.ndarray) -> pd.DataFrame:
    x = np.atleast_2d(x)
    i, j = np.indices(x.shape, np.int32).reshape(2, -1)
    return pd.DataFrame({"i": i, "j": j, "a": x.reshape(-1)})


def solved(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mat_id, i, j, a): X of A X = B for square A; a singular or missing A has no rows."""

    def run(_, left, right):
        if not left.size or left.shape[0] != left.shape[1] or len(right) != len(left) or np.linalg.matrix_rank(left) < len(left):
            return long(np.zeros((0, 1)))
        return long(np.linalg.solve(left, right))

    return paired(a, b, "i int, j int, a double", run)


def pointed(vectors: np.ndarray) -> np.ndarray:
    """Columns that point so that the largest entry is positive."""
    if not vectors.size:
        return vectors
    big = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return vectors * np.where(big < 0, -1.0, 1.0)


def eigen_pairs(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values ascending, vectors as columns) of A x = l B x for symmetric A and positive definite B; vectors have x' B x = 1. By Cholesky factors of B."""
    if b is None:
        values, vectors = np.linalg.eigh(a)
        return values, pointed(vectors)
    low = np.linalg.cholesky(b)
    inverse = np.linalg.inv(low)
    values, vectors = np.linalg.eigh(inverse @ a @ inverse.T)
    return values, pointed(inverse.T @ vectors)


def eigen_symmetric(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mat_id, part, value, i, x): the pairs of A x = l B x, values ascending. B that isn't positive definite has no rows."""

    def run(_, left, right):
        try:
            values, vectors = eigen_pairs(left, right)
        except np.linalg.LinAlgError:
            values, vectors = np.zeros(0), np.zeros((0, 0))
        found = long(vectors.T)
        return pd.DataFrame({"part": found["i"], "value": np.repeat(values, len(vectors)), "i": found["j"], "x": found["a"]})

    return paired(a, b, "part int, value double, i int, x double", run)


def eigen_general(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mat_id, part, re, im): values of A x = l B x for any square A and regular B, by real part, then imaginary. Infinite values, of a singular B, are left out."""

    def run(_, left, right):
        n = len(left)
        if not n or right.shape != left.shape:
            values = np.zeros(0, complex)
        elif np.linalg.matrix_rank(right) == n:
            values = np.linalg.eigvals(np.linalg.solve(right, left))
        else:  # values of the reversed problem are 1 / l; 0 stands for an infinite one
            back = np.linalg.eigvals(np.linalg.solve(left, right))
            values = 1 / back[np.abs(back) > 1e-10 * max(1e-300, np.abs(back).max())]
        values = values[np.lexsort((np.round(values.imag, 9), np.round(values.real, 9)))]
        return pd.DataFrame({"part": np.arange(len(values), dtype=np.int32), "re": np.round(values.real, 6) + 0.0, "im": np.round(values.imag, 6) + 0.0})

    return paired(a, b, "part int, re double, im double", run)


def unit_errors(a: DataFrame, q: DataFrame | None = None) -> DataFrame:
    """(mat_id, max_diag, max_off, avg_diag, avg_off): how far A Q A' (A A' without Q) is from the unit matrix, on and off the diagonal."""
    inner = a if q is None else product(a, q)
    e = product(inner, a, turn_b=True).withColumn("e", F.abs(F.col("a") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))
    on, off = F.when(F.col("i") == F.col("j"), F.col("e")), F.when(F.col("i") != F.col("j"), F.col("e"))
    return e.groupBy("mat_id").agg(*(F.round(F.coalesce(f(c), F.lit(0.0)), 9).alias(n) for n, f, c in (("max_diag", F.max, on), ("max_off", F.max, off), ("avg_diag", F.avg, on), ("avg_off", F.avg, off))))


def eigen_errors(a: DataFrame, pairs: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(mat_id, error): the largest root of |A x - l B x|^2 / l over the pairs (mat_id, part, value, i, x); without B of |A x - l x|^2 / l. Pairs of l <= 0 are left out."""
    vectors = pairs.select("mat_id", F.col("i"), F.col("part").alias("j"), F.col("x").alias("a"))
    own = pairs.filter("value > 0").select("mat_id", F.col("part").alias("j"), "i", "value", "x")
    left = product(a, vectors).withColumnRenamed("a", "__l")
    right = (product(b, vectors) if b is not None else vectors).withColumnRenamed("a", "__r")
    met = own.join(left, ["mat_id", "i", "j"]).join(right, ["mat_id", "i", "j"]).withColumn("d", F.col("__l") - F.col("value") * F.col("__r"))
    each = met.groupBy("mat_id", "j").agg(F.sqrt(F.sum(F.col("d") * F.col("d")) / F.max("value")).alias("e"))
    return each.groupBy("mat_id").agg(F.round(F.max("e"), 6).alias("error"))


def discriminants(vec: DataFrame, dims: int, parts: int) -> DataFrame:
    """(part, value, i, w): the unit axes along which classes differ most against their inner scatter, the strongest first.

    vec is (vec_id, label, i, e). Scatters are sums over samples by (i, j); dims^2 numbers reach the driver, whatever the samples. Fewer than two classes,
    a class of fewer than three samples or a singular inner scatter are errors.
    """
    sizes = vec.filter("i = 0").groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).first()
    if sizes["k"] < 2 or sizes["least"] < 3:
        raise ValueError("at least two classes of three samples are needed")
    full = lambda rows: matrix(rows.withColumnRenamed("c", "a").toPandas(), dims)
    total, inner = full(products(vec, dims, False)), full(products(vec, dims, True))
    values, vectors = eigen_pairs(total - inner, inner)
    values, vectors = values[::-1][:parts], pointed(vectors[:, ::-1][:, :parts] / np.linalg.norm(vectors[:, ::-1][:, :parts], axis=0))
    rows = [(p, float(np.round(values[p], 6)), i, float(np.round(vectors[i, p], 6))) for p in range(len(values)) for i in range(dims)]
    return vec.sparkSession.createDataFrame(rows, "part int, value double, i int, w double")
