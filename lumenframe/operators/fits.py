"""Curves through points: ellipses from moments, and least squares for any model by damped Gauss-Newton steps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Powers of x and y whose sums the fits need.
POWERS = [(i, j) for i in range(5) for j in range(5 - i)]


def fourth_moments(points: DataFrame, key: str = "set_id", scale: float = 1.0) -> DataFrame:
    """(key, m00, m10, ...): sums of x^i y^j up to the fourth order, made before the shuffle; a row a set, whatever its points."""
    x, y = F.col("x").cast("double") / scale, F.col("y").cast("double") / scale
    term = lambda i, j: math.prod([x] * i + [y] * j, start=F.lit(1.0))
    return points.groupBy(key).agg(*(F.sum(term(i, j)).alias(f"m{i}{j}") for i, j in POWERS))


def from_conic(c: np.ndarray) -> tuple[float, ...] | None:
    """(xc, yc, a, b, tilt) of A x^2 + B x y + C y^2 + D x + E y = 1, or None if it is no ellipse; a lies along the tilt."""
    tilt = float(np.arctan2(c[1], c[0] - c[2]) / 2)
    co, si = np.cos(tilt), np.sin(tilt)
    # In turned coordinates the curve has no mixed term.
    p, q = c[0] * co * co + c[1] * co * si + c[2] * si * si, c[0] * si * si - c[1] * co * si + c[2] * co * co
    d, e = c[3] * co + c[4] * si, c[4] * co - c[3] * si
    if p == 0 or q == 0:
        return None
    size = 1 + d * d / (4 * p) + e * e / (4 * q)
    if p * size <= 0 or q * size <= 0:
        return None
    xt, yt = -d / (2 * p), -e / (2 * q)
    return xt * co - yt * si, xt * si + yt * co, float(np.sqrt(size / p)), float(np.sqrt(size / q)), tilt


def design(m: dict[str, float]) -> np.ndarray:
    """Sums of products of (x^2, x y, y^2, x, y, 1)."""
    terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)]
    return np.array([[m[f"m{a + c}{b + d}"] for c, d in terms] for a, b in terms])


def algebraic(m: dict[str, float]) -> tuple[float, ...] | None:
    """Least squares of the conic's equation with free term 1; five points at least, not on a line."""
    s = design(m)
    if m["m00"] < 5 or (m["m20"] * m["m02"] - m["m11"] ** 2) / (m["m20"] + m["m02"]) ** 2 < 1e-5 or np.linalg.matrix_rank(s[:5, :5]) < 5:
        return None
    return from_conic(np.linalg.solve(s[:5, :5], s[:5, 5]))


def constrained(m: dict[str, float]) -> tuple[float, ...] | None:
    """Least squares under 4 A C - B^2 = 1, which holds for ellipses only; the linear terms are eliminated first, so points that lie on the curve are no harm."""
    s = design(m)
    if np.linalg.matrix_rank(s[3:, 3:]) < 3:
        return None
    linear = -np.linalg.solve(s[3:, 3:], s[3:, :3])
    k = np.array([[0.0, 0.0, 2.0], [0.0, -1.0, 0.0], [2.0, 0.0, 0.0]])
    vectors = np.linalg.eig(np.linalg.solve(k, s[:3, :3] + s[:3, 3:] @ linear))[1]
    good = [v.real for v in vectors.T if np.abs(v.imag).max() < 1e-9 and 4 * v[0].real * v[2].real - v[1].real ** 2 > 1e-9]
    if len(good) != 1:
        return None
    a = np.concatenate([good[0], linear @ good[0]])
    return from_conic(-a[:5] / a[5]) if a[5] else None


def ellipses(points: DataFrame, key: str = "set_id", fit: Callable = algebraic, scale: float = 100.0) -> DataFrame:
    """(key, xc, yc, a, b, tilt, off): the ellipse through each set's points and their mean distance from it in the ellipse's own measure; sets without an ellipse are left out.

    Coordinates are divided by `scale` while sums are made, which keeps the equations well conditioned.
    """
    moments = fourth_moments(points, key, scale)
    kind = points.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r[key], *(v * scale for v in e[:4]), e[4]) for r in pdf.to_dict("records") if (e := fit(r)) is not None]
            yield pd.DataFrame(rows, columns=[key, "xc", "yc", "a", "b", "tilt"])

    found = moments.mapInPandas(run, f"{key} {kind}, xc double, yc double, a double, b double, tilt double")
    dx, dy = F.col("x") - F.col("xc"), F.col("y") - F.col("yc")
    u, v = (dx * F.cos("tilt") + dy * F.sin("tilt")) / F.col("a"), (dy * F.cos("tilt") - dx * F.sin("tilt")) / F.col("b")
    away = points.join(found, key).groupBy(key, "xc", "yc", "a", "b", "tilt").agg(F.avg(F.abs(u * u + v * v - 1)).alias("off"))
    return away.select(key, *(F.round(c, 6).alias(c) for c in ("xc", "yc", "a", "b", "tilt", "off")))


def least_squares(residuals: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 200, near: float = 1e-10) -> tuple[np.ndarray, float, bool]:
    """(parameters, sum of squares, settled): Gauss-Newton steps, damped so that the sum never rises; slopes by central differences.

    The damping falls after a step that helped and rises after one that didn't. Settled: the last step changed the sum or the parameters by less than `near` of them.
    """
    p, damp = np.asarray(start, np.float64).copy(), 1e-3
    r = residuals(p)
    total = float(r @ r)
    for _ in range(steps):
        h = 1e-6 * np.maximum(1.0, np.abs(p))
        slope = np.stack([(residuals(p + e) - residuals(p - e)) / (2 * e[i]) for i, e in enumerate(np.diag(h))], 1)
        a, g = slope.T @ slope, slope.T @ r
        while True:
            step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g, rcond=None)[0]
            new = residuals(p + step)
            if (now := float(new @ new)) <= total:
                break
            damp *= 10
            if damp > 1e12:
                return p, total, True
        done = total - now <= near * total or float(np.abs(step).max()) <= near * max(1.0, float(np.abs(p).max()))
        p, r, total, damp = p + step, new, now, max(damp / 10, 1e-12)
        if done:
            return p, total, True
    return p, total, False


def model_fits(df: DataFrame, key: str, columns: list[str], residuals: Callable[[np.ndarray, pd.DataFrame], np.ndarray], start: Callable[[pd.DataFrame], np.ndarray], names: list[str]) -> DataFrame:
    """(key, names, squares, settled): each set's parameters by least_squares(); a set is worked on as a whole, so sets are of bounded size."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, total, settled = least_squares(lambda q: residuals(q, pdf), start(pdf))
        return pd.DataFrame({key: pdf[key].iloc[:1], **{n: [round(float(v), 6) + 0.0] for n, v in zip(names, p, strict=True)}, "squares": [round(total, 6)], "settled": [settled]})

    return df.select(key, *columns).groupBy(key).applyInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names) + ", squares double, settled boolean")


def geometric_circle(points: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, xc, yc, r, squares, settled): the circle of least squared distances, from the points' mean and mean distance on."""

    def away(p: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
        return np.hypot(pdf["x"].to_numpy(np.float64) - p[0], pdf["y"].to_numpy(np.float64) - p[1]) - p[2]

    def first(pdf: pd.DataFrame) -> np.ndarray:
        x, y = pdf["x"].to_numpy(np.float64), pdf["y"].to_numpy(np.float64)
        return np.array([x.mean(), y.mean(), np.hypot(x - x.mean(), y - y.mean()).mean()])

    return model_fits(points, key, ["x", "y"], away, first, ["xc", "yc", "r"])
