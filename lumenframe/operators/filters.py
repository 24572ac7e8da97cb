"""Smoothing, difference and normalising filters on pixels in long form; every function takes and returns (img_id, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import along, down, whole, at, box, inner, mirrored, replicate, stencil

# The integer kernels.
BLUR3 = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]
UNIFORM3 = [[1, 1, 1]] * 3
BLUR5 = [[2, 7, 12, 7, 2], [7, 31, 52, 31, 7], [12, 52, 127, 52, 12], [7, 31, 52, 31, 7], [2, 7, 12, 7, 2]]
LINE5, LINE3 = [12, 52, 127, 52, 12], [52, 127, 52]


def pixels(df: DataFrame, c) -> DataFrame:
    return df.select("img_id", "y", "x", c.cast("int").alias("v"))


def smooth(df: DataFrame, kernel: list[list[int]], divisor: int | None, bias: int = 0) -> DataFrame:
    """(kernel response + bias) div divisor inside, border replicated; without divisor the plain response."""
    my, mx = len(kernel) // 2, len(kernel[0]) // 2
    out = stencil(df, kernel).withColumn("s", F.expr(f"(s + {bias}) div {divisor}") if divisor else F.col("s"))
    return pixels(replicate(out, ["s"], my, mx), F.col("s"))


def blur3x3(df):
    return smooth(df, BLUR3, 16)


def blur3x3_sum(df):
    return smooth(df, BLUR3, None)


def uniform3x3(df):
    return smooth(df, UNIFORM3, 9)


def blur5x5(df):
    return smooth(df, BLUR5, 571)


def blur_down5(df):
    return smooth(df, [[w] for w in LINE5], 255, 125)


def blur_along5(df):
    return smooth(df, [LINE5], 255)


def blur_down3(df):
    return smooth(df, [[w] for w in LINE3], 231)


def blur_along3(df):
    return smooth(df, [LINE3], 231)


def shifted_difference(df: DataFrame, shift: int, vertical: bool) -> DataFrame:
    """127 + 4 (before - after) within 5 to 250, `shift` apart; the border is replicated."""
    up = (shift - 1) // 2
    dn = shift - up
    over = down() if vertical else along()
    s = df.withColumn("s", F.least(F.lit(250), F.greatest(F.lit(5), 127 + 4 * at("v", -up, over) - 4 * at("v", dn, over))))
    return pixels(replicate(s, ["s"], dn if vertical else 0, 0 if vertical else dn), F.col("s"))


def median_along3(df: DataFrame) -> DataFrame:
    """Median of three along rows; at both ends the mean of two, rounded down."""
    before, after, v = at("v", -1, along()), at("v", 1, along()), F.col("v")
    middle = F.greatest(F.least(before, v), F.least(F.greatest(before, v), after))
    two = F.floor((v + F.coalesce(before, after)) / 2)
    return pixels(df.withColumn("s", F.when(before.isNull() | after.isNull(), two).otherwise(middle)), F.col("s"))


def clear_alone(df: DataFrame) -> DataFrame:
    """Zeroes inner pixels all of whose eight neighbours are zero."""
    out = box(df, F.sum, 1, 1).withColumn("in", inner(1, 1))
    return pixels(out, F.when(F.col("in") & (F.col("s") == F.col("v")), 0).otherwise(F.col("v")))


def local_variation(df: DataFrame, wy: int, wx: int) -> DataFrame:
    """Largest less smallest value of the box around each inner pixel; only inner pixels are returned."""
    out = box(box(df, F.max, wy, wx, "hi"), F.min, wy, wx, "lo").withColumn("in", inner(wy, wx))
    return pixels(out.filter("in"), F.col("hi") - F.col("lo"))


def local_max_drop(df: DataFrame, wy: int, wx: int) -> DataFrame:
    """One more than the height over the box's smallest value, as a byte; the border is replicated."""
    out = box(df, F.min, wy, wx, "lo").withColumn("s", (1 + F.col("v") - F.col("lo")).bitwiseAND(255))
    return pixels(replicate(out, ["s"], wy, wx), F.col("s"))


def mirror_sums(df: DataFrame, hy: int, hx: int) -> DataFrame:
    """(img_id, y, x, v, s, s2): sums of values and of squares over the mirrored box."""
    ends = Window.partitionBy("img_id")
    wide = mirrored(df, hy, hx).withColumn("q", F.col("v").cast("long") * F.col("v"))
    out = box(box(wide, F.sum, hy, hx, "s", "v"), F.sum, hy, hx, "s2", "q")
    return out.withColumn("__x", F.max("x").over(ends) - hx).withColumn("__y", F.max("y").over(ends) - hy).filter("x >= 0 and y >= 0 and x <= __x and y <= __y")


def box_mean(df: DataFrame, hy: int, hx: int) -> DataFrame:
    """Mean of the mirrored box; each column's sum starts from one, so the box's width is added to its sum."""
    return pixels(mirror_sums(df, hy, hx).withColumn("s", F.expr(f"(s + {2 * hx + 1}) div {(2 * hx + 1) * (2 * hy + 1)}")), F.col("s").bitwiseAND(255))


def local_normalise(df: DataFrame, hy: int, hx: int) -> DataFrame:
    """v * 127 * box size div the box's sum (plus its width), as a byte that wraps."""
    return pixels(mirror_sums(df, hy, hx).withColumn("s", F.expr(f"(v * {(2 * hx + 1) * (2 * hy + 1) * 127}L) div (s + {2 * hx + 1})")), F.col("s").bitwiseAND(255))


def box_mean_deviation(df: DataFrame, hy: int, hx: int, times: int) -> DataFrame:
    """(img_id, y, x, mean, disp): mean of the mirrored box, and `times` its standard deviation, rounded and at most 255."""
    n = (2 * hx + 1) * (2 * hy + 1)
    spread = F.sqrt((F.col("s2") - F.col("s").cast("double") * F.col("s") / n) / n)
    return mirror_sums(df, hy, hx).select("img_id", "y", "x", F.expr(f"s div {n}").cast("int").alias("mean"), F.least(F.lit(255), F.floor(times * spread + 0.5)).cast("int").alias("disp"))


def global_normalise(df: DataFrame, level: int) -> DataFrame:
    """Scales so that the image's mean is `level`, with an 8-bit fixed-point factor; images within half a level stay as they are."""
    n, total = F.count(F.lit(1)).over(whole()), F.sum("v").over(whole())
    out = df.withColumn("n", n).withColumn("t", total)
    near = (F.col("t") > F.col("n") * level - F.expr("n div 2")) & (F.col("t") < F.col("n") * level + F.expr("n div 2"))
    out = out.withColumn("mul", F.expr(f"(n * {level} * 256 + 128) div t"))
    return pixels(out, F.when(near, F.col("v")).otherwise(F.least(F.lit(255), F.shiftright(F.col("v") * F.col("mul"), 8))))


def diffuse(df: DataFrame, k: float, rate: float, steps: int) -> DataFrame:
    """Edge-preserving diffusion in doubles: each step adds rate * sum of d exp(-|d| / k^2) over the four neighbours' differences d."""
    for _ in range(steps):
        flows = [at("v", by, over) - F.col("v") for by in (-1, 1) for over in (along(), down())]
        total = sum((F.coalesce(d * F.exp(-F.abs(d) / (k * k)), F.lit(0.0)) for d in flows[1:]), F.coalesce(flows[0] * F.exp(-F.abs(flows[0]) / (k * k)), F.lit(0.0)))
        df = df.withColumn("v", F.col("v").cast("double")).withColumn("v", F.col("v") + rate * total)
    return df.select("img_id", "y", "x", "v")


# Fixed value: the base of the Gaussian's exponential.
BASE = 2.71828


def gaussian(df: DataFrame, sigma: float | Column, boost: float = 1.0, most: float | None = None) -> DataFrame:
    """Separable Gaussian of half width ceil(2.5 sigma), weights renewed at the edge; doubles. sigma may be a column of at most `most`."""
    half = -int(-2.5 * (sigma if most is None else most) // 1)
    if most is None:
        weights = [F.lit(BASE ** (-0.5 * (j / sigma) ** 2)) for j in range(-half, half + 1)]
    else:
        df = df.withColumn("__s", sigma)
        weights = [F.when(F.ceil(2.5 * F.col("__s")) >= abs(j), F.pow(F.lit(BASE), -0.5 * j * j / (F.col("__s") * F.col("__s")))).otherwise(0.0) for j in range(-half, half + 1)]

    def line(c: str, over) -> Column:
        parts = [(at(c, j - half, over), w) for j, w in enumerate(weights)]
        value = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts[1:]), F.coalesce(parts[0][0] * parts[0][1], F.lit(0.0)))
        mass = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
        return value / mass

    return df.withColumn("m", line("v", along())).withColumn("s", line("m", down()) * boost).select("img_id", "y", "x", F.col("s").alias("v"))
