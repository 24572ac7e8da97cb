"""Windows over pixels in long form (img_id, y, x, v): shifts, borders, stencils and boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F



def whole() -> WindowSpec:
    return Window.partitionBy("img_id")


def row() -> WindowSpec:
    return Window.partitionBy("img_id", "y")


def column() -> WindowSpec:
    return Window.partitionBy("img_id", "x")


def along() -> WindowSpec:
    return row().orderBy("x")


def down() -> WindowSpec:
    return column().orderBy("y")


def by_image(df: DataFrame) -> DataFrame:
    """Brings each image to one partition, which serves all row and column windows that follow: one shuffle for a chain of filters.

    Right for many images of bounded size. For few huge images leave it out; the windows then shuffle by row and by column.
    """
    return df.repartition("img_id")


def at(c: str | Column, by: int, over: WindowSpec) -> Column:
    """The value `by` places on (back, if negative); null beyond the edge."""
    c = F.col(c) if isinstance(c, str) else c
    return c if by == 0 else (F.lead(c, by) if by > 0 else F.lag(c, -by)).over(over)


def last(name: str, over: WindowSpec) -> Column:
    return F.max(name).over(over)


def replicate(df: DataFrame, names: list[str], my: int, mx: int) -> DataFrame:
    """Fills a border of my rows and mx columns with the nearest inner value; corners get the inner corner's."""
    if mx:
        low, high = F.col("x") < mx, F.col("x") > last("x", row()) - mx
        pick = lambda c: F.when(low, F.max(F.when(F.col("x") == mx, F.col(c))).over(row())).when(high, F.max(F.when(F.col("x") == F.col("__e"), F.col(c))).over(row())).otherwise(F.col(c))
        df = df.withColumn("__e", last("x", row()) - mx).withColumns({c: pick(c) for c in names}).drop("__e")
    if my:
        low, high = F.col("y") < my, F.col("y") > last("y", column()) - my
        pick = lambda c: F.when(low, F.max(F.when(F.col("y") == my, F.col(c))).over(column())).when(high, F.max(F.when(F.col("y") == F.col("__e"), F.col(c))).over(column())).otherwise(F.col(c))
        df = df.withColumn("__e", last("y", column()) - my).withColumns({c: pick(c) for c in names}).drop("__e")
    return df


def stencil(df: DataFrame, kernel: list[list[int]], out: str = "s", of: str = "v") -> DataFrame:
    """Adds the kernel's response, null where it reaches past the edge. Each distinct kernel row is one column of the first pass."""
    rows = list(dict.fromkeys(tuple(r) for r in kernel))
    hx, hy = len(rows[0]) // 2, len(kernel) // 2
    total = lambda parts: sum(parts[1:], parts[0])
    df = df.withColumns({f"__r{k}": total([at(of, j - hx, along()) * w for j, w in enumerate(r) if w] or [F.lit(0)]) for k, r in enumerate(rows)})
    return df.withColumn(out, total([at(f"__r{rows.index(tuple(r))}", i - hy, down()) for i, r in enumerate(kernel)])).drop(*(f"__r{k}" for k in range(len(rows))))


def box(df: DataFrame, agg: Callable, hy: int, hx: int, out: str = "s", of: str = "v") -> DataFrame:
    """agg over the (2hy+1)(2hx+1) box around each pixel, cut at the edge: along rows, then down columns."""
    mid = agg(F.col(of)).over(along().rowsBetween(-hx, hx))
    return df.withColumn("__m", mid).withColumn(out, agg(F.col("__m")).over(down().rowsBetween(-hy, hy))).drop("__m")


def inner(my: int, mx: int) -> Column:
    return (F.col("x") >= mx) & (F.col("x") <= last("x", row()) - mx) & (F.col("y") >= my) & (F.col("y") <= last("y", column()) - my)


def mirrored(df: DataFrame, hy: int, hx: int) -> DataFrame:
    """df with hx columns and hy rows more on each side, mirrored without repeating the edge."""

    def side(name: str, half: int, over: WindowSpec) -> Column:
        c, end = F.col(name), F.col("__end")
        return F.explode(F.array_compact(F.array(c, F.when((c >= 1) & (c <= half), -c), F.when((c <= end - 1) & (c >= end - half), 2 * end - c))))

    keep = ["img_id", "v"]
    df = df.withColumn("__end", last("x", whole())).select(*keep, "y", side("x", hx, row()).alias("x"))
    return df.withColumn("__end", last("y", whole())).select(*keep, "x", side("y", hy, column()).alias("y")).select("img_id", "y", "x", "v")
