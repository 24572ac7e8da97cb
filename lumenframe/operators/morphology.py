"""Order statistics and morphology on pixels in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import along, down, at, box, inner, replicate
from .filters import pixels


def erode(df: DataFrame, hy: int, hx: int) -> DataFrame:
    """Smallest value of the box; the border, where the box would leave the image, is replicated."""
    return pixels(replicate(box(df, F.min, hy, hx), ["s"], hy, hx), F.col("s"))


def dilate(df: DataFrame, hy: int, hx: int) -> DataFrame:
    return pixels(replicate(box(df, F.max, hy, hx), ["s"], hy, hx), F.col("s"))


def _cross() -> list[Column]:
    return [F.col("v"), at("v", -1, along()), at("v", 1, along()), at("v", -1, down()), at("v", 1, down())]


def erode_cross(df: DataFrame) -> DataFrame:
    return pixels(replicate(df.withColumn("s", F.least(*_cross())), ["s"], 1, 1), F.col("s"))


def dilate_cross(df: DataFrame) -> DataFrame:
    return pixels(replicate(df.withColumn("s", F.greatest(*_cross())), ["s"], 1, 1), F.col("s"))


def opening(df: DataFrame) -> DataFrame:
    return dilate(erode(df, 1, 1), 1, 1)


def eroded_difference(df: DataFrame) -> DataFrame:
    """v less its 3 x 3 erosion: what stands out of its surroundings."""
    low = replicate(box(df, F.min, 1, 1), ["s"], 1, 1)
    return pixels(low, F.col("v") - F.col("s"))


def median3x3(df: DataFrame) -> DataFrame:
    """Median of nine; the border is copied. Rows are sorted first, then the median is that of the largest low, middle of middles and least high."""
    a, b, c = at("v", -1, along()), F.col("v"), at("v", 1, along())
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    middle = lambda p, q, r: F.greatest(F.least(p, q), F.least(F.greatest(p, q), r))
    out = df.withColumns({"lo": low, "mi": middle(a, b, c), "hi": high})
    three = lambda n: [at(n, -1, down()), F.col(n), at(n, 1, down())]
    out = out.withColumns({"p": F.greatest(*three("lo")), "q": middle(*three("mi")), "r": F.least(*three("hi")), "in": inner(1, 1)})
    return pixels(out, F.when(F.col("in"), middle(F.col("p"), F.col("q"), F.col("r"))).otherwise(F.col("v")))


def binary_dilate(df: DataFrame, hy: int, hx: int) -> DataFrame:
    """255 where any pixel of the box, cut at the edge, is not zero."""
    return pixels(box(df, F.max, hy, hx), F.when(F.col("s") > 0, 255).otherwise(0))


def pack_bits(df: DataFrame, width: int = 32) -> DataFrame:
    """(img_id, y, word, bits): non-zero pixels as bits of words of `width` pixels, the leftmost in the lowest bit."""
    bit = F.when(F.col("v") != 0, F.expr(f"shiftleft(1L, x % {width})")).otherwise(F.lit(0).cast("long"))
    return df.groupBy("img_id", "y", F.expr(f"cast(x div {width} as int)").alias("word")).agg(F.sum(bit).alias("bits"))


# Half widths of the rows of the two bit discs, from the topmost row to the lowest.
DISCS = {3: [1, 2, 3, 3, 3, 2, 1], 4: [1, 3, 3, 4, 4, 4, 3, 3, 1]}


def disc_morphology(df: DataFrame, radius: int, grow: bool) -> DataFrame:
    """Erosion or dilation of v != 0 by a disc, pixels outside being empty: each row of the disc is a window along rows, shifted down."""
    if radius not in DISCS:
        raise ValueError("radius must be 3 or 4")
    bit = F.when(F.col("v") != 0, 1).otherwise(0)
    halves = dict(zip(range(-radius, radius + 1), DISCS[radius], strict=True))
    agg = F.max if grow else F.min
    df = df.withColumn("b", bit)
    df = df.withColumns({f"h{h}": agg("b").over(along().rowsBetween(-h, h)) if grow else F.when(F.count("b").over(along().rowsBetween(-h, h)) == 2 * h + 1, agg("b").over(along().rowsBetween(-h, h))).otherwise(0) for h in set(halves.values())})
    parts = [F.coalesce(at(f"h{h}", dy, down()), F.lit(0)) for dy, h in halves.items()]
    return pixels(df, F.greatest(*parts) if grow else F.least(*parts))
