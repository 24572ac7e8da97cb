"""Rectangles, discs, rings, lines and contours as masks, and what is measured inside them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import along, at, down
from .components import labelled

#: (x, y, width, height)
Rect = tuple[int, int, int, int]


def expanded(rects: DataFrame, by_x: int, by_y: int, bound: Rect) -> DataFrame:
    """(..., x, y, w, h) grown on each side and cut to `bound`; one that lies wholly outside is 0, 0, 0, 0."""
    bx, by, bw, bh = bound
    wide = rects.withColumns({"__l": F.col("x") - by_x, "__t": F.col("y") - by_y, "__r": F.col("x") + F.col("w") + by_x, "__b": F.col("y") + F.col("h") + by_y})
    meets = F.expr(f"__l < {bx + bw} and __t < {by + bh} and __r > {bx} and __b > {by}")
    cut = wide.withColumns({"__l2": F.greatest("__l", F.lit(bx)), "__t2": F.greatest("__t", F.lit(by)), "__r2": F.least("__r", F.lit(bx + bw)), "__b2": F.least("__b", F.lit(by + bh))})
    out = {"x": F.col("__l2"), "y": F.col("__t2"), "w": F.col("__r2") - F.col("__l2"), "h": F.col("__b2") - F.col("__t2")}
    return cut.withColumns({k: F.when(meets, v).otherwise(0) for k, v in out.items()}).drop("__l", "__t", "__r", "__b", "__l2", "__t2", "__r2", "__b2")


def octant(radius: int) -> list[tuple[int, int]]:
    """(x, y) of the digital circle's arc from the horizontal axis to the diagonal, y counting up from 0."""
    x, y, error, out = radius, 0, 3 - 2 * radius, []
    while y <= x:
        out.append((x, y))
        if error < 0:
            error += 4 * y + 6
        else:
            error += 4 * (y - x) + 10
            x -= 1
        y += 1
    return out


def disc_rows(radius: int) -> dict[int, int]:
    """Half width of each row of the digital disc, by distance from its middle row; a radius of 0 is 1."""
    rows: dict[int, int] = {}
    for x, y in octant(max(1, radius)):
        rows[y] = max(rows.get(y, 0), x)
        if y < x:
            rows[x] = max(rows.get(x, 0), y)
    return rows


def in_rows(rows: dict[int, tuple[int, int]], yc: int, xc: int) -> Column:
    """Whether a pixel's distance from column xc lies between the two limits of its row; rows count from yc both ways."""
    if not rows:
        return F.lit(False)
    limits = F.create_map(*(x for dy, (a, z) in rows.items() for x in (F.lit(dy), F.array(F.lit(a), F.lit(z)))))
    own = F.element_at(limits, F.abs(F.col("y") - yc))
    away = F.abs(F.col("x") - xc)
    return F.coalesce((away >= own[0]) & (away <= own[1]), F.lit(False))


def in_disc(yc: int, xc: int, radius: int, roi: Rect) -> Column:
    """Inside the digital disc and the region; the column just right of the region counts as inside."""
    x, y, w, h = roi
    return in_rows({dy: (0, half) for dy, half in disc_rows(radius).items()}, yc, xc) & F.expr(f"x >= {x} and x <= {x + w} and y >= {y} and y < {y + h}")


def in_half_ring(yc: int, xc: int, first: int, last: int, roi: Rect) -> Column:
    """Inside the left and right quarters of a digital ring, up to the diagonals, and the region; the column just right of the region counts as inside."""
    x, y, w, h = roi
    outer, rows = octant(max(1, last)), {}
    inner = {dy: at for at, dy in octant(first)} if first else {}
    for far, dy in outer:
        near = max(inner.get(dy, dy), dy) if first else 0
        if near <= far:
            rows[dy] = (near, far)
    return in_rows(rows if first <= last else {}, yc, xc) & F.expr(f"x >= {x} and x <= {x + w} and y >= {y} and y < {y + h}")


def painted(df: DataFrame, where: Column, value: int) -> DataFrame:
    return df.select("img_id", "y", "x", F.when(where, F.lit(value)).otherwise(F.col("v")).alias("v"))


def ridge_mass(df: DataFrame, where: Column | None = None) -> DataFrame:
    """(img_id, ridge, mass): the sum of all values, and of those that exceed both neighbours in one of four directions; a neighbour that is missing is exceeded, two are not."""
    m = df.withColumns({"l": at("v", -1, along()), "r": at("v", 1, along())})
    m = m.withColumns({k: at(c, by, down()) for k, c, by in (("u", "v", -1), ("d", "v", 1), ("ul", "l", -1), ("ur", "r", -1), ("dl", "l", 1), ("dr", "r", 1))})
    over = lambda a, b: (F.col(a).isNotNull() | F.col(b).isNotNull()) & (F.col("v") > F.coalesce(a, F.lit(-1))) & (F.col("v") > F.coalesce(b, F.lit(-1)))
    ridge = over("l", "r") | over("u", "d") | over("ul", "dr") | over("ur", "dl")
    inside = m if where is None else m.filter(where)
    return inside.groupBy("img_id").agg(F.sum(F.when(ridge & (F.col("v") != 0), F.col("v")).otherwise(0)).cast("long").alias("ridge"), F.sum("v").cast("long").alias("mass"))


def sobel_whole(df: DataFrame, most: int | None = 255) -> DataFrame:
    """(img_id, y, x, v) for all pixels: length of the Sobel gradient, rounded down, at most `most`; beyond the edge the edge repeats."""
    side = lambda c, by, over: F.coalesce(at(c, by, over), F.col(c))
    rows = df.withColumns({"l": side("v", -1, along()), "r": side("v", 1, along())})
    rows = rows.withColumns({"h": F.col("r") - F.col("l"), "w": F.col("l") + 2 * F.col("v") + F.col("r")})
    g = rows.withColumns({"gx": side("h", -1, down()) + 2 * F.col("h") + side("h", 1, down()), "gy": side("w", 1, down()) - side("w", -1, down())})
    length = F.floor(F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))).cast("int")
    return g.select("img_id", "y", "x", (F.least(F.lit(most), length) if most is not None else length).alias("v"))


def line_pixels(lines: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, y, x): the pixels of straight lines (key, x0, y0, x1, y1): as many even steps as the rounded length, from the first point on, without the last point."""
    dx, dy = (F.col(f"{c}1").cast("double") - F.col(f"{c}0") for c in "xy")
    n = F.floor(F.col("len") + 0.5).cast("int")
    steps = lines.withColumn("len", F.sqrt(dx * dx + dy * dy)).withColumn("n", n).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    place = lambda c, d: F.floor(F.col(f"{c}0") + F.col("k") * d / F.col("len") + 0.5).cast("int").alias(c)
    return steps.select(key, place("y", dy), place("x", dx)).filter(f"y >= 0 and x >= 0 and y < {height} and x < {width}").distinct()


def contour_mask(radii: DataFrame, yc: int, xc: int, height: int, width: int, clockwise: bool = False, key: str = "set_id") -> DataFrame:
    """(key, y, x): pixels on and inside the closed line through the points at radius r and angle 2 pi i / count around a centre, for (key, i, r) with i from 0 on.

    Inside is what joins the centre (4 neighbours) without crossing the line; the part beyond the height x width image is left out.
    """
    turn = F.lit(-1 if clockwise else 1)
    own = Window.partitionBy(key).orderBy("i")
    count = F.count(F.lit(1)).over(Window.partitionBy(key))
    angle = 2 * math.pi * F.col("i") / F.col("__n")
    trunc = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
    points = radii.withColumn("__n", count).select(key, "i", trunc(xc + F.col("r") * F.cos(angle) + 0.5).alias("x0"), trunc(yc + F.col("r") * F.sin(angle) * turn + 0.5).alias("y0"))
    first = lambda c: F.first(c).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = points.withColumns({"x1": F.coalesce(F.lead("x0").over(own), first("x0")), "y1": F.coalesce(F.lead("y0").over(own), first("y0"))})
    # Lines may leave the image; the frame around the largest radius holds all of them.
    reach = radii.agg(F.max("r")).first()[0] or 0
    top, left = int(min(0, yc - reach - 3)), int(min(0, xc - reach - 3))
    rows, cols = int(max(height, yc + reach + 4)) - top, int(max(width, xc + reach + 4)) - left
    moved = ends.select(key, *((F.col(c) - (left if c[0] == "x" else top)).alias(c) for c in ("x0", "y0", "x1", "y1")))
    line = line_pixels(moved, key, rows, cols)
    grid = radii.select(key).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    free = labelled(grid.join(line, [key, "y", "x"], "left_anti").withColumnRenamed(key, "img_id"))
    centre = free.filter((F.col("y") == yc - top) & (F.col("x") == xc - left)).select("img_id", "comp")
    inside = free.join(centre, ["img_id", "comp"]).select(F.col("img_id").alias(key), "y", "x")
    both = inside.unionByName(line).distinct().select(key, (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"))
    return both.filter(f"y >= 0 and x >= 0 and y < {height} and x < {width}")


def ring_mask(include: DataFrame, exclude: DataFrame, centre: tuple[int, int], hole: tuple[int, int], height: int, width: int, clockwise: bool = False, key: str = "set_id") -> DataFrame:
    """(key, y, x): the mask of one contour without that of another; centres are (y, x)."""
    outer = contour_mask(include, *centre, height, width, clockwise, key)
    return outer.join(contour_mask(exclude, *hole, height, width, clockwise, key), [key, "y", "x"], "left_anti")


def stretched(df: DataFrame, roi: Rect, height: int, width: int) -> DataFrame:
    """A region of each image brought to height x width pixels by bilinear interpolation in 2^-8 pixels; 0 where the region lies outside the image.

    Column j lies at 256 j (w - 1) div width; the last column and row that lie in the image stand on a whole pixel.
    """
    x0, y0, w, h = roi
    images = df.groupBy("img_id").agg((F.max("y") + 1).alias("sh"), (F.max("x") + 1).alias("sw"))

    def line(name: str, size: int, first: int, span: int, source: str) -> dict[str, Column]:
        """Destination start and length that the image covers."""
        start = 0 if first >= 0 else -first * size // (span - 1)
        covered = F.when(F.col(source) < first + span, F.expr(f"({-first} + {source} - 1) * {size} div {span - 1}") - start).otherwise(size - start)
        return {f"{name}s": F.lit(start), f"{name}n": covered.cast("int")}

    at_ = images.withColumns(line("x", width, x0, w, "sw") | line("y", height, y0, h, "sh"))
    at_ = at_.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    step = lambda c, size, span: F.expr(f"case when {c} - {c}s = {c}n - 1 then (256 * ({c} - {c}s) * {span - 1} div {size}) div 256 * 256 else 256 * ({c} - {c}s) * {span - 1} div {size} end")
    at_ = at_.withColumns({"ok": F.expr("x >= xs and x < xs + xn and y >= ys and y < ys + yn"), "px": step("x", width, w), "py": step("y", height, h)})
    corner = F.explode(F.array(*(F.struct(F.lit(j).alias("dy"), F.lit(k).alias("dx")) for j in (0, 1) for k in (0, 1)))).alias("k")
    part = lambda g, k: F.when(F.col(k) == 1, F.col(g) % 256).otherwise(256 - F.col(g) % 256)
    four = at_.select("img_id", "y", "x", "ok", "px", "py", corner).select("img_id", "y", "x", "ok", (part("py", "k.dy") * part("px", "k.dx")).alias("wt"), F.expr(f"cast({max(0, y0)} + py div 256 + k.dy as int)").alias("sy"), F.expr(f"cast({max(0, x0)} + px div 256 + k.dx as int)").alias("sx"))
    met = four.join(df.select("img_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "v"), ["img_id", "sy", "sx"], "left")
    return met.groupBy("img_id", "y", "x", "ok").agg(F.shiftright(F.sum(F.col("wt") * F.coalesce("v", F.lit(0))), 16).alias("s")).select("img_id", "y", "x", F.when(F.col("ok"), F.col("s")).otherwise(0).cast("int").alias("v"))
