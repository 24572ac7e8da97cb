"""Gradients, edges and votes for circles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import along, at, column, down, inner, row, stencil
from .components import reached
from .filters import gaussian


def gradient(df: DataFrame, of: str = "v") -> DataFrame:
    """Adds gx and gy: central differences, one-sided at the edges."""
    side = lambda by, over: F.coalesce(at(of, by, over), F.col(of))
    return df.withColumns({"gx": side(1, along()) - side(-1, along()), "gy": side(1, down()) - side(-1, down())})


def magnitude(df: DataFrame) -> DataFrame:
    """gradient() with mag, its rounded length."""
    return gradient(df).withColumn("mag", F.floor(F.lit(0.5) + F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))).cast("int"))


# The Sobel kernels.
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
SOBEL_Y = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]


def sobel(df: DataFrame, most: int | None = 255) -> DataFrame:
    """(img_id, y, x, v) for inner pixels: length of the Sobel gradient, rounded down, at most `most`."""
    out = stencil(stencil(df, SOBEL_X, "gx"), SOBEL_Y, "gy").withColumn("in", inner(1, 1)).filter("in")
    length = F.floor(F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double"))).cast("int")
    return out.select("img_id", "y", "x", (F.least(F.lit(most), length) if most is not None else length).alias("v"))


def thinned(df: DataFrame) -> DataFrame:
    """magnitude() of the pixels that are peaks along their gradient.

    The magnitude is interpolated between the two neighbours that enclose the gradient's direction, one beside the pixel along the longer component
    and one diagonal; both sides must lie lower. The outer row and column on the near sides and two on the far sides hold no peaks.
    """
    m = magnitude(df).withColumns({"l": at("mag", -1, along()), "r": at("mag", 1, along())})
    m = m.withColumns({k: at(c, by, down()) for k, c, by in (("u", "mag", -1), ("d", "mag", 1), ("ul", "l", -1), ("ur", "r", -1), ("dl", "l", 1), ("dr", "r", 1))})
    ax, ay = F.abs("gx"), F.abs("gy")
    right, lower, wide = F.col("gx") >= 0, F.col("gy") >= 0, ax >= ay
    pick = lambda a, b, c, d: F.when(right & lower, F.col(a)).when(right, F.col(b)).when(lower, F.col(c)).otherwise(F.col(d))
    back, front = F.when(wide, pick("l", "l", "r", "r")).otherwise(pick("u", "d", "u", "d")), F.when(wide, pick("r", "r", "l", "l")).otherwise(pick("d", "u", "d", "u"))
    slope = lambda near, corner: (near - F.col("mag")) * F.greatest(ax, ay) + (corner - near) * F.least(ax, ay)
    m = m.withColumns({"p": slope(back, pick("ul", "dl", "ur", "dr")), "q": slope(front, pick("dr", "ur", "dl", "ul")), "ex": F.max("x").over(row()), "ey": F.max("y").over(column())})
    return m.filter("mag > 0 and p < 0 and q < 0 and x >= 1 and y >= 1 and x < ex - 1 and y < ey - 1").select("img_id", "y", "x", "gx", "gy", "mag")


def smoothed(df: DataFrame, sigma: float | Column, most: float | None = None) -> DataFrame:
    """Gaussian of 90 times the values, rounded. sigma may be a column of at most `most`."""
    return gaussian(df, sigma, 90.0, most).withColumn("v", F.floor(F.col("v") + 0.5).cast("int"))


def thresholds(peaks: DataFrame, low: float | str, high: float | str) -> DataFrame:
    """(img_id, hi, lo): hi is the magnitude below which the share `high` of the peaks lies, at most one below the largest; lo = hi * low, rounded.

    low and high are numbers, or names of columns of peaks that have one value for each image.
    """
    own = [c for c in (low, high) if isinstance(c, str)]
    low, high = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (low, high))
    counts = peaks.groupBy("img_id", *own, "mag").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("img_id").orderBy("mag").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("cum", F.sum("n").over(up_to)).withColumn("mass", F.sum("n").over(Window.partitionBy("img_id")))
    found = cum.groupBy("img_id", *own).agg(F.min(F.when(F.col("cum") >= F.floor(F.col("mass") * high + 0.5), F.col("mag"))).alias("h"), F.max("mag").alias("top"))
    hi = F.greatest(F.lit(1), F.least(F.col("h"), F.col("top") - 1))
    return found.select("img_id", hi.cast("int").alias("hi"), F.floor(hi * low + 0.5).cast("int").alias("lo"))


def canny(df: DataFrame, sigma: float, low: float, high: float) -> DataFrame:
    """(img_id, y, x, gx, gy, mag) of the smoothed image: peaks of at least hi, and those above lo that touch them by way of others above lo (8 neighbours)."""
    peaks = thinned(smoothed(df, sigma))
    marked = peaks.join(thresholds(peaks, low, high), "img_id").filter("mag >= hi or mag > lo")
    return reached(marked.withColumn("seed", F.col("mag") >= F.col("hi"))).select("img_id", "y", "x", "gx", "gy", "mag")


def edge_points(df: DataFrame, least: int, margin: int) -> DataFrame:
    """(img_id, y, x, gx, gy, dir): pixels of gradient `least` or more, `margin` from the edge; dir in degrees from 0 to 359."""
    g = magnitude(df).withColumn("in", inner(margin, margin)).filter(F.col("in") & (F.col("mag") >= least))
    return g.select("img_id", "y", "x", "gx", "gy", F.pmod(F.floor(F.degrees(F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double")))), F.lit(360)).cast("int").alias("dir"))


def pair_votes(points: DataFrame, turn: int, width: int, least: float, most: float) -> DataFrame:
    """(img_id, yc, xc, n): centres of circles through pairs of edge points whose directions differ by turn +- width degrees.

    The normals of a pair meet in the centre; the pair counts if both points are about equally far from it and least to most away. Directions are
    cut into bins of 2 width + 1 degrees; a point meets only the two bins that may hold its partners, not the whole image.
    """
    size = 2 * width + 1
    bins = -(-360 // size)
    a = points.select("img_id", *(F.col(c).alias(c + "1") for c in ("y", "x", "gx", "gy", "dir")))
    start = F.pmod(F.col("dir1") + turn - width, F.lit(360))
    stop = F.pmod(F.col("dir1") + turn + width, F.lit(360))
    a = a.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor(start / size), F.floor(stop / size), F.pmod(F.floor(start / size) + 1, F.lit(bins))))))
    b = points.select("img_id", *(F.col(c).alias(c + "2") for c in ("y", "x", "gx", "gy", "dir")), F.floor(F.col("dir") / size).alias("bin"))
    off = F.pmod(F.col("dir2") - F.col("dir1") - turn + width, F.lit(360))
    pairs = a.join(b, ["img_id", "bin"]).filter(off <= 2 * width)
    cross = (F.col("gx1") * F.col("gy2") - F.col("gy1") * F.col("gx2")).cast("double")
    t = ((F.col("x2") - F.col("x1")) * F.col("gy2") - (F.col("y2") - F.col("y1")) * F.col("gx2")) / cross
    met = pairs.withColumn("cross", cross).filter("cross <> 0").withColumn("t", t).withColumns({"fx": F.col("x1") + F.col("t") * F.col("gx1"), "fy": F.col("y1") + F.col("t") * F.col("gy1")})
    far = lambda k: F.sqrt((F.col("fx") - F.col(f"x{k}")) * (F.col("fx") - F.col(f"x{k}")) + (F.col("fy") - F.col(f"y{k}")) * (F.col("fy") - F.col(f"y{k}")))
    ok = met.withColumns({"r1": far(1), "r2": far(2)}).filter((F.abs(F.col("r1") - F.col("r2")) < 2) & (F.greatest("r1", "r2") >= least) & (F.greatest("r1", "r2") <= most))
    return ok.groupBy("img_id", F.floor(F.col("fy") + 0.5).cast("int").alias("yc"), F.floor(F.col("fx") + 0.5).cast("int").alias("xc")).agg(F.count(F.lit(1)).alias("n"))


def best_centre(votes: DataFrame) -> DataFrame:
    """(img_id, yc, xc, n): the centre of most votes; of equal ones the first by rows."""
    first = Window.partitionBy("img_id").orderBy(F.desc("n"), "yc", "xc")
    return votes.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")


def radius_histogram(points: DataFrame, centres: DataFrame, least: int, most: int, aligned: float) -> DataFrame:
    """(img_id, r, n): edge points by rounded distance to the centre, if their gradient points along the radius."""
    p = points.join(centres.select("img_id", "yc", "xc"), "img_id").withColumns({"ry": F.col("y") - F.col("yc"), "rx": F.col("x") - F.col("xc")})
    p = p.withColumn("r2", F.col("ry") * F.col("ry") + F.col("rx") * F.col("rx")).filter("r2 > 0")
    dot = (F.col("rx") * F.col("gx") + F.col("ry") * F.col("gy")).cast("double")
    cos2 = dot * dot / (F.col("r2").cast("double") * (F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    p = p.withColumn("r", F.floor(F.sqrt(F.col("r2").cast("double")) + 0.5).cast("int")).filter((cos2 > aligned * aligned) & (F.col("r") >= least) & (F.col("r") < most))
    return p.groupBy("img_id", "r").agg(F.count(F.lit(1)).alias("n"))


def projections(points: DataFrame, yc: int, xc: int) -> DataFrame:
    """(img_id, side, r, n): aligned edge points left and right of a centre by distance, rounded down."""
    p = points.withColumns({"ry": F.col("y") - yc, "rx": F.col("x") - xc}).withColumn("r2", F.expr("ry * ry + rx * rx")).filter("r2 > 0")
    p = p.withColumn("dot", F.expr("cast(rx * gx + ry * gy as bigint)")).filter(F.expr("4 * dot * dot > 3 * cast(r2 as bigint) * (gx * gx + gy * gy)"))
    return p.groupBy("img_id", F.when(F.col("rx") < 0, "left").otherwise("right").alias("side"), F.floor(F.sqrt(F.col("r2").cast("double"))).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("n"))


# Side projections: gradient, its least horizontal part and square, and the least squared cosine to the radius as a fraction.
SIDES = {"plain": ("sobel", 6, 128, (1, 2)), "fine": ("sobel", 4, 72, (1, 2)), "smooth": ("central", 2, 144, (3, 4))}
# Half width of the sums over radii, and the share of a circle, in 10000/157, that has to be seen.
SIDE_BLUR, SIDE_SEEN = 4, 20


def side_projections(df: DataFrame, yc: int, xc: int, first: int, last: int, kind: str = "plain") -> DataFrame:
    """(img_id, side, r, n): pixels left and right of a centre whose gradient points outwards along the radius, in 1024ths of all pixels there, by distance rounded down.

    Pixels lie in the quarter of their side, at `first` from the centre or beyond, up to `last`; radii below `first` take the value there. Values are summed over
    2 SIDE_BLUR + 1 radii, and radii of which little is seen are 0. A column m, if df has one, leaves out pixels where it isn't 0.
    """
    source, least_x, least, (over, under) = SIDES[kind]
    masked = "m" in df.columns
    if source == "sobel":
        g = stencil(stencil(df, SOBEL_X, "gx"), SOBEL_Y, "gy")
    else:
        s = smoothed(df.select("img_id", "y", "x", "v"), 2.0)
        g = s.withColumns({"gx": at("v", 1, along()) - at("v", -1, along()), "gy": at("v", 1, down()) - at("v", -1, down())}).withColumn("gx", F.expr("cast(6 * gx div 5 as int)"))
        g = g.join(df.select("img_id", "y", "x", "m"), ["img_id", "y", "x"]) if masked else g
    g = g.withColumn("in", inner(1, 1)).filter("in").withColumns({"i": F.col("y") - yc, "j": F.col("x") - xc})
    root = lambda c: F.floor(F.sqrt(c.cast("double")))
    i, j = F.col("i"), F.col("j")
    near = F.when(F.abs(i) < first, F.greatest(F.abs(i), root(first * first - i * i))).otherwise(F.abs(i))
    ring = g.filter((F.abs(i) <= last) & (F.abs(j) >= near) & (F.abs(j) <= root(last * last - i * i)))
    if masked:
        ring = ring.filter("m = 0")
    # The centre's own pixel, if it is in the ring, is of both sides.
    ring = ring.withColumn("side", F.explode(F.array_compact(F.array(F.when(j <= 0, F.lit("left")), F.when(j >= 0, F.lit("right"))))))
    dot, square, far = (F.col("gx") * j + F.col("gy") * i).cast("long"), (F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("long"), (i * i + j * j).cast("long")
    outward = F.when(F.col("side") == "left", F.col("gx") < -least_x).otherwise(F.col("gx") > least_x)
    hit = outward & (square > least) & (dot > 0) & (dot * under * dot > far * square * over)
    counts = ring.groupBy("img_id", "side", root(far).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("all"), F.sum(hit.cast("int")).alias("hits"))
    radii = df.select("img_id").distinct().withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(last))))
    own = radii.join(counts, ["img_id", "side", "r"], "left").fillna(0, ["all", "hits"])
    line = Window.partitionBy("img_id", "side")
    start = lambda c: F.when(F.col("r") < first, F.max(F.when(F.col("r") == first, F.col(c))).over(line)).otherwise(F.col(c))
    own = own.withColumns({"all": start("all"), "hits": start("hits")}).withColumn("n", F.expr("case when all > 0 then 1024 * hits div all else 0 end"))
    by_r = line.orderBy("r")

    def summed(c: str) -> Column:
        ends = F.max(F.when(F.col("r") == 0, F.col(c))).over(line), F.max(F.when(F.col("r") == last, F.col(c))).over(line)
        return F.sum(c).over(by_r.rowsBetween(-SIDE_BLUR, SIDE_BLUR)) + F.greatest(F.lit(0), SIDE_BLUR - F.col("r")) * ends[0] + F.greatest(F.lit(0), F.col("r") + SIDE_BLUR - last) * ends[1]

    sums = own.withColumns({"seen": summed("all"), "s": summed("n")})
    shown = sums.withColumn("s", F.when((F.col("r") > 0) & (F.expr(f"10000 * seen div ({157 * (2 * SIDE_BLUR + 1)} * greatest(1, r))") < SIDE_SEEN), 0).otherwise(F.col("s")))
    return shown.select("img_id", "side", "r", F.when(F.col("r") == 0, F.lead("s").over(by_r)).otherwise(F.col("s")).cast("long").alias("n"))
