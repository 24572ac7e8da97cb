"""Connected components of pixels and what is measured on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import along
from ..functions.tables import held, let_go


def runs(df: DataFrame) -> DataFrame:
    """(img_id, y, x, x0): pixels with the first column of their unbroken run in the row."""
    return df.withColumn("__g", F.col("x") - F.row_number().over(along())).withColumn("x0", F.min("x").over(Window.partitionBy("img_id", "y", "__g"))).drop("__g")


def run_name() -> Column:
    """y * 2^31 + x0: coordinates are 32-bit whole numbers and not negative, so names don't collide."""
    return (F.col("y").cast("long") * (1 << 31) + F.col("x0")).alias("run")


def links(pixels: DataFrame, diagonal: bool) -> DataFrame:
    """(img_id, a, b): runs of neighbouring rows that touch, by run_name()."""
    r = runs(pixels).select("img_id", "y", "x", run_name())
    below = r.select("img_id", (F.col("y") - 1).alias("y"), F.col("x").alias("x"), F.col("run").alias("b"))
    if diagonal:
        below = below.withColumn("x", F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1)))
    return r.withColumnRenamed("run", "a").join(below, ["img_id", "y", "x"]).select("img_id", "a", "b").distinct()


def labelled(pixels: DataFrame, diagonal: bool = False) -> DataFrame:
    """pixels with comp, the least run of their component.

    Vertices are runs of pixels, some times fewer than pixels. Each round a run and the run that it was named after take the least label around the
    first, then that label's label; as whole regions move with the run they are named after, rounds stay few. Each round is a written table, so a lost
    executor costs one round; ends when nothing moves.
    """
    own = held(runs(pixels).withColumn("run", run_name()), "cc-runs")
    edge = links(pixels, diagonal)
    both = held(edge.unionByName(edge.select("img_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    state = held(own.select("img_id", "run").distinct().withColumn("comp", F.col("run")), "cc-labels")
    state = settled(both, state, ["img_id"], "run", "comp", "cc-labels")
    return own.join(state, ["img_id", "run"]).select(*pixels.columns, "comp")


def settled(both: DataFrame, state: DataFrame, keys: list[str], vertex: str, label: str, name: str) -> DataFrame:
    """Labels (keys, vertex, label) spread along links (keys, a, b), both ways, until none changes; the label of a component is its least vertex."""
    moved = True
    while moved:
        near = both.join(state.select(*keys, F.col(vertex).alias("b"), F.col(label).alias("c")), [*keys, "b"]).groupBy(*keys, F.col("a").alias(vertex)).agg(F.min("c").alias("c"))
        step = state.join(near, [*keys, vertex], "left").select(*keys, vertex, F.col(label).alias("old"), F.least(label, F.coalesce("c", label)).alias("mid"))
        named = step.filter("mid < old").groupBy(*keys, F.col("old").alias(vertex)).agg(F.min("mid").alias("hook"))
        hooked = held(step.join(named, [*keys, vertex], "left").select(*keys, vertex, "old", F.least("mid", F.coalesce("hook", "mid")).alias("mid")), name)
        jump = hooked.select(*keys, F.col(vertex).alias("mid"), F.col("mid").alias("far"))
        new = held(hooked.join(jump, [*keys, "mid"], "left").select(*keys, vertex, "old", F.least("mid", F.coalesce("far", "mid")).alias(label)), name)
        moved = new.filter(f"old <> {label}").limit(1).count() > 0
        let_go(state)
        let_go(hooked)
        state = new.select(*keys, vertex, label)
    return state


def moments(labels: DataFrame, least: int = 1) -> DataFrame:
    """(img_id, comp, yb, xb, m, mx, my, mxx, mxy, myy): first pixel by rows, mass and moments of each component of at least `least` pixels."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    sums = labels.groupBy("img_id", "comp").agg(
        F.min(F.struct("y", "x")).alias("b"), F.count(F.lit(1)).alias("m"), F.sum(x).alias("mx"), F.sum(y).alias("my"), F.sum(x * x).alias("mxx"), F.sum(x * y).alias("mxy"), F.sum(y * y).alias("myy")
    )
    return sums.filter(F.col("m") >= least).select("img_id", F.col("b.y").alias("yb"), F.col("b.x").alias("xb"), "m", "mx", "my", "mxx", "mxy", "myy")


def ellipses(found: DataFrame) -> DataFrame:
    """(..., xc, yc, a, b, tilt): the ellipse of equal moments, the longer axis first."""
    m = F.col("m").cast("double")
    out = found.withColumns({"xc": F.col("mx") / m, "yc": F.col("my") / m})
    out = out.withColumns({"cxx": F.col("mxx") / m - F.col("xc") * F.col("xc"), "cxy": F.col("mxy") / m - F.col("xc") * F.col("yc"), "cyy": F.col("myy") / m - F.col("yc") * F.col("yc")})
    root = F.sqrt((F.col("cxx") - F.col("cyy")) * (F.col("cxx") - F.col("cyy")) + 4 * F.col("cxy") * F.col("cxy"))
    half = lambda sign: F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("cxx") + F.col("cyy") + sign * root)))
    tilt = F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy")) / 2
    r = lambda c, name: F.round(c, 6).alias(name)
    keep = [c for c in found.columns if c in ("img_id", "set_id", "yb", "xb", "m")]
    return out.select(*keep, r(F.col("xc"), "xc"), r(F.col("yc"), "yc"), r(half(1), "a"), r(half(-1), "b"), r(tilt, "tilt"))


def reached(marked: DataFrame) -> DataFrame:
    """The pixels of `marked` whose component (8 neighbours) holds one with seed."""
    labels = labelled(marked, diagonal=True)
    good = labels.groupBy("img_id", "comp").agg(F.max("seed").alias("__ok")).filter("__ok")
    return labels.join(good, ["img_id", "comp"], "left_semi").drop("comp")


def flooded(df: DataFrame, y: int, x: int, spread: int) -> DataFrame:
    """(img_id, y, x): pixels joined (4 neighbours) to pixel (y, x) by pixels within `spread` of its value."""
    seed = df.filter((F.col("y") == y) & (F.col("x") == x)).select("img_id", F.col("v").alias("v0"))
    near = df.join(seed, "img_id").filter(F.abs(F.col("v") - F.col("v0")) <= spread).select("img_id", "y", "x")
    labels = labelled(near)
    own = labels.filter((F.col("y") == y) & (F.col("x") == x)).select("img_id", "comp")
    return labels.join(own, ["img_id", "comp"]).select("img_id", "y", "x")


def glints_removed(df: DataFrame) -> DataFrame:
    """Each pixel limited to what its row or its column allows when values rise by one a pixel at most from a side; the largest of the four limits counts.

    A running value that falls to smaller pixels and rises by one otherwise is min over earlier pixels of v + distance, a running minimum.
    """

    def slide(order: str, over, back: bool):
        k = F.col(order)
        w = over.orderBy(F.desc(order) if back else F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
        return (F.min(F.col("v") + k).over(w) - k) if back else (F.min(F.col("v") - k).over(w) + k)

    row, col = Window.partitionBy("img_id", "y"), Window.partitionBy("img_id", "x")
    out = df.withColumn("r", F.greatest(slide("x", row, False), slide("x", row, True))).withColumn("c", F.greatest(slide("y", col, False), slide("y", col, True)))
    return out.select("img_id", "y", "x", F.greatest("r", "c").cast("int").alias("v"))


