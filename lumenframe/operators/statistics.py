"""Error curves, fits, covariances, classifiers and scoring against markup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import held


def error_curve(scores: DataFrame) -> DataFrame:
    """(k, threshold, frr, far): corners of the error trade-off, larger scores being likelier the same, impostors first among equals.

    Running counts over one global order without one task for it: counts by score first, then ranges of scores, whose sums (a row a range) give each range its
    start; within a range the scores are counted on apart.
    """
    by_score = scores.groupBy("score").agg(F.count_if(F.col("is_same") == 0).alias("aliens"), F.count_if(F.col("is_same") != 0).alias("sames"))
    parts = held(by_score.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "det-ranges")
    kind = F.when(F.col("sames") > 0, 1).otherwise(0)
    ends = parts.groupBy("part").agg(F.max("score").alias("top"), F.sum("aliens").alias("a"), F.sum("sames").alias("s"), F.min(F.struct("score", kind.alias("kind"))).alias("low"))
    ranges = Window.orderBy(F.desc("top"))
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"at": F.sum("a").over(Window.partitionBy()), "st": F.sum("s").over(Window.partitionBy()), "pa": F.coalesce(F.sum("a").over(earlier), F.lit(0)), "ps": F.coalesce(F.sum("s").over(earlier), F.lit(0)), "above": F.lag("low").over(ranges)})
    # A row a range, so as many as there are partitions.
    c = parts.join(F.broadcast(ends.select("part", "at", "st", "pa", "ps", "above")), "part")
    order = Window.partitionBy("part").orderBy(F.desc("score"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumns({"a0": F.coalesce(F.sum("aliens").over(before), F.lit(0)) + F.col("pa"), "s0": F.coalesce(F.sum("sames").over(before), F.lit(0)) + F.col("ps")})
    # A corner stands between two items of different kind. Items of one score run aliens first; a corner before an item has the counts up to it.
    c = c.withColumns({"pk": F.coalesce(F.lag(kind).over(order), F.col("above.kind")), "pscore": F.coalesce(F.lag("score").over(order), F.col("above.score")), "fk": F.when(F.col("aliens") > 0, 0).otherwise(1)})
    outer = c.filter("pk is not null and pk <> fk").select("s0", "a0", "st", "at", F.col("pscore").alias("threshold"))
    inside = c.filter("aliens > 0 and sames > 0").select("s0", (F.col("a0") + F.col("aliens")).alias("a0"), "st", "at", F.col("score").alias("threshold"))
    corners = outer.unionByName(inside).filter("st > 0 and at > 0")
    return corners.select((F.col("s0") + F.col("a0")).cast("long").alias("k"), "threshold", F.round((F.col("st") - F.col("s0")) / F.col("st"), 9).alias("frr"), F.round(F.col("a0") / F.col("at"), 9).alias("far"))


def detection_errors(markup: DataFrame) -> DataFrame:
    """(rec_id, ctr, pup, iri, total): errors of detected circles as shares of the expert's outer radius.

    ctr adds the centre distances of both circles; pup and iri are radius differences. That sums of distances are taken is this engine's
    definition; total = ctr + pup + iri.
    """
    r = F.col("ir").cast("double")
    away = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    out = markup.select("rec_id", (2 * away / r).alias("ctr"), (F.abs("drp") / r).alias("pup"), (F.abs("dri") / r).alias("iri"))
    return out.withColumn("total", F.col("ctr") + F.col("pup") + F.col("iri"))


def error_histograms(errors: DataFrame, bins: int = 100) -> DataFrame:
    """(kind, bin, n): records whose error falls below (bin + 1) percent, cumulative; larger errors are in no bin."""
    kinds = ["ctr", "iri", "pup", "total"]
    long = errors.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.floor(F.round(F.col(k) * 100, 9)).cast("int").alias("bin")) for k in kinds))).alias("e")).select("e.*").filter(F.col("bin") < bins)
    counts = long.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = errors.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"))
    up_to = Window.partitionBy("kind").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(counts, ["kind", "bin"], "left").select("kind", "bin", F.sum(F.coalesce("n", F.lit(0))).over(up_to).alias("n"))


def circle_fit(points: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, xc, yc, r, off): least-squares circle from moments about the mean, and the mean distance of points from it."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    means = points.groupBy(key).agg(F.avg(x).alias("ax"), F.avg(y).alias("ay"))
    u, v = F.col("u"), F.col("w")
    centred = points.join(means, key).withColumns({"u": x - F.col("ax"), "w": y - F.col("ay")})
    s = centred.groupBy(key, "ax", "ay").agg(F.count(F.lit(1)).alias("n"), F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u * u * u + u * v * v).alias("p"), F.sum(v * v * v + v * u * u).alias("q"))
    s = s.withColumn("det", F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")).filter(F.abs("det") >= 1e-5)
    s = s.withColumns({"a": (F.col("p") * F.col("vv") - F.col("q") * F.col("uv")) / (2 * F.col("det")), "b": (F.col("q") * F.col("uu") - F.col("p") * F.col("uv")) / (2 * F.col("det"))})
    s = s.select(key, (F.col("ax") + F.col("a")).alias("xc"), (F.col("ay") + F.col("b")).alias("yc"), F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + (F.col("uu") + F.col("vv")) / F.col("n")).alias("r"))
    away = F.sqrt((x - F.col("xc")) * (x - F.col("xc")) + (y - F.col("yc")) * (y - F.col("yc")))
    out = points.join(s, key).groupBy(key, "xc", "yc", "r").agg(F.avg(F.abs(away - F.col("r"))).alias("off"))
    return out.select(key, *(F.round(c, 6).alias(c) for c in ("xc", "yc", "r", "off")))


def line_fit(points: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, n, slope, base, r2): straight line of y over x by least squares."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("base"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def point_moments(points: DataFrame, key: str = "set_id") -> DataFrame:
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.sum(x).alias("mx"), F.sum(y).alias("my"), F.sum(x * x).alias("mxx"), F.sum(x * y).alias("mxy"), F.sum(y * y).alias("myy"))


def class_means(vec: DataFrame) -> DataFrame:
    return vec.groupBy("label", "i").agg(F.round(F.avg("e"), 9).alias("mean"))


def products(vec: DataFrame, dims: int, by_class: bool) -> DataFrame:
    """(i, j, c): n sum(x_i x_j) - sum(x_i) sum(x_j), over all samples or added up over classes, for the first `dims` dimensions.

    Each vector is one row while its products are made, so the shuffle carries sums by (i, j), not pairs of samples.
    """
    keys = ["label"] if by_class else []
    rows = vec.filter(F.col("i") < dims).groupBy("vec_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "e"))), lambda p: p["e"]).alias("v"))
    pair = rows.select(*keys, F.posexplode("v").alias("i", "a"), "v").select(*keys, "i", "a", F.posexplode("v").alias("j", "b"))
    s = pair.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    s = s.withColumn("c", F.col("n") * F.col("ab") - F.col("a") * F.col("b"))
    if by_class:
        s = s.groupBy("i", "j").agg(F.sum("c").alias("c"))
    return s.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("c", 6).alias("c"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, a) x (i, j, a) -> a times b's transpose."""
    left, right = a.select(F.col("i"), F.col("j").alias("k"), F.col("a").alias("p")), b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("q"))
    return left.join(right, "k").groupBy("i", "j").agg(F.round(F.sum(F.col("p") * F.col("q")), 6).alias("a"))


def gram(vec: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, population covariance, samples) on the driver: dims + dims^2 numbers, whatever the samples."""
    c = {(r["i"], r["j"]): r["c"] for r in products(vec, dims, False).collect()}
    means = {r["i"]: (r["m"], r["n"]) for r in vec.filter(F.col("i") < dims).groupBy("i").agg(F.avg("e").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    n = means[0][1] if means else 0
    return np.array([means[i][0] for i in range(dims)]), np.array([[c[i, j] for j in range(dims)] for i in range(dims)]) / n**2, n


def principal(vec: DataFrame, dims: int, parts: int) -> DataFrame:
    """(vec_id, part, coef): each vector's coefficients on the `parts` largest principal axes; an axis points so that its largest entry is positive."""
    means, cov, _ = gram(vec, dims)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :parts]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(parts)])
    model = vec.sparkSession.createDataFrame([(i, p, float(axes[i, p]), float(means[i])) for i in range(dims) for p in range(parts)], "i int, part int, w double, m double")
    return vec.filter(F.col("i") < dims).join(F.broadcast(model), "i").groupBy("vec_id", "part").agg(F.round(F.sum((F.col("e") - F.col("m")) * F.col("w")), 6).alias("coef"))


def gaussian_classes(vec: DataFrame, dims: int) -> DataFrame:
    """(vec_id, label, best, dist): the class of least Mahalanobis distance, each class with its own mean and covariance over `dims` dimensions.

    A class of too few samples to span all dimensions has a singular covariance; its inverse is the pseudo-inverse, blind to the directions
    in which the class doesn't vary. Means and dims^2 products a class reach the driver, whatever the samples.
    """
    few = vec.filter(F.col("i") < dims)
    rows = few.groupBy("vec_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "e"))), lambda p: p["e"]).alias("v"))
    pair = rows.select("label", F.posexplode("v").alias("i", "a"), "v").select("label", "i", "a", F.posexplode("v").alias("j", "b")).filter("i <= j")
    stats = pair.groupBy("label", "i", "j").agg(F.avg("a").alias("m"), F.covar_pop("a", "b").alias("c")).toPandas()
    labels = np.unique(stats["label"].to_numpy())
    at, i, j = np.searchsorted(labels, stats["label"].to_numpy()), stats["i"].to_numpy(), stats["j"].to_numpy()
    cov, means = np.zeros((len(labels), dims, dims)), np.zeros((len(labels), dims))
    cov[at, i, j] = cov[at, j, i] = stats["c"].to_numpy()
    means[at[i == j], i[i == j]] = stats["m"].to_numpy()[i == j]
    sent = vec.sparkSession.sparkContext.broadcast((labels, means, np.linalg.pinv(cov, rcond=1e-10, hermitian=True) if len(labels) else cov))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, mean, inverse = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column(2).to_pylist(), np.float64)
            dist = np.round(np.stack([np.einsum("ni,ij,nj->n", v - m, x, v - m, optimize=True) for m, x in zip(mean, inverse, strict=True)], 1), 9)
            best = dist.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best].astype(np.int32)), pa.array(np.round(dist[np.arange(len(v)), best], 6))], names=["vec_id", "label", "best", "dist"])

    kind = {f.name: f.dataType.simpleString() for f in vec.schema.fields}
    return rows.mapInArrow(nearest, f"vec_id {kind['vec_id']}, label {kind['label']}, best int, dist double")
