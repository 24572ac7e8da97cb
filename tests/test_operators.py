"""Operators against numpy or the definition, on small inputs."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import cluster, components, filters, fits, glints, histograms, linear, morphology, quality, regions, segmentation, sequences, spectral, statistics, transport


def image(spark, a, img_id=1):
    return spark.createDataFrame([(img_id, y, x, int(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "img_id int, y int, x int, v int")


def array(df, shape):
    out = np.full(shape, -1.0)
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def picture():
    return np.random.default_rng(1).integers(0, 256, (9, 11))


def test_constant_stays_constant(spark):
    flat = np.full((8, 8), 77)
    for op in (filters.blur3x3, filters.blur5x5, filters.uniform3x3, filters.blur_along5, morphology.median3x3, morphology.opening):
        assert (array(op(image(spark, flat)), flat.shape) == 77).all()


def test_erosion_and_dilation_bound(spark, picture):
    low, high = array(morphology.erode_cross(image(spark, picture)), picture.shape), array(morphology.dilate_cross(image(spark, picture)), picture.shape)
    assert (low[1:-1, 1:-1] <= picture[1:-1, 1:-1]).all() and (high[1:-1, 1:-1] >= picture[1:-1, 1:-1]).all()


def test_median_is_numpys(spark, picture):
    got = array(morphology.median3x3(image(spark, picture)), picture.shape)
    want = np.array([[np.median(picture[y - 1 : y + 2, x - 1 : x + 2]) for x in range(1, 10)] for y in range(1, 8)])
    assert (got[1:-1, 1:-1] == want).all()


def test_mirrors_and_half_frames_undo_themselves(spark, picture):
    for op in (transport.mirror_x, transport.mirror_y, transport.transpose):
        assert (array(op(op(image(spark, picture))), picture.shape) == picture).all()
    assert (array(transport.combine_half_frames(transport.split_half_frames(image(spark, picture))), picture.shape) == picture).all()


def test_integral_is_cumulative(spark, picture):
    assert (array(transport.integral(image(spark, picture)), picture.shape) == picture.cumsum(0).cumsum(1)).all()


def test_histogram_keeps_mass(spark, picture):
    hist = histograms.histogram(image(spark, picture))
    assert hist.count() == 256 and hist.agg(F.sum("n")).first()[0] == picture.size


def test_components(spark):
    a = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 0], [1, 1, 1, 1]])
    on = image(spark, a).filter("v = 1").select("img_id", "y", "x")
    assert components.labelled(on).select("comp").distinct().count() == 3
    assert components.labelled(on, diagonal=True).select("comp").distinct().count() == 2
    assert sorted(r["m"] for r in components.moments(components.labelled(on)).collect()) == [2, 3, 5]


def test_glints_follow_the_sweeps(spark, picture):
    def sweep(line):
        out, v = [], 255
        for p in line:
            v = p if v > p else v + 1 if v < p else v
            out.append(v)
        return np.array(out)

    both = lambda line: np.maximum(sweep(line), sweep(line[::-1])[::-1])
    want = np.maximum(np.array([both(r) for r in picture]), np.array([both(c) for c in picture.T]).T)
    assert (array(components.glints_removed(image(spark, picture)), picture.shape) == want).all()


def test_transforms(spark):
    e = np.random.default_rng(2).normal(size=8)
    vec = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(e)], "vec_id long, i int, e double")
    f = np.fft.fft(e)
    for r in spectral.fourier(vec, ["i"]).withColumnRenamed("i", "k").collect():
        assert abs(r["re"] - f[r["k"]].real) < 1e-5 and abs(r["im"] - f[r["k"]].imag) < 1e-5
    w = np.array([r["e"] for r in spectral.walsh(vec, ["i"]).orderBy("i").collect()])
    assert abs((w**2).sum() - 8 * (e**2).sum()) < 1e-4
    assert abs(spectral.haar(vec, ["i"]).filter("i = 0").first()["e"] - e.sum()) < 1e-5


def test_checksums(spark):
    texts = ["", "a", "Grüße", None, "x" * 100_000]
    got = {r["doc_id"]: r for r in spectral.checksums(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert got[i]["crc32"] == zlib.crc32(data) and got[i]["adler32"] == zlib.adler32(data)


def test_circle_fit_finds_a_circle(spark):
    pts = [(1, round(50 + 30 * math.cos(t)), round(40 + 30 * math.sin(t))) for t in np.linspace(0, 6.28, 60)]
    r = statistics.circle_fit(spark.createDataFrame(pts, "set_id int, x int, y int")).first()
    assert abs(r["xc"] - 50) < 0.3 and abs(r["yc"] - 40) < 0.3 and abs(r["r"] - 30) < 0.3 and r["off"] < 0.5


def test_principal_axes_and_classes(spark):
    random = np.random.default_rng(3)
    data = np.vstack([random.normal(0, 1, (60, 4)) * [3, 1, 0.5, 0.2], random.normal(0, 1, (60, 4)) * [0.5, 2, 1, 1] + 6])
    vec = spark.createDataFrame([(n, int(n >= 60), i, float(data[n, i])) for n in range(120) for i in range(4)], "vec_id long, label int, i int, e double")
    coef = statistics.principal(vec, 4, 2).groupBy("part").agg(F.var_pop("coef").alias("v")).orderBy("part").collect()
    want = np.sort(np.linalg.eigvalsh(np.cov(data.T, bias=True)))[::-1]
    assert [round(r["v"], 3) for r in coef] == [round(x, 3) for x in want[:2]]
    got = statistics.gaussian_classes(vec, 4)
    assert got.filter("label = best").count() >= 118


def test_single_linkage_links_places_not_points(spark, monkeypatch):
    """Copies of a place make no pairs; repeated ids join their places; points without a set, id or finite place stay alone."""
    pts = [(s, 10 * n + s, float(x), 0.0) for s in (1, 2) for n, x in enumerate([0, 2, 9, 11, 40] * 100)]
    pts += [(1, 7, 80.0, 0.0), (1, 7, 90.0, 0.0), (1, 8, 90.0, 1.0), (1, 9001, None, 0.0), (1, 9002, None, 0.0), (1, 9003, math.nan, 0.0), (1, 9004, math.nan, 0.0), (None, 1, 0.0, 0.0), (None, 2, 0.0, 0.0), (1, None, 0.0, 0.0), (1, None, 9.0, 0.0)]
    made, pairs = [], cluster.near_pairs
    monkeypatch.setattr(cluster, "near_pairs", lambda *a: made.append(pairs(*a)) or made[-1])
    got = {(r["set_id"], r["id"]): r["cluster"] for r in cluster.single_linkage(spark.createDataFrame(pts, "set_id int, n long, x double, y double"), 3).collect()}
    assert made[0].count() == 5
    at = {}
    for s, n, x, y in pts:
        at.setdefault((s, n), set()).add((x, y))
    want = {k: k[1] for k in at}
    near = lambda p, q: any(None not in (*a, *b) and (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 9 for a in at[p] for b in at[q])
    for p in sorted((k for k in at if None not in k), key=lambda k: k[1]):
        todo = [p] if want[p] == p[1] else []
        for q in todo:
            for r in at:
                if None not in r and r[0] == q[0] and want[r] > p[1] and near(q, r):
                    want[r] = p[1]
                    todo.append(r)
    assert got == want


def test_single_linkage_and_resampling(spark):
    pts = spark.createDataFrame([(1, n, x, 0) for n, x in enumerate([0, 2, 4, 20, 21, 50])], "set_id int, n long, x int, y int")
    assert sorted(r["n"] for r in cluster.cluster_sizes(cluster.single_linkage(pts, 2)).collect()) == [1, 2, 3]
    seq = spark.createDataFrame([(1, i, float(i * i)) for i in range(5)], "user_id int, i int, value double")
    got = [r["value"] for r in sequences.resampled(seq, 9, "user_id").orderBy("k").collect()]
    assert got == [0, 0.5, 1, 2.5, 4, 6.5, 9, 12.5, 16]


def test_vector_queries_use_all_components(spark):
    from lumenframe.plans import registry

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").orderBy("vec_id").toPandas()
    x, label = np.array(table["embedding"].tolist(), np.float64), table["label"].to_numpy()
    dims = x.shape[1]
    total = len(x) * x.T @ x - np.outer(x.sum(0), x.sum(0))
    classes = {k: x[label == k] for k in np.unique(label)}
    within = sum(len(c) * c.T @ c - np.outer(c.sum(0), c.sum(0)) for c in classes.values())
    for name, want in (("cov_total_all", total), ("cov_within_all", within)):
        got = registry.QUERIES[name](spark, sf).toPandas()
        assert len(got) == dims * dims and np.allclose(got["c"], want[got["i"], got["j"]], rtol=1e-9, atol=1e-5)
    axes = np.linalg.eigh(total)[1][:, ::-1][:, :4]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(4)])
    got = registry.QUERIES["pca_expand"](spark, sf).toPandas().sort_values(["vec_id", "part"])["coef"].to_numpy().reshape(-1, 4)
    assert np.allclose(got, (x - x.mean(0)) @ axes, atol=1e-5)
    away = np.stack([np.sum(((x - c.mean(0)) @ np.linalg.pinv(np.cov(c.T, bias=True), rcond=1e-10, hermitian=True)) * (x - c.mean(0)), axis=1) for c in classes.values()], 1)
    got = registry.QUERIES["ndc_classify"](spark, sf).toPandas().sort_values("vec_id")
    assert len(got) == len(x) and np.allclose(got["dist"], away.min(1), rtol=1e-5) and (got["best"].to_numpy() == np.array(list(classes))[away.argmin(1)]).all()


def test_several_axes(spark):
    a = np.random.default_rng(5).normal(size=(4, 8))
    df = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(4) for x in range(8)], "vec_id long, y int, x int, e double")
    f = np.fft.fft2(a)
    got = {(r["y"], r["x"]): r for r in spectral.fourier(df, ["y", "x"]).collect()}
    assert all(abs(got[y, x]["re"] - f[y, x].real) < 1e-5 and abs(got[y, x]["im"] - f[y, x].imag) < 1e-5 for y in range(4) for x in range(8))
    back = {(r["y"], r["x"]): r["re"] for r in spectral.fourier(spectral.fourier(df, ["y", "x"]), ["y", "x"], "re", "vec_id", "im", True).collect()}
    assert all(abs(back[y, x] - a[y, x]) < 1e-4 for y in range(4) for x in range(8))
    w = {(r["y"], r["x"]): r["e"] for r in spectral.walsh(df, ["y", "x"]).collect()}
    assert abs(w[0, 0] - a.sum()) < 1e-5 and abs(sum(v * v for v in w.values()) - 32 * (a**2).sum()) < 1e-3


def test_noise_is_the_best_decay(spark):
    random = np.random.default_rng(6)
    calm, loud = np.full((32, 32), 100), np.clip(100 + random.normal(0, 12, (32, 32)), 0, 255).astype(int)
    df = image(spark, calm, 1).unionByName(image(spark, loud, 2))
    got = {r["img_id"]: r["noise"] for r in quality.noise(df).collect()}
    hist = np.bincount(random.geometric(0.3, 5000) - 1, minlength=256)[:256]
    place, value = quality.minimum(quality.decay_error(hist), 0.0, 1.0, 10.0, 1e-6)
    grid = np.linspace(0.01, 3, 3000)
    assert abs(place - grid[np.argmin([quality.decay_error(hist)(x) for x in grid])]) < 2e-3 and value <= min(quality.decay_error(hist)(x) for x in grid) + 1e-6
    assert got[1] > got[2]


def test_masked_sharpness(spark):
    random = np.random.default_rng(9)
    a = random.integers(0, 256, (128, 128))
    flat = np.full((128, 128), 90)
    mask = lambda df: df.withColumn("m", F.when(F.col("x") < 96, 255).otherwise(0))
    got = {r["img_id"]: r["sharpness"] for r in quality.masked_sharpness(mask(image(spark, a, 1).unionByName(image(spark, flat, 2)))).collect()}
    small, e = a, []
    for k in range(3):
        half = (small[0::2, 0::2] + small[0::2, 1::2] + small[1::2, 0::2] + small[1::2, 1::2] + 2) // 4
        p = np.pad(half, 1, mode="edge")
        n, d = half.shape[0], np.zeros(small.shape, int)
        for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)):
            sy, sx = 2 * dy - 1, 2 * dx - 1
            up = (5 * half + p[1 : n + 1, 1 + sx : n + 1 + sx] + p[1 + sy : n + 1 + sy, 1 : n + 1] + p[1 + sy : n + 1 + sy, 1 + sx : n + 1 + sx] + 4) // 8
            d[dy::2, dx::2] = up - small[dy::2, dx::2]
        inside = d[:, : 96 >> k]
        e.append(int(int(math.sqrt((inside**2).sum() / inside.size) * 256) / 2 ** (k / 2)))
        small = half
    assert got[2] is None and got[1] == e[1] + e[2] - (e[1] + e[2])


def test_linear_algebra(spark):
    random = np.random.default_rng(4)
    a, b, x = random.normal(size=(5, 5)), random.normal(size=(5, 5)), random.normal(size=(5, 2))
    sym, pos = a + a.T, b @ b.T + np.eye(5)
    frame = lambda m: spark.createDataFrame([(7, i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "mat_id long, i int, j int, a double")
    got = np.zeros((5, 2))
    for r in linear.solved(frame(a), frame(a @ x)).collect():
        got[r["i"], r["j"]] = r["a"]
    assert np.allclose(got, x)
    assert linear.solved(frame(np.ones((3, 3))), frame(np.ones((3, 1)))).count() == 0
    pairs = linear.eigen_symmetric(frame(sym), frame(pos)).collect()
    values = [next(r["value"] for r in pairs if r["part"] == p) for p in range(5)]
    v = np.array([[next(r["x"] for r in pairs if r["part"] == p and r["i"] == i) for p in range(5)] for i in range(5)])
    assert values == sorted(values) and np.allclose(sym @ v, pos @ v * values) and np.allclose(v.T @ pos @ v, np.eye(5))
    want = np.linalg.eigvals(np.linalg.solve(b, a))
    found = [complex(r["re"], r["im"]) for r in linear.eigen_general(frame(a), frame(b)).collect()]
    assert len(found) == 5 and all(min(abs(w - f) for f in found) < 1e-4 for w in want)
    square = linear.eigen_errors(frame(sym @ sym.T), linear.eigen_symmetric(frame(sym @ sym.T), frame(np.eye(5)))).first()["error"]
    assert square < 1e-4


def test_discriminants_part_the_classes(spark):
    random = np.random.default_rng(8)
    centres = random.normal(size=(3, 4)) * 5
    x = np.concatenate([c + random.normal(size=(30, 4)) @ np.diag([1, 4, 0.5, 1]) for c in centres])
    label = np.repeat(range(3), 30)
    vec = spark.createDataFrame([(k, int(label[k]), i, float(x[k, i])) for k in range(90) for i in range(4)], "vec_id long, label int, i int, e double")
    got = linear.discriminants(vec, 4, 2).collect()
    cov = lambda y: len(y) * y.T @ y - np.outer(y.sum(0), y.sum(0))
    inner = sum(cov(x[label == k]) for k in range(3))
    values = np.sort(np.linalg.eigvals(np.linalg.solve(inner, cov(x) - inner)).real)[::-1]
    assert np.allclose([next(r["value"] for r in got if r["part"] == p) for p in range(2)], values[:2], rtol=1e-4)
    with pytest.raises(ValueError):
        linear.discriminants(vec.filter("label = 0"), 4, 2)


def test_glints_are_filled(spark):
    random = np.random.default_rng(11)
    plain = (60 + 20 * np.sin(np.arange(96)[:, None] / 15) + 10 * np.cos(np.arange(128) / 20) + random.integers(0, 3, (96, 128))).astype(int)
    spot = plain.copy()
    spot[40:46, 60:67] = 250
    mask, clean = glints.mask_of(spot), glints.removed(spot)
    assert mask[41:45, 62:66].all() and mask.sum() / 255 < 600
    assert np.abs(clean - plain)[40:46, 60:67].max() < 25 and (clean == spot)[:30].all()
    got = array(glints.without_glints(image(spark, spot)), spot.shape)
    assert (got == clean).all()
    given = image(spark, spot).withColumn("m", F.when((F.col("y").between(40, 45)) & (F.col("x").between(60, 67)), 255).otherwise(0))
    assert array(glints.filled(given), spot.shape)[42, 63] < 120


def test_circles_of_a_drawn_eye(spark):
    y, x = np.mgrid[0:150, 0:180]
    eye = np.full((150, 180), 190.0)
    eye[(x - 90) ** 2 + (y - 75) ** 2 <= 60**2] = 110
    eye[(x - 92) ** 2 + (y - 76) ** 2 <= 32**2] = 30
    eye = (eye + np.random.default_rng(2).integers(0, 4, eye.shape)).astype(int)
    found = segmentation.segmented(image(spark, eye))
    r = found.first()
    assert abs(r["pr"] - 32) <= 4 and abs(r["ir"] - 60) <= 5 and abs(r["ix"] - 90) <= 4 and abs(r["iy"] - 75) <= 4, r
    marked = spark.createDataFrame([(1, 92, 76, 32, 90, 75, 60)], "img_id int, px int, py int, pr int, ix int, iy int, ir int")
    assert segmentation.scored(found, marked).first()["total"] < 0.5
    circles = spark.createDataFrame([(1, 90, 75, 32)], "img_id int, ix int, iy int, pr int")
    ring = array(segmentation.iris_gradient(image(spark, 255 - eye), circles), eye.shape)  # gradients that point outwards, from a bright disc
    far = np.sqrt((x - 90.0) ** 2 + (y - 75.0) ** 2)
    assert ring.max() > 0 and (ring[far < 42] == 0).all()


def test_contour_masks(spark):
    radii = spark.createDataFrame([(1, i, 10) for i in range(36)], "set_id int, i int, r int")
    inside = {(r["y"], r["x"]) for r in regions.contour_mask(radii, 20, 22, 40, 45).collect()}
    y, x = np.mgrid[0:40, 0:45]
    far = np.sqrt((x - 22.0) ** 2 + (y - 20.0) ** 2)
    assert all(((j, i) in inside) for j, i in zip(*np.nonzero(far < 8.5), strict=True)) and not any(far[j, i] > 11.5 for j, i in inside)
    hole = spark.createDataFrame([(1, i, 4) for i in range(36)], "set_id int, i int, r int")
    ring = {(r["y"], r["x"]) for r in regions.ring_mask(radii, hole, (20, 22), (20, 22), 40, 45).collect()}
    assert ring < inside and (20, 22) not in ring and (20, 30) in ring


def test_ellipses_through_points(spark):
    random = np.random.default_rng(3)
    rows = []
    for k, (xc, yc, a, b, tilt) in enumerate(((200, 150, 60, 35, 0.4), (320, 90, 25, 70, -0.2), (100, 300, 40, 39, 0.0))):
        t = random.uniform(0, 2 * np.pi, 200)
        rows += [(k, float(xc + a * np.cos(u) * np.cos(tilt) - b * np.sin(u) * np.sin(tilt)), float(yc + a * np.cos(u) * np.sin(tilt) + b * np.sin(u) * np.cos(tilt))) for u in t]
    rows += [(9, float(i), 2.0 * i) for i in range(30)] + [(8, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "set_id int, x double, y double")
    for fit in (fits.algebraic, fits.constrained):
        got = {r["set_id"]: r for r in fits.ellipses(df, fit=fit).collect()}
        assert set(got) == {0, 1, 2}
        for k, (xc, yc, a, b) in enumerate(((200, 150, 60, 35), (320, 90, 25, 70), (100, 300, 40, 39))):
            r = got[k]
            assert abs(r["xc"] - xc) < 0.1 and abs(r["yc"] - yc) < 0.1 and sorted((round(r["a"]), round(r["b"]))) == sorted((a, b)) and r["off"] < 0.01
    circles = {r["set_id"]: r for r in fits.geometric_circle(df.filter("set_id = 2")).collect()}
    assert abs(circles[2]["r"] - 39.5) < 0.3 and circles[2]["settled"]


def test_least_squares_settles():
    x = np.linspace(0, 4, 60)
    y = 3 * np.exp(-1.3 * x) + 0.5
    p, total, settled = fits.least_squares(lambda q: q[0] * np.exp(-q[1] * x) + q[2] - y, np.array([1.0, 0.2, 0.0]))
    assert settled and total < 1e-10 and np.allclose(p, [3, 1.3, 0.5], atol=1e-4)
