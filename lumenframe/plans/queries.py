"""Registered queries on the fixtures, each with an independent DuckDB statement of the same result.

Stencils are stated in SQL as joins of each output pixel with the offsets it reads, borders as clamped coordinates; the engine computes them
with windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import by_image
from ..operators import cluster, components, edges, filters, histograms, morphology, quality, sequences, spectral, statistics, transport
from ..sources.fixtures import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SIZE = "size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM grid)"


def add(name: str, fixture: str, op: Callable[[DataFrame], DataFrame], sql: str | None, image: bool = False) -> None:
    """Registers op on a fixture; {t} in sql stands for the fixture's own SQL."""
    QUERIES[name] = lambda spark, sf_dir: op(by_image(view(spark, sf_dir, fixture)) if image else view(spark, sf_dir, fixture))
    if sql:
        ORACLE_SQL[name] = sql.replace("{t}", duck(fixture))


def near(value: str, offsets: list[tuple[int, ...]], my: int = 0, mx: int = 0, pre: str = "", where: str = "", base: str = "grid", kind: str = "INTEGER") -> str:
    """SQL: value aggregated over n.v (weights k.wt) at the offsets around each pixel, whose coordinates are clamped to a margin."""
    rows = ", ".join(f"({dy}, {dx}, {w[0] if w else 1})" for dy, dx, *w in offsets)
    return f"""WITH grid AS ({{t}}), {SIZE}, k(dy, dx, wt) AS (VALUES {rows}){pre}
SELECT o.img_id, o.y, o.x, CAST({value} AS {kind}) AS v FROM {base} o CROSS JOIN size CROSS JOIN k
JOIN {base} n ON n.img_id = o.img_id AND n.y = least(greatest(o.y, {my}), h - 1 - {my}) + k.dy AND n.x = least(greatest(o.x, {mx}), w - 1 - {mx}) + k.dx
{where} GROUP BY o.img_id, o.y, o.x, o.v"""


def weights(kernel: list[list[int]]) -> list[tuple[int, ...]]:
    hy, hx = len(kernel) // 2, len(kernel[0]) // 2
    return [(i - hy, j - hx, w) for i, r in enumerate(kernel) for j, w in enumerate(r)]


def square(hy: int, hx: int) -> list[tuple[int, ...]]:
    return [(dy, dx) for dy in range(-hy, hy + 1) for dx in range(-hx, hx + 1)]


def image(name: str, op: Callable[[DataFrame], DataFrame], sql: str | None, fixture: str = "grid") -> None:
    add(name, fixture, op, sql, image=True)


# --- smoothing and differences
for _name, _op, _kernel, _value in (
    ("blur3x3", filters.blur3x3, filters.BLUR3, "sum(k.wt * n.v) // 16"), ("blur3x3_sum", filters.blur3x3_sum, filters.BLUR3, "sum(k.wt * n.v)"), ("blur_uniform", filters.uniform3x3, filters.UNIFORM3, "sum(n.v) // 9"),
    ("blur5x5", filters.blur5x5, filters.BLUR5, "sum(k.wt * n.v) // 571"), ("blur_1x5", filters.blur_down5, [[w] for w in filters.LINE5], "(sum(k.wt * n.v) + 125) // 255"), ("blur_5x1", filters.blur_along5, [filters.LINE5], "sum(k.wt * n.v) // 255"),
    ("blur_1x3", filters.blur_down3, [[w] for w in filters.LINE3], "sum(k.wt * n.v) // 231"), ("blur_3x1", filters.blur_along3, [filters.LINE3], "sum(k.wt * n.v) // 231"),
):
    image(_name, _op, near(_value, weights(_kernel), len(_kernel) // 2, len(_kernel[0]) // 2))
image("shifted_diff_y", lambda g: filters.shifted_difference(g, 4, True), near("least(250, greatest(5, 127 + 4 * sum(k.wt * n.v)))", [(-1, 0, 1), (3, 0, -1)], 3, 0))
image("shifted_diff_x", lambda g: filters.shifted_difference(g, 4, False), near("least(250, greatest(5, 127 + 4 * sum(k.wt * n.v)))", [(0, -1, 1), (0, 3, -1)], 0, 3))
image("median3x1", filters.median_along3, near("CASE count(*) WHEN 3 THEN list_sort(list(n.v))[2] ELSE sum(n.v) // 2 END", square(0, 1)))
image("clear_alone", filters.clear_alone, near("CASE WHEN count(*) = 9 AND sum(n.v) = o.v THEN 0 ELSE o.v END", square(1, 1)))
image("local_variation", lambda g: filters.local_variation(g, 2, 3), near("max(n.v) - min(n.v)", square(2, 3)) + " HAVING count(*) = 35")
image("max_drop", lambda g: filters.local_max_drop(g, 2, 2), near("(1 + max(CASE WHEN k.dy = 0 AND k.dx = 0 THEN n.v END) - min(n.v)) & 255", square(2, 2), 2, 2))
_MIRROR = """WITH grid AS ({t}), size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM grid), k AS (SELECT a.dy, b.dx FROM (SELECT unnest(range(-%(hy)d, %(hy)d + 1)) AS dy) a, (SELECT unnest(range(-%(hx)d, %(hx)d + 1)) AS dx) b),
s AS (SELECT o.img_id, o.y, o.x, o.v, sum(n.v) AS s, sum(CAST(n.v AS BIGINT) * n.v) AS q FROM grid o CROSS JOIN size CROSS JOIN k
  JOIN grid n ON n.img_id = o.img_id AND n.y = CASE WHEN o.y + dy < 0 THEN -(o.y + dy) WHEN o.y + dy >= h THEN 2 * h - 2 - (o.y + dy) ELSE o.y + dy END
    AND n.x = CASE WHEN o.x + dx < 0 THEN -(o.x + dx) WHEN o.x + dx >= w THEN 2 * w - 2 - (o.x + dx) ELSE o.x + dx END GROUP BY ALL)
SELECT img_id, y, x, %(out)s FROM s"""
image("box_mean", lambda g: filters.box_mean(g, 2, 3), _MIRROR % {"hy": 2, "hx": 3, "out": "CAST(((s + 7) // 35) & 255 AS INTEGER) AS v"})
image("local_normalize", lambda g: filters.local_normalise(g, 2, 3), _MIRROR % {"hy": 2, "hx": 3, "out": "CAST(((v * 35 * 127) // (s + 7)) & 255 AS INTEGER) AS v"})
image("box_meandisp", lambda g: filters.box_mean_deviation(g, 2, 2, 3), _MIRROR % {"hy": 2, "hx": 2, "out": "CAST(s // 25 AS INTEGER) AS mean, CAST(least(255, floor(3 * sqrt((q - CAST(s AS DOUBLE) * s / 25) / 25) + 0.5)) AS INTEGER) AS disp"})
image("global_normalize", lambda g: filters.global_normalise(g, 100), """WITH grid AS ({t}), s AS (SELECT img_id, count(*) AS n, sum(v) AS t FROM grid GROUP BY 1)
SELECT img_id, y, x, CAST(CASE WHEN t > n * 100 - n // 2 AND t < n * 100 + n // 2 THEN v ELSE least(255, (v * ((n * 25600 + 128) // t)) >> 8) END AS INTEGER) AS v FROM grid JOIN s USING (img_id)""")

# --- morphology
for _name, _op, _agg in (("erode", morphology.erode, "min"), ("dilate", morphology.dilate, "max")):
    for _hy, _hx, _tag in ((1, 1, "3x3"), (0, 2, "5x1"), (2, 0, "1x5"), (2, 3, "box")):
        image(f"{_name}_{_tag}", lambda g, op=_op, a=_hy, b=_hx: op(g, a, b), f"""WITH grid AS ({{t}}), {SIZE}, r AS (SELECT img_id, y, x, {_agg}(v) OVER (PARTITION BY img_id, y ORDER BY x ROWS BETWEEN {_hx} PRECEDING AND {_hx} FOLLOWING) AS v FROM grid),
c AS (SELECT img_id, y, x, {_agg}(v) OVER (PARTITION BY img_id, x ORDER BY y ROWS BETWEEN {_hy} PRECEDING AND {_hy} FOLLOWING) AS v FROM r)
SELECT o.img_id, o.y, o.x, c.v FROM grid o CROSS JOIN size JOIN c ON c.img_id = o.img_id AND c.y = least(greatest(o.y, {_hy}), h - 1 - {_hy}) AND c.x = least(greatest(o.x, {_hx}), w - 1 - {_hx})""")
_CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
image("erode_cross", morphology.erode_cross, near("min(n.v)", _CROSS, 1, 1))
image("dilate_cross", morphology.dilate_cross, near("max(n.v)", _CROSS, 1, 1))
image("opening", morphology.opening, near("max(n.v)", square(1, 1), 1, 1, pre=", e AS (SELECT o.img_id, o.y, o.x, 0 AS v0, min(n.v) AS v FROM grid o CROSS JOIN size CROSS JOIN k JOIN grid n ON n.img_id = o.img_id AND n.y = least(greatest(o.y, 1), h - 2) + k.dy AND n.x = least(greatest(o.x, 1), w - 2) + k.dx GROUP BY 1, 2, 3)", base="e"))
image("open_tophat", morphology.eroded_difference, near("o.v - min(n.v)", square(1, 1), 1, 1))
image("median3x3", morphology.median3x3, near("CASE count(*) WHEN 9 THEN list_sort(list(n.v))[5] ELSE o.v END", square(1, 1)))
image("dilate_binary", lambda g: morphology.binary_dilate(g, 1, 2), near("CASE WHEN max(n.v) > 0 THEN 255 ELSE 0 END", square(1, 2)))
image("bit_pack", morphology.pack_bits, "WITH grid AS ({t}) SELECT img_id, y, CAST(x // 32 AS INTEGER) AS word, CAST(sum(CASE WHEN v <> 0 THEN 1::BIGINT << (x % 32) ELSE 0 END) AS BIGINT) AS bits FROM grid GROUP BY 1, 2, 3")
_DISC_ROWS = {3: "(-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 3), (2, 2), (3, 1)", 4: "(-4, 1), (-3, 3), (-2, 3), (-1, 4), (0, 4), (1, 4), (2, 3), (3, 3), (4, 1)"}
_DISC_SQL = """WITH grid AS ({t}), b AS (SELECT *, CASE WHEN v <> 0 THEN 1 ELSE 0 END AS b FROM grid), k(dy, hw) AS (VALUES %(rows)s),
r AS (SELECT img_id, y, x, [%(agg)s(b) OVER (PARTITION BY img_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), %(agg)s(b) OVER (PARTITION BY img_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
  %(agg)s(b) OVER (PARTITION BY img_id, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), %(agg)s(b) OVER (PARTITION BY img_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)] AS m, least(x, max(x) OVER (PARTITION BY img_id, y) - x) AS edge FROM b)
SELECT o.img_id, o.y, o.x, CAST(%(out)s AS INTEGER) AS v FROM grid o CROSS JOIN k LEFT JOIN r ON r.img_id = o.img_id AND r.x = o.x AND r.y = o.y + dy GROUP BY 1, 2, 3"""
for _r in (3, 4):
    image(f"disc_dilate{_r}", lambda g, r=_r: morphology.disc_morphology(g, r, True), _DISC_SQL % {"rows": _DISC_ROWS[_r], "agg": "max", "out": "max(coalesce(r.m[hw], 0))"})
    image(f"disc_erode{_r}", lambda g, r=_r: morphology.disc_morphology(g, r, False), _DISC_SQL % {"rows": _DISC_ROWS[_r], "agg": "min", "out": "min(CASE WHEN r.edge >= hw THEN r.m[hw] ELSE 0 END)"})

# --- histograms
_H = "WITH grid AS ({t}), h AS (SELECT i.img_id, CAST(b.bin AS INTEGER) AS bin, count(g.v) AS n FROM (SELECT DISTINCT img_id FROM grid) i CROSS JOIN (SELECT unnest(range(256)) AS bin) b LEFT JOIN grid g ON g.img_id = i.img_id AND g.v = b.bin GROUP BY 1, 2)"
_C = _H + ", c AS (SELECT *, sum(n) OVER (PARTITION BY img_id ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY img_id) AS mass FROM h)"
image("hist_gray", histograms.histogram, _H + " SELECT img_id, bin, n FROM h")
add("hist_clamped", "sig", lambda s: histograms.clamped(s, 10, 90), "WITH sig AS ({t}) SELECT CAST(greatest(10, least(90, v)) AS INTEGER) AS bin, count(*) AS n FROM sig GROUP BY 1")
add("hist_flexible", "sig", lambda s: histograms.flexible(s, 16, "user_id"), """WITH sig AS ({t}), m AS (SELECT user_id, max(v) AS top FROM sig GROUP BY 1),
d AS (SELECT user_id, min(p.d) AS divisor FROM m JOIN (SELECT CAST(1 << unnest(range(31)) AS INTEGER) AS d) p ON top // p.d < 16 GROUP BY 1)
SELECT user_id, CAST(divisor AS INTEGER) AS divisor, CAST(v // divisor AS INTEGER) AS bin, count(*) AS n FROM sig JOIN d USING (user_id) WHERE v >= 0 GROUP BY 1, 2, 3""")
image("hist_equalize", histograms.equalised, _C + " SELECT g.img_id, g.y, g.x, CAST(CASE WHEN g.v = 0 THEN 0 ELSE floor(cum * 255.0::DOUBLE / mass + 0.5) END AS INTEGER) AS v FROM grid g JOIN c ON c.img_id = g.img_id AND c.bin = g.v")
image("hist_quantile", lambda g: histograms.quantiles(g, [0, 100, 500, 900, 1000]), _C + """, q AS (SELECT *, (mass * q) // 1000 AS goal FROM c CROSS JOIN (SELECT unnest([0, 100, 500, 900, 1000]) AS q))
SELECT img_id, CAST(q AS INTEGER) AS q, CAST(CASE WHEN count(*) FILTER (cum = goal) > 0 OR goal = 0
  THEN trunc((coalesce(min(bin) FILTER (goal > 0 AND cum >= goal), -1) + coalesce(min(bin) FILTER (cum > goal AND n > 0), 255)) / 2) ELSE min(bin) FILTER (cum >= goal) END AS INTEGER) AS pos FROM q GROUP BY img_id, q, goal""")
_MED = "(SELECT {key}, CAST(min({val}) AS INTEGER) AS median FROM (SELECT {key}, {val}, row_number() OVER (PARTITION BY {key} ORDER BY {val}) AS r, count(*) OVER (PARTITION BY {key}) AS n FROM {src}) WHERE r >= ((n // 2) | 1) GROUP BY 1)"
image("hist_median", histograms.median, "WITH grid AS ({t}) SELECT * FROM " + _MED.format(key="img_id", val="v", src="grid"))
image("hist_mad", histograms.median_deviation, "WITH grid AS ({t}), m AS " + _MED.format(key="img_id", val="v", src="grid") + ", a AS (SELECT img_id, abs(v - median) AS d FROM grid JOIN m USING (img_id)), d AS " + _MED.format(key="img_id", val="d", src="a") + " SELECT img_id, m.median, d.median AS mad FROM m JOIN d USING (img_id)")
image("hist_blur", lambda g: histograms.moving_sum(histograms.histogram(g), 3), _H + " SELECT o.img_id, o.bin, CAST(sum(n.n) AS BIGINT) AS n FROM h o CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) JOIN h n ON n.img_id = o.img_id AND n.bin = least(255, greatest(0, o.bin + d)) GROUP BY 1, 2")
add("hist_fillgaps", "sig", lambda s: histograms.filled(histograms.histogram(s.withColumn("v", F.pmod("v", F.lit(64))), "user_id", "v", 64), 4, "user_id", 64), """WITH sig AS ({t}),
h AS (SELECT i.user_id, CAST(b.bin AS INTEGER) AS bin, count(g.v) AS n FROM (SELECT DISTINCT user_id FROM sig) i CROSS JOIN (SELECT unnest(range(64)) AS bin) b LEFT JOIN sig g ON g.user_id = i.user_id AND ((g.v % 64) + 64) % 64 = b.bin GROUP BY 1, 2),
e AS (SELECT o.user_id, o.bin, o.n, max(p.bin) FILTER (p.bin < o.bin) AS pb, min(p.bin) FILTER (p.bin > o.bin) AS qb FROM h o LEFT JOIN h p ON p.user_id = o.user_id AND p.n > 0 GROUP BY 1, 2, 3)
SELECT e.user_id, e.bin, CAST(CASE WHEN e.n = 0 AND qb - pb <= 5 AND pb + 5 < 64 THEN ((e.bin - pb) * q.n + (qb - e.bin) * p.n) // (qb - pb) ELSE e.n END AS BIGINT) AS n
FROM e LEFT JOIN h p ON p.user_id = e.user_id AND p.bin = pb LEFT JOIN h q ON q.user_id = e.user_id AND q.bin = qb""")
image("hist_normalize", lambda g: histograms.normalised(histograms.histogram(g), 1000), _H + ", m AS (SELECT img_id, max(n) AS top FROM h GROUP BY 1) SELECT img_id, bin, CAST((n * 1000 + top // 2) // top AS BIGINT) AS n FROM h JOIN m USING (img_id)")
image("pmp_normalize", lambda g: histograms.stretched(g, 50, 950), _C + """, e AS (SELECT img_id, min(bin) FILTER (1000 * cum >= mass * 50) + 1 AS a, max(bin) FILTER (1000 * (mass - cum + n) >= mass * 50) - 1 AS b FROM c GROUP BY 1)
SELECT img_id, y, x, CAST(CASE WHEN a = b THEN a ELSE least(255, greatest(0, trunc(255.0::DOUBLE * (v - a) / (b - a)))) END AS INTEGER) AS v FROM grid JOIN e USING (img_id)""")

# --- pixel transport
for _name, _size, _bias, _div, _even in (("pyramid2x2", 2, 2, 4, False), ("squeeze2", 2, 1, 4, False), ("pyramid2x1", 2, 0, 2, True), ("pyramid4x2", 4, 3, 8, True), ("pyramid8x4", 8, 15, 32, True), ("pyramid4x2_sum", 4, 0, 1, True)):
    image(_name, lambda g, a=_size, b=_bias, c=_div, e=_even: transport.blocks(g, a, b, c, e), f"WITH grid AS ({{t}}) SELECT img_id, CAST(y // {_size} AS INTEGER) AS y, CAST(x // {_size} AS INTEGER) AS x, CAST((sum(v) + {_bias}) // {_div} AS INTEGER) AS v FROM grid {'WHERE y % 2 = 0' if _even else ''} GROUP BY 1, 2, 3")
image("squeeze2_simple", transport.every_second, "WITH grid AS ({t}) SELECT img_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, v FROM grid WHERE y % 2 = 0 AND x % 2 = 0")
_UP = "WITH grid AS ({t}), size AS (SELECT max(y) AS h, max(x) AS w FROM grid), o AS (SELECT img_id, a.i * 2 + s.dy AS y, b.i * 2 + t.dx AS x, a.i AS y0, b.i AS x0, s.dy, t.dx FROM (SELECT DISTINCT img_id FROM grid), (SELECT DISTINCT y AS i FROM grid) a, (SELECT DISTINCT x AS i FROM grid) b, (VALUES (0), (1)) s(dy), (VALUES (0), (1)) t(dx))"
image("expand2", transport.doubled, _UP + " SELECT o.img_id, CAST(o.y AS INTEGER) AS y, CAST(o.x AS INTEGER) AS x, g.v FROM o JOIN grid g ON g.img_id = o.img_id AND g.y = o.y0 AND g.x = o.x0")
image("expand2_smooth", transport.doubled_smooth, _UP + """ SELECT o.img_id, CAST(o.y AS INTEGER) AS y, CAST(o.x AS INTEGER) AS x, CAST((sum(g.v) + CASE count(*) WHEN 4 THEN 1 ELSE 0 END) // count(*) AS INTEGER) AS v
FROM o CROSS JOIN size JOIN grid g ON g.img_id = o.img_id AND g.y BETWEEN y0 AND least(h, y0 + dy) AND g.x BETWEEN x0 AND least(w, x0 + dx) GROUP BY 1, 2, 3""")
image("integral_image", transport.integral, "WITH grid AS ({t}) SELECT o.img_id, o.y, o.x, CAST(sum(sum(o.v)) OVER (PARTITION BY o.img_id, o.y ORDER BY o.x) AS BIGINT) AS v FROM (SELECT o.img_id, o.y, o.x, sum(n.v) AS v FROM grid o JOIN grid n ON n.img_id = o.img_id AND n.x = o.x AND n.y <= o.y GROUP BY 1, 2, 3) o GROUP BY 1, 2, 3")
image("split_halfframes", transport.split_half_frames, "WITH grid AS ({t}) SELECT img_id, CAST(row_number() OVER (PARTITION BY img_id, x ORDER BY y % 2, y) - 1 AS INTEGER) AS y, x, v FROM grid")
image("combine_halfframes", lambda g: transport.combine_half_frames(transport.split_half_frames(g)), "{t}")
image("interpolate_rows", transport.interpolate_odd_rows, near("CASE WHEN o.y % 2 = 1 THEN sum(n.v) // count(*) ELSE o.v END", [(-1, 0), (1, 0)]))
image("copy_rows", lambda g: transport.interpolate_odd_rows(g, True), "WITH grid AS ({t}) SELECT o.img_id, o.y, o.x, n.v FROM grid o JOIN grid n ON n.img_id = o.img_id AND n.x = o.x AND n.y = o.y - o.y % 2")
image("crop_center", lambda g: transport.crop_centre(g, 20, 30, 5, 60), "WITH grid AS ({t}) SELECT img_id, y, CAST(x - 34 AS INTEGER) AS x, v FROM grid WHERE y < 20 AND x >= 34")
image("mirror_x", transport.mirror_x, "WITH grid AS ({t}) SELECT img_id, y, CAST(63 - x AS INTEGER) AS x, v FROM grid")
image("mirror_y", transport.mirror_y, "WITH grid AS ({t}) SELECT img_id, CAST(63 - y AS INTEGER) AS y, x, v FROM grid")
image("transpose", transport.transpose, "WITH grid AS ({t}) SELECT img_id, x AS y, y AS x, v FROM grid")
_BLI = """, q AS (SELECT *, CAST(floor(sy) AS INTEGER) AS y0, CAST(floor(sx) AS INTEGER) AS x0 FROM p)
SELECT q.img_id, q.y, q.x, round(sum(CASE WHEN g.y = y0 THEN 1 - (sy - y0) ELSE sy - y0 END * CASE WHEN g.x = x0 THEN 1 - (sx - x0) ELSE sx - x0 END * coalesce(g.v, 0)), 6) AS v
FROM q LEFT JOIN grid g ON g.img_id = q.img_id AND g.y BETWEEN y0 AND y0 + 1 AND g.x BETWEEN x0 AND x0 + 1 GROUP BY 1, 2, 3"""
image("affine_bilinear", lambda g: transport.affine(g, (0.75, 0.25, 3.5, -0.25, 0.75, 12.25)), "WITH grid AS ({t}), p AS (SELECT img_id, y, x, CAST(0.75 * y + 0.25 * x + 3.5 AS DOUBLE) AS sy, CAST(-0.25 * y + 0.75 * x + 12.25 AS DOUBLE) AS sx FROM grid)" + _BLI.replace("sum(", "coalesce(sum(", 1).replace(", 0)), 6)", ", 0)), 0), 6)", 1))
image("polar_unwrap", lambda g: transport.polar(g, 31.5, 30.25, 90, 25, 4.0), "WITH grid AS ({t}), p AS (SELECT img_id, CAST(a AS INTEGER) AS y, CAST(r AS INTEGER) AS x, 31.5::DOUBLE + (4.0::DOUBLE + r) * sin(2 * pi() * a / 90) AS sy, 30.25::DOUBLE + (4.0::DOUBLE + r) * cos(2 * pi() * a / 90) AS sx FROM (SELECT DISTINCT img_id FROM grid), (SELECT unnest(range(90)) AS a), (SELECT unnest(range(25)) AS r))" + _BLI)

# --- gradients, edges, votes
_GR = "WITH grid AS ({t}), size AS (SELECT max(y) AS h, max(x) AS w FROM grid), g AS (SELECT o.img_id, o.y, o.x, r.v - l.v AS gx, d.v - u.v AS gy FROM grid o CROSS JOIN size JOIN grid l ON l.img_id = o.img_id AND l.y = o.y AND l.x = greatest(0, o.x - 1) JOIN grid r ON r.img_id = o.img_id AND r.y = o.y AND r.x = least(w, o.x + 1) JOIN grid u ON u.img_id = o.img_id AND u.x = o.x AND u.y = greatest(0, o.y - 1) JOIN grid d ON d.img_id = o.img_id AND d.x = o.x AND d.y = least(h, o.y + 1)), m AS (SELECT *, CAST(floor(0.5 + sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS INTEGER) AS mag FROM g)"
image("gradient_dxdy", lambda g: edges.magnitude(g).select("img_id", "y", "x", "gx", "gy", "mag"), _GR + " SELECT * FROM m")
_SOB = "WITH grid AS ({t}), k(dy, dx, a, b) AS (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)), s AS (SELECT o.img_id, o.y, o.x, sum(a * n.v) AS gx, sum(b * n.v) AS gy FROM grid o CROSS JOIN k JOIN grid n ON n.img_id = o.img_id AND n.y = o.y + dy AND n.x = o.x + dx GROUP BY 1, 2, 3 HAVING count(*) = 8)"
image("sobel_mag", edges.sobel, _SOB + " SELECT img_id, y, x, CAST(least(255, floor(sqrt(CAST(gx * gx + gy * gy AS DOUBLE)))) AS INTEGER) AS v FROM s")
image("sobel_mag_wide", lambda g: edges.sobel(g, None), _SOB + " SELECT img_id, y, x, CAST(floor(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS INTEGER) AS v FROM s")
_NMS = _GR + """, a AS (SELECT *, abs(gx) >= abs(gy) AS wide, CASE WHEN gx >= 0 THEN 1 ELSE -1 END AS sx, CASE WHEN gy >= 0 THEN 1 ELSE -1 END AS sy, greatest(abs(gx), abs(gy)) AS major, least(abs(gx), abs(gy)) AS minor FROM m),
p AS (SELECT a.img_id, a.y, a.x, a.gx, a.gy, a.mag FROM a CROSS JOIN size
  JOIN m b ON b.img_id = a.img_id AND b.y = a.y - CASE WHEN wide THEN 0 ELSE sy END AND b.x = a.x - CASE WHEN wide THEN sx ELSE 0 END JOIN m bc ON bc.img_id = a.img_id AND bc.y = a.y - sy AND bc.x = a.x - sx
  JOIN m f ON f.img_id = a.img_id AND f.y = a.y + CASE WHEN wide THEN 0 ELSE sy END AND f.x = a.x + CASE WHEN wide THEN sx ELSE 0 END JOIN m fc ON fc.img_id = a.img_id AND fc.y = a.y + sy AND fc.x = a.x + sx
  WHERE a.x BETWEEN 1 AND w - 2 AND a.y BETWEEN 1 AND h - 2 AND a.mag > 0 AND (b.mag - a.mag) * major + (bc.mag - b.mag) * minor < 0 AND (f.mag - a.mag) * major + (fc.mag - f.mag) * minor < 0)"""
_GAUSS = "k AS (SELECT unnest(range(-{h}, {h} + 1)) AS d), gh AS (SELECT o.img_id, o.y, o.x, sum(n.v * pow(2.71828, -0.5 * pow(d / {s}, 2))) / sum(pow(2.71828, -0.5 * pow(d / {s}, 2))) AS v FROM raw o CROSS JOIN k JOIN raw n ON n.img_id = o.img_id AND n.y = o.y AND n.x = o.x + d GROUP BY 1, 2, 3), gs AS (SELECT o.img_id, o.y, o.x, sum(n.v * pow(2.71828, -0.5 * pow(d / {s}, 2))) / sum(pow(2.71828, -0.5 * pow(d / {s}, 2))) AS v FROM gh o CROSS JOIN k JOIN gh n ON n.img_id = o.img_id AND n.x = o.x AND n.y = o.y + d GROUP BY 1, 2, 3)"
_SMOOTHED = "WITH raw AS ({t}), " + _GAUSS.format(h=5, s="2.0::DOUBLE") + ", grid AS (SELECT img_id, y, x, CAST(floor(v * 90 + 0.5) AS INTEGER) AS v FROM gs)"
image("smoothed_short", lambda g: edges.smoothed(g, 2.0), _SMOOTHED + " SELECT * FROM grid", "disc")
image("edge_peaks", edges.thinned, _NMS + " SELECT * FROM p", "disc")
_THR = _NMS.replace("WITH grid AS ({t})", _SMOOTHED, 1) + """, cc AS (SELECT img_id, mag, sum(count(*)) OVER (PARTITION BY img_id ORDER BY mag) AS cum, sum(count(*)) OVER (PARTITION BY img_id) AS mass, max(mag) OVER (PARTITION BY img_id) AS top FROM p GROUP BY img_id, mag),
t AS (SELECT img_id, greatest(1, least(min(mag) FILTER (cum >= floor(mass * 0.8 + 0.5)), max(top) - 1)) AS hi FROM cc GROUP BY 1), th AS (SELECT img_id, CAST(hi AS INTEGER) AS hi, CAST(floor(hi * 0.4 + 0.5) AS INTEGER) AS lo FROM t)"""
image("canny_thresholds", lambda g: edges.thresholds(edges.thinned(edges.smoothed(g, 2.0)), 0.4, 0.8), _THR + " SELECT * FROM th", "disc")
image("canny_edges", lambda g: edges.canny(g, 2.0, 0.4, 0.8), _THR.replace("WITH raw", "WITH RECURSIVE raw", 1) + """, c AS (SELECT p.*, mag >= hi AS seed FROM p JOIN th USING (img_id) WHERE mag >= hi OR mag > lo),
f(img_id, y, x) AS (SELECT img_id, y, x FROM c WHERE seed UNION SELECT c.img_id, c.y, c.x FROM f JOIN c ON c.img_id = f.img_id AND abs(c.y - f.y) <= 1 AND abs(c.x - f.x) <= 1) SELECT img_id, y, x, gx, gy, mag FROM c SEMI JOIN f USING (img_id, y, x)""", "disc")
_PTS = _GR + ", e AS (SELECT m.img_id, y, x, gx, gy, CAST(((CAST(floor(degrees(atan2(gy, gx))) AS INTEGER) % 360) + 360) % 360 AS INTEGER) AS dir FROM m CROSS JOIN size WHERE mag >= 60 AND x BETWEEN 3 AND w - 3 AND y BETWEEN 3 AND h - 3)"
_points = lambda g: edges.edge_points(g, 60, 3)
image("edge_points", _points, _PTS + " SELECT * FROM e", "disc")
_VOTE = _PTS + """, j AS (SELECT a.img_id, a.x AS x1, a.y AS y1, a.gx AS gx1, a.gy AS gy1, b.x AS x2, b.y AS y2, CAST(a.gx * b.gy - a.gy * b.gx AS DOUBLE) AS crs, CAST((b.x - a.x) * b.gy - (b.y - a.y) * b.gx AS DOUBLE) AS num
  FROM e a JOIN e b ON a.img_id = b.img_id AND (b.dir - a.dir - 90 + 10 + 720) % 360 <= 20),
f AS (SELECT *, x1 + num / crs * gx1 AS fx, y1 + num / crs * gy1 AS fy FROM j WHERE crs <> 0),
r AS (SELECT *, sqrt((fx - x1) * (fx - x1) + (fy - y1) * (fy - y1)) AS r1, sqrt((fx - x2) * (fx - x2) + (fy - y2) * (fy - y2)) AS r2 FROM f),
vt AS (SELECT img_id, CAST(floor(fy + 0.5) AS INTEGER) AS yc, CAST(floor(fx + 0.5) AS INTEGER) AS xc, count(*) AS n FROM r WHERE abs(r1 - r2) < 2 AND greatest(r1, r2) BETWEEN 5 AND 30 GROUP BY 1, 2, 3)"""
_votes = lambda g: edges.pair_votes(_points(g), 90, 10, 5, 30)
image("edge_pairs_vote", _votes, _VOTE + " SELECT * FROM vt", "disc")
_BEST = _VOTE + ", bc AS (SELECT img_id, yc, xc, n FROM vt QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY n DESC, yc, xc) = 1)"
image("circle_centre", lambda g: edges.best_centre(_votes(g)), _BEST + " SELECT * FROM bc", "disc")
image("radius_hist", lambda g: edges.radius_histogram(_points(g), edges.best_centre(_votes(g)), 5, 32, 0.96), _BEST + """, q AS (SELECT e.img_id, y - yc AS ry, x - xc AS rx, gx, gy FROM e JOIN bc USING (img_id)), z AS (SELECT *, rx * rx + ry * ry AS r2, CAST(rx * gx + ry * gy AS DOUBLE) AS dot FROM q)
SELECT img_id, CAST(floor(sqrt(CAST(r2 AS DOUBLE)) + 0.5) AS INTEGER) AS r, count(*) AS n FROM z WHERE r2 > 0 AND dot * dot / (CAST(r2 AS DOUBLE) * (gx * gx + gy * gy)) > 0.96::DOUBLE * 0.96::DOUBLE AND floor(sqrt(CAST(r2 AS DOUBLE)) + 0.5) BETWEEN 5 AND 31 GROUP BY 1, 2""", "disc")
image("hough_projection", lambda g: edges.projections(_points(g), 33, 30), _PTS + """, z AS (SELECT *, x - 30 AS rx, y - 33 AS ry FROM e) SELECT img_id, CASE WHEN rx < 0 THEN 'left' ELSE 'right' END AS side, CAST(floor(sqrt(CAST(rx * rx + ry * ry AS DOUBLE))) AS INTEGER) AS r, count(*) AS n
FROM z WHERE rx * rx + ry * ry > 0 AND 4 * CAST(rx * gx + ry * gy AS BIGINT) * (rx * gx + ry * gy) > 3 * CAST(rx * rx + ry * ry AS BIGINT) * (gx * gx + gy * gy) GROUP BY 1, 2, 3""", "disc")

# --- components
_CC = """WITH RECURSIVE grid AS ({t}), p AS (SELECT img_id, y, x FROM grid WHERE v > 215), f(img_id, y, x, r) AS (SELECT img_id, y, x, y * 64 + x FROM p UNION SELECT q.img_id, q.y, q.x, f.r FROM f JOIN p q ON q.img_id = f.img_id AND abs(q.y - f.y) + abs(q.x - f.x) = 1),
l AS (SELECT img_id, y, x, min(r) AS c FROM f GROUP BY 1, 2, 3), mo AS (SELECT img_id, c, CAST(c // 64 AS INTEGER) AS yb, CAST(c % 64 AS INTEGER) AS xb, count(*) AS m, CAST(sum(x) AS BIGINT) AS mx, CAST(sum(y) AS BIGINT) AS my, CAST(sum(x * x) AS BIGINT) AS mxx, CAST(sum(x * y) AS BIGINT) AS mxy, CAST(sum(y * y) AS BIGINT) AS myy FROM l GROUP BY 1, 2)"""
_bright = lambda g, least: components.moments(components.labelled(g.filter("v > 215").select("img_id", "y", "x")), least)
_ELL = """SELECT {key}, {more} round(xc, 6) AS xc, round(yc, 6) AS yc, round(sqrt(greatest(0, 2 * (a + c + rt))), 6) AS a, round(sqrt(greatest(0, 2 * (a + c - rt))), 6) AS b, round(atan2(2 * b, a - c) / 2, 6) AS tilt
FROM (SELECT *, sqrt((a - c) * (a - c) + 4 * b * b) AS rt FROM (SELECT *, mxx / m - xc * xc AS a, mxy / m - xc * yc AS b, myy / m - yc * yc AS c FROM (SELECT * REPLACE (CAST(m AS DOUBLE) AS m), m AS m0, mx / CAST(m AS DOUBLE) AS xc, my / CAST(m AS DOUBLE) AS yc FROM mo {where})))"""
image("cc_moments", lambda g: _bright(g, 2), _CC + " SELECT img_id, yb, xb, m, mx, my, mxx, mxy, myy FROM mo WHERE m >= 2")
image("ellipse_detect", lambda g: components.ellipses(_bright(g, 4)), _CC + " " + _ELL.format(key="img_id", more="yb, xb, m0 AS m,", where="WHERE m >= 4").replace("mo WHERE", "(SELECT * EXCLUDE (c) FROM mo) WHERE"))
image("flood_fill", lambda g: components.flooded(g, 33, 30, 20), "WITH RECURSIVE grid AS ({t}), p AS (SELECT g.img_id, g.y, g.x FROM grid g JOIN grid s ON s.img_id = g.img_id AND s.y = 33 AND s.x = 30 AND abs(g.v - s.v) <= 20), f(img_id, y, x) AS (SELECT img_id, y, x FROM p WHERE y = 33 AND x = 30 UNION SELECT q.img_id, q.y, q.x FROM f JOIN p q ON q.img_id = f.img_id AND abs(q.y - f.y) + abs(q.x - f.x) = 1) SELECT * FROM f", "disc")
image("killblik", components.glints_removed, "WITH grid AS ({t}) SELECT o.img_id, o.y, o.x, CAST(greatest(min(CASE WHEN n.y = o.y AND n.x <= o.x THEN n.v + o.x - n.x END), min(CASE WHEN n.y = o.y AND n.x >= o.x THEN n.v + n.x - o.x END), min(CASE WHEN n.x = o.x AND n.y <= o.y THEN n.v + o.y - n.y END), min(CASE WHEN n.x = o.x AND n.y >= o.y THEN n.v + n.y - o.y END)) AS INTEGER) AS v FROM grid o JOIN grid n ON n.img_id = o.img_id AND (n.y = o.y OR n.x = o.x) GROUP BY 1, 2, 3")
add("single_linkage", "points", lambda p: cluster.cluster_sizes(cluster.single_linkage(p, 3)), """WITH RECURSIVE pt AS ({t}), e AS (SELECT a.set_id, a.n AS a, b.n AS b FROM pt a JOIN pt b ON a.set_id = b.set_id AND a.n <> b.n AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9),
f(set_id, id, r) AS (SELECT set_id, n, n FROM pt UNION SELECT e.set_id, e.b, f.r FROM f JOIN e ON e.set_id = f.set_id AND e.a = f.id), l AS (SELECT set_id, id, min(r) AS cluster FROM f GROUP BY 1, 2)
SELECT set_id, cluster, count(*) AS n, CAST(row_number() OVER (PARTITION BY set_id ORDER BY count(*) DESC, cluster) AS INTEGER) AS place FROM l GROUP BY 1, 2""")

# --- sequences
add("seq_interpolate", "sig", lambda s: sequences.resampled(s, 40, "user_id"), """WITH sig AS ({t}), m AS (SELECT user_id, max(i) AS e FROM sig GROUP BY 1), o AS (SELECT user_id, CAST(k AS INTEGER) AS k, CAST(k * e AS DOUBLE) / 39 AS p FROM m CROSS JOIN (SELECT unnest(range(40)) AS k))
SELECT o.user_id, k, round(a.value + CASE WHEN b.value IS NULL THEN 0 ELSE (p - a.i) * (b.value - a.value) END, 6) AS value FROM o JOIN sig a ON a.user_id = o.user_id AND a.i = floor(p) LEFT JOIN sig b ON b.user_id = o.user_id AND b.i = a.i + 1""")
add("seq_interpolate_timed", "sig", lambda s: sequences.timed(s, 30, "user_id"), """WITH sig AS ({t}), m AS (SELECT user_id, min(t_us) AS t0, max(t_us) AS t1 FROM sig GROUP BY 1), o AS (SELECT user_id, CAST(k AS INTEGER) AS k, t0 + k * (CAST(t1 - t0 AS DOUBLE) / 29) AS p FROM m CROSS JOIN (SELECT unnest(range(30)) AS k) WHERE t1 > t0),
s AS (SELECT user_id, t_us AS t, value AS a, lead(t_us) OVER w AS t2, lead(value) OVER w AS b FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY t_us))
SELECT o.user_id, k, round(CASE WHEN k = 29 THEN s.a ELSE ((t2 - p) * a + (p - t) * b) / (t2 - t) END, 6) AS value FROM o JOIN s ON s.user_id = o.user_id AND CASE WHEN k = 29 THEN t2 IS NULL ELSE p >= t AND p < t2 END""")
add("seq_line_median", "sig", lambda s: sequences.running_median(s, 3, "user_id"), "WITH sig AS ({t}), m AS (SELECT user_id, max(i) AS e FROM sig GROUP BY 1) SELECT o.user_id, o.i, list_sort(list(n.v))[4] AS v FROM sig o JOIN m USING (user_id) CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) JOIN sig n ON n.user_id = o.user_id AND n.i = least(e, greatest(0, o.i + d)) GROUP BY 1, 2")
for _name, _grow, _agg in (("seq_erode_cyclic", False, "min"), ("seq_dilate_cyclic", True, "max")):
    add(_name, "sig", lambda s, g=_grow: sequences.circular(s, 4, "user_id", g), f"WITH sig AS ({{t}}), m AS (SELECT user_id, max(i) + 1 AS e FROM sig GROUP BY 1) SELECT o.user_id, o.i, {_agg}(n.v) AS v FROM sig o JOIN m USING (user_id) CROSS JOIN (SELECT unnest(range(-4, 5)) AS d) JOIN sig n ON n.user_id = o.user_id AND n.i = (o.i + d + e) % e GROUP BY 1, 2")

# --- statistics
add("det_curve", "scores", statistics.error_curve, """WITH s AS ({t}), o AS (SELECT score, is_same, row_number() OVER w AS r, sum(is_same) OVER w AS cs, sum(1 - is_same) OVER w AS ca, lead(is_same) OVER w AS nx, sum(is_same) OVER () AS st, sum(1 - is_same) OVER () AS al FROM s WINDOW w AS (ORDER BY score DESC, is_same, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(cs + ca AS BIGINT) AS k, score AS threshold, round((st - cs) / st, 9) AS frr, round(ca / al, 9) AS far FROM o WHERE nx IS NOT NULL AND nx <> is_same""".replace("lead(is_same) OVER w", "lead(is_same) OVER (ORDER BY score DESC, is_same, doc_id)"))
_ERR = "WITH mk AS ({t}), e AS (SELECT rec_id, 2 * sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) / ir AS ctr, abs(drp) / CAST(ir AS DOUBLE) AS pup, abs(dri) / CAST(ir AS DOUBLE) AS iri FROM mk), a AS (SELECT *, ctr + pup + iri AS total FROM e)"
add("detection_errors", "markup", lambda m: statistics.detection_errors(m).select("rec_id", *(F.round(c, 9).alias(c) for c in ("ctr", "pup", "iri", "total"))), _ERR + " SELECT rec_id, round(ctr, 9) AS ctr, round(pup, 9) AS pup, round(iri, 9) AS iri, round(total, 9) AS total FROM a")
add("score_error_hist", "markup", lambda m: statistics.error_histograms(statistics.detection_errors(m)), _ERR + ", u AS (SELECT kind, floor(round(val * 100, 9)) AS b FROM (UNPIVOT (SELECT ctr, iri, pup, total FROM a) ON ctr, iri, pup, total INTO NAME kind VALUE val)) SELECT k.kind, CAST(r.bin AS INTEGER) AS bin, count(u.b) AS n FROM (SELECT DISTINCT kind FROM u) k CROSS JOIN (SELECT unnest(range(100)) AS bin) r LEFT JOIN u ON u.kind = k.kind AND u.b <= r.bin GROUP BY 1, 2")
add("circle_fit", "points", statistics.circle_fit, """WITH p AS ({t}), z AS (SELECT p.*, x - avg(x) OVER (PARTITION BY set_id) AS u, y - avg(y) OVER (PARTITION BY set_id) AS w, avg(x) OVER (PARTITION BY set_id) AS ax, avg(y) OVER (PARTITION BY set_id) AS ay FROM p),
s AS (SELECT set_id, ax, ay, count(*) AS n, sum(u*u) AS uu, sum(u*w) AS uv, sum(w*w) AS vv, sum(u*u*u + u*w*w) AS p, sum(w*w*w + w*u*u) AS q FROM z GROUP BY 1, 2, 3), f AS (SELECT *, (p*vv - q*uv) / (2 * (uu*vv - uv*uv)) AS a, (q*uu - p*uv) / (2 * (uu*vv - uv*uv)) AS b FROM s WHERE abs(uu*vv - uv*uv) >= 1e-5),
c AS (SELECT set_id, ax + a AS xc, ay + b AS yc, sqrt(a*a + b*b + (uu + vv) / n) AS r FROM f) SELECT set_id, round(xc, 6) AS xc, round(yc, 6) AS yc, round(r, 6) AS r, round(avg(abs(sqrt((x - xc)*(x - xc) + (y - yc)*(y - yc)) - r)), 6) AS off FROM p JOIN c USING (set_id) GROUP BY set_id, xc, yc, r""")
add("line_fit", "points", statistics.line_fit, "WITH p AS ({t}) SELECT set_id, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS base, round(regr_r2(y, x), 6) AS r2 FROM p GROUP BY 1")
add("equivalent_ellipse", "points", lambda p: components.ellipses(statistics.point_moments(p)), "WITH p AS ({t}), mo AS (SELECT set_id, count(*) AS m, sum(x) AS mx, sum(y) AS my, sum(x * x) AS mxx, sum(x * y) AS mxy, sum(y * y) AS myy FROM p GROUP BY 1) " + _ELL.format(key="set_id", more="m0 AS m,", where=""))
add("class_means", "vec", statistics.class_means, "WITH vec AS ({t}) SELECT label, i, round(avg(e), 9) AS mean FROM vec GROUP BY 1, 2")
add("cov_total", "vec", lambda v: statistics.products(v, 12, False), "WITH vec AS ({t}) SELECT a.i, b.i AS j, round(count(*) * sum(a.e * b.e) - sum(a.e) * sum(b.e), 6) AS c FROM vec a JOIN vec b ON a.vec_id = b.vec_id WHERE a.i < 12 AND b.i < 12 GROUP BY 1, 2")
add("cov_within", "vec", lambda v: statistics.products(v, 12, True), "WITH vec AS ({t}), k AS (SELECT a.label, a.i, b.i AS j, count(*) * sum(a.e * b.e) - sum(a.e) * sum(b.e) AS c FROM vec a JOIN vec b ON a.vec_id = b.vec_id WHERE a.i < 12 AND b.i < 12 GROUP BY 1, 2, 3) SELECT i, j, round(sum(c), 6) AS c FROM k GROUP BY 1, 2")
# The SQL of cov_total and cov_within states 12 of the 64 components; these two have all.
add("cov_total_all", "vec", lambda v: statistics.products(v, 64, False), None)
add("cov_within_all", "vec", lambda v: statistics.products(v, 64, True), None)
add("matmul_abt", "vec", lambda v: statistics.multiply(v.groupBy(F.col("label").alias("i"), F.col("i").alias("j")).agg(F.sum("e").alias("a")), v.groupBy(F.col("label").alias("i"), F.col("i").alias("j")).agg(F.max("e").alias("a"))), "WITH vec AS ({t}), a AS (SELECT label AS i, i AS k, sum(e) AS a, max(e) AS b FROM vec GROUP BY 1, 2) SELECT p.i, q.i AS j, round(sum(p.a * q.b), 6) AS a FROM a p JOIN a q ON p.k = q.k GROUP BY 1, 2")
add("pca_expand", "vec", lambda v: statistics.principal(v, 64, 4), None)
add("ndc_classify", "vec", lambda v: statistics.gaussian_classes(v, 64), None)

# --- transforms, quality, whole numbers
add("dft", "vec", lambda v: spectral.fourier(v, ["i"]).withColumnRenamed("i", "k"), "WITH vec AS ({t}) SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(e * cos(-2 * pi() / 64 * ((k * i) % 64))), 6) AS re, round(sum(e * sin(-2 * pi() / 64 * ((k * i) % 64))), 6) AS im FROM vec CROSS JOIN (SELECT unnest(range(64)) AS k) GROUP BY 1, 2")
_REV = "({k} // 32 + ({k} // 16 % 2) * 2 + ({k} // 8 % 2) * 4 + ({k} // 4 % 2) * 8 + ({k} // 2 % 2) * 16 + ({k} % 2) * 32)"
_REV8 = "({k} // 4 + ({k} // 2 % 2) * 2 + ({k} % 2) * 4)"
add("walsh", "vec", lambda v: spectral.walsh(v, ["i"]).withColumnRenamed("i", "k"), "WITH vec AS ({t}) SELECT vec_id, CAST(k AS INTEGER) AS k, round(sum(CASE WHEN bit_count(i & CAST(" + _REV.format(k="k") + " AS INTEGER)) % 2 = 0 THEN e ELSE -e END), 6) AS e FROM vec CROSS JOIN (SELECT unnest(range(64)) AS k) GROUP BY 1, 2")
add("haar", "vec", lambda v: spectral.haar(v, ["i"]).withColumnRenamed("i", "k"), "WITH vec AS ({t}), l AS (SELECT CAST(1 << unnest(range(6)) AS INTEGER) AS b), u AS (SELECT vec_id, 0 AS k, e FROM vec UNION ALL SELECT vec_id, CAST(b + i // (64 // b) AS INTEGER), CASE WHEN i % (64 // b) < 32 // b THEN e ELSE -e END FROM vec CROSS JOIN l) SELECT vec_id, k, round(sum(e), 6) AS e FROM u GROUP BY 1, 2")
_K8 = "(SELECT CAST(unnest(range(8)) AS INTEGER) AS p) a, (SELECT CAST(unnest(range(8)) AS INTEGER) AS q) b"
add("dft_2d", "img8", lambda g: spectral.fourier(g, ["y", "x"], "v", "img_id"), f"WITH g AS ({{t}}) SELECT img_id, p AS y, q AS x, round(sum(v * cos(-2 * pi() / 8 * ((p * y + q * x) % 8))), 6) + 0 AS re, round(sum(v * sin(-2 * pi() / 8 * ((p * y + q * x) % 8))), 6) + 0 AS im FROM g, {_K8} GROUP BY 1, 2, 3")
add("dft_back", "img8", lambda g: spectral.fourier(spectral.fourier(g, ["y", "x"], "v", "img_id"), ["y", "x"], "re", "img_id", "im", True).select("img_id", "y", "x", F.round("re", 3).cast("int").alias("v")), "SELECT img_id, y, x, v FROM ({t})")
add("dft_3d", "vec", lambda v: spectral.fourier(v.select("vec_id", F.expr("cast(i div 16 as int)").alias("z"), F.expr("cast(i div 4 % 4 as int)").alias("y"), (F.col("i") % 4).alias("x"), "e"), ["z", "y", "x"]), "WITH g AS ({t}), k AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS k) SELECT vec_id, k // 16 AS z, k // 4 % 4 AS y, k % 4 AS x, round(sum(e * cos(-pi() / 2 * (((k // 16) * (i // 16) + (k // 4 % 4) * (i // 4 % 4) + (k % 4) * (i % 4)) % 4))), 6) + 0 AS re, round(sum(e * sin(-pi() / 2 * (((k // 16) * (i // 16) + (k // 4 % 4) * (i // 4 % 4) + (k % 4) * (i % 4)) % 4))), 6) + 0 AS im FROM g CROSS JOIN k GROUP BY 1, 2, 3, 4")
add("walsh_2d", "img8", lambda g: spectral.walsh(g, ["y", "x"], "v", "img_id"), f"WITH g AS ({{t}}) SELECT img_id, p AS y, q AS x, CAST(sum(CASE WHEN (bit_count(y & {_REV8.format(k='p')}) + bit_count(x & {_REV8.format(k='q')})) % 2 = 0 THEN v ELSE -v END) AS DOUBLE) AS e FROM g, {_K8} GROUP BY 1, 2, 3")
_HAAR8 = "CASE WHEN {k} = 0 THEN 1 WHEN {i} // CAST(8 / {b} AS INTEGER) <> {k} - {b} THEN 0 WHEN {i} % CAST(8 / {b} AS INTEGER) < CAST(4 / {b} AS INTEGER) THEN 1 ELSE -1 END"
_BAND = "CASE WHEN {k} >= 4 THEN 4 WHEN {k} >= 2 THEN 2 ELSE 1 END"
add("haar_2d", "img8", lambda g: spectral.haar(g, ["y", "x"], "v", "img_id"), f"WITH g AS ({{t}}) SELECT img_id, p AS y, q AS x, CAST(sum(v * {_HAAR8.format(k='p', i='y', b='(' + _BAND.format(k='p') + ')')} * {_HAAR8.format(k='q', i='x', b='(' + _BAND.format(k='q') + ')')}) AS DOUBLE) AS e FROM g, {_K8} GROUP BY 1, 2, 3")
def _pyramid(levels: int) -> str:
    """SQL: p0 to p<levels>, each half the size of the one before, and e(img_id, level, e), their energies."""
    parts = ["p0 AS ({t})"]
    for k in range(levels):
        parts.append(f"p{k + 1} AS (SELECT img_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST((sum(v) + count(*) // 2) // count(*) AS INTEGER) AS v FROM p{k} GROUP BY 1, 2, 3)")
        parts.append(f"""e{k} AS (SELECT o.img_id, {k} AS level, CAST(floor(floor(sqrt(CAST(sum(d * d) AS DOUBLE) / count(*)) * 256) / pow(2.0::DOUBLE, {k / 2})) AS INTEGER) AS e FROM (
  SELECT o.img_id, (5 * a.v + b.v + c.v + d.v + 4) // 8 - o.v AS d FROM p{k} o CROSS JOIN (SELECT max(y) AS h, max(x) AS w FROM p{k + 1}) s
  JOIN p{k + 1} a ON a.img_id = o.img_id AND a.y = o.y // 2 AND a.x = o.x // 2 JOIN p{k + 1} b ON b.img_id = o.img_id AND b.y = o.y // 2 AND b.x = least(w, greatest(0, o.x // 2 + 2 * (o.x % 2) - 1))
  JOIN p{k + 1} c ON c.img_id = o.img_id AND c.x = o.x // 2 AND c.y = least(h, greatest(0, o.y // 2 + 2 * (o.y % 2) - 1)) JOIN p{k + 1} d ON d.img_id = o.img_id AND d.y = c.y AND d.x = b.x) o GROUP BY 1)""")
    return "WITH " + ", ".join(parts) + ", e AS (" + " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(levels)) + ")"


image("pyramid_energies", quality.energies, _pyramid(6) + " SELECT * FROM e")
image("sharpness", quality.sharpness, _pyramid(6) + " SELECT img_id, CAST(-trunc(CAST(600 * (2 * sum(e * level) - 4 * sum(e)) AS DOUBLE) / 120) AS INTEGER) AS sharpness FROM e WHERE level < 5 GROUP BY 1")
image("split_nearest", lambda g: quality.residue(g, transport.every_second(g), False).select("img_id", "y", "x", F.col("d").bitwiseAND(255).alias("v")), "WITH grid AS ({t}) SELECT o.img_id, o.y, o.x, (n.v - o.v) & 255 AS v FROM grid o JOIN grid n ON n.img_id = o.img_id AND n.y = o.y - o.y % 2 AND n.x = o.x - o.x % 2")
image("split_mean", lambda g: quality.residue(g, quality.halved(g), False).select("img_id", "y", "x", F.col("d").bitwiseAND(255).alias("v")), "WITH grid AS ({t}), p AS (SELECT img_id, y // 2 AS y, x // 2 AS x, (sum(v) + 2) // 4 AS v FROM grid GROUP BY 1, 2, 3) SELECT o.img_id, o.y, o.x, CAST(n.v - o.v AS INTEGER) & 255 AS v FROM grid o JOIN p n ON n.img_id = o.img_id AND n.y = o.y // 2 AND n.x = o.x // 2")
image("noise", quality.noise, None)
image("motion", quality.motion, """WITH g0 AS ({t}), grid AS (SELECT img_id, y % 2 AS f, y // 2 AS y, x, v FROM g0), k(dy, dx, a, b) AS (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)),
s AS (SELECT o.img_id, o.f, o.y, o.x, sum(a * n.v) AS gx, sum(b * n.v) AS gy FROM grid o CROSS JOIN k JOIN grid n ON n.img_id = o.img_id AND n.f = o.f AND n.y = o.y + dy AND n.x = o.x + dx GROUP BY 1, 2, 3, 4 HAVING count(*) = 8), m AS (SELECT *, least(255, CAST(abs(gx) + abs(gy) AS BIGINT) // 8) AS v FROM s)
SELECT a.img_id, CAST(64 * CAST(sum(abs(a.v - b.v)) AS BIGINT) // count(*) AS INTEGER) AS motion FROM m a JOIN m b ON a.img_id = b.img_id AND a.f = 0 AND b.f = 1 AND a.y = b.y AND a.x = b.x GROUP BY 1""")
image("sync_loss", spectral.sync_loss, """WITH grid AS ({t}), d AS (SELECT a.img_id, a.y, CAST(floor(sqrt(CAST(sum((a.v - b.v) * (a.v - b.v)) // count(*) AS DOUBLE))) AS INTEGER) AS m FROM grid a JOIN grid b ON a.img_id = b.img_id AND a.x = b.x AND b.y = a.y + 2 WHERE a.y % 2 = 0 GROUP BY 1, 2),
l AS (SELECT img_id, list_reverse_sort(list(m)) AS m FROM d GROUP BY 1) SELECT img_id, m[1] - m[2] > m[2] - m[3] AND m[1] - m[2] > 1 AS lost FROM l""")
add("vj_features", "img8", spectral.box_features, "WITH g AS ({t}) SELECT img_id, label, feature, value FROM (UNPIVOT (SELECT img_id, label, CAST(sum(CASE WHEN x < 4 THEN v ELSE -v END) AS BIGINT) AS left_right, CAST(sum(CASE WHEN y < 4 THEN v ELSE -v END) AS BIGINT) AS top_bottom, CAST(sum(CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN v ELSE -v END) AS BIGINT) AS centre_border, CAST(sum(CASE WHEN (x < 4) = (y < 4) THEN v ELSE -v END) AS BIGINT) AS diagonal FROM g GROUP BY 1, 2) ON left_right, top_bottom, centre_border, diagonal INTO NAME feature VALUE value)")
QUERIES["whole_functions"] = lambda spark, sf_dir: spectral.whole_functions(spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey > 0"), "o_orderkey")
ORACLE_SQL["whole_functions"] = "SELECT o_orderkey, CAST(floor(sqrt(CAST(o_orderkey AS DOUBLE))) AS BIGINT) AS root, CAST(floor(log2(CAST(o_orderkey AS DOUBLE))) AS INTEGER) AS log_lo, CAST(ceil(log2(CAST(o_orderkey AS DOUBLE))) AS INTEGER) AS log_hi, CAST((o_orderkey & 255) * 16777216 + ((o_orderkey // 256) & 255) * 65536 + ((o_orderkey // 65536) & 255) * 256 + ((o_orderkey // 16777216) & 255) AS BIGINT) AS swapped FROM orders WHERE o_orderkey > 0"
QUERIES["checksums"] = lambda spark, sf_dir: spectral.checksums(spark.read.parquet(f"{sf_dir}/documents.parquet"))
image("gaussian_smooth", lambda g: filters.gaussian(g, 1.2).withColumn("v", F.round("v", 6)), """WITH grid AS ({t}), k AS (SELECT unnest(range(-3, 4)) AS d), h AS (SELECT o.img_id, o.y, o.x, sum(n.v * pow(2.71828, -0.5 * pow(d / 1.2, 2))) / sum(pow(2.71828, -0.5 * pow(d / 1.2, 2))) AS v FROM grid o CROSS JOIN k JOIN grid n ON n.img_id = o.img_id AND n.y = o.y AND n.x = o.x + d GROUP BY 1, 2, 3)
SELECT o.img_id, o.y, o.x, round(sum(n.v * pow(2.71828, -0.5 * pow(d / 1.2, 2))) / sum(pow(2.71828, -0.5 * pow(d / 1.2, 2))), 6) AS v FROM h o CROSS JOIN k JOIN h n ON n.img_id = o.img_id AND n.x = o.x AND n.y = o.y + d GROUP BY 1, 2, 3""")
image("diffusion", lambda g: filters.diffuse(g, 8.0, 0.2, 1).withColumn("v", F.round("v", 6)), "WITH grid AS ({t}), k(dy, dx) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) SELECT o.img_id, o.y, o.x, round(o.v + 0.2 * sum((n.v - o.v) * exp(-abs(n.v - o.v) / 64.0)), 6) AS v FROM grid o CROSS JOIN k JOIN grid n ON n.img_id = o.img_id AND n.y = o.y + dy AND n.x = o.x + dx GROUP BY o.img_id, o.y, o.x, o.v")
image("resample_frames", lambda g: transport.resampled_frames(g, 5, 3), """WITH grid AS ({t}), s AS (SELECT dense_rank() OVER (ORDER BY img_id) - 1 AS i, y, x, v FROM grid), n AS (SELECT max(i) AS e FROM s), o AS (SELECT k, CAST(k * e AS DOUBLE) / 9 AS p FROM n CROSS JOIN (SELECT unnest(range(10)) AS k))
SELECT CAST(k // 2 AS INTEGER) AS img_id, a.y, a.x, CAST(least(255, greatest(0, floor(a.v + (p - floor(p)) * coalesce(b.v - a.v, 0) + 0.5 + 1e-9) + 6)) AS INTEGER) AS v FROM o JOIN s a ON a.i = floor(p) AND a.y % 2 = k % 2 LEFT JOIN s b ON b.i = a.i + 1 AND b.y = a.y AND b.x = a.x""")
QUERIES["fixed_functions"] = lambda spark, sf_dir: spectral.fixed_functions(spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey > 0"), "o_orderkey")
_TABLED = "(floor({f0} * 1048576 + 0.5) + floor((floor({f1} * 1048576 + 0.5) - floor({f0} * 1048576 + 0.5)) * {rest} / {span}))"


def _tabled(f: str, place: str, rest: str, span: int) -> str:
    """SQL: between the table's entries at `place` and the next; f has $ for the argument."""
    at = lambda p: "(" + f.replace("$", f"(CAST({p} AS DOUBLE) / 1024)") + ")"
    return _TABLED.format(f0=at(place), f1=at(f"({place} + 1)"), rest=rest, span=f"{span}::DOUBLE")


_ATAN = _tabled("atan($)", "(q // 1024)", "(q % 1024)", 1024)
ORACLE_SQL["fixed_functions"] = f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS c FROM orders WHERE o_orderkey > 0),
a AS (SELECT *, c % 6588397 AS x, (c % 16777216) - 4194304 AS e, CAST(floor(log2(CAST(c AS DOUBLE))) AS BIGINT) AS k, c - 32768 AS dy FROM o),
b AS (SELECT *, CASE WHEN x >= 3294198 THEN x - 3294198 ELSE x END AS y, CASE WHEN e < 0 THEN -((-e + 1048575) // 1048576) ELSE e // 1048576 END AS sh, CASE WHEN k > 22 THEN c >> (k - 22) ELSE c << (22 - least(22, k)) END % 4194304 AS m, (c << (32 - k)) % 4294967296 AS w,
  CASE WHEN abs(dy) >= c THEN (c * 1048576) // greatest(1, abs(dy)) ELSE (abs(dy) * 1048576) // c END AS q FROM a),
d AS (SELECT *, CASE WHEN y >= 1647099 THEN 3294198 - y ELSE y END AS z, e - sh * 1048576 AS r FROM b)
SELECT o_orderkey, CAST(CASE WHEN (x >= 3294198) <> (y >= 1647099) THEN -1 ELSE 1 END * {_tabled("cos($)", "(z // 1024)", "(z % 1024)", 1024)} AS BIGINT) AS cosine,
  CASE WHEN sh >= 12 THEN 4294967295 WHEN sh >= 0 THEN CAST({_tabled("pow(2.0::DOUBLE, $)", "(r // 1024)", "(r % 1024)", 1024)} AS BIGINT) << sh ELSE CAST({_tabled("pow(2.0::DOUBLE, $)", "(r // 1024)", "(r % 1024)", 1024)} AS BIGINT) >> (-sh) END AS power,
  CAST((k - 20) * 1048576 + {_tabled("log2(1 + $)", "(m // 4096)", "(m % 4096)", 4096)} AS BIGINT) AS logarithm, CAST(k * 1048576 + {_tabled("log2(1 + $)", "(w // 4194304)", "((w // 4) % 1048576)", 1048576)} AS BIGINT) AS logarithm_whole,
  CAST(CASE WHEN dy = 0 THEN 0 ELSE sign(dy) * CASE WHEN abs(dy) >= c THEN 1647099 - {_ATAN} ELSE {_ATAN} END END AS BIGINT) AS angle FROM d"""
