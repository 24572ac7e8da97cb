"""Further registered queries: colour, polar sheets, ranks, regions, linear algebra, segmentation; each with an independent DuckDB statement where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import colour, edges, fits, glints, linear, polar, ranks, regions, segmentation, transport
from ..sources.fixtures import view
from .queries import _SMOOTHED, QUERIES, add, image, near, square

# --- colour and scaling
_STEPS = "o AS (SELECT img_id, i.y, j.x, j.x * {a} + i.y * {b} + {ox} AS gx, j.x * {c} + i.y * {d} + {oy} AS gy, h, w FROM (SELECT DISTINCT img_id FROM g), (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM g), (SELECT CAST(unnest(range({H})) AS INTEGER) AS y) i, (SELECT CAST(unnest(range({W})) AS INTEGER) AS x) j), q AS (SELECT *, gx >= 0 AND (gx >> 16) + 1 < w AND gy >= 0 AND (gy >> 16) + 1 < h AS ok, greatest(gx, 0) >> 16 AS x0, greatest(gy, 0) >> 16 AS y0, greatest(gx, 0) & 65535 AS px, greatest(gy, 0) & 65535 AS py FROM o), z AS (SELECT *, px >> 8 AS fx, (65536 - px) >> 8 AS ex, py >> 8 AS fy, (65536 - py) >> 8 AS ey FROM q)"
_FOUR = " FROM z o LEFT JOIN g a ON a.img_id = o.img_id AND a.y = y0 AND a.x = x0 LEFT JOIN g b ON b.img_id = o.img_id AND b.y = y0 AND b.x = x0 + 1 LEFT JOIN g c ON c.img_id = o.img_id AND c.y = y0 + 1 AND c.x = x0 LEFT JOIN g d ON d.img_id = o.img_id AND d.y = y0 + 1 AND d.x = x0 + 1"


def _sum(c: str) -> str:
    return f"a.{c} * ex * ey + b.{c} * fx * ey + c.{c} * ex * fy + d.{c} * fx * fy"


def _steps(matrix, height, width, origin=(0.0, 0.0)) -> str:
    a, b, c, d = (int(m * 65536 + 0.5) if m * 65536 + 0.5 >= 0 else -int(-(m * 65536 + 0.5)) for m in matrix)
    return _STEPS.format(a=a, b=b, c=c, d=d, ox=int(origin[0] * 65536), oy=int(origin[1] * 65536), H=height, W=width)


_TURN, _AT = (0.8, -0.3, 0.35, 0.7), (6.5, 2.25)
_RGB = "WITH g AS ({t}), " + _steps(_TURN, 40, 48, _AT)
image("affine_rgb", lambda g: colour.affine_rgb(g, _TURN, 40, 48, _AT), _RGB + " SELECT o.img_id, o.y, o.x, " + ", ".join(f"CAST(CASE WHEN ok THEN (32768 + {_sum(c)}) >> 16 ELSE 0 END AS INTEGER) AS {c}" for c in "rgb") + _FOUR, "rgb")
image("affine_rgb_nearest", lambda g: colour.affine_rgb(g, _TURN, 40, 48, _AT, False), _RGB + " SELECT o.img_id, o.y, o.x, " + ", ".join(f"CAST(CASE WHEN ok THEN n.{c} ELSE 0 END AS INTEGER) AS {c}" for c in "rgb") + " FROM z o LEFT JOIN g n ON n.img_id = o.img_id AND n.y = y0 + CASE WHEN py > 32768 THEN 1 ELSE 0 END AND n.x = x0 + CASE WHEN px > 32768 THEN 1 ELSE 0 END", "rgb")
_GREY = " SELECT o.img_id, o.y, o.x, CAST(CASE WHEN ok THEN ((98304 + " + " + ".join(map(_sum, "rgb")) + ") // 3) >> 16 ELSE 0 END AS INTEGER) AS v" + _FOUR
image("affine_rgb_grey", lambda g: colour.affine_rgb_to_grey(g, _TURN, 40, 48, _AT), _RGB + _GREY, "rgb")
_DOWN = colour.scale(64, 64, 40, 28)
image("scale_rgb_grey", lambda g: colour.affine_rgb_to_grey(g, _DOWN, 28, 40), "WITH g AS ({t}), " + _steps(_DOWN, 28, 40) + _GREY, "rgb")
_LUMA = " SELECT o.img_id, o.y, o.x, CAST(CASE WHEN ok THEN (32768 + " + _sum("v") + ") >> 16 ELSE 0 END AS INTEGER) AS v" + _FOUR
image("affine_luma", lambda g: colour.affine_luma(g, _TURN, 40, 48, _AT), "WITH g AS ({t}), " + _steps(_TURN, 40, 48, _AT) + _LUMA)
image("scale_luma", lambda g: colour.affine_luma(g, _DOWN, 28, 40), "WITH g AS ({t}), " + _steps(_DOWN, 28, 40) + _LUMA)
image("scale_grey", lambda g: colour.rotate_scale(g, 0.0, 28, 40, (0.0, 0.0, 64.0, 64.0)), "WITH g AS ({t}), " + _STEPS.format(a=1048576 * 64 // (40 * 16), b=0, c=0, d=1048576 * 64 // (28 * 16), ox=0, oy=0, H=28, W=40) + _LUMA)
_BAYER = "WITH g0 AS ({t}), g AS (SELECT img_id, y // 2 AS y, x // 2 AS x, max(v) FILTER (y % 2 = 0 AND x % 2 = 0) AS r, max(v) FILTER (y % 2 = 0 AND x % 2 = 1) AS g, max(v) FILTER (y % 2 = 1 AND x % 2 = 1) AS b FROM g0 GROUP BY 1, 2, 3), "
image("affine_bayer_grey", lambda g: colour.affine_bayer_to_grey(g, _TURN, 40, 48, _AT), _BAYER + _steps(tuple(m / 2 for m in _TURN), 40, 48, _AT) + _GREY)
image("scale_bayer_grey", lambda g: colour.affine_bayer_to_grey(g, _DOWN, 28, 40), _BAYER + _steps(tuple(m / 2 for m in _DOWN), 28, 40) + _GREY)
image("scale_bayer_crop", lambda g: colour.affine_bayer_to_grey(g, _DOWN, 28, 40, smooth=False), _BAYER + _steps(tuple(m / 2 for m in _DOWN), 28, 40) + " SELECT o.img_id, o.y, o.x, CAST(CASE WHEN ok THEN (n.r + n.g + n.b) // 3 ELSE 0 END AS INTEGER) AS v FROM z o LEFT JOIN g n ON n.img_id = o.img_id AND n.y = y0 AND n.x = x0")
image("crop_placed", lambda g: colour.crop(g, -4, 50, 20, 30, 24, 32, 3, 5), "WITH g AS ({t}) SELECT i.img_id, y, x, coalesce(n.v, 0) AS v FROM (SELECT DISTINCT img_id FROM g) i, (SELECT CAST(unnest(range(24)) AS INTEGER) AS y), (SELECT CAST(unnest(range(32)) AS INTEGER) AS x) LEFT JOIN (SELECT img_id, y + 3 AS cy, x - 45 AS cx, v FROM g WHERE y < 16 AND x >= 50) n ON n.img_id = i.img_id AND n.cy = y AND n.cx = x")
image("rotate_left", lambda g: g.select("img_id", (F.max("x").over(Window.partitionBy("img_id")) - F.col("x")).alias("y"), F.col("y").alias("x"), "v"), "SELECT img_id, CAST(63 - x AS INTEGER) AS y, y AS x, v FROM ({t})")

# --- polar sheets
_INNER, _OUTER = (30, 33, 9), (31, 31, 28)
_RAYS = "WITH g AS ({t}), s AS (SELECT *, 2.0::DOUBLE * 3.141592653589 / 48 * a + 3.141592653589 / 2 AS f FROM (SELECT DISTINCT img_id FROM g), (SELECT CAST(unnest(range(48)) AS INTEGER) AS a), (SELECT CAST(unnest(range(16)) AS INTEGER) AS i)), e AS (SELECT *, cos(f) * 9 + 30 AS x1, -sin(f) * 9 * 0.94 + 33 AS y1, cos(f) * 28 + 31 AS x2, -sin(f) * 28 * 0.95 + 31 AS y2 FROM s)"
_SHEET = _RAYS + ", p AS (SELECT *, CAST(trunc((x1 * (16 - i) + x2 * i) / 16 + 0.5) AS INTEGER) AS px, CAST(trunc((y1 * (16 - i) + y2 * i) / 16 + 0.5) AS INTEGER) AS py FROM e), r AS (SELECT p.img_id, a, i, coalesce(last_value(g.v IGNORE NULLS) OVER (PARTITION BY p.img_id ORDER BY a, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v FROM p LEFT JOIN g ON g.img_id = p.img_id AND g.y = py AND g.x = px AND py BETWEEN 1 AND 62 AND px BETWEEN 1 AND 62)"
image("rubber_sheet", lambda g: polar.rubber(g, _INNER, _OUTER, 48, 16), _SHEET + " SELECT img_id, a AS y, i AS x, v FROM r")
image("rubber_upright", lambda g: polar.rubber(g, _INNER, _OUTER, 48, 16, True), _SHEET + " SELECT img_id, i AS y, a AS x, v FROM r")
image("rubber_lines", lambda g: polar.rubber_lines(g, _INNER, _OUTER, 48, 16), _SHEET.split(", r AS")[0] + " SELECT g.img_id, g.y, g.x, CASE WHEN m.px IS NULL THEN g.v ELSE 255 END AS v FROM g LEFT JOIN (SELECT DISTINCT img_id, py, px FROM p WHERE i % 4 = 0 AND py BETWEEN 1 AND 62 AND px BETWEEN 1 AND 62) m ON m.img_id = g.img_id AND m.py = g.y AND m.px = g.x")
_BILINEAR = ", b AS (SELECT *, CAST(floor(px) AS INTEGER) AS x0, CAST(floor(py) AS INTEGER) AS y0 FROM p), c AS (SELECT b.img_id, a, i, floor(round(sum(g.v * CASE WHEN g.x = x0 THEN 1 - (px - x0) ELSE px - x0 END * CASE WHEN g.y = y0 THEN 1 - (py - y0) ELSE py - y0 END), 6) + 0.5) AS v FROM b JOIN g ON g.img_id = b.img_id AND g.y BETWEEN y0 AND y0 + 1 AND g.x BETWEEN x0 AND x0 + 1 WHERE px >= 1 AND px < 63 AND py >= 1 AND py < 63 GROUP BY 1, 2, 3) SELECT p.img_id, p.a AS y, p.i AS x, CAST(coalesce(last_value(c.v IGNORE NULLS) OVER (PARTITION BY p.img_id ORDER BY p.a, p.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS v FROM p LEFT JOIN c ON c.img_id = p.img_id AND c.a = p.a AND c.i = p.i"
image("rubber_power", lambda g: polar.rubber_power(g, _INNER, _OUTER, 48, 16, 1.4), _RAYS + ", p AS (SELECT *, x1 * (1 - pow(i / 16.0::DOUBLE, 1.4)) + x2 * pow(i / 16.0::DOUBLE, 1.4) AS px, y1 * (1 - pow(i / 16.0::DOUBLE, 1.4)) + y2 * pow(i / 16.0::DOUBLE, 1.4) AS py FROM e)" + _BILINEAR)
image("rubber_stretched", lambda g: polar.rubber_stretched(g, _INNER, _OUTER, 48, 16, 0.5), _RAYS + """, u AS (SELECT *, (0.5 - 9 / 28::DOUBLE) * (9 / 28::DOUBLE) / (1 - 9 / 28::DOUBLE) AS ss FROM e), w AS (SELECT *, 0.5 + 0.5 * pow(i / 16::DOUBLE, 1.5) + ss AS d FROM u), o AS (SELECT *, (d + sqrt(d * d - 4 * ss)) / 2 AS ro FROM w),
p AS (SELECT *, 30 - (9 * cos(f) + (ro * 28 - 9) * (cos(f) + (30 - 31) / 19::DOUBLE)) AS px, 33 - (9 * sin(f) + (ro * 28 - 9) * (sin(f) * (28 * 0.95 - 9) / 19::DOUBLE + (33 - 31) / 19::DOUBLE)) AS py FROM o)""" + _BILINEAR)
image("polar_between", lambda g: polar.unwrapped_between(g, _INNER, _OUTER, 40, 12), """WITH g AS ({t}), s AS (SELECT *, a * 2 * pi() / 40 AS f FROM (SELECT DISTINCT img_id FROM g), (SELECT CAST(unnest(range(40)) AS INTEGER) AS a), (SELECT CAST(unnest(range(12)) AS INTEGER) AS i)),
e AS (SELECT *, 30 + 9 * cos(f) AS bx, 33 + 9 * sin(f) AS y1, -sin(f) - 2 * cos(f) AS k FROM s), p AS (SELECT *, bx + (31 + k * sin(f) + sqrt(784 - k) * cos(f) - bx) / 12 * (i + 0.5) AS px, y1 + (31 + k * cos(f) + sqrt(784 - k) * sin(f) - y1) / 12 * (i + 0.5) AS py FROM e), b AS (SELECT *, CAST(floor(px) AS INTEGER) AS x0, CAST(floor(py) AS INTEGER) AS y0 FROM p),
c AS (SELECT b.img_id, a, i, floor(round(sum(g.v * CASE WHEN g.x = x0 THEN 1 - (px - x0) ELSE px - x0 END * CASE WHEN g.y = y0 THEN 1 - (py - y0) ELSE py - y0 END), 6)) AS v FROM b JOIN g ON g.img_id = b.img_id AND g.y BETWEEN y0 AND y0 + 1 AND g.x BETWEEN x0 AND x0 + 1 WHERE px >= 0 AND px < 63 AND py >= 0 AND py < 63 GROUP BY 1, 2, 3)
SELECT p.img_id, CAST(11 - p.i AS INTEGER) AS y, p.a AS x, CAST(coalesce(c.v, 0) AS INTEGER) AS v FROM p LEFT JOIN c ON c.img_id = p.img_id AND c.a = p.a AND c.i = p.i""")
image("polar_fixed", lambda g: polar.unwrapped_fixed(g, (31, 30), (5, 40), (0.25, 5.5), 36, 20, 7), None)

# --- ranks
_MID = "list_sort(list(n.v))[8]"
image("median_box", lambda g: ranks.median(g, 2, 1), near(_MID, square(2, 1), 2, 1))
image("to_extreme", lambda g: ranks.to_extreme(g, 2, 1), near(f"CASE WHEN {_MID} > (min(n.v) + max(n.v)) // 2 THEN max(n.v) WHEN {_MID} < (min(n.v) + max(n.v)) // 2 THEN min(n.v) ELSE (min(n.v) + max(n.v)) // 2 END", square(2, 1), 2, 1))
image("line_median", lambda g: ranks.line_median(g, 30, 3), "WITH g AS ({t}), k AS (SELECT CAST(unnest(range(-3, 4)) AS INTEGER) AS d) SELECT o.img_id, o.x, list_sort(list(n.v))[25] AS v FROM (SELECT img_id, x FROM g WHERE y = 30) o CROSS JOIN k JOIN g n ON n.img_id = o.img_id AND n.x = least(63, greatest(0, o.x + d)) AND n.y BETWEEN 27 AND 33 GROUP BY 1, 2")
add("seq_circular_median", "sig", lambda s: ranks.circular_median(s, 5, "user_id"), "WITH sig AS ({t}), m AS (SELECT user_id, max(i) + 1 AS e FROM sig GROUP BY 1) SELECT o.user_id, o.i, list_sort(list(n.v))[3] AS v FROM sig o JOIN m USING (user_id) CROSS JOIN (SELECT unnest(range(-2, 3)) AS d) JOIN sig n ON n.user_id = o.user_id AND n.i = (o.i + d + 5 * e) % e GROUP BY 1, 2 HAVING count(*) = 5 OR max(e) < 5")
_MEDIAN_OF = "(SELECT user_id, min({v}) AS {out} FROM (SELECT user_id, {v}, row_number() OVER (PARTITION BY user_id ORDER BY {v}) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM {src}) WHERE r >= ((n // 2) | 1) GROUP BY 1)"
add("seq_spread", "sig", lambda s: ranks.spread(s, "user_id"), "WITH sig AS ({t}), m AS " + _MEDIAN_OF.format(v="v", out="med", src="sig") + ", a AS (SELECT user_id, abs(v - med) AS d FROM sig JOIN m USING (user_id)), w AS " + _MEDIAN_OF.format(v="d", out="mad", src="a") + ", z AS (SELECT user_id, count(*) AS n, max(d) AS top FROM a GROUP BY 1) SELECT user_id, CAST(((n - ((n // 2) | 1)) * (top - mad) * (mad + 1)) // (2 * ((n // 2) | 1)) AS BIGINT) AS spread FROM z JOIN w USING (user_id) WHERE n > 1")
add("seq_masked_median", "sig", lambda s: ranks.masked_median(s.withColumn("w", F.col("v") * 11 + F.col("i")), "user_id", "w"), "WITH sig AS (SELECT user_id, CAST((v * 11 + i) & 511 AS INTEGER) AS b FROM ({t})) SELECT * FROM " + _MEDIAN_OF.format(v="b", out="median", src="sig"))
add("seq_positive_mean", "sig", lambda s: ranks.positive_mean(s.withColumn("v", F.col("v") - 40), "user_id"), "WITH s AS (SELECT user_id, CASE WHEN v > 40 THEN CAST(v - 40 AS BIGINT) END AS v FROM ({t})), a AS (SELECT user_id, count(v) AS n, coalesce(sum(v), 0) AS m, coalesce(sum(v * v), 0) AS q FROM s GROUP BY 1) SELECT user_id, CAST(CASE WHEN n > 0 THEN (m + n // 2) // n ELSE 0 END AS INTEGER) AS mean, round(CASE WHEN n > 0 THEN sqrt(CAST(n * q - m * m AS DOUBLE)) / n ELSE 1000 END, 5) AS deviation FROM a")
for _name, _falling in (("chess_rising", False), ("chess_falling", True)):
    _d, _l = (("b", "c"), ("a", "d")) if _falling else (("a", "d"), ("b", "c"))
    _least = "least(" + ", ".join(f"{p}.e - {q}.d" for p in _d for q in _l) + ")"
    _most = "greatest(abs(a.e - d.d), abs(d.e - a.d), abs(b.e - c.d), abs(c.e - b.d))"
    image(_name, lambda g, f=_falling: ranks.chess_crosses(g, g.withColumn("v", F.least(F.lit(255), F.col("v") + 9)), 2, f), f"""WITH g AS (SELECT img_id, y, x, v AS e, least(255, v + 9) AS d FROM ({{t}})) SELECT o.img_id, o.y, o.x, CAST(coalesce(greatest(0, {_least} - {_most}), 0) AS INTEGER) AS v FROM g o
  LEFT JOIN g a ON a.img_id = o.img_id AND a.y = o.y - 2 AND a.x = o.x - 2 LEFT JOIN g b ON b.img_id = o.img_id AND b.y = o.y - 2 AND b.x = o.x + 2 LEFT JOIN g c ON c.img_id = o.img_id AND c.y = o.y + 2 AND c.x = o.x - 2 LEFT JOIN g d ON d.img_id = o.img_id AND d.y = o.y + 2 AND d.x = o.x + 2""")
_K5 = "k(d, wt) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))"
_BACK = "CASE WHEN {c} + d < 0 THEN -1 - ({c} + d) WHEN {c} + d > 63 THEN 127 - ({c} + d) ELSE {c} + d END"
_SM = f"WITH grid AS ({{t}}), {_K5}, sx AS (SELECT o.img_id, o.y, o.x, CAST(sum(wt * n.v) AS INTEGER) AS v FROM grid o CROSS JOIN k JOIN grid n ON n.img_id = o.img_id AND n.y = o.y AND n.x = {_BACK.format(c='o.x')} GROUP BY 1, 2, 3), sm AS (SELECT o.img_id, o.y, o.x, CAST(sum(wt * n.v) // 4 AS INTEGER) AS v FROM sx o CROSS JOIN k JOIN sx n ON n.img_id = o.img_id AND n.x = o.x AND n.y = {_BACK.format(c='o.y')} GROUP BY 1, 2, 3)"
image("smooth_x", lambda g: ranks.smoothed(g, False), _SM + " SELECT * FROM sx")
image("smooth_xy", ranks.smoothed_twice, _SM + " SELECT * FROM sm")
image("edge_slopes", lambda g: ranks.slopes(ranks.smoothed_twice(g), 192), _SM + """, d AS (SELECT o.img_id, o.y, o.x, r.v - l.v AS gx, b.v - a.v AS gy FROM sm o JOIN sm l ON l.img_id = o.img_id AND l.y = o.y AND l.x = greatest(0, o.x - 1) JOIN sm r ON r.img_id = o.img_id AND r.y = o.y AND r.x = least(63, o.x + 1)
  JOIN sm a ON a.img_id = o.img_id AND a.x = o.x AND a.y = greatest(0, o.y - 1) JOIN sm b ON b.img_id = o.img_id AND b.x = o.x AND b.y = least(63, o.y + 1)), e AS (SELECT *, CAST(abs(gx) + abs(gy) + CASE WHEN abs(gx) > 2 * abs(gy) THEN abs(gx) // 3 WHEN abs(gy) > 2 * abs(gx) THEN abs(gy) // 3 ELSE 0 END AS INTEGER) AS len FROM d)
SELECT img_id, y, x, gx, gy, len, CASE WHEN len < 192 THEN 0 WHEN abs(gx) > abs(gy) THEN 127 ELSE -127 END AS dir FROM e""")

# --- regions
_ROI = "WITH r AS (SELECT rec_id, px - pr AS x, py - pr AS y, 2 * pr AS w, 2 * pr AS h FROM ({t})), e AS (SELECT rec_id, x - 12 AS l, y - 7 AS t, x + w + 12 AS r, y + h + 7 AS b FROM r) SELECT rec_id, "
_MEET = "CASE WHEN l < 400 AND t < 290 AND r > 100 AND b > 90 THEN {} ELSE 0 END AS {}"
add("expand_roi", "markup", lambda m: regions.expanded(m.select("rec_id", (F.col("px") - F.col("pr")).alias("x"), (F.col("py") - F.col("pr")).alias("y"), (2 * F.col("pr")).alias("w"), (2 * F.col("pr")).alias("h")), 12, 7, (100, 90, 300, 200)), _ROI + ", ".join(_MEET.format(v, n) for v, n in (("greatest(l, 100)", "x"), ("greatest(t, 90)", "y"), ("least(r, 400) - greatest(l, 100)", "w"), ("least(b, 290) - greatest(t, 90)", "h"))) + " FROM e")
_CIRCLE = """WITH RECURSIVE g AS ({t}), arc(x, y, e) AS (SELECT {r}, 0, 3 - 2 * {r} UNION ALL SELECT CASE WHEN e < 0 THEN x ELSE x - 1 END, y + 1, CASE WHEN e < 0 THEN e + 4 * y + 6 ELSE e + 4 * (y - x) + 10 END FROM arc WHERE y + 1 <= CASE WHEN e < 0 THEN x ELSE x - 1 END),
rows AS (SELECT dy, max(half) AS half FROM (SELECT y AS dy, x AS half FROM arc UNION ALL SELECT x, y FROM arc) GROUP BY 1)"""
image("fill_disc", lambda g: regions.painted(g, regions.in_disc(30, 33, 17, (20, 18, 40, 30)), 7), _CIRCLE.replace("{r}", "17") + " SELECT img_id, y, g.x, CASE WHEN half IS NOT NULL AND abs(g.x - 33) <= half AND g.x BETWEEN 20 AND 60 AND y BETWEEN 18 AND 47 THEN 7 ELSE v END AS v FROM g LEFT JOIN rows ON rows.dy = abs(g.y - 30)")
_RING = """WITH RECURSIVE g AS ({t}), arc(x, y, e) AS (SELECT 20, 0, -37 UNION ALL SELECT CASE WHEN e < 0 THEN x ELSE x - 1 END, y + 1, CASE WHEN e < 0 THEN e + 4 * y + 6 ELSE e + 4 * (y - x) + 10 END FROM arc WHERE y + 1 <= CASE WHEN e < 0 THEN x ELSE x - 1 END),
inn(x, y, e) AS (SELECT 9, 0, -15 UNION ALL SELECT CASE WHEN e < 0 THEN x ELSE x - 1 END, y + 1, CASE WHEN e < 0 THEN e + 4 * y + 6 ELSE e + 4 * (y - x) + 10 END FROM inn WHERE y + 1 <= CASE WHEN e < 0 THEN x ELSE x - 1 END),
rows AS (SELECT a.y AS dy, a.x AS far, greatest(a.y, coalesce(i.x, a.y)) AS nr FROM arc a LEFT JOIN inn i ON i.y = a.y),
ring AS (SELECT g.*, nr IS NOT NULL AND abs(g.x - 33) BETWEEN nr AND far AS inside FROM g LEFT JOIN rows ON rows.dy = abs(g.y - 30))"""
image("fill_half_ring", lambda g: regions.painted(g, regions.in_half_ring(30, 33, 9, 20, (0, 0, 64, 64)), 7), _RING + " SELECT img_id, y, x, CASE WHEN inside THEN 7 ELSE v END AS v FROM ring")
_RIDGE = """n AS (SELECT o.img_id, o.y, o.x, o.v, k.d, count(n.v) AS k, bool_and(o.v > n.v) AS over FROM g o CROSS JOIN (VALUES (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, -1)) k(d, dy, dx) LEFT JOIN g n ON n.img_id = o.img_id AND ((n.y = o.y + dy AND n.x = o.x + dx) OR (n.y = o.y - dy AND n.x = o.x - dx)) GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT img_id, y, x, v, bool_or(k > 0 AND over) AS ridge FROM n GROUP BY 1, 2, 3, 4)"""
image("ridge_mass", regions.ridge_mass, "WITH g AS ({t}), " + _RIDGE + " SELECT img_id, CAST(sum(CASE WHEN ridge AND v <> 0 THEN v ELSE 0 END) AS BIGINT) AS ridge, CAST(sum(v) AS BIGINT) AS mass FROM m GROUP BY 1")
image("ridge_mass_ring", lambda g: regions.ridge_mass(g, regions.in_half_ring(30, 33, 9, 20, (1, 1, 62, 62))), _RING + ", " + _RIDGE + " SELECT m.img_id, CAST(sum(CASE WHEN ridge AND m.v <> 0 THEN m.v ELSE 0 END) AS BIGINT) AS ridge, CAST(sum(m.v) AS BIGINT) AS mass FROM m JOIN ring USING (img_id, y, x) WHERE inside GROUP BY 1")
_EDGED = "WITH g AS ({t}), k(dy, dx, a, b) AS (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)), s AS (SELECT o.img_id, o.y, o.x, sum(a * n.v) AS gx, sum(b * n.v) AS gy FROM g o CROSS JOIN k JOIN g n ON n.img_id = o.img_id AND n.y = least(63, greatest(0, o.y + dy)) AND n.x = least(63, greatest(0, o.x + dx)) GROUP BY 1, 2, 3)"
image("sobel_whole", regions.sobel_whole, _EDGED + " SELECT img_id, y, x, CAST(least(255, floor(sqrt(CAST(gx * gx + gy * gy AS DOUBLE)))) AS INTEGER) AS v FROM s")
image("sobel_whole_wide", lambda g: regions.sobel_whole(g, None), _EDGED + " SELECT img_id, y, x, CAST(floor(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS INTEGER) AS v FROM s")
add("draw_lines", "markup", lambda m: regions.line_pixels(m.select("rec_id", (F.col("px") % 60).alias("x0"), (F.col("py") % 50).alias("y0"), (F.col("ix") % 71).alias("x1"), (F.col("iy") % 67).alias("y1")), "rec_id", 64, 64), """WITH l AS (SELECT rec_id, px % 60 AS x0, py % 50 AS y0, ix % 71 AS x1, iy % 67 AS y1 FROM ({t})), d AS (SELECT *, sqrt(CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE)) AS len FROM l),
s AS (SELECT *, unnest(range(CAST(floor(len + 0.5) AS BIGINT))) AS k FROM d WHERE floor(len + 0.5) > 0), p AS (SELECT DISTINCT rec_id, CAST(floor(y0 + k * CAST(y1 - y0 AS DOUBLE) / len + 0.5) AS INTEGER) AS y, CAST(floor(x0 + k * CAST(x1 - x0 AS DOUBLE) / len + 0.5) AS INTEGER) AS x FROM s) SELECT * FROM p WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63""")


def _radii(spark: SparkSession, sf_dir: str, more: int = 0) -> DataFrame:
    sets = view(spark, sf_dir, "points").select("set_id").distinct()
    return sets.select("set_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i")).withColumn("r", (F.lit(12 - more) + (F.col("set_id") + 3 * F.col("i")) % 7).cast("int"))


QUERIES["contour_mask"] = lambda spark, sf_dir: regions.contour_mask(_radii(spark, sf_dir), 40, 9, 64, 64)
QUERIES["ring_mask"] = lambda spark, sf_dir: regions.ring_mask(_radii(spark, sf_dir), _radii(spark, sf_dir, 8), (40, 9), (39, 10), 64, 64)
image("stretch_roi", lambda g: regions.stretched(g, (-6, 20, 40, 30), 36, 50), """WITH g AS ({t}), o AS (SELECT img_id, y, x, CASE WHEN x >= 7 THEN CASE WHEN x = 49 THEN (256 * (x - 7) * 39 // 50) // 256 * 256 ELSE 256 * (x - 7) * 39 // 50 END END AS px, CASE WHEN y = 35 THEN (256 * y * 29 // 36) // 256 * 256 ELSE 256 * y * 29 // 36 END AS py
  FROM (SELECT DISTINCT img_id FROM g), (SELECT CAST(unnest(range(36)) AS INTEGER) AS y), (SELECT CAST(unnest(range(50)) AS INTEGER) AS x))
SELECT o.img_id, o.y, o.x, CAST(coalesce(sum(g.v * CASE WHEN g.x = px // 256 THEN 256 - px % 256 ELSE px % 256 END * CASE WHEN g.y = 20 + py // 256 THEN 256 - py % 256 ELSE py % 256 END) // 65536, 0) AS INTEGER) AS v
FROM o LEFT JOIN g ON g.img_id = o.img_id AND g.x BETWEEN px // 256 AND px // 256 + 1 AND g.y BETWEEN 20 + py // 256 AND 21 + py // 256 GROUP BY 1, 2, 3""")

# --- matrices made of vectors: a label's first vectors are rows
_MAT = "SELECT label AS mat_id, CAST(r - 1 AS INTEGER) AS i, i AS j, e AS a FROM (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM ({t})) WHERE r <= 6 AND i < 6"


def _matrix(v: DataFrame) -> DataFrame:
    ranked = v.withColumn("r", F.dense_rank().over(Window.partitionBy("label").orderBy("vec_id")))
    return ranked.filter("r <= 6 and i < 6").select(F.col("label").alias("mat_id"), (F.col("r") - 1).cast("int").alias("i"), F.col("i").alias("j"), F.col("e").alias("a"))


_rounded = lambda m: m.select("mat_id", "i", "j", F.round("a", 6).alias("a"))
for _name, _ta, _tb, _on in (("matmul_ab", False, False, "p.j = q.i"), ("matmul_atb", True, False, "p.i = q.i"), ("matmul_atbt", True, True, "p.i = q.j")):
    add(_name, "vec", lambda v, a=_ta, b=_tb: _rounded(linear.product(_matrix(v), _matrix(v), a, b)), f"WITH m AS ({_MAT}) SELECT p.mat_id, {'p.j' if _ta else 'p.i'} AS i, {'q.i' if _tb else 'q.j'} AS j, round(sum(p.a * q.a), 6) AS a FROM m p JOIN m q ON p.mat_id = q.mat_id AND {_on} GROUP BY 1, 2, 3")
_SYM = lambda v: linear.product(_matrix(v), _matrix(v), False, True)
_ONE = lambda v: _matrix(v).filter("j = 0").withColumn("j", F.lit(0))
# Solutions, axes and values are held against numpy by the tests; what SQL can state of them is registered: A X = B again, and the errors of exact pairs.
add("linear_solve", "vec", lambda v: _rounded(linear.product(_matrix(v), linear.solved(_matrix(v), _ONE(v)))), f"WITH m AS ({_MAT}) SELECT mat_id, i, j, round(a, 6) AS a FROM m WHERE j = 0")
add("symmetric_solve", "vec", lambda v: _rounded(linear.product(_SYM(v), linear.solved(_SYM(v), _ONE(v)))), f"WITH m AS ({_MAT}) SELECT mat_id, i, j, round(a, 6) AS a FROM m WHERE j = 0")
add("unit_errors", "vec", lambda v: linear.unit_errors(_matrix(v)), f"WITH m AS ({_MAT}), e AS (SELECT p.mat_id, p.i, q.i AS j, abs(sum(p.a * q.a) - CASE WHEN p.i = q.i THEN 1 ELSE 0 END) AS e FROM m p JOIN m q ON p.mat_id = q.mat_id AND p.j = q.j GROUP BY 1, 2, 3) SELECT mat_id, round(max(e) FILTER (i = j), 9) AS max_diag, round(max(e) FILTER (i <> j), 9) AS max_off, round(avg(e) FILTER (i = j), 9) AS avg_diag, round(avg(e) FILTER (i <> j), 9) AS avg_off FROM e GROUP BY 1")
add("unit_errors_general", "vec", lambda v: linear.unit_errors(_matrix(v), _SYM(v)), f"WITH m AS ({_MAT}), s AS (SELECT p.mat_id, p.i, q.i AS j, sum(p.a * q.a) AS a FROM m p JOIN m q ON p.mat_id = q.mat_id AND p.j = q.j GROUP BY 1, 2, 3), h AS (SELECT m.mat_id, m.i, s.j, sum(m.a * s.a) AS a FROM m JOIN s ON s.mat_id = m.mat_id AND s.i = m.j GROUP BY 1, 2, 3), e AS (SELECT h.mat_id, h.i, m.i AS j, abs(sum(h.a * m.a) - CASE WHEN h.i = m.i THEN 1 ELSE 0 END) AS e FROM h JOIN m ON m.mat_id = h.mat_id AND m.j = h.j GROUP BY 1, 2, 3) SELECT mat_id, round(max(e) FILTER (i = j), 9) AS max_diag, round(max(e) FILTER (i <> j), 9) AS max_off, round(avg(e) FILTER (i = j), 9) AS avg_diag, round(avg(e) FILTER (i <> j), 9) AS avg_off FROM e GROUP BY 1")
_UNIT = lambda v: _matrix(v).select("mat_id", "i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0).alias("a"))
add("eigen_symmetric", "vec", lambda v: linear.eigen_errors(_SYM(v), linear.eigen_symmetric(_SYM(v), _UNIT(v)).filter("value > 1e-3")).withColumn("error", F.round("error", 4)), f"WITH m AS ({_MAT}) SELECT DISTINCT mat_id, CAST(0 AS DOUBLE) AS error FROM m")
add("eigen_general", "vec", lambda v: linear.eigen_general(_matrix(v), _UNIT(v)).groupBy("mat_id").agg(F.round(F.sum("re"), 4).alias("trace")), f"WITH m AS ({_MAT}) SELECT mat_id, round(sum(a), 4) AS trace FROM m WHERE i = j GROUP BY 1")
add("discriminants", "vec", lambda v: linear.discriminants(v, 64, 4), None)

# --- glints and segmentation
image("glint_mask", glints.glint_mask, None, "disc")
image("without_glints", glints.without_glints, None, "disc")
image("segmentation", lambda g: segmentation.segmented(g, least=5, margin=4), None, "disc")
_WIDE = "WITH g AS ({t}), w(d, wt) AS (VALUES (-10, 1), (-9, 1), (-8, 2), (-7, 2), (-6, 4), (-5, 5), (-4, 7), (-3, 8), (-2, 10), (-1, 11), (0, 11), (1, 11), (2, 10), (3, 8), (4, 7), (5, 5), (6, 4), (7, 2), (8, 2), (9, 1), (10, 1)), ax AS (SELECT o.img_id, o.y, o.x, sum(wt * n.v) AS v FROM g o CROSS JOIN w JOIN g n ON n.img_id = o.img_id AND n.y = o.y AND n.x = {x} GROUP BY 1, 2, 3), ay AS (SELECT o.img_id, o.y, o.x, sum(wt * n.v) AS v FROM g o CROSS JOIN w JOIN g n ON n.img_id = o.img_id AND n.x = o.x AND n.y = {y} GROUP BY 1, 2, 3), s AS (SELECT o.img_id, o.y, o.x, CAST(l.v - r.v AS INTEGER) AS gx, CAST(a.v - b.v AS INTEGER) AS gy FROM g o JOIN ax a ON a.img_id = o.img_id AND a.x = o.x AND a.y = abs(o.y - 10) JOIN ax b ON b.img_id = o.img_id AND b.x = o.x AND b.y = 63 - abs(53 - o.y) JOIN ay l ON l.img_id = o.img_id AND l.y = o.y AND l.x = abs(o.x - 10) JOIN ay r ON r.img_id = o.img_id AND r.y = o.y AND r.x = 63 - abs(53 - o.x)), m AS (SELECT *, CAST(floor(sqrt(CAST(CAST(gx AS BIGINT) * gx + CAST(gy AS BIGINT) * gy AS DOUBLE))) AS INTEGER) AS mag FROM s)".replace("{x}", "63 - abs(63 - abs(o.x + d))").replace("{y}", "63 - abs(63 - abs(o.y + d))")
image("sobel_21", segmentation.sobel_wide, _WIDE + " SELECT * FROM m")
image("sobel_21_selected", lambda g: segmentation.selected(segmentation.sobel_wide(g)), _WIDE + ", k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY mag) AS k, count(*) OVER (PARTITION BY img_id) AS n FROM m), l AS (SELECT img_id, max(mag) FILTER (k = 3 * n // 4 + 2) AS lo, max(mag) FILTER (k = 99 * n // 100 + 2) AS hi FROM k GROUP BY 1) SELECT img_id, y, x, CASE WHEN mag BETWEEN lo AND hi THEN gx ELSE 0 END AS gx, CASE WHEN mag BETWEEN lo AND hi THEN gy ELSE 0 END AS gy, CASE WHEN mag BETWEEN lo AND hi THEN mag ELSE 0 END AS mag FROM m JOIN l USING (img_id)")
image("sobel_21_scaled", lambda g: segmentation.scaled(segmentation.sobel_wide(g)), _WIDE + " SELECT img_id, y, x, CAST(floor(CAST(mag AS DOUBLE) / max(mag) OVER (PARTITION BY img_id) * 255) AS INTEGER) AS v FROM m")
image("segmentation_levels", lambda g: segmentation.levels(g).select("img_id", *(F.round(c, 9).alias(c) for c in ("sigma", "low", "high"))), "WITH g AS ({t}), s AS (SELECT img_id, CAST(list_sort(list(v))[2049] AS DOUBLE) / max(v) AS t FROM g GROUP BY 1) SELECT img_id, round(least(4.5, 2 + 2.5 * t), 9) AS sigma, round(greatest(0.55, 0.8 * t), 9) AS low, round(least(0.8, 1.33 * t), 9) AS high FROM s", "disc")

# --- fits, held against numpy and drawn curves by the tests
add("ellipse_fit", "points", fits.ellipses, None)
add("ellipse_fit_constrained", "points", lambda p: fits.ellipses(p, fit=fits.constrained), None)
add("circle_fit_geometric", "points", fits.geometric_circle, None)

# --- side projections
_SIDE = """, o AS (SELECT img_id, y, x, gx, gy, y - 33 AS i, x - 30 AS j FROM gr {mask}), w AS (SELECT * FROM o WHERE abs(i) <= 24 AND abs(j) <= floor(sqrt(CAST(576 - i * i AS DOUBLE))) AND abs(j) >= CASE WHEN abs(i) < 7 THEN greatest(abs(i), floor(sqrt(CAST(49 - i * i AS DOUBLE)))) ELSE abs(i) END),
d AS (SELECT *, side, CAST(floor(sqrt(CAST(i * i + j * j AS DOUBLE))) AS INTEGER) AS r, gx * j + gy * i AS s, gx * gx + gy * gy AS g FROM w JOIN (VALUES ('left', -1), ('right', 1)) t(side, sg) ON j * sg >= 0),
c AS (SELECT img_id, side, r, count(*) AS a, count(*) FILTER ((CASE WHEN side = 'left' THEN -gx ELSE gx END) > {lx} AND g > {lg} AND s > 0 AND CAST(s AS BIGINT) * {under} * s > CAST(i * i + j * j AS BIGINT) * g * {over}) AS h FROM d GROUP BY 1, 2, 3),
q AS (SELECT m.img_id, z.side, CAST(k.r AS INTEGER) AS r, coalesce(c.a, 0) AS a, coalesce(c.h, 0) AS h FROM (SELECT DISTINCT img_id FROM grid) m CROSS JOIN (VALUES ('left'), ('right')) z(side) CROSS JOIN (SELECT unnest(range(25)) AS r) k LEFT JOIN c ON c.img_id = m.img_id AND c.side = z.side AND c.r = greatest(7, k.r)),
n AS (SELECT *, CASE WHEN a > 0 THEN 1024 * h // a ELSE 0 END AS n FROM q), b AS (SELECT o.img_id, o.side, o.r, sum(p.a) AS a, sum(p.n) AS n FROM n o CROSS JOIN (SELECT unnest(range(-4, 5)) AS d) JOIN n p ON p.img_id = o.img_id AND p.side = o.side AND p.r = least(24, greatest(0, o.r + d)) GROUP BY 1, 2, 3),
e AS (SELECT img_id, side, r, CASE WHEN r > 0 AND 10000 * a // (1413 * greatest(1, r)) < 20 THEN 0 ELSE n END AS n FROM b) SELECT x.img_id, x.side, x.r, CAST(y.n AS BIGINT) AS n FROM e x JOIN e y ON y.img_id = x.img_id AND y.side = x.side AND y.r = greatest(1, x.r)"""
_SOBELS = "WITH grid AS ({t}), k(dy, dx, a, b) AS (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)), gr AS (SELECT o.img_id, o.y, o.x, o.v, CAST(sum(a * n.v) AS INTEGER) AS gx, CAST(sum(b * n.v) AS INTEGER) AS gy FROM grid o CROSS JOIN k JOIN grid n ON n.img_id = o.img_id AND n.y = o.y + dy AND n.x = o.x + dx GROUP BY 1, 2, 3, 4 HAVING count(*) = 8)"
_CENTRAL = _SMOOTHED + ", gr AS (SELECT o.img_id, o.y, o.x, CAST(trunc(CAST(6 * (r.v - l.v) AS DOUBLE) / 5) AS INTEGER) AS gx, b.v - a.v AS gy FROM grid o JOIN grid l ON l.img_id = o.img_id AND l.y = o.y AND l.x = o.x - 1 JOIN grid r ON r.img_id = o.img_id AND r.y = o.y AND r.x = o.x + 1 JOIN grid a ON a.img_id = o.img_id AND a.x = o.x AND a.y = o.y - 1 JOIN grid b ON b.img_id = o.img_id AND b.x = o.x AND b.y = o.y + 1)"
for _name, _kind, _pre, _lx, _lg, _over, _under in (("side_projection", "plain", _SOBELS, 6, 128, 1, 2), ("side_projection_fine", "fine", _SOBELS, 4, 72, 1, 2), ("side_projection_smooth", "smooth", _CENTRAL, 2, 144, 3, 4)):
    image(_name, lambda g, k=_kind: edges.side_projections(g, 33, 30, 7, 24, k), _pre + _SIDE.replace("{mask}", "").replace("{lx}", str(_lx)).replace("{lg}", str(_lg)).replace("{over}", str(_over)).replace("{under}", str(_under)), "disc")
image("side_projection_masked", lambda g: edges.side_projections(g.withColumn("m", F.when(F.col("v") % 4 == 0, 255).otherwise(0)), 33, 30, 7, 24), _SOBELS + _SIDE.replace("{mask}", "WHERE v % 4 <> 0").replace("{lx}", "6").replace("{lg}", "128").replace("{over}", "1").replace("{under}", "2"), "disc")

# --- anchors, blocks at a place, timed frames
_SLOPES = _SM + """, d AS (SELECT o.img_id, o.y, o.x, abs(r.v - l.v) AS gx, abs(b.v - a.v) AS gy FROM sm o JOIN sm l ON l.img_id = o.img_id AND l.y = o.y AND l.x = greatest(0, o.x - 1) JOIN sm r ON r.img_id = o.img_id AND r.y = o.y AND r.x = least(63, o.x + 1)
  JOIN sm a ON a.img_id = o.img_id AND a.x = o.x AND a.y = greatest(0, o.y - 1) JOIN sm b ON b.img_id = o.img_id AND b.x = o.x AND b.y = least(63, o.y + 1)), e AS (SELECT *, CAST(gx + gy + CASE WHEN gx > 2 * gy THEN gx // 3 WHEN gy > 2 * gx THEN gy // 3 ELSE 0 END AS INTEGER) AS len FROM d)"""
image("edge_anchors", lambda g: ranks.anchors(ranks.slopes(ranks.smoothed_twice(g), 192), 3, 2), _SLOPES + """ SELECT o.img_id, o.y, o.x, o.len, CASE WHEN o.gx > o.gy THEN 127 ELSE -127 END AS dir FROM e o JOIN e p ON p.img_id = o.img_id AND p.y = o.y - CASE WHEN o.gx > o.gy THEN 0 ELSE 1 END AND p.x = o.x - CASE WHEN o.gx > o.gy THEN 1 ELSE 0 END
JOIN e q ON q.img_id = o.img_id AND q.y = o.y + CASE WHEN o.gx > o.gy THEN 0 ELSE 1 END AND q.x = o.x + CASE WHEN o.gx > o.gy THEN 1 ELSE 0 END WHERE o.len >= 192 AND o.y BETWEEN 1 AND 62 AND o.x BETWEEN 1 AND 62 AND (o.y - 1) % 3 = 0 AND (o.x - 1) % 2 = 0 AND o.len > p.len + 2 AND o.len > q.len + 2""")
image("blocks_of_four", lambda g: transport.blocks_of_four(g, -4, 6, 10, 15), "WITH g AS ({t}), o AS (SELECT img_id, j, k FROM (SELECT DISTINCT img_id FROM g), (SELECT CAST(unnest(range(12)) AS INTEGER) AS j), (SELECT CAST(unnest(range(16)) AS INTEGER) AS k)) SELECT o.img_id, j AS y, k AS x, CAST(CASE WHEN j >= 1 AND count(n.v) = 8 THEN (sum(n.v) + 3) // 8 ELSE 0 END AS INTEGER) AS v FROM o LEFT JOIN g n ON n.img_id = o.img_id AND n.y IN (4 * j - 4, 4 * j - 2) AND n.x BETWEEN 6 + 4 * k AND 9 + 4 * k GROUP BY 1, 2, 3")
image("resample_timed", lambda g: transport.resampled_frames_timed(g.withColumn("t", F.col("img_id") * F.col("img_id") - 1), 5, shift=-2), """WITH g AS ({t}), s AS (SELECT y, x, v, CAST(img_id * img_id - 1 AS DOUBLE) AS t, lead(v) OVER w AS b, CAST(lead(img_id * img_id - 1) OVER w AS DOUBLE) AS t2, max(img_id * img_id - 1) OVER (PARTITION BY y, x) AS e FROM g WINDOW w AS (PARTITION BY y, x ORDER BY img_id)),
o AS (SELECT s.*, k, CAST(k * e AS DOUBLE) / 9 AS p FROM s CROSS JOIN (SELECT CAST(unnest(range(10)) AS INTEGER) AS k) WHERE y % 2 = k % 2)
SELECT CAST(k // 2 AS INTEGER) AS img_id, y, x, CAST(least(255, greatest(0, CASE WHEN t2 IS NULL THEN v ELSE floor(v * (1 - (p - t) / (t2 - t)) + b * (p - t) / (t2 - t) + 0.5 + 1e-9) END - 4)) AS INTEGER) AS v FROM o WHERE CASE WHEN k = 9 THEN t2 IS NULL ELSE p >= t - 1e-9 AND p < t2 - 1e-9 END""")
