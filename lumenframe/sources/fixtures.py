"""Named inputs derived from the driver's tables: images, vectors, sequences, scores and markup, each as a Spark view and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Seven 64 x 64 grey images in long form.
_GRID = """
SELECT g.img_id, g.y, g.x, COALESCE(a.v, 0) AS v
FROM (SELECT i.img_id, r.y, q.x FROM (SELECT DISTINCT img_id FROM a) i CROSS JOIN (SELECT DISTINCT y FROM a) r CROSS JOIN (SELECT DISTINCT x FROM a) q) g
LEFT JOIN a ON a.img_id = g.img_id AND a.y = g.y AND a.x = g.x"""
_FILLED = """SELECT l_linenumber AS img_id, CAST(l_partkey % 64 AS INT) AS y, CAST(l_orderkey % 64 AS INT) AS x,
  CAST(SUM(CAST(l_quantity AS BIGINT) * 7) % 256 AS INT) AS v FROM {lineitem} GROUP BY 1, 2, 3"""
_DISC = "SELECT img_id, y, x, CAST(CASE WHEN (x - 30) * (x - 30) + (y - 33) * (y - 33) <= (10 + img_id) * (10 + img_id) THEN 40 ELSE 180 END + floor(v / 16) AS INT) AS v FROM ({grid}) t"
_RGB = "SELECT img_id, y, x, v AS r, CAST((v * 7 + x * 3) % 256 AS INT) AS g, CAST((v * 3 + y * 5) % 256 AS INT) AS b FROM ({grid}) t"
_SIG = """SELECT user_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i, {micros} AS t_us, CAST(FLOOR(value) AS INT) AS v, value FROM {events}"""
_IMG8 = "SELECT vec_id AS img_id, label, CAST(FLOOR(i / 8) AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(LEAST(255, GREATEST(0, FLOOR((e + 1.0) * 127.5))) AS INT) AS v FROM ({vec}) t"
_MARKUP = """SELECT o_orderkey AS rec_id, CAST(200 + o_orderkey % 200 AS INT) AS px, CAST(150 + o_custkey % 150 AS INT) AS py, CAST(40 + o_orderkey % 60 AS INT) AS pr,
  CAST(200 + o_orderkey % 200 AS INT) AS ix, CAST(150 + o_custkey % 150 AS INT) AS iy, CAST(110 + o_orderkey % 110 AS INT) AS ir,
  CAST(o_custkey % 21 - 10 AS INT) AS dx, CAST(o_custkey % 13 - 6 AS INT) AS dy, CAST(o_orderkey % 17 - 8 AS INT) AS drp, CAST(o_orderkey % 23 - 11 AS INT) AS dri FROM {orders}"""
_SCORES = "SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS is_same FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id"
# Points of one ellipse for each order date's day of the year.
_POINTS = "SELECT CAST(c_nationkey AS INT) AS set_id, CAST(200 + (40 + c_nationkey) * cos(c_custkey * 0.37) AS INT) AS x, CAST(150 + (20 + c_nationkey) * sin(c_custkey * 0.37) AS INT) AS y, c_custkey AS n FROM {customer}"
_POINTS_DUCK = "SELECT CAST(c_nationkey AS INT) AS set_id, CAST(trunc(200 + (40 + c_nationkey) * cos(c_custkey * 0.37)) AS INT) AS x, CAST(trunc(150 + (20 + c_nationkey) * sin(c_custkey * 0.37)) AS INT) AS y, c_custkey AS n FROM customer"
_VEC = "SELECT vec_id, label, i, CAST(e AS DOUBLE) AS e FROM {embeddings} LATERAL VIEW POSEXPLODE(embedding) AS i, e"
_VEC_DUCK = "SELECT vec_id, label, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS e FROM (SELECT vec_id, label, embedding, UNNEST(range(1, 65)) AS i FROM embeddings)"


def _spark() -> dict[str, str]:
    grid = f"WITH a AS ({_FILLED}) {_GRID}"
    return {
        "grid": grid, "disc": _DISC.replace("{grid}", grid), "rgb": _RGB.replace("{grid}", grid), "sig": _SIG.replace("{micros}", "unix_micros(CAST(ts AS TIMESTAMP))"), "vec": _VEC, "img8": _IMG8.replace("{vec}", _VEC),
        "markup": _MARKUP, "scores": _SCORES, "points": _POINTS,
    }


TABLES = {"grid": ["lineitem"], "disc": ["lineitem"], "rgb": ["lineitem"], "sig": ["events"], "vec": ["embeddings"], "img8": ["embeddings"], "markup": ["orders"], "scores": ["labels", "documents"], "points": ["customer"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixtures as a DataFrame."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    return spark.sql(_spark()[name], **tables)


def duck(name: str) -> str:
    """The same fixture as DuckDB SQL."""
    plain = lambda sql: sql.replace("{", "").replace("}", "")
    grid = f"WITH a AS ({plain(_FILLED)}) {_GRID}"
    return {
        "grid": grid, "disc": _DISC.replace("{grid}", grid), "rgb": _RGB.replace("{grid}", grid), "sig": plain(_SIG.replace("{micros}", "epoch_us(ts)")), "vec": _VEC_DUCK, "img8": _IMG8.replace("{vec}", _VEC_DUCK),
        "markup": plain(_MARKUP), "scores": plain(_SCORES), "points": _POINTS_DUCK,
    }[name]
