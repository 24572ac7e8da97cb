"""Single-linkage clustering at a distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import held
from .components import settled


def near_pairs(points: DataFrame, distance: int, key: str = "set_id", id_col: str = "n") -> DataFrame:
    """(key, a, b): pairs of points at most `distance` apart. Points meet by square cells of that size: each looks at its own cell and the eight around."""
    cell = lambda c: F.floor(F.col(c) / F.lit(distance)).cast("int")
    a = points.select(key, F.col(id_col).alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = points.select(key, F.col(id_col).alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c")).select(key, "b", "x2", "y2", "c.cx", "c.cy")
    return a.join(b, [key, "cx", "cy"]).filter(F.expr(f"a < b and (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) <= {distance * distance}")).select(key, "a", "b")


def single_linkage(points: DataFrame, distance: int, key: str = "set_id", id_col: str = "n") -> DataFrame:
    """(key, id, cluster): points joined by chains of steps of at most `distance`; a cluster is named by its least id.

    Points at one place are one cluster, so links are sought between distinct places, each named by its least id, and their number doesn't grow with the
    copies of a place. An id that stands at several places joins them. Points without a set, an id or a finite place are linked to none.
    """
    own = points.filter(f"{key} is not null and {id_col} is not null and x - x = 0 and y - y = 0").select(key, F.col(id_col).alias("id"), "x", "y").distinct()
    places = held(own.groupBy(key, "x", "y").agg(F.min("id").alias("place")), "link-places")
    member = own.join(places, [key, "x", "y"]).select(key, "id", "place").distinct()
    homes = held(member.groupBy(key, "id").agg(F.min("place").alias("home"), F.max("place").alias("last")), "link-homes")
    split = homes.filter("home < last").select(key, "id", "home")
    edge = near_pairs(places, distance, key, "place").unionByName(split.join(member, [key, "id"]).filter("home < place").select(key, F.col("home").alias("a"), F.col("place").alias("b"))).distinct()
    both = held(edge.unionByName(edge.select(key, F.col("b").alias("a"), F.col("a").alias("b"))), "link-edges")
    state = held(places.select(key, F.col("place").alias("home")).distinct().withColumn("cluster", F.col("home")), "link-labels")
    named = homes.select(key, "id", "home").join(settled(both, state, [key], "home", "cluster", "link-labels"), [key, "home"]).select(key, "id", "cluster")
    return points.select(key, F.col(id_col).alias("id")).distinct().join(named, [key, "id"], "left").select(key, "id", F.coalesce("cluster", "id").alias("cluster"))


def cluster_sizes(labels: DataFrame, key: str = "set_id") -> DataFrame:
    sizes = labels.groupBy(key, "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "cluster")).cast("int"))
