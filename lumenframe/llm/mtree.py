"""Exact top-k inner product search by M-trees.

Vectors of one length M' are points of a metric space in which the largest inner product is the least distance: each vector v gets one more
component, sqrt(M^2 - |v|^2), M being the longest of its tree, and a query gets 0 there. Rows are dealt to the nearest of some pivots, and where many
rows are near one pivot on to several trees by a hash of their id, so no tree grows with the corpus or with a vector that many rows share. A tree is
built once and stored. Its nodes hold a routing point, the covering radius and the distance to the parent's routing point; pages hold members with
their distance to the page's point. Search takes the node of least lower bound first. |d(q, parent) - d(child, parent)| is a lower bound that costs no
distance; where it exceeds the k-th best by more than a radius, nothing is computed.

Queries are searched in a tree of their own pivot first; the k-th best score found there is what other trees have to reach.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

TREE_ROWS = 32768
QUERY_ROWS = 4096
#: Pivots of vectors of one length at most: a table of bounded size, whatever the rows.
PIVOTS = 256
#: Blocks of queries that meet a tree at once, about.
SLICE = 64
PAGE, FANOUT = 256, 16


@dataclass
class Node:
    """routing: point; radius: covers all below; children or a page of members with distances to `routing`."""

    routing: np.ndarray
    radius: float
    children: list["Node"] = field(default_factory=list)
    points: np.ndarray | None = None
    radii: np.ndarray | None = None
    apart: np.ndarray | None = None
    members: np.ndarray | None = None


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT):
        self.ids = ids
        norms = (vectors.astype(np.float64) ** 2).sum(1)
        self.most = float(norms.max()) if len(ids) else 0.0
        self.space = np.column_stack([vectors, np.sqrt(np.maximum(self.most - norms, 0.0))]).astype(np.float32)
        # Sums of products below 2^24 are exact in 32-bit floats, below 2^53 in 64-bit ones, where matrix products are fast.
        largest = float(np.abs(vectors).max()) ** 2 * vectors.shape[1] if len(ids) else 0.0
        self.exact = vectors.astype(np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else np.int64)
        self.page, self.fanout = page, fanout
        self.random = np.random.default_rng(5)
        self.computed = self.avoided = 0
        self.root = self.built(np.arange(len(ids)), self.space.mean(0, dtype=np.float64).astype(np.float32)) if len(ids) else None

    def built(self, rows: np.ndarray, routing: np.ndarray) -> Node:
        d = np.sqrt(((self.space[rows] - routing) ** 2).sum(1))
        node = Node(routing, float(d.max()))
        if len(rows) <= self.page:
            order = np.argsort(self.ids[rows], kind="stable")
            node.members, node.apart = rows[order], d[order]
            return node
        at = self.space[rows]
        pivots = at[self.random.choice(len(rows), min(self.fanout, -(-len(rows) // self.page)), replace=False)]
        gaps = (pivots**2).sum(1) - 2 * at @ pivots.T
        near = gaps.argmin(1)
        if np.bincount(near, minlength=len(pivots)).max() > 0.9 * len(rows):  # many equal points: cut by distance instead
            near = np.argsort(np.argsort(d, kind="stable"), kind="stable") * len(pivots) // len(rows)
        for k in range(len(pivots)):
            if len(own := rows[near == k]):
                node.children.append(self.built(own, self.space[own].mean(0, dtype=np.float64).astype(np.float32)))
        node.points = np.stack([c.routing for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.apart = np.sqrt(((node.points - routing) ** 2).sum(1))
        return node

    def search(self, query: np.ndarray, own_id: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), the k best without rows of own_id: largest score first, then smallest id. Scores below `least` needn't be found."""
        q = np.append(query, 0).astype(np.float32)
        wanted = query.astype(self.exact.dtype)
        reach = float((query.astype(np.float64) ** 2).sum()) + self.most
        # Distances are 32-bit floats; the slack is some hundred times their error.
        slack = 1e-4 * (1.0 + np.sqrt(reach))
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cutoff = np.inf if least is None else float(np.sqrt(max(0.0, reach - 2.0 * least)))
        heap: list[tuple[float, int, Node, float]] = []
        if self.root is not None:
            d = float(np.sqrt(((q - self.root.routing) ** 2).sum()))
            heap.append((max(0.0, d - self.root.radius), 0, self.root, d))
        pushed = 0
        while heap:
            bound, _, node, d = heapq.heappop(heap)
            if bound > cutoff + slack:
                break
            free = np.abs(d - node.apart)
            if node.members is None:
                may = np.flatnonzero(free - node.radii <= cutoff + slack)
                self.avoided += len(free) - len(may)
                far = np.sqrt(((node.points[may] - q) ** 2).sum(1))
                self.computed += len(may)
                for c, x in zip(may.tolist(), far.tolist(), strict=True):
                    if (low := max(0.0, x - node.radii[c], bound)) <= cutoff + slack:
                        heapq.heappush(heap, (low, pushed := pushed + 1, node.children[c], x))
                continue
            rows = node.members[free <= cutoff + slack] if np.isfinite(cutoff) else node.members
            self.avoided += len(node.members) - len(rows)
            self.computed += len(rows)
            scores = (self.exact[rows] @ wanted).astype(np.int64)
            take = self.ids[rows] != own_id
            if len(best_s) == k:
                take &= scores >= best_s[-1]
            elif least is not None:
                take &= scores >= least
            if take.any():
                s, i = np.concatenate([best_s, scores[take]]), np.concatenate([best_i, self.ids[rows[take]]])
                top = np.lexsort((i, -s))[:k]
                best_s, best_i = s[top], i[top]
                if len(best_s) == k:
                    cutoff = min(cutoff, np.sqrt(max(0.0, reach - 2.0 * float(best_s[-1]))))
        return best_s, best_i


def whole(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v, dim): floor(scale * x) of each component; rows with a null id, a null vector or a component that is null or not finite are left out."""
    odd = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).filter(~odd)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v")).withColumn("dim", F.size("v"))


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them."""
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def grown(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tree of a block's rows."""
    pdf = pdf.sort_values("id", kind="stable")
    tree = MTree(pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.int64))
    return pd.DataFrame({**{c: pdf[c].iloc[:1].to_numpy() for c in ("dim", "cell", "part")}, "tree": [pickle.dumps(tree, protocol=5)]})


def asked_for(pdf: pd.DataFrame) -> pd.DataFrame:
    """The queries of a block in one row: ids, vectors, and the scores that they have to reach."""
    pdf = pdf.sort_values("id", kind="stable")
    return pd.DataFrame({"dim": pdf["dim"].iloc[:1].to_numpy(), "cell": pdf["cell"].iloc[:1].to_numpy(), "queries": [pickle.dumps((pdf["id"].to_numpy(np.int64), narrow(np.stack(pdf["v"].to_numpy()).astype(np.int64)), pdf["least"].tolist()), protocol=5)]})


def searched(forest: DataFrame, asked: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each tree that has its (dim, cell, part).

    A tree meets its queries as one group, in which it stands once; of many blocks of queries at most some SLICE are in a group, and the tree is sent as often as
    that takes.
    """
    keys, slices = ["dim", "cell", "part", "slice"], max(1, -(-blocks // SLICE))
    trees = forest.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    queries = asked.withColumn("slice", F.pmod(F.xxhash64("queries"), F.lit(slices)).cast("int"))

    def run(key, trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        for blob in trees["tree"] if len(queries) else ():
            tree = pickle.loads(blob)
            for ids, vectors, least in map(pickle.loads, queries["queries"]):
                for own, q, low in zip(ids.tolist(), vectors.astype(np.int64), least, strict=True):
                    scores, near = tree.search(q, own, k, None if low is None or np.isnan(low) else int(low))
                    found.append((np.full(len(near), own, np.int64), near, scores))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 3
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    return trees.groupBy(keys).cogroup(queries.groupBy(keys)).applyInPandas(run, "query_id long, vec_id long, score long")


def dealt(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with `cell`, the number of the nearest pivot of their length."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors of each length at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for dim, at in pdf.groupby("dim").indices.items():
                p = sent.value[dim]
                if len(p) > 1:
                    for a in range(0, len(at), 4096):
                        v = np.stack(pdf["v"].to_numpy()[at[a : a + 4096]]).astype(np.float64)
                        cell[at[a : a + 4096]] = ((p**2).sum(1) - 2 * v @ p.T).argmin(1)
            yield pdf.assign(cell=cell)

    return rows.mapInPandas(run, "id long, v array<long>, dim int, cell int")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows of largest inner product.

    Rows of the query's own id are no candidates; other repeated rows are candidates each, and of repeated query rows the one of the least vector in
    order counts. Fewer rows than k give fewer ranks. Vectors are compared with vectors of equal length. Rows with null ids, null vectors or components
    that are null or not finite take no part. An empty table gives an empty result.
    """
    rows = whole(vectors, id_col, vec_col, scale)
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    # About as many pivots as there are trees, by a hash of the id; any vectors will do.
    share = {dim: min(PIVOTS, n // tree_rows) / n for dim, n in counts.items()}
    pivots = {dim: np.zeros((0, dim)) for dim in counts}
    if any(share.values()):
        of = F.element_at(F.create_map(*(F.lit(x) for dim, y in share.items() for x in (dim, y))), F.col("dim"))
        chosen = rows.filter(F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 30)) < of * (1 << 30)).dropDuplicates(["v"]).select("dim", "v").orderBy("dim", "v").toPandas()
        pivots |= {dim: np.stack(own["v"].to_numpy()).astype(np.float64)[: 2 * PIVOTS] for dim, own in chosen.groupby("dim")}
    placed = written(dealt(rows, pivots), "top-rows")
    sizes = written(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tree_rows)).cast("int").alias("parts")), "top-sizes")  # a row a pivot
    forest = placed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    forest = written(forest.groupBy("dim", "cell", "part").applyInPandas(grown, "dim int, cell int, part int, tree binary"), "top-trees")

    asked = placed.filter(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min(F.struct("v", "cell")).alias("x")).groupBy("id").agg(F.min(F.struct("dim", "x")).alias("y")).select("id", F.col("y.dim").alias("dim"), F.col("y.x.v").alias("v"), F.col("y.x.cell").alias("cell"))
    asked = written(asked, "top-queries")
    cells = {r["dim"]: r["n"] for r in sizes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {dim: -(-n // (every * query_rows * cells[dim])) for dim, n in counts.items()}
    sized = F.element_at(F.create_map(*(F.lit(x) for dim, n in parts.items() for x in (dim, n))), F.col("dim")) if parts else F.lit(1)
    packed = lambda df: df.groupBy("dim", "cell", F.pmod(F.xxhash64(F.lit(3), "id"), sized).alias("__block")).applyInPandas(asked_for, "dim int, cell int, queries binary")
    blocks = sum(n * cells[dim] for dim, n in parts.items())
    first = written(searched(forest.filter("part = 0"), packed(asked.withColumn("least", F.lit(None).cast("double"))).withColumn("part", F.lit(0)), k, blocks), "top-first")
    # A query that has k rows already needs no lower scores elsewhere.
    reached = first.groupBy(F.col("query_id").alias("id")).agg(F.min("score").cast("double").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("id", "least")
    others = packed(asked.join(reached, "id", "left")).withColumnRenamed("cell", "home").join(F.broadcast(sizes), "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("not (cell = home and part = 0)")
    rest = searched(forest, others, k, blocks)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = written(first.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-found")
    for x in (placed, sizes, forest, asked, first):
        dropped(x)
    return found


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
