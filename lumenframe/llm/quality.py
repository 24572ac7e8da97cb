"""Quality classifier: a byte-level convolutional network in numpy.

Filters slide over the bytes of the whole text. Each chunk of CHUNK positions, half of it shared with the next chunk, keeps the largest response
of each filter. The mean and the largest of the chunks' values are combined by one logistic unit into a probability. Filters and weights are
learned by Adam on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import held_out
from .textblocks import pieces, strings

#: Filters, bytes that a filter sees, and positions of half a chunk.
FILTERS, WIDTH, HALF = 20, 5, 256
#: Labelled documents that the network learns from at most, whole texts of any length; scoring has no bound.
SAMPLE = 2500
FOLDS, HELD = 3, 1


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with WIDTH - 1 zeros after each document, first position of each half chunk, its document, end of the positions)."""
    sizes = np.diff(offsets)
    full = sizes > 0
    starts = offsets[:-1] + (WIDTH - 1) * np.arange(len(sizes))
    out = np.zeros(len(data) + (WIDTH - 1) * (len(sizes) + 1), np.uint8)
    out[np.arange(len(data)) + np.repeat((WIDTH - 1) * np.arange(len(sizes)), sizes)] = data
    halves = np.where(full, -(-sizes // HALF), 0)
    doc = np.repeat(np.arange(len(sizes)), halves)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(halves) - halves, halves)
    first = starts[doc] + within * HALF
    return out, first, doc, np.minimum(first + HALF, starts[doc] + sizes[doc])


def chunks(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(does a chunk start at this half?, is it the last half of its document?): the last half starts one only if it is alone."""
    ends = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    begins = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    return ~ends | begins, ends


class Network:
    def __init__(self, filters: int = FILTERS, seed: int = 3):
        random = np.random.default_rng(seed)
        self.w = random.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32)
        self.b = np.zeros(filters, np.float32)
        self.out = random.normal(0, 0.1, 2 * filters).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def responses(self, text: np.ndarray, a: int, z: int) -> np.ndarray:
        """Filter values at positions a to z; no position sees past the zeros after its document."""
        x = np.take(self.w[0], text[a:z], axis=0)
        for j in range(1, WIDTH):
            x += np.take(self.w[j], text[a + j : z + j], axis=0)
        return x

    def halves(self, text: np.ndarray, first: np.ndarray, end: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Largest values (and their positions) of each half chunk, some hundred half chunks at a time."""
        best, at = np.zeros((len(first), len(self.b)), np.float32), np.zeros((len(first), len(self.b)), np.int64)
        for i in range(0, len(first), 256):
            own = slice(i, min(i + 256, len(first)))
            a, z = int(first[i]), int(end[own][-1])
            x = self.responses(text, a, z)
            # Half chunks of one document follow each other; between documents lie positions that belong to none.
            cuts = np.column_stack([first[own], end[own]]).reshape(-1) - a
            x = np.concatenate([x, np.full((1, x.shape[1]), -np.inf, np.float32)])
            best[own] = np.maximum.reduceat(x, cuts, axis=0)[::2]
            if where:
                for k in range(own.start, own.stop):
                    at[k] = x[first[k] - a : end[k] - a].argmax(0) + first[k]
        return np.maximum(best + self.b, 0.0), at

    def pooled(self, half: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document values, chunk values, row of the half chunk that gave each): a chunk is a half and the next of the same document."""
        keep, last = chunks(doc)
        follow = np.where(last, np.arange(len(doc)), np.arange(len(doc)) + 1)
        nxt = half[follow]
        chunk = np.maximum(half, nxt)[keep]
        src = np.where(half >= nxt, np.arange(len(doc))[:, None], follow[:, None])[keep]
        out, of = np.zeros((n, 2 * half.shape[1]), np.float32), doc[keep]
        if len(of):
            seen, begin = np.unique(of, return_index=True)
            count = np.diff(np.append(begin, len(of)))
            out[seen, : half.shape[1]] = np.add.reduceat(chunk, begin, axis=0) / count[:, None]
            out[seen, half.shape[1] :] = np.maximum.reduceat(chunk, begin, axis=0)
        return out, chunk, src

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, first, doc, end = padded(data, offsets)
        half, _ = self.halves(text, first, end)
        z = self.pooled(half, doc, len(offsets) - 1)[0].astype(np.float64) @ self.out + self.bias[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 32, seed: int = 4) -> "Network":
        """Adam on the logistic loss; a step sees the whole texts of a batch."""
        random = np.random.default_rng(seed)
        n, f = len(texts), len(self.b)
        if not n or labels.min() == labels.max():
            self.out[:] = 0.0
            p = (labels.sum() + 0.5) / (n + 1.0)
            self.bias[:] = np.log(p / (1 - p))
            return self
        params = [self.w, self.b, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = random.permutation(n)
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for i in range(0, n, batch):
                rows = order[i : i + batch]
                cut = [texts[r] for r in rows]
                offsets = np.append(0, np.cumsum([len(x) for x in cut])).astype(np.int64)
                text, first, doc, end = padded(np.frombuffer(b"".join(cut), np.uint8), offsets)
                half, at = self.halves(text, first, end, where=True)
                value, chunk, src = self.pooled(half, doc, len(rows))
                p = 1.0 / (1.0 + np.exp(-np.clip(value @ self.out + self.bias[0], -30, 30)))
                d = ((p - labels[rows]) / len(rows)).astype(np.float32)
                gw, gb = np.zeros_like(self.w), np.zeros_like(self.b)
                dv = d[:, None] * self.out
                of = doc[chunks(doc)[0]]
                count = np.maximum(np.bincount(of, minlength=len(rows)), 1)
                dc = dv[of, :f] / count[of][:, None] + np.where(chunk == value[of, f:], dv[of, f:], 0.0)
                dc = np.where(chunk > 0, dc, 0.0)
                cols = np.broadcast_to(np.arange(f), dc.shape)
                pos = at[src, cols]
                for j in range(WIDTH):
                    np.add.at(gw[j], (text[pos + j].reshape(-1), cols.reshape(-1)), dc.reshape(-1))
                gb += dc.sum(0)
                grads = [gw + 1e-5 * self.w, gb, value.T @ d + 1e-4 * self.out, np.array([d.sum()], np.float32)]
                t += 1
                for q, g, a, b in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, folds: int = FOLDS, held: int = HELD) -> Network:
    """Learns from at most `sample` labelled documents outside the held-out fold, those of least id hash, whatever their length.

    Repeated labels count as their largest; of several texts of one id the first in order is learned from. A null text is an empty one.
    """
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col), folds, held)).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("y"))
    picked = own.orderBy(F.xxhash64(F.lit(5), id_col), id_col).limit(sample)
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), id_col).groupBy(id_col, "y").agg(F.min("text").alias("text")).toPandas()  # at most `sample` rows
    rows = rows.sort_values(id_col)
    return Network().train([x.encode() for x in rows["text"]], rows["y"].to_numpy(np.float32))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row of docs: the probability of label 1, from the whole text.

    A null or empty text has no chunk and gets the score of the bias alone. Rows with equal texts get equal scores. If nothing is labelled, or all labels
    are alike, every score is the share of label 1. An empty table gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a fixed number of weights
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            out = np.zeros(batch.num_rows)
            for i, j, part, at in pieces(data, offsets):
                out[i:j] = sent.value.scores(part, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=schema.names)

    return docs.select(id_col, F.col(text_col)).mapInArrow(run, schema)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
