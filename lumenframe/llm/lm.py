"""Language-model scoring by deleted interpolation of order three.

P(w | u v) = l3 c(uvw) / c(uv) + l2 c(vw) / c(v) + l1 c(w) / N + l0 / (V + 1). The weights belong to a bucket of the context's frequency: that of
c(uv), or of c(v) where uv was never seen. They are learned by expectation-maximisation on deleted counts: each training occurrence is predicted
from the counts without itself, its bucket too.

Counts cover every training document and grow with the corpus, so they are neither broadcast nor collected. Documents are dealt to blocks of
bounded size. A block sends each distinct word, word pair and word triple once, as sorted hashes cut by hash range; a range adds up what all blocks
sent and answers each block in the order of its question. Equal keys meet once a block, so a frequent word costs no more than a rare one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from . import textblocks as tb
from .langid import held_out

FOLDS, HELD = 7, 2
#: Bytes of text of a block, about.
BLOCK = 8 << 20
#: Tokens of a block whose estimates are worked out at once.
PLACES = 1 << 16
END, START = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BC2B2AE35)
ORDER = 3
#: Powers of two up to 2^63, so no count is cut. A bucket is the power of two of c(uv), or 64 and that of c(v).
LEVELS, BUCKETS = 64, 128
#: Word pairs and triples are told apart by so many bits more than it takes to number the bytes of the corpus; words by 64 bits.
SPARE_BITS = 11
#: What EM's last weights are mixed with, so that no weight of the lower orders is 0.
FLOOR, ROUNDS = 1e-4, 80


def pack(values: np.ndarray) -> bytes:
    """Numbers as bytes: equal places of all numbers together, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, kind)
    raw = pa.decompress(data[8:], size, codec="zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """(token, document): the words of each text in order, then END."""
    gap, low = tb.table(tb.SPACES)
    words, docs = [], []
    data, offsets = tb.strings(column)
    for i, _, part, at in tb.pieces(data, offsets):
        starts, ends, doc = tb.spans(~gap[part], at)
        words.append(tb.hashes(low[part], starts, ends))
        docs.append((doc + i).astype(np.int32))
    n = len(offsets) - 1
    size = sum(len(x) for x in docs)
    of = np.empty(size + n, np.int32)
    token = np.full(len(of), END, np.uint64)
    sizes, at = np.zeros(n, np.int64), 0
    for word, doc in zip(words, docs, strict=True):
        place = np.arange(at, at + len(doc)) + doc
        token[place], of[place] = word, doc
        if len(doc):
            sizes[doc[0] : doc[-1] + 1] += np.bincount(doc - doc[0])
        at += len(doc)
    of[np.cumsum(sizes + 1) - 1] = np.arange(n)
    return token, of


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, whose numbers are of 32 bits: a text, and so a block, has fewer than 2^31 words."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], inverse


def keys_of(token: np.ndarray, doc: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """The hash of each token and the `kind` tokens before it, START standing before each text; of words all bits count, else the upper ones."""
    if not kind:
        return token
    keys = np.empty(len(token), np.uint64)
    for a in range(0, len(token), PLACES):
        z = min(a + PLACES, len(token))
        parts = []
        for back in range(kind, 0, -1):
            earlier, b = np.full(z - a, START, np.uint64), min(max(a, back), z)
            same = doc[b:z] == doc[b - back : z - back]
            earlier[b - a :][same] = token[b - back : z - back][same]
            parts.append(earlier)
        keys[a:z] = tb.combined([*parts, token[a:z]]) >> np.uint64(64 - bits)
    return keys


def questions(parts: int, bits: int):
    power = parts.bit_length() - 1

    def ask(key, rows):
        """The block's distinct words, pairs and triples (kinds 0 to 2) with their counts in its training documents, a row for each hash range."""
        token, doc = tokens(rows["text"])
        learned = np.asarray(rows["learned"].to_numpy(), bool)[doc]
        out = {"kind": [], "part": [], "block": [], "keys": [], "counts": []}
        for kind in range(ORDER):
            keys, inverse = numbered(keys_of(token, doc, kind, bits))
            counts = np.bincount(inverse[learned], minlength=len(keys)).astype(np.uint32)
            del inverse
            of = (keys >> np.uint64((bits if kind else 64) - power)).astype(np.int64) if power else np.zeros(len(keys), np.int64)
            cuts = np.searchsorted(of, np.arange(parts + 1))
            for p in range(parts):
                a, z = cuts[p], cuts[p + 1]
                if a < z:
                    for name, x in zip(out, (kind, p, key[0].as_py(), pack_keys(keys[a:z]), pack(counts[a:z])), strict=True):
                        out[name].append(x)
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return ask


def answer(key, rows):
    """Sums over blocks, sent back to each; block -1 gets the range's tokens and distinct tokens."""
    keys = [unpack_keys(x.as_py()) for x in rows["keys"]]
    cuts = np.append(0, np.cumsum([len(k) for k in keys]))
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    del keys, order
    sums = np.bincount(inverse, weights=np.concatenate([unpack(x.as_py(), np.uint32) for x in rows["counts"]]))
    wide = bool(sums.max() >= 2**32)
    told = [pack(sums[inverse[a:z]].astype(np.uint64 if wide else np.uint32)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    n = len(told) + 1
    kind, part = key[0].as_py(), key[1].as_py()
    number = lambda x: pa.array([0.0] * (n - 1) + [float(x)])
    return pa.table({"block": pa.array([*rows["block"].to_pylist(), -1], pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "wide": pa.array([wide] * n), "data": pa.array([*told, b""], pa.binary()), "total": number(sums.sum()), "distinct": number((sums > 0).sum())})


def known_counts(rows, told, bits: int) -> tuple[np.ndarray, ...]:
    """(c(w), c(vw), c(uvw), document) for each token of the block, from the answers; and c(START)."""
    token, doc = tokens(rows["text"])
    kinds = told["kind"].to_pylist()
    found = []
    for kind in range(ORDER):
        at = sorted((p, i) for i, (k, p) in enumerate(zip(kinds, told["part"].to_pylist(), strict=True)) if k == kind)
        inverse = numbered(keys_of(token, doc, kind, bits))[1]
        found.append(np.concatenate([unpack(told["data"][i].as_py(), np.uint64 if told["wide"][i].as_py() else np.uint32) for _, i in at])[inverse])
    # START stands before each text, once as a word and once as a pair, as often as END after it.
    texts = found[0][token == END]
    return *found, doc, float(texts[0]) if len(texts) else 0.0


def contexts(one, two, three, doc, start: float):
    """(slice, c(w), c(vw), c(uvw), c(v), c(uv)) for runs of PLACES tokens: a context's count is that of the place before, or `start` at the first of a text."""
    for a in range(0, len(doc), PLACES):
        z = min(a + PLACES, len(doc))
        first = np.append(a == 0 or doc[a] != doc[a - 1], doc[a + 1 : z] != doc[a : z - 1])
        before = lambda count: np.where(first, start, np.append(count[a - 1] if a else start, count[a : z - 1]))  # noqa: B023, E731
        yield slice(a, z), *(x[a:z].astype(np.float64) for x in (one, two, three)), before(one).astype(np.float64), before(two).astype(np.float64)


def power_of(x: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(x, 1.0)).astype(np.int64)


def bucket(word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The bucket of a context from c(v) and c(uv)."""
    return np.where(pair > 0, power_of(pair), LEVELS + power_of(word))


def estimates(one, two, three, word, pair, total: float) -> np.ndarray:
    """Maximum-likelihood estimates of each order, from the third down; 0 where the context wasn't seen."""
    part = lambda a, b: np.where(b > 0, a / np.maximum(b, 1.0), 0.0)
    return np.stack([part(three, pair), part(two, word), one / max(total, 1.0)], 1)


def level(p: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the power of two of the inverse."""
    return np.where(p > 0, 1 + np.minimum(power_of(1.0 / np.maximum(p, 1e-300)), LEVELS - 2), 0)


def model_of(told: pa.Table) -> tuple[float, float, np.ndarray | None]:
    """(N, V, weights) from the one row of a block that has them; weights are missing while they are learned."""
    data = told["model"].drop_null()[0].as_py()
    total, distinct = np.frombuffer(data[:16], np.float64)
    return float(total), float(distinct), np.frombuffer(data[16:], np.float64).reshape(BUCKETS, ORDER + 1) if len(data) > 16 else None


def deleted(bits: int):
    def run(key, rows, told):
        """Training occurrences by (bucket, powers of two of the estimates), with their number and the sums of their estimates."""
        total, _, _ = model_of(told)
        one, two, three, doc, start = known_counts(rows, told, bits)
        learned = np.asarray(rows["learned"].to_numpy(), bool)[doc]
        cells, sums = [], []
        for of, *counts in contexts(one, two, three, doc, start):
            one_, two_, three_, word, pair = (np.maximum(x[learned[of]] - 1, 0.0) for x in counts)
            p = estimates(one_, two_, three_, word, pair, total - 1)
            cell = bucket(word, pair)
            for k in range(ORDER):
                cell = cell * LEVELS + level(p[:, k])
            at, which = np.unique(cell, return_inverse=True)
            cells.append(at)
            sums.append(np.stack([np.bincount(which, minlength=len(at)), *(np.bincount(which, weights=p[:, k], minlength=len(at)) for k in range(ORDER))]))
        at, which = np.unique(np.concatenate(cells), return_inverse=True)
        n, *sums = (np.bincount(which, weights=x, minlength=len(at)) for x in np.concatenate(sums, 1))
        return pa.table({"cell": pa.array(at, pa.int64()), "n": pa.array(n.astype(np.int64)), **{f"p{k}": pa.array(x, pa.float64()) for k, x in enumerate(sums)}})

    return run


def learn(pdf: pd.DataFrame) -> pd.DataFrame:
    """The weights of one bucket by EM over its cells, each standing for its occurrences at their mean estimates; LEVELS^3 rows at most, whatever the corpus."""
    n = pdf["n"].to_numpy(np.float64)
    p = np.concatenate([pdf[[f"p{k}" for k in range(ORDER)]].to_numpy(np.float64) / n[:, None], 1.0 / (pdf[["distinct"]].to_numpy(np.float64) + 1.0)], axis=1)
    w = np.full(ORDER + 1, 1.0 / (ORDER + 1))
    for _ in range(ROUNDS):
        r = p * w
        w = (r / r.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
    w = (1 - FLOOR) * w + FLOOR * np.array([0.0] * (ORDER - 1) + [0.5, 0.5])
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "weights": [w.tolist()]})


def probabilities(one, two, three, word, pair, total: float, distinct: float, weights: np.ndarray) -> np.ndarray:
    """P of each token: the weights of orders whose context wasn't seen go to the others in proportion."""
    w = weights[bucket(word, pair)]
    seen = np.stack([pair > 0, word > 0, np.full(len(word), total > 0), np.full(len(word), True)], 1)
    w = np.where(seen, w, 0.0)
    p = np.concatenate([estimates(one, two, three, word, pair, total), np.full((len(word), 1), 1.0 / (distinct + 1.0))], axis=1)
    return (w * p).sum(1) / w.sum(1)


def scored(id_type: pa.DataType, bits: int):
    def run(key, rows, told):
        total, distinct, weights = model_of(told)
        one, two, three, doc, start = known_counts(rows, told, bits)
        log, base = np.empty(len(doc)), np.empty(len(doc))
        for of, *counts in contexts(one, two, three, doc, start):
            log[of] = np.log10(probabilities(*counts, total, distinct, weights))
            base[of] = np.log10((counts[0] + 1.0) / (total + distinct + 1.0))
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        add = lambda x: np.add.reduceat(x, first)
        n = np.diff(np.append(first, len(doc)))
        return pa.table({"doc_id": rows["doc_id"].cast(id_type), "held_out": rows["held_out"], "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(add((one > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(len(n), int(total)), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(log))})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    A null text is an empty one: its one token is END. A null id is neither held out nor learned from. Repeated rows count as often as they stand. Without
    training documents every count is 0. An empty table gives an empty result. A text longer than a block is a block of its own. Only id_col and
    text_col are read. Words are told apart by 64-bit hashes; of pairs and triples about one in 10^4 shares its hash with another.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block))
    parts = 1 << max(0, (blocks - 1).bit_length())
    bits = min(64, max(size, 2).bit_length() + SPARE_BITS)
    out = F.col(id_col)
    rows = docs.select(
        F.pmod(F.xxhash64(out, F.col(text_col)), F.lit(blocks)).cast("int").alias("block"), out.alias("doc_id"), held_out(out, folds, held).alias("held_out"),
        (out.isNotNull() & ~held_out(out, folds, held)).alias("learned"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).repartition(blocks, "block")
    asked = rows.groupBy("block").applyInArrow(questions(parts, bits), "kind int, part int, block int, keys binary, counts binary")
    # A task of its own for each range, as far as hashing goes, so that a task's share doesn't grow with the corpus.
    told = asked.repartition(ORDER * parts, "kind", "part").groupBy("kind", "part").applyInArrow(answer, "block int, kind int, part int, wide boolean, data binary, total double, distinct double")
    stats = told.filter("block = -1 and kind = 0").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("total", "distinct")))
    # Dealt to blocks once for both passes. N and V, and the weights of all buckets, are one row of BUCKETS x (ORDER + 1) + 2 numbers; a block gets them with
    # the answer that has its count of END.
    to_blocks = told.filter("block >= 0").select("block", "kind", "part", "wide", "data").repartition(blocks, "block")
    has_end = (F.col("kind") == 0) & (F.col("part") == (int(END) * parts >> 64))
    told_all = lambda model: to_blocks.crossJoin(F.broadcast(model)).withColumn("model", F.when(has_end, F.col("model"))).groupBy("block")
    by_block = rows.groupBy("block")
    cells = by_block.cogroup(told_all(stats.mapInArrow(_model, "model binary"))).applyInArrow(_not_empty(deleted(bits), CELLS), CELLS)
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(ORDER)))
    cells = cells.withColumn("bucket", F.expr(f"cast(cell div {LEVELS**ORDER} as int)")).crossJoin(F.broadcast(stats))
    weights = cells.groupBy("bucket").applyInPandas(learn, "bucket int, weights array<double>").agg(F.collect_list(F.struct("bucket", "weights")).alias("weights"))
    model = stats.crossJoin(F.broadcast(weights)).mapInArrow(_model, "model binary")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return by_block.cogroup(told_all(model)).applyInArrow(_not_empty(scored(to_arrow_type(id_type), bits), schema), schema)


CELLS = T.StructType([T.StructField("cell", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(f"p{k}", T.DoubleType()) for k in range(ORDER))])


def _not_empty(run, schema):
    def f(key, rows, told):
        if rows.num_rows:
            return run(key, rows, told)
        return to_arrow_schema(schema).empty_table()

    return f


def _model(batches):
    """N and V as bytes, and where the row has them the weights of all buckets; buckets without training occurrences share their weight between the lower orders."""
    for b in batches:
        told = []
        for i in range(b.num_rows):
            data = np.array([b.column(0)[i].as_py(), b.column(1)[i].as_py()], np.float64).tobytes()
            if b.num_columns > 2:
                weights = np.tile([0.0] * (ORDER - 1) + [0.5, 0.5], (BUCKETS, 1))
                for own in b.column(2)[i].as_py():
                    weights[own["bucket"]] = own["weights"]
                data += weights.tobytes()
            told.append(data)
        yield pa.RecordBatch.from_arrays([pa.array(told, pa.binary())], names=["model"])
