"""Near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

A text is the set of its shingles of five words with weight tf * idf, idf being the mean over the five words of log((N + 1) / (df + 1)) + 1.
Word document frequencies are exact and cover all documents, words being told apart by 64-bit hashes. They grow with the corpus, so they are neither
broadcast nor collected: documents are dealt to blocks of bounded size, a block sends its distinct words cut by hash range, a range adds up what all
blocks sent and answers each with the idf of its words. A sample of ICWS hits the same (shingle, level) in two texts with a probability equal to their weighted Jaccard similarity. Samples are
banded; texts that share a band are candidates; a link is a candidate pair whose weighted Jaccard similarity, computed exactly, reaches the
threshold. Classes are the connected components.

A band's members are not paired with each other. Each is compared with three of them, and where that leaves several components, with the
member that differs least from what the band has in common, the centre. What then stays apart is searched by prefixes of edits: see across(). A group of near copies costs
about its size, and no pair that shares a band and could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import dropped, written
from .lm import pack, pack_keys, unpack, unpack_keys

SHINGLE, THRESHOLD = 5, 0.8
#: Two texts of similarity 0.8 share one of 10 bands of 3 samples with probability 0.9992.
BANDS, ROWS = 10, 3
#: Bytes of text of a block, about.
BLOCK = 8 << 20
#: Bytes up to which a list of nodes is broadcast.
LISTED_BYTES = 8 << 20
#: Members of a group from which its centre is sought, about; groups of fewer take the first choice.
SURVEYED = 24


def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 2^16 even steps, and their logarithms."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(p), np.full_like(p, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        over = 1 - (1 + x) * np.exp(-x) > p
        low, high = np.where(over, low, x), np.where(over, x, high)
    x = (low + high) / 2
    return x.astype(np.float32), np.log(x).astype(np.float32)


_tables: list = []


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its document): lower-cased words of letters and digits."""
    gap, low = tb.table(tb.NOT_ALNUM)
    starts, ends, doc = tb.spans(~gap[data], offsets)
    return tb.hashes(low[data], starts, ends), doc


def shingles(data: np.ndarray, offsets: np.ndarray, idf: Callable[[np.ndarray], np.ndarray], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), sorted by document and shingle; a text of fewer words is one shingle of all its words."""
    words, doc = word_hashes(data, offsets)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    value = idf(words)
    padded = np.concatenate([words, np.zeros(size - 1, np.uint64)])
    values = np.concatenate([value, np.zeros(size - 1, np.float32)])
    docs = np.concatenate([doc, np.full(size - 1, -1)])
    parts, weight, inside = [], np.zeros(n, np.float32), np.zeros(n, np.int32)
    for j in range(size):
        own = docs[j : j + n] == doc
        parts.append(np.where(own, padded[j : j + n], np.uint64(0)))
        weight += np.where(own, values[j : j + n], 0)
        inside += own
    first = np.append(True, doc[1:] != doc[:-1])
    keep = (inside == size) | first
    d, s, w = doc[keep], tb.combined(parts)[keep], (weight / inside).astype(np.float32)[keep]
    order = np.lexsort((s, d))
    d, s, w = d[order], s[order], w[order]
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]))
    at = np.flatnonzero(new)
    return d[at], s[at], w[at] * np.diff(np.append(at, len(d))).astype(np.float32)


def icws(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, samples): for each sample the 32-bit hash of the (shingle, level) that wins.

    The randoms r, c ~ Gamma(2, 1) and b ~ U(0, 1) of a shingle come from one hash, by quantile tables. t = floor(ln w / r + b),
    ln a = ln c - r (t - b + 1); the least a wins.
    """
    if not _tables:
        _tables.extend(_gamma_tables())
    gamma, log_gamma = _tables
    seen, first = np.unique(doc, return_index=True)
    count = np.diff(np.append(first, len(doc)))
    out = np.zeros((len(seen), samples), np.int32)
    log_w, low16 = np.log(weight), np.uint64(0xFFFF)
    keys = np.random.default_rng(17).integers(1, 1 << 63, samples, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(samples):
            h = tb.mixed(shingle ^ keys[k])
            r = gamma[(h & low16).astype(np.int32)]
            b = ((h >> np.uint64(32)) & low16).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_w / r + b)
            a = log_gamma[((h >> np.uint64(16)) & low16).astype(np.int32)] - r * (t - b + 1)
            least = np.minimum.reduceat(a, first)
            hit = np.flatnonzero(a == np.repeat(least, count))
            hit = hit[np.append(True, doc[hit][1:] != doc[hit][:-1])]
            won = tb.mixed(shingle[hit] * np.uint64(0x9E3779B97F4A7C15) + t[hit].astype(np.int64).astype(np.uint64))
            out[:, k] = (won >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return seen, out


def frequencies(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, ascending, and the documents that have each) of a block's texts."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in tb.pieces(*tb.strings(column)):
        words, doc = word_hashes(data, offsets)
        found, of = np.unique(words, return_inverse=True)
        keys.append(found)
        counts.append(np.bincount(np.unique(of * len(offsets) + doc) // len(offsets), minlength=len(found)))
    all_, of = np.unique(np.concatenate(keys), return_inverse=True)
    return all_, np.bincount(of, weights=np.concatenate(counts), minlength=len(all_)).astype(np.uint32)


def inverse(n: int, df: np.ndarray) -> np.ndarray:
    return (np.log((n + 1.0) / (df + 1.0)) + 1.0).astype(np.float32)


def word_weights(rows: DataFrame, blocks: int, n: int) -> DataFrame:
    """(block, part, keys, idf): the distinct words of each block's texts, cut by hash range, and their idf over all n documents of rows (block, node, text)."""
    parts = 1 << max(0, (blocks - 1).bit_length())
    shift = np.uint64(64 - parts.bit_length() + 1) if parts > 1 else None

    def ask(key, block):
        keys, counts = frequencies(block["text"])
        of = (keys >> shift).astype(np.int64) if shift is not None else np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(of, np.arange(parts + 1))
        some = [(p, a, z) for p, a, z in zip(range(parts), cuts[:-1], cuts[1:], strict=True) if a < z]
        return pa.table({"part": pa.array([p for p, _, _ in some], pa.int32()), "block": pa.array([key[0].as_py()] * len(some), pa.int32()), "keys": pa.array([pack_keys(keys[a:z]) for _, a, z in some], pa.binary()), "counts": pa.array([pack(counts[a:z]) for _, a, z in some], pa.binary())})

    def answer(key, asked):
        keys = [unpack_keys(x.as_py()) for x in asked["keys"]]
        _, of = np.unique(np.concatenate(keys), return_inverse=True)
        idf = inverse(n, np.bincount(of, weights=np.concatenate([unpack(x.as_py(), np.uint32) for x in asked["counts"]])))
        cuts = np.append(0, np.cumsum([len(k) for k in keys]))
        told = [pack(idf[of[a:z]]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"block": asked["block"], "part": pa.array([key[0].as_py()] * len(told), pa.int32()), "keys": asked["keys"], "idf": pa.array(told, pa.binary())})

    return rows.groupBy("block").applyInArrow(ask, "part int, block int, keys binary, counts binary").groupBy("part").applyInArrow(answer, "block int, part int, keys binary, idf binary")


def told_idf(told: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
    """The idf of a block's words, from its rows of word_weights."""
    own = sorted(zip(*(told[c].to_pylist() for c in ("part", "keys", "idf")), strict=True))
    keys = np.concatenate([np.zeros(0, np.uint64), *(unpack_keys(k) for _, k, _ in own)])
    idf = np.concatenate([np.zeros(0, np.float32), *(unpack(x, np.float32) for _, _, x in own)])
    return lambda words: idf[np.searchsorted(keys, words)]


def sampled(rows: DataFrame, told: DataFrame, bands: int, size: int) -> DataFrame:
    """(node, sig, block, part, keys, idf): the samples of each text that has words, and the rows of told, whose node is null."""

    def run(key, block, own):
        idf, nodes = told_idf(own), block["node"].to_numpy()
        at, values = [np.zeros(0, np.int64)], [np.zeros((0, bands * size), np.int32)]
        for i, _, data, offsets in tb.pieces(*tb.strings(block["text"])):
            if len(data):
                doc, sig = icws(*shingles(data, offsets, idf), bands * size)
                at.append(nodes[i + doc])
                values.append(sig)
        node, sig = np.concatenate(at), np.concatenate(values)
        sigs = pa.ListArray.from_arrays(np.arange(len(node) + 1, dtype=np.int32) * (bands * size), sig.reshape(-1))
        blank = lambda kind, n: pa.nulls(n, kind)
        n, m = len(node), own.num_rows
        both = lambda x, y: pa.chunked_array([x, *(y.chunks if isinstance(y, pa.ChunkedArray) else [y])])
        return pa.table({
            "node": both(pa.array(node, pa.int64()), blank(pa.int64(), m)), "sig": both(sigs, blank(sigs.type, m)),
            **{c: both(blank(own[c].type, n), own[c]) for c in ("block", "part", "keys", "idf")},
        })

    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, "node long, sig array<int>, block int, part int, keys binary, idf binary")


def vectors(rows: DataFrame, told: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, vec): shingles (their upper 32 bits, ascending) and weights of the texts of rows (block, node, text) that are chosen, as bytes.

    chosen has one (node, block) a text; blocks get the list of their own with their words' idf, so texts that aren't chosen go no further.
    """
    asked = told.withColumn("node", F.lit(None).cast("long")).unionByName(chosen.select("block", "node"), allowMissingColumns=True)

    def run(key, block, own):
        wanted = own.filter(pa.compute.is_valid(own["node"]))["node"].to_numpy()
        nodes, first = np.unique(block["node"].to_numpy(), return_index=True)
        block = block.take(pa.array(first[np.isin(nodes, wanted)]))
        vec = []
        if block.num_rows:
            idf = told_idf(own.filter(pa.compute.is_valid(own["keys"])))
            for _, _, data, offsets in tb.pieces(*tb.strings(block["text"])):
                doc, shingle, weight = shingles(data, offsets, idf)
                short = (shingle >> np.uint64(32)).astype(np.uint32)
                cuts = np.searchsorted(doc, np.arange(len(offsets)))
                vec += [short[a:z].tobytes() + weight[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"node": block["node"].cast(pa.int64()), "vec": pa.array(vec, pa.binary())})

    return rows.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, "node long, vec binary")


def weighted_jaccard(a: bytes, b: bytes) -> float:
    n, m = len(a) // 8, len(b) // 8
    key = np.concatenate([np.frombuffer(a, np.uint32, n), np.frombuffer(b, np.uint32, m)])
    w = np.concatenate([np.frombuffer(a, np.float32, n, 4 * n), np.frombuffer(b, np.float32, m, 4 * m)]).astype(np.float64)
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    both = np.minimum(w[same], w[same + 1]).sum()
    total = w.sum() - both
    return float(both / total) if total > 0 else 0.0


def beside(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with va and vb, the vectors of both; a should be the side of fewer different nodes.

    Vectors are dealt by node once, for b, and of these the ones that stand as a go on. A node of many pairs meets them in a join that may be split by skew:
    its sides are plain shuffles.
    """
    right = vecs.select(F.col("node").alias("b"), F.col("vec").alias("vb"))
    left = vecs.select(F.col("node").alias("a"), F.col("vec").alias("va")).join(pairs.select("a").distinct(), "a", "left_semi")
    return pairs.join(right, "b").join(left, "a")


def verified(pairs: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of those pairs whose similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [weighted_jaccard(x.as_buffer(), y.as_buffer()) >= threshold for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).columns, names=["a", "b"])

    return beside(pairs, vecs).select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of links (a, b): comp is the least node of the connected component.

    Each round a node and the node it was named after both take the least label around the first, then the label of that label; a written
    table a round. As whole regions move with the node they are named after, rounds stay few in any order of nodes. Ends when nothing moves.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dup-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "dup-labels")
    moved = True
    while moved:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("mid"))
        named = step.filter("mid < old").groupBy(F.col("old").alias("node")).agg(F.min("mid").alias("hook"))
        hooked = written(step.join(named, "node", "left").select("node", "old", F.least("mid", F.coalesce("hook", "mid")).alias("mid")), "dup-hooks")
        jump = hooked.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        new = written(hooked.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("comp")), "dup-labels")
        dropped(labels)
        dropped(hooked)
        moved = new.filter("old <> comp").limit(1).count() > 0
        labels = new.select("node", "comp")
    dropped(both)
    return labels


def candidates(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node, n): members of the bands that two or more texts share, with the band's size."""
    key = lambda i: F.xxhash64(F.lit(i), *(F.get("sig", F.lit(i * rows + j)) for j in range(rows)))
    members = sigs.select("node", F.explode(F.array(*(key(i) for i in range(bands)))).alias("key"))
    # Sums are written before they are joined to what they were taken from: a join of two plain shuffles can split a hot key.
    shared = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "dup-shared")
    found = written(members.join(shared, "key"), "dup-members")
    dropped(shared)
    return found


def starred(members: DataFrame) -> DataFrame:
    """(a, b): each member of a band with three of its members: the first, the last, and the one that shares most places of all its bands.

    Of a group of near copies the last is the one nearest to what they were copied from.
    """
    degree = members.groupBy("node").agg(F.sum("n").alias("deg"))
    ends = members.join(degree, "node").groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max(F.struct("deg", "node"))["node"].alias("mid"))
    ends = written(ends, "dup-ends")
    star = members.join(ends, "key").select("node", F.explode(F.array_distinct(F.array("low", "high", "mid"))).alias("to"))
    pairs = written(oriented(star), "dup-star")
    dropped(ends)
    return pairs


def oriented(star: DataFrame) -> DataFrame:
    """(a, b) for rows (node, to) of two different nodes: to and node, each pair once, whichever of the two is the centre."""
    once = star.filter("node <> to").groupBy(F.least("node", "to").alias("x"), F.greatest("node", "to").alias("y")).agg(F.min("to").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))


def within(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of df whose node is one of nodes; a list of some megabytes is broadcast, a longer one is met in a shuffle."""
    own = nodes.select("node").distinct()
    return df.join(F.broadcast(own) if own.count() * 16 <= LISTED_BYTES else own, "node", "left_semi")


def masses(vecs: DataFrame) -> DataFrame:
    """(node, t, u): a text's whole weight, and the weight of its shingles that no other of these texts has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, vec in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = vec.as_buffer()
                n = data.size // 8
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, np.int32, n)), pa.array(np.full(n, node)), pa.array(np.frombuffer(data, np.float32, n, 4 * n).astype(np.float64))], names=["sh", "node", "w"])

    rows = vecs.select("node", "vec").mapInArrow(run, "sh int, node long, w double")
    once = rows.groupBy("sh").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("node"), F.max("w").alias("w")).filter("n = 1").groupBy("node").agg(F.sum("w").alias("u"))
    return rows.groupBy("node").agg(F.sum("w").alias("t")).join(once, "node", "left").select("node", "t", F.coalesce("u", F.lit(0.0)).alias("u"))


def split_bands(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, comp): members of the bands that still hold several components."""
    known = members.filter("n > 2").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    split = written(known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key"), "dup-split")
    found = written(known.join(split, "key"), "dup-open")
    dropped(split)
    return found


def plainest(open_: DataFrame, mass: DataFrame) -> DataFrame:
    """(key, to): of each split band the member that has the least share of weight alone. What a copy has alone is what was changed in it."""
    rated = open_.join(mass, "node").filter("t > 0").withColumn("alone", F.col("u") / F.col("t"))
    return rated.groupBy("key").agg(F.min(F.struct("alone", "node"))["node"].alias("to"))


def common(vecs: list[bytes]) -> bytes:
    """The vector of the shingles that at least half of these have, each with its least weight there."""
    parts = [(np.frombuffer(v, np.uint32, len(v) // 8), np.frombuffer(v, np.float32, len(v) // 8, len(v) // 2)) for v in vecs]
    key, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    least = np.full(len(key), np.inf, np.float32)
    np.minimum.at(least, of, np.concatenate([w for _, w in parts]))
    many = 2 * np.bincount(of, minlength=len(key)) >= len(vecs)
    return key[many].tobytes() + least[many].tobytes()


def centred(open_: DataFrame, mass: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """(key, to): the centre of each split band, a member near to what its members have in common.

    Bands of one plainest member are a group. In groups of more than SURVEYED members the centre becomes the member that differs least from what
    at least half of some SURVEYED of them have. Which member is the centre decides how much work is left, not which links are found.
    """
    first = written(plainest(open_, mass), "dup-plainest")
    group = written(open_.join(first, "key").select("to", "node").distinct(), "dup-groups")
    sizes = written(group.groupBy("to").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SURVEYED), "dup-sizes")
    large = written(group.join(sizes, "to"), "dup-large")
    some = large.filter(F.pmod(F.xxhash64("node", F.lit(23)), F.lit(1 << 30)) * F.col("n") < F.lit(SURVEYED << 30)).select("to", "node").join(vecs, "node").select("to", "vec")

    def agree(key, rows):
        return pa.table({"to": pa.array([key[0].as_py()], pa.int64()), "core": pa.array([common(rows["vec"].to_pylist())], pa.binary())})

    core = written(some.groupBy("to").applyInArrow(agree, "to long, core binary"), "dup-cores")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = []
            for c, v in zip(batch.column(2), batch.column(3), strict=True):
                _, side, w = edits(c.as_py(), v.as_py())
                cost.append(float(w[side == 0].sum() + threshold * w[side == 1].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cost, pa.float64())], names=["to", "node", "cost"])

    rated = large.select("to", "node").join(core, "to").join(vecs, "node").select("to", "node", "core", "vec").mapInArrow(apart, "to long, node long, cost double")
    better = written(rated.groupBy("to").agg(F.min(F.struct("cost", "node"))["node"].alias("new")), "dup-centres")
    found = written(first.join(better, "to", "left").select("key", F.coalesce("new", "to").alias("to")), "dup-centred")
    for x in (first, group, sizes, large, core, better):
        dropped(x)
    return found


def grouped(open_: DataFrame, centres: DataFrame) -> DataFrame:
    """(to, node, comp): the members of split bands by their centres."""
    return written(open_.join(centres, "key").select("to", "node", "comp").distinct(), "dup-grouped")


def edits(centre: bytes, vec: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, side, weight) of the difference of a text from its centre: side 0 is weight that the text lacks, side 1 weight that it has beyond the centre."""
    n, m = len(centre) // 8, len(vec) // 8
    key = np.concatenate([np.frombuffer(centre, np.uint32, n), np.frombuffer(vec, np.uint32, m)])
    w = np.concatenate([-np.frombuffer(centre, np.float32, n, 4 * n).astype(np.float64), np.frombuffer(vec, np.float32, m, 4 * m)])
    found, of = np.unique(key, return_inverse=True)
    change = np.bincount(of, weights=w, minlength=len(found))
    at = np.flatnonzero(change)
    return found[at].view(np.int32), (change[at] > 0).astype(np.int8), np.abs(change[at])


def changes(group: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """(to, node, comp, far, need, sh, side, w): the edits that make each member from its centre; far: its similarity to the centre is below the threshold.

    Let T be the centre's weight, L and U what a member lacks and adds, e = L + s U. If two members x and y share a weight o of their edits, their
    similarity is (T - Lx - Ly + o) / (T + Ux + Uy - o), so it reaches s only if o >= (ex + ey - (1 - s) T) / (1 + s). A member is far if
    e > (1 - s) T, so a partner y of a far one shares ey / (1 + s) of its edits with it: need. Where what y has of the centre doesn't make up s of y,
    it has to share s of y less that, of its additions alone; then only these are searched, and w is 0 for the others.
    """
    fields = [("to", pa.int64()), ("node", pa.int64()), ("comp", pa.int64()), ("far", pa.bool_()), ("need", pa.float64()), ("sh", pa.int32()), ("side", pa.int8()), ("w", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, node, comp = (batch.column(i).to_pylist() for i in range(3))
            for i, (c, v) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                c, v = c.as_buffer().to_pybytes(), v.as_buffer().to_pybytes()
                sh, side, w = edits(c, v)
                whole, own = (float(np.frombuffer(x, np.float32, len(x) // 8, len(x) // 2).sum(dtype=np.float64)) for x in (c, v))
                adds = float(w[side == 1].sum())
                e = float(w[side == 0].sum()) + threshold * adds
                far, need = e > (1 - threshold) * whole * (1 - 1e-6), e / (1 + threshold)
                if (alone := threshold * own - (own - adds)) > 1e-6 * own:
                    need, w = alone, np.where(side == 1, w, 0.0)
                told = np.full(len(sh), True) if far else w > 0
                columns = [np.full(told.sum(), x) for x in (to[i], node[i], comp[i], far, need * (1 - 1e-6))] + [x[told] for x in (sh, side, w)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    joined = beside(group.select(F.col("to").alias("a"), F.col("node").alias("b"), "comp"), vecs)
    return joined.select("a", "b", "comp", "va", "vb").mapInArrow(run, "to long, node long, comp long, far boolean, need double, sh int, side tinyint, w double")


def across(group: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of members of one centre, of different components, that may still reach the threshold.

    Two members that are both near the centre are linked by way of it, so one of each pair is far from it. Of the other's edits, the rarest are
    looked up among the edits of far members: so many that the rest weighs less than what a pair has to share. Copies that were changed apart
    from each other share next to no rare edits, so a group of near copies costs its size and not its square, and no link is left out.
    """
    token = Window.partitionBy("to", "sh", "side")
    counted = changes(group, vecs, threshold).withColumns({"all": F.count(F.lit(1)).over(token), "n": F.sum(F.col("far").cast("int")).over(token)})
    # Edits that stand alone, most of them, can't be met; being the rarest, they don't count in the weight of the more frequent ones either.
    shared = written(counted.filter("all > 1 and n > 0").withColumn("n", F.col("n") - F.col("far").cast("int")).drop("all"), "dup-edits")
    rest = Window.partitionBy("to", "node").orderBy(F.desc("n"), "sh", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    probes = shared.filter("w > 0 and n > 0").withColumn("rest", F.sum("w").over(rest)).filter("rest >= need")
    met = shared.filter("far").select("to", "sh", "side", F.col("node").alias("other"), F.col("comp").alias("apart"))
    found = probes.select("to", "sh", "side", "node", "comp").join(met, ["to", "sh", "side"]).filter("comp <> apart")
    pairs = written(found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "dup-across")
    dropped(shared)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, comp, class_id) for every row of docs: class_id is the least doc_id of its class.

    comp is the class itself: the least node in it. Where ids are null or repeat, different classes may have one class_id. node is the 64-bit hash of
    the text: equal texts are one node and so one class; a null text is a node of its own. Texts without a word are linked to equal texts only. A null
    id is larger than others: a class of null ids alone has a null class_id. An empty table gives an empty result. A text of any length is one vector
    of all its shingles. Only id_col and text_col are read.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    blocks = max(1, -(-(total["bytes"] or 0) // BLOCK))
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block")
    texts = docs.select(block, F.xxhash64(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = texts.repartition(blocks, "block")
    found = written(sampled(dealt, word_weights(dealt, blocks, total["n"]), bands, rows), "dup-sampled")
    told = found.filter("node is null").select("block", "part", "keys", "idf")
    sigs = written(found.filter("node is not null").select("node", "sig").dropDuplicates(["node"]), "dup-samples")
    members = candidates(sigs, bands, rows)

    dropped(sigs)
    pairs = starred(members)
    # One block for each text that shares a band, found without the texts themselves.
    chosen = written(texts.select("node", "block").distinct().join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("block").alias("block")), "dup-chosen")
    vecs = written(vectors(dealt, told, chosen), "dup-vectors")
    dropped(chosen)
    dropped(found)
    links = written(verified(pairs, vecs, threshold), "dup-links")
    comps = components(links)
    open_ = split_bands(members, comps)
    if open_.limit(1).count():
        # The vectors that are still needed, a part of all.
        own = written(within(vecs, open_), "dup-vectors")
        mass = written(masses(own), "dup-masses")
        centres = centred(open_, mass, own, threshold)
        group = grouped(open_, centres)
        seen = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        near = oriented(group).withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(seen, ["x", "y"], "left_anti").select("a", "b")
        more = written(verified(near, own, threshold), "dup-links")
        if more.limit(1).count():
            links = links.unionByName(more)
            for x in (comps, open_, group):
                dropped(x)
            comps = components(links)
            open_ = split_bands(members, comps)
            group = grouped(open_, centres)
        rest = across(group, own, threshold)
        last = written(verified(rest, own, threshold), "dup-links")
        if last.limit(1).count():
            dropped(comps)
            comps = components(links.unionByName(last))
        for x in (own, mass, centres, group, rest, last, more):
            dropped(x)
    for x in (open_, vecs, pairs, members):
        dropped(x)
    return classes(docs, comps, id_col, text_col)


def classes(docs: DataFrame, comps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, comp, class_id) for every row: the least id is found for each text, then for each component, and told back to rows by way of texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("node"))
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    of_text = written(least.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "least"), "dup-texts")
    of_class = written(of_text.groupBy("comp").agg(F.min("least").alias("class_id")), "dup-classes")
    told = written(of_text.join(of_class, "comp").select("node", "comp", "class_id"), "dup-told")
    for x in (comps, of_text, of_class):
        dropped(x)
    return rows.join(told, "node").select("doc_id", "node", "comp", "class_id")


def op6(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: one that has the class's least id; columns unchanged.

    Classes of null ids alone keep a row each; of rows of one id and text one stays; an empty table gives an empty one; texts of any length are compared whole.
    """
    kept = near_duplicates(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("comp", "class_id").agg(F.min("node").alias("__node"))
    rows = docs.withColumn("__of", F.xxhash64(text_col)).withColumn("__id", F.col(id_col))
    number = F.row_number().over(Window.partitionBy("__id", "__of").orderBy(F.lit(0)))
    met = rows.join(kept, rows["__id"].eqNullSafe(kept["class_id"]) & (rows["__of"] == kept["__node"])).withColumn("__row", number).filter("__row = 1")
    return met.select(*(rows[c] for c in docs.columns))
