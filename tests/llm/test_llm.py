"""Corpus operators against brute force, round trips or held-out accuracy, with the odd cases: nulls, empty and long texts, ties, repeats, empty tables, other columns."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import common, decontaminate, html, langid, licenses, lm, mixing, mtree, neardup, quality, sharding
from lumenframe.llm import textblocks as tb

LOWER = str.maketrans(common.UPPER, common.LOWER)
ALNUM, SPACE = re.compile(common.ALNUM_WORD), re.compile(common.SPACE_WORD)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, words string, shard int"


def words(t, pattern=ALNUM):
    return pattern.findall((t or "").translate(LOWER))


def made(seed=1, n=120):
    """Documents in two invented languages, with copies, near copies, nulls and odd texts."""
    random = np.random.default_rng(seed)
    letters = {"aa": "bdgk aeio", "bb": "mnrs uyäö"}
    vocab = {k: ["".join(random.choice(list(v.split()[j % 2])) for j in range(random.integers(2, 8))) for _ in range(400)] for k, v in letters.items()}
    rows = []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        rows.append((i, " ".join(random.choice(vocab[lang], random.integers(5, 90))).capitalize() + ".", lang, f"s{i % 5}" if i % 7 else None))
    rows += [(1000 + i, rows[i % 4][1], rows[i % 4][2], "s0") for i in range(40)]
    near = rows[8][1].split()
    for i in range(20):
        edit = list(near)
        edit[(i * 7) % len(edit)] = f"changed{i}"
        rows.append((2000 + i, " ".join(edit), rows[8][2], "s1"))
    rows += [(3000, None, "aa", "s0"), (3001, "", "aa", None), (3002, "...!!! 123", None, "s2"), (3003, "word " * 20000, "aa", "s3"), (None, "no id here at all", "aa", "s1"), (3004, "　 \x00 tab\tline\n", "bb", "s1"), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", 7) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_text_blocks():
    texts = ["", "Ab c", None, "é—x  y", "a", " "]
    data, at = tb.strings(pa.array(texts))
    gap, low = tb.table(tb.SPACES)
    s, e, d = tb.spans(~gap[data], at)
    got = [(int(k), bytes(low[data][a:b]).decode()) for a, b, k in zip(s, e, d, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in words(t, SPACE)]
    h = tb.hashes(low[data], s, e)
    assert len(set(h.tolist())) == len({w for _, w in got})
    assert [x[:2] for x in tb.pieces(data, at, 4)][-1][1] == len(texts)


def test_language(docs, rows, empty):
    got = langid.op1(docs).toPandas()
    assert len(got) == len(rows)
    by = {(r.doc_id if r.doc_id == r.doc_id else None): r for r in got.itertuples()}
    for i, text, lang, _ in rows:
        r = by[i]
        assert bool(r.held_out) == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert r.lang_pred == "und" and r.score == 0
    good = [by[i].lang_pred == lang for i, _, lang, _ in rows if i is not None and i < 120 and by[i].held_out]
    assert np.mean(good) > 0.95
    assert langid.op1(empty).count() == 0


def test_language_proportions():
    logp = np.log(np.full((langid.BUCKETS, 2), 1e-6, np.float32))
    for k, t in enumerate(["aba bab abab", "xyx yxy xyxy"]):
        data, at = tb.strings(pa.array([t]))
        logp[langid.trigrams(data, at)[0], k] = np.log(0.1)
    data, at = tb.strings(pa.array(["aba " * 60 + "xyx " * 40, "aba bab abab"]))
    top, share = langid.infer(data, at, logp.astype(np.float32))
    assert top.tolist() == [0, 0] and abs(share[0, 1] - 0.4) < 0.02 and share[1].tolist() == [1, 0]


def test_language_mix_of_four(spark):
    import corpus_pipeline

    random = np.random.default_rng(8)
    letters = ["abde", "fghi", "jklm", "nopr"]
    vocab = [["".join(random.choice(list(x), 5)) for _ in range(60)] for x in letters]
    text = lambda *n: " ".join(w for k, m in enumerate(n) for w in random.choice(vocab[k], m))
    rows = [(i, text(*(40 * (k == i % 4) for k in range(4))), "ABCD"[i % 4]) for i in range(200)] + [(1000, text(50, 50, 50, 50), None), (1001, text(80, 40, 40, 40), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = {r["doc_id"]: r for r in langid.identify(df).filter("doc_id >= 1000").collect()}
    for i, want in ((1000, [0.25] * 4), (1001, [0.2, 0.2, 0.2, 0.4])):
        assert sorted(mixed[i]["languages"]) == list("ABCD") and np.allclose(sorted(mixed[i]["shares"]), want, atol=0.02)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, df, "").collect()}
    assert 1000 not in kept and 1001 in kept and len(kept) == 201


def test_shards(docs, rows, empty):
    got = sharding.shard(docs, 7).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"rows"}
    n = got.groupby("shard").size().reindex(range(7), fill_value=0)
    assert n.max() - n.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    want = Counter((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"], strict=True)) == want
    pairs = got[(got["group_rows"] > 1) & (got["group_rows"] <= 20)]
    assert (pairs["group_shards"] == 1).mean() > 0.8
    assert sharding.shard(empty).count() == 0
    kept = sharding.sharded(docs, 7)
    assert kept.columns == [*(c for c in docs.columns if c != "shard"), "shard", "slot"] and kept.count() == len(rows)


def test_mix(docs, rows, empty):
    got = mixing.op3(docs).toPandas()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(SPACE.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    total, stopped = 1.5 * sum(size.values()), {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in stopped}
        level = (total - sum(stopped.values())) / sum(rest.values())
        over = {s: 2.0 * size[s] for s, w in rest.items() if level * w >= 2 * size[s]}
        if not over:
            break
        stopped |= over
    target = {s: stopped.get(s, level * weight[s]) for s in order}
    source = {i: s for i, _, _, s in rows}
    got["source"] = [source[None if i != i else int(i)] for i in got["doc_id"]]
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    for s, g in got.groupby(got["source"].fillna("none")):
        s = None if s == "none" else s
        assert abs(g["target"].iloc[0] - target[s]) < 1e-6 * target[s] and g["source_size"].iloc[0] == size[s]
        # Whole copies can miss by half of a document that outweighs all the others of its source.
        assert abs(g["taken"].sum() - target[s]) <= max(0.02 * target[s], 3, g["size"].max() / 2 if g["size"].max() > g["size"].sum() / 2 else 0)
    again = mixing.op3(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, again[key].fillna(-1).values.tolist())) == sorted(map(str, got[key].fillna(-1).values.tolist()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == got["copies"].sum()
    assert mixing.op3(empty).count() == 0


def test_mix_of_sources_without_words(spark):
    rows = [(1, "", "a"), (2, None, "a"), (3, "x y z", "b"), (4, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.op3(df).collect()}
    assert len(got) == 4 and got[1]["target"] == got[2]["target"] == got[4]["target"] == 0 and got[1]["taken"] == 0
    assert got[3]["source_size"] == 3 and abs(got[3]["target"] - 4.5) < 1e-9 and got[3]["taken"] in (3, 6)
    only = mixing.op3(df.filter("doc_id < 3")).collect()
    assert [(r["target"], r["taken"]) for r in only] == [(0, 0), (0, 0)]


def test_quality(spark, docs, empty):
    random = np.random.default_rng(1)
    good = lambda: " ".join("".join(random.choice(list("abcdefgh"), 5)) for _ in range(40))
    rows = [(i, good() if i % 2 else " ".join(w + "%%" for w in good().split())) for i in range(300)] + [(900, None), (901, ""), (902, "z"), (903, good() * 200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(5, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.op4(d, labels).toPandas().set_index("doc_id")
    held = [i for i in range(300) if got.loc[i, "held_out"]]
    assert all(got.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got.index)
    assert np.mean([got.loc[i, "predicted"] == i % 2 for i in held]) > 0.95
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert quality.op4(empty, labels.limit(0)).count() == 0 and quality.op4(docs, labels.limit(0)).count() == docs.count()


def test_network_sees_the_whole_text():
    net = quality.Network()
    texts = ["ab" * 3000, "ab" * 3000 + "%%%%%"]
    data, at = tb.strings(pa.array(texts))
    text, first, doc, end = quality.padded(data, at)
    half, _ = net.halves(text, first, end)
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode() + bytes(quality.WIDTH - 1), np.uint8)
        x = sum(net.w[j][raw[j : j + len(t)]] for j in range(quality.WIDTH))
        assert np.allclose(half[doc == k].max(0), np.maximum(x.max(0) + net.b, 0), atol=1e-5)


def test_top_k(spark, empty):
    random = np.random.default_rng(2)
    v = random.normal(0, 0.3, (400, 8)).astype(np.float32)
    v[50:120] = v[3]
    rows = [(int(i), [float(x) for x in v[i]], "c") for i in range(400)] + [(1000, None, "c"), (1001, [None] * 8, "c"), (1002, [float("nan")] * 8, "c"), (1020, [float("inf")] * 8, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    w = np.floor(64 * v.astype(np.float64)).astype(np.int64)
    s = w @ w.T
    for tree_rows in (64, 8192):
        got = mtree.top_k(df, tree_rows=tree_rows).toPandas()
        want = [(q, r + 1, int(i), int(s[q, i])) for q in range(0, 400, 20) for r, i in enumerate(sorted((i for i in range(400) if i != q), key=lambda i: (-s[q, i], i))[:20])]
        assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].values.tolist())) == sorted(want)
    assert mtree.top_k(df.limit(0)).count() == 0
    few = mtree.top_k(df.filter("vec_id < 6")).toPandas()
    assert len(few) == 5


def test_tree_avoids_computations():
    random = np.random.default_rng(3)
    centres = random.integers(-200, 200, (20, 6))
    v = np.repeat(centres, 50, axis=0) + random.integers(-2, 3, (1000, 6))
    tree = mtree.MTree(np.arange(1000), v, page=25, fanout=5)
    for q in range(0, 1000, 50):
        scores, ids = tree.search(v[q], q, 10)
        s = v @ v[q]
        want = sorted((i for i in range(1000) if i != q), key=lambda i: (-s[i], i))[:10]
        assert ids.tolist() == want and scores.tolist() == [s[i] for i in want]
    assert tree.avoided > 0 and tree.computed < 20 * 1000 / 5  # most pages are never opened
    least = int(sorted(v @ v[0])[-10])
    before = tree.computed
    tree.search(v[0], 0, 10)
    alone, before = tree.computed - before, tree.computed
    scores, ids = tree.search(v[0], 0, 10, least)
    assert tree.computed - before <= alone and min(scores) >= least and ids[0] == tree.search(v[0], 0, 10)[1][0]


def brute_classes(rows):
    w = [words(t) for _, t, _, _ in rows]
    distinct = {t: words(t) for _, t, _, _ in rows}
    n = len(rows)
    df = Counter(x for ws in w for x in set(ws))
    idf = {x: math.log((n + 1) / (c + 1)) + 1 for x, c in df.items()}
    vec = {}
    for t, ws in distinct.items():
        c = Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else {}
        vec[t] = {g: m * sum(idf[x] for x in g) / len(g) for g, m in c.items()}
    keys = list(vec)
    up = {t: t for t in keys}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if vec[a] and vec[b]:
                both = sum(min(x, vec[b][g]) for g, x in vec[a].items() if g in vec[b])
                if both / (sum(vec[a].values()) + sum(vec[b].values()) - both) >= 0.8:
                    up[top(a)] = top(b)
    least = {}
    for i, t, _, _ in rows:
        least.setdefault(top(t), []).append(math.inf if i is None else i)
    return Counter((i, min(least[top(t)])) for i, t, _, _ in rows)


def test_near_duplicates(docs, rows, empty):
    got = neardup.op6(docs).collect()
    assert Counter((r["doc_id"], math.inf if r["class_id"] is None else r["class_id"]) for r in got) == brute_classes(rows)
    kept = neardup.deduplicated(docs)
    classes = {c for _, c in brute_classes(rows)}
    assert kept.columns == docs.columns and kept.count() == len(classes)
    assert neardup.op6(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_classes_of_null_and_repeated_ids_stay_apart(spark):
    random = np.random.default_rng(6)
    text = lambda: " ".join("".join(random.choice(list("abcdefgh"), 6)) for _ in range(30))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, c), (None, c), (None, None), (7, d), (7, e), (8, d), (9, a + " more"), (5, "x " + b)]
    kept = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(9, a + " more"), (5, "x " + b), (None, c), (None, None), (7, d), (7, e)])


def test_weights_in_a_large_vocabulary(spark):
    random = np.random.default_rng(9)
    common = [f"c{k}" for k in range(80)]
    rows = [(i, " ".join(random.permutation(common))) for i in range(200)]
    for k in range(20):
        text = list(random.permutation(common)[: 56 if k % 2 else 62])
        edit = text[:25] + [f"unique{k}"] + text[26:]
        rows += [(1000 + 2 * k, " ".join(text)), (1001 + 2 * k, " ".join(edit))]
    filler, n = 400, 400 + len(rows)
    df = Counter(w for _, t in rows for w in set(t.split()))
    idf = {w: math.log((n + 1) / (c + 1)) + 1 for w, c in df.items()}

    def vector(t):
        w = t.split()
        return Counter({tuple(w[k : k + 5]): sum(idf[x] for x in w[k : k + 5]) / 5 for k in range(len(w) - 4)})

    text, want = dict(rows), set()
    for k in range(1000, 1040, 2):
        a, b = vector(text[k]), vector(text[k + 1])
        if sum((a & b).values()) / sum((a | b).values()) >= 0.8:
            want.add(k + 1)
    assert want == {k + 1 for k in range(1000, 1040, 4)}
    more = spark.range(filler).selectExpr("5000 + id as doc_id", "array_join(transform(sequence(1, 5000), x -> concat('w', id * 5000 + x)), ' ') as text")
    got = neardup.op6(spark.createDataFrame(rows, "doc_id long, text string").unionByName(more)).filter("class_id <> doc_id").collect()
    assert {r["doc_id"] for r in got} == want and all(r["class_id"] == r["doc_id"] - 1 for r in got)


def test_edits_of_a_group_leave_out_no_link(spark):
    """All pairs of a group of copies, copies of copies, shortened and joined texts, against across(): no pair of two components that is alike is missing."""
    random = np.random.default_rng(21)
    base = random.permutation(4000)[:160].tolist()
    texts = [base]

    def changed(words, n):
        words = list(words)
        for _ in range(n):
            at, kind = int(random.integers(len(words))), random.random()
            words[at : at + (kind < 0.7)] = [] if kind < 0.3 else [int(random.integers(4000, 9000))]
        return words

    for k in range(90):
        texts.append(changed(base, int(random.integers(1, 14))))
        if k % 3 == 0:  # families that share what was changed first
            texts += [changed(texts[-1], int(random.integers(1, 5))) for _ in range(3)]
        if k % 9 == 0:
            texts.append(base[: int(random.integers(40, 150))])
            texts.append(random.integers(9000, 20000, 60).tolist() + base[40:100])
            texts += [texts[-1][: -int(random.integers(1, 12))] for _ in range(2)]
    vec = {}
    for i, t in enumerate(texts):
        of = {}
        for k in range(len(t) - 4):
            key = hash(tuple(t[k : k + 5])) & 0xFFFFFFFF
            of[key] = of.get(key, 0.0) + 1.0 + (key % 7) / 4
        keys = np.array(sorted(of), np.uint32)
        vec[i] = keys.tobytes() + np.array([of[int(x)] for x in keys], np.float32).tobytes()
    like = lambda i, j: neardup.weighted_jaccard(vec[i], vec[j])
    vecs = spark.createDataFrame([(i, bytearray(v)) for i, v in vec.items()], "node long, vec binary")
    comp = {i: 0 if like(0, i) >= 0.8 else i for i in vec}
    assert 20 < sum(c == 0 for c in comp.values()) < len(texts) - 60
    group = spark.createDataFrame([(0, 0, i, c) for i, c in comp.items()], "to long, own long, node long, comp long")
    got = {(r["a"], r["b"]) for r in neardup.across(group, vecs, 0.8).collect()}
    want = {(i, j) for i in vec for j in vec if i < j and comp[i] != comp[j] and like(i, j) >= 0.8}
    assert len(want) > 30 and want <= got and len(got) < len(texts) ** 2 / 8


def test_components_of_a_long_path_in_random_order(spark):
    node = [int(x) for x in np.random.default_rng(7).permutation(1000)]
    links = spark.createDataFrame([(x, y) for k, (x, y) in enumerate(zip(node, node[1:])) if k != 699], "a long, b long")
    got = {r["node"]: r["comp"] for r in neardup.components(links).collect()}
    assert got == {x: min(part) for part in (node[:700], node[700:]) for x in part}


def test_samples_estimate_weighted_similarity():
    random = np.random.default_rng(4)
    a = random.choice(400, 300, replace=False)
    b = np.concatenate([a[:240], np.arange(1000, 1060)])
    doc = np.repeat([0, 1], 300)
    sh = np.concatenate([np.sort(tb.mixed(x.astype(np.uint64))) for x in (a, b)])
    w = np.ones(600, np.float32) * 3
    _, sig = neardup.icws(doc, sh, w, 2000)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.04


def test_language_model(docs, rows, empty):
    tok = [[*words(t, SPACE), None] for _, t, _, _ in rows]
    train = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in rows]
    c = Counter(x for ws, ok in zip(tok, train, strict=True) if ok for x in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(ws), sum(c[x] > 0 for x in ws), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ws), 6)) for (i, *_), ws in zip(rows, tok, strict=True))
    for block in (1 << 14, 1 << 24):
        got = lm.score(docs, block=block).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        scores = {r["doc_id"]: r["score"] for r in got}
        if block < 1 << 20:
            first = scores
    assert all(abs(scores[k] - first[k]) < 1e-6 * max(1, abs(first[k])) for k in scores)
    assert lm.score(empty).count() == 0
    none = lm.score(docs.filter("doc_id = 3000")).first()
    assert none["n_tokens"] == 1


def brute_model(trained):
    """Deleted interpolation as defined, on plain counts: P(word, v, u), its weights fitted to every single occurrence."""
    tri, pair, word, seen = Counter(), Counter(), Counter(), []
    for t in trained:
        toks = ["<s>", "<s>", *t, "</s>"]
        for k in range(2, len(toks)):
            seen.append((toks[k], toks[k - 1], toks[k - 2]))
    for w, v, u in seen:
        tri[u, v, w] += 1
        pair[v, w] += 1
        word[w] += 1
    before, context, total = Counter(), Counter(), len(seen)
    for (u, v, w), n in tri.items():
        context[u, v] += n
    for (v, w), n in pair.items():
        before[v] += n
    log = lambda x: int(math.log2(max(1, x)))
    bucket = lambda v, uv: log(uv) if uv > 0 else 64 + log(v)
    groups = {}
    for w, v, u in seen:
        a, b, c, d, e = tri[u, v, w] - 1, pair[v, w] - 1, word[w] - 1, before[v] - 1, context[u, v] - 1
        groups.setdefault(bucket(d, e), []).append((a / e if e else 0, b / d if d else 0, c / (total - 1), 1 / (len(word) + 1)))
    weights = {}
    for k, rows in groups.items():
        p, x = np.array(rows), np.full(4, 0.25)
        for _ in range(lm.ROUNDS):
            r = p * x
            x = (r / r.sum(1, keepdims=True)).mean(0)
        weights[k] = (1 - lm.FLOOR) * x + lm.FLOOR * np.array([0, 0, 0.5, 0.5])

    def probability(w, v, u):
        d, e = before[v], context[u, v]
        x = weights.get(bucket(d, e), np.array([0, 0, 0.5, 0.5])) * np.array([e > 0, d > 0, True, True])
        return float((x * np.array([tri[u, v, w] / e if e else 0, pair[v, w] / d if d else 0, word[w] / total, 1 / (len(word) + 1)])).sum() / x.sum())

    return probability, set(word)


def test_language_model_is_deleted_interpolation(spark):
    random = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(40)]
    share = 1 / np.arange(1, 41)
    texts = [(i, " ".join(random.choice(vocabulary, random.integers(0, 60), p=share / share.sum()))) for i in range(300)]
    texts += [(1000 + i, "w1 w2 w3 w4 unseen" + str(i % 9)) for i in range(60)]
    learned = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    probability, known = brute_model([t.split() for i, t in texts if learned(i)])
    for v, u in (("w1", "w2"), ("<s>", "<s>"), ("w39", "w38"), ("never", "w1"), ("w1", "never")):
        assert abs(sum(probability(w, v, u) for w in known) + probability("another", v, u) - 1) < 1e-9
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(texts, "doc_id long, text string"), block=1 << 13).collect()}
    for i, t in texts:
        toks = ["<s>", "<s>", *t.split(), "</s>"]
        want = sum(math.log10(probability(toks[k], toks[k - 1], toks[k - 2])) for k in range(2, len(toks)))
        assert abs(got[i] - want) < 0.01 * (len(toks) - 2)


def test_language_model_memory_of_a_block(spark):
    """A pass over a block takes little more than the sort of its keys, and the counts are summed once for N and V and once for both passes."""
    random = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in random.integers(0, 30000, 10000)) for _ in range(150)]
    n, bits = len(texts), 40
    rows = pa.table({"doc_id": pa.array(range(n)), "held_out": pa.array([False] * n), "learned": pa.array([True] * n), "text": pa.array(texts)})
    asked = lm.questions(1, bits)((pa.scalar(0, pa.int32()),), rows)
    told = pa.concat_tables([lm.answer((asked["kind"][i], asked["part"][i]), asked.slice(i, 1)) for i in range(asked.num_rows)])
    told = told.filter(pa.compute.equal(told["block"], 0))
    model = np.concatenate([[1.5e6 + n, 30001.0], np.tile([0.4, 0.3, 0.2, 0.1], lm.BUCKETS)]).tobytes()
    told = told.append_column("model", pa.array([model if k == 0 else None for k in told["kind"].to_pylist()], pa.binary()))
    extra = {"block": pa.array([0], pa.int32()), "kind": pa.array([lm.ORDER], pa.int32()), "part": pa.array([0], pa.int32()), "wide": pa.array([False]), "data": pa.array([model], pa.binary())}
    told = pa.concat_tables([told, pa.table(extra)], promote_options="default")
    for run in (lm.scored(pa.int64(), bits), lm.deleted(bits)):
        tracemalloc.start()
        run((pa.scalar(0, pa.int32()),), rows, told)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80 * 1.5e6
    plan = lm.score(spark.createDataFrame([(i, t[:2000]) for i, t in enumerate(texts)], "doc_id long, text string"), block=1 << 16)
    assert len(plan.collect()) == n
    done = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert done.count("answer(kind") == 2


def test_language_model_estimates_at_any_count():
    """Probabilities come from counts up to 2^62 as from small ones of the same ratios."""
    weights = np.tile([0.4, 0.3, 0.2, 0.1], (lm.BUCKETS, 1))
    small = [np.array([x], np.float64) for x in (8, 4, 2, 16, 8)]
    large = [x * 2.0**58 for x in small]
    p, q = lm.probabilities(*small, 64.0, 9.0, weights), lm.probabilities(*large, 64.0 * 2.0**58, 9.0, weights)
    assert np.allclose(p, q) and np.allclose(p, 0.4 * 0.25 + 0.3 * 0.25 + 0.2 * 0.125 + 0.1 * 0.1)
    assert lm.bucket(np.array([2.0**62]), np.array([0.0])).tolist() == [126] and lm.bucket(np.array([1.0]), np.array([2.0**62])).tolist() == [62]


def brute_hits(text, items):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        k = min(10, len(iw))
        for a in range(len(iw) - k + 1) if k else ():
            for p in range(len(w) - k + 1):
                if w[p : p + k] == iw[a : a + k]:
                    hit |= set(range(p, p + k))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontamination(spark, docs, rows, empty):
    a, b = rows[1][1].split(), rows[9][1].split()
    items = [(1, " ".join(a[2:20])), (2, " ".join(b[:12]).upper()), (3, "word word word"), (4, None), (5, "..."), (10, "word " * 14), (11, " ".join(a[:9] + ["other"] + a[9:30])), (1, " ".join(a[2:20]))]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, words string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.op8(docs, bench).collect())
    assert got == Counter((i, *brute_hits(t, items)) for i, t, _, _ in rows)
    assert decontaminate.op8(empty, bench).count() == 0 and decontaminate.op8(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_proximity_of_the_rarest_words(spark):
    """A window's two rarest words in order, up to three words nearer or further apart; the phrase itself is a hit and no proximity match."""
    common = "of the and to in on at by we"
    docs = [(1, f"{common} alpha x y beta {common}"), (2, f"{common} alpha x y z q beta"), (3, "alpha x y 1 2 3 4 5 beta"), (4, "beta x y alpha"), (5, "alpha beta"), (6, None), (7, f"{common} " * 9), (None, "alpha x y of beta")]
    bench = [(9, "alpha x y beta"), (8, "single"), (7, "single and more")]
    got = {r["id"]: r for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert {i for i, r in got.items() if r["items"]} == {1} and got[1]["n_hit"] == 4 and got[1]["near"] == []
    # The rarest of alpha, x, y and beta are those that stand least often: x and y, which stand together in five texts.
    rare = sorted((sum((t or "").split().count(w) for _, t in docs), k, w) for k, w in enumerate("alpha x y beta".split()))[:2]
    (_, k1, w1), (_, k2, w2) = rare
    for i, t in docs:
        ws = (t or "").split()
        want = any(w1 == a and w2 == b and 1 <= abs(q - p - (k2 - k1)) <= 3 for p, a in enumerate(ws) for q, b in enumerate(ws))
        assert (got[i]["near"] == ["9"]) == want, (i, got[i], rare)


def test_a_word_that_repeats_through_document_and_item(spark):
    docs = spark.createDataFrame([(1, "word " * 3000), (2, "word " * 9), (3, "other")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.op8(docs, spark.createDataFrame([(1, "word " * 400)], "item_id long, text string")).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"]) for i in (1, 2, 3)] == [(3000, 1), (0, 0), (0, 0)]


def test_main_text(spark):
    pages = [
        (1, "u", "<html><head><title>T</title></head><body><nav><ul><li><a href='/'>home</a></li><li><a href='/x'>about</a></li></ul></nav><article><h1>A &amp; B</h1><p>First  para\n graph of some length, with commas.<p>Second <b>bold</b> one follows here.<script>var x='<p>no</p>'</script></article><footer>&copy; all rights reserved</footer></body></html>"),
        (2, None, None), (None, "v", ""), (3, "w", "<"), (4, "x", "plain &lt;text&gt; <"),
    ]
    df = spark.createDataFrame([(*p, "n") for p in pages], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): r for r in html.extract(df).collect()}
    assert got[1, "u"]["text"] == "A & B\n\nFirst para graph of some length, with commas.\n\nSecond bold one follows here."
    assert len(got) == 5 and got[2, None]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.extract(df.limit(0)).count() == 0


def test_only_raw_text_runs_to_the_end_of_a_page():
    for tag in ("video src=x", "audio src=x", "svg width=1", "math", "object data=x", "canvas", "noscript", "template"):
        found = [t for t, _, _ in html.blocks(f"<article><p>One.</p><{tag}><p>Two.</p><p>Three.</p></article><footer>End</footer>")]
        assert found == ["One.", "Two.", "Three.", "End"], tag
    found = html.blocks("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object data=y>a picture</object> <svg><path d='M0'/><text>b</text></svg>.</p><p>Next.")
    assert [t for t, _, _ in found] == ["Let x=1 and a picture b.", "Next."]
    for tag in ("script", "style", "textarea", "iframe", "xmp", "noembed", "noframes"):
        assert [t for t, _, _ in html.blocks(f"<p>One.</p><{tag}><p>Two.</p>")] == ["One."]


def test_labeller_on_new_pages():
    net = html.trained()
    found = html.examples(60, 1234)
    prob = net.label([html.blocks(p) for _, _, p in found])
    assert np.mean(np.concatenate([(p >= 0.5) == y for p, (_, y, _) in zip(prob, found, strict=True)])) > 0.95


def test_labeller_gradient():
    random = np.random.default_rng(5)
    net = html.Labeller(size=4, hidden=3)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    x, mask = html.stacked([random.normal(size=(5, 4)).astype(np.float32), random.normal(size=(3, 4)).astype(np.float32)])
    y = (random.random(mask.shape) > 0.5).astype(np.float32)

    def loss():
        p = net.forward(x, mask)[0]
        return -(np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for k in ("wf", "ub", "o", "bb"):
        at = (0,) * net.params[k].ndim
        net.params[k][at] += 1e-3
        up = loss()
        net.params[k][at] -= 2e-3
        down = loss()
        net.params[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3


def test_licenses(spark, docs, rows, empty):
    notice = next(t for label, t in licenses.NOTICES if label == "bsd")
    texts = [(1, "Released under the MIT License."), (2, "Apache License, Version 2.0 and CC BY-NC 4.0 and cc by nc"), (3, "under the MIT and BSD license"), (4, None), (5, ""), (6, "x " + notice.replace("binary", "object binary") + " y"), (7, "under the mit license " * 300), (1, "Released under the MIT License."), (8, notice.split("are")[0][:30])]
    got = [r.asDict() for r in licenses.op10(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    for i, t in texts:
        w = words(t)
        places = sorted((p, label) for label, phrase in licenses.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
        r = by[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert by[6]["labels"] == "bsd" and by[8]["labels"] == ""
    assert licenses.op10(docs).count() == len(rows) and licenses.op10(empty).count() == 0


def test_license_labels_by_share_of_words(spark):
    """The first words of each notice, alone, after other words and with words put in: labelled if the share of its k-grams reaches the limit."""
    texts, want = [], {}
    share = lambda w, own: len({tuple(w[k : k + 3]) for k in range(len(w) - 2)} & (g := {tuple(own[k : k + 3]) for k in range(len(own) - 2)})) / len(g)
    for n, (label, notice) in enumerate(licenses.NOTICES):
        own = licenses.split(notice)
        for part, k in enumerate((0.3, 0.55, 0.65, 1.0)):
            cut = own[: round(len(own) * k)]
            for form, w in enumerate((cut, ["unrelated", "words"] * 5 + cut, [x for i, y in enumerate(cut) for x in ([y, "put"] if i % 11 == 10 else [y])])):
                i = n * 100 + part * 10 + form
                texts.append((i, " ".join(w)))
                want[i] = {x for x, t in licenses.NOTICES if share(w, licenses.split(t)) >= 0.6}
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(","))) for r in licenses.op10(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    base = {r["doc_id"]: set(filter(None, r["base_labels"].split(","))) for r in licenses.op10(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[i] | base[i] == want[i] | base[i] for i, _ in texts), [(i, got[i], want[i]) for i, _ in texts if got[i] | base[i] != want[i] | base[i]][:5]


def test_shards_replace_columns_of_their_names(spark):
    rows = spark.createDataFrame([(k, f"text {k % 3}", 9, "s") for k in range(20)], "doc_id long, text string, shard int, slot string")
    got = sharding.sharded(rows, 4)
    assert got.columns == ["doc_id", "text", "shard", "slot"] and sorted(r["doc_id"] for r in got.collect()) == list(range(20)) and {r["shard"] for r in got.collect()} == {0, 1, 2, 3}


def test_running_sums_in_pieces(spark):
    random = np.random.default_rng(8)
    rows = [(int(random.integers(3)), int(random.integers(1, 6)), k) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, n long, i long")
    for largest in (False, True):
        got = common.before(df, ["k"], "n", ["i"], F.col("i"), 8, "b", largest).collect()
        for k in range(3):
            own = sorted((r["b"], r["n"], r["i"]) for r in got if r["k"] == k)
            total = 0
            for b, n, _ in own:
                assert b == total
                total += n
            if largest:
                assert [n for _, n, _ in own] == sorted((n for _, n, _ in own), reverse=True)


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    for name, data, schema in (
        ("documents", [(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        ("benchmark", [(1, " ".join(rows[20][1].split()[:12]))], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = df.columns
    left = list(rows)
    for name, stage in corpus_pipeline.STAGES:
        df = common.written(stage(spark, df, str(tmp_path)), name)
        got = [(r["doc_id"], r["text"]) for r in df.collect()]
        if name == "language":
            left = [r for r in left if r[1] and any(c.isalpha() for c in r[1])]
        elif name == "near_duplicates":
            classes = brute_classes(left)
            assert len(got) == len({c for _, c in classes})
            left = [r for r in left if (r[0], r[1]) in set(got)]
            continue
        elif name == "decontamination":
            left = [r for r in {(a, b): (a, b, c, d) for a, b, c, d in left}.values() if not brute_hits(r[1], [(1, " ".join(rows[20][1].split()[:12]))])[1]]
        else:
            assert set(got) <= {r[:2] for r in left} and max(Counter(got).values()) <= 2
            continue
        assert Counter(got) == Counter(r[:2] for r in left)
        assert df.columns == columns
    n = df.groupBy("shard").count().toPandas()["count"]
    assert df.columns == [*columns, "shard", "slot"] and n.max() - n.min() <= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == df.count()
