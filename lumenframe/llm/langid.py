"""Language identification as mixture inference.

A word is a draw from one language; its likelihood there is that of its byte trigrams, spaces at both ends. Expectation-maximisation estimates
each document's language proportions from its words' likelihoods. The language set is chosen among the best one, two and more languages, up to all
that were learned, by likelihood less a penalty for each language beyond the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textblocks import pieces, spans, strings

BUCKETS = 1 << 16
#: Documents of a language that its n-gram counts are learned from, about; whole texts are counted.
PER_LANGUAGE = 2000
FOLDS, HELD = 4, 2

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def held_out(id_col: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    """Whether a document is kept from learning; a null id isn't held out, but isn't learned from either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == held, F.lit(False))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, first letter of each word, document of each word)."""
    text = _LETTERS[data]
    starts, ends, doc = spans(text != 32, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), starts, doc
    before, after = np.empty_like(text), np.empty_like(text)
    before[1:], after[:-1] = text[:-1], text[1:]
    before[starts], after[ends - 1] = 32, 32
    code = (before.astype(np.uint32) << 16) | (text.astype(np.uint32) << 8) | after
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    letters = np.flatnonzero(text != 32)
    return bucket[letters], np.searchsorted(letters, starts), doc


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, folds: int = FOLDS, held: int = HELD) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language) from documents outside the held-out fold whose language is known.

    At most about per_language documents of each language are read, picked by a hash of the id; counts are added up by (language, bucket). A null text counts
    nothing, a long one as a whole, repeated rows as often as they stand. Without a known language, as in an empty table, there are none and no numbers. What
    reaches the driver is a number for each language and bucket, so languages are taken to be few.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds, held))
    counts = sorted((r[0], r[1]) for r in known.groupBy(lang_col).count().collect())
    langs = [x for x, _ in counts]
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.element_at(F.create_map(*(F.lit(v) for x, n in counts for v in (x, min(1.0, per_language / n)))), F.col(lang_col))
    sample = known.filter(F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(1 << 20)) < share * (1 << 20)).select(lang_col, text_col)
    index = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(index), BUCKETS), np.int64)
        for batch in batches:
            of = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for i, _, data, offsets in pieces(*strings(batch.column(1))):
                bucket, words, doc = trigrams(data, offsets)
                if len(words):
                    lang = np.repeat(of[i + doc], np.diff(np.append(words, len(bucket))))
                    np.add.at(sums.reshape(-1), lang * BUCKETS + bucket, 1)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"lang": lang.astype(np.int32), "bucket": bucket.astype(np.int32), "n": sums[lang, bucket]})

    found = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    sums = np.full((BUCKETS, len(langs)), 0.05)
    sums[found["bucket"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
    return langs, np.log(sums / sums.sum(0)).astype(np.float32)


def proportions(like: np.ndarray, doc_first: np.ndarray, doc_of: np.ndarray, start: np.ndarray, steps: int) -> np.ndarray:
    """EM: like (words x languages) is scaled to a largest value of 1; start is 0 where a language is not in the set."""
    share, words = start, np.diff(np.append(doc_first, len(like))).astype(np.float32)[:, None]
    for _ in range(steps):
        resp = like * share[doc_of]
        resp /= resp.sum(1, keepdims=True) + 1e-30
        share = np.add.reduceat(resp, doc_first, axis=0) / words
    return share


def infer(data: np.ndarray, offsets: np.ndarray, logp: np.ndarray, penalty: float = 3.0, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(languages by document, best set's proportions): rows of documents without a letter are 0."""
    n, langs = len(offsets) - 1, logp.shape[1]
    out = np.zeros((n, langs), np.float32)
    bucket, words, doc = trigrams(data, offsets)
    if not len(words) or not langs:
        return np.zeros(n, np.int64), out
    ll = np.add.reduceat(logp[bucket], words, axis=0)
    # Words outside every language, such as codes, weigh no more than a clear preference.
    like = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -25.0))
    seen, first = np.unique(doc, return_index=True)
    of = np.searchsorted(seen, doc)
    count = np.diff(np.append(first, len(doc)))
    even = np.full((len(seen), langs), 1.0 / langs, np.float32)
    share = proportions(like, first, of, even, steps)
    order = np.argsort(-share, axis=1, kind="stable")
    alone = np.add.reduceat(np.log(like), first, axis=0)
    # The best single language is the one of largest likelihood; sets of two and more are the largest shares.
    best = alone.argmax(1)
    value, chosen = alone[np.arange(len(seen)), best].astype(np.float64), np.zeros_like(share)
    chosen[np.arange(len(seen)), best] = 1.0
    for size in range(2, langs + 1):
        allowed = np.zeros_like(share)
        np.put_along_axis(allowed, order[:, :size], np.maximum(np.take_along_axis(share, order[:, :size], 1), 1e-4), 1)
        own = proportions(like, first, of, allowed / allowed.sum(1, keepdims=True), steps // 2)
        fit_of = np.add.reduceat(np.log((like * own[of]).sum(1) + 1e-30), first) - penalty * (size - 1) * np.log(count + 1.0)
        better = fit_of > value
        value[better], chosen[better] = fit_of[better], own[better]
    out[seen] = chosen
    return out.argmax(1), out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", penalty: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, lang_pred, score, languages, shares) and the columns `keep` for every row of docs.

    score is the proportion of lang_pred in the document, 0 to 1; languages and shares list the whole chosen set, largest first. A null text or
    one without a letter is `und` with score 0 and no languages, as is every text if no language was learned. Equal texts get equal answers;
    ties go to the language that sorts first. An empty table gives an empty result.
    """
    langs, logp = model or fit(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((langs, logp))  # languages x 2^16 numbers, whatever the corpus
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    columns = list(dict.fromkeys([id_col, *keep]))
    fields = [T.StructField(c, docs.schema[c].dataType) for c in columns]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = sent.value
        for batch in batches:
            has = np.asarray(batch.column(len(columns) + 1).to_numpy(zero_copy_only=False), bool)
            preds, scores, sets, shares = [], [], [], []
            for i, _, data, offsets in pieces(*strings(batch.column(len(columns)))):
                top, share = infer(data, offsets, table, penalty)
                for k in range(len(top)):
                    if not has[i + k] or not names or not share[k].any():
                        preds.append("und"), scores.append(0.0), sets.append([]), shares.append([])
                        continue
                    order = [x for x in np.argsort(-share[k], kind="stable") if share[k, x] > 0]
                    preds.append(names[top[k]]), scores.append(min(1.0, float(share[k, top[k]])))
                    sets.append([names[x] for x in order]), shares.append([float(share[k, x]) for x in order])
            own = [pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *own], names=schema.names)

    return docs.select(*columns, F.col(text_col).alias("__text"), letter.alias("__letter")).mapInArrow(predict, schema)


def op1(docs: DataFrame) -> DataFrame:
    found = identify(docs)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")
