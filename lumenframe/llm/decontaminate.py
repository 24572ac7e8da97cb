"""Benchmark decontamination by a positional inverted index [native].

The index stores the places of every test term in the training texts, in the order of the texts: (document, term, place). Terms that stand in no
test item can't match and have no list. Of each window of an item the rarest terms are looked up first: a place p of the term at item word j
stands for the alignment p - j, and the lists of the window's two rarest terms are intersected on (document, item, alignment). Alignments that
are left are compared word by word, which gives exact phrases. Where the two terms stand in order but a few words nearer or further apart than
in the item, the window is a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, dropped, written

WINDOW = 10
#: Bytes up to which a table made from the benchmark is broadcast, by its counted rows and the bytes of a row; larger ones are joined by shuffles.
BROADCAST_BYTES = 8 << 20
#: Words by which the distance of a proximity match may differ from the item's.
SLACK = 3


def small(df: DataFrame, row_bytes: int | Column = 64, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcasting if its counted rows, of row_bytes each, allow it."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, ref, words) for each different text of an item that has words; item is the id as a string ('' if null)."""
    texts = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), alnum_words(F.col(text_col)).alias("words"))
    return texts.filter(F.size("words") > 0).distinct().withColumn("ref", F.xxhash64("item", "words"))


def lexicon(items: DataFrame) -> DataFrame:
    """(term, t): the different words of the items, numbered by hash; a row for each, so as many as the benchmark has words."""
    return written(items.select(F.explode("words").alias("term")).distinct().withColumn("t", F.xxhash64("term")), "decon-terms")


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored postings (id, fp, t, pos) of the terms: a row for each place, in the order of the texts; nothing is shuffled. fp is the hash of the text.

    The rows of the explosion don't carry the text; an explosion copies what stands beside it.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), alnum_words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    places = texts.select("id", "fp", F.posexplode("words").alias("pos", "term"))
    return written(places.join(small(terms, 40 + F.octet_length("term")), "term").select("id", "fp", "t", "pos"), "decon-index")


def lookups(items: DataFrame, postings: DataFrame, window: int) -> DataFrame:
    """(ref, t1, at1, t2, at2): for each window the item words of its rarest and second rarest term (of equally rare ones the first); a window of one word has itself twice."""
    places = items.select("ref", F.size("words").alias("n"), F.posexplode("words").alias("at", "term")).withColumn("t", F.xxhash64("term")).drop("term")
    # Counts of the lists; a term without one is the rarest of all.
    seen = postings.groupBy("t").agg(F.count(F.lit(1)).alias("seen"))
    counted = places.join(seen, "t", "left").fillna(0, ["seen"])
    ahead = Window.partitionBy("ref").orderBy("at").rowsBetween(0, window - 1)
    ranked = F.sort_array(F.collect_list(F.struct("seen", "at", "t")).over(ahead))
    start = F.col("at") <= F.greatest(F.lit(0), F.col("n") - window)
    chosen = counted.withColumn("r", ranked).filter(start).select("ref", F.col("r")[0].alias("a"), F.coalesce(F.get("r", F.lit(1)), F.col("r")[0]).alias("b"))
    # A window that lacks its rarest term altogether occurs nowhere.
    return chosen.filter("a.seen > 0").select("ref", F.col("a.t").alias("t1"), F.col("a.at").alias("at1"), F.col("b.t").alias("t2"), F.col("b.at").alias("at2")).distinct()


def alignments(postings: DataFrame, pairs: DataFrame, slack: int = SLACK) -> DataFrame:
    """(id, fp, ref, start, shift): intersected lists. start is the document's place of the item's word 0 by the rarest term (it may be below 0), shift
    how much further the second rarest stands from it than in the item: 0 for a possible phrase, else up to `slack` either way for a proximity match.

    Both lists are cut into blocks of 2 slack + 1 places; a place of the first meets the one or two blocks of the second that `slack` words reach. The
    one word of a window of one has no proximity match.
    """
    size = 2 * slack + 1
    first = small(pairs.groupBy("t1", "ref", "at1").agg(F.collect_set(F.struct("t2", "at2")).alias("second")), 40 + 24 * F.size("second"))
    hits = postings.join(first, F.col("t") == F.col("t1")).select("id", "fp", "ref", (F.col("pos") - F.col("at1")).alias("start"), "at1", F.explode("second").alias("s"))
    hits = hits.select("id", "fp", "ref", "start", (F.col("s.at2") == F.col("at1")).alias("alone"), F.col("s.t2").alias("t"), (F.col("start") + F.col("s.at2")).alias("want"))
    hits = hits.withColumn("block", F.explode(F.array_distinct(F.array(F.floor((F.col("want") - slack) / size), F.floor((F.col("want") + slack) / size)))))
    lists = postings.join(small(pairs.select(F.col("t2").alias("t")).distinct(), 16), "t").select(F.col("id").alias("id2"), F.col("fp").alias("fp2"), F.col("t").alias("tt"), "pos", F.floor(F.col("pos") / size).alias("block2"))
    on = F.col("id").eqNullSafe(F.col("id2")) & (F.col("fp") == F.col("fp2")) & (F.col("t") == F.col("tt")) & (F.col("block") == F.col("block2"))
    met = hits.join(lists, on).withColumn("shift", F.col("pos") - F.col("want")).filter((F.abs("shift") <= slack) & ((F.col("shift") == 0) | ~F.col("alone")))
    return met.select("id", "fp", "ref", "start", "shift").distinct()


def phrases(found: DataFrame, docs: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Alignments (id, fp, ref, start) -> (id, fp, item, lo, hi): runs of the document's words that equal the item's over whole windows.

    A document meets its alignments once each, an alignment being one row with the words along it; runs are found by a scan that keeps the
    number of equal words so far, so an alignment costs its length.
    """
    sizes = items.select("ref", F.size("words").alias("n"))
    own = found.join(small(sizes, 24), "ref")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text")).join(found.select("id", "fp").distinct().withColumnsRenamed({"id": "i2", "fp": "f2"}), F.col("id").eqNullSafe(F.col("i2")) & (F.col("fp") == F.col("f2")), "left_semi")
    words = texts.groupBy("id", "fp").agg(F.first("text").alias("text")).select(F.col("id").alias("i2"), F.col("fp").alias("f2"), alnum_words(F.col("text")).alias("all"))
    ahead = F.greatest(F.lit(0), -F.col("start"))  # item words before the text
    cut = F.slice("all", F.greatest(F.lit(0), F.col("start")) + 1, F.greatest(F.lit(0), F.col("n") - ahead))
    here = own.join(words, F.col("id").eqNullSafe(F.col("i2")) & (F.col("fp") == F.col("f2"))).select("id", "fp", "ref", "start", ahead.alias("skip"), cut.alias("here"))
    both = here.join(small(items, 64 + 16 * F.size("words")), "ref")
    same = F.zip_with(F.slice("words", F.col("skip") + 1, F.greatest(F.lit(1), F.size("here"))), "here", lambda a, b: F.coalesce(a == b, F.lit(False)))
    # Breaks are the places where words differ; between two of them lies a run of equal ones.
    breaks = F.concat(F.array(F.lit(-1)), F.filter(F.transform("same", lambda x, i: F.when(~x, i)), lambda i: i.isNotNull()), F.array(F.size("same")))
    runs = F.zip_with("breaks", F.slice("breaks", 2, F.size("breaks")), lambda a, b: F.struct((a + 1).alias("lo"), (b - 1).alias("hi")))
    rows = both.withColumn("same", same).withColumn("breaks", breaks).withColumn("width", F.least(F.size("words"), F.lit(window)))
    long = F.filter(runs, lambda r: r["hi"] - r["lo"] + 1 >= F.col("width"))
    return rows.select("id", "fp", "item", "start", "skip", F.explode(long).alias("r")).select("id", "fp", "item", (F.col("start") + F.col("skip") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("skip") + F.col("r.hi")).alias("hi"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slack: int = SLACK) -> tuple[DataFrame, DataFrame]:
    """(id, fp, item, lo, hi), the runs of words that stand as in an item, and (id, fp, item), the items with a proximity match; both from one index."""
    own = written(item_words(items, item_col, item_text_col), "decon-items")
    terms = lexicon(own)
    postings = index(docs, terms, id_col, text_col)
    pairs = written(lookups(own, postings, window), "decon-lookups")
    found = written(alignments(postings, pairs, slack), "decon-alignments")
    exact = written(phrases(found.filter("shift = 0").select("id", "fp", "ref", "start").distinct(), docs, own, id_col, text_col, window), "decon-phrases")
    names = small(own.select("ref", "item"), 64)
    near = written(found.filter("shift <> 0").select("id", "fp", "ref").distinct().join(names, "ref").select("id", "fp", "item").distinct(), "decon-near")
    for x in (terms, postings, pairs, found, own):
        dropped(x)
    return exact, near


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """(id, fp, n_words, n_hit, items, near) for every row of docs: words, those inside occurring windows, the items that own the windows, and the items
    whose two rarest words of a window stand in order, up to `slack` words nearer or further apart than there.

    A window is `window` consecutive words of an item, or all words of a shorter one. Null texts have no words; null ids are ids; rows with one
    id and one text get one answer each; a repeated item counts once. Empty tables give no hits or no rows. Long texts and items are rows of runs,
    never joined place by place. Only the named columns are read.
    """
    exact, near = matches(docs, items, id_col, text_col, item_col, item_text_col, window, slack)
    # Words that several runs cover count once: runs in order, each from where the ones before it end.
    before = Window.partitionBy("id", "fp").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    runs = exact.select("id", "fp", "lo", "hi").distinct().withColumn("done", F.coalesce(F.max("hi").over(before), F.lit(-1)))
    covered = F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo") - 1, F.col("done"))).cast("long")
    no = F.lit(None).cast("string")
    facts = runs.select("id", "fp", covered.alias("n"), no.alias("item"), no.alias("close"))
    facts = facts.unionByName(exact.select("id", "fp", F.lit(0).cast("long").alias("n"), "item", no.alias("close"))).unionByName(near.select("id", "fp", F.lit(0).cast("long").alias("n"), no.alias("item"), F.col("item").alias("close")))
    by_doc = facts.groupBy(F.col("id").alias("i2"), F.col("fp").alias("f2")).agg(F.sum("n").alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"), F.sort_array(F.collect_set("close")).alias("near"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), F.size(alnum_words(F.col(text_col))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    met = rows.join(by_doc, F.col("id").eqNullSafe(F.col("i2")) & (F.col("fp") == F.col("f2")), "left")
    return met.select("id", "fp", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))


def op8(docs: DataFrame, items: DataFrame) -> DataFrame:
    digest: Column = F.sha2(F.array_join("items", ","), 256)
    return decontaminate(docs, items).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
occ AS (SELECT d.doc_id, d.i, win.n, win.item_id FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) d JOIN win ON win.n = 10 AND array_to_string(d.w[d.i:d.i + 9], ' ') = win.g
  UNION ALL SELECT d.doc_id, d.i, win.n, win.item_id FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) d JOIN win ON win.n < 10 AND array_to_string(d.w[d.i:d.i + win.n - 1], ' ') = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY 1),
refs AS (SELECT item_id, w, row_number() OVER () AS ref FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)), words AS (SELECT ref, item_id, len(w) AS n, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM refs),
tok AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS term FROM d), seen AS (SELECT term, count(*) AS seen FROM tok GROUP BY 1), pos AS (SELECT words.*, coalesce(seen, 0) AS seen FROM words LEFT JOIN seen USING (term)),
two AS (SELECT item_id, n, p, list_sort(list(struct_pack(seen := seen, p := p, term := term)) OVER (PARTITION BY ref ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) AS r FROM pos),
pair AS (SELECT DISTINCT item_id, r[1].term AS t1, r[1].p AS a1, r[2].term AS t2, r[2].p AS a2 FROM two WHERE p <= greatest(1, n - 9) AND len(r) > 1 AND r[1].seen > 0),
lead AS (SELECT DISTINCT tok.doc_id, pair.item_id, pair.t2, tok.i - pair.a1 + pair.a2 AS want FROM tok JOIN pair ON tok.term = pair.t1),
close AS (SELECT l.doc_id, count(DISTINCT l.item_id) AS n_near FROM lead l CROSS JOIN (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS shift) JOIN tok ON tok.doc_id = l.doc_id AND tok.i = l.want + shift AND tok.term = l.t2 GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id LEFT JOIN close ON close.doc_id = d.doc_id
"""
