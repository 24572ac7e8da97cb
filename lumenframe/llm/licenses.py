"""License scan by diagonal voting over word k-grams [native].

Every k-gram of a document's words is joined by hash to the places of equal k-grams in the templates. A match at word i of the document and
word j of a template votes for the diagonal i - j. Votes are summed by diagonal, neighbouring diagonals that touch in the text are merged into
a span (words put in or left out shift the diagonal), and a span is verified word for word: by the share of the template's k-grams that stand in it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, written

# Phrases that must stand word for word, and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# The paragraphs of well-known public licenses and license notices. A paragraph is a template of its own, so parts of a license count too.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-3", "licensed under the GNU General Public License version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

GRAM = 3


def split(text: str) -> list[str]:
    """Words as the scan splits them; templates are of ASCII letters, digits and signs."""
    return re.findall("[a-z0-9]+", text.lower())


def lists(spark, templates: list[tuple[str, str]], k: int = GRAM) -> DataFrame:
    """(template, label, own): the words of each template."""
    rows = [(t, label, split(text)) for t, (label, text) in enumerate(templates)]
    for _, label, words in rows:
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {label}")
    return spark.createDataFrame(rows, "template int, label string, own array<string>")


def rolling(words: Column, k: int) -> Column:
    """The hash of each k words in a row; of fewer words none."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))))


def grams(spark, templates: list[tuple[str, str]], k: int = GRAM) -> DataFrame:
    """One row for each k-gram of each template: (template, label, at, of, h); as many rows as the templates have words at most."""
    own = lists(spark, templates, k)
    return own.select("template", "label", (F.size("own") - k + 1).alias("of"), F.posexplode(rolling(F.col("own"), k)).alias("at", "h"))


def matched(docs: DataFrame, gram: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM) -> DataFrame:
    """(id, fp, n_words, hits, words) for every row of docs, from one pass over the texts: places and hashes of k-grams that a template has too.

    words are kept where there is a hit only. Hashes are made and looked up inside the array; exploding all of them would make a row for each word.
    """
    known = [r["h"] for r in gram.select("h").distinct().collect()]  # some hundred numbers, those of the templates
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), alnum_words(F.col(text_col)).alias("words"))
    places = F.filter(F.transform(rolling(F.col("words"), k), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))), lambda x: x["h"].isin(known))
    found = texts.select("id", "fp", F.size("words").cast("long").alias("n_words"), F.coalesce(places, F.array().cast("array<struct<pos:int,h:bigint>>")).alias("hits"), "words")
    return found.withColumn("words", F.when(F.size("hits") > 0, F.col("words")))


def votes(base: DataFrame, gram: DataFrame) -> DataFrame:
    """(id, fp, template, label, of, at, pos): each k-gram of a text that has the hash of one of a template. Rows with one id and text vote once.

    The templates are constants of the call, some hundred rows, so broadcasting them is bounded whatever the corpus.
    """
    hits = base.filter(F.size("hits") > 0).select("id", "fp", F.explode("hits").alias("x")).select("id", "fp", F.col("x.pos").alias("pos"), F.col("x.h").alias("h"))
    return hits.join(F.broadcast(gram), "h").select("id", "fp", "template", "label", "of", "at", "pos").distinct()


def spans(found: DataFrame, k: int = GRAM, drift: int = 12, gap: int = 12) -> DataFrame:
    """Votes -> (id, fp, template, label, first, last, coverage): spans of merged neighbouring diagonals.

    Runs are gathered in two sets of overlapping bands of 2 `drift` diagonals, so that diagonals of one passage, up to `drift` words put in or left out, share a
    band and stray matches elsewhere don't part them; in a band, runs merge if at most `gap` words lie between them. coverage: the part of the
    template's k-grams that the span holds.
    """
    runs = (
        found.withColumn("diag", F.col("pos") - F.col("at"))
        .groupBy("id", "fp", "template", "label", "of", "diag")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "at"))).alias("hits"))
    )
    band = lambda shift, odd: F.floor((F.col("diag") + shift) / (2 * drift)) * 2 + odd
    rows = runs.withColumn("band", F.explode(F.array(band(0, 0), band(drift, 1)))).select("id", "fp", "template", "label", "of", "band", F.explode("hits").alias("x")).select("id", "fp", "template", "label", "of", "band", "x.*")
    order = Window.partitionBy("id", "fp", "template", "band").orderBy("pos", "at")
    new = F.coalesce(F.col("pos") - F.lag("pos").over(order) > gap + k, F.lit(True)).cast("int")
    numbered = rows.withColumn("new", new).withColumn("span", F.sum("new").over(order))
    return numbered.groupBy("id", "fp", "template", "label", "of", "band", "span").agg(
        F.min("pos").alias("first"), (F.max("pos") + k - 1).alias("last"), F.count_distinct("at").alias("hit")
    ).select("id", "fp", "template", "label", "first", "last", (F.col("hit") / F.col("of")).alias("coverage")).distinct()


def verified(found: DataFrame, texts: DataFrame, own: DataFrame, k: int, least: float) -> DataFrame:
    """Spans whose words hold `least` or more of the template's k-grams, coverage being that share; equality is that of words, not of hashes."""
    line = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.array_join(F.slice(c, i + 1, k), " "))
    met = found.join(texts, found["id"].eqNullSafe(texts["i2"]) & (found["fp"] == texts["f2"])).join(F.broadcast(own.select("template", "own")), "template")
    met = met.withColumn("here", F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + 1))
    # Spans are made of k-grams, so they have k words at least.
    share = F.size(F.array_intersect(line(F.col("here")), line(F.col("own")))) / F.size(F.array_distinct(line(F.col("own"))))
    return met.withColumn("coverage", share).filter(F.col("coverage") >= least).select("id", "fp", "label", "first", "last", "coverage")


def standing(found: DataFrame, texts: DataFrame, own: DataFrame) -> DataFrame:
    """(id, fp, label, first): diagonals that all k-grams of a template vote for and whose words are the template's."""
    full = found.groupBy("id", "fp", "template", "label", "of", (F.col("pos") - F.col("at")).alias("first")).agg(F.count(F.lit(1)).alias("n")).filter("n = of")
    met = full.join(texts, full["id"].eqNullSafe(texts["i2"]) & (full["fp"] == texts["f2"])).join(F.broadcast(own.select("template", "own")), "template")
    return met.filter(F.slice("words", F.col("first") + 1, F.size("own")) == F.col("own")).select("id", "fp", "label", "first")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES, k: int = GRAM, least: float = 0.6) -> DataFrame:
    """Every document with its license spans: (id, n_words, places, found).

    places: array of (label, first) where a phrase stands word for word, which is a diagonal that all k-grams of the phrase vote for.
    found: array of (label, first, last, coverage) of spans that hold `least` or more of a phrase or notice.
    A null text has no words. Rows with one id and one text each get the same answer; rows with one id and other texts get their own. A null
    id is an id. An empty table gives an empty result. A long text is one row of its words and of its hits. Only id_col and text_col are read.
    """
    spark = docs.sparkSession
    templates, n = [*phrases, *notices], len(phrases)
    own, gram = lists(spark, templates, k), grams(spark, templates, k)
    base = written(matched(docs, gram, id_col, text_col, k), "license-hits")
    texts = base.filter(F.size("hits") > 0).groupBy(F.col("id").alias("i2"), F.col("fp").alias("f2")).agg(F.first("words").alias("words"))
    found = votes(base, gram)
    exact = standing(found.filter(F.col("template") < n), texts, own).select("id", "fp", F.struct("label", "first").alias("place"), F.lit(None).cast("struct<label:string,first:int,last:int,coverage:double>").alias("span"))
    # What the votes cover is an upper bound of what the words do: hashes of equal words are equal.
    other = verified(spans(found, k).filter(F.col("coverage") >= least), texts, own, k, least).select("id", "fp", F.lit(None).cast("struct<label:string,first:int>").alias("place"), F.struct("label", "first", "last", "coverage").alias("span"))
    by_doc = exact.unionByName(other).groupBy(F.col("id").alias("i3"), F.col("fp").alias("f3")).agg(F.sort_array(F.collect_list("place")).alias("places"), F.sort_array(F.collect_set("span")).alias("found"))
    met = base.select("id", "fp", "n_words").join(by_doc, F.col("id").eqNullSafe(F.col("i3")) & (F.col("fp") == F.col("f3")), "left")
    return met.select("id", "n_words", "places", "found")


def op10(docs: DataFrame) -> DataFrame:
    """The digest of scan() that the query returns."""
    firsts = F.transform("places", lambda p: p["first"])
    base, own = F.transform("places", lambda p: p["label"]), F.transform("found", lambda p: p["label"])
    listed = lambda c: F.coalesce(F.array_join(F.sort_array(F.array_distinct(c)), ","), F.lit(""))
    return scan(docs).select(
        F.col("id").alias("doc_id"), "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(firsts).cast("long").alias("first_word"), F.array_max(firsts).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda p: p["coverage"])), F.lit(0.0)).alias("score"),
    )
