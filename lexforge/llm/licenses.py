"""Op 2, license scans: diagonal voting of word k-grams.

All rolling word ``K``-grams of all texts are joined, by hash and then by the words themselves, with the positions of the
templates' k-grams (a constant of this module, so broadcast). Matches of a text and template are counted by
diagonal, the difference of their positions; diagonals at most ``SLACK`` apart, as words inserted or left out make
them, merge into one span. A span holds if it covers enough of the template (``COVER``) and is dense enough.

Everything is DataFrame functions. The only rows that move are counts of diagonals.

Defined results: a null text is empty and has no words, labels or spans (score 0). Rows with one doc_id and text have the
same result each; texts that are fuller than templates, or hold several, have all their labels. Of spans over the same words that
fit equally well all hold. An empty table has an empty result; very long texts are looked through whole; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

K = 3
SLACK = 6
COVER = 0.7
DENSE = 0.5

_OUT = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORDS = rf"[^{_OUT}]+"
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Letters of each phrase without which a text cannot hold it; none is an i, which some locales lower-case otherwise.
HINTS = {"mit": "cense", "apache-2": "apache", "cc-by-nc": "cc"}

#: label, kind of text, text. Public notices.
TEMPLATES = (
    ("mit", "line", "Released under the MIT License."),
    ("mit", "line", "Licensed under the MIT License."),
    ("mit", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "line", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("bsd", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl-2", "line", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "line", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "line", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)

_TEMPLATE_WORDS = [re.findall(WORDS, text.lower()) for _, _, text in TEMPLATES]
#: The words that stand first, second and third in k-grams of templates, all of ASCII letters.
PLACES = [sorted({w for words in _TEMPLATE_WORDS for w in words[i : len(words) - K + 1 + i]}) for i in range(K)]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _low(word: str) -> Column:
    """A-Z lower-cased, no other letters. It looks at each letter for itself, so it is for few words."""
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words() -> Column:
    """All words as they stand. Cutting at the gaps is faster than extracting each match."""
    return F.array_remove(F.split(_text(), f"[{_OUT}]+", -1), "")


def _grams(words: str) -> Column:
    """(w1, w2, w3) at each position, nulls beyond the end."""
    n = F.size(words)
    return F.arrays_zip(F.col(words).alias("w1"), F.slice(words, F.lit(2), n).alias("w2"), F.slice(words, F.lit(3), n).alias("w3"))


def templates(spark: SparkSession) -> DataFrame:
    """template, label, size (k-grams), tpos, t1, t2, t3, hash: the positions of all templates."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, _, text) in enumerate(TEMPLATES)])
    t = spark.range(1).select(F.explode(rows).alias("t")).select("t.template", "t.label", F.regexp_extract_all(F.lower("t.text"), F.lit(WORDS), F.lit(0)).alias("words"))
    t = t.select("template", "label", (F.size("words") - K + 1).alias("size"), F.posexplode(_grams("words")).alias("tpos", "g"))
    return t.where("g.w3 is not null").select("template", "label", "size", "tpos", F.col("g.w1").alias("t1"), F.col("g.w2").alias("t2"), F.col("g.w3").alias("t3"), F.xxhash64("g.w1", "g.w2", "g.w3").alias("hash"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, label, template, first, last (words, both included), cover, dense: all merged diagonals.

    ``text_hash`` tells rows apart that share a doc_id.
    """
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _words().alias("words"))
    # outer, since the plan would else cut the text twice: once to ask whether it has words
    d = d.select("doc_id", "text_hash", "words", F.posexplode_outer("words").alias("pos", "w1"))
    d = d.select("doc_id", "text_hash", "pos", "w1", F.get("words", F.col("pos") + 1).alias("w2"), F.get("words", F.col("pos") + 2).alias("w3"))
    # lower() is exact for ASCII words and other words are no template's; what it takes for one beyond them is asked again in the join
    for i, words in enumerate(PLACES):
        d = d.where(F.lower(f"w{i + 1}").isin(words))
    d = d.select("doc_id", "text_hash", "pos", *[_low(w).alias(w) for w in ("w1", "w2", "w3")]).withColumn("hash", F.xxhash64("w1", "w2", "w3"))
    hits = d.join(F.broadcast(templates(docs.sparkSession)), "hash").where("w1 = t1 and w2 = t2 and w3 = t3")
    key = ["doc_id", "text_hash", "template", "label", "size"]
    # at most ``size`` template positions, and as many matches, in a row
    diagonals = hits.groupBy(*key, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("tpos"))
    order = W.partitionBy(*key).orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > SLACK
    islands = diagonals.withColumn("island", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy(*key, "island").agg(F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("covered"))
    return merged.select("doc_id", "text_hash", "label", "template", "first", "last", (F.col("covered") / F.col("size")).alias("cover"), F.least(F.lit(1.0), (F.col("covered") + K - 1) / (F.col("last") - F.col("first") + 1)).alias("dense"))


def settled(found: DataFrame) -> DataFrame:
    """``spans`` with ``holds``: enough of a template, densely, and no span over the same words fits another one better."""
    enough = (F.col("cover") >= COVER) & (F.col("dense") >= DENSE)
    key = ["doc_id", "text_hash"]
    rated = found.withColumn("rate", F.when(enough, F.col("cover") * F.col("dense")))
    # sweeping by first word, spans that touch form a run; only within one can a span give way to another
    order = W.partitionBy(*key).orderBy("first", "last", "template")
    reach = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = rated.withColumn("new", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    top = F.max("rate").over(W.partitionBy(*key, "run"))
    size = F.col("last") - F.col("first") + 1
    longest = F.max(F.when(F.col("rate").isNotNull(), size)).over(W.partitionBy(*key, "run"))
    # a run can hold several licenses one after another: a span gives way to a better one only if that one is as long
    return runs.withColumn("holds", F.col("rate").isNotNull() & ((F.col("rate") >= top) | (size * 2 < longest))).drop("rate", "new", "run")


def _base(n_words: Column) -> dict[str, Column]:
    """By label: places, first and last place of its phrase. Splitting by the phrase leaves what stands around its places."""
    out = {}
    for label, phrase in PHRASES:
        words = phrase.split()
        pattern = F.lit(rf"(?i)(?<![^{_OUT}])" + rf"[{_OUT}]+".join(words) + rf"(?![^{_OUT}])")
        parts = F.split(_text(), pattern, -1)
        n = F.regexp_count(_text(), pattern)
        out[label] = F.when(F.lower(_text()).contains(HINTS[label]) & (n > 0), F.struct(n.alias("n"), F.regexp_count(F.element_at(parts, 1), F.lit(WORDS)).alias("first"), (n_words - len(words) - F.regexp_count(F.element_at(parts, -1), F.lit(WORDS))).alias("last")))
    return out


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; see the module."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.array_size(_words()).cast("long").alias("n_words"))
    found = _base(F.col("n_words"))
    d = d.select("doc_id", "text_hash", "n_words", *[c.alias(k) for k, c in found.items()])
    get = lambda f: [F.col(f"`{k}`.{f}") for k in found]
    d = d.select(
        "doc_id", "text_hash", "n_words", sum((F.coalesce(c, F.lit(0)) for c in get("n")), F.lit(0)).cast("long").alias("n_base"), F.least(*get("first")).cast("long").alias("first_word"), F.greatest(*get("last")).cast("long").alias("last_word"),
        F.sort_array(F.array_compact(F.array(*[F.when(F.col(f"`{k}`.n") > 0, F.lit(k)) for k in found]))).alias("base"),
    )
    best = settled(spans(docs)).groupBy("doc_id", "text_hash").agg(F.collect_set(F.when(F.col("holds"), F.col("label"))).alias("more"), F.max(F.col("cover") * F.col("dense")).alias("best"), F.count(F.when(F.col("holds"), 1)).alias("n_spans"))
    best = best.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    d = d.join(best, d.doc_id.eqNullSafe(best._id) & (d.text_hash == best._hash), "left")
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )


def op2_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
