"""License scans by diagonal voting: word k-grams of documents meet template positions, votes of a diagonal are counted, neighbouring diagonals merged, spans verified."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, dealt, if_small, stage

#: Words of a k-gram.
K = 5
#: Diagonals that differ by so much at most belong to one place: words left out or put in move the rest.
DRIFT = 4
#: Share of a template's words that must be found in one place.
MIN_SHARE = 0.6

# Phrases that name a license, and the public wording of license notices.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)


def words(text: Column) -> Column:
    """Runs of 0-9, a-z and all beyond ASCII, A-Z lowered; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i.cast("int"))


def _from_to(first, last) -> Column:
    """The whole numbers from first to last; none if last is less."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _grams(df: DataFrame, ident: str, k: int) -> DataFrame:
    """(ident, pos, gram) of all rolling k-grams of the column `_w`; of fewer than k words, none."""
    gram = lambda i: F.xxhash64(*(_at("_w", i + F.lit(o)) for o in range(k)))
    found = F.transform(_from_to(F.lit(0), F.size("_w") - k), lambda i: F.struct(i.alias("pos"), gram(i).alias("gram")))
    return df.select(ident, F.explode(found).alias("g")).select(ident, "g.pos", "g.gram")


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """template (its number), label, text."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, label string, text string")


def spans(docs: DataFrame, templates: DataFrame, k: int = K, drift: int = DRIFT, min_share: float = MIN_SHARE) -> DataFrame:
    """Places of templates in documents: doc, template, label, first_word and last_word of the place, votes, matched, share.

    docs: doc (any type; rows that repeat it have equal words) and _w, an array of words; templates: template, label, text.
    All rolling k-gram hashes of the documents are joined to the places of the templates. Hits of a document and a template
    are counted by diagonal (place in the document less place in the template); diagonals that follow each other within
    `drift` words are one place. In each place the words along its diagonals are compared from the first to the last hit:
    `matched` counts the template's words that are there, share is theirs among all its words, and places under min_share
    are no license. A replaced word costs that word alone. Templates of fewer than k words are never found.
    """
    known = stage(templates.select("template", "label", words(F.col("text")).alias("_w")))
    seeds = stage(_grams(known, "template", k).withColumnRenamed("pos", "t"))
    hits = _grams(docs, "doc", k).join(if_small(seeds), "gram").select("doc", "template", (F.col("pos") - F.col("t")).alias("diagonal"), "t")
    own = Window.partitionBy("doc", "template").orderBy("diagonal")
    diagonals = hits.distinct().groupBy("doc", "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("t").alias("from_t"), (F.max("t") + k - 1).alias("to_t"))
    breaks = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > drift, F.lit(False)).cast("int")
    diagonals = stage(diagonals.withColumn("break", breaks).withColumn("place", F.sum("break").over(own)).drop("break"))
    there = docs.join(if_small(diagonals.select("doc").distinct()), "doc", "left_semi").dropDuplicates(["doc"])
    along = there.join(if_small(diagonals), "doc").join(if_small(known.withColumnRenamed("_w", "_t")), "template")
    same = F.filter(_from_to(F.col("from_t"), F.col("to_t")), lambda t: _at("_w", t + F.col("diagonal")) == _at("_t", t))
    one = along.select("doc", "template", "label", "place", "votes", (F.col("from_t") + F.col("diagonal")).alias("a"), (F.col("to_t") + F.col("diagonal")).alias("b"), F.size("_t").alias("of"), F.explode(same).alias("t"), "diagonal")
    one = one.groupBy("doc", "template", "label", "place", "t", "of").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    found = one.groupBy("doc", "template", "label", "place", "of").agg(F.min("a").cast("long").alias("first_word"), F.max("b").cast("long").alias("last_word"), F.count(F.lit(1)).alias("matched"))
    votes = diagonals.groupBy("doc", "template", "place").agg(F.sum("votes").alias("votes"))
    found = found.join(votes, ["doc", "template", "place"]).withColumn("share", F.col("matched") / F.col("of")).where(F.col("share") >= min_share)
    return found.select("doc", "template", "label", "first_word", "last_word", "votes", "matched", "share")


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places where a phrase's words stand one after another, their number, and the starts of the first and last of them
    (null where there are none). labels joins the base labels and those of the templates that `spans` verifies; score is the
    largest verified share, 0 without any. Labels are distinct, sorted and joined by commas, empty if there are none.

    Null and empty texts have no words; a null id is an id like any other; rows with equal ids are scanned each; further
    columns do not matter; an empty table gives an empty one, and without templates the base alone is left.
    """
    rows = dealt(docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("of")).alias("doc"), F.col(text_col).cast("string").alias("text")))
    split = rows.select("doc", words(F.col("text")).alias("_w"))
    found = spans(split, templates, **options).groupBy("doc").agg(F.collect_set("label").alias("found"), F.max("share").alias("score"))

    def places(phrase: str) -> Column:
        parts = phrase.split()
        here = lambda i: functools.reduce(Column.__and__, (_at("_w", i + F.lit(o)) == w for o, w in enumerate(parts)))
        return F.filter(_from_to(F.lit(0), F.size("_w") - len(parts)), here)

    at = [f"_at{n}" for n in range(len(phrases))]
    base = split.select("doc", F.size("_w").cast("long").alias("n_words"), *(places(p).alias(c) for c, (p, _) in zip(at, phrases, strict=True)))
    starts = F.flatten(F.array(*at))
    named = F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(at, phrases, strict=True))))
    base = base.select("doc", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), named.alias("_base"))
    out = base.join(if_small(stage(found)), "doc", "left")
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    both = F.concat("_base", F.coalesce("found", F.array().cast("array<string>")))
    return out.select(F.col("doc.id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", labels(F.col("_base")).alias("base_labels"), labels(both).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
