"""License scans by an exact set-similarity join, in DataFrame functions alone.

The words of every template stand in a table, ordered by their document frequency over the whole corpus, rarest
first. A block is as many consecutive words of a text as the template has, wherever lines end; it matches if
it holds enough of the template's distinct words: all of a template of fewer than WHOLE, else the share
CONTAINMENT. Words of texts meet the template words by an equi-join on the word. A text takes part only with a
word of the prefix of some template (prefix filter); a text and a template go on only if the text holds enough
of the template's words at all (length filter); a block counts only if its rarest word stands early enough in
the template's order to leave enough words (positional filter); what is left is verified on whole sets.

Defined results: null text is empty: no words, no labels, score 0; repeated rows are scanned each; whole texts
are read, very long ones in work that grows in proportion; of several templates of a label the best counts,
and ties between blocks do not show; columns named like a result give way to it, all others pass; no rows give
no rows.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.shared import durable, quoted, table

CONTAINMENT = 0.8
WHOLE = 20  #: templates of fewer distinct words need all of them: four of five also stand in notices of other licenses
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license texts and the notices that name a license, by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Released under the MIT license."),
    ("mit", "Licensed under the MIT license."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is not part of a word.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def needed(n_distinct: int, containment: float = CONTAINMENT) -> int:
    return n_distinct if n_distinct < WHOLE else math.ceil(containment * n_distinct - 1e-9)


def template_words(templates: list[tuple[str, str]], containment: float = CONTAINMENT) -> list[tuple[int, str, str, int, int, int]]:
    """(template, label, word, distinct words, words needed, words of a block) of every word of every template."""
    out = []
    for k, (label, text) in enumerate(templates):
        words = words_of(text)
        distinct = sorted(set(words))
        out += [(k, label, w, len(distinct), needed(len(distinct), containment), len(words)) for w in distinct]
    return out


def flat_text(text: Column) -> Column:
    """Words in lower case with one space between."""
    clean = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), GAPS, " "), UPPER, LOWER)
    return F.trim(clean)


def base_places(flat: Column, wide: Column, n_words: Column) -> tuple[list[Column], ...]:
    """Of each phrase the number of places, the first and last start, and the label where there is a place."""
    places = []
    for phrase, label in PHRASES.items():
        p = f" {phrase.replace(' ', '  ')} "
        n = (F.length(wide) - F.length(F.replace(wide, F.lit(p)))) / len(p)
        before = lambda s: ((F.length(s) - F.length(F.replace(s, F.lit(" ")))) / 2).cast("long")
        first, last = before(F.substring_index(wide, p, 1)), n_words - before(F.substring_index(wide, p, -1)) - len(phrase.split())
        places.append((n.cast("long"), F.when(n > 0, first), F.when(n > 0, last), F.when(n > 0, F.lit(label))))
    return tuple(zip(*places, strict=True))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """The columns named in ``keep`` (all by default) with n_words, n_base, first_word, last_word, base_labels,
    labels and score."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    flat = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep))).alias("row"), flat_text(F.col(quoted(text))).alias("flat"))

    # The table of template words, as large as the templates, which are given; it and its words are broadcast.
    held = spark.createDataFrame(template_words(TEMPLATES if templates is None else templates, containment), "t int, label string, word string, m int, need int, size int")
    vocabulary = F.broadcast(held.agg(F.collect_set("word").alias("vocabulary")))
    often = flat.crossJoin(vocabulary).select(F.explode(F.array_intersect(F.split("flat", " "), "vocabulary")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = held.join(often, "word", "left").withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(F.coalesce("df", F.lit(0)), "word")))
    ranked = durable(ranked.withColumn("prefix", F.col("rank") <= F.col("m") - F.col("need") + 1).drop("df"))

    n_words = F.when(F.col("flat") == "", 0).otherwise(F.length("flat") - F.length(F.replace(F.col("flat"), F.lit(" "))) + 1).cast("long")
    any_base = reduce(lambda a, b: a | b, (F.col("flat").contains(p) for p in PHRASES))
    wide = F.when(any_base, F.concat(F.lit(" "), F.replace(F.col("flat"), F.lit(" "), F.lit("  ")), F.lit(" ")))
    prefixes = F.broadcast(ranked.where("prefix").agg(F.collect_set("word").alias("prefixes")))
    near = F.arrays_overlap(F.split("flat", " "), "prefixes")
    base = flat.withColumn("n_words", n_words).withColumn("wide", wide).crossJoin(prefixes)
    n, first, last, label = base_places(F.col("flat"), F.col("wide"), F.col("n_words"))
    least = lambda c: F.least(*c) if len(c) > 1 else c[0]
    most = lambda c: F.greatest(*c) if len(c) > 1 else c[0]
    base = durable(base.select(
        "row", F.monotonically_increasing_id().alias("id"), F.when(near, F.split("flat", " ")).alias("words"),
        "n_words", F.coalesce(reduce(lambda a, b: a + b, n), F.lit(0)).cast("long").alias("n_base"),
        least(first).alias("first_word"), most(last).alias("last_word"), F.array_compact(F.array(*label)).alias("base"),
    ))

    # Texts with a prefix word meet the templates word by word.
    met = base.where("words IS NOT NULL").select("id", F.posexplode("words").alias("at", "word")).join(F.broadcast(ranked), "word")
    sets = met.groupBy("id", "t", "label", "m", "need", "size").agg(F.sort_array(F.collect_list(F.struct("at", "rank"))).alias("h"), F.count_distinct("rank").alias("shared"), F.bool_or("prefix").alias("prefix"))
    sets = sets.where("prefix AND shared >= need")

    def hits(x: Column, i: Column) -> Column:
        block = F.filter(F.slice("h", i + 1, F.col("size")), lambda y: y["at"] < x["at"] + F.col("size"))
        ranks = F.transform(block, lambda y: y["rank"])
        return F.when(F.col("m") - F.array_min(ranks) + 1 >= F.col("need"), F.size(F.array_distinct(ranks))).otherwise(0)

    best = sets.select("id", "label", "m", "need", F.array_max(F.transform("h", hits)).alias("best")).where("best >= need")
    matches = best.groupBy("id").agg(F.collect_set("label").alias("own"), F.max(F.col("best") / F.col("m")).alias("reached"))
    return base.join(matches, "id", "left").select(
        *(F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("reached", F.lit(0.0))).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def sql() -> str:
    """Every block of every text against every template, and every word against every phrase."""
    values = ", ".join(f"({t}, '{label}', '{w}', {m}, {need}, {size})" for t, label, w, m, need, size in template_words(TEMPLATES))
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in PHRASES.items())
    word, lower = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
e AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
p AS (SELECT * FROM (VALUES {phrases}) AS p(words, label)),
b AS (SELECT id, label, i FROM e JOIN d USING (id) JOIN p ON e.word = words[1] WHERE w[i + 1:i + len(words)] = words),
v AS (SELECT * FROM (VALUES {values}) AS v(t, label, word, m, need, size)),
a AS (SELECT id, t, label, m, need, size, i, word FROM e JOIN v USING (word)),
c AS (SELECT id, t FROM a GROUP BY ALL HAVING count(DISTINCT word) >= any_value(need)),
h AS (SELECT a.* FROM a JOIN c USING (id, t)),
s AS (SELECT f.id, f.t, f.i, any_value(f.label) AS label, any_value(f.m) AS m, any_value(f.need) AS need, count(DISTINCT g.word) AS n
  FROM h f JOIN h g ON f.id = g.id AND f.t = g.t AND g.i >= f.i AND g.i < f.i + f.size GROUP BY f.id, f.t, f.i),
u AS (SELECT id, label, i, 1.0::DOUBLE AS s FROM b UNION ALL SELECT id, label, NULL, max(n / m) FROM s WHERE n >= need GROUP BY id, label)
SELECT any_value(d.doc_id) AS doc_id, len(any_value(w))::BIGINT AS n_words, count(i) AS n_base, min(i)::BIGINT AS first_word, max(i)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE i IS NOT NULL), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(s), 0)::DOUBLE AS score
FROM d LEFT JOIN u USING (id) GROUP BY d.id"""
