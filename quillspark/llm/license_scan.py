"""License phrases by diagonal voting. DataFrame functions only.

Every rolling pair of words is hashed and looked up in a literal table of the templates' pairs, which are a fixed
library of bounded size. A hit votes for the diagonal "word position in the text minus position in the template". Only
votes for templates of which the text holds enough different pairs leave their row, so common pairs don't. A base
phrase is there where a diagonal has all its pairs in a row. For longer templates, the diagonals within `slack` of one
(words inserted, left out or changed) are merged with it, and the merged span is verified: its votes are read in the
order of the text, only those that go forward in the template count, and they must cover enough of it within a bounded
stretch. The best of neighbouring spans stays.

Defined results: a null or empty text has no words; repeated rows each get a row, with equal results; an
empty table gives no rows; other columns are ignored; very long texts are scanned whole; of overlapping spans all count.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, require

SLOTS = 1 << 18
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Fixed wordings of well-known licenses and notices, as words of the contract's kind.
TEMPLATES = {
    "afl-3.0": ["licensed under the academic free license version 3 0"],
    "agpl": [
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license along with this program",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
        "licensed to the apache software foundation under one or more contributor license agreements",
    ],
    "artistic-2.0": ["this package is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "use of this source code is governed by a bsd style license that can be found in the license file",
    ],
    "bsl-1.0": ["distributed under the boost software license version 1 0"],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4 0 international license",
        "this work is licensed under the creative commons attribution 4 0 international license",
        "open access article distributed under the terms of the creative commons attribution license which permits unrestricted use distribution and reproduction in any medium provided the original work is properly cited",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "cc-by-nd": ["licensed under cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "cc-by-sa": [
        "licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license",
        "text is available under the creative commons attribution sharealike license additional terms may apply",
    ],
    "cc0": [
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "dedicated to the public domain under the creative commons cc0 1 0 universal public domain dedication",
    ],
    "epl-2.0": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution",
    ],
    "eupl": ["licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl"],
    "gfdl": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"],
    "gpl": [
        "this work is licensed under the gnu general public license version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "either version 2 of the license or at your option any later version", "either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "you should have received a copy of the gnu general public license along with this program",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": [
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license",
    ],
    "mit": [
        "released under the mit license", "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
    ],
    "ms-pl": ["this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software"],
    "odbl": ["made available under the open database license any rights in individual contents of the database are licensed under the database contents license"],
    "ofl-1.1": ["this font software is licensed under the sil open font license version 1 1"],
    "psf": ["the python software foundation grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform and or display publicly"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "wtfpl": ["do what the fuck you want to public license"],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
}


def words_of(text: Column) -> Column:
    """Words of the lower-cased text: runs of digits, a-z and characters beyond ASCII."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def library(base: dict[str, str], templates: dict[str, list[str]]) -> list[tuple[str, bool, list[str]]]:
    """(label, is_base, words) of each template, by its number."""
    phrases = [(v, True, k) for k, v in base.items()] + [(k, False, p) for k, ps in templates.items() for p in ps]
    return [(label, is_base, phrase.split()) for label, is_base, phrase in phrases]


def literal(value: object, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), schema)


def places_of(words: Column, known: list[tuple[str, bool, list[str]]], spark: SparkSession) -> Column:
    """Where pairs of an array of words stand in templates: struct<t, i, at>, t: template, i, at: places in the text and in it.

    A literal table of bounded size says which of its 262,144 slots a pair of the library falls into (some 1,200 do); the
    pairs of that slot are compared as words.
    """
    pairs = [(t, at, a, b) for t, (_, _, w) in enumerate(known) for at, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    rows = spark.createDataFrame(pairs, "t int, at int, a string, b string").select("*", slot(F.col("a"), F.col("b")).alias("slot")).collect()
    found: dict[int, list[dict]] = {}
    for r in rows:
        found.setdefault(r.slot, []).append({"t": r.t, "at": r.at, "a": r.a, "b": r.b})
    numbers = {k: n for n, k in enumerate(found)}
    slots = literal([numbers.get(k, -1) for k in range(SLOTS)], "array<int>")
    entries = literal(list(found.values()), "array<array<struct<t:int,at:int,a:string,b:string>>>")
    n = F.size(words)
    numbered = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(i.alias("i"), F.get(slots, slot(F.get(words, i), F.get(words, i + 1))).alias("k")))
    maybe = F.when(n > 1, F.filter(numbered, lambda p: p["k"] >= 0)).otherwise(F.array().cast("array<struct<i:int,k:int>>"))
    same = lambda e, i: (e["a"] == F.get(words, i)) & (e["b"] == F.get(words, i + 1))
    return F.flatten(F.transform(maybe, lambda p: F.transform(
        F.filter(F.get(entries, p["k"]), lambda e: same(e, p["i"])), lambda e: F.struct(e["t"].alias("t"), p["i"].alias("i"), e["at"].alias("at"))
    )))


def slot(a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(a, b), F.lit(SLOTS)).cast("int")


def able(hits: Column, known: list[tuple[str, bool, list[str]]], covered: float) -> Column:
    """Templates of which a row holds so many different pairs that a span of it could be valid, wherever they stand."""
    need = []
    for _, is_base, words in known:
        n = len(words) - 1
        need.append(n if is_base else next(c for c in range(n + 1) if c / n >= covered))
    different = F.array_distinct(F.transform(hits, lambda h: h["t"] * 1000 + h["at"]))
    return F.aggregate(
        F.array(different), F.array().cast("array<int>"),
        lambda _, d: F.filter(F.array_distinct(F.transform(d, lambda x: F.floor(x / 1000).cast("int"))), lambda t: F.size(F.filter(d, lambda x: (x >= t * 1000) & (x < t * 1000 + 1000))) >= F.get(literal(need, "array<int>"), t)),
    )


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES,
    slack: int = 4, covered: float = 0.75, stretch: float = 1.5,
) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and the verified spans of each row."""
    spark = docs.sparkSession
    known = library(base, templates)
    texts = require(docs, [id_col, text_col]).toDF("doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    texts = texts.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), places_of(F.col("words"), known, spark).alias("hits"))
    texts = texts.select("row", "doc_id", "n_words", "hits", able(F.col("hits"), known, covered).alias("able"))
    # only votes for templates that may be there leave their row
    votes = F.filter("hits", lambda h: F.array_contains("able", h["t"]))
    found = texts.select("row", "doc_id", "n_words", F.explode_outer(votes).alias("hit")).select("row", "doc_id", "n_words", "hit.*")
    named = spark.createDataFrame([(t, f"{int(is_base)}:{' '.join(w)}", label, is_base, len(w) - 1) for t, (label, is_base, w) in enumerate(known)], "t int, template string, label string, is_base boolean, n_pairs int")
    found = found.join(F.broadcast(named), "t", "left")
    # votes of each diagonal, by the number of the row in its partition: ids may repeat
    key = ["row", "doc_id", "n_words"]
    place = F.struct("i", "at")
    lines = found.groupBy(*key, "template", "label", "is_base", "n_pairs", (F.col("i") - F.col("at")).alias("diagonal")).agg(F.collect_set(place).alias("votes"))
    # a diagonal and its neighbours; base phrases stay on one
    near = Window.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(-slack, slack)
    merged = F.array_sort(F.when(F.col("is_base"), F.col("votes")).otherwise(F.flatten(F.collect_list("votes").over(near))))
    spans = lines.select(*key, "template", "label", "is_base", "n_pairs", "diagonal", merged.alias("votes"))
    # votes that go forward in the template, in the order of the text
    forward = F.aggregate(
        "votes", F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n")),
        lambda s, v: F.when(v["at"] > s["at"], F.struct(v["at"].alias("at"), (s["n"] + 1).alias("n"))).otherwise(s), lambda s: s["n"],
    )
    spans = spans.select(
        *key, "template", "label", "is_base", "n_pairs", "diagonal", (forward / F.col("n_pairs")).alias("cover"),
        F.get("votes", 0)["i"].alias("first"), (F.element_at("votes", -1)["i"] + 1).alias("last"),
    )
    valid = F.col("is_base") & (F.col("cover") == 1) | ~F.col("is_base") & (F.col("cover") >= covered) & (F.col("last") - F.col("first") <= stretch * F.col("n_pairs") + slack)
    best = F.max(F.when(F.coalesce(valid, F.lit(False)), F.struct("cover", -F.col("diagonal")))).over(near)
    own = F.struct(F.col("cover"), -F.col("diagonal"))
    spans = spans.withColumn("valid", F.coalesce(valid & (F.col("is_base") | own.eqNullSafe(best)), F.lit(False)))
    is_base = F.col("valid") & F.col("is_base")
    labels = F.array_join(F.array_sort(F.collect_set(F.when(F.col("valid"), F.col("label")))), ",")
    result = spans.groupBy(*key).agg(
        F.count_if(is_base).alias("n_base"), F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"), labels.alias("labels"),
        F.coalesce(F.max(F.when(F.col("valid"), F.col("cover"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("valid"), F.struct("first", "last", "label")))).alias("spans"), F.count(F.lit(1)).alias("n_spans"),
    )
    return result.drop("row", "n_spans").withColumnRenamed("doc_id", id_col)


