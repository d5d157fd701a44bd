"""Licence scans by the Dice coefficient of word bigrams, by DataFrame functions alone.

A text is normalised to its words, over all line breaks. Its bigrams meet an index of the templates' bigrams; a template
of b bigrams can reach the threshold t only where at least b * t / (2 - t) of them stand in the text, a bound that spares
nearly all pairs of text and template. For the rest every window of the template's length that begins with one of its
bigrams is compared with it, bigrams counted as often as they stand, in one pass over the occurrences. So a notice is found in any wrapping, in the midst of
a line and with words changed.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm._common import table

THRESHOLD = 0.7
#: Bigrams of all templates up to which their index may be broadcast: some 10 MB.
INDEX_ROWS = 200_000

# The usual notices and grants of public licences, as their texts ask for them.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "AGPL-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "Apache-2.0-terms": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def words_of(text: str) -> list[str]:
    """The words of a template: lower-cased, parted by all but letters a to z and digits."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return kept.split()


def bigrams_of(text: str) -> list[str]:
    """The bigrams of a template in order, repeats included."""
    w = words_of(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def _index(spark: SparkSession, templates: dict[str, str], threshold: float) -> DataFrame:
    """name, gram, most (how often the template has it), grams (all of the template's) and least (how many a match shares)."""
    rows = []
    for name, text in sorted(templates.items()):
        grams = bigrams_of(text)
        rows += [(name, gram, n, len(grams), len(grams) * threshold / (2 - threshold)) for gram, n in sorted(Counter(grams).items())]
    index = spark.createDataFrame(rows, "name string, gram string, most int, grams int, least double")
    index = index.withColumn("gram", F.xxhash64(F.xxhash64(F.substring_index("gram", " ", 1)), F.xxhash64(F.substring_index("gram", " ", -1))))
    return F.broadcast(index) if len(rows) <= INDEX_ROWS else index


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))


def _events(places: Column, grams: Column) -> Column:
    """What changes a window's shared bigrams as its start moves on, sorted: (at, kind) of each occurrence twice.

    places: of each bigram its positions in order and how often the template has it. An occurrence at p counts in the
    windows that begin after `low` and not after p: low is the bigram's `most`-th occurrence before it, or p - grams if that
    is nearer. kind 1 at low: it counts from there on; kind 0 at p: a window begins here, and it counts no more after it.
    """

    def each(g: Column) -> Column:
        def both(p: Column, i: Column) -> Column:
            before = F.when(i >= g["most"], F.get(g["at"], i - g["most"])).otherwise(-1)
            return F.array(F.struct(F.greatest(before, p - grams).alias("at"), F.lit(1).alias("kind")), F.struct(p.alias("at"), F.lit(0).alias("kind")))

        return F.flatten(F.transform(g["at"], both))

    return F.array_sort(F.flatten(F.transform(places, each)))


def _best_window(events: Column, grams: Column, words: Column) -> Column:
    """(dice, first word, negative) of the best window that begins with an occurrence; the first of equal ones. One pass."""
    none = F.struct(F.lit(-1.0).alias("dice"), F.lit(0).cast("int").alias("place"))

    def step(s: Column, e: Column) -> Column:
        window = F.struct((F.lit(2.0) * s["shared"] / (F.least(grams, words - 1 - e["at"]) + grams)).alias("dice"), (-e["at"]).cast("int").alias("place"))
        here = e["kind"] == 0
        return F.struct((s["shared"] + F.when(here, -1).otherwise(1)).cast("int").alias("shared"), F.when(here, F.greatest(s["best"], window)).otherwise(s["best"]).alias("best"))

    return F.aggregate(events, F.struct(F.lit(0).cast("int").alias("shared"), none.alias("best")), step, lambda s: s["best"])


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, dice, first_word and matches of every row of docs (doc_id, text).

    license is the template of the largest coefficient of any window, ties to the smaller name, dice that coefficient,
    first_word the number of words before the first such window, and matches the number of templates that reach the
    threshold; with none the first three are null. Words are runs of A-Z, a-z and 0-9 without regard to case. Null or
    empty texts match nothing. Rows that repeat an id are rows of their own. Bigrams meet by a 64-bit hash. An empty table
    gives an empty result. Only positions of bigrams that a template has are shuffled, a text's own together.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    # Rows are known by two hashes of id and text; rows that are wholly alike have one result.
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("k"), F.xxhash64(F.lit(1), text, "doc_id").alias("l"))
    words = keyed.where("text is not null").select("k", "l", F.transform(_words(F.col("text")), lambda w: F.xxhash64(F.lower(w))).alias("w"))
    # No filter on the words: it would be evaluated before them, and so cut the text a second time.
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    # The size is taken before the bigrams part, lest every one of them carries all words.
    grams = words.select("k", "l", F.size("w").alias("words"), pairs.alias("pairs")).select("k", "l", "words", F.posexplode("pairs").alias("at", "gram"))
    hits = grams.join(_index(spark, templates, threshold), "gram")
    places = hits.groupBy("k", "l", "words", "name", "gram", "most", "grams", "least").agg(F.sort_array(F.collect_set("at")).alias("at"))
    pair = places.groupBy("k", "l", "words", "name", "grams", "least").agg(F.sum(F.least(F.size("at"), F.col("most"))).alias("shared"), F.collect_list(F.struct("at", "most")).alias("places"))
    scored = pair.where("shared >= least").withColumn("events", _events(F.col("places"), F.col("grams")))
    scored = scored.withColumn("best", _best_window(F.col("events"), F.col("grams"), F.col("words")))
    # The threshold holds within the aggregates: a filter would be moved before the hits and work them out for each of them.
    reached = F.col("best")["dice"] >= threshold
    top = F.min(F.when(reached, F.struct((-F.col("best")["dice"]).alias("dice"), "name", (-F.col("best")["place"]).alias("place"))))
    found = scored.groupBy("k", "l").agg(top.alias("top"), F.count_if(reached).alias("matches"))
    out = keyed.select("doc_id", "k", "l").join(found, ["k", "l"], "left")
    return out.select("doc_id", F.col("top")["name"].alias("license"), (-F.col("top")["dice"]).alias("dice"), F.col("top")["place"].cast("long").alias("first_word"), F.coalesce("matches", F.lit(0)).cast("long").alias("matches"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = ", ".join(f"('{name}', [{', '.join(repr(x) for x in bigrams_of(text))}])" for name, text in sorted(TEMPLATES.items()))
    return rf"""
WITH t(name, own) AS (VALUES {rows}),
i AS (SELECT name, gram, count(*) AS most, any_value(b) AS b FROM (SELECT name, unnest(own) AS gram, len(own) AS b FROM t) GROUP BY name, gram),
d AS (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents),
w AS (
  SELECT rowid, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM d
), g AS (SELECT rowid, len(w) AS words, w, unnest(range(1, len(w))) AS p FROM w),
h AS (SELECT rowid, words, name, b, p, i.gram, most FROM g JOIN i ON w[p] || ' ' || w[p + 1] = i.gram),
r AS (
  SELECT rowid, name FROM (SELECT rowid, name, b, gram, least(count(*), any_value(most)) AS n FROM h GROUP BY rowid, name, b, gram)
  GROUP BY rowid, name, b HAVING sum(n) >= b * {THRESHOLD} / (2 - {THRESHOLD})
), s AS (
  SELECT rowid, name, p, b, words, sum(n) AS shared FROM (
    SELECT x.rowid, x.name, x.p, x.b, x.words, y.gram, least(count(*), any_value(y.most)) AS n
    FROM h x JOIN r USING (rowid, name) JOIN h y ON x.rowid = y.rowid AND x.name = y.name AND y.p BETWEEN x.p AND x.p + x.b - 1
    GROUP BY ALL
  ) GROUP BY ALL
), m AS (
  SELECT rowid, name, p, 2.0::DOUBLE * shared / (least(b, words - p) + b) AS dice FROM s
), o AS (
  SELECT *, row_number() OVER (PARTITION BY rowid ORDER BY dice DESC, name, p) AS place FROM m WHERE dice >= {THRESHOLD}
), n AS (SELECT rowid, count(DISTINCT name) AS matches FROM o GROUP BY rowid)
SELECT d.doc_id, o.name AS license, o.dice, o.p - 1 AS first_word, coalesce(n.matches, 0)::BIGINT AS matches
FROM d LEFT JOIN (SELECT * FROM o WHERE place = 1) o USING (rowid) LEFT JOIN n USING (rowid)
"""


ORACLE_SQL = _oracle()
