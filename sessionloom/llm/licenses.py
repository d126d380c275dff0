"""License scans by diagonal voting: word k-grams of documents meet those of templates, and matches vote by offset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import written
from sessionloom.llm.exact_dedup import ascii_lower

#: Words of a template's k-grams, and of those of a template with fewer words; percent of a template's words that a span must
#: have; words by which neighbouring diagonals of one span may lie apart.
WORDS, SHORT_WORDS, PERCENT, SLACK = 5, 2, 80, 8
#: An index of template k-grams of at most so many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: What no word contains (fixed value).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases whose places are the base (fixed values).
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: License notices as their publishers word them (fixed values).
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]


def words_of(text: Column) -> Column:
    """The words of a text after lower-casing A-Z: runs of letters, digits and characters beyond ASCII. Null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _grams(k: int, of: str = "w") -> Column:
    """The hashes of the k-grams that start at each word."""
    words = ", ".join(f"{of}[i + {j}]" for j in range(k))
    return F.expr(f"if(size({of}) >= {k}, transform(sequence(0, size({of}) - {k}), i -> xxhash64({k}, {words})), array())")


def _rolled(k: int) -> Column:
    """The hash of the k-gram that starts at the word before place p; null at place 0 and where the text ends before."""
    words = ", ".join(f"get(w, p - 1 + {j})" for j in range(k))
    return F.expr(f"if(p > 0 and p - 1 + {k} <= n_words, xxhash64({k}, {words}), cast(null as long))")


def _gram(k: Column, at: Column, of: str = "w") -> Column:
    return F.array_join(F.slice(of, at + 1, k), " ")


def default_templates(spark: SparkSession) -> DataFrame:
    """(template, label, text, exact): the phrases, whose places count one by one and in full, then the notices."""
    rows = [(i, label, text, i < len(PHRASES)) for i, (label, text) in enumerate(PHRASES + NOTICES)]
    return spark.createDataFrame(rows, "template int, label string, text string, exact boolean")


def license_spans(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, slack: int = SLACK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: id, n_words, and spans, an array of (template, label, exact, start, end, cover) in order.

    templates: template (a number that tells them apart), label, text, exact. A template of SHORT_WORDS words or more is
    cut into k-grams (of WORDS words, or of SHORT_WORDS if it has fewer than WORDS); smaller ones, and null ones, match
    nothing. Every k-gram hash of every document joins the templates' positions; the words themselves are compared, too. A
    match votes for the diagonal on which its template begins. Votes are counted by diagonal; diagonals up to `slack`
    words apart merge, which bears words put in or left out. A span is verified if the template's words that its k-grams
    cover are `percent` % or more; cover is that share. An exact template takes each diagonal alone, in full.

    Null and empty texts have no words and no spans; repeated ids and rows count apart; ties are ordered by template; an
    empty table gives an empty result. Texts are read once, whole; partial counts go before each shuffle, on (row,
    template), so that a k-gram which fills the corpus is no key.
    """
    spark = docs.sparkSession
    cut = templates.select("template", "label", "exact", F.explode(F.array(words_of(F.col("text")))).alias("w"))
    cut = cut.withColumn("k", F.when(F.size("w") >= WORDS, WORDS).otherwise(SHORT_WORDS)).withColumn("hs", F.when(F.size("w") >= WORDS, _grams(WORDS)).otherwise(_grams(SHORT_WORDS)))
    index = written(cut.select("template", "label", "exact", F.size("w").alias("size"), "k", "w", F.posexplode("hs").alias("j", "h")).withColumn("gram", _gram(F.col("k"), F.col("j"))).drop("w"), "templates")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "id", F.explode(F.array(words_of(F.col("text")))).alias("w"))
    # place 0 stands for the document itself and meets no template; grams are made a word at a time, after the generator,
    # where Catalyst compiles them
    rows = rows.select("row", "id", "w", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("p", "word"))
    grams = F.array(*(F.struct(F.lit(k).alias("width"), _rolled(k).alias("h")) for k in (SHORT_WORDS, WORDS)))
    rows = rows.select("row", "id", "w", "n_words", "p", F.inline(grams)).filter(F.col("h").isNotNull() | ((F.col("p") == 0) & (F.col("width") == WORDS)))
    i = F.col("p") - 1
    keep = ["template", "label", "exact", "size", "k", "j"]
    if index.agg(F.coalesce(F.sum(F.octet_length("gram") + 64), F.lit(0))).first()[0] <= broadcast_bytes:
        met = rows.join(F.broadcast(index), "h", "left").filter((F.col("p") == 0) | (F.col("gram") == _gram(F.col("k"), i)))
    else:
        met = rows.select("row", "id", "n_words", "p", "h", F.when(F.col("p") > 0, _gram(F.col("width"), i)).alias("gram")).join(index, ["h", "gram"], "left").filter("p = 0 or template is not null")
    met = written(met.select("row", "id", "n_words", "p", F.when(F.col("p") > 0, i).alias("i"), *keep), "grams")
    of = ["row", "template", "label", "exact", "size", "k"]
    diagonals = met.filter("p > 0").groupBy(*of, (F.col("i") - F.col("j")).alias("diagonal")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.collect_set("j").alias("js"))
    near = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(near) > F.when(F.col("exact"), 0).otherwise(slack)
    merged = diagonals.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(near)).select(*of, "span", "first", "last", F.explode("js").alias("j"))
    merged = merged.groupBy(*of, "span").agg(F.min("first").alias("start"), F.max("last").alias("last"), F.sort_array(F.collect_set("j")).alias("js"))
    # template words under the k-grams: each adds k words, or as many as it lies behind the one before
    covered = F.expr("aggregate(transform(js, (j, n) -> if(n = 0, k, least(k, j - js[n - 1]))), 0, (a, b) -> a + b)")
    merged = merged.withColumn("cover", covered / F.col("size")).filter(F.when(F.col("exact"), F.col("cover") == 1).otherwise(covered * 100 >= F.col("size") * percent))
    span = F.struct("start", "template", "label", "exact", (F.col("last") + F.col("k")).alias("end"), "cover")
    spans = merged.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return met.filter("p = 0").join(spans, "row", "left").select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("spans", none).alias("spans"))


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    done = license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_templates(spark))
    base = F.filter("spans", lambda s: s["exact"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    start = F.transform(base, lambda s: s["start"].cast("long"))
    return done.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"))


def _values() -> str:
    texts = [(label, reduce(lambda t, x: t.replace(*x), [("'", "''")], text)) for label, text in PHRASES + NOTICES]
    return ", ".join(f"({i}, '{label}', '{text}', {i < len(PHRASES)})" for i, (label, text) in enumerate(texts))


OP13_SQL = rf"""
WITH texts AS (
  SELECT -1 - row_number() OVER () AS no, doc_id, NULL AS label, false AS exact, text FROM documents
  UNION ALL SELECT no, NULL, label, exact, text FROM (VALUES {_values()}) AS t(no, label, text, exact)),
cut AS (
  SELECT no, doc_id, label, exact, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
grams AS (
  SELECT no, label, exact, len(w) AS size, k, i, array_to_string(w[i + 1:i + k], ' ') AS gram
  FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM cut CROSS JOIN (VALUES ({SHORT_WORDS}), ({WORDS})) AS width(k) WHERE len(w) >= k AND (no < 0 OR k = CASE WHEN len(w) >= {WORDS} THEN {WORDS} ELSE {SHORT_WORDS} END))),
met AS (SELECT d.no AS doc, t.no AS template, t.label, t.exact, t.size, t.k, d.i, t.i AS j, d.i - t.i AS diagonal FROM grams d JOIN grams t USING (k, gram) WHERE d.no < 0 AND t.no >= 0),
steps AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc, template ORDER BY diagonal) > CASE WHEN exact THEN 0 ELSE {SLACK} END AS apart FROM met),
merged AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc, template ORDER BY diagonal) AS span FROM steps),
found AS (
  SELECT doc, template, label, exact, size, span, min(i) AS start, count(DISTINCT j + o) AS covered
  FROM merged CROSS JOIN range({WORDS}) AS within(o) WHERE o < k GROUP BY doc, template, label, exact, size, span),
good AS (SELECT *, covered / size AS cover FROM found WHERE CASE WHEN exact THEN covered = size ELSE covered * 100 >= size * {PERCENT} END)
SELECT c.doc_id, any_value(len(w)) AS n_words, count(template) FILTER (g.exact) AS n_base, min(start) FILTER (g.exact) AS first_word, max(start) FILTER (g.exact) AS last_word,
  coalesce(string_agg(DISTINCT g.label, ',' ORDER BY g.label) FILTER (g.exact), '') AS base_labels, coalesce(string_agg(DISTINCT g.label, ',' ORDER BY g.label), '') AS labels, coalesce(max(cover), 0.0) AS score
FROM cut c LEFT JOIN good g ON g.doc = c.no WHERE c.no < 0 GROUP BY c.no, c.doc_id
"""

