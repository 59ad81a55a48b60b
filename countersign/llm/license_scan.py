"""License notices by diagonal voting, with built-in Spark functions only.

1. The scan cuts every text into words and hashes each run of ``GRAM`` words (a rolling k-gram).
2. All hashes are joined with the hashes of the templates, which carry the place in the
   template. A hit at word ``i`` of the text and ``j`` of the template votes for the diagonal
   ``i - j``: all words of one unbroken quotation vote for the same one.
3. Votes are aggregated per text, template and diagonal, then diagonals at most ``SHIFT`` apart
   whose words lie at most ``GAP`` apart are merged, since a word added or left out moves the rest
   of a notice by one.
4. A merged span is verified: its words must cover ``COVER`` of the template and ``DENSE`` of the
   span. Where spans overlap, the one that covers most words names the license.

The scan writes one row per text and one per hit, in one pass, so a row number cannot differ
between two evaluations. Hits of a text are combined before they are shuffled; a group is one
text, so a frequent notice or a hot source makes no large group.

Beside the templates, short *phrases* are looked for word by word; they are the base of the
result and hold whatever the votes say.

Edge cases: a NULL or empty text, or one without words, has zero words, no places (NULL first and
last), empty labels and score 0. A text shorter than a k-gram can still hold a phrase. Rows that
repeat, also with one ``doc_id``, are scanned and returned one by one; a NULL ``doc_id`` stays
NULL. An empty table gives an empty result. Other columns of the table play no part, whatever
their names. Two different k-grams with one 64-bit hash would count as equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

GRAM = 4
SHIFT, GAP = 6, 12
COVER, DENSE = 0.75, 0.6
#: Templates up to this many bytes are sent to all tasks; larger collections are joined by shuffle.
SENT_BYTES = 4 << 20
_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The phrases of the base and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices that public licenses ask to be placed in a work, and common short forms.
TEMPLATES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
_BASE = ("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "phrases")


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for NULL."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(1))


def _grams(words: str) -> Column:
    """Hash of the k-gram at each place of an array of words."""
    run = ", ".join(f"get({words}, i + {n})" for n in range(GRAM))
    return F.expr(
        f"if(size({words}) < {GRAM}, array(), transform(sequence(0, size({words}) - {GRAM}), i -> xxhash64({run})))"
    )


def template_grams(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, label, length, at, gram) of all templates of at least one k-gram."""
    rows = spark.createDataFrame(
        [(n, label, text) for n, (label, text) in enumerate(templates)], "template int, label string, body string"
    )
    cut = rows.select("template", "label", words_of(F.col("body")).alias("w"))
    return cut.select("template", "label", F.size("w").alias("length"), F.posexplode(_grams("w")).alias("at", "gram"))


def _phrase_at(phrases: Sequence[tuple[str, str]]) -> str:
    """Bit mask of the phrases that begin at word ``i``."""
    tests = []
    for n, (phrase, _) in enumerate(phrases):
        same = " and ".join(f"get(w, i + {k}) <=> '{word}'" for k, word in enumerate(phrase.split()))
        tests.append(f"if({same}, {1 << n}L, 0L)")
    return " + ".join(tests) or "0L"


def _scanned(
    documents: DataFrame, templates: DataFrame, phrases: Sequence[tuple[str, str]], broadcast: bool
) -> DataFrame:
    """One row per text at ``pos`` 0, and one per hit at ``pos`` = its word, counted from 1."""
    cut = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        words_of(F.col("text")).alias("w"),
    )
    # Every phrase holds its last word: texts without any of these are not looked through.
    maybe = " or ".join(f"array_contains(w, '{p.split()[-1]}')" for p in {x[0] for x in phrases}) or "false"
    found = cut.select(
        "row",
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.expr(
            f"""if(size(w) > 0 and ({maybe}), filter(transform(sequence(0, size(w) - 1),
                i -> struct(cast(i as bigint) as i, {_phrase_at(phrases)} as p)), x -> x.p > 0),
                cast(array() as array<struct<i: bigint, p: bigint>>))"""
        ).alias("b"),
        _grams("w").alias("g"),
    )
    rows = found.select(
        "row",
        "doc_id",
        "n_words",
        F.expr("aggregate(b, 0L, (n, x) -> n + bit_count(x.p))").alias("n_base"),
        F.expr("get(b, 0).i").alias("first_word"),
        F.expr("get(b, size(b) - 1).i").alias("last_word"),
        F.expr("aggregate(b, 0L, (n, x) -> n | x.p)").alias("phrases"),
        # The row of the text itself comes first and joins nothing.
        F.posexplode(F.concat(F.array("row"), F.col("g"))).alias("pos", "gram"),
    )
    side = templates.withColumnRenamed("gram", "_gram")
    side = F.broadcast(side) if broadcast else side
    joined = rows.join(side, (F.col("gram") == F.col("_gram")) & (F.col("pos") > 0), "left")
    return joined.where("pos = 0 or template is not null").drop("gram", "_gram")


def diagonals(hits: DataFrame) -> DataFrame:
    """Votes per text, template and diagonal, with the template's words hit."""
    return hits.groupBy(
        "row", "template", "label", "length", (F.col("pos") - 1 - F.col("at")).alias("diagonal")
    ).agg(F.sort_array(F.collect_set("at")).alias("at"))


def spans(votes: DataFrame) -> DataFrame:
    """Verified spans: (row, label, begin, end, covered, share), words counted from 0."""
    placed = votes.withColumn("begin", F.col("diagonal") + F.col("at")[0])
    placed = placed.withColumn("end", F.col("diagonal") + F.element_at("at", -1) + GRAM)
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("diagonal") - F.lag("diagonal").over(line) > SHIFT) | (F.col("begin") - reach > GAP)
    marked = placed.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    merged = (
        marked.withColumn("run", F.sum("_new").over(line))
        .groupBy("row", "template", "label", "length", "run")
        .agg(
            F.min("begin").alias("begin"),
            F.max("end").alias("end"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"),
            F.array_sort(
                F.array_distinct(F.flatten(F.collect_list(F.expr("transform(at, x -> x + diagonal)"))))
            ).alias("places"),
        )
    )

    def reached(places: str) -> Column:
        """Number of words under the k-grams that begin at the given places, in order."""
        return F.expr(
            f"""aggregate({places}, named_struct('n', 0, 'to', -1),
                (s, x) -> named_struct('n', s.n + x + {GRAM} - greatest(x, s.to), 'to', x + {GRAM}), s -> s.n)"""
        )

    counted = merged.select(
        "row", "template", "label", "length", "begin", "end", reached("at").alias("covered"), reached("places").alias("held")
    ).withColumn("share", F.col("covered") / F.col("length"))
    verified = counted.where((F.col("share") >= COVER) & (F.col("held") >= DENSE * (F.col("end") - F.col("begin"))))
    order = Window.partitionBy("row").orderBy("begin", "end", "template")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = verified.withColumn("_new", F.coalesce(F.col("begin") >= before, F.lit(True)).cast("int"))
    island = island.withColumn("island", F.sum("_new").over(order))
    best = Window.partitionBy("row", "island").orderBy(F.desc("covered"), F.desc("share"), "template", "begin")
    kept = island.withColumn("_place", F.row_number().over(best)).where("_place = 1")
    return kept.select("row", "label", "begin", "end", "covered", "share")


def scan(
    documents: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """Licenses of every row of ``documents`` (doc_id, text).

    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans): ``spans``
    are the verified quotations as (label, begin, end, share); ``score`` is 1 where a phrase stands,
    else the largest share of a template that a span covers.
    """
    spark = documents.sparkSession
    small = sum(len(text) for _, text in templates) * 8 <= SENT_BYTES
    base, found = located(documents, template_grams(spark, templates), phrases, broadcast=small)
    per_row = found.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("begin", "end", "label", "share"))).alias("spans"),
        F.max("share").alias("share"),
    )
    names = F.array(
        *(F.when(F.col("phrases").bitwiseAND(F.lit(1 << n)) > 0, F.lit(label)) for n, (_, label) in enumerate(phrases))
    )
    known = F.array_sort(F.array_distinct(F.array_compact(names)))
    quoted = F.coalesce(F.expr("transform(spans, x -> x.label)"), F.array().cast("array<string>"))
    return base.join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(known, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(known, quoted))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        "spans",
    )


def located(
    documents: DataFrame, grams: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, *, broadcast: bool = True
) -> tuple[DataFrame, DataFrame]:
    """One row per text, and the verified spans, joined by ``row``."""
    rows = written(_scanned(documents, grams, phrases, broadcast), "licenses")
    base = rows.where("pos = 0").select(*_BASE)
    return base, spans(diagonals(rows.where("pos > 0")))


def oracle_sql(
    templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES
) -> str:
    """The same for DuckDB: k-grams are joined as lists of words instead of hashes."""

    def quote(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def cut(text: str) -> str:
        return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    bodies = ", ".join(f"({n}, {quote(label)}, {quote(text)})" for n, (label, text) in enumerate(templates))
    sought = ", ".join(f"({quote(p)}, {quote(label)})" for p, label in phrases)
    return rf"""
WITH t AS (
  SELECT template, label, {cut("body")} AS w FROM (VALUES {bodies}) AS v(template, label, body)
), tg AS (
  SELECT template, label, len(w) AS length, u.j AS j, w[u.j + 1 : u.j + {GRAM}] AS gram
  FROM t, unnest(range(0, greatest(len(w) - {GRAM} + 1, 0))) AS u(j)
), d AS (
  SELECT row_number() OVER () AS "row", doc_id, {cut("text")} AS w FROM documents
), p AS (
  SELECT string_split(phrase, ' ') AS pw, label FROM (VALUES {sought}) AS v(phrase, label)
), places AS (
  SELECT d."row", p.label, u.i FROM d, p, unnest(range(0, greatest(len(d.w) - len(p.pw) + 1, 0))) AS u(i)
  WHERE list_contains(d.w, p.pw[1]) AND d.w[u.i + 1 : u.i + len(p.pw)] = p.pw
), based AS (
  SELECT "row", count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS names
  FROM places GROUP BY "row"
), g AS (
  SELECT d."row", u.i, d.w[u.i + 1 : u.i + {GRAM}] AS gram
  FROM d, unnest(range(0, greatest(len(d.w) - {GRAM} + 1, 0))) AS u(i)
), hits AS (
  SELECT g."row", tg.template, tg.label, tg.length, tg.j, g.i, g.i - tg.j AS diagonal FROM g JOIN tg USING (gram)
), votes AS (
  SELECT "row", template, label, length, diagonal, min(i) AS "begin", max(i) + {GRAM} AS "end"
  FROM hits GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER line <= {SHIFT}
                  AND "begin" - max("end") OVER before <= {GAP} THEN 0 ELSE 1 END AS fresh
  FROM votes
  WINDOW line AS (PARTITION BY "row", template ORDER BY diagonal),
         before AS (PARTITION BY "row", template ORDER BY diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), runs AS (
  SELECT "row", template, label, length, diagonal,
         sum(fresh) OVER (PARTITION BY "row", template ORDER BY diagonal) AS run
  FROM marked
), merged AS (
  SELECT "row", template, label, length, run, min(i) AS "begin", max(i) + {GRAM} AS "end",
         len(list_distinct(flatten(list([j + k FOR k IN range({GRAM})])))) AS covered,
         len(list_distinct(flatten(list([i + k FOR k IN range({GRAM})])))) AS held
  FROM hits JOIN runs USING ("row", template, label, length, diagonal) GROUP BY ALL
), verified AS (
  SELECT *, covered / length AS share FROM merged
  WHERE covered / length >= {COVER} AND held >= {DENSE} * ("end" - "begin")
), isles AS (
  SELECT *, CASE WHEN "begin" < max("end") OVER (PARTITION BY "row" ORDER BY "begin", "end", template
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
  FROM verified
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY "row" ORDER BY "begin", "end", template ROWS UNBOUNDED PRECEDING) AS isle
  FROM isles
), kept AS (
  SELECT * FROM numbered
  QUALIFY row_number() OVER (PARTITION BY "row", isle ORDER BY covered DESC, share DESC, template, "begin") = 1
), quoted AS (
  SELECT "row", list(DISTINCT label) AS names, max(share) AS share FROM kept GROUP BY "row"
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base,
       b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.names), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.names, []), coalesce(q.names, [])))), ','), '') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(q.share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN based b USING ("row") LEFT JOIN quoted q USING ("row")
"""
