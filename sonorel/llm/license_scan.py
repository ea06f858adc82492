"""Licence scanning by diagonal voting, with DataFrame functions only.

Every rolling word pair of every text is hashed and joined to the places where a template holds
that pair; the words themselves are compared too. A hit at text place p and template place j
lies on diagonal p - j, so a diagonal is one way to lay the template over the text, and its hits
are a mask of template places. Neighbouring diagonals (words put in or left out between) are
merged: an alignment follows one diagonal up to some place of the template and another, at most
``SLACK`` away, from there on, and never goes back in the text. A span is verified, and its
label given, if the best alignment holds ``COVERED`` of the template's pairs; a pair counts
once, however often the text repeats it. A base phrase counts only where one diagonal holds all
its pairs.

The template table is fixed in this module and has a few hundred rows, so it is broadcast. The
text is never shuffled: one exchange, by row, moves a few numbers per hit and per document.

Defined results: a null text is empty: no words, no labels, score 0, first_word and last_word
null; repeated rows and null doc_ids each get their own row; extra columns are not carried; an
empty table gives no rows. Templates have 2 to 63 words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What stands between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of public licence texts and notices, and the labels that the method adds for them.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
COVERED, SLACK = 0.9, 2
_END = -1
_HIT = "w string, v string, template int, place int, pairs int, phrase boolean"


def words_of(text: Column) -> Column:
    """A text's words. Lower-casing more than A-Z moves no word's edge and makes no word of the templates, but for the Kelvin sign."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.contains(text, F.lit("\u212a")), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, BETWEEN), "")


def _templates(spark) -> DataFrame:
    rows = [("", "", _END, 0, 0, False)]
    for number, text in enumerate([*PHRASES, *NOTICES]):
        w = text.split()
        if not 2 <= len(w) <= 63:
            raise ValueError(f"a template has 2 to 63 words: {text}")
        rows += [(a, b, number, j, len(w) - 1, text in PHRASES) for j, (a, b) in enumerate(zip(w, w[1:]))]
    table = spark.createDataFrame(rows, _HIT)
    return table.withColumn("gram", F.when(F.col("template") == _END, F.lit(0)).otherwise(F.xxhash64("w", "v")))


def _hits(docs: DataFrame) -> DataFrame:
    """Places where a text's word pair stands in a template, and one row of template _END for each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words"))
    # the place after the last word stands for the document itself
    placed = rows.select("row", "doc_id", "n_words", "words", F.explode(F.sequence(F.lit(0), F.col("n_words"))).alias("pos"))
    pairs = placed.select("row", "doc_id", "n_words", "pos", F.get("words", F.col("pos")).alias("a"), F.get("words", F.col("pos") + 1).alias("b"))
    pairs = pairs.where(F.col("b").isNotNull() | (F.col("pos") == F.col("n_words")))
    pairs = pairs.withColumn("gram", F.when(F.col("b").isNull(), F.lit(0)).otherwise(F.xxhash64("a", "b")))
    ends = F.col("b").isNull() & (F.col("template") == _END)
    met = pairs.join(F.broadcast(_templates(docs.sparkSession)), "gram").where(ends | (F.col("a") == F.col("w")) & (F.col("b") == F.col("v")))
    diagonal = F.when(F.col("template") == _END, F.lit(0)).otherwise(F.col("pos") - F.col("place"))
    return met.select("row", "doc_id", "n_words", "template", "place", "pairs", "phrase", diagonal.alias("diagonal"))


def _ones(mask: Column) -> Column:
    return F.bit_count(mask).cast("int")


def _aligned(near: Column) -> Column:
    """Most pairs in order on this diagonal up to a place and on one of ``near`` from there on."""

    def with_other(d: Column) -> Column:
        gap = F.greatest(F.col("diagonal") - d["diagonal"], F.lit(0))

        def split(s: Column) -> Column:
            first = F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s) - 1)
            return _ones(first) + _ones(F.call_function("shiftright", d["mask"], F.least(s + gap, F.lit(63))))

        return F.array_max(F.transform(F.sequence(F.lit(0), F.col("pairs")), split))

    return F.array_max(F.transform(near, with_other))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row."""
    hits = _hits(docs).repartition("row")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))
    diagonals = hits.groupBy("row", "template", "diagonal").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("pairs").alias("pairs"), F.max("phrase").alias("phrase"), F.bit_or(bit).alias("mask")
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-SLACK, SLACK)
    diagonals = diagonals.withColumn("near", F.collect_list(F.struct("diagonal", "mask")).over(near))  # 2 * SLACK + 1 at most
    is_end, full = F.col("template") == _END, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pairs")) - 1
    whole = ~is_end & F.col("phrase") & (F.col("mask") == full)
    cover = F.when(is_end, F.lit(0.0)).when(F.col("phrase"), whole.cast("double")).otherwise(_aligned(F.col("near")) / F.col("pairs"))
    marked = diagonals.select("row", "doc_id", "n_words", "template", "diagonal", whole.alias("whole"), cover.alias("cover"))
    names = [*PHRASES.values(), *NOTICES.values()]
    order = sorted(set(names))

    def flag(when: Column) -> Column:
        place = F.element_at(F.array(*[F.lit(order.index(x)) for x in names]), F.greatest(F.col("template"), F.lit(0)) + 1)
        return F.coalesce(F.bit_or(F.when(when, F.call_function("shiftleft", F.lit(1).cast("long"), place))), F.lit(0).cast("long"))

    out = marked.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.sum(F.col("whole").cast("long")).alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(F.col("whole"), F.col("diagonal"))).cast("long").alias("last_word"),
        flag(F.col("whole")).alias("base"), flag((F.col("template") != _END) & (F.col("cover") >= COVERED)).alias("any"), F.max("cover").alias("score"),
    )

    def labels(mask: str) -> Column:
        return F.concat_ws(",", *[F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.lit(x)) for i, x in enumerate(order)])

    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", labels("base").alias("base_labels"), labels("any").alias("labels"), "score")


def sql() -> str:
    """The same result in DuckDB's SQL: every pair of words against every template, every alignment of two diagonals."""
    rows = []
    for number, (text, label) in enumerate([*PHRASES.items(), *NOTICES.items()]):
        rows.append(f"({number}, '{label}', {str(text in PHRASES).lower()}, '{text}')")
    return rf"""
WITH tpl(template, label, phrase, t) AS (VALUES {", ".join(rows)}),
tw AS (SELECT template, label, phrase, string_split(t, ' ') AS t FROM tpl),
grams AS (SELECT template, label, phrase, CAST(len(t) - 1 AS INTEGER) AS pairs, CAST(j - 1 AS INTEGER) AS place, t[j] AS a, t[j + 1] AS b FROM tw, range(1, 64) r(j) WHERE j < len(t)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, unnest(w) AS a, unnest(list_append(w[2:], '')) AS b, unnest(range(0, len(w))) AS pos FROM d),
diag AS (SELECT r, template, label, phrase, pairs, pos - place AS g, CAST(sum(CAST(1 AS BIGINT) << place) AS BIGINT) AS m FROM p JOIN grams USING (a, b) GROUP BY ALL),
cover AS (
    SELECT r, label, g, phrase AND m = (CAST(1 AS BIGINT) << pairs) - 1 AS whole, CASE WHEN phrase THEN CASE WHEN m = (CAST(1 AS BIGINT) << pairs) - 1 THEN 1.0::DOUBLE ELSE 0 END ELSE best / CAST(pairs AS DOUBLE) END AS cover
    FROM (SELECT x.r, x.label, x.g, x.phrase, x.pairs, x.m, max(bit_count(x.m & ((CAST(1 AS BIGINT) << s) - 1)) + bit_count(y.m >> CAST(least(s + greatest(x.g - y.g, 0), 62) AS INTEGER))) AS best
        FROM diag x JOIN diag y ON x.r = y.r AND x.template = y.template AND abs(x.g - y.g) <= {SLACK}, range(0, 64) q(s) WHERE s <= x.pairs GROUP BY ALL)
),
found AS (
    SELECT r, count(*) FILTER (WHERE whole) AS n_base, min(g) FILTER (WHERE whole) AS first_word, max(g) FILTER (WHERE whole) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE cover >= {COVERED}) AS labels, max(cover) AS score
    FROM cover GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found USING (r)
"""
