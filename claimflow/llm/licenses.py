"""License scans: diagonal voting of word k-grams against license templates, in DataFrame operations alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimflow.llm.common import ascii_lower, table

#: Phrases of the base rule and their labels (fixed values).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Notices as their licenses word them, by label.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: ASCII characters that are no letter or digit.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Words of a text: runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z lower-cased."""
    parts = F.filter(F.split(text, BREAKS), lambda w: w != "")
    return F.transform(parts, ascii_lower)


def gram_hashes(words: Column, k: int) -> Column:
    """Hash of the ``k`` words from each word on; empty if there are fewer words."""
    last = F.size(words) - k
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def phrase_columns(words: Column, phrases: list[tuple[str, str]]) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of a word array.

    Each word is wrapped in two blanks of its own, so places of a phrase never overlap
    and blanks count the words before a place.
    """
    wrapped = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    blanks = lambda s: ((F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        look = F.lit(" " + phrase.replace(" ", "  ") + " ")
        width = F.char_length(look)
        n = ((F.char_length(wrapped) - F.char_length(F.replace(wrapped, look, F.lit("")))) / width).cast("long")
        before_first = F.instr(wrapped, look) - 1
        before_last = F.char_length(wrapped) - F.instr(F.reverse(wrapped), F.reverse(look)) + 1 - width
        places.append(n)
        firsts.append(F.when(n > 0, blanks(F.left(wrapped, before_first))))
        lasts.append(F.when(n > 0, blanks(F.left(wrapped, before_last))))
        labels.append(F.when(n > 0, F.lit(label)))
    return {
        "n_base": sum(places, F.lit(0)).cast("long"),
        "first_word": F.least(*firsts),
        "last_word": F.greatest(*lasts),
        "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def template_grams(spark, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """gram, template, tpos, label, grams (number of the template's grams). Its size is that of the template list."""
    frame = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    words = frame.withColumn("words", license_words(F.col("text")))
    grams = words.withColumn("all", gram_hashes(F.col("words"), k)).withColumn("grams", F.size("all"))
    return grams.select("template", "label", "grams", F.posexplode("all").alias("tpos", "gram"))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    phrases: list[tuple[str, str]] | None = None,
    k: int = 3,
    drift: int = 2,
    coverage: float = 0.8,
    most_template_grams: int = 100_000,
) -> DataFrame:
    """License notices of every text: base phrases, and templates found by diagonal voting.

    Every rolling ``k``-gram hash of every text is joined to the templates' positions; a
    hit votes for the diagonal (text position - template position). Votes
    are summed by text, template and diagonal; diagonals at most ``drift`` apart
    are one span; it is a find if the distinct template grams it holds are at least
    ``coverage`` of the template's and it is no longer than the template and the drift allow.
    The template side is broadcast; its size is checked against ``most_template_grams``.

    Columns: id, n_words, n_base, first_word, last_word, base_labels and labels (sorted
    arrays), spans (array of label, first_word, n_words, coverage), score (best
    coverage; 1 where a base phrase stands). Null or empty text: no words, nothing
    found. Repeated rows: a row each. Null id: kept. No rows: no rows. Other columns
    are ignored. A template of fewer than ``k`` words is refused.
    """
    spark = docs.sparkSession
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    grams = template_grams(spark, templates, k)
    size = grams.agg(F.countDistinct("template"), F.count("*")).first()
    if size[0] < len(templates) or size[1] > most_template_grams:
        raise ValueError(f"{len(templates)} templates with {size[1]} grams: at least {k} words each, {most_template_grams} grams in all")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))

    # words are a column of their own: inside a lambda an expression would run once per word
    words = rows.select("id", "th", license_words(F.col("text")).alias("words"))
    rolled = words.select("id", "th", F.posexplode(gram_hashes(F.col("words"), k)).alias("pos", "gram"))
    hits = rolled.join(F.broadcast(grams), "gram")
    # sets and extremes: repeated rows of one id and text change nothing
    votes = hits.groupBy("id", "th", "template", "label", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("voted"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    order = Window.partitionBy("id", "th", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(True))
    votes = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
    spans = votes.groupBy("id", "th", "template", "label", "grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("voted")))).alias("own"),
        F.min("first").cast("long").alias("first"),
        (F.max("last") - F.min("first") + k).cast("long").alias("width"),
    )
    share = F.col("own") / F.col("grams")
    spans = spans.where((share >= coverage) & (F.col("width") <= F.col("grams") + k - 1 + 2 * drift))
    span = F.struct("label", F.col("first").alias("first_word"), F.col("width").alias("n_words"), share.alias("coverage"))
    finds = spans.groupBy("id", "th").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    finds = finds.select(F.col("id").alias("fid"), F.col("th").alias("fth"), "spans")

    counted = words.select("id", "th", F.size("words").cast("long").alias("n_words"), F.col("words"))
    holds = [F.array_contains("words", phrase.split(" ")[-1]) for phrase, _ in phrases]
    found = phrase_columns(F.col("words"), phrases)
    base = F.when(reduce(Column.__or__, holds), F.struct(*[c.alias(name) for name, c in found.items()]))
    based = counted.select("id", "th", "n_words", base.alias("base"))
    joined = based.join(finds, based["id"].eqNullSafe(finds["fid"]) & (based["th"] == finds["fth"]), "left")
    none = F.array().cast("array<string>")
    base_labels = F.coalesce("base.base_labels", none)
    span_labels = F.coalesce(F.transform("spans", lambda x: x["label"]), none)
    n_base = F.coalesce("base.n_base", F.lit(0)).cast("long")
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        n_base.alias("n_base"),
        "base.first_word",
        "base.last_word",
        base_labels.alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base_labels, span_labels))).alias("labels"),
        "spans",
        F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """:func:`scan_licenses` of all ``documents``, labels comma-joined."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = {x: F.array_join(x, ",") for x in ("base_labels", "labels")}
    return found.withColumns(joined).drop("spans")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP7_SQL = f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM documents
), words AS (
  SELECT doc_id, r, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS w0 FROM texts
), rolled AS (
  SELECT *, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)
), base_hits AS (
  SELECT r, pos, p.label FROM rolled JOIN (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in PHRASES)}) p(phrase, label)
    ON w0 || ' ' || w1 = phrase OR w0 || ' ' || w1 || ' ' || w2 = phrase
), base AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels
  FROM base_hits GROUP BY r
), templates AS (
  SELECT template, label, regexp_extract_all(lower(text), '[0-9a-z]+') AS w
  FROM (VALUES {", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))}) t(template, label, text)
), tgrams AS (
  SELECT template, label, len(w) - 2 AS grams, unnest(range(len(w) - 2)) AS tpos, w FROM templates
), hits AS (
  SELECT r, template, label, grams, pos - tpos AS diagonal, tpos, pos FROM rolled JOIN tgrams
    ON w0 = w[tpos + 1] AND w1 = w[tpos + 2] AND w2 = w[tpos + 3]
), votes AS (
  SELECT r, template, label, grams, diagonal, list(DISTINCT tpos) AS voted, min(pos) AS f, max(pos) AS l FROM hits GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS apart FROM votes
), numbered AS (
  SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM marked
), spans AS (
  SELECT r, label, grams, len(list_distinct(flatten(list(voted)))) AS own, max(l) - min(f) + 3 AS width
  FROM numbered GROUP BY r, template, label, grams, span
), finds AS (
  SELECT r, list(label) AS labels, max(own / grams) AS best FROM spans WHERE own / grams >= 0.8 AND width <= grams + 6 GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(finds.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM texts LEFT JOIN base USING (r) LEFT JOIN finds USING (r)
"""
