"""License scans by diagonal voting (operator 1). DataFrame functions only.

Every document is cut into words once; all its rolling word 3-grams are joined by hash (and
by the words themselves, so a collision never counts) to their positions in the license
templates. A hit at word ``pos`` of the document and ``tpos`` of a template votes for the
diagonal ``pos - tpos``: unbroken template text puts all its votes on one diagonal, and a
word added or left out moves the rest to a near one. Votes are summed per diagonal,
diagonals at most ``GAP`` words apart are merged into a span, and a span is verified by
the share of the template's grams that it covers and by its length.

The base phrases are templates too; a place of a phrase is a diagonal on which every one of
its grams voted. Templates are a fixed list in this file, so the joined side has a constant
size. Words are runs of ASCII letters and digits and of all characters beyond ASCII.

Defined results: a null or empty text has no words, no labels and score 0. Repeated rows
each get their own row; columns other than ``doc_id`` and ``text`` are not looked at. An
empty table gives no rows. Long texts cost memory in proportion to one row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from jouleframe.llm.common import LOCATOR, located, text_of

K = 3
GAP = 4        # words by which neighbouring diagonals of one span may differ
COVER = 0.6    # least share of a template's grams that a span must cover
SHORT = 12     # templates of so few grams must be covered as a whole
STRETCH = 1.5  # most words of a span per word of the template

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that always count, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Public license notices.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
            "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
            "sublicense and or sell copies of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
            "merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
                 "obtain a copy of the license at"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
              "by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
              "by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
              "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
            "above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]
END = "\x01"  # stands behind the last word of every document; no word contains it


def templates(spark: SparkSession, base=None, notices=None) -> DataFrame:
    """One row per gram of each template: hash, gram, template, tpos, n_grams, label, is_base."""
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    rows = [(END, -1, 0, 1, "", True)]
    for number, (text, label, is_base) in enumerate([(t, x, True) for t, x in base] + [(t, x, False) for x, t in notices]):
        words = text.split()
        if len(words) < K or not all(re.fullmatch("[a-z0-9]+", w) for w in words):
            raise ValueError(f"a template needs {K} plain lower-case words: {text!r}")
        n = len(words) - K + 1
        rows += [(" ".join(words[i:i + K]), number, i, n, label, is_base) for i in range(n)]
    values = ", ".join(f"('{g}', {t}, {i}, {n}, '{x}', {str(b).lower()})" for g, t, i, n, x, b in rows)
    return spark.sql(f"SELECT xxhash64(gram) AS hash, * FROM VALUES {values} AS t(gram, template, tpos, n_grams, label, is_base)")


def grams(docs: DataFrame) -> DataFrame:
    """``pos`` and ``gram`` of all rolling grams, and one row per document at its word count."""
    lowered = F.translate(text_of(), UPPER, LOWER)
    words = docs.select(LOCATOR, "doc_id", F.array_remove(F.split(lowered, SEPARATOR), "").alias("words"))
    w = F.col("words")
    rolling = F.transform(w, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, K)]))
    return words.select(LOCATOR, "doc_id", F.posexplode(F.array_append(rolling, F.lit(END))).alias("pos", "gram"))


def votes(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document, template and diagonal: template positions hit, first and last word."""
    hits = grams(docs).withColumn("hash", F.xxhash64("gram")).join(F.broadcast(known), ["hash", "gram"])
    key = [LOCATOR, "doc_id", "template", "n_grams", "label", "is_base"]
    return (hits.groupBy(*key, (F.col("pos") - F.col("tpos")).alias("diagonal"))
            .agg(F.collect_set("tpos").alias("covered"), F.min("pos").alias("first"), F.max("pos").alias("last")))


def spans(found: DataFrame) -> DataFrame:
    """Merge neighbouring diagonals: one row per span with the share of its template it covers."""
    w = Window.partitionBy(LOCATOR, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > GAP, F.lit(True))
    x = found.withColumn("_new", apart.cast("int")).withColumn("span", F.sum("_new").over(w))
    x = x.groupBy(LOCATOR, "doc_id", "template", "n_grams", "label", "is_base", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("n_covered"), F.min("first").alias("start"),
        (F.max("last") + K).alias("end"),
        F.sum(F.when(F.size("covered") == F.col("n_grams"), 1).otherwise(0)).alias("whole"),
        F.min(F.when(F.size("covered") == F.col("n_grams"), F.col("first"))).alias("first_whole"),
        F.max(F.when(F.size("covered") == F.col("n_grams"), F.col("first"))).alias("last_whole"))
    cover = F.col("n_covered") / F.col("n_grams")
    fits = (F.col("end") - F.col("start") <= STRETCH * (F.col("n_grams") + K - 1)) | (F.col("whole") > 0)
    least = F.when(F.col("n_grams") <= SHORT, 1.0).otherwise(COVER)
    x = x.withColumn("cover", cover).withColumn("verified", (cover >= least) & fits | (F.col("whole") > 0))
    # Of notices that differ in a few words, the one that covers its span best.
    best = F.max(F.when(F.col("verified") & ~F.col("is_base"), F.col("cover"))).over(Window.partitionBy(LOCATOR, "start"))
    return x.withColumn("verified", F.col("verified") & (F.col("is_base") | (F.col("cover") >= best)))


def scan(docs: DataFrame, base=None, notices=None) -> DataFrame:
    """One row per row of ``docs``: word count, base places, labels and score."""
    content = located(docs, "doc_id", "text")
    found = spans(votes(content, templates(docs.sparkSession, base, notices)))
    text = F.col("template") >= 0
    is_base = text & F.col("is_base")
    labels = lambda keep: F.concat_ws(",", F.array_sort(F.collect_set(F.when(keep & F.col("verified"), F.col("label")))))
    return found.groupBy(LOCATOR, "doc_id").agg(
        F.max(F.when(~text, F.col("start"))).cast("bigint").alias("n_words"),
        F.coalesce(F.sum(F.when(is_base, F.col("whole"))), F.lit(0)).cast("bigint").alias("n_base"),
        F.min(F.when(is_base, F.col("first_whole"))).cast("bigint").alias("first_word"),
        F.max(F.when(is_base, F.col("last_whole"))).cast("bigint").alias("last_word"),
        labels(is_base).alias("base_labels"), labels(text).alias("labels"),
        F.coalesce(F.max(F.when(text, F.col("cover"))), F.lit(0.0)).alias("score"),
        F.sum(F.when(text & F.col("verified"), 1).otherwise(0)).cast("bigint").alias("n_spans"),
    ).drop(LOCATOR)
