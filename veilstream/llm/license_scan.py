"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of a text is joined by hash to the k-grams of license notices.  A hit at word p of
the text and place t of a notice votes for the diagonal p - t.  Diagonals of one notice that lie next to each
other (a word more or less in between) and whose hits stand near each other are merged; the merged span is
accepted if the k-grams it holds, compared word by word, cover enough of the notice.  Phrases of the base list
must be covered in full on a single diagonal, which is one place each.

The notices are a fixed list, so the side that is broadcast has a fixed size.  A text's hits are grouped by the
text's own key and the notice, and no group spans documents.

Defined results: null and empty texts have no words and no labels; equal rows give equal results; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilstream.llm.common import materialise

K = 3
#: share of a notice's k-grams that a span must hold
COVER = 0.75
#: diagonals at most so far apart are neighbours
DRIFT = 3
#: a word, once A-Z are lower-cased, and what parts words
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases of the base list, and notices that licenses tell their users to give.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
NOTICES = {
    "mit": [
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd license",
        "use of this source code is governed by a bsd style license that can be found in the license file",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "lgpl": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "licensed under the gnu lesser general public license",
    ],
    "mpl-2": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
    ],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4 0 international license",
        "licensed under cc by 4 0",
    ],
    "cc-by-sa": [
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        "licensed under cc by sa 4 0",
    ],
    "cc-by-nc": [
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "licensed under cc by nc 4 0",
    ],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "released under cc0 1 0 universal"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license"],
    "proprietary": ["all rights reserved unauthorized copying of this file via any medium is strictly prohibited"],
}


def _notices() -> list[tuple[int, str, bool, list[str]]]:
    """(number, label, whether it is of the base list, words)"""
    both = [(label, True, text) for label, text in PHRASES.items()] + [(label, False, t) for label, texts in NOTICES.items() for t in texts]
    return [(n, label, base, text.split()) for n, (label, base, text) in enumerate(both)]


def templates(spark: SparkSession) -> DataFrame:
    """A row for each k-gram of each notice: hash, notice, label, base, place, grams in the notice, its words."""
    rows = []
    for n, label, base, words in _notices():
        if len(words) < K or not all(re.fullmatch("[0-9a-z]+", w) for w in words):
            raise ValueError(f"notice {n} is too short or not in plain words")
        rows += [f"({n}, '{label}', {str(base).lower()}, {t}, {len(words) - K + 1}, {', '.join(repr(w) for w in words[t : t + K])})" for t in range(len(words) - K + 1)]
    names = ", ".join(f"g{i}" for i in range(K))
    return spark.sql(f"SELECT xxhash64({names}) AS h, * FROM VALUES {', '.join(rows)} AS t(notice, label, base, place, grams, {names})")


def _words(text: Column) -> Column:
    """Words of a text in order; cutting at what parts them is one pass, where extracting copies a match state a word."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), APART), "")


def _row_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def hits(docs: DataFrame) -> DataFrame:
    """Every k-gram of every text that a notice has too: doc_id, text_key, notice, label, base, grams, place, word."""
    words = docs.select(*_row_key(), _words(F.col("text")).alias("w"))
    rolling = F.transform(F.slice("w", 1, F.greatest(F.size("w") - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("w", i + j) for j in range(1, K))))
    grams = words.select("doc_id", "text_key", "w", F.posexplode(rolling).alias("word", "h"))
    # compared after the join, as two inequalities: an equation would become part of the join's key
    same = F.lit(True)
    for j in range(K):
        own = F.get("w", F.col("word") + j)
        same &= (F.col(f"g{j}") <= own) & (F.col(f"g{j}") >= own)
    found = grams.join(F.broadcast(templates(docs.sparkSession)), "h").where(same)
    return found.select("doc_id", "text_key", "notice", "label", "base", "grams", "place", "word")


def spans(docs: DataFrame) -> DataFrame:
    """Accepted spans: doc_id, text_key, label, base, first_word, last_word (of the span), cover (of the notice)."""
    key = ["doc_id", "text_key", "notice", "label", "base", "grams"]
    diagonals = (
        materialise(hits(docs), "hits")
        .groupBy(*key, (F.col("word") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"), F.min("word").alias("lo"), F.max("word").alias("hi"))
    )
    base = diagonals.where(F.col("base") & (F.size("places") == F.col("grams"))).select("doc_id", "text_key", "label", "base", F.col("diagonal").cast("long").alias("first_word"), (F.col("hi") + K - 1).cast("long").alias("last_word"), F.lit(1.0).alias("cover"))
    by = Window.partitionBy(*key).orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT) | (F.col("lo") > F.lag("hi").over(by) + F.col("grams")) | (F.col("hi") + F.col("grams") < F.lag("lo").over(by))
    merged = (
        diagonals.where(~F.col("base"))
        .withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "span")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("cover", F.col("held") / F.col("grams"))
        .where(F.col("cover") >= COVER)
    )
    return base.unionByName(merged.select("doc_id", "text_key", "label", "base", F.col("lo").cast("long").alias("first_word"), (F.col("hi") + K - 1).cast("long").alias("last_word"), "cover"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: n_words, the base phrases' places, first and last start, base labels, all labels, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    found = (
        spans(docs)
        .groupBy("doc_id", "text_key")
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("first_word"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("first_word"))).alias("last_word"),
            names(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
            names(F.collect_set("label")).alias("labels"),
            F.max("cover").alias("score"),
        )
        .withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    )
    rows = docs.select(*_row_key(), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
