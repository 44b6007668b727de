"""License scan: exact phrases, and a set-similarity join of text blocks with license templates.

Phrases give the base labels. The join finds every text block whose words contain at
least ``threshold`` of a template's distinct words. Blocks are the lines, and, for
notices wrapped over lines, the runs of as many consecutive words as the template
has, whatever line breaks they cross:

* the words of the templates, a fixed vocabulary, are counted over all documents
  and ordered by rising frequency;
* a template's prefix is its rarest size - need + 1 words, need being
  ceil(threshold * size): a block that meets the threshold holds one of them;
* length filter: the block holds at least ``need`` words of the vocabulary;
* positional filter: at least ``need`` of them stand at or after the shared word
  in that order;
* what is left is verified by the full intersection.

All of it is DataFrame operations. Texts are read once and never shuffled: inside
the scan a document is reduced to its words of the vocabulary, and if those could
meet a template, to those of each block. Only finds are grouped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, stored, text_of

GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# Fixed values of the query's contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("reserved", "All rights reserved."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Words of a lower-cased text: runs of ASCII digits and letters and of all beyond ASCII."""
    return F.array_remove(F.split(text, GAPS), "")


def _all_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def _template_words(text: str) -> list[str]:
    return list(dict.fromkeys(_all_words(text)))


def _runs(number: int, text: str, need: int) -> Column:
    """Blocks of the runs of ``words`` as long as the template that hold ``need``
    of its words. A run may start at one of them: no other holds more."""
    own, length = F.lit(_template_words(text)), len(_all_words(text))
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains(own, F.get("words", i - 1)))
    held = F.transform(starts, lambda i: F.array_intersect(own, F.slice("words", i, length)))
    return F.transform(F.array_distinct(F.filter(held, lambda w: F.size(w) >= need)), lambda w: _block(F.lit(number), w))


def _block(only: Column, words: Column) -> Column:
    """A text block; ``only`` is the one template it is compared with, or NULL."""
    return F.struct(only.cast("int").alias("only"), words.alias("words"))


def phrase_starts(words: Column, phrase: Sequence[str]) -> Column:
    """Places (from 0) where the phrase's words stand consecutively."""
    last = F.size(words) - len(phrase)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(phrase)])

    return F.filter(places, stands)


def _need(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def _base(docs: DataFrame, id_column: str, text_column: str, phrases, templates, threshold: float) -> DataFrame:
    """Per document: words, phrase places, which words of the templates it holds
    (``held``), and, if it holds enough of any template's, those of each block."""
    sets = [_template_words(text) for _, text in templates]
    vocabulary = sorted({w for s in sets for w in s})
    none = F.array().cast("array<int>")
    lower = docs.select(F.col(id_column).alias("id"), ascii_lower(text_of(text_column)).alias("lower"))
    cut = lower.withColumn("words", words_of(F.col("lower")))
    starts = [
        F.when(reduce(lambda a, b: a & b, [F.col("lower").contains(w) for w in p.split()]), phrase_starts(F.col("words"), p.split())).otherwise(none)
        for p, _ in phrases
    ]
    found = cut.select(
        "id", F.size("words").cast("long").alias("n_words"),
        *[s.alias(f"s{i}") for i, s in enumerate(starts)],
        F.array_intersect(F.lit(vocabulary), F.col("words")).alias("held"), "lower", "words",
    )
    enough = [F.size(F.array_intersect(F.lit(s), F.col("held"))) >= _need(len(s), threshold) for s in sets]
    by_line = F.transform(F.split("lower", "\n"), lambda line: _block(F.lit(None), F.array_intersect(F.lit(vocabulary), words_of(line))))
    wrapped = [
        F.when(e & F.col("lower").contains("\n"), _runs(k, text, _need(len(s), threshold))).otherwise(F.array().cast("array<struct<only:int,words:array<string>>>"))
        for k, (e, s, (_, text)) in enumerate(zip(enough, sets, templates))
    ]
    blocks = F.concat(by_line, *wrapped)
    found = found.withColumn("blocks", F.when(reduce(lambda a, b: a | b, enough, F.lit(False)), blocks)).drop("lower", "words")
    names = [f"s{i}" for i in range(len(phrases))]
    every = F.concat(*names) if names else none
    labels = F.array_compact(F.array(*[F.when(F.size(n) > 0, label) for n, (_, label) in zip(names, phrases)]))
    return found.select(
        "id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), labels.cast("array<string>").alias("base"), "held", "blocks",
    )


def matching_blocks(
    held: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(id, block, template, label, containment) of every block that holds at
    least ``threshold`` of a template's words. ``held`` has, per document, the
    templates' words in it (``held``, which gives the order) and in each block."""
    sets = [_template_words(text) for _, text in templates]
    # At most one row per word of the templates comes back.
    counted = {r["word"]: r["count"] for r in held.select(F.explode("held").alias("word")).groupBy("word").count().collect()}
    order = sorted({w for s in sets for w in s}, key=lambda w: (counted.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefix, verify = [], []
    for number, ((label, _), words) in enumerate(zip(templates, sets)):
        need = _need(len(words), threshold)
        ranked = sorted(words, key=rank.__getitem__)
        for word in ranked[: len(words) - need + 1]:
            prefix.append((word, number, need))
        verify.append((number, label, need, ranked))
    spark = held.sparkSession
    rows = lambda part: ", ".join(part)
    text = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
    # Two fixed tables, as large as the templates.
    keys = spark.sql(f"SELECT * FROM VALUES {rows(f'({text(w)}, {n}, {k})' for w, n, k in prefix)} AS t(word, template, need)")
    full = spark.sql(
        "SELECT * FROM VALUES "
        + rows(f"({n}, {text(label)}, array({rows(map(text, ws))}))" for n, label, _, ws in verify)
        + " AS t(template, label, set)"
    )
    least = min(k for _, _, k in prefix)
    blocks = held.where("blocks IS NOT NULL").select("id", F.posexplode("blocks").alias("block", "one")).where(F.size("one.words") >= least)
    cut = blocks.select("id", "block", "one.only", F.array_intersect(F.lit(order), F.col("one.words")).alias("has"))
    seen = cut.select("id", "block", "only", "has", F.posexplode("has").alias("place", "word"))
    near = seen.join(F.broadcast(keys), "word").where("only IS NULL OR only = template").where(F.size("has") - F.col("place") >= F.col("need"))
    common = F.size(F.array_intersect("has", "set"))
    checked = near.join(F.broadcast(full), "template").withColumn("common", common).where("common >= need")
    return checked.select("id", "block", "template", "label", (F.col("common") / F.size("set")).alias("containment")).distinct()


def scan_licenses(
    docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    Base: places of the phrases (all are counted, the smallest and largest start
    are given). ``labels`` adds those of matching templates; both lists are
    distinct, sorted, joined by commas, empty if there is none. ``score`` is 1
    where a phrase stands, else the largest containment of a matching block, else
    0. NULL counts as an empty text: no words, no labels, NULL places. Rows that
    repeat an id share their template labels. An empty table gives no rows.
    Other columns of ``docs`` play no part.
    """
    base = stored(_base(docs, id_column, text_column, phrases, templates, threshold), "license-base")
    blocks = matching_blocks(base, templates, threshold)
    more = blocks.groupBy("id").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    more = more.withColumnRenamed("id", "more_id")
    joined = base.join(more, F.col("id").eqNullSafe(F.col("more_id")), "left")
    joined_labels = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    return joined.select(
        F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(joined_labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
