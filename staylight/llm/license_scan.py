"""Licence notices in texts, as an exact set-similarity join with DataFrame functions.

A block is a line or, where ``wrapped`` notices are sought too, also a stretch of words across line
breaks. A template matches a block that holds at least ``threshold`` of the
template's distinct words. Words are put in one order, rarest in the whole corpus
first. If a block holds enough of a template, it holds one of the first
``size - needed + 1`` words of it (prefix filter), so only such words are joined; blocks with
too few words (length filter), or too few words left behind the shared one (positional
filter), are dropped before the exact count. Notices of one family share most of their words, so a block must
also hold, word after word, the phrases that mark a template's licence (:data:`MARKS`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylight.llm.texts import ascii_lower, documents, same_row, words_of

#: A word of a lower-cased text: no ASCII but digits and letters.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that name a licence by themselves.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

#: Short notices as authors put them into files.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This program is free software under the GNU General Public License, version 2."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("agpl-3", "This program is licensed under the GNU Affero General Public License version 3"),
    ("mpl-2", "This source code form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc0", "This work has been dedicated to the public domain under CC0 Creative Commons Zero"),
    ("proprietary", "Copyright. All rights reserved. Unauthorized copying or distribution is prohibited."),
)

#: What tells a licence from the others of its family, as words in a row.
MARKS = {
    "gpl-3": ("gnu general public license", "version 3"),
    "gpl-2": ("gnu general public license", "version 2"),
    "lgpl": ("lesser general public license",),
    "agpl-3": ("affero general public license", "version 3"),
    "mpl-2": ("mozilla public license",),
    "apache-2": ("apache license",),
    "cc-by-nc": ("by nc",),
    "cc-by-sa": ("by sa",),
    "cc-by": ("commons attribution",),
    "cc0": ("cc0",),
    "bsd": ("redistribution and use",),
    "proprietary": ("all rights reserved",),
}
#: The two notices of this licence have no phrase in common, so each has its own.
MIT_MARKS = ("mit license", "permission is hereby granted")


def marks_of(label: str, words: list[str]) -> list[str]:
    """The phrases that a block must hold to carry the label; none for a label without any."""
    if label == "mit":
        return [m for m in MIT_MARKS if f" {m} " in f" {' '.join(words)} "]
    return list(MARKS.get(label, ()))


def _tokens(text: Column) -> Column:
    return words_of(ascii_lower(text), TOKEN)


def _template_words(spark, templates) -> list[tuple[int, str, list[str], list[str]]]:
    """Number, label, distinct words and marks of each template; as many rows as templates."""
    rows = [(n, label, text) for n, (label, text) in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template int, label string, text string")
    found = frame.select("template", "label", _tokens(F.col("text")).alias("words")).collect()
    return [
        (r["template"], r["label"], list(dict.fromkeys(r["words"])), marks_of(r["label"], r["words"])) for r in found if r["words"]
    ]


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by the number of times the whole corpus uses each word, rarest
    first, ties by the word. What reaches the driver has at most one row per word of the
    templates, whatever the size of the corpus."""
    used = (
        documents(docs)
        .select(F.explode(_tokens(F.col("text"))).alias("word"))
        .filter(F.col("word").isin(vocabulary))
        .groupBy("word")
        .count()
    )
    counts = {r["word"]: r["count"] for r in used.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _stretches(texts: DataFrame, longest: int) -> DataFrame:
    """Overlapping stretches of the words of texts with several lines. Any 1.5 * ``longest`` words in
    a row, however they are wrapped, lie whole in one of them."""
    step = max(1, longest // 2)
    words = F.col("all_words")
    cut = F.transform(F.sequence(F.lit(0), F.size(words), F.lit(step)), lambda i: F.slice(words, i + 1, 2 * longest))
    return (
        texts.filter(F.contains("text", F.lit("\n")))
        .select("doc_id", F.xxhash64("text").alias("text_hash"), _tokens(F.col("text")).alias("all_words"))
        .select("doc_id", "text_hash", F.posexplode(cut).alias("block", "stretch"))
        .select("doc_id", "text_hash", (-1 - F.col("block")).alias("block"), F.col("stretch").alias("words"))
    )


def template_matches(
    docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, wrapped: bool = False
) -> DataFrame:
    """Every (block, template) with ``|block & template| >= threshold * |template|`` whose block holds the template's marks.

    ``docs`` has doc_id and text. Returns doc_id, text_hash, block (line number from 0; -1, -2 and so on for
    the stretches of ``wrapped``), label, template, overlap and containment. Missing texts have no blocks.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark = docs.sparkSession
    known = _template_words(spark, templates)
    order = word_order(docs, sorted({w for _, _, words, _ in known for w in words}))
    rank = {w: n for n, w in enumerate(order)}
    prefixes, rows = set(), []
    for number, label, words, marks in known:
        needed = max(1, math.ceil(round(threshold * len(words), 9)))
        ranked = sorted(words, key=rank.__getitem__)
        for i, word in enumerate(ranked[: len(words) - needed + 1]):
            prefixes.add(word)
            rows.append((word, number, label, i, needed, ranked, marks))
    table = spark.createDataFrame(
        rows, "word string, template int, label string, at int, needed int, template_words array<string>, marks array<string>"
    )
    rare = F.array(*[F.lit(w) for w in sorted(prefixes, key=rank.__getitem__)])
    ordered = F.array(*[F.lit(w) for w in order])

    texts = documents(docs).filter(F.arrays_overlap(_tokens(F.col("text")), rare))
    found = (
        texts
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("block", "line"))
        .select("doc_id", "text_hash", "block", _tokens(F.col("line")).alias("words"))
    )
    if wrapped and known:
        found = found.unionByName(_stretches(texts, max(len(words) for _, _, words, _ in known)))
    blocks = (
        found
        .filter(F.arrays_overlap("words", rare))
        # The block's words that any template has, rarest first.
        .select(
            "doc_id", "text_hash", "block", F.size(F.array_distinct("words")).alias("n_block"),
            F.array_intersect(ordered, "words").alias("shared"),
            "words",
        )
    )
    candidates = (
        blocks.withColumn("word", F.explode(F.array_intersect("shared", rare)))
        .join(table, "word")
        .filter(F.col("n_block") >= F.col("needed"))
        .filter(
            1 + F.least(
                F.size("template_words") - F.col("at") - 1,
                F.size("shared") - F.array_position("shared", F.col("word")).cast("int"),
            )
            + F.least(F.col("at"), F.array_position("shared", F.col("word")).cast("int") - 1)
            >= F.col("needed")
        )
    )
    overlap = F.size(F.array_intersect("shared", "template_words"))
    # Looked at last: of few blocks, each word by word.
    in_a_row = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    marked = F.forall("marks", lambda m: F.contains(in_a_row, F.concat(F.lit(" "), m, F.lit(" "))))
    return (
        candidates.withColumn("overlap", overlap)
        .filter(F.col("overlap") >= F.col("needed"))
        .filter(marked)
        .withColumn("containment", F.col("overlap") / F.size("template_words"))
        .groupBy("doc_id", "text_hash", "block", "label", "template")
        .agg(F.max("overlap").alias("overlap"), F.max("containment").alias("containment"))
    )


def _starts(phrase: str) -> Column:
    """Word numbers at which the phrase stands; sought only in texts that hold its words
    in a row in some spelling."""
    parts = phrase.split(" ")
    n = F.size("_words")
    here = lambda i: F.expr("true") if not parts else _all(
        [F.get(F.col("_words"), i + k) == part for k, part in enumerate(parts)]
    )
    return F.when(
        F.col("_low").rlike(BETWEEN.join(parts)) & (n >= len(parts)),
        F.filter(F.sequence(F.lit(0), n - len(parts)), here),
    ).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, wrapped: bool = False
) -> DataFrame:
    """One row per row of ``docs``: phrases that name a licence, and templates found.

    Columns: doc_id, n_words, n_base, first_word, last_word (word numbers from 0, null without a
    phrase), base_labels and labels (distinct, sorted, comma-joined; empty without any), score (the
    largest containment of a template found, 0 without any). Missing texts count as empty. With
    ``wrapped``, templates are also found across line breaks.
    Repeated rows (same id and text) each get their result; rows that share an id but not
    the text are told apart.
    """
    low = documents(docs).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), ascii_lower(F.col("text")).alias("_low")
    )
    read = low.select("doc_id", "text_hash", "_low", words_of(F.col("_low"), TOKEN).alias("_words"))
    starts = {label: f"_at{n}" for n, label in enumerate(PHRASES)}
    placed = read.select(
        "doc_id",
        "text_hash",
        F.size("_words").cast("long").alias("n_words"),
        *[_starts(PHRASES[label]).alias(name) for label, name in starts.items()],
    )
    every = F.concat(*starts.values())
    base = placed.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.filter(
            F.array(*[F.when(F.size(name) > 0, F.lit(label)) for label, name in starts.items()]),
            lambda x: x.isNotNull(),
        ).alias("_base"),
    )
    found = (
        template_matches(docs, templates, threshold, wrapped)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("label").alias("_found"), F.max("containment").alias("_best"))
    )
    join = lambda labels: F.array_join(F.array_sort(labels), ",")
    more = F.coalesce("_found", F.array().cast("array<string>"))
    return base.join(found, same_row(base, found, ("doc_id", "text_hash")), "left").select(
        base["doc_id"], "n_words", "n_base", "first_word", "last_word",
        join("_base").alias("base_labels"),
        join(F.array_union("_base", more)).alias("labels"),
        F.coalesce("_best", F.lit(0.0)).alias("score"),
    )
