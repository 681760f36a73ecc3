"""Licence scan: exact containment join of text blocks with licence templates.

A block is a sentence, which may run over wrapped lines: a line break ends it only after a line of
fewer than ``WRAPPED`` characters. A template is met in a block that holds at least ``threshold`` of
its distinct words, the same share of those that no template of another licence has, and each of its
words that name the licence. Of several met in a block, one whose words found there are only a part of those
found for another licence gives way to it, as the notice of a licence that builds on another does. Words are ordered by their frequency in the whole corpus, rarest first; a
block that reaches the threshold must share a word of a template's prefix (its rarest words, one
more than it may miss), so only blocks with such a word are looked at. Length and positional
filters remove most of the rest before the overlap is counted.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WRAPPED = 40

# Phrases of the contract and the label that each gives.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Sentences of the public licence notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the license"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "Released into the public domain under the CC0 1.0 Universal dedication."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


# Words that name a licence; of them those must be met that a template has.
NAMES = {"mit": "mit", "apache": "apache", "gpl": "gnu general public", "lgpl": "gnu lesser general public", "agpl": "gnu affero general public", "cc-by-nc": "nc", "cc-by-sa": "sa sharealike", "cc0": "cc0", "mpl": "mozilla public"}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _words(text: str) -> list[str]:
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    return re.findall(WORD, lowered)


def blocks_of(text: Column) -> Column:
    """The sentences of a text as an array; marks of comments and blank lines hold no words."""
    marked = F.regexp_replace(text, F.lit(rf"(?dm)^([^\n]{{0,{WRAPPED - 1}}})\n"), F.lit("$1\x01"))
    return F.split(marked, r"\x01|(?<=[.!?])\s+")


def phrase_starts(words: Column, phrase: str) -> Column:
    """Places at which the words of ``phrase`` stand one after another."""
    want = phrase.split()

    def here(i: Column) -> Column:
        fits = F.get(words, i) == want[0]
        for k, word in enumerate(want[1:], 1):
            fits = fits & (F.get(words, i + k) == word)
        return fits

    last = F.size(words) - len(want)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def own_words(templates: list[tuple[str, str]]) -> list[list[str]]:
    """Of each template the words that no template of another label has."""
    return [sorted(set(_words(text)) - {w for other, t in templates if other != label for w in _words(t)}) for label, text in templates]


def template_index(docs: DataFrame, text_col: str, templates: list[tuple[str, str]], threshold: float) -> tuple[dict[str, int], list[dict]]:
    """Rank of every template word by corpus frequency, and per template its ordered words and prefix.

    What reaches the driver is one count for each word of the fixed templates.
    """
    vocabulary = sorted({w for _, text in templates for w in _words(text)})
    words = docs.select(F.explode(F.filter(words_of(F.coalesce(F.col(text_col), F.lit(""))), lambda w: w.isin(vocabulary))).alias("w"))
    counts = {r["w"]: r["count"] for r in words.groupBy("w").count().collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index, alone = [], own_words(templates)
    for number, (label, text) in enumerate(templates):
        own = sorted(set(_words(text)), key=rank.get)
        need = math.ceil(threshold * len(own) - 1e-9)
        index.append({"number": number, "label": label, "words": own, "need": need, "prefix": own[: len(own) - need + 1], "alone": alone[number], "alone_need": math.ceil(threshold * len(alone[number]) - 1e-9), "names": sorted(set(NAMES.get(label, "").split()) & set(own))})
    return rank, index


def matches(docs: DataFrame, *, keys: list[str], text_col: str, rank: dict[str, int], index: list[dict]) -> DataFrame:
    """One row for each block and template that meet: ``keys``, _block, _label, _containment."""
    prefix = sorted({w for t in index for w in t["prefix"]})
    by_rank = sorted(rank, key=rank.get)
    spark = docs.sparkSession
    rows = [(w, t["number"], t["label"], t["words"].index(w), len(t["words"]), t["need"], t["words"], t["alone"], t["alone_need"], t["names"]) for t in index for w in t["prefix"]]
    entries = spark.createDataFrame(rows, "_word string, _template int, _label string, _i int, _n int, _need int, _own array<string>, _alone array<string>, _alone_need int, _names array<string>")

    blocks = (
        docs.where(F.exists(words_of(F.col(text_col)), lambda w: w.isin(prefix)))
        .select(*keys, F.posexplode(blocks_of(F.col(text_col))).alias("_block", "_text"))
        .withColumn("_set", F.array_distinct(F.filter(words_of(F.col("_text")), lambda w: w.isin(by_rank))))
        .where(F.exists("_set", lambda w: w.isin(prefix)))
        # words by global frequency: the constant array is in that order already
        .withColumn("_set", F.array_intersect(F.array(*[F.lit(w) for w in by_rank]), F.col("_set")))
    )
    met = (
        blocks.select(*keys, "_block", "_set", F.posexplode("_set").alias("_j", "_word"))
        .where(F.col("_word").isin(prefix))
        .join(F.broadcast(entries), "_word")  # a few rows for each fixed template
        .where(F.size("_set") >= F.col("_need"))
        .where(1 + F.least(F.col("_n") - F.col("_i") - 1, F.size("_set") - F.col("_j") - 1) >= F.col("_need"))
        # of several shared prefix words the first one in template order speaks for the pair
        .where(F.element_at(F.array_intersect("_own", "_set"), 1) == F.col("_word"))
        .withColumn("_found", F.array_intersect("_own", "_set"))
        .where((F.size("_found") >= F.col("_need")) & (F.size(F.array_intersect("_alone", "_set")) >= F.col("_alone_need")) & (F.size(F.array_except("_names", "_set")) == 0))
    )
    each = F.struct(F.col("_label").alias("label"), F.col("_found").alias("found"), (F.size("_found") / F.col("_n")).alias("share"))
    listed = met.groupBy(*keys, "_block").agg(F.collect_list(each).alias("_met"))  # a template is there once at most
    part = lambda x, y: (x["label"] != y["label"]) & (F.size(x["found"]) < F.size(y["found"])) & (F.size(F.array_except(x["found"], y["found"])) == 0)
    best = listed.select(*keys, "_block", F.explode(F.filter("_met", lambda x: ~F.exists("_met", lambda y: part(x, y)))).alias("_x"))
    return best.select(*keys, "_block", F.col("_x.label").alias("_label"), F.col("_x.share").alias("_containment"))


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a phrase stands, else the best containment that met the threshold, else 0.
    Null and empty texts have no words, no labels and score 0; null ids and repeated rows are rows
    like others; further columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumns({"_k1": F.xxhash64("_id", "_text"), "_k2": F.xxhash64(F.lit(11), "_text", "_id")})
    rank, index = template_index(rows, "_text", templates, threshold)
    found = matches(rows, keys=["_k1", "_k2"], text_col="_text", rank=rank, index=index)
    found = found.groupBy("_k1", "_k2").agg(F.collect_set("_label").alias("_more"), F.max("_containment").alias("_best"))

    words = rows.withColumn("_words", words_of(F.col("_text")))
    likely = F.lower("_text")
    starts = {}
    for k, (phrase, _) in enumerate(phrases):
        hit = likely.contains(phrase.split()[0]) & likely.contains(phrase.split()[-1])
        starts[f"_at{k}"] = F.when(hit, phrase_starts(F.col("_words"), phrase)).otherwise(F.array().cast("array<int>"))
    base = words.withColumns(starts).withColumns(
        {
            "_all": F.concat(*starts),
            "_base": F.array_compact(F.array(*[F.when(F.size(f"_at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)])),
        }
    )
    base = base.select("_id", "_k1", "_k2", F.size("_words").cast("bigint").alias("n_words"), "_all", "_base")
    joined = base.join(found, ["_k1", "_k2"], "left")
    labels = F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.size("_all").cast("bigint").alias("n_base"),
        F.array_min("_all").cast("bigint").alias("first_word"),
        F.array_max("_all").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size("_all") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
