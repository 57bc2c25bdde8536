"""License scans: phrases in whole texts, and an exact set-similarity join of text blocks with license templates.

All of it is DataFrame expressions. Words are runs of digits, letters a to z after lower-casing
A to Z, and characters beyond ASCII. The blocks of a text are windows of 96 words at every 64th word, whatever lines they stand
on, so every passage of 33 words or fewer, and each template is one, is whole in some block. A block
meets a template if it has at least the threshold's share of the template's distinct words. The
join finds every such block: template words are ordered by the number of blocks
that have them, rarest first; a block that meets the template has one of the
template's first words, so many of them that the rest alone fall short (prefix filter). Only
words of templates can count, so blocks are first cut down to these; a block with fewer
of them than needed goes (length filter), as does one that has too few left from the
matching word on (positional filter). What remains is verified by the intersection.

The templates are a fixed small list, so what is broadcast and what comes to the
driver (a count for each of their words) is bounded. Null and empty texts have no words, null places,
no labels and score 0. Repeated rows are scanned each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a template's distinct words that a block must have.
CONTAINED = 0.8
#: Words of a block, and from one block's start to the next.
BLOCK, STEP = 96, 64
# Phrases and their labels; labels and texts of license notices.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A to Z in lower case, all else as it is; the general function is faster and the same for ASCII texts."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, CAPITALS, SMALL)).otherwise(F.lower(text))


def words(text: Column | str) -> Column:
    """Words of a lower-cased text."""
    return F.array_remove(F.split(text, BREAK), "")


def template_words(templates: list[tuple[str, str]]) -> list[tuple[str, set[str]]]:
    keep = set("0123456789" + SMALL)
    return [(label, set("".join(c if c in keep else " " for c in text.lower()).split())) for label, text in templates]


def blocks(docs: DataFrame, vocabulary: list[str], keep: list[str]) -> DataFrame:
    """Rows of the columns to keep and `own`, the distinct template words of a block that has any; docs has __words."""
    n = F.size("__words")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n - BLOCK + STEP), F.lit(STEP)))
    found = docs.select(*keep, "__words", F.explode_outer(starts).alias("start"))
    own = F.array_intersect(F.slice("__words", F.coalesce("start", F.lit(1)), F.lit(BLOCK)), F.array(*map(F.lit, vocabulary)))
    return found.select(*keep, own.alias("own")).where(F.size("own") > 0)


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """The number of blocks that have each word of the vocabulary."""
    found = blocks(docs, vocabulary, []).select(F.explode_outer("own").alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in found}


def matches(docs: DataFrame, keep: list[str], templates: list[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """The columns to keep, label and share of every block and template that meet; docs has __words."""
    spark = docs.sparkSession
    told = template_words(templates)
    vocabulary = sorted(set().union(*(w for _, w in told)))
    count = frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (count[w], w))
    place = {w: k for k, w in enumerate(order)}
    rows = []
    for number, (label, own) in enumerate(told):
        ranked = sorted(own, key=place.get)
        need = math.ceil(contained * len(ranked) - 1e-9)
        rows += [(number, label, w, k, len(ranked), need, ranked) for k, w in enumerate(ranked[: len(ranked) - need + 1])]
    prefix = spark.createDataFrame(rows, "template int, label string, word string, at int, size int, need int, words array<string>")
    least = min(r[5] for r in rows)
    # In the order of the vocabulary, rarest first; blocks too short for every template go.
    ranked = F.array_intersect(F.array(*map(F.lit, order)), "own")
    found = blocks(docs, order, keep).where(F.size("own") >= least).withColumn("own", ranked)
    probes = found.select(*keep, "own", F.posexplode_outer("own").alias("seen", "word"))
    pairs = probes.join(F.broadcast(prefix), "word")
    # From this word on, and with the template's words before it, too few may be left.
    pairs = pairs.where((F.size("own") >= F.col("need")) & (F.least(F.col("size") - F.col("at"), F.size("own") - F.col("seen")) + F.least("at", "seen") >= F.col("need")))
    both = F.size(F.array_intersect("own", "words"))
    return pairs.withColumn("both", both).where("both >= need").select(*keep, "label", (F.col("both") / F.col("size")).alias("share"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Key, n_words, n_base, first_word, last_word, base_labels, labels, score of each row.

    score is 1 where a phrase occurs, else the largest share of a template that a block meets, else 0.
    """
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__low", lowered(F.col("__text"))).withColumn("__id", F.xxhash64("__text"))
    rows = rows.select("__key", "__id", words("__low").alias("__words"))
    found = matches(rows, ["__key", "__id"], templates, contained).groupBy("__key", "__id").agg(F.collect_set("label").alias("__more"), F.max("share").alias("__share"))
    joined = F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" "))
    some = F.lit(False)
    for phrase in PHRASES:
        some = some | joined.contains(f" {phrase} ")
    rows = rows.withColumn("__some", some)

    def followed(word: str):
        return lambda i, w: F.when(w == word, i)

    def places(phrase: str) -> Column:
        first, *rest = phrase.split(" ")
        starts = F.transform("__words", lambda w, i: F.when(w == first, i))
        for k, x in enumerate(rest, 1):
            shifted = F.slice("__words", k + 1, F.greatest(F.size("__words"), F.lit(1)))
            starts = F.zip_with(starts, shifted, followed(x))
        return F.when(F.col("__some"), F.filter(starts, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))

    rows = rows.select("__key", "__id", F.size("__words").cast("long").alias("n_words"), F.array(*(F.struct(F.lit(label).alias("label"), places(phrase).alias("at")) for phrase, label in PHRASES.items())).alias("__places"))
    every = F.flatten(F.transform("__places", lambda p: p["at"]))
    base = F.array_sort(F.array_distinct(F.transform(F.filter("__places", lambda p: F.size(p["at"]) > 0), lambda p: p["label"])))
    rows = rows.select("__key", "__id", "n_words", every.alias("__at"), base.alias("__base"))
    found = found.withColumnsRenamed({"__key": "__key_found", "__id": "__id_found"})
    rows = rows.join(found, (F.col("__id") == F.col("__id_found")) & F.col("__key").eqNullSafe(F.col("__key_found")), "left")
    labels = F.array_sort(F.array_union("__base", F.coalesce("__more", F.array().cast("array<string>"))))
    return rows.select(
        F.col("__key").alias(key), "n_words", F.size("__at").cast("long").alias("n_base"),
        F.array_min("__at").cast("long").alias("first_word"), F.array_max("__at").cast("long").alias("last_word"),
        F.array_join("__base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("__at") > 0, 1.0).otherwise(F.coalesce("__share", F.lit(0.0))).alias("score"),
    )
