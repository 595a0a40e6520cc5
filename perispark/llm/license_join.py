"""License scans: fixed phrases, and an exact set-similarity join against templates.

DataFrame functions only. A text block is any run of consecutive words, over line ends, as
long as the template divided by the threshold, so that some words may be put in. A template
is a set of tokens, ordered by how often each stands in the whole corpus, rarest first. A
block whose tokens hold a template to the share t or more

- has one of the first |T| - ceil(t |T|) + 1 of its tokens (prefix filter): only the words
  of texts that are in some template's prefix are exploded, each with the words around it,
  which is the join's left side; the right side is the templates' prefix tokens; the join is
  an equality of tokens;
- has ceil(t |T|) different words at least (length filter);
- has, from that token on in the global order, as many tokens as are needed (positional
  filter: the rarest shared token leaves enough places in both lists).

For the pairs that are left, the template's tokens in each block around the word are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perispark.llm.common import LOWER, UPPER, Scratch

#: The phrases of the base scan and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Opening sentences of widely used licence notices, with their labels.
TEMPLATES = (
    ("notice-gpl", "This work is licensed under the GNU General Public License version"),
    ("notice-apache", "Licensed under the Apache License Version"),
    ("notice-mit", "Released under the MIT License"),
    ("notice-cc-by", "Licensed under CC BY NC"),
    (
        "text-mit",
        "Permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files",
    ),
    (
        "text-bsd",
        "Redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    (
        "text-apache",
        "Unless required by applicable law or agreed to in writing software distributed under the License is "
        "distributed on an AS IS BASIS",
    ),
    (
        "text-gpl",
        "This program is free software you can redistribute it and or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    ("text-mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    (
        "text-isc",
        "Permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ),
    ("text-cc", "This work is licensed under a Creative Commons Attribution International License"),
    (
        "text-reserved",
        "All rights reserved No part of this publication may be reproduced distributed or transmitted in any "
        "form or by any means",
    ),
)

#: ASCII characters that separate words: all but digits and letters.
GAPS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Prefix tokens of all templates up to which they are broadcast; beyond, Spark shuffles both sides.
SENT = 100_000
FOUND = "array<struct<word:int,label:string,containment:double>>"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.array_remove(F.split(plain, " "), "")


def _strings(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def _hits(words: Column, wanted: list[str]) -> Column:
    """struct(word, at) of the wanted words' places; texts without any aren't gone through."""
    each = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    none = F.array().cast("array<struct<word:string,at:int>>")
    return F.when(F.arrays_overlap(words, _strings(wanted)), F.filter(each, lambda x: x["word"].isin(wanted))).otherwise(none)


def phrase_places(words: Column) -> Column:
    """struct(at, label) of the places where a phrase's words stand consecutively."""
    def label(hit: Column) -> Column:
        found = None
        for phrase, name in PHRASES:
            own = phrase.split()
            here = F.slice(words, hit["at"] + 1, len(own)) == _strings(own)
            found = (F if found is None else found).when(here, F.lit(name))
        return found

    heads = sorted({phrase.split()[0] for phrase, _ in PHRASES})
    named = F.transform(_hits(words, heads), lambda x: F.struct(x["at"].alias("at"), label(x).alias("label")))
    return F.filter(named, lambda x: x["label"].isNotNull())


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.85,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks: a row per row.

    score is the largest containment of a template in a block, 1 where a base phrase
    stands. blocks lists struct(word, label, containment): for each template found, where
    its best block begins. Null and empty texts have no words; rows are judged alone but
    for the token frequencies, so repeated rows and null ids give their own results; an
    empty table none. Other columns aren't read.

    Scale: the text is scanned twice, for the frequencies of the templates' tokens and for
    the words that may begin a match; the text itself is never shuffled. What is shuffled
    is a row for each document and one for each template found in one. The driver gets one
    count for each template token.
    """
    spark = docs.sparkSession
    sets = {label: sorted(set(t.lower().split())) for label, t in templates}
    width = {label: math.ceil(len(t.split()) / containment) for label, t in templates}
    need = {label: math.ceil(containment * len(own) - 1e-9) for label, own in sets.items()}
    around = max(width.values())
    vocabulary = sorted({w for own in sets.values() for w in own})

    words = words_of(F.col(text_col).cast("string"))
    spoken = docs.select(F.explode(words).alias("word")).filter(F.col("word").isin(vocabulary))
    frequency = {r.word: r["count"] for r in spoken.groupBy("word").count().collect()}
    ordered = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ordered)}

    # right side: a row for each prefix token of each template
    index = []
    for label, own in sets.items():
        own.sort(key=rank.__getitem__)
        for place, token in enumerate(own[: len(own) - need[label] + 1]):
            index.append((token, label, own, own[place:], need[label], width[label], float(len(own))))
    schema = "token string, label string, own array<string>, rest array<string>, need int, width int, size double"
    right = spark.createDataFrame(index, schema)

    # left side: prefix tokens of the texts, each with the words around it
    prefixes = sorted({r[0] for r in index})
    near = (lambda x: F.slice("_words", F.greatest(x["at"] - around + 2, F.lit(1)), around + F.least(x["at"], F.lit(around - 1))))
    hits = (
        F.transform(_hits(F.col("_words"), prefixes),
        lambda x: F.struct(x["word"].alias("token"), x["at"].alias("at"), near(x).alias("near"))))
    text = (
        docs.select(F.col(id_col).alias("_id"), words.alias("_words"),
        F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("_key")))
    scratch = Scratch(spark)
    staged = scratch.written(
        text.select("_id", "_key", F.size("_words").cast("long").alias("n_words"), phrase_places(F.col("_words")).alias("_places"),
            hits.alias("_hits")),
        "license-words",
    )
    left = staged.filter(F.size("_hits") > 0).select("_id", "_key", F.inline("_hits"))

    length = F.size(F.array_distinct("near")) >= F.col("need")
    positional = F.size(F.array_intersect("rest", "near")) >= F.col("need")
    if len(index) <= SENT:
        right = F.broadcast(right)
    pairs = left.join(right, "token").filter(length & positional)
    start = F.greatest(F.col("at") - around + 1, F.lit(0))
    begins = F.sequence(F.greatest(F.col("at") - F.col("width") + 1, F.lit(0)), F.col("at"))
    shared = lambda b: F.size(F.array_intersect("own", F.slice("near", b - start + 1, F.col("width"))))
    counted = F.transform(begins, lambda b: F.struct(shared(b).alias("shared"), (-b).alias("back")))
    best = (
        pairs.select("_id", "_key", "label", "need", "size",
        F.array_max(counted).alias("best")).filter(F.col("best.shared") >= F.col("need")))
    share = F.struct((F.col("best.shared") / F.col("size")).alias("share"), F.col("best.back").alias("back"))
    rows = best.groupBy("_id", "_key", "label").agg(F.max(share).alias("m"))
    one = F.struct((-F.col("m.back")).alias("word"), "label", F.col("m.share").alias("containment"))
    blocks = rows.groupBy(F.col("_id").alias("_id2"), F.col("_key").alias("_key2")).agg(F.array_sort(F.collect_list(one)).alias("blocks"))
    same = (F.col("_key") == F.col("_key2")) & F.col("_id").eqNullSafe(F.col("_id2"))
    out = staged.drop("_hits").join(blocks, same, "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(FOUND)))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.col("_places.label")
    return out.select(
        F.col("_id").alias(id_col), "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places.at").cast("long").alias("first_word"), F.array_max("_places.at").cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, "blocks.label")).alias("labels"),
        F.when(F.size("_places") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"), "blocks",
    )
