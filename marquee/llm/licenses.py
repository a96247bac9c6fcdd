"""License scans by an exact set-similarity join, with DataFrame functions only.

A template is a piece of a license's text or of its usual notice. It is looked
for in blocks of about twice its own length (a power of two, ``block_words``),
each starting half a block after the one before, so that every run of words as
long as the template lies whole in a block. A block and a template are a link if
the block contains at least ``threshold`` of the template's distinct tokens; the
join finds all of them (``links``). A block carries the license if it is linked to
it and has the
phrases that tell it from its relatives and from prose of the same words
(``must``), each as words that follow one another: "gnu general public license"
isn't in the notice of the Lesser one, nor "version 3" in that of version 2.

The tokens of the templates are ordered by the number of documents that have
them, rarest first. A block that meets the threshold must have one of the first
|T|-o+1 tokens of the template T, where o = ceil(threshold*|T|) is the overlap
it needs (prefix filter); it must have o tokens at all (length filter); and from
the places of the shared token in both orders follows how many more they can
share (positional filter). What passes is verified. Templates are a fixed list,
so the index of their prefixes is of fixed size. Only texts that have o tokens of
a template at all are cut into blocks, and only into those of its size.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.session import materialise

#: Most words of a template; longer license texts are given in pieces.
MOST_WORDS = 64
THRESHOLD = 0.8

#: Phrases of the plain scan.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Texts of public licenses and their usual notices, and the phrases that tell each from its relatives (| between alternatives).
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "sublicense")),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", ("the software is provided as is", "noninfringement")),
    ("mit", "Released under the MIT License", ("under the mit license|under mit license",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license version 2|apache license 2",)),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ("as is basis", "warranties or conditions of any kind")),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ("under the gnu general public license", "version 3")),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("terms of the gnu general public license", "version 3 of the license")),
    ("gpl-2", "licensed under the GNU General Public License, version 2", ("under the gnu general public license", "version 2")),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("terms of the gnu general public license", "version 2 of the license")),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3", ("under the gnu lesser general public license", "version 3")),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("terms of the gnu lesser general public license", "version 3 of the license")),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3", ("under the gnu affero general public license", "version 3")),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("terms of the gnu affero general public license", "version 3 of the license")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ("redistributions of source code", "following disclaimer")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4",)),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4",)),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_tokens(text: str) -> list[str]:
    """Distinct words of an ASCII template in order."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def block_words(text: str) -> int:
    """Block length for a template: twice its words or more, a power of two, 16 at least."""
    n = 16
    while n < 2 * len("".join(c if c.isalnum() else " " for c in text).split()):
        n *= 2
    return n


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def _base(words: Column, n: Column) -> dict[str, Column]:
    """Places, first and last start and labels of the phrases; ``words``: all words, a space around each."""
    counts, firsts, lasts, labels = [], [], [], []
    for label, phrase in sorted(PHRASES.items()):
        has = F.contains(words, F.lit(f" {phrase} "))
        counts.append(F.when(has, F.size(F.split(words, f" {phrase}(?= )")) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(has, _spaces(F.substring_index(words, f" {phrase} ", 1))))
        lasts.append(F.when(has, n - _spaces(F.substring_index(words, f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(has, F.lit(label)))
    return {"n_base": sum(counts[1:], counts[0]), "first_word": F.least(*firsts), "last_word": F.greatest(*lasts), "base_set": F.array_compact(F.array(*labels))}


def _places(words: Column, joined: Column, phrase: str) -> Column:
    """Starts of a phrase among the words, from 0."""
    own = phrase.split()
    here = lambda i: sum((F.when(F.get(words, i + j) == w, 0).otherwise(1) for j, w in enumerate(own)), F.lit(0)) == 0
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), starts).otherwise(F.array().cast("array<int>"))


def _linked(docs: DataFrame, threshold: float, templates: list[tuple[str, str, tuple[str, ...]]] | None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` (rid, doc_id and what ``_base`` says) and all links (rid, template, label, size, block, share, told) of their blocks."""
    templates = TEMPLATES if templates is None else templates
    sets = [(label, template_tokens(text), must, block_words(text)) for label, text, must in templates]
    for label, _, must, block in sets:
        if block > 2 * MOST_WORDS or not must:
            raise ValueError(f"template of {label}: too long, or without distinguishing phrases")
    vocabulary = sorted({t for _, tokens, _, _ in sets for t in tokens})
    phrases = sorted({p for _, _, must, _ in sets for group in must for p in group.split("|")})
    words = words_of(F.col("text"))
    literal = lambda tokens: F.array(*(F.lit(t) for t in tokens)).cast("array<string>")
    seen = docs.select(F.explode(F.array_intersect(words, literal(vocabulary))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    frequency = {r["token"]: r["n"] for r in seen.collect()}  # at most as many as the templates have
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t)))}
    ordered = [(label, sorted(tokens, key=rank.get), must, block) for label, tokens, must, block in sets]
    needs = [math.ceil(threshold * len(tokens) - 1e-9) for _, tokens, _, _ in ordered]
    prefix = [(t, i, place) for i, ((_, tokens, _, _), o) in enumerate(zip(ordered, needs, strict=True)) for place, t in enumerate(tokens[: len(tokens) - o + 1])]

    by_rank = sorted(vocabulary, key=rank.get)
    sizes = sorted({own for _, _, _, own in ordered})
    first = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    first = first.withColumns({"n_words": F.size("words").cast("long"), "joined": F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))})
    # Block sizes of the templates of which the whole text has tokens enough.
    first = first.withColumn("has", F.array_intersect("words", literal(vocabulary)))
    enough = [(own, F.size(F.array_intersect("has", literal(tokens))) >= o) for (_, tokens, _, own), o in zip(ordered, needs, strict=True)]
    wanted = F.array(*(F.when(F.size("has") >= min(o for (_, _, _, own), o in zip(ordered, needs, strict=True) if own == size), F.when(functools.reduce(operator.or_, [x for own, x in enough if own == size]), F.lit(size))) for size in sizes))
    first = first.withColumn("sizes", F.array_compact(wanted.cast("array<int>"))).drop("has")
    some = F.size("sizes") > 0
    first = first.withColumn("places", F.when(some, F.array(*(_places(F.col("words"), F.col("joined"), p) for p in phrases)) if phrases else F.array().cast("array<array<int>>")))
    first = first.withColumns(_base(F.col("joined"), F.col("n_words")))
    rows = materialise(first.withColumn("words", F.when(some, F.col("words"))).drop("joined"), "license_rows")
    lengths = F.array(*(F.lit(len(p.split())) for p in phrases)) if phrases else F.array().cast("array<int>")

    def blocks_of(size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n_words") - size) / (size // 2)).cast("int")))
        tokens = lambda i: F.array_intersect(literal(by_rank), F.slice("words", i * (size // 2) + 1, size))  # noqa: E731  in the global order

        def told(i: Column) -> Column:
            a = i * (size // 2)
            within = lambda starts, p: F.exists(starts, lambda x: (x >= a) & (x + F.element_at(lengths, p + 1) <= a + size))
            return F.filter(F.transform("places", lambda starts, p: F.when(within(starts, p), p)), lambda p: p.isNotNull())

        least = min(o for o, (_, _, _, own) in zip(needs, ordered, strict=True) if own == size)
        full = F.filter(F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("block"), tokens(i).alias("tokens"))), lambda b: F.size(b["tokens"]) >= least)
        own = F.transform(full, lambda b: F.struct(b["size"].alias("size"), b["block"].alias("block"), told(b["block"]).alias("told"), b["tokens"].alias("tokens")))
        return F.when(F.array_contains("sizes", size), own).otherwise(F.array().cast("array<struct<size:int,block:int,told:array<int>,tokens:array<string>>>"))

    blocks = rows.filter("words is not null").select("rid", F.inline(F.concat(*map(blocks_of, sizes)))) if sizes else rows.limit(0).selectExpr("rid", "0 AS size", "0 AS block", "array(0) AS told", "words AS tokens")
    spark = docs.sparkSession
    index = spark.createDataFrame(prefix or [("", 0, 0)], "token string, template int, place int")
    number = {p: i for i, p in enumerate(phrases)}
    shape = [(i, label, tokens, [[number[p] for p in group.split("|")] for group in must], len(tokens), o, own) for i, ((label, tokens, must, own), o) in enumerate(zip(ordered, needs, strict=True))]
    index = index.join(spark.createDataFrame(shape, "template int, label string, wanted array<string>, must array<array<int>>, length int, need int, size int"), "template")
    met = blocks.select("rid", "size", "block", "told", "tokens", F.posexplode("tokens").alias("at", "token")).join(F.broadcast(index), ["token", "size"])
    met = met.filter(F.size("tokens") >= F.col("need"))
    # A pair that matches passes at its first shared token: there, no earlier token of either can add to the overlap.
    met = met.filter(1 + F.least(F.col("length") - F.col("place") - 1, F.size("tokens") - F.col("at") - 1) >= F.col("need"))
    share = F.size(F.array_intersect("tokens", "wanted"))
    met = met.filter(share >= F.col("need"))
    # A block may pass at several shared tokens.
    met = met.select("rid", "template", "label", "size", "block", (share / F.col("length")).alias("share"), F.forall("must", lambda group: F.arrays_overlap(group, F.col("told"))).alias("told")).distinct()
    return rows.drop("words", "places", "sizes"), met


def links(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str, tuple[str, ...]]] | None = None) -> DataFrame:
    """All links of ``docs`` (doc_id, text) to templates: doc_id, template, label, n_blocks, share, told.

    One row for each row of ``docs`` and template of which a block has
    ``threshold`` of the distinct tokens, with the number of such blocks, the
    largest share and whether one has the phrases that tell the license. Those
    that are not told are links too, though ``scan`` gives them no label.
    """
    rows, met = _linked(docs, threshold, templates)
    found = met.groupBy("rid", "template", "label").agg(F.count("*").alias("n_blocks"), F.max("share").alias("share"), F.max("told").alias("told"))
    return rows.select("rid", "doc_id").join(found, "rid").drop("rid")


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str, tuple[str, ...]]] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template that a block contains where that
    is a match, 1 where a base phrase stands, else 0. A null text is an empty
    one. Repeated rows each give a row; an empty table gives none. Other columns
    are not read. Raises for templates of over MOST_WORDS words and for those
    without a distinguishing phrase.
    """
    rows, met = _linked(docs, threshold, templates)
    found = met.filter("told").groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    out = rows.join(found, "rid", "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("base_set", F.coalesce("found", none)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_set"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
