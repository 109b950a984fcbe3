"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A block (a line, unless ``split`` says otherwise) meets a template if it holds at least
``threshold`` of the template's distinct words. The join is exact and finds its pairs by
filters over one order of words, rarest in the whole corpus first:

* length: a block with fewer template words than the needed overlap is dropped;
* prefix: if the overlap is reached, the first ``size - need + 1`` words of the template
  and those of the block, both in that order, have a word in common;
* position: from a common word on, what follows on either side must suffice;

and what passes is counted. Words that are in no template change no overlap, so blocks are
reduced to template words where the text is read, and texts are read once. Templates are a
fixed list: their words, counts and prefixes are a few hundred values, and the inverted
index of prefixes is one small map that each row looks into. Nothing is shuffled but the
counts of template words, combined first.

Besides, the phrases of ``PHRASES`` are looked for word by word in the whole text.

Defined cases: a null text is empty: no words, no labels, score 0; repeated rows give
repeated rows, also without id; very long lines are blocks like others; equal containments
keep all their labels; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from docweft.llm.columns import let
from docweft.session import stored

# Phrases and labels, templates and labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
]
THRESHOLD = 0.9
#: What stands between words of a lower-case text.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(BETWEEN, text.lower()) if w})


def needed(size: int, threshold: float) -> int:
    """Smallest overlap whose share of the template reaches the threshold."""
    return next(n for n in range(1, size + 1) if n / size >= threshold)


def places(low: Column) -> Column:
    """Start (words from 0) and label of each phrase in a lower-case text, in order."""

    def found(w: Column) -> Column:
        def at(i: Column) -> Column:
            hit = F.lit(None).cast("string")
            for phrase, label in PHRASES.items():
                same = [F.get(w, i + k) == word for k, word in enumerate(phrase)]
                hit = F.when(F.coalesce(all_of(same), F.lit(False)), label).otherwise(hit)
            return F.struct(i.cast("long").alias("start"), hit.alias("label"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1), at), lambda x: x["label"].isNotNull())

    none = F.array().cast("array<struct<start:bigint,label:string>>")
    ends = [phrase[-1] for phrase in PHRASES]
    some = [low.contains(x) for x in sorted(set(ends))]
    return F.when(any_of(some), let(F.array_remove(F.split(low, BETWEEN), ""), found)).otherwise(none)


def all_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def any_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def reduced(docs: DataFrame, key: str, text: str, templates, threshold: float, split: str) -> DataFrame:
    """``doc_id, n_words, places, blocks``: the phrases, and the template words of blocks that hold enough of them."""
    known = sorted({w for _, t in templates for w in template_words(t)})
    least = min(needed(len(template_words(t)), threshold) for _, t in templates)
    words = F.array(*(F.lit(w) for w in known))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # no phrase or template has a letter that only lower-casing beyond ASCII would give it
    rows = rows.withColumn("low", F.lower("t"))
    blocks = F.transform(F.split("low", split), lambda b: F.array_intersect(F.split(b, BETWEEN), words))
    return rows.select(
        "doc_id", F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"), places(F.col("low")).alias("places"),
        F.filter(blocks, lambda b: F.size(b) >= least).alias("blocks"),
    )


def order_of_words(seen: DataFrame) -> DataFrame:
    """One row with a map: word to its place, rarest first, ties by the word. Words that no block holds are not in it."""
    counts = seen.select(F.explode("blocks").alias("b")).select(F.explode("b").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    listed = counts.agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("l"))
    return listed.select(
        F.map_from_entries(F.transform("l", lambda x, i: F.struct(x["word"].alias("word"), i.alias("place")))).alias("places_of")
    )


def template_array(templates, threshold: float) -> Column:
    return F.array(
        *(
            F.struct(
                F.lit(label).alias("label"), F.array(*(F.lit(w) for w in template_words(text))).alias("words"),
                F.lit(needed(len(template_words(text)), threshold)).alias("need"),
            )
            for label, text in templates
        )
    )


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, split: str = "\n"
) -> DataFrame:
    """``doc_id, n_words, places, matches``: matches are ``block, label, containment`` of every pair that reaches the threshold."""
    seen = stored(reduced(docs, key, text, templates, threshold, split), "blocks")
    order = order_of_words(seen)

    def place(word: Column, of: Column) -> Column:
        return F.coalesce(of[word], F.lit(-1))  # a word that never occurs comes first: it is the rarest

    # the templates in that order, and the inverted index of their prefixes: word to (template, position)
    ordered = order.select(
        "places_of",
        F.transform(
            template_array(templates, threshold),
            lambda t: F.struct(
                t["label"].alias("label"), t["need"].alias("need"), t["words"].alias("words"),
                F.sort_array(F.transform(t["words"], lambda w: F.struct(place(w, F.col("places_of")).alias("p"), w.alias("w")))).alias("sorted"),
            ),
        ).alias("templates"),
    )
    entries = F.flatten(
        F.transform(
            "templates",
            lambda t, n: F.transform(
                F.slice(t["sorted"], F.lit(1), F.size(t["words"]) - t["need"] + 1),
                lambda x, i: F.struct(x["w"].alias("w"), n.alias("t"), i.alias("i")),
            ),
        )
    )
    plan = ordered.select(
        F.struct("places_of", "templates", entries.alias("index"), F.array_distinct(F.transform(entries, lambda e: e["w"])).alias("heads")).alias("plan")
    )
    rows = seen.withColumn("plan", plan.scalar())

    def matches(block: Column, number: Column, plan: Column) -> Column:
        def pairs(b: Column) -> Column:
            size = F.size(b)

            def passes(e: Column) -> Column:
                t = F.get(plan["templates"], e["t"])
                j = F.array_position(b, e["w"]).cast("int") - 1
                after = F.least(F.size(t["words"]) - e["i"] - 1, size - j - 1)
                return (j >= 0) & (size >= t["need"]) & (j <= size - t["need"]) & (after + 1 >= t["need"])

            near = F.array_distinct(F.transform(F.filter(plan["index"], passes), lambda e: e["t"]))
            counted = F.transform(
                near,
                lambda n: F.struct(
                    number.alias("block"), F.get(plan["templates"], n)["label"].alias("label"), F.get(plan["templates"], n)["need"].alias("need"),
                    F.size(F.array_intersect(F.get(plan["templates"], n)["words"], b)).alias("overlap"),
                    F.size(F.get(plan["templates"], n)["words"]).alias("size"),
                ),
            )
            return F.transform(
                F.filter(counted, lambda x: x["overlap"] >= x["need"]),
                lambda x: F.struct(x["block"].alias("block"), x["label"].alias("label"), (x["overlap"] / x["size"]).alias("containment")),
            )

        in_order = F.transform(
            F.sort_array(F.transform(block, lambda w: F.struct(place(w, plan["places_of"]).alias("p"), w.alias("w")))), lambda x: x["w"]
        )
        return let(in_order, pairs)

    none = F.array().cast("array<struct<block:int,label:string,containment:double>>")
    found = F.flatten(
        F.transform(
            "blocks",
            lambda b, n: F.when(F.arrays_overlap(b, F.col("plan")["heads"]), matches(b, n, F.col("plan"))).otherwise(none),
        )
    )
    return rows.select("doc_id", "n_words", "places", found.alias("matches"))
