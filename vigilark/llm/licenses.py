"""License scans with built-in functions only: fixed phrases, and an exact set-similarity join of text blocks and templates.

A block is what stands between ends of sentences or blank lines; it holds a template if it has at least ``percent``
of the template's distinct words. All such pairs are found by the prefix method of set-similarity joins:

* Template words are put in one order by the number of documents that have them, rarest first; words of no
  template come after all others, and can be left out of a block without changing any overlap.
* An overlap of o words of a template of t means that the first t - o + 1 words of the template and the first
  b - o + 1 of the block's b share one (prefix filter), that b >= o (length filter), and that not too few words
  are left on either side behind the shared one (position filter). What passes is verified on the full sets.

The index has a row for each prefix word of the templates, which are a list at the driver of at most
``MOST_WORDS`` words, so it is broadcast; documents without any prefix word are left after one look at their words.
Matches are joined back by the digest of the text: copies of a text share them.

Defined cases: a null text is an empty one, with no words and no labels; repeated rows and null ids give a row each;
an empty table gives an empty result; a template without words is never found; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilark.functions.fields import array_lit, once
from vigilark.llm.common import written

#: Label and phrase of the base scan. Fixed values.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Label and text of notices as licenses word them. Fixed values.
TEMPLATES = (
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
            "this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Share of a template's words that a block must have.
PERCENT = 80
#: Template words that the driver and each task may hold.
MOST_WORDS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words of a lower-cased text, and between blocks.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCKS = r"[.!?][\x09-\x0D\x20]+|\n[\x09\x20]*\n"


class Template(NamedTuple):
    number: int
    label: str
    words: list[str]
    """Distinct words, rarest first."""
    least: int


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(low: Column) -> Column:
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def word_sets(templates: tuple[tuple[str, str], ...]) -> list[list[str]]:
    """Each template's distinct words, in the order of its text."""
    import re

    sets = [list(dict.fromkeys(w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w)) for _, text in templates]
    if sum(map(len, sets)) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words of templates; scan with parts of the list")
    return sets


def ordered(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT,
            text_col: str = "text") -> tuple[list[str], list[Template]]:
    """The words of all templates, rarest first by the documents that have them, and the templates in that order.

    Every document counts. A row for each template word reaches the driver.
    """
    sets = word_sets(templates)
    vocabulary = sorted({w for s in sets for w in s})
    held = F.explode(F.array_intersect(words(lowered(F.col(text_col))), array_lit(vocabulary)))
    found = {r.word: r["count"] for r in docs.select(held.alias("word")).groupBy("word").count().collect()} if vocabulary else {}
    order = sorted(vocabulary, key=lambda w: (found.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    return order, [Template(i, label, sorted(s, key=place.get), -(-percent * len(s) // 100))
                   for i, ((label, _), s) in enumerate(zip(templates, sets)) if s]


def index(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """A row for each word of a template's prefix, with its place there from 1."""
    rows = [(t.number, t.label, t.words, len(t.words), t.least, w, i + 1)
            for t in templates for i, w in enumerate(t.words[:len(t.words) - t.least + 1])]
    return docs.sparkSession.createDataFrame(
        rows, "template int, label string, template_words array<string>, size int, least int, word string, template_place int")


def pairs(docs: DataFrame, order: list[str], templates: list[Template], text_col: str = "text") -> DataFrame:
    """digest, block (from 0), block_text, template, label, overlap, containment of every block and template that meet the threshold.

    ``digest`` is sha256 of the text; texts that repeat give their pairs again.
    """
    fewest = min((t.least for t in templates), default=1)
    prefixes = sorted({w for t in templates for w in t.words[:len(t.words) - t.least + 1]})
    low = docs.select(lowered(F.col(text_col)).alias("low"), F.col(text_col).alias("text"))
    some = low.filter(F.arrays_overlap(words(F.col("low")), array_lit(prefixes or [""])))
    blocks = some.select(F.sha2("text", 256).alias("digest"), F.posexplode(F.split("low", BLOCKS)).alias("block", "block_text"))
    # array_intersect keeps the order of its first argument, here the common one.
    known = once(blocks.withColumn("held", F.array_intersect(array_lit(order or [""]), words(F.col("block_text")))), "held")
    prefix = F.slice("held", F.lit(1), F.size("held") - fewest + 1)
    probes = known.filter(F.size("held") >= fewest).select("*", F.posexplode(prefix).alias("place", "word"))
    met = probes.join(F.broadcast(index(docs, templates)), "word")
    b, place = F.size("held"), F.col("place") + 1
    left = F.least(F.col("size") - F.col("template_place"), b - place)
    near = met.filter((b >= F.col("least")) & (place <= b - F.col("least") + 1) & (left + 1 >= F.col("least")))
    both = F.array_intersect("template_words", "held")
    # Several prefix words may meet; the pair counts where the first common one does.
    sure = near.withColumn("both", both).filter((F.size("both") >= F.col("least")) & (F.element_at("both", 1) == F.col("word")))
    return sure.select("digest", "block", "block_text", "template", "label", F.size("both").alias("overlap"),
                       (F.size("both") / F.col("size")).alias("containment"))


def by_text(found: DataFrame) -> DataFrame:
    """digest, found_labels, containment: of each block the best template, by share of its words, then by their number."""
    hits = found.groupBy("digest", "block").agg(F.collect_set(F.struct("containment", "overlap", "label")).alias("hits"))
    best = F.array_max("hits")
    top = F.filter("hits", lambda h: (h["containment"] == best["containment"]) & (h["overlap"] == best["overlap"]))
    return hits.select("digest", best["containment"].alias("containment"), F.explode(top).alias("hit")).groupBy("digest").agg(
        F.collect_set("hit.label").alias("found_labels"), F.max("containment").alias("containment"))


def places(word_list: Column) -> Column:
    """Start and label of each place where the words of a phrase stand one after another."""
    def starts(label: str, phrase: str) -> Column:
        def here(i: Column) -> Column:
            good = F.lit(True)
            for k, word in enumerate(phrase.split(" ")):
                good = good & (F.get(word_list, i + k) == word)
            return good

        all_ = F.sequence(F.lit(0), F.size(word_list) - 1)
        return F.transform(F.filter(all_, here), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    last = array_lit(sorted({phrase.split(" ")[-1] for _, phrase in PHRASES}))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(F.arrays_overlap(word_list, last), F.concat(*(starts(*p) for p in PHRASES))).otherwise(none)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, base (start and label of the phrases' places), found_labels, containment.

    ``found_labels`` are those of the templates, null with ``containment`` where no block holds one.
    """
    order, ranked = ordered(docs, templates, percent, text_col)
    found = written(by_text(pairs(docs, order, ranked, text_col)), "license-pairs")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), words(lowered(text)).alias("words"))
    counted = once(rows, "words").select("id", "digest", F.size("words").cast("long").alias("n_words"), places(F.col("words")).alias("base"))
    return counted.join(found, "digest", "left").select(F.col("id").alias(id_col), "n_words", "base", "found_labels", "containment")


def labelled(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The scan in plain columns: counts, first and last place, labels as text, and a score.

    The score is the largest share of a template's words that a block has, if it meets the threshold; 1 with a phrase.
    """
    base = F.array_distinct(F.transform("base", lambda p: p["label"]))
    starts = F.transform("base", lambda p: p["start"])
    every = F.array_union(base, F.coalesce("found_labels", F.array().cast("array<string>")))
    shown = lambda labels: F.array_join(F.array_sort(labels), ",")
    n_base = F.size("base").cast("long")
    return scanned.select(
        id_col, "n_words", n_base.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        shown(base).alias("base_labels"), shown(every).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))
