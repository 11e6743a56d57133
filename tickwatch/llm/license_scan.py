"""License scan: phrases word by word, and notices by an exact set-similarity join with templates.

Words are maximal runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters, so line breaks and
punctuation do not hide a notice. Two things are found in every whole text:

* the places of given phrases, as consecutive words;
* *blocks* that hold the words of a *template* up to its threshold, in any order and with words between. A template of k
  words is compared with blocks of 2**b >= 2 k words that begin every 2**(b-1) words, so each run of k words lies whole in
  some block, and a long text does not gather a template's words from all over it.

The join is the prefix-filtering one, and exact. The templates' words are ordered from rare to frequent, by the number of
blocks in the corpus that hold them. A template of which ``need`` words have to be there shares a word with a matching block
among its first ``size - need + 1`` words in that order, and with the block's own first words likewise (prefix filter);
a block with fewer than ``need`` words of the templates' vocabulary cannot match (length filter); and from the places of the
shared word in both, the words that can still be shared are counted (positional filter). What is left is compared word by
word. Words that no template has match nothing, so they only count as words of a text.

Texts are read once. The table of blocks with enough vocabulary is written; templates are parameters, so their index, one row per
prefix word, has a size that does not depend on the corpus and is broadcast. Nothing is joined on a text's or a source's key
except a row's own number, at the end, for the labels found in it.

Defined results: a null text is empty; rows without a match have no labels (``''``), score 0 and null places; rows of one
doc_id are rows of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwatch.llm.common import materialise
from tickwatch.model import local_frame

# --- fixed values: phrases and the openings of published licences, as they are worded there -------------
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
NOTICES = [
    ("released under the mit license", "mit", 1.0),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", 0.8),
    ("licensed under the apache license version 2 0", "apache-2", 1.0),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2", 0.8),
    ("licensed under cc by nc 4 0", "cc-by-nc", 1.0),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc", 0.9),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", 0.9),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3", "gpl-3", 0.8),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", 0.8),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", 0.9),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 0.8),
    ("this is free and unencumbered software released into the public domain", "unlicense", 0.9),
]
# --- end of fixed values ------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCAN = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, "
    "blocks array<struct<width: int, start: bigint, words: array<string>>>"
)
KINDS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base": pa.list_(pa.string())}
KINDS["blocks"] = pa.list_(pa.struct([("width", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.string()))]))


@dataclass(frozen=True)
class Template:
    """A notice: its distinct words, its label, how many of them a block must hold, and the width of its blocks."""

    number: int
    label: str
    words: frozenset[str]
    need: int
    width: int


def templates(notices: list[tuple[str, str, float]]) -> list[Template]:
    out = []
    for i, (text, label, threshold) in enumerate(notices):
        words = text.split()
        distinct = frozenset(words)
        # a share like 0.9 of 10 words is 9, whatever the float says
        need = max(1, ceil(round(threshold * len(distinct), 9)))
        out.append(Template(i, label, distinct, need, 1 << (2 * len(words) - 1).bit_length()))
    return out


# --- one pass over the texts ----------------------------------------------------------------


def places(words: list[str], phrases: list[tuple[list[str], str]]) -> list[tuple[int, str]]:
    """(start, label) of every phrase, overlapping ones too."""
    firsts = defaultdict(list)
    for phrase, label in phrases:
        firsts[phrase[0]].append((phrase, label))
    out = []
    for first, some in firsts.items():
        at = -1
        for _ in range(words.count(first)):
            at = words.index(first, at + 1)
            out += [(at, label) for phrase, label in some if words[at : at + len(phrase)] == phrase]
    return out


def blocks(words: list[str], vocabulary: dict[int, tuple[frozenset[str], int]]) -> list[dict]:
    """The blocks of each width that hold enough distinct words of the width's vocabulary."""
    out = []
    for width, (known, least) in vocabulary.items():
        if len(known.intersection(words)) < least:
            continue
        step = width // 2
        halves = defaultdict(set)
        for at, word in enumerate(words):
            if word in known:
                halves[at // step].add(word)
        last = (len(words) - 1) // step
        for half in halves.keys() | {h - 1 for h in halves if h}:
            # a block that ends with the text is the one before it, cut short
            if half == last and half:
                continue
            held = halves.get(half, set()) | halves.get(half + 1, set())
            if len(held) >= least:
                out.append({"width": width, "start": half * step, "words": sorted(held)})
    return sorted(out, key=lambda b: (b["width"], b["start"]))


def scanner(phrases: list[tuple[str, str]], wanted: list[Template]):
    """The function that scans batches of (doc_id, text)."""
    split = [(p.split(), label) for p, label in phrases]
    vocabulary = {}
    for width in sorted({t.width for t in wanted}):
        same = [t for t in wanted if t.width == width]
        vocabulary[width] = (frozenset().union(*(t.words for t in same)), min(t.need for t in same))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = defaultdict(list)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = WORD.findall((text.as_py() or "").translate(LOWER))
                found = places(words, split)
                starts = [at for at, _ in found]
                row = (doc_id, len(words), len(found), min(starts, default=None), max(starts, default=None), sorted({label for _, label in found}), blocks(words, vocabulary))
                for name, value in zip(KINDS, row):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict({name: pa.array(rows[name], kind) for name, kind in KINDS.items()})

    return scan


# --- the join ---------------------------------------------------------------------------------


def word_order(held: DataFrame, wanted: list[Template]) -> list[str]:
    """The templates' words from rare to frequent, by the blocks that hold them; at most as many rows as templates have words."""
    counts = held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    seen = {r["word"]: r["n"] for r in counts}
    return sorted(frozenset().union(*(t.words for t in wanted)), key=lambda w: (seen.get(w, 0), w))


def prefix_index(spark: SparkSession, wanted: list[Template], order: list[str]) -> DataFrame:
    """A row per template and word of its prefix: the word, its place in the template, what the template needs."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t in wanted:
        words = sorted(t.words, key=rank.__getitem__)
        for at, word in enumerate(words[: len(words) - t.need + 1]):
            rows.append({"width": t.width, "word": word, "at": at, "template": t.number, "label": t.label, "need": t.need, "size": len(words), "template_words": words})
    kind = "width int, word string, at int, template int, label string, need int, size int, template_words array<string>"
    return local_frame(spark, rows, kind)


def matches(held: DataFrame, wanted: list[Template]) -> DataFrame:
    """The columns of ``held`` (with width, words) for every block and template that meet the template's threshold:
    template, label, and containment, the share of the template's words that the block holds."""
    order = word_order(held, wanted)
    index = F.broadcast(prefix_index(held.sparkSession, wanted, order))
    least = F.lit(None).cast("int")
    for width in {t.width for t in wanted}:
        least = F.when(F.col("width") == width, min(t.need for t in wanted if t.width == width)).otherwise(least)
    # words in global order, as places in it: sorting places sorts words
    ranks = F.create_map(*[F.lit(x) for i, w in enumerate(order) for x in (w, i)])
    names = F.array(*[F.lit(w) for w in order])
    mine = held.withColumn("ranks", F.array_sort(F.transform("words", lambda w: ranks[w])))
    heads = mine.select("*", F.posexplode(F.slice("ranks", 1, F.size("ranks") - least + 1)).alias("my_at", "my_rank"))
    heads = heads.withColumn("word", names[F.col("my_rank")])
    able = heads.join(index, ["width", "word"]).where(
        (F.size("words") >= F.col("need"))
        # as many words as still come in both, the shared one included
        & (F.least(F.col("size") - F.col("at"), F.size("words") - F.col("my_at")) >= F.col("need"))
    )
    # a pair may share several prefix words: it is kept once, at the first
    both = F.array_intersect("words", "template_words")
    first = F.array_min(F.transform(both, lambda w: ranks[w]))
    exact = able.withColumn("shared", F.size(both)).where((F.col("shared") >= F.col("need")) & (first == F.col("my_rank")))
    return exact.withColumn("containment", F.col("shared") / F.col("size")).select(*held.columns, "template", "label", "containment")


def scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str, float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row per document with a number ``row``, a row per block and notice found: row, width, start, words, template, label, containment)."""
    wanted = templates(NOTICES if notices is None else notices)
    asked = PHRASES if phrases is None else phrases
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(texts.mapInArrow(scanner(asked, wanted), SCAN).withColumn("row", F.monotonically_increasing_id()), "license-rows")
    held = rows.where(F.size("blocks") > 0).select("row", F.inline("blocks"))
    if not wanted:
        return rows, held.selectExpr("*", "0 as template", "'' as label", "0d as containment").limit(0)
    return rows, matches(held, wanted)


def license_scan(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, notices: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """Per document: words, places of phrases, their labels, the labels of phrases and notices, and a score, the
    largest share of a phrase or notice that was found."""
    rows, found = scan(docs, phrases, notices)
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    out = rows.drop("blocks").join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
