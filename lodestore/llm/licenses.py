"""License scans: an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.shared import small_batches
from lodestore.llm.tokens import alnum_words

# Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Openings and short notices of public licenses, with the labels they add.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide"),
    ("reserved", "All rights reserved"),
)

#: A block meets a template if it contains this part of the template's distinct words.
THRESHOLD = 0.85
#: Templates are held by every task; more than this many must be scanned in several calls.
MOST_TEMPLATES = 20_000


def needed(size: int, threshold: float) -> int:
    """Words of a template of ``size`` distinct ones that a block must contain."""
    return max(1, math.ceil(threshold * size - 1e-9))


def longest(template: str, threshold: float) -> int:
    """Words of the longest block: the template's, and as many others as may be missing of it."""
    return math.ceil(len(alnum_words(template.encode())) / threshold - 1e-9)


class TemplateIndex:
    """Prefixes of the templates' words, ordered from the rarest in the corpus.

    A block that contains ``needed`` of a template's n words contains one of the first n - needed + 1 of any order.
    """

    def __init__(self, templates, often: dict[bytes, int], threshold: float):
        self.labels, self.words, self.least, self.reach = [], [], [], []
        self.by_word: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for label, text in templates:
            words = sorted(set(alnum_words(text.encode())), key=lambda w: (often.get(w, 0), w))
            if not words:
                continue
            k, least = len(self.words), needed(len(words), threshold)
            self.labels.append(label)
            self.words.append(words)
            self.least.append(least)
            self.reach.append(longest(text, threshold))
            for at, w in enumerate(words[: len(words) - least + 1]):
                self.by_word[w].append((k, at))

    def candidates(self, present: set[bytes]) -> Iterator[int]:
        """The templates of which a text has a prefix word and, in all, enough words."""
        tested = set()
        # in prefix order, so a template's first probe found is its first word that the text has
        for at, k in sorted((at, k) for w in present & self.by_word.keys() for k, at in self.by_word[w]):
            if k not in tested:
                tested.add(k)
                # positional filter: too few of the template's words are left from here on; length filter: too few are there
                if len(self.words[k]) - at >= self.least[k] and sum(w in present for w in self.words[k][at:]) >= self.least[k]:
                    yield k

    def best(self, k: int, places: list[tuple[int, bytes]]) -> tuple[float, int]:
        """(containment, first word) of the first block that holds the most of a template's different words; ``places``
        are those of the text's words that are in any template."""
        own, reach, count, held = frozenset(self.words[k]), self.reach[k], {}, deque()
        most, start = 0, -1
        for at, w in places:
            if w not in own:
                continue
            held.append((at, w))
            count[w] = count.get(w, 0) + 1
            while at - held[0][0] >= reach:
                left = held.popleft()[1]
                count[left] -= 1
                if not count[left]:
                    del count[left]
            if len(count) > most:
                most, start = len(count), held[0][0]
        return most / len(self.words[k]), start


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many texts of ``docs(text)`` each word of a bounded vocabulary occurs; one row per word and task moves."""
    small_batches(docs.sparkSession)
    vocabulary = frozenset(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                for w in vocabulary.intersection(alnum_words(t or b"")):
                    seen[w] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(start word, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases:
        at, n = -1, len(phrase)
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + n] == phrase:
                out.append((at, label))
    return out


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, places, matches) for each row of ``docs(doc_id, text)``.

    ``places`` lists (start word, label) of the phrases in the whole text. A block is any run of words, whatever line
    breaks stand in it, of up to ``longest`` words. ``matches`` lists (label, start word, containment) of the first blocks
    with the highest containment of each label, for every template of which a block contains at least ``threshold`` of
    the distinct words: found exactly, by prefix, length and positional filters on words ordered by their frequency in
    all texts.

    Null texts have no words. Texts without words match nothing; a very long one takes time in proportion. Repeated rows
    each get a row, a null doc_id stays null, empty tables give no rows, other columns are ignored. Templates without
    words are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MOST_TEMPLATES} a call")
    vocabulary = {w for _, text in templates for w in alnum_words(text.encode())}
    index = spark.sparkContext.broadcast(TemplateIndex(templates, word_frequencies(docs, vocabulary), threshold))
    wanted = [(alnum_words(p.encode()), label) for p, label in phrases.items()]
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("containment", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        prefix, every = frozenset(own.by_word), frozenset(w for words in own.words for w in words)
        firsts = frozenset(p[0] for p, _ in wanted)
        for b in batches:
            n_words, places, matches = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                words = alnum_words(t or b"")
                n_words.append(len(words))
                seen = set(words)
                places.append([{"start": at, "label": label} for at, label in sorted(phrase_places(words, wanted))] if firsts & seen else [])
                best: dict[str, tuple[float, int]] = {}
                if prefix & seen:
                    found = list(own.candidates(seen))
                    at = [(i, w) for i, w in enumerate(words) if w in every] if found else []
                    for k in found:
                        containment, start = own.best(k, at)
                        if containment * len(own.words[k]) >= own.least[k] - 1e-9 and (containment, -start) > best.get(own.labels[k], (0.0, 0)):
                            best[own.labels[k]] = (containment, -start)
                matches.append([{"label": label, "start": -i, "containment": c} for label, (c, i) in sorted(best.items())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(places, kind.field(2).type), pa.array(matches, kind.field(3).type)], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, places array<struct<start:long,label:string>>, matches array<struct<label:string,start:long,containment:double>>")
