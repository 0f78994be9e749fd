"""License notices in text blocks: an exact set-similarity join of blocks with templates by containment.

A template is a set of words, and a block holds it if at least a share `threshold` of them stands in the block; of a
template of few words, where a single one tells licenses apart, all must stand there. Words are ordered by their frequency in all documents, rarest first. A block that holds a template of n words, o = ceil of
threshold * n of them, must hold one of the template's first n - o + 1 words, so only these are looked up (prefix
filter). Blocks with fewer than o different template words are skipped (length filter), and so are pairs whose words
after the first common one are too few on either side (positional filter). What is left is compared word by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.texts import shipped, slices

THRESHOLD = 0.8
BLOCK_WORDS = 64            # a block is a line, or a window of so many words, or twice the longest template, over a longer line or the whole text
WHOLE_BELOW = 10            # templates of fewer words must stand whole: one word tells such licenses apart

#: Lower case, and every ASCII character but letters and digits as a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

#: Words that must stand one after the other, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Opening words of public license notices, and their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("all-rights", "copyright all rights reserved no part may be reproduced without written permission"),
]


def words_of(line: str | bytes | None) -> list[bytes]:
    line = line.encode() if isinstance(line, str) else line or b""
    return line.translate(_FOLD).split()


@dataclass
class Join:
    """Templates as ordered sets, with the index of their prefixes."""

    order: dict[bytes, int]                         # word: place in the global order
    templates: list[tuple[str, list[int], int]]     # label, places in order, words needed
    prefixes: dict[int, list[tuple[int, int]]]      # place: (template, position in it)
    block: int = BLOCK_WORDS                        # words of a window; the next begins half of them further on

    def held(self, block: list[int]) -> Iterator[tuple[str, float]]:
        """(label, containment) of each template that a block, its words as places, holds."""
        own = sorted(set(block))
        seen = set()
        for j, place in enumerate(own):
            for t, i in self.prefixes.get(place, ()):
                if t in seen:
                    continue
                seen.add(t)                         # its first common word: every earlier one of the block is not in it
                label, words, need = self.templates[t]
                if len(own) < need or 1 + min(len(words) - i - 1, len(own) - j - 1) < need:
                    continue
                common = len(set(words).intersection(own[j:]))
                if common >= need:
                    yield label, common / len(words)


def make_join(counts: dict[bytes, int], templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> Join:
    sets = [(label, set(words_of(text))) for label, text in templates]
    if not all(words for _, words in sets):
        raise ValueError("a template must have a word")
    block = max([BLOCK_WORDS, *(2 * len(words_of(text)) for _, text in templates)])
    order = {w: k for k, w in enumerate(sorted(set().union(*(s for _, s in sets)), key=lambda w: (counts.get(w, 0), w)))}
    rows = [(label, sorted(order[w] for w in s), len(s) if len(s) < WHOLE_BELOW else max(1, math.ceil(threshold * len(s) - 1e-9))) for label, s in sets]
    prefixes: dict[int, list[tuple[int, int]]] = {}
    for t, (_, words, need) in enumerate(rows):
        for i, place in enumerate(words[:len(words) - need + 1]):
            prefixes.setdefault(place, []).append((t, i))
    return Join(order, rows, prefixes, block)


def blocks_around(lines: list[int], at: list[int], width: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """The blocks (first word, end) of `width` words that hold one of the word numbers `at`; `lines` are the ends of the lines."""
    out = set()
    ends, step = np.array(lines), width // 2
    for place in at:
        n = int(np.searchsorted(ends, place, side="right"))
        begin, end = int(ends[n - 1]) if n else 0, int(ends[n])
        last = max(0, -(-(end - begin - width) // step))
        for k in range(max(0, (place - begin - width) // step + 1), min(last, (place - begin) // step) + 1):
            a = begin + k * step
            out.add((a, min(a + width, end)))
    return sorted(out)


def scan(text: str | None, join: Join, across: bool = False) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    """(words, phrase places, first and last of them, their labels, all labels, score) of one text.

    Blocks are those of the lines and, with `across`, the windows over the whole text as well.
    """
    by_line = [words_of(line) for line in (text or "").encode().split(b"\n")]
    words = [w for line in by_line for w in line]
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in PHRASES:
        needle = f" {phrase} ".encode()
        at, before, place = joined.find(needle), 0, 0
        while at >= 0:
            place += joined.count(b" ", before, at)         # each byte is counted once
            before = at
            starts.append(place)
            base.add(label)
            at = joined.find(needle, at + 1)
    labels, score = set(base), 1.0 if starts else 0.0
    get = join.order.get
    places = [get(w, -1) for w in words]
    hits = [i for i, p in enumerate(places) if p >= 0 and p in join.prefixes]
    if hits:
        ends = np.cumsum([len(line) for line in by_line]).tolist()
        blocks = blocks_around(ends, hits, join.block)
        if across and len(by_line) > 1:
            blocks = sorted({*blocks, *blocks_around([len(words)], hits, join.block)})
        for a, b in blocks:
            for label, share in join.held([p for p in places[a:b] if p >= 0]):
                labels.add(label)
                score = max(score, share)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels), score


def word_counts(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> dict[bytes, int]:
    """How often each word of the templates stands in all documents."""
    wanted = {w for _, text in templates for w in words_of(text)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total.update(w for w in words_of(text) if w in wanted)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}       # a row per template word at most


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each whole text.

    A-Z count as lower case; words are runs of ASCII letters and digits and of all other characters beyond ASCII.
    `n_base` counts the places of `PHRASES`, `first_word` and `last_word` are the first and last word number where one
    starts, null if none does. `labels` adds those of the templates that a block holds (see above); blocks are the lines and
    windows over the whole text, twice as wide as the longest template, so a notice may be wrapped. The score is the largest share
    of a template that a block holds, 1 where a phrase stands, 0 where there are no labels. Null texts are empty and
    have no words. Every row gives a row, equal or null ids included; only doc_id and text are read, so extra columns
    cannot clash; an empty table gives no rows.
    """
    sent = shipped(docs.sparkSession, make_join(word_counts(docs, templates), templates, threshold))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = sent()
        for batch in slices(batches):
            n, base, first, last, own, labels, score = zip(*(scan(t, join, across=True) for t in batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                 pa.array(own, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string())), pa.array(score, pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        apply, f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
               "base_labels array<string>, labels array<string>, score double")
