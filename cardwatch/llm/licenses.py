"""License scans: an exact set-similarity join between text blocks and license templates.

A template is a set of words; a text block is a stretch of twice as many words as the template has,
and blocks start every template length, so any stretch as long as the template lies whole in one. A
block meets a template if it holds at least the threshold's share of the template's words.

All words of the templates are ordered by their number in all documents, rarest first. To meet a
template that needs ``n`` of its ``m`` words, a block must hold one of the first ``m - n + 1`` words of
the template in that order (prefix filter); it must hold at least ``n`` template words at all (length
filter); and while both ordered sets are merged, what is left of either must still be able to reach
``n`` (positional filter). The filters only spare work: every block that meets a template is found.

Base phrases are templates with a threshold of one; an exact look at the words of each block found
gives the places where the phrase stands word by word.

Edge cases: NULL and empty texts have no words, no labels and score 0; repeated rows are scanned each;
an empty table gives no rows; templates need at least one word; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import lower_ascii, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Share of a template's words that a block must hold.
THRESHOLD = 0.8

#: Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Names with versions, which a block must hold whole, and their labels.
NAMES = {
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc",
}
#: Wordings of public license notices and their labels.
TEMPLATES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu"
    " general public license as published by the free software foundation": "gpl",
    "you may not use this file except in compliance with the license you may obtain a copy of the license": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and"
    " associated documentation files to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided"
    " that the following conditions are met": "bsd",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
}


@dataclass(frozen=True)
class Template:
    label: str
    phrase: tuple[str, ...]
    need: int
    base: bool


def templates(
    phrases: Mapping[str, str] = BASE_PHRASES,
    names: Mapping[str, str] = NAMES,
    notices: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> list[Template]:
    def made(texts: Mapping[str, str], share: float, base: bool) -> list[Template]:
        split = [(tuple(WORD.findall(text)), label) for text, label in texts.items()]
        return [Template(label, words, math.ceil(share * len(set(words)) - 1e-9), base) for words, label in split]

    return made(phrases, 1.0, True) + made(names, 1.0, False) + made(notices, threshold, False)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text or ""))


def frequencies(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How often each word of a bounded vocabulary stands in all documents."""

    def count(batches):
        total: Counter[str] = Counter()
        for rows in rows_of(batches, "text"):
            for (text,) in rows:
                total.update(word for word in words_of(text) if word in vocabulary)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return {word: n for word, n in counted.groupBy("word").agg(F.sum("n")).collect()}


class Scanner:
    """The index from prefix words to templates, in the global order of words."""

    def __init__(self, wanted: list[Template], often: dict[str, int]):
        vocabulary = {word for template in wanted for word in template.phrase}
        ordered = sorted(vocabulary, key=lambda word: (often.get(word, 0), word))
        self.rank = {word: k for k, word in enumerate(ordered)}
        self.templates = [(t, sorted({self.rank[word] for word in t.phrase})) for t in wanted]
        self.by_prefix: dict[int, list[int]] = {}
        for k, (template, ranks) in enumerate(self.templates):
            for rank in ranks[: len(ranks) - template.need + 1]:
                self.by_prefix.setdefault(rank, []).append(k)

    def blocks(self, words: list[str]) -> list[tuple[Template, int, int, float]]:
        """Every block that meets a template: the template, first word, past the last, share held."""
        rank = self.rank
        known = [(at, rank[word]) for at, word in enumerate(words) if word in rank]
        candidates = set()
        for at, r in known:
            for k in self.by_prefix.get(r, ()):
                step = len(self.templates[k][0].phrase)
                candidates.update((k, block) for block in (at // step - 1, at // step) if block >= 0)
        found = []
        places = [at for at, _ in known]
        for k, block in sorted(candidates):
            template, ranks = self.templates[k]
            step = len(template.phrase)
            start, end = block * step, (block + 2) * step
            held = _between(known, places, start, end)
            if len(held) < template.need:
                continue
            own = sorted(set(held))
            overlap = self._overlap(ranks, own, template.need)
            if overlap >= template.need:
                found.append((template, start, min(end, len(words)), overlap / len(ranks)))
        return found

    @staticmethod
    def _overlap(ranks: list[int], own: list[int], need: int) -> int:
        i = j = overlap = 0
        while i < len(ranks) and j < len(own):
            if overlap + min(len(ranks) - i, len(own) - j) < need:
                return 0
            if ranks[i] == own[j]:
                i, j, overlap = i + 1, j + 1, overlap + 1
            elif ranks[i] < own[j]:
                i += 1
            else:
                j += 1
        return overlap

    def scan(self, text: str | None) -> tuple:
        """n_words, places of base phrases as (start, label), labels of the blocks, highest share."""
        words = words_of(text)
        places, labels, score = set(), set(), 0.0
        for template, start, end, share in self.blocks(words):
            if not template.base:
                labels.add(template.label)
                score = max(score, share)
                continue
            size = len(template.phrase)
            for at in range(start, end - size + 1):
                if words[at] == template.phrase[0] and tuple(words[at : at + size]) == template.phrase:
                    places.add((at, template.label))
                    score = 1.0
        return len(words), sorted(places), sorted(labels), score


def _between(known: list[tuple[int, int]], places: list[int], start: int, end: int) -> list[int]:
    return [r for _, r in known[bisect_left(places, start) : bisect_left(places, end)]]


SCAN = (
    "doc_id long, n_words long, places array<struct<word: long, label: string>>, labels array<string>, score double"
)


def scanned(docs: DataFrame, wanted: list[Template] | None = None) -> DataFrame:
    """One row per document: its words, places of base phrases, labels found by similarity, score.

    Two passes over the texts: one counts the templates' words, one scans. Both are without a shuffle
    of texts; the counts are as many as the templates have words.
    """
    wanted = wanted or templates()
    often = frequencies(docs, {word for template in wanted for word in template.phrase})
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])

    def scan(batches):
        scanner = Scanner(wanted, often)
        for rows in rows_of(batches, "doc_id", "text"):
            out = [scanner.scan(text) for _, text in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_id for doc_id, _ in rows], pa.int64()),
                    pa.array([r[0] for r in out], pa.int64()),
                    pa.array([[{"word": at, "label": label} for at, label in r[1]] for r in out], pa.list_(place)),
                    pa.array([r[2] for r in out], pa.list_(pa.string())),
                    pa.array([r[3] for r in out], pa.float64()),
                ],
                names=["doc_id", "n_words", "places", "labels", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCAN)
