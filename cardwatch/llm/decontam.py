"""Benchmark decontamination: items found in documents within an error budget of word edits.

Texts are compared as lower-cased words. An item of up to 36 words is tested as a whole, and one of more
than 24 words as all of its stretches of 24 words too, so that every copied part of 24 words or more is
found; a shorter part of a longer item is no evidence. A window of ``m`` words may differ by
``k = m // 8`` word edits. By the pigeonhole principle, of ``k + 1`` pieces that lie apart in it at least
one then occurs unchanged: an Aho-Corasick automaton over all pieces finds these hits, and Myers'
bit-parallel edit distance verifies the windows around each. Windows share their pieces: every stretch
of 24 words holds four whole pieces of an item that is cut every five words.

The benchmark is the stated query set. It is matched in blocks of a bounded number of characters, one
pass over the documents for each, so the automaton in a task and the block sent to the executors are
bounded whatever its size.

Edge cases: NULL and empty texts contain nothing; items of fewer than ``MIN_WORDS`` words, NULL or
empty ones are no evidence and match nothing; items repeated under one id count once; repeated
documents each give their rows; empty tables give no matches; other columns are ignored by ``matches``
and kept by ``decontaminated``, which works on rows and so also on rows without a doc_id.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import rows_of, slices

WORD = re.compile(r"[^\W_]+")
MIN_WORDS = 6
#: Of longer items all windows of this many words are tested.
WINDOW = 24
#: Items of up to this many words are tested as a whole, with the budget of the whole.
WHOLE = WINDOW + WINDOW // 2
#: One word edit is allowed for so many words.
WORDS_PER_EDIT = 8
#: Words of a shared piece, such that a window holds one piece more than its edits wherever it starts.
PIECE = (WINDOW + 1) // (WINDOW // WORDS_PER_EDIT + 2)
#: Windows whose bit masks a task keeps.
PATTERNS_KEPT = 4096
#: Characters of the benchmark that are matched in one pass.
BLOCK_CHARS = 4_000_000

MATCHES = "doc_id long, item_id long, windows int, windows_hit int, distance int, first_word int, last_word int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Pattern:
    """One window of an item: its words as bit masks, and its pieces."""

    def __init__(self, words: list[str]):
        self.words, self.budget = words, len(words) // WORDS_PER_EDIT
        self.forward, self.backward = masks(words), masks(words[::-1])

    def pieces(self) -> Iterator[tuple[int, str]]:
        """Where each piece starts, and its words."""
        count, length = self.budget + 1, len(self.words)
        borders = [length * k // count for k in range(count + 1)]
        for start, end in zip(borders, borders[1:], strict=False):
            yield start, f" {' '.join(self.words[start:end])} "

    def find(self, text: list[str], at: int) -> tuple[int, int, int] | None:
        """Distance, first and last word of the best place whose start is within the budget of ``at``."""
        low = max(0, at - self.budget)
        high = min(len(text), at + len(self.words) + self.budget)
        distance, end = best_end(self.forward, len(self.words), text[low:high])
        if distance > self.budget:
            return None
        _, back = best_end(self.backward, len(self.words), text[low : low + end + 1][::-1], distance)
        return distance, low + end - back, low + end


def masks(words: list[str]) -> dict[str, int]:
    found: dict[str, int] = {}
    for k, word in enumerate(words):
        found[word] = found.get(word, 0) | 1 << k
    return found


def best_end(pattern: dict[str, int], length: int, text: list[str], wanted: int = -1) -> tuple[int, int]:
    """Myers' algorithm: the least edit distance of the pattern to a stretch of the text, and its end.

    The first end that reaches ``wanted`` is taken at once; otherwise the first of the least.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, -1
    for k, word in enumerate(text):
        equal = pattern.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, k
            if best == wanted:
                break
    return best, end


class Finder:
    """All windows of a block of items, and the automaton over their pieces."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.windows: dict[int | None, int] = {}
        #: Words of each text, its item_id, and the number of its first window within the item.
        self.texts: list[tuple[list[str], int | None, int]] = []
        automaton = ahocorasick.Automaton()
        #: Of each piece: the text, where the piece starts in it, its words, and whether the whole text is meant.
        places: dict[str, list[tuple[int, int, int, bool]]] = {}
        for item_id, text in dict.fromkeys(items):
            words = words_of(text)
            starts = window_starts(len(words))
            if not starts:
                continue
            number, known = len(self.texts), self.windows.get(item_id, 0)
            self.texts.append((words, item_id, known))
            self.windows[item_id] = known + len(starts)
            if starts[0] is None:
                for at, piece in Pattern(words).pieces():
                    places.setdefault(piece, []).append((number, at, piece.count(" ") - 1, True))
            if starts[-1] is not None:
                for at in range(0, len(words) - PIECE + 1, PIECE):
                    piece = f" {' '.join(words[at : at + PIECE])} "
                    places.setdefault(piece, []).append((number, at, PIECE, False))
        for piece, found in places.items():
            automaton.add_word(piece, found)
        if places:
            automaton.make_automaton()
        self.automaton = automaton if places else None
        self.pattern = lru_cache(PATTERNS_KEPT)(self._pattern)

    def _pattern(self, number: int, start: int | None) -> Pattern:
        words = self.texts[number][0]
        return Pattern(words if start is None else words[start : start + WINDOW])

    def _around(self, number: int, at: int, size: int, whole: bool) -> Iterator[tuple[int, int | None]]:
        """The windows that hold a piece: their number within the item, and where they start."""
        words, _, known = self.texts[number]
        if whole:
            yield known, None
            return
        known += len(words) <= WHOLE
        for start in range(max(0, at + size - WINDOW), min(at, len(words) - WINDOW) + 1):
            yield known + start, start

    def search(self, text: str | None) -> list[tuple]:
        """(item_id, windows, windows_hit, least distance, first_word, last_word, distance of the whole item,
        None if it is not found as a whole) of every item found."""
        words = words_of(text)
        if not words or self.automaton is None:
            return []
        line = f" {' '.join(words)} "
        starts: list[int] = []
        found: dict[tuple, tuple[int, int, int]] = {}
        tried: set[tuple] = set()
        as_whole: dict[int | None, int] = {}
        for end, places in self.automaton.iter(line):
            starts = starts or list(accumulate((len(word) + 1 for word in words), initial=1))
            word = bisect_right(starts, end - 1) - 1  # the last word of the piece
            for number, at, size, whole in places:
                item_id = self.texts[number][1]
                for window, start in self._around(number, at, size, whole):
                    if found.get((item_id, window), (1,))[0] == 0:
                        continue
                    first = word - size + 1 - at + (start or 0)
                    if (item_id, window, first) in tried:
                        continue
                    tried.add((item_id, window, first))
                    place = self.pattern(number, start).find(words, first)
                    if place is not None and place < found.get((item_id, window), (len(words),)):
                        found[item_id, window] = place
                    if place is not None and start is None:
                        as_whole[item_id] = min(place[0], as_whole.get(item_id, place[0]))
        by_item: dict = {}
        for (item_id, _), place in found.items():
            by_item.setdefault(item_id, []).append(place)
        return [
            (item_id, self.windows[item_id], len(places), *(f(p[k] for p in places) for k, f in enumerate((min, min, max))), as_whole.get(item_id))
            for item_id, places in by_item.items()
        ]


def window_starts(length: int) -> list[int | None]:
    """Where windows start; the single None stands for the whole item."""
    if length < MIN_WORDS:
        return []
    whole = [None] if length <= WHOLE else []
    return whole + [*range(length - WINDOW + 1)] if length > WINDOW else whole


def _finders(benchmark: DataFrame):
    """One broadcast of items per block."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    context = benchmark.sparkSession.sparkContext
    for block in range(blocks):
        # By the id alone, so that all texts of an item are searched for together; NULL is one id.
        own = items.distinct().filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        yield context.broadcast([tuple(row) for row in own.collect()])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: how many of the item's windows, the distance, and the
    span of words they cover. The distance is the whole item's where that is found, else the least."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for sent in _finders(benchmark):
        part = narrow.mapInArrow(_searching(sent), MATCHES)
        found = part if found is None else found.unionByName(part)
    return found


def _searching(sent):
    names = ["doc_id", "item_id", "windows", "windows_hit", "distance", "first_word", "last_word"]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]

    def search(batches):
        finder = Finder(sent.value)
        for rows in rows_of(batches, "doc_id", "text"):
            out = [
                (doc_id, *match[:3], match[3] if match[-1] is None else match[-1], *match[4:-1])
                for doc_id, text in rows
                for match in finder.search(text)
            ]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return search


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found; no shuffle."""
    for sent in _finders(benchmark):
        docs = docs.mapInArrow(_keeping(sent), docs.schema)
    return docs


def _keeping(sent):
    def keep(batches):
        finder = Finder(sent.value)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not finder.search(text) for text in texts], pa.bool_()))

    return keep
