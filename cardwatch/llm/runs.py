"""Periodic runs: stretches of words that repeat with a period, and texts with such stretches collapsed.

A run is a stretch of at least ``max(least, 2 * period)`` words in which words one period apart are
equal, that no neighbouring word extends, named by its smallest period.

*Descending-LCP Kruskal.* The suffixes of a text are sorted; the longest common prefix of neighbours is
the weight of an edge. Edges are taken by falling weight, and the classes at their ends, ordered sets of
positions in a union-find, are united, the smaller into the larger. Two positions ``p < p + d`` that
become neighbours in the united set at weight ``l`` share exactly ``l`` words. If ``d <= l`` they seed
the run of ``d + l`` words from ``p`` with period ``d``, provided that the words before them differ.
Nothing smaller than ``d`` can be the period: its positions would lie between the two, in the set
since a greater weight. So each run is found once and complete, without extending or verifying.

A run of ``least`` words needs ``l >= least / 2``, so only positions whose next ``least / 2`` words come
again in the text are sorted, and the edges end at that weight. Texts are taken together, some hundred
thousand words at a time, with words numbered apart for each text; sorting is by prefix doubling.

Memory follows the words of one text, or of ``BATCH_WORDS``; nothing is shuffled, so copies and
common words make no hot group.

Edge cases: NULL and empty texts have no words and no runs; repeated rows, rows with NULL ids and tied
texts are treated each for itself; an empty table gives no rows; columns of any name besides ``doc_id``
and ``text`` are ignored; very long texts take time and memory in proportion, times a logarithm.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 12
#: Words handled together.
BATCH_WORDS = 200_000
#: Odd factor of the rolling hash that sorts out positions before words are compared.
FACTOR = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period

FOUND = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string, "
    "runs_sha256 string, collapsed_sha256 string"
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, equal only within a text, each text followed by a number of its own; and
    where the texts begin."""
    parts, starts, base, at = [], [], 0, 0
    for words in texts:
        known = {word: k for k, word in enumerate(dict.fromkeys(words), base)}
        codes = np.empty(len(words) + 1, np.int64)
        codes[:-1] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        base += len(known)
        codes[-1] = base
        base += 1
        parts.append(codes)
        starts.append(at)
        at += len(codes)
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(starts, np.int64)


def _repeated(codes: np.ndarray, gram: int) -> np.ndarray:
    """Ascending positions whose next ``gram`` words come again; some more where hashes collide."""
    room = len(codes) - gram + 1
    if room < 2:
        return np.empty(0, np.int64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * FACTOR
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(room, np.uint64)
    for k in range(gram):
        key = key * FACTOR + mixed[k : k + room]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(room, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def _firsts(changes: np.ndarray) -> np.ndarray:
    """For each element of an ordered array the place of the first of its group."""
    places = np.concatenate([[True], changes])
    return np.maximum.accumulate(np.where(places, np.arange(len(places)), 0))


def _grouped(codes: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their next ``gram`` words, and the place of the first equal one.

    The positions are those that repeat and the ``gram`` after each: where a repeated stretch ends, the
    order of its suffixes is decided there.
    """
    found = _repeated(codes, gram)
    near = np.unique((found[:, None] + np.arange(gram + 1)).ravel())
    near = near[near + gram <= len(codes)]
    if not len(near):
        return near, near
    columns = [codes[near + k] for k in range(gram)]
    order = np.lexsort(columns[::-1])
    changes = np.any([column[order[1:]] != column[order[:-1]] for column in columns], axis=0)
    return near[order], _firsts(changes)


def _sorted_suffixes(codes: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in suffix order, the words each shares with the next, and its group by ``gram`` words."""
    # Numbers of their own after the end, so that every position has ``gram`` words.
    codes = np.concatenate([codes, codes.max(initial=0) + 1 + np.arange(gram)])
    suffixes, group = _grouped(codes, gram)
    if not len(suffixes):
        return suffixes, suffixes, suffixes
    # Positions outside stand for themselves.
    rank = len(suffixes) + np.arange(len(codes))
    rank[suffixes] = group
    levels, width = [(gram, rank.astype(np.int32))], gram
    while True:
        place = rank[suffixes]
        open_ = np.flatnonzero(np.bincount(place, minlength=len(place))[place] > 1)
        if not len(open_):
            break
        at = suffixes[open_]
        own, following = rank[at], rank[at + width]
        order = np.lexsort((following, own))
        at, own, following = at[order], own[order], following[order]
        suffixes[open_] = at
        rank[at] = open_[_firsts((own[1:] != own[:-1]) | (following[1:] != following[:-1]))]
        width *= 2
        levels.append((width, rank.astype(np.int32)))

    left, right = suffixes[:-1], suffixes[1:]
    shared = np.zeros(len(left), np.int64)
    inside = np.flatnonzero(group[1:] == group[:-1])
    left, right, common = left[inside], right[inside], shared[inside]
    for width, ranks in reversed(levels):
        common += np.where(ranks[left + common] == ranks[right + common], width, 0)
    for _ in range(gram - 1):
        common += codes[left + common] == codes[right + common]
    shared[inside] = common
    return suffixes, shared, group


def _can_seed(suffixes: np.ndarray, shared: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Edges of groups in which some positions are no farther apart than the longest prefix shared."""
    by_place = np.lexsort((suffixes, group))
    placed, owner = suffixes[by_place], group[by_place]
    gaps = np.where(owner[1:] == owner[:-1], placed[1:] - placed[:-1], np.iinfo(np.int64).max)
    nearest = np.full(len(suffixes), np.iinfo(np.int64).max)
    np.minimum.at(nearest, owner[1:], gaps)
    longest = np.zeros(len(suffixes), np.int64)
    np.maximum.at(longest, group[1:], np.where(group[1:] == group[:-1], shared, 0))
    return (nearest <= longest)[group[1:]]


def seeds(suffixes: np.ndarray, shared: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(p, d, l): positions p and p + d that become neighbours at weight l, where d <= l."""
    owner, members = {}, {}

    def find(x: int) -> int:
        while (up := owner.get(x, x)) != x:
            owner[x] = x = owner.get(up, up)
        return x

    for k, length in zip(edges.tolist(), shared[edges].tolist(), strict=True):
        a, b = find(k), find(k + 1)
        large = members.pop(a, None) or [int(suffixes[a])]
        small = members.pop(b, None) or [int(suffixes[b])]
        if len(large) < len(small):
            large, small, a, b = small, large, b, a
        owner[b] = a
        members[a] = large
        before = -1  # the one of the small set put in last
        for turn, p in enumerate(small):
            at = bisect_left(large, p)
            if at and large[at - 1] != before and p - large[at - 1] <= length:
                yield large[at - 1], p - large[at - 1], length
            if at < len(large):
                following = large[at]
                if following - p <= length and not (turn + 1 < len(small) and small[turn + 1] < following):
                    yield p, following - p, length
            large.insert(at, p)
            before = p


def runs_in(texts: list[list[str]], least: int = LEAST) -> list[list[Run]]:
    """Each text's runs, ordered by start, then period."""
    codes, starts = numbered(texts)
    gram = max(1, -(-least // 2))
    suffixes, shared, group = _sorted_suffixes(codes, gram)
    out: list[list[Run]] = [[] for _ in texts]
    if len(suffixes) < 2:
        return out
    edges = np.flatnonzero((shared >= gram) & _can_seed(suffixes, shared, group))
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    found = [
        (p, d + length, d)
        for p, d, length in seeds(suffixes, shared, edges)
        if d + length >= least and (not p or codes[p - 1] != codes[p + d - 1])
    ]
    if found:
        found.sort(key=lambda run: (run[0], run[2]))
        of_text = np.searchsorted(starts, [run[0] for run in found], side="right") - 1
        for text, (p, length, d) in zip(of_text.tolist(), found, strict=True):
            out[text].append((p - int(starts[text]), length, d))
    return out


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def periodic_runs(
    docs: DataFrame,
    least: int = LEAST,
    rewrite: Callable[[int | None, list[str]], list[str]] | None = None,
    with_text: bool = True,
) -> DataFrame:
    """``FOUND`` for each document: its runs, the text without their repetitions (NULL unless
    ``with_text``), and digests of both. ``rewrite`` may change a document's words beforehand."""

    def found(rows: list[tuple[int | None, list[str]]]) -> pa.RecordBatch:
        out = []
        for (doc_id, words), runs in zip(rows, runs_in([words for _, words in rows], least), strict=True):
            text = " ".join(collapsed(words, runs))
            told = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
            as_rows = [{"start": s, "length": n, "period": p} for s, n, p in runs]
            out.append((doc_id, len(words), as_rows, text if with_text else None, _digest(told), _digest(text)))
        names = ["doc_id", "n_words", "runs", "collapsed", "runs_sha256", "collapsed_sha256"]
        run = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        types = [pa.int64(), pa.int64(), run, pa.string(), pa.string(), pa.string()]
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def scan(batches):
        for rows in rows_of(batches, "doc_id", "text"):
            waiting, size = [], 0
            for doc_id, text in rows:
                words = words_of(text)
                waiting.append((doc_id, rewrite(doc_id, words) if rewrite else words))
                size += len(words)
                if size >= BATCH_WORDS:
                    yield found(waiting)
                    waiting, size = [], 0
            if waiting:
                yield found(waiting)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(scan, FOUND)
