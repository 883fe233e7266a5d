"""Noisy-channel deobfuscation: what a disguised word was, under a character language model.

A suspicious stretch of text becomes a lattice. Each position offers what may have been meant: a digit
or sign may stand for letters, a run of one letter for one or two of it, single characters with
separators for a word. A Viterbi search finds the cheapest path, disguise costs plus the negative
log-likelihood of the letters under a trigram model of the corpus.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import rows_of

#: Letters that digits and signs stand for.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "€": "e",
    "£": "l",
}
SIGNS = "".join(re.escape(sign) for sign in LEET)

#: Costs of a disguise, in nats: a sign for a letter, a letter left out of or kept in a run, a word's end.
SIGN_COST, RUN_COST, PAIR_COST, BREAK_COST = 0.5, 0.3, 2.0, 1.0

#: Symbols of the language model: 0 for anything between words, a to z, and one for other letters.
SYMBOLS, OTHER = 28, 27

#: Cyrillic letters that look like Latin ones.
LOOKALIKES = {
    "а": "a",
    "е": "e",
    "о": "o",
    "р": "p",
    "с": "c",
    "у": "y",
    "х": "x",
    "і": "i",
    "ј": "j",
    "ѕ": "s",
    "ԁ": "d",
}

#: Soft hyphen, zero-width characters and combining marks that normalization left alone.
HIDDEN = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u2060\ufeff]")
LETTERS = re.compile(f"[a-z{''.join(LOOKALIKES)}]+")
WORD = re.compile(r"[^\W\d_]+")
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{SIGNS}])(?:[ .\-_*·/~]{{1,3}}(?:[^\W_]|[{SIGNS}])){{3,}}(?![^\W_])")
WIDE_SPACE = re.compile(r"\s{2,}")
HAS_SIGN = re.compile(f"[{SIGNS}]+")
PART = re.compile(rf"(?:[^\W_]|[{SIGNS}])+")
SEPARATORS = re.compile(r"[ .\-_*·/~]+")
INNER = re.compile(r"(?<=[^\W\d_])[.\-_*·~]+(?=[^\W\d_])")
RUN = re.compile(r"(.)\1*", re.DOTALL)

_TO_LATIN = str.maketrans(LOOKALIKES)
_CLASS = np.zeros(128, np.int64)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
#: Characters looked at together, which bounds the memory for very long texts.
CHUNK = 1 << 20


def symbol(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    return OTHER if char.isalpha() else 0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def trigram_counts(text: str) -> np.ndarray:
    """Counts over (before last, last, next) of the symbols, as one flat array. Beyond ASCII all is letters."""
    codes = _codes(f" {text} ")
    total = np.zeros(SYMBOLS**3, np.int64)
    for start in range(0, len(codes) - 2, CHUNK):
        part = codes[start : start + CHUNK + 2]
        kinds = np.where(part < 128, _CLASS[np.minimum(part, 127)], OTHER)
        total += np.bincount(kinds[:-2] * SYMBOLS**2 + kinds[1:-1] * SYMBOLS + kinds[2:], minlength=len(total))
    return total


def corpus_trigrams(docs: DataFrame) -> np.ndarray:
    """The counts over all texts: at most ``SYMBOLS ** 3`` numbers come to the driver."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for rows in rows_of(batches, "text"):
            for (text,) in rows:
                if text:
                    total += trigram_counts(text)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["k", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "k long, n long")
    total = np.zeros(SYMBOLS**3)
    for k, n in counted.groupBy("k").agg(F.sum("n")).collect():
        total[k] = n
    return total


class Restorer:
    """Restores the disguised words of a text under the corpus' trigrams."""

    def __init__(self, trigrams: np.ndarray, weight: float = 5.0):
        cube = trigrams.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        single = (cube.sum((0, 1)) + 1.0) / (cube.sum() + SYMBOLS)
        pair = cube.sum(0)
        pair = (pair + weight * single) / (pair.sum(-1, keepdims=True) + weight)
        triple = (cube + weight * pair[None]) / (cube.sum(-1, keepdims=True) + weight)
        self.cost = (-np.log(triple)).tolist()

    def words(self, text: str) -> set[str]:
        """The text's words as they stand, and those that disguised stretches decode to."""
        text = bare(text)
        found = set(WORD.findall(text))
        for stretch, spaced in suspicious(text):
            found.update(WORD.findall(self.decode(stretch)))
            if spaced:
                found.update(WORD.findall(self.decode(stretch, breaks=True)))
        return found

    def decode(self, stretch: str, breaks: bool = False) -> str:
        """The likeliest plain form, as one word or, with ``breaks``, as several."""
        paths = {(0, 0): (0.0, None)}
        for options in lattice(stretch):
            reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            if breaks:
                paths = self._with_breaks(paths)
            for (a, b), (spent, path) in paths.items():
                for letters, cost in options:
                    x, y, total, way = a, b, spent + cost, path
                    for letter in letters:
                        z = symbol(letter)
                        total += self.cost[x][y][z]
                        x, y, way = y, z, (way, letter)
                    if (x, y) not in reached or total < reached[x, y][0]:
                        reached[x, y] = (total, way)
            paths = reached
        _, best = min(((spent + self.cost[a][b][0], way) for (a, b), (spent, way) in paths.items()), key=lambda p: p[0])
        letters = []
        while best is not None:
            best, letter = best
            letters.append(letter)
        return "".join(reversed(letters))

    def _with_breaks(self, paths: dict) -> dict:
        broken = dict(paths)
        for (a, b), (spent, path) in paths.items():
            total = spent + self.cost[a][b][0] + BREAK_COST
            if b and total < broken.get((b, 0), (np.inf,))[0]:
                broken[b, 0] = (total, (path, " "))
        return broken


def bare(text: str) -> str:
    """Lower-cased, without hidden characters, wide or styled forms, and Cyrillic letters in Latin words."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text).lower()
    if HIDDEN.search(text):
        text = HIDDEN.sub("", text)
    if any(letter in text for letter in LOOKALIKES):
        text = LETTERS.sub(lambda m: _latin(m[0]), text)
    return text


def _latin(letters: str) -> str:
    mixed = not letters.isascii() and any("a" <= letter <= "z" for letter in letters)
    return letters.translate(_TO_LATIN) if mixed else letters


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, what it may stand for and at what cost."""
    positions = []
    for run in RUN.finditer(SEPARATORS.sub("", stretch)):
        char, times = run[1], len(run[0])
        meant = LEET.get(char)
        if meant is None:
            once, twice = (0.0, None) if times == 1 else (PAIR_COST, 0.0) if times == 2 else (RUN_COST, RUN_COST)
            options = [(char, once)] if twice is None else [(char, once), (char * 2, twice)]
        else:
            options = [(letter, SIGN_COST + RUN_COST * (times > 1)) for letter in meant]
            if times > 1:
                options += [(letter * 2, 2 * SIGN_COST) for letter in meant]
        positions.append(options)
    return positions


def suspicious(text: str) -> list[tuple[str, bool]]:
    """Stretches of a lower-cased text that may be disguised words, and whether they are spaced out."""
    spaced = [word for m in SPACED.finditer(text) for word in WIDE_SPACE.split(m[0])]
    found = [(word, True) for word in spaced if any(c.isalpha() for c in word)]
    last = -1
    for m in INNER.finditer(text):
        if m.start() < last:
            continue
        # Letters with a separator among them; what stands on both sides is taken as one word.
        start, last = _token(text, m.start())
        joined = SEPARATORS.sub("", text[start:last])
        found.extend((word, False) for word in WORD.findall(joined))
    last = -1
    for m in HAS_SIGN.finditer(text):
        if m.start() < last:
            continue
        start, last = _token(text, m.start())
        for part in PART.findall(text, start, last):
            part = part.rstrip("!$+|")
            if sum(c.isalpha() for c in part) >= 2 and HAS_SIGN.search(part):
                found.append((part, False))
    # Tokens with a sign anew: their words are decoded without it as well, as it may be mere punctuation.
    last = -1
    for at in _long_runs(text):
        if at >= last:
            start, last = _token(text, at)
            found.extend((word, False) for word in WORD.findall(text, start, last))
    return found


def _token(text: str, at: int) -> tuple[int, int]:
    """The borders of the stretch without white space around a position."""
    start, end = at, at
    while start and not text[start - 1].isspace():
        start -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return start, end


def _long_runs(text: str) -> list[int]:
    """Where a letter stands three times in a row, or three letters stand twice each."""
    places = []
    for start in range(0, len(text), CHUNK):
        codes = _codes(text[start : start + CHUNK + 5])
        same = codes[:-1] == codes[1:]
        thrice, pairs = same[:-1] & same[1:], same[:-4] & same[2:-2] & same[4:]
        at = np.union1d(np.flatnonzero(thrice), np.flatnonzero(pairs))
        places += [start + int(k) for k in at if text[start + int(k)].isalpha()]
    return places
