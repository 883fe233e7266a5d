"""Token ids of whole texts from the ids of their words, which come again and again.

A vocabulary whose pre-tokenizer never joins text across white space gives a text the ids of its
words, one after the other. So each Python worker keeps the ids of words it has seen. That property is read from the tokenizer file; without it, whole texts are
encoded.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Python's split also cuts at the first four, its lower() looks at the context of a sigma and makes
#: two characters of a dotted I. The last is this module's own separator. Such texts are encoded whole.
UNSAFE = re.compile("[\x1c-\x1fΣİ\x01]")
SEPARATOR = "\x01"
#: A single one of these after letters is a token of its own.
MARKS = ",."
#: Words kept per worker, about 50 MB; a full store is emptied.
KEPT_WORDS = 250_000
#: Characters of texts that are looked up together.
TOGETHER = 20_000
#: New words that are encoded in one call; the tokenizer is slower on longer texts.
JOINED = 160


class WordTokenizer:
    _shared: dict[str, WordTokenizer] = {}

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        with open(file, encoding="utf-8") as f:
            described = f.read()
        self.whole = Tokenizer.from_str(described)
        self.whole.encode_special_tokens = True
        self.by_word = goes_by_word(json.loads(described))
        self.letters = LetterPieces.of(json.loads(described)) if self.by_word else None
        separator = self._ids(SEPARATOR) if self.by_word else []
        self.by_word = len(separator) == 1
        self.separator = separator[0] if self.by_word else -1
        self.marks = {"": []} | {mark: self._ids(mark) for mark in MARKS}
        self.known: dict[str, bytes] = {}

    @classmethod
    def shared(cls, file: str) -> WordTokenizer:
        """One per worker process and file."""
        if file not in cls._shared:
            cls._shared[file] = cls(file)
        return cls._shared[file]

    def _ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text in turn. New words of some texts together are encoded at once."""
        waiting: list[list[str] | bytes] = []
        size = 0
        for text in texts:
            lowered = unicodedata.normalize("NFC", text).lower()
            if not self.by_word or UNSAFE.search(text) or not unicodedata.is_normalized("NFC", lowered):
                waiting.append(np.asarray(self._ids(text), "<u4").tobytes())
            else:
                waiting.append(lowered.split())
            size += len(text)
            if size >= TOGETHER:
                yield from self._looked_up(waiting)
                waiting, size = [], 0
        yield from self._looked_up(waiting)

    def _looked_up(self, waiting: list[list[str] | bytes]) -> Iterator[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        found = [list(map(self.known.get, words)) if isinstance(words, list) else None for words in waiting]
        new: set[str] = set()
        for words, ids in zip(waiting, found, strict=True):
            if ids and None in ids:
                new.update([word for word, own in zip(words, ids, strict=True) if own is None])
        self._learn(list(new))
        for words, ids in zip(waiting, found, strict=True):
            if ids is None:
                yield words
            elif None in ids:
                yield b"".join(map(self.known.__getitem__, words))
            else:
                yield b"".join(ids)

    def _learn(self, words: list[str]) -> None:
        if self.letters:
            left = []
            for word in words:
                stem = word[:-1] if word[-1] in MARKS else word
                ids = self.letters.encode(stem) if stem.isalpha() else None
                if ids is None:
                    left.append(word)
                else:
                    self.known[word] = array("I", ids + self.marks[word[len(stem) :]]).tobytes()
            words = left
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            joined = f" {SEPARATOR} ".join(some)
            ids = np.asarray(self.whole.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.separator)
            coded, starts = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()]
            for word, start, end in zip(some, starts, [*(4 * ends).tolist(), len(coded)], strict=True):
                self.known[word] = coded[start:end]


class LetterPieces:
    """Words of letters alone, which the pre-tokenizer leaves whole, by rank-based pair merging.

    A byte that no UTF-8 text has stands for the mark of a word's end. Merging by ranks takes the pair
    whose union is the token of the lowest rank; the vocabulary's rules allow one pair for each token.
    Both agree on a word if no token of the result was, inside, merged from another pair, which is
    looked up once per token. Otherwise ``encode`` gives None and the word goes to the tokenizer itself.
    """

    END = b"\xff"

    def __init__(self, ranks: dict[bytes, int], pairs: dict[bytes, tuple[bytes, bytes]]):
        self.ranks, self.pairs = ranks, pairs
        self.token = {rank: token for token, rank in ranks.items()}
        self.merge = tiktoken.Encoding("letters", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.by_rule: dict[int, bool] = {}

    @classmethod
    def of(cls, described: dict) -> LetterPieces | None:
        """None for a vocabulary whose ranks are not in the order of its rules."""
        model, suffix = described["model"], described["model"].get("end_of_word_suffix")
        if model.get("type") != "BPE" or not suffix or model.get("ignore_merges"):
            return None
        special = {token["content"] for token in described.get("added_tokens", ())}
        byte_of = {char: byte for byte, char in byte_characters().items()}

        def plain(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(byte_of[c] for c in (token.removesuffix(suffix) if ends else token)) + cls.END * ends

        ranks = {plain(token): rank for token, rank in model["vocab"].items() if token not in special}
        rules = [tuple(rule) if isinstance(rule, list) else tuple(rule.split(" ")) for rule in model["merges"]]
        pairs = {plain(a) + plain(b): (plain(a), plain(b)) for a, b in rules}
        in_order = [ranks[union] for union in pairs]
        if len(pairs) != len(rules) or in_order != sorted(in_order):
            return None
        # A word's last byte and its end are one symbol from the start.
        ends = {bytes([b]) + cls.END: (bytes([b]), cls.END) for b in range(256) if bytes([b]) + cls.END in ranks}
        if len(ends) < 256 or max(ranks[e] for e in ends) > min(in_order):
            return None
        return cls(ranks, pairs | ends)

    def encode(self, word: str) -> list[int] | None:
        ids = self.merge.encode_single_piece(word.encode() + self.END)
        by_rule = self.by_rule
        for rank in ids:
            if rank not in by_rule:
                by_rule[rank] = self._made_by_rule(self.token[rank])
            if not by_rule[rank]:
                return None
        return ids

    def _made_by_rule(self, token: bytes) -> bool:
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda k: self.ranks.get(parts[k] + parts[k + 1], len(self.ranks)))
            if self.pairs.get(parts[at] + parts[at + 1]) != (parts[at], parts[at + 1]):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def goes_by_word(described: dict) -> bool:
    """Whether texts are lower-cased and then cut into letters, digits and marks without white space."""
    before = described.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    first = steps[0] if steps else {}
    only_matches = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    pattern = first.get("pattern", {}).get("Regex", "")
    normal = described.get("normalizer") or {}
    lowers = any(step.get("type") == "Lowercase" for step in normal.get("normalizers", [normal]))
    return only_matches and lowers and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
