"""Language-model scoring by cross-entropy difference.

Two bigram models over the corpus' own words, of the same smoothing, are counted: one over the target
documents, those labelled as good, and one over all documents. A document's score is its loss per token
under the target model minus its loss per token under the background model: the lower, the more it reads
like the target.

Tokens are lower-cased words, signs, the single characters of scripts that set no spaces, and a
boundary before and behind each text, of which the second is predicted too. Every word and pair of words
that occurs is counted, over every document; nothing is left out or capped, so the models grow with the
corpus and no task and no driver holds one.

* Documents are dealt at random into blocks of bounded size, so neither an id, a source nor a group of
  copies makes a block large. A block counts its n-grams once, whatever number of documents they stand in.
* Counts meet by ranges of n-grams, as many as there are blocks, so a range is as large as a block. A block
  sends one row for each range, with its n-grams there in order and how often each stands; the sums come
  back in the same order, without the n-grams.
* A block scores its documents with these sums. Only ids are joined with the labels, not texts.

N-grams are known by 64 bits of a hash; two that share one would share their counts.

Smoothing: pairs are interpolated with words, and words with a model of spelling that gives each
character the chance ``1 / ALPHABET``; both models share it, so no word is outside the vocabulary. The
weight of the lower order is ``PRIOR`` observations.

Edge cases: a NULL text is an empty text; a text without tokens is not counted and has losses and a
score of 0; without any target document its model is the spelling model; several of one doc_id count as
good if any is; NULL labels and ids are none; repeated rows are counted and scored each; a single very
long text is a block of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import rows_of

PRIOR = 20.0
ALPHABET = 64.0
#: Characters beyond this number add nothing more to what a word costs in the spelling model.
LONGEST = 100
#: Characters and rows of a block, about.
BLOCK_CHARS, BLOCK_ROWS = 8 << 20, 50_000
#: Characters cut into tokens at once, which bounds the memory for very long texts.
CHUNK = 1 << 20

#: Thai to Tibetan, Burmese, Khmer, and the Chinese and Japanese scripts.
UNSPACED = "฀-࿿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+|[^\w\s]")
BETWEEN = re.compile(rf"[\W{UNSPACED}]")

#: Numbers that stand for the boundary and for the count of all tokens.
BOUNDARY, TOTAL = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
COUNTS = "block long, span long, grams binary, n binary, n_good binary, length long"
SUMS = "block long, span long, n binary, n_good binary"


def tokens(text: str):
    """The tokens of a text, a list for each stretch; no token is cut."""
    start = 0
    while start < len(text):
        stop = BETWEEN.search(text, start + CHUNK)
        stop = stop.start() if stop else len(text)
        yield TOKEN.findall(text[start:stop].lower())
        start = stop


class Block:
    """The tokens of some documents as pairs of local word numbers, and the n-grams they make.

    ``grams`` has the total first, then the words, then the pairs.
    """

    def __init__(self, batches):
        number, lengths, before, after = {"": 0}, [], [], []
        for rows in rows_of(batches, "text"):
            for (text,) in rows:
                found = [
                    np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, len(words))
                    for words in tokens(text or "")
                ]
                n = sum(map(len, found))
                lengths.append(n + 1 if n else 0)
                if n:
                    before += [[0], *found]
                    after += [*found, [0]]
        empty = [np.zeros(0, np.int64)]
        self.before, self.after = (np.concatenate(empty + part).astype(np.int64) for part in (before, after))
        self.lengths = np.array(lengths, np.int64)
        self.doc = np.repeat(np.arange(len(lengths)), self.lengths)
        words = list(number)
        self.width = np.array([min(len(word), LONGEST) for word in words])
        hashes = [BOUNDARY, *(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words[1:])]
        hashes = np.array(hashes, np.uint64)
        pairs, self.pair = np.unique(self.before * len(words) + self.after, return_inverse=True)
        self.first, self.second = pairs // len(words), pairs % len(words)
        mixed = (hashes[self.first] * np.uint64(0xBF58476D1CE4E5B9)) ^ (hashes[self.second] + np.uint64(TOTAL))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        self.grams = np.concatenate([np.array([TOTAL], np.uint64), hashes, mixed ^ (mixed >> np.uint64(29))]).view(np.int64)

    def counts(self, good: np.ndarray | None = None) -> np.ndarray:
        """How often each n-gram stands in the documents, or in the good ones."""
        weights = None if good is None else good[self.doc].astype(np.float64)
        total = len(self.doc) if weights is None else weights.sum()
        words = np.bincount(self.after, weights, len(self.width))
        pairs = np.bincount(self.pair, weights, len(self.first))
        return np.concatenate([[total], words, pairs]).astype(np.int64)

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """The negative log-likelihood of each document."""
        words, pairs = counts[1 : 1 + len(self.width)], counts[1 + len(self.width) :]
        chance = (words + PRIOR * ALPHABET ** -(self.width + 1.0)) / (counts[0] + PRIOR)
        chance = (pairs + PRIOR * chance[self.second]) / (words[self.first] + PRIOR)
        return np.bincount(self.doc, -np.log(chance)[self.pair], len(self.lengths))


def good_rows(docs: pa.Table, ids: pa.ChunkedArray) -> np.ndarray:
    return pc.is_in(docs["doc_id"], value_set=pc.drop_null(ids.combine_chunks())).to_numpy(zero_copy_only=False)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes: their low bytes first, then the next ones, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, length: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * length, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, length).T).view("<u8").reshape(-1)


def _spans(block: Block, spans: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the block's n-grams, and the places in it where each range of them begins and ends."""
    grams = block.grams.view(np.uint64)
    order = np.argsort(grams)
    starts = np.array([(k << 64) // spans for k in range(1, spans)], np.uint64)
    return order, np.concatenate([[0], np.searchsorted(grams[order], starts), [len(grams)]])


def count_block(docs: pa.Table, good: pa.Table, spans: int) -> pa.Table:
    """A row for each range that the block has n-grams in. ``grams`` are steps from one to the next."""
    block = Block(docs.to_batches())
    order, ends = _spans(block, spans)
    grams = block.grams.view(np.uint64)[order]
    n, n_good = block.counts()[order], block.counts(good_rows(docs, good["good"]))[order]
    own = np.flatnonzero(np.diff(ends))
    parts = [slice(ends[k], ends[k + 1]) for k in own]
    return pa.table(
        {
            "block": np.full(len(own), docs["block"][0].as_py()),
            "span": own,
            "grams": pa.array([packed(np.diff(grams[part], prepend=np.uint64(0))) for part in parts], pa.binary()),
            "n": pa.array([packed(n[part]) for part in parts], pa.binary()),
            "n_good": pa.array([packed(n_good[part]) for part in parts], pa.binary()),
            "length": np.diff(ends)[own],
        }
    )


def sum_span(counted: pa.Table) -> pa.Table:
    """The counts of a range, each replaced by the sum over all blocks."""
    lengths = counted["length"].to_pylist()
    grams = np.concatenate([np.cumsum(unpacked(d, k), dtype=np.uint64) for d, k in zip(counted["grams"].to_pylist(), lengths, strict=True)])
    _, at = np.unique(grams, return_inverse=True)
    del grams
    sums = []
    for name in ("n", "n_good"):
        own = np.concatenate([unpacked(d, k) for d, k in zip(counted[name].to_pylist(), lengths, strict=True)])
        # Counts are exact as floating-point numbers up to 2 ** 53.
        total = np.bincount(at, own.astype(np.float64)).astype(np.uint64)[at]
        sums.append(pa.array([packed(part) for part in np.split(total, np.cumsum(lengths)[:-1])], pa.binary()))
    return pa.table({"block": counted["block"], "span": counted["span"], "n": sums[0], "n_good": sums[1]})


def score_block(docs: pa.Table, found: pa.Table, spans: int) -> pa.Table:
    """``found`` has the sums of the block's ranges."""
    block = Block(docs.to_batches())
    order, ends = _spans(block, spans)
    background, target = (np.zeros(len(block.grams), np.int64) for _ in range(2))
    for row in found.select(["span", "n", "n_good"]).to_pylist():
        part = order[ends[row["span"]] : ends[row["span"] + 1]]
        background[part], target[part] = (unpacked(row[name], len(part)) for name in ("n", "n_good"))
    n = np.maximum(block.lengths, 1)
    losses = block.losses(target), block.losses(background)
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "tokens": block.lengths,
            "loss_target": losses[0] / n,
            "loss_background": losses[1] / n,
            "score": (losses[0] - losses[1]) / n,
        }
    )


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tokens, loss_target, loss_background and score (per token) of every row.

    ``docs`` is read more than once and must come in the same order each time, as a table does; write the
    result of a shuffle first.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = texts.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("rows")).first()
    blocks = 1 + (size["chars"] or 0) // BLOCK_CHARS + size["rows"] // BLOCK_ROWS
    dealt = texts.withColumn("block", F.floor(F.rand(5) * blocks).cast("long"))
    good = labels.filter("doc_id IS NOT NULL AND quality > 0").select(F.col("doc_id").cast("long").alias("good")).distinct()
    ids = dealt.select(F.col("block").alias("place"), F.col("doc_id").alias("good")).distinct()
    good = ids.join(good, "good", "left_semi").select("place", "good")
    by_block = dealt.groupBy("block")
    counted = by_block.cogroup(good.groupBy("place")).applyInArrow(lambda d, g: count_block(d, g, blocks), COUNTS)
    sums = counted.groupBy("span").applyInArrow(sum_span, SUMS)
    return by_block.cogroup(sums.groupBy("block")).applyInArrow(
        lambda d, f: score_block(d, f, blocks),
        "doc_id long, tokens long, loss_target double, loss_background double, score double",
    )
