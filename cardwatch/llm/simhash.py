"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits; bit ``i`` is set if it is set in over half the hashes of the text's word
shingles. Two fingerprints that differ in at most ``radius`` bits are linked, and documents reachable
over links are one component.

*Finding the links.* Each bit position gets a nonzero vector of ``radius + 1`` bits. For every nonzero
vector ``v`` there is a table; its mask keeps the positions whose vector has an odd inner product with
``v``. Any ``radius`` positions span less than the whole space, so some ``v`` is orthogonal to all of
them and its mask leaves them out: a pair within the radius meets in some table, without exception.

*Bounding the cells.* Only distinct fingerprints take part; a text's copies share one. A cell of a
table with more than ``CELL`` of them is cut again by masks over the bits that its mask left out, where
the same argument holds; the kept bits then leave so few open that a cell is bounded by construction.
A cell is compared in blocks and reports, for each member, the smallest fingerprint it reaches within
the cell: one row per member, not one per pair.

*Components* come from alternating large-star and small-star rounds over such links.

Edge cases: a NULL text is an empty text; a text without words has fingerprint zero and is linked like
any other; a text with fewer words than a shingle has its whole word sequence as its one shingle;
repeated rows come back as often as they came; rows with a NULL doc_id take part and cannot name a
component (``component_id`` is NULL if no member has an id); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import lower_ascii, rows_of, written

BITS = 64
SEED = 42
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Distinct fingerprints of one cell up to which it is not cut again.
CELL = 2048
#: Hashes counted at a time, which bounds the memory for very long texts.
CHUNK = 65_536


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included."""
    found = WORD.findall(lower_ascii(text or ""))
    if not found:
        return np.empty(0, "<u8")
    shingles = map(" ".join, zip(*(found[k:] for k in range(min(words, len(found))))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(shingle, SEED) for shingle in shingles), "<u8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint as an unsigned integer."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = ones * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long, one row per document."""

    def compute(batches):
        for rows in rows_of(batches, "doc_id", "text"):
            prints = np.fromiter((fingerprint(text, words) for _, text in rows), "<u8", len(rows))
            ids = pa.array([doc_id for doc_id, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view("<i8"))], names=["doc_id", "print"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(compute, "doc_id long, print long")


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """One mask per table: any ``radius`` of the positions are left out together by some mask."""
    vectors = range(1, 1 << (radius + 1))
    given = {position: vectors[k % len(vectors)] for k, position in enumerate(positions)}
    return [
        sum(1 << position for position, vector in given.items() if (vector & v).bit_count() % 2) for v in vectors
    ]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _cells(prints: DataFrame, masks: list[Column], name: str) -> DataFrame:
    """One row per fingerprint and mask, with the masked value as the cell's key."""
    tables = F.array(*[F.struct(F.lit(k).alias("table"), mask.alias("mask")) for k, mask in enumerate(masks)])
    return prints.select("*", F.posexplode(tables).alias(f"{name}_at", "_t")).select(
        *prints.columns,
        F.col("_t.table").alias(name),
        F.col("print").bitwiseAND(F.col("_t.mask")).alias(f"{name}_key"),
    )


def links(prints: DataFrame, radius: int = 3, cell: int = CELL) -> DataFrame:
    """(print, least): members of a cell and the smallest member they reach within it.

    ``prints`` holds distinct fingerprints. The links' closure is the closure of all pairs within the
    radius.
    """
    masks = covering_masks(list(range(BITS)), radius)
    first = _cells(prints.select("print"), [F.lit(_signed(mask)) for mask in masks], "outer")
    keys = ["outer", "outer_key"]
    sizes = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = first.join(sizes, keys)
    whole = shared.filter(F.col("members") <= cell).select(
        *keys, F.lit(0).alias("inner"), F.lit(0).cast("long").alias("inner_key"), "print"
    )
    # What the outer mask left out is cut by masks of its own; which ones depends on the outer table.
    inner = [covering_masks([p for p in range(BITS) if not mask >> p & 1], radius) for mask in masks]
    of_table = F.array(*[F.array(*[F.lit(_signed(mask)) for mask in own]) for own in inner])
    crowded = shared.filter(F.col("members") > cell).select(*keys, "print")
    cut = crowded.select("*", F.posexplode(F.element_at(of_table, F.col("outer") + 1)).alias("inner", "mask"))
    split = cut.select(*keys, "inner", F.col("print").bitwiseAND(F.col("mask")).alias("inner_key"), "print")
    cells = whole.unionByName(split)
    all_keys = [*keys, "inner", "inner_key"]
    # A whole cell keeps to (outer, outer_key) anyway; the inner key spreads the crowded ones.
    ordered = cells.repartition(*all_keys).sortWithinPartitions(*all_keys, "print")
    return ordered.mapInArrow(lambda batches: _linked(batches, all_keys, radius), "print long, least long")


def _linked(batches, keys: list[str], radius: int):
    """Rows come ordered by cell; the last cell of a batch waits for the next batch."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for name in [*keys, "print"]]
        if not len(columns[0]):
            continue
        if kept is not None:
            columns = [np.concatenate(pair) for pair in zip(kept, columns, strict=True)]
        changes = np.any([column[1:] != column[:-1] for column in columns[:-1]], axis=0)
        borders = np.flatnonzero(changes) + 1
        last = int(borders[-1]) if len(borders) else 0
        kept = [column[last:] for column in columns]
        if last:
            yield _cell_links(columns[-1][:last], borders[:-1], radius)
    if kept is not None:
        yield _cell_links(kept[-1], np.empty(0, np.int64), radius)


def _cell_links(prints: np.ndarray, borders: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links of consecutive cells; a cell's fingerprints are in ascending order."""
    bits = prints.astype("<i8").view("<u8")
    starts = np.concatenate([[0], borders]).astype(np.int64)
    ends = np.concatenate([borders, [len(bits)]]).astype(np.int64)
    sizes = ends - starts
    label = np.arange(len(bits))
    small = np.repeat(sizes <= 16, sizes)
    room = np.repeat(ends, sizes) - np.arange(len(bits)) - 1  # members of the same cell that follow
    pairs = []
    for lag in range(1, 16):
        at = np.flatnonzero(small & (room >= lag))
        if not len(at):
            break
        at = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= radius]
        pairs.append((at, at + lag))
    if pairs:
        _settle(label, np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))
    for start, end in zip(starts[sizes > 16].tolist(), ends[sizes > 16].tolist(), strict=True):
        own, names = bits[start:end], np.arange(end - start)
        for at in range(0, len(own), 256):  # a block of rows against the whole cell
            near = np.bitwise_count(own[at : at + 256, None] ^ own[None, :]) <= radius
            a, b = np.nonzero(near)
            _settle(names, a + at, b)
        label[start:end] = names + start
    moved = np.flatnonzero(label != np.arange(len(bits)))
    return pa.RecordBatch.from_arrays(
        [pa.array(prints[moved].astype(np.int64)), pa.array(prints[label[moved]].astype(np.int64))],
        names=["print", "least"],
    )


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower the labels of linked members, in place, until both ends of each link agree."""
    while True:
        ends = np.minimum(label[a], label[b])
        if np.array_equal(ends, label[a]) and np.array_equal(ends, label[b]):
            return
        # The labels' own labels move as well, so that everything hanging on them follows.
        for side in (label[a], label[b], a, b):
            np.minimum.at(label, side, ends)
        while not np.array_equal(label, label[label]):
            label[:] = label[label]


def least_reachable(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b); only nodes that have one.

    Each round hangs every node's larger neighbours on its smallest neighbour (large star), then the
    node and its other smaller neighbours (small star). Each round's links are written, and the rounds
    end when one changes nothing, which is told by a count and two sums over the links.
    """
    current = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    before = None
    while True:
        mark = current.select(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        ).first()
        if tuple(mark) == before or not mark[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(mark)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(nearest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ordered = large.filter("a <> b").distinct()
        lowest = ordered.groupBy("a").agg(F.min("b").alias("low"))
        small = ordered.join(lowest, "a")
        hung = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
        current = written(hung.select("e.a", "e.b").filter("a <> b").distinct(), "links")


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, print (signed long) and component_id, one row per document."""
    prints = written(fingerprints(docs, words), "prints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("smallest"))
    edges = links(prints.select("print").distinct(), radius)
    roots = least_reachable(edges.select(F.col("print").alias("a"), F.col("least").alias("b")))
    rooted = classes.join(roots, classes["print"] == roots["node"], "left").select(
        "print", "smallest", F.coalesce("root", "print").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    of_print = rooted.join(named, "root").select("print", "component_id")
    return prints.join(of_print, "print").select("doc_id", "print", "component_id")


def near_duplicates_removed(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The documents without all but the smallest doc_id of each component.

    Rows without a doc_id cannot be told apart by it and stay; of repeated rows of the kept id one stays.
    """
    groups = simhash_groups(docs.filter(F.col("doc_id").isNotNull()), words, radius)
    dropped = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    # The same join at every size; rows then lie by doc_id, which the next step needs anyway.
    named = docs.filter(F.col("doc_id").isNotNull()).join(dropped.hint("shuffle_hash"), "doc_id", "left_anti")
    return named.dropDuplicates(["doc_id"]).select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
