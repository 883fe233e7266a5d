"""One document of each group of near duplicates: SimHash under covering masks, verified by Jaccard.

Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are near duplicates.
A fingerprint of such shingles changes in ten bits of 64 at that similarity, beyond any radius that
covering masks can be afforded for over a whole corpus. So the fingerprint is one of single words, each
with the square root of its count: frequent words then neither make unlike texts alike nor hide what
differs. Candidates are

* the pairs within ``RADIUS`` bits of each other. Covering masks for that radius (see
  :mod:`cardwatch.llm.simhash`) are laid over all texts, so every such pair meets under some mask;
* beyond that radius, the pairs that share one of ``TABLES`` min-hashes of their shingles and are within
  ``WIDE`` bits: a pair of similarity 0.8 shares none with a chance of 0.0016.

A candidate pair is linked if the Jaccard similarity of its shingle sets is at least the threshold. It is
exact for texts of up to ``SKETCH`` different shingles, and estimated from the ``SKETCH`` smallest hashes for
longer ones (standard error 0.025 at 0.8).

Cells are met twice, first by fingerprints alone. Only texts that have a candidate there bring their
sketches. A pair is a candidate under the first mask that it meets under. The first ``FIRST`` masks go ahead,
and texts that they linked are not compared again, so a group of near copies does not bring its sketches
under every mask. Cells of more than ``CELL`` texts are compared in pieces of about that size, each with
each.

Decisions are made for rows. Equal texts are one class; of each component of classes one row stays: of
the smallest doc_id, NULL last; of several rows with that doc_id, that of the smallest text digest.

Edge cases: texts without words (NULL and empty ones too) are one group; texts of fewer words than a
shingle have their whole word sequence as its only one; of repeated rows one stays; different texts under
one doc_id are judged each for itself; rows without a doc_id are judged as others; an empty table gives no
rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import lower_ascii, rows_of, written
from cardwatch.llm.simhash import BITS, SEED, WORD, _signed, covering_masks, least_reachable

WORDS, THRESHOLD = 5, 0.8
TABLES, RADIUS, SKETCH = 4, 5, 256
#: Bits within which texts of equal min-hashes are candidates.
WIDE = 16
#: Masks that go ahead of the others.
FIRST = 8
#: Texts of a cell up to which it is compared whole, and of a piece of a larger one.
CELL = 16_384
#: Odd factors that make other orders of the hashes, one for each table.
FACTORS = np.array([2 * xxhash.xxh64_intdigest(b"%d" % k, SEED) + 1 & (2**64 - 1) for k in range(TABLES)], np.uint64)
SKETCHES = "doc_id long, digest string, print long, mins array<long>, sketch array<int>"


def sketch(text: str | None, words: int = WORDS) -> tuple[int, list[int], list[int]]:
    """The SimHash of the single words by the roots of their counts, the min-hashes, and the smallest hashes,
    of the shingles."""
    found = WORD.findall(lower_ascii(text or ""))
    if not found:
        return 0, [0] * TABLES, []
    digest = xxhash.xxh64_intdigest
    counts = Counter(found)
    bits = np.fromiter((digest(word, SEED) for word in counts), "<u8", len(counts)).view(np.uint8).reshape(-1, 8)
    weights = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    ones = weights @ np.unpackbits(bits, axis=1, bitorder="little")
    name = int(np.packbits(ones * 2 > weights.sum(), bitorder="little").view("<i8")[0])
    shingles = {" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))}
    hashes = np.fromiter((digest(shingle, SEED) for shingle in shingles), np.uint64, len(shingles))
    mins = [int((hashes * factor).min().astype(np.int64)) for factor in FACTORS]
    # The upper halves keep the order and are distinct enough for a set of this size.
    small = (np.unique(hashes)[:SKETCH] >> np.uint64(32)).astype(np.int64) - 2**31
    return name, mins, small.tolist()


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sketches; of two empty ones 1."""
    union = np.union1d(a, b)
    if len(a) >= SKETCH or len(b) >= SKETCH:
        union = union[:SKETCH]
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``SKETCHES``, one row per document."""

    def compute(batches):
        for rows in rows_of(batches, "doc_id", "digest", "text"):
            made = [(doc_id, digest, *sketch(text, words)) for doc_id, digest, text in rows]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "print", "mins", "sketch"])

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long"), _digest().alias("digest"), text.alias("text"))
    return narrow.mapInArrow(compute, SKETCHES)


def _digest():
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


KEYS = ["table", "value", "low", "high"]
MET = "table int, value long, low int, high int, node long, print long, root long, members long"


def verified_links(classes: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, cell: int | None = None) -> DataFrame:
    """(node, least): texts and others that they are linked to; their closure is that of all linked pairs."""
    cell = cell or CELL
    masks = covering_masks(list(range(BITS)), radius)
    fixed = F.array(*[F.lit(_signed(mask)) for mask in masks])
    under = F.posexplode(F.slice(fixed, 1, FIRST)).alias("table", "mask")
    ahead = classes.select("node", "print", F.col("node").alias("root"), under)
    ahead = ahead.select("*", F.col("print").bitwiseAND(F.col("mask")).alias("value"))
    found = written(_verified(ahead, classes, masks, threshold, radius, cell), "ahead")
    roots = least_reachable(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    rooted = classes.select("node", "print", "mins").join(roots, "node", "left")
    rooted = rooted.select("node", "print", F.coalesce("root", "node").alias("root"), "mins")
    values = F.concat(F.transform(fixed, lambda mask: F.col("print").bitwiseAND(mask)), F.col("mins"))
    others = rooted.select("node", "print", "root", F.posexplode(values).alias("table", "value")).filter(F.col("table") >= FIRST)
    rest = _verified(others, classes, masks, threshold, radius, cell)
    return rest.unionByName(roots.select("node", F.col("root").alias("least")))


def _verified(cells: DataFrame, classes: DataFrame, masks: list[int], threshold: float, radius: int, cell: int) -> DataFrame:
    """(node, least) of the cells ``(table, value)``: tables are the masks, and the min-hashes behind them."""

    def met(rows: DataFrame, most: int | None) -> DataFrame:
        # What a mask leaves of a fingerprint is not shipped with it.
        fixed = F.array(*[F.lit(_signed(mask)) for mask in masks])
        value = F.coalesce("value", F.col("print").bitwiseAND(F.get(fixed, F.col("table"))))
        order = ["table", value, "low", "high"]
        ordered = rows.repartition(*order).sortWithinPartitions(*order)
        return ordered.mapInArrow(lambda batches: _met(batches, masks, radius, most), MET)

    shipped = F.when(F.col("table") >= len(masks), F.col("value"))
    whole = cells.select("table", shipped.alias("value"), F.lit(0).alias("low"), F.lit(0).alias("high"), "node", "print", "root")
    found = written(met(whole, cell), "met")
    candidates, crowded = found.filter("members = 0"), found.filter("members > 0")
    if not crowded.isEmpty():
        pieces = F.ceil(F.col("members") / cell).cast("int")
        own = crowded.withColumn("pieces", pieces).withColumn("own", F.expr("CAST(pmod(xxhash64(node), pieces) AS int)"))
        each = own.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
        pairs = each.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        candidates = candidates.unionByName(written(met(pairs.select(*whole.columns), None), "met"))
    ordered = candidates.join(classes.select("node", "sketch"), "node").repartition(*KEYS).sortWithinPartitions(*KEYS, "node")
    return ordered.mapInArrow(lambda batches: _linked(batches, len(masks), threshold, radius), "node long, least long")


def _met(batches, masks: list[int], radius: int, most: int | None):
    """Members of a cell that have a candidate in it, with 0 ``members``; all of a cell of more than ``most``.

    Rows come ordered by cell; the last cell of a batch waits for the next batch.
    """
    bits = np.array(masks, np.uint64)
    names = [*KEYS, "node", "print", "root"]
    kept: list[list[np.ndarray]] = []

    def made(columns: list[np.ndarray], borders: np.ndarray) -> pa.RecordBatch:
        at, members = _candidates(columns, borders, bits, radius, most)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(column[at], kind) for column, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(members, pa.int64())], names=[*names, "members"])

    def settled():
        """The rows kept, with the places where a cell begins."""
        columns = [np.concatenate(parts) for parts in zip(*kept, strict=True)]
        changes = np.any([column[1:] != column[:-1] for column in columns[: len(KEYS)]], axis=0)
        return columns, np.concatenate([[0], np.flatnonzero(changes) + 1])

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(name)) for name in names]
        columns = [column.fill_null(0).to_numpy(zero_copy_only=False) for column in columns]
        if not len(columns[0]):
            continue
        table, value, prints = columns[0], columns[1], columns[5].view(np.uint64)
        left = (prints & bits[np.minimum(table, len(bits) - 1)]).view(np.int64)
        columns[1] = np.where(table < len(bits), left, value)
        same = kept and all(kept[-1][k][-1] == columns[k][0] == columns[k][-1] for k in range(len(KEYS)))
        kept.append(columns)
        if same:  # a cell that has not ended
            continue
        columns, starts = settled()
        last = starts[-1]
        kept = [[column[last:] for column in columns]]
        if last:
            yield made([column[:last] for column in columns], starts[:-1])
    if kept:
        yield made(*settled())


def _candidates(columns: list[np.ndarray], starts: np.ndarray, masks: np.ndarray, radius: int, most: int | None):
    """The rows that ``_met`` names, and their ``members``."""
    table, prints, root = columns[0], columns[5].view(np.uint64), columns[6]
    ends = np.append(starts[1:], len(table))
    sizes = np.repeat(ends - starts, ends - starts)
    room = np.repeat(ends, ends - starts) - np.arange(len(table)) - 1  # members of the same cell that follow
    crowded = sizes > most if most else np.zeros(len(table), bool)
    wide = table >= len(masks)
    reach = np.where(wide, WIDE, radius)
    meets = np.zeros(len(table), bool)
    a, lag = np.flatnonzero(~crowded), 0
    while len(a := a[room[a] > lag]):
        lag += 1
        differ = prints[a] ^ prints[a + lag]
        far = np.bitwise_count(differ)
        near = (far <= reach[a]) & (root[a] != root[a + lag]) & ~(wide[a] & (far <= radius))
        at, differ = a[near], differ[near]
        for part in range(0, len(at), 65_536):
            own, bits = at[part : part + 65_536], differ[part : part + 65_536]
            # A pair under a mask is one of the first mask that it meets under.
            first = ((bits[:, None] & masks) == 0).argmax(axis=1)
            own = own[wide[own] | (first == table[own])]
            meets[own] = meets[own + lag] = True
    at = np.flatnonzero(meets | crowded)
    return at, np.where(crowded[at], sizes[at], 0)


def _linked(batches, masks: int, threshold: float, radius: int):
    """Rows come ordered by cell; a cell's rows are gathered until the next one begins."""
    held: list[tuple] = []
    cell, found = None, []
    reach = lambda: WIDE if cell and cell[0] >= masks else radius
    for batch in batches:
        own = [batch.column(batch.schema.get_field_index(name)) for name in [*KEYS, "node", "print", "root"]]
        lists = batch.column(batch.schema.get_field_index("sketch"))
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for k, (*key, node, print_, root) in enumerate(zip(*(column.to_pylist() for column in own), strict=True)):
            if key != cell:
                found += _cell_links(held, threshold, reach())
                held, cell = [], key
            held.append((node, print_, root, values[ends[k] : ends[k + 1]].copy()))
        yield _batch(found)
        found = []
    yield _batch(_cell_links(held, threshold, reach()))


def _batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "least"])


def _cell_links(members: list[tuple[int, int, int, np.ndarray]], threshold: float, radius: int) -> list[tuple[int, int]]:
    if len(members) < 2:
        return []
    nodes, prints, roots, sketched = zip(*members, strict=True)
    bits = np.array(prints, np.int64).view(np.uint64)
    # Members that are linked already are one from the start.
    _, first, group = np.unique(np.array(roots), return_index=True, return_inverse=True)
    label = first[group]
    for a in range(len(members) - 1):
        near = np.bitwise_count(bits[a + 1 :] ^ bits[a]) <= radius
        for b in (np.flatnonzero(near & (label[a + 1 :] != label[a])) + a + 1).tolist():
            # An earlier one of this turn may have brought it along.
            if label[a] != label[b] and alike(sketched[a], sketched[b]) >= threshold:
                low, high = sorted((label[a], label[b]))
                label[label == high] = low
    return [(nodes[k], nodes[label[k]]) for k in np.flatnonzero(label != np.arange(len(members)))]


def near_duplicates_removed(docs: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """One row of each group; the others go. Columns stay as they are."""
    made = written(sketches(docs), "sketches")
    classes = written(
        made.groupBy("digest")
        .agg(F.first(F.struct("print", "mins", "sketch")).alias("_s"))
        .select("digest", "_s.*")
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    edges = written(verified_links(classes, threshold, radius), "links")
    roots = least_reachable(edges.select(F.col("node").alias("a"), F.col("least").alias("b")))
    rooted = classes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    # Rows are told apart by doc_id and text; how many have both alike is counted with them.
    rows = made.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")).join(rooted, "digest")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    stays = rows.groupBy("root").agg(F.min(order).alias("_stays"))
    judged = rows.join(stays, "root").withColumn("goes", order != F.col("_stays"))
    judged = written(judged.select("doc_id", "digest", "goes", "copies"), "judged")
    gone, repeated = judged.filter("goes"), judged.filter("NOT goes AND copies > 1")
    # Whatever the documents' columns are called, they are fields of one column here.
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), _digest().alias("_digest"), F.struct(*docs.columns).alias("_row"))
    if repeated.isEmpty():
        return _matched(keyed, gone, "left_anti").select("_row.*")
    once = _matched(keyed, gone.unionByName(repeated), "left_anti")
    again = _matched(keyed, repeated, "left_semi").dropDuplicates(["_id", "_digest"])
    return once.select("_row.*").unionByName(again.select("_row.*"))


def _matched(keyed: DataFrame, judged: DataFrame, how: str) -> DataFrame:
    """The same join at every size."""
    asked = judged.select(F.col("doc_id").alias("_of"), F.col("digest").alias("_text")).hint("shuffle_hash")
    return keyed.join(asked, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_digest") == F.col("_text")), how)
