"""Best-fit packing of tokenized documents into sequences by the sum-of-squares rule.

A document becomes its token ids and one end id. Documents longer than a sequence are cut into
full pieces and a rest; nothing else is ever cut. Pieces are dealt into groups of a bounded, even
size by a row number that was written with them, so neither a hot document nor a hot source makes a
group larger. Within a group, pieces are taken from the longest to the shortest, and each goes where
the sum over all residual gaps ``g`` of ``(open sequences with gap g) ** 2`` becomes smallest: into an
open sequence of some gap, or into a new one.

Edge cases: a NULL text is an empty text; an empty text is the single end id; repeated rows are
packed as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.llm.common import rows_of, written
from cardwatch.llm.word_cache import WordTokenizer

#: A group this large leaves well under one percent of the sequences' room unused.
GROUP_PIECES = 16_384

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(
    docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ``ids`` if asked for."""
    schema = T.StructType.fromDDL(PIECES)
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    fields = [name for name in schema.names if name != "row_id"]

    def cut(batches):
        tokenizer = WordTokenizer.shared(tokenizer_file)
        for rows in rows_of(batches, "doc_id", "text"):
            out = {name: [] for name in fields}
            coded = tokenizer.encode_all(text or "" for _, text in rows)
            for (doc_id, _), ids in zip(rows, coded, strict=True):
                ids += np.uint32(end_id).tobytes()
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [pa.array(out[name], _arrow_type(name)) for name in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=fields)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = narrow.mapInArrow(cut, T.StructType([schema[name] for name in fields]))
    return pieces.select(F.monotonically_increasing_id().alias("row_id"), "*")


def _arrow_type(name: str) -> pa.DataType:
    return {"piece": pa.int32(), "ids": pa.list_(pa.int32())}.get(name, pa.int64())


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items placed in the given order."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.float64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for k, size in enumerate(lengths.tolist()):
        # Half the change of the sum of squares. Gap 0 is not counted, so an exact fit only lowers it.
        best, gain = -1, count[capacity - size] + 0.5 if size < capacity else 0.0
        if count[size] and 0.5 - count[size] < gain:
            best, gain = size, 0.5 - count[size]
        if size + 1 < capacity:
            change = np.where(count[size + 1 : capacity] > 0, count[1 : capacity - size] - count[size + 1 : capacity], np.inf)
            at = int(change.argmin())
            if change[at] + 1.0 < gain:
                best = size + 1 + at
        if best < 0:
            chosen, best = made, capacity
            made += 1
        else:
            chosen = open_bins[best].pop()
            count[best] -= 1
        bins[k], offsets[k] = chosen, capacity - best
        gap = best - size
        if gap:
            open_bins[gap].append(chosen)
            count[gap] += 1
    return bins, offsets


def packed(pieces: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have ``row_id`` and ``length``.

    ``pieces`` must be a written table: it is counted first, for the number of groups, and its row
    numbers must be the same each time it is read.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    other = [name for name in pieces.columns if name not in ("sequence_id", "offset")]
    schema = T.StructType(
        [T.StructField("group", T.LongType()), *pieces.select(*other).schema]
    ).add("sequence_id", T.LongType()).add("offset", T.LongType())

    def place(table: pa.Table) -> pa.Table:
        lengths, rows = table["length"].to_numpy(), table["row_id"].to_numpy()
        order = np.lexsort((rows, -lengths))
        bins, offsets = np.empty_like(lengths), np.empty_like(lengths)
        bins[order], offsets[order] = sum_of_squares(lengths[order], capacity)
        group = table["group"].to_numpy()
        return table.append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.select(F.pmod(F.xxhash64("row_id"), F.lit(groups)).alias("group"), *other)
    return dealt.groupBy("group").applyInArrow(place, schema).drop("group")


def pack_documents(
    docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its place."""
    pieces = written(tokenized_pieces(docs, tokenizer_file, capacity, end_id, with_ids), "pieces")
    return packed(pieces, capacity).drop("row_id")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``input_ids`` and the documents' borders, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return (
        placed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.flatten("parts.ids").alias("input_ids"),
            F.col("parts.offset").alias("offsets"),
            F.col("parts.doc_id").alias("doc_ids"),
            F.col("parts.piece").alias("pieces"),
        )
    )


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies on this machine; a cluster passes its own path."""
    import public_tokenizers

    return public_tokenizers.path(name)


__all__: list[str] = ["pack_documents", "packed", "sequences", "sum_of_squares", "tokenized_pieces", "vocabulary_file"]
