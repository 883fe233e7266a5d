"""Near duplicates among embeddings: Int8-quantised tile products with rigorous error bounds.

Vectors of one label are compared by cosine; pairs at or above the threshold are linked, and vectors
reachable over links are one component.

*Classes.* Equal vectors of a label are one class with a multiplicity, so copies, however many, are
compared once.

*Tiles.* A label's classes are dealt evenly to tiles of about ``tile_rows``, and every pair of tiles is a
task of its own, so a label that holds most of the table is cut as any other. A task takes at most two
tiles and returns at most one row for each of their classes: how many vectors it links to, and the
least class it reaches within the task. Links themselves are never written. All pairs of a label are
compared, so work grows with the square of a label; a vector is shipped once for each tile of its label.

*Bounds.* A unit vector ``u`` is stored as ``s * q`` with ``q`` of signed bytes and ``s`` its largest
component over 127; ``e = |u - s q|`` is measured. Then ``|u.v - s_u s_v (q_u.q_v)| <= e_u + e_v + e_u e_v``.
Products of bytes are sums of integers, exact in single precision up to 1,040 components and in double
precision beyond. A pair whose bound stays below the threshold is no link, one whose bound stays above is
one; only the others are computed in double precision from the full components.

Edge cases: vectors that are NULL, empty, all zero, hold a NULL or a component that is not finite, or have
no label link with nothing; shorter vectors count as filled up with zeros; repeated rows and rows that
share a vec_id are vectors of their own; a NULL vec_id takes part and names no component (``component_id``
is NULL if no member has an id, and such a row is ``kept``); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import written
from cardwatch.llm.simhash import _settle as settle
from cardwatch.llm.simhash import least_reachable

TILE_ROWS = 4096
#: Rows of a tile compared at a time with the other tile, and pairs computed at a time in full.
BLOCK, PAIRS = 512, 65_536
#: Components up to which a sum of products of signed bytes is below 2**24.
SINGLE = 1040
#: Room for the rounding of the bounds themselves.
SLACK = 1e-9


def comparable(x: str = "embedding"):
    """Vectors that can be linked: something in them, and nothing but finite numbers."""
    c = F.col(x)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda v: v != 0)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of length one in double precision, filled up with zeros."""
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(lists.offsets.to_numpy())
    made = np.zeros((len(sizes), int(sizes.max(initial=1))))
    inside = np.arange(made.shape[1]) < sizes[:, None]
    made[inside] = values
    made /= np.abs(made).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return made / np.sqrt((made * made).sum(axis=1, keepdims=True))


class Quantised:
    """Rows as whole numbers from -127 to 127, a scale and a measured error each."""

    def __init__(self, units: np.ndarray):
        self.units = units
        self.scale = np.abs(units).max(axis=1, initial=0) / 127
        whole = np.rint(units / np.where(self.scale > 0, self.scale, 1)[:, None])
        rest = units - whole * self.scale[:, None]
        self.error = np.sqrt((rest * rest).sum(axis=1)) + SLACK
        self.bytes = whole.astype(np.int8)
        self.kind = np.float32 if units.shape[1] <= SINGLE else np.float64

    def __len__(self) -> int:
        return len(self.units)

    def near(self, rows: slice, other: Quantised, columns: slice, threshold: float) -> np.ndarray:
        """Which of the rows are within the threshold of which of the other's, as booleans."""
        a, b = self.bytes[rows].astype(self.kind), other.bytes[columns].astype(self.kind)
        product = (a @ b.T).astype(float) * self.scale[rows, None] * other.scale[None, columns]
        error_a, error_b = self.error[rows, None], other.error[None, columns]
        room = error_a + error_b + error_a * error_b
        linked = product - room >= threshold
        at, with_ = np.nonzero((product + room >= threshold) & ~linked)
        for k in range(0, len(at), PAIRS):
            i, j = at[k : k + PAIRS], with_[k : k + PAIRS]
            exact = np.einsum("ij,ij->i", self.units[rows][i], other.units[columns][j])
            linked[i, j] = exact >= threshold
        return linked


def tile_links(left: Quantised, right: Quantised | None, copies: np.ndarray, threshold: float):
    """For the rows of one tile, or of two, what the task finds: vectors linked to, and a label that
    linked rows share. ``copies`` are the rows' multiplicities, left before right."""
    n = len(left)
    other, shift = (left, 0) if right is None else (right, n)
    links, label = np.zeros(len(copies)), np.arange(len(copies))
    weights = copies.astype(float)
    for at in range(0, n, BLOCK):
        rows = slice(at, min(at + BLOCK, n))
        columns = slice(at if right is None else 0, len(other))
        near = left.near(rows, other, columns, threshold)
        if right is None:
            near &= np.arange(columns.start, columns.stop)[None, :] > np.arange(rows.start, rows.stop)[:, None]
        first = columns.start + shift
        links[rows] += near @ weights[first : first + near.shape[1]]
        links[first : first + near.shape[1]] += weights[rows] @ near
        a, b = np.nonzero(near)
        a, b = a + at, b + first
        apart = label[a] != label[b]
        settle(label, a[apart], b[apart])
    return links.astype(np.int64), label


def _compared(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tile", "ascending"), ("node", "ascending")])
        node, tile, copies = (table[name].to_numpy() for name in ("node", "tile", "copies"))
        left = int(np.searchsorted(tile, tile[0], side="right"))
        units = _units(table["vec"])
        # In a task of two tiles, one may be empty; what is left of it then was compared elsewhere.
        one = table["i"][0].as_py() == table["j"][0].as_py()
        if one or left == len(node):
            links, label = (
                tile_links(Quantised(units), None, copies, threshold)
                if one
                else (np.zeros(len(node), np.int64), np.arange(len(node)))
            )
        else:
            links, label = tile_links(Quantised(units[:left]), Quantised(units[left:]), copies, threshold)
        told = np.flatnonzero(links > 0)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        return pa.table({"node": node[told], "links": links[told], "least": least[label[told]]})

    return compare


def linked(vectors: DataFrame, threshold: float = 0.93, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per vector."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("tag"), F.col("embedding").alias("vec")
    )
    valid = rows.filter(F.col("tag").isNotNull() & comparable("vec"))
    counted = valid.groupBy("tag", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("smallest"))
    # Written with a number each, so that a class has the same number whenever it is read.
    classes = written(counted.withColumn("node", F.monotonically_increasing_id()), "classes")

    tiles = classes.groupBy("tag").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    placed = classes.join(tiles, "tag").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = placed.select(
        "tag", "node", "copies", "vec", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")
    ).select("*", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"))
    found = written(
        dealt.drop("o").groupBy("tag", "i", "j").applyInArrow(_compared(threshold), "node long, links long, least long"),
        "links",
    )

    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = least_reachable(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    rooted = (
        classes.join(degree, "node", "left")
        .join(roots, "node", "left")
        .select("tag", "vec", "copies", "smallest", "links", F.coalesce("root", "node").alias("root"))
    )
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component"))
    told = rooted.join(named, "root").select(
        "tag", "vec", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.join(told, ["tag", "vec"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
