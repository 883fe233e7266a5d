"""Exact top-k search by inner product: one KD-tree per shard, searched best-first.

*Shards in space.* A bounded sample is split at medians of the widest dimension into at most ``LEAVES``
leaves; every vector goes to its leaf, and a leaf's vectors to shards of about ``SHARD_ROWS`` rows by a
hash of the row, so a leaf that holds very many vectors, or copies of one, is cut as well. The tight box of
every leaf is kept. A shard's tree splits at the median of the widest dimension; every node keeps the tight
box around its vectors. The largest inner product a box allows, ``sum(max(q * low, q * high))``, orders the
search: the most promising node first, until none can beat the k-th best so far.

*Carried along.* Each query first searches one shard of the leaf whose box allows it most. With the k-th
score found there, leaves whose box allows less are dropped before anything is shuffled; the query goes
to the shards of the others, and starts there from that score.

Vectors are shipped once for each of the two passes, queries to the shards that may hold a better one. In
a task a shard's vectors, bounded, come first, and its queries stream past them.

Scores are exact integers: products that fit are computed in doubles below 2**53, others in Python's
integers; a score beyond a long is given as the nearest long.

Edge cases: vectors that are NULL or hold a NULL or a component that is not finite take no part; vectors
of different length are compared as if filled up with zeros; fewer than k candidates give all of them; a
row never finds rows of its own id; repeated query rows give one answer, repeated candidates are found
each; a NULL id is a candidate, last among equal scores, and no query; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import written

SHARD_ROWS, LEAF = 8192, 128
#: Leaves at most, and rows they are told from; both bound what the driver and every task hold.
LEAVES, SAMPLE = 256, 20_000
#: Stands for a NULL id, after all others.
NO_ID = 2**63 - 1
EXACT = 2**53


def quantized(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and ``vec``, the components as whole numbers: floor(scale * x)."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale)))
    return vectors.filter(x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), whole.alias("vec")
    )


class Tree:
    """A KD-tree over the rows of a matrix of whole numbers."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.low, self.high, self.least, self.span, self.children = [], [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            start, end, parent = todo.pop()
            own = points[order[start:end]]
            low, high = own.min(axis=0), own.max(axis=0)
            node = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.least.append(int(ids[order[start:end]].min()))
            self.span.append((start, end))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if end - start > leaf and points.shape[1] and (high > low).any():
                widest = int((high - low).argmax())
                middle = (end - start) // 2
                split = np.argpartition(own[:, widest], middle)
                order[start:end] = order[start:end][split]
                todo += [(start, start + middle, node), (start + middle, end, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.points = ids[order], points[order]

    def search(self, query: np.ndarray, own_id: int, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
        """(score, id) of the k best, best first; with ``floor`` only those better than that (score, id)."""
        bound = np.maximum(query * self.low, query * self.high).sum(axis=1)
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top
        worst = (int(floor[0]), -int(floor[1])) if floor else None
        queue = [(-bound[0], 0)]
        while queue:
            most, node = heapq.heappop(queue)
            most = int(-most)
            if worst and most < worst[0]:
                break
            if worst and most == worst[0] and -self.least[node] < worst[1]:
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-bound[child], child))
                continue
            start, end = self.span[node]
            scores = self.points[start:end] @ query
            fine = self.ids[start:end] != own_id
            if worst:
                fine &= scores >= worst[0]
            for at in np.flatnonzero(fine):
                found = (int(scores[at]), -int(self.ids[start + at]))
                if worst and found <= worst:
                    continue
                heapq.heappush(best, found)
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k:
                    worst = max(worst, best[0]) if worst else best[0]
        return [(score, -negative) for score, negative in sorted(best, reverse=True)]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows filled up with zeros to one width."""
    rows = column.combine_chunks()
    lengths = np.diff(rows.offsets.to_numpy())
    values = rows.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    made = np.zeros((len(lengths), width), np.int64)
    starts = np.cumsum(lengths) - lengths
    for k, (start, length) in enumerate(zip(starts, lengths, strict=True)):
        made[k, :length] = values[start : start + length]
    return made


def _fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """The rows at another width: what has no partner there adds nothing to a product."""
    made = np.zeros((len(rows), width), rows.dtype)
    least = min(width, rows.shape[1])
    made[:, :least] = rows[:, :least]
    return made


def _widest(column: pa.ChunkedArray) -> int:
    rows = column.combine_chunks()
    return int(np.diff(rows.offsets.to_numpy()).max(initial=0))


class Space:
    """Median splits of a sample into leaves, as nested (dimension, border, below, above) or a number."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.leaves = 0
        self.root = self._split(points, leaves)

    def _split(self, points: np.ndarray, leaves: int):
        if leaves > 1 and len(points) > 1 and points.shape[1]:
            span = points.max(axis=0) - points.min(axis=0)
            widest = int(span.argmax())
            border = np.median(points[:, widest])
            above = points[:, widest] >= border
            if span[widest] > 0 and above.any() and not above.all():
                parts = (self._split(points[~above], leaves // 2), self._split(points[above], leaves - leaves // 2))
                return (widest, float(border), *parts)
        self.leaves += 1
        return self.leaves - 1

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        found = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                found[rows] = node
                continue
            dimension, border, below, above = node
            own = points[rows, dimension] if dimension < points.shape[1] else np.zeros(len(rows))
            todo += [(below, rows[own < border]), (above, rows[own >= border])]
        return found


def _placing(sent):
    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            points = _matrix(table["vec"], _widest(table["vec"])).astype(float)
            leaf = pa.array(sent.value.leaf_of(points), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], names=["row", "vec_id", "vec", "leaf"])

    return place


def _sides(batches):
    """Per task, leaf and dimension: least and greatest component, and of how many vectors."""
    held: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        points, leaves = _matrix(table["vec"], _widest(table["vec"])), table["leaf"].to_numpy()
        for leaf in np.unique(leaves).tolist():
            own = points[leaves == leaf]
            # A dimension of its own number counts the vectors, also those without any.
            new = [(-1, 0, 0)] + [(pos, int(a), int(b)) for pos, (a, b) in enumerate(zip(own.min(axis=0), own.max(axis=0), strict=True))]
            for pos, low, high in new:
                old = held.get((leaf, pos), [low, high, 0])
                held[leaf, pos] = [min(low, old[0]), max(high, old[1]), old[2] + len(own)]
    rows = [(leaf, pos, *found) for (leaf, pos), found in held.items()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["leaf", "pos", "low", "high", "n"])


class Boxes:
    """The box and the number of shards of every leaf."""

    def __init__(self, rows: list, shard_rows: int):
        counts = {leaf: n for leaf, pos, _, _, n in rows if pos < 0}
        self.shards = {leaf: -(-n // shard_rows) for leaf, n in counts.items()}
        self.leaf = np.array(sorted(counts), np.int32)
        width = max((row[1] for row in rows), default=-1) + 1
        self.low, self.high = np.zeros((2, len(self.leaf), width))
        place = {leaf: k for k, leaf in enumerate(self.leaf.tolist())}
        for leaf, pos, low, high, n in rows:
            if pos >= 0:
                # Where some vectors end earlier, they count as zero.
                short = n < counts[leaf]
                self.low[place[leaf], pos] = min(low, 0) if short else low
                self.high[place[leaf], pos] = max(high, 0) if short else high

    def most(self, query: np.ndarray) -> np.ndarray:
        """What each leaf allows at most, rounded up."""
        q = _fitted(query[None, :].astype(float), self.low.shape[1])[0]
        size = (np.abs(q) * np.maximum(np.abs(self.low), np.abs(self.high))).sum(axis=1)
        return np.maximum(q * self.low, q * self.high).sum(axis=1) + size * 1e-12 + 1


ASKED = "vec_id long, query long, vec array<long>, floor_score long, floor_id long, leaf int, shard int"


def _asking(sent, home: bool):
    """Queries with the shards to search: one of the best leaf at first, then all that may hold more."""

    def ask(batches):
        boxes = sent.value
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(["vec_id", "query", "vec", "floor_score", "floor_id"])
            points = _matrix(rows["vec"], _widest(rows["vec"]))
            taken, leaves, shards = [], [], []
            keys = zip(rows["query"].to_pylist(), rows["floor_score"].to_pylist(), strict=True)
            for k, (query, floor) in enumerate(keys):
                most = boxes.most(points[k])
                best = int(boxes.leaf[most.argmax()])
                own = (best, query % boxes.shards[best])
                if home:
                    pairs = [own]
                else:
                    near = boxes.leaf if floor is None else boxes.leaf[most >= floor]
                    pairs = [(leaf, n) for leaf in near.tolist() for n in range(boxes.shards[leaf]) if (leaf, n) != own]
                taken += [k] * len(pairs)
                leaves += [leaf for leaf, _ in pairs]
                shards += [n for _, n in pairs]
                if len(taken) >= 4096:
                    yield from _told(rows, taken, leaves, shards)
                    taken, leaves, shards = [], [], []
            yield from _told(rows, taken, leaves, shards)

    return ask


def _told(rows: pa.Table, taken: list[int], leaves: list[int], shards: list[int]):
    asked = rows.take(pa.array(taken, pa.int64()))
    for name, values in (("leaf", leaves), ("shard", shards)):
        asked = asked.append_column(name, pa.array(values, pa.int32()))
    yield from asked.combine_chunks().to_batches()


class Shard:
    """A shard's tree, in doubles where products fit them and in Python's integers elsewhere."""

    def __init__(self, parts: list[pa.Table]):
        table = pa.concat_tables(parts)
        self.ids, self.points = table["vec_id"].to_numpy(), _matrix(table["vec"], _widest(table["vec"]))
        self.largest = float(np.abs(self.points.astype(float)).max(initial=0))
        self.trees: dict = {}

    def search(self, queries: pa.Table, k: int) -> list[tuple]:
        width = self.points.shape[1]
        wanted = _fitted(_matrix(queries["vec"], _widest(queries["vec"])), width)
        size = self.largest * float(np.abs(wanted.astype(float)).max(initial=0)) * max(width, 1)
        kind = np.float64 if size < EXACT else object
        if kind not in self.trees:
            self.trees[kind] = Tree(self.ids, self.points.astype(kind))
        floors = zip(queries["floor_score"].to_pylist(), queries["floor_id"].to_pylist(), strict=True)
        keys = zip(queries["vec_id"].to_pylist(), queries["query"].to_pylist(), floors, strict=True)
        out: list[tuple] = []
        for (own_id, query, floor), vector in zip(keys, wanted.astype(kind), strict=True):
            found = self.trees[kind].search(vector, own_id, k, floor if floor[0] is not None else None)
            out += [(own_id, query, vec_id, min(max(score, -(2**63)), 2**63 - 1)) for score, vec_id in found]
        return out


FOUND = "query_id long, query long, vec_id long, score long"


def _searching(k: int):
    """Rows come ordered by shard, its vectors before its queries."""

    def search(batches):
        at, parts, shard = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table[name].to_numpy().astype(np.int64) for name in ("leaf", "shard", "is_query")], axis=1)
            borders = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            out: list[tuple] = []
            for start, end in zip([0, *borders], [*borders, len(keys)], strict=True):
                if start == end:
                    continue
                leaf, number, is_query = keys[start].tolist()
                if (leaf, number) != at:
                    at, parts, shard = (leaf, number), [], None
                own = table.slice(start, end - start)
                if not is_query:
                    parts.append(own)
                elif parts:
                    shard = shard or Shard(parts)
                    out += shard.search(own, k)
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            names = ["query_id", "query", "vec_id", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, leaves: int = LEAVES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best; ``vectors`` as ``quantized`` makes them."""
    context = vectors.sparkSession.sparkContext
    # Written with a number for each row, so that a row is in the same shard whenever it is read.
    numbered = written(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec"), "vectors")
    sample = numbered.select("vec").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
    wanted = min(leaves, -(-numbered.count() // shard_rows))
    space = context.broadcast(Space(_matrix(sample["vec"], _widest(sample["vec"])).astype(float), wanted))
    placed = written(
        numbered.mapInArrow(_placing(space), "row long, vec_id long, vec array<long>, leaf int"), "placed"
    )
    # As many rows as leaves have dimensions.
    sides = placed.mapInArrow(_sides, "leaf int, pos int, low long, high long, n long").groupBy("leaf", "pos")
    found = Boxes([tuple(row) for row in sides.agg(F.min("low"), F.max("high"), F.sum("n")).collect()], shard_rows)
    boxes = context.broadcast(found)

    nothing = F.lit(None).cast("long")
    # Of as many entries as there are leaves.
    shards = F.create_map(*[F.lit(x) for pair in ({0: 1} | found.shards).items() for x in pair])
    dealt = placed.select(
        "vec_id",
        nothing.alias("query"),
        "vec",
        *(nothing.alias(name) for name in ("floor_score", "floor_id")),
        "leaf",
        F.pmod(F.xxhash64("row"), shards[F.col("leaf")]).cast("int").alias("shard"),
        F.lit(False).alias("is_query"),
    )

    def searched(asking: DataFrame, home: bool) -> DataFrame:
        asked = asking.mapInArrow(_asking(boxes, home), ASKED).withColumn("is_query", F.lit(True))
        rows = dealt.unionByName(asked).repartition("leaf", "shard")
        return rows.sortWithinPartitions("leaf", "shard", "is_query").mapInArrow(_searching(k), FOUND)

    queries = (
        numbered.filter(is_query & (F.col("vec_id") != NO_ID))
        .select("vec_id", "vec")
        .distinct()
        .withColumn("query", F.xxhash64("vec_id", "vec"))
        .withColumns({"floor_score": nothing, "floor_id": nothing})
    )
    at_home = written(_best(searched(queries, True), k), "home")
    kth = at_home.filter(F.col("rank") == k).select(
        "query", F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id")
    )
    elsewhere = queries.join(kth, "query", "left").withColumns({"floor_score": F.col("kth_score"), "floor_id": F.col("kth_id")})
    found = at_home.drop("rank").unionByName(searched(elsewhere.drop("kth_score", "kth_id"), False))
    return _best(found, k).select(
        "query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score"
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
