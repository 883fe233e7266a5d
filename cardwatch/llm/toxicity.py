"""Toxicity: texts are freed of disguise first, and the restored words are scored.

The words of a text, as they stand and as disguised stretches decode (``deobfuscation``), and their
beginnings of four and five letters are its features. A logistic regression over them is fitted, by
follow-the-regularised-leader with an L1 penalty, on a bounded sample of labelled rows; its probability
is calibrated by a temperature on a held-back fifth and by the share of toxic labels.

Bounds: the sample has at most ``SAMPLE`` labelled documents, half of either label where there are
enough; the model has no more features than the sample has; the language model has ``28 ** 3`` numbers
and is counted over all documents.

Edge cases: a NULL text is an empty text; empty texts get the score of a text without any telling word;
several labels of one doc_id count as toxic if any is; NULL labels are none; if either label is missing
altogether every score is 0; repeated rows are scored each; rows with a NULL doc_id are scored and not
learned from; an empty table gives no rows. ``scores`` ignores other columns, ``without_toxic`` keeps
them.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.common import rows_of, slices, written
from cardwatch.llm.deobfuscation import Restorer, corpus_trigrams
from cardwatch.llm.ftrl import Ftrl, temperature
from cardwatch.llm.langid import remainder

#: The bound of the training sample, in documents.
SAMPLE = 16_000
#: What a feature needs: toxic documents that are no near copies of one another, how much likelier it
#: is in toxic ones, and its weight in the first fit as a share of the strongest ten.
LEAST_SUPPORT, LEAST_RATIO, LEAST_SHARE = 5, 10.0, 0.1
#: Share of the toxic examples that are repeated with one word alone.
ALONE = 0.3
THRESHOLD = 0.3
EPOCHS = 8


def features(words: set[str]) -> set[str]:
    """The words and, marked by a star, their beginnings."""
    found = set(words)
    found.update(f"{word[:4]}*" for word in words if len(word) > 4)
    found.update(f"{word[:5]}*" for word in words if len(word) > 5)
    return found


@dataclass
class ToxicityModel:
    restorer: Restorer
    weights: dict[str, float] = field(default_factory=dict)
    #: Log-odds of a text without any of the features; None if nothing could be learned.
    base: float | None = None

    def score(self, text: str | None) -> float:
        if self.base is None:
            return 0.0
        present = features(self.restorer.words(text or ""))
        margin = self.base + sum(self.weights[f] for f in present if f in self.weights)
        return 1.0 / (1.0 + math.exp(-margin)) if margin > -700 else 0.0


def trained(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> ToxicityModel:
    """Learns from the ``toxic`` column of the given labels, of which none should be held out."""
    restorer = Restorer(corpus_trigrams(docs))
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    )
    of_label = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    if set(of_label) != {0, 1}:
        return ToxicityModel(restorer)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("label = 1").orderBy(*order).limit(size // 2).unionByName(
        known.filter("label = 0").orderBy(*order).limit(size // 2)
    )
    sent = docs.sparkSession.sparkContext.broadcast(restorer)

    def extract(batches):
        for rows in rows_of(batches, "label", "text"):
            words = [sent.value.words(text or "") for _, text in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([_sketch(text or "") for _, text in rows], pa.int64()),
                    pa.array([sorted(features(own)) for own in words], pa.list_(pa.string())),
                ],
                names=["label", "sketch", "features"],
            )

    # At most ``size`` rows of two numbers, so they may be sent to every task.
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    examples = written(chosen.mapInArrow(extract, "label int, sketch long, features array<string>"), "examples")
    toxic = examples.filter("label = 1").select("sketch", F.explode("features").alias("feature"))
    supported = toxic.distinct().groupBy("feature").count().filter(F.col("count") >= LEAST_SUPPORT)
    names = ["", *sorted(row["feature"] for row in supported.select("feature").collect())]
    number = {name: k for k, name in enumerate(names) if k}

    def numbered(batches):
        for rows in rows_of(batches, "label", "features"):
            present = [sorted(number[f] for f in own if f in number) for _, own in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array(present, pa.list_(pa.int32()))],
                names=["label", "present"],
            )

    def fit(table: pa.Table) -> pa.Table:
        present = (np.asarray(own.values) for own in table["present"])
        labelled = zip(table["label"].to_pylist(), present, strict=True)
        # In an order of their own, whichever the rows arrive in.
        rows = sorted(labelled, key=lambda row: (row[0], row[1].tobytes()))
        odds, prior = _fitted(rows, names)
        kept = [0, *(k for k in np.flatnonzero(odds).tolist() if k)]
        return pa.table({"feature": pa.array(kept, pa.int32()), "weight": [float(odds[k]) for k in kept], "prior": [prior] * len(kept)})

    fitted = (
        examples.mapInArrow(numbered, "label int, present array<int>")
        .groupBy(F.lit(0).alias("one"))
        .applyInArrow(fit, "feature int, weight double, prior double")
        .collect()
    )
    if not fitted or fitted[0]["prior"] is None:
        return ToxicityModel(restorer)
    weight = {row["feature"]: row["weight"] for row in fitted}
    # The sample has its own share of toxic rows; the corpus has that of the labels.
    shift = math.log(of_label[1] / of_label[0]) - fitted[0]["prior"]
    return ToxicityModel(restorer, {names[k]: w for k, w in weight.items() if k}, weight[0] + shift)


def _sketch(text: str) -> int:
    """Least hash of the word triples: near copies mostly share it, so they do not count as so many."""
    words = text.split()
    triples = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [words]
    return min(zlib.crc32(" ".join(triple).encode("utf-8", "surrogatepass")) for triple in triples)


def _fitted(rows: list[tuple[int, np.ndarray]], names: list[str]) -> tuple[np.ndarray, float | None]:
    """Log-odds of each feature, that of number 0 for a text without any, and the sample's prior.

    A first fit with a strong L1 penalty finds the telling features: what merely stands beside them
    gets no weight. For the second, some toxic examples are repeated with one of their telling words
    alone, since most have several and a text with one must be caught too.
    """
    toxic, clean = (np.zeros(len(names)) for _ in range(2))
    for label, present in rows:
        (toxic if label else clean)[present] += 1
    n_toxic = sum(label for label, _ in rows)
    n_clean = len(rows) - n_toxic
    if not n_toxic or not n_clean:
        return np.zeros(len(names)), None
    likelier = toxic / n_toxic >= LEAST_RATIO * (clean + 1) / n_clean
    order = np.random.default_rng(11)
    made = [(present[likelier[present]].tolist(), label) for label, present in rows]
    made = [made[k] for k in order.permutation(len(made))]
    held, taught = made[::5], [e for k, e in enumerate(made) if k % 5]
    first = _odds(Ftrl(len(names), 2, alpha=1.0, l1=0.5, l2=0.0).fit(_examples(taught), EPOCHS))
    strongest = np.sort(first[1:])[-10:]
    telling = set((np.flatnonzero(first[1:] >= LEAST_SHARE * strongest.mean()) + 1).tolist()) if len(strongest) else set()
    telling &= set(np.flatnonzero(first > 0).tolist())
    number = {names[k]: k for k in telling}

    def extended(examples):
        for present, label in examples:
            own = [k for k in present if k in telling]
            yield own, label
            if label and own and order.random() < ALONE:
                word = names[own[order.integers(len(own))]]
                yield sorted(number[f] for f in (word, f"{word[:4]}*", f"{word[:5]}*") if f in number), label

    taught, held = list(extended(taught)), list(extended(held))
    model = Ftrl(len(names), 2, alpha=1.0, l1=0.1, l2=0.0).fit(_examples(taught), EPOCHS)
    weights = model.weights()
    margins = np.array([weights[present].sum(0) for present, _, _ in _examples(held)]).reshape(len(held), 2)
    warmth = temperature(margins, np.array([label for _, label in held], np.int64))
    # Where a few words decide all, the likelihood alone would ask for ever steeper probabilities.
    return _odds(model) / min(max(warmth, 0.5), 5.0), math.log(n_toxic / n_clean)


def _odds(model: Ftrl) -> np.ndarray:
    weights = model.weights()
    return weights[:, 1] - weights[:, 0]


def _examples(rows: list[tuple[list[int], int]]) -> list:
    """With the constant feature 0."""
    return [(np.array([0, *present]), np.ones(len(present) + 1), label) for present, label in rows]


def learnable(labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The labels outside the held-out remainder of the ids."""
    return labels.filter(remainder("doc_id", folds) != held_out)


def scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for rows in rows_of(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_id for doc_id, _ in rows], pa.int64()),
                    pa.array([sent.value.score(text) for _, text in rows], pa.float64()),
                ],
                names=["doc_id", "score"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(score, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([sent.value.score(text) < threshold for text in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
