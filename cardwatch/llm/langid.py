"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Every whole text becomes counts of hashed n-grams of one to three characters, weighted by
``(1 + log(count)) * idf`` and scaled to length one. Document frequencies are counted over all
documents that may be learned from. The classifier is fitted by follow-the-regularised-leader with
elastic-net penalties on a bounded sample, ``SAMPLE`` documents shared evenly by the languages, of
which a fifth is held back to calibrate the probabilities by a temperature.

The sample is gathered in one task; everything else stays distributed. What is sent to the executors
is one number per hashed n-gram and language.

Edge cases: a NULL text or one without a letter is ``und`` with score 0, as is every text if nothing
can be learned from; rows with a NULL language are predicted but not learned from; a NULL doc_id is
in neither remainder and is learned from; repeated rows are predicted each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import rows_of
from cardwatch.llm.ftrl import Ftrl, softmax, temperature

ORDERS = (1, 2, 3)
#: Hashed n-grams, a power of two.
BUCKETS = 1 << 15
#: Steps of the hash by which samples are cut.
FINE = 1_000_003
#: The bound of the training sample, in documents.
SAMPLE = 6000
EPOCHS = 3
UNDETERMINED = "und"

WORDLIKE = re.compile(r"[^\W\d_]")
#: Characters hashed at a time, which bounds the memory for very long texts.
CHUNK = 1 << 20
#: Odd multiplier of the rolling hash (any large odd number does).
MIX = 0x9E3779B97F4A7C15


def has_letter(text: str | None) -> bool:
    """Fractions, superscripts and Roman numeral signs are no letters."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text or ""))


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of the lower-cased text occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    shift, mix = np.uint64(64 - BUCKETS.bit_length() + 1), np.uint64(MIX)
    longest = max(ORDERS)
    for start in range(0, len(codes), CHUNK):
        part = codes[start : start + CHUNK + longest - 1]
        fresh = min(CHUNK, len(codes) - start)  # n-grams that start here, each counted once
        rolled = np.zeros(len(part), np.uint64)
        for order in range(1, longest + 1):
            width = len(part) - order + 1
            if width <= 0:
                break
            rolled = (rolled[:width] + part[order - 1 :] + np.uint64(order)) * mix
            if order in ORDERS:
                total += np.bincount((rolled[:fresh] >> shift).astype(np.int64), minlength=BUCKETS)
    return total


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the present features, of length one."""
    present = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[present])) * idf[present]
    norm = np.sqrt(values @ values)
    return present, values / norm if norm else values


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        present, values = weighted(ngram_counts(text), self.idf)
        chances = softmax(values @ self.weights[present] / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; NULL for a NULL id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(by))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """``log((1 + n) / (1 + df)) + 1`` of every hashed n-gram over all given texts."""

    def count(batches):
        present, n = np.zeros(BUCKETS, np.int64), 0
        for rows in rows_of(batches, "text"):
            for (text,) in rows:
                present += ngram_counts(text or "") > 0
                n += 1
        seen = np.flatnonzero(present)
        numbers = np.concatenate([seen, [-1]])  # -1 stands for the number of texts
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.concatenate([present[seen], [n]]))], names=["k", "n"])

    totals = docs.select(F.col("text").cast("string")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n"))
    frequencies, n = np.zeros(BUCKETS), 0
    for k, number in totals.collect():
        if k < 0:
            n = number
        else:
            frequencies[k] = number
    return np.log((1.0 + n) / (1.0 + frequencies)) + 1.0


def sample(learnable: DataFrame, size: int) -> DataFrame:
    """An even share of ``size`` documents of each language, picked by a hash of id and text: lang, text,
    turn. Rows alike in both count as one.

    A first cut by the hash leaves some times the share of each language, by how many it has; only
    those are ordered, so no task sees all rows of a language.
    """
    learnable = learnable.withColumn("pick", F.xxhash64("doc_id", "text"))
    # A row for each class of the model, whose weights the driver holds as well.
    counts = learnable.groupBy("lang").agg(F.count_distinct("pick").alias("n")).collect()
    share = max(1, size // max(1, len(counts)))
    # Four times the share and some more: that fewer than the share are left is out of the question.
    below = [F.lit(x) for row in counts for x in (row["lang"], FINE * (4 * share + 100) // row["n"])]
    near = learnable.filter(F.pmod("pick", F.lit(FINE)) < F.create_map(*below)[F.col("lang")]) if counts else learnable
    once = near.groupBy("lang", "pick").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("pick")
    return once.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= share).drop("pick")


def trained(learnable: DataFrame, size: int = SAMPLE, epochs: int = EPOCHS) -> LanguageModel:
    """``learnable`` has doc_id, text and a lang that is not NULL."""
    idf = inverse_frequencies(learnable)

    def features(batches):
        for rows in rows_of(batches, "lang", "text", "turn"):
            made = [weighted(ngram_counts(text or ""), idf) for _, text, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                    pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32())),
                ],
                names=["lang", "turn", "present", "weights"],
            )

    def fit(table: pa.Table) -> pa.Table:
        languages = sorted(set(table["lang"].to_pylist()))
        turns = table["turn"].to_pylist()
        examples = [
            (np.asarray(present.values), np.asarray(values.values, np.float64), languages.index(lang))
            for present, values, lang in zip(table["present"], table["weights"], table["lang"].to_pylist(), strict=True)
        ]
        order = sorted(range(len(examples)), key=lambda k: (examples[k][2], turns[k]))
        held = [examples[k] for n, k in enumerate(order) if n % 5 == 4]
        taught = [examples[k] for n, k in enumerate(order) if n % 5 != 4]
        weights = Ftrl(BUCKETS, len(languages), l1=0.02).fit(taught, epochs).weights()
        scores = np.array([values @ weights[present] for present, values, _ in held]).reshape(len(held), len(languages))
        warmth = temperature(scores, np.array([label for _, _, label in held], np.int64))
        kept = [np.flatnonzero(column) for column in weights.T]
        return pa.table(
            {
                "lang": languages,
                "temperature": [warmth] * len(languages),
                "present": pa.array([k.astype(np.int32) for k in kept], pa.list_(pa.int32())),
                "weights": pa.array([weights[k, c] for c, k in enumerate(kept)], pa.list_(pa.float64())),
            }
        )

    examples = sample(learnable, size).mapInArrow(
        features, "lang string, turn int, present array<int>, weights array<float>"
    )
    fitted = examples.groupBy(F.lit(0).alias("one")).applyInArrow(
        fit, "lang string, temperature double, present array<int>, weights array<double>"
    )
    rows = sorted(fitted.collect())
    weights = np.zeros((BUCKETS, len(rows)))
    for c, row in enumerate(rows):
        weights[row["present"], c] = row["weights"]
    return LanguageModel([row["lang"] for row in rows], idf, weights, rows[0]["temperature"] if rows else 1.0)


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for rows in rows_of(batches, "doc_id", "text"):
            out = [sent.value.predict(text) for _, text in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_id for doc_id, _ in rows], pa.int64()),
                    pa.array([lang for lang, _ in out], pa.string()),
                    pa.array([score for _, score in out], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Learns from the documents outside the held-out remainder, predicts all."""
    left = F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False))
    learnable = docs.filter(F.col("lang").isNotNull() & ~left).select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
    )
    model = trained(learnable)
    return predicted(docs, model).withColumn(
        "held_out", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False))
    )
