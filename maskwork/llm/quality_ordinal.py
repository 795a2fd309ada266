"""Quality classifier: ordinal cumulative-link regression on graded ratings.

The probability that a text's grade is above j is ``logistic(w . x - t_j)``: one weight vector over hashed words for all
grades, and ordered thresholds ``t_0 < t_1 < ...``.  The model gives the expected grade and the probability of the top
grade, by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .columns import head_of, set_aside


@dataclass(frozen=True)
class OrdinalRules:
    bits: int = 18
    #: The model is fitted on so many labelled documents at most, those with the smallest hashes of their ids.
    most_labelled: int = 12_000
    #: And on so many features in all, from the first of these on; each takes four bytes.
    most_features: int = 20_000_000
    #: A hashed word counts only if so many of these documents have it.
    least_documents: int = 4
    rounds: int = 120
    step: float = 0.5
    decay: float = 2e-4
    least_top_probability: float = 0.5


#: Bytes by kind, for a word's shape: runs of one kind are read as one.
_KIND = np.full(256, 6, np.uint8)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 1
for _c in b".,;:!?'\"()-":
    _KIND[_c] = 4
_KIND[0x7C] = 5


def features(column: pa.Array, bits: int) -> list[np.ndarray]:
    """Sorted distinct slots of each text: hashed words in lower case, and hashed shapes of words."""
    data, offsets = T.buffers(column)
    starts, ends, rows = T.words(data, offsets)
    word = T.Hasher(T.LOWER[data])(starts, ends)
    kind = _KIND[data]
    change = np.ones(len(kind) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[starts] = True
    at = np.flatnonzero(change[:-1])
    shape = T.Hasher(kind[at])(np.searchsorted(at, starts), np.searchsorted(at, ends)) ^ np.uint64(0xA5A5A5A5)
    shift = np.uint64(64 - bits)
    word, shape = (word >> shift).astype(np.int32), (T.mix(shape) >> shift).astype(np.int32)
    return [np.unique(np.concatenate([word[a:b], shape[a:b]])) for a, b in zip(rows[:-1], rows[1:])]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """Probability, per text and threshold, that the grade is above it."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, rules: OrdinalRules = OrdinalRules()) -> OrdinalModel:
    """Maximum likelihood with AdaGrad steps over all rows; thresholds stay ordered as they are sums of exponentials."""
    top = int(grades.max()) if len(grades) else 1
    weights, n = np.zeros(1 << rules.bits), max(len(grades), 1)
    base, gaps = -1.0, np.zeros(max(top - 1, 0))
    if not len(grades) or top == 0:
        return OrdinalModel(weights, np.arange(max(top, 1), dtype=float))
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    df = np.bincount(flat, minlength=1 << rules.bits)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    use = df[flat] >= rules.least_documents
    flat, owner = flat[use], owner[use]
    scale = np.sqrt(np.maximum(np.bincount(owner, minlength=len(rows)), 1))
    value = 1 / np.sqrt(scale)[owner]
    balance = n / ((top + 1) * np.maximum(np.bincount(grades, minlength=top + 1), 1))[grades]
    seen_w, seen_t = np.full(1 << rules.bits, 1e-8), np.full(top, 1e-8)
    for _ in range(rules.rounds):
        thresholds = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(owner, weights[flat] * value, minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -50, 50)))
        # P(grade = k) = above(k-1) - above(k); the gradient of its logarithm by each margin
        full = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], axis=1)
        rank = np.arange(len(rows))
        hi, lo = full[rank, grades], full[rank, grades + 1]
        chance = np.maximum(hi - lo, 1e-9)
        g_hi, g_lo = hi * (1 - hi) / chance * balance, -lo * (1 - lo) / chance * balance
        grad = np.bincount(flat, (g_hi + g_lo)[owner] * value, minlength=1 << rules.bits) / n - rules.decay * weights
        by = np.zeros(top)
        np.add.at(by, grades[grades > 0] - 1, -g_hi[grades > 0])
        np.add.at(by, grades[grades < top], -g_lo[grades < top])
        by /= n
        step_t = np.concatenate([[by.sum()], [by[i + 1 :].sum() * np.exp(gaps[i]) for i in range(top - 1)]])
        seen_w += grad**2
        seen_t += step_t**2
        weights += rules.step * grad / np.sqrt(seen_w)
        move = rules.step * step_t / np.sqrt(seen_t)
        base, gaps = base + move[0], gaps + move[1:]
    return OrdinalModel(weights, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def _feature_batches(docs: DataFrame, rules: OrdinalRules) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.pieces(whole):
                rows = features(batch.column("text"), rules.bits)
                yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("grade"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["place", "grade", "slots"])

    return docs.mapInArrow(run, "place long, grade int, slots binary")


def train(docs: DataFrame, grades: DataFrame, rules: OrdinalRules = OrdinalRules()) -> OrdinalModel:
    """Fit on documents joined with ``grades (doc_id, grade)``, at most ``most_labelled`` ids with the smallest hashes.

    An id with several grades has the smallest; all rows of an id count, in the order of the ids' hashes, up to
    ``most_features``.  Null ids and grades are left out; without rows the weights are 0.
    """
    one = grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = one.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(rules.most_labelled)
    rows = _feature_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("place", "grade", "text"), rules)
    slots, grade, room = [], [], rules.most_features
    for r in rows.orderBy("place", "slots").toLocalIterator():
        x = np.frombuffer(r["slots"], np.int32)
        room -= len(x)
        if room < 0 and slots:
            break
        slots.append(x)
        grade.append(r["grade"])
    return fit(slots, np.array(grade, np.int64), rules)


def score_quality(docs: DataFrame, model: OrdinalModel, rules: OrdinalRules = OrdinalRules()) -> DataFrame:
    """Adds ``expected_grade, top_probability, kept`` to the columns of ``docs``, whatever their names (those that are made
    here are replaced).

    ``top_probability`` is that of the highest grade and ``kept`` whether it reaches ``least_top_probability``.  A null or
    wordless text has no features, so the thresholds alone speak.  Texts are read whole whatever their length, and repeated
    rows are judged alike.  Rows are neither dropped nor added; an empty table gives none.
    """
    made = ["expected_grade", "top_probability", "kept"]
    docs, names, restored = set_aside(docs, ["text"], made)
    shared = docs.sparkSession.sparkContext.broadcast(OrdinalModel(model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in T.pieces(whole):
                score = np.array([model.weights[r].sum(dtype=np.float64) / max((model.weights[r] != 0).sum(), 1) ** 0.25 for r in features(batch.column("text"), rules.bits)])
                above = model.above(score)
                top = above[:, -1]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(above.sum(axis=1)), pa.array(top), pa.array(top >= rules.least_top_probability)], names=[*names, *made])

    return docs.mapInArrow(run, f"{head_of(docs)}, expected_grade double, top_probability double, kept boolean").select(*restored, *made)
