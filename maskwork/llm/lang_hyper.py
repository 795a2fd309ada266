"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  The vector of three letters in a row is the product (binding) of the
first letter's vector rotated twice, the second's rotated once and the third's.  A text is the sum (bundling) of its
letter triples, a language the sum of its texts, and a text is given the language of the largest cosine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .columns import head_of, set_aside
from .shared import discard, written

#: Letters beyond the first are dealt to this many vectors by their code.
SLOTS = 1024
#: The length of a prototype's direction in whole numbers.
_UNIT = 2.0**26
UNKNOWN = "und"


@dataclass(frozen=True)
class HyperRules:
    dimensions: int = 1024
    seed: int = 5
    #: Prototypes are broadcast so many at a time; with more languages, texts are compared with one block after another.
    block: int = 2000


_tables: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _letters(rules: HyperRules) -> tuple[np.ndarray, np.ndarray]:
    """Slot by code point (0: no letter), vector by slot (0: the space between words)."""
    key = (rules.dimensions, rules.seed)
    if key not in _tables:
        slots = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                slots[c] = 1 + (ord(low[0]) * 2654435761 % 2**32 >> 7) % (SLOTS - 1)
        vectors = np.random.default_rng(rules.seed).integers(0, 2, (SLOTS, rules.dimensions), np.int8) * 2 - 1
        _tables[key] = slots, vectors
    return _tables[key]


def triples(texts: list[str | None], rules: HyperRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, triple and count of the letter triples of each text, its runs of other characters read as one space."""
    slots, _ = _letters(rules)
    joined = "\x00".join(t or "" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: len(codes)]
    slot = slots[codes]
    keep = np.ones(len(slot), bool)
    keep[1:] = (slot[1:] > 0) | (slot[:-1] > 0) | (row[1:] != row[:-1])
    slot, row = slot[keep].astype(np.int64), row[keep]
    if len(slot) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    code = (slot[:-2] * SLOTS + slot[1:-1]) * SLOTS + slot[2:]
    inside = (row[:-2] == row[2:]) & ((slot[:-2] > 0) | (slot[1:-1] > 0) | (slot[2:] > 0))
    both, counts = np.unique(row[:-2][inside] * SLOTS**3 + code[inside], return_counts=True)
    return both // SLOTS**3, both % SLOTS**3, counts.astype(np.float32)


def bundle(texts: list[str | None], rules: HyperRules) -> np.ndarray:
    """The vector of each text; all zero where it has no letter triple."""
    _, vectors = _letters(rules)
    row, code, counts = triples([f" {t} " if t else t for t in texts], rules)
    out = np.zeros((len(texts), rules.dimensions))
    for a in range(0, len(texts), 32):
        lo, hi = np.searchsorted(row, [a, a + 32])
        if hi > lo:
            distinct, at = np.unique(code[lo:hi], return_inverse=True)
            first, second, third = distinct // SLOTS**2, distinct // SLOTS % SLOTS, distinct % SLOTS
            bound = np.roll(vectors[first], 2, axis=1) * np.roll(vectors[second], 1, axis=1) * vectors[third]
            table = np.zeros((min(32, len(texts) - a), len(distinct)))
            table[row[lo:hi] - a, at] = counts[lo:hi]
            exact = np.float32 if table.sum(axis=1).max() < 2**24 else np.float64  # sums of whole numbers, in any order
            out[a : a + 32] = table.astype(exact) @ bound.astype(exact)
    return out


def whole_prototypes(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions of the languages' sums in whole numbers, and their lengths.

    Products with a text's vector are sums of whole numbers below 2**53, so a cosine is the same whatever texts and languages
    are multiplied with it.
    """
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    whole = np.rint(sums / np.where(norms > 0, norms, 1) * _UNIT)
    return whole, np.linalg.norm(whole, axis=1)


def learn_languages(docs: DataFrame, rules: HyperRules = HyperRules()) -> DataFrame:
    """``lang, sums array<double>``, written: the sum of the texts' vectors of each language, from all rows with a text and a
    non-null ``lang``.

    Each task adds up its own texts by language, and hands sums on where it has many; only sums are shuffled, one value per
    language and dimension.
    """

    def table(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in T.pieces(whole):
                langs = np.array(batch.column("lang").to_pylist(), object)
                vectors = bundle(batch.column("text").to_pylist(), rules)
                for x in set(langs.tolist()):
                    sums[x] = sums.get(x, 0) + vectors[langs == x].sum(axis=0, dtype=np.float64)
                if len(sums) > rules.block:
                    yield table(sums)
                    sums = {}
        yield table(sums)

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sums = rows.mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    return written(sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("sums")), "languages")


def predict_languages(docs: DataFrame, model: DataFrame, rules: HyperRules = HyperRules()) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (cosine, 0 to 1) to the columns of ``docs``, whatever their names (those that are made
    here are replaced); reads ``text`` alone.

    A null text, one without letters, or any text where no language was learned gets ``und`` and 0.  Ties go to the
    language that is first in order.  Texts are read whole whatever their length, and repeated rows are judged alike.  Rows
    are neither dropped nor added; an empty table gives none.
    """
    out, names, restored = set_aside(docs, ["text"], ["lang_pred", "score"])
    n_blocks = max(1, -(-model.count() // rules.block))
    for k in range(n_blocks):
        rows = model.where(F.pmod(F.xxhash64("lang"), F.lit(n_blocks)) == k).collect()
        found = sorted((r["lang"], r["sums"]) for r in rows)
        sums = np.array([v for _, v in found]).reshape(len(found), rules.dimensions)
        shared = docs.sparkSession.sparkContext.broadcast(([x for x, _ in found], *whole_prototypes(sums)))
        judged = _compared(out, names, shared, k == 0, rules)
        if k < n_blocks - 1:
            before, out = out, written(judged, "compared")
            shared.destroy()
            if k:
                discard(before)
    return judged.select(*restored, "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))).alias("score"))


def _compared(docs: DataFrame, names: list[str], shared, first: bool, rules: HyperRules) -> DataFrame:
    """The best of a block of languages and of what the blocks before have found: ``lang_pred`` and an unclipped ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes, lengths = shared.value
        for whole in batches:
            for batch in T.pieces(whole):
                n = batch.num_rows
                pred, score = (np.full(n, UNKNOWN, object), np.full(n, -np.inf)) if first else (np.array(batch.column("lang_pred").to_pylist(), object), np.array([-np.inf if x is None else x for x in batch.column("score").to_pylist()]))
                if langs:
                    vectors = bundle(batch.column("text").to_pylist(), rules)
                    size = np.linalg.norm(vectors, axis=1)
                    cosine = vectors @ prototypes.T / (np.where(size > 0, size, 1)[:, None] * np.where(lengths > 0, lengths, 1))
                    best = cosine.argmax(axis=1)
                    names_, own = np.array(langs, object)[best], cosine[np.arange(n), best]
                    better = (size > 0) & ((own > score) | ((own == score) & np.array([a < b for a, b in zip(names_, pred)], bool)))
                    pred, score = np.where(better, names_, pred), np.where(better, own, score)
                scores = pa.array(np.where(np.isfinite(score), score, 0.0), pa.float64(), mask=~np.isfinite(score))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(pred.tolist(), pa.string()), scores], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{head_of(docs.select(*names))}, lang_pred string, score double")


def held_out(remainder: int, divisor: int) -> Column:
    """Whether crc32 of the id, as text, has this remainder; a null id reads as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor == remainder
