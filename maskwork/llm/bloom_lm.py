"""Language-model scores from a log-frequency Bloom filter.

The filter holds each n-gram once for every level up to ``1 + floor(log2(count))``.  A count is looked up by asking for
level 1, 2, ... until one is missing.  Counting is exact and distributed: tasks count their own n-grams, the counts are
exchanged in sorted blocks by hash range, of which there are the more the longer the texts are, and each range builds its
own segment of the filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .columns import head_of, set_aside
from .exchange import BUNDLE, bundled, entries_of, exchanged, widths
from .shared import discard, written

U = np.uint64
END = U(0x6A09E667F3BCC908)
UNIGRAM, BIGRAM = 1, 2


@dataclass(frozen=True)
class LmRules:
    bits_per_key: int = 10
    probes: int = 4
    #: Weight of the unigram model against a context's own counts.
    prior: float = 50.0
    #: Tokens counted by a task before it hands its counts on.
    flush: int = 2_000_000
    #: Bytes of text for each hash range.
    bucket_bytes: int = 4 << 20
    #: Into so many groups of ranges a task sends its counts at most.
    fan: int = 512
    #: Bytes of the model that a pass over the texts looks at; where it has more, there are several passes.
    pass_bytes: int = 256 << 20
    #: Bytes of one broadcast, and so of what the driver holds at once.
    part_bytes: int = 8 << 20


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, an end after each row's words, and the first token of each row (one more at last)."""
    data, offsets = T.buffers(column)
    data = T.LOWER[data]
    starts, ends, rows = T.words(data, offsets)
    n = len(rows) - 1
    out = np.full(len(starts) + n, END, U)
    owner = np.repeat(np.arange(n), np.diff(rows))
    out[np.arange(len(starts)) + owner] = T.Hasher(data)(starts, ends)
    return out, rows + np.arange(n + 1)


def bigrams(tokens: np.ndarray) -> np.ndarray:
    """Each token with the one before it; an end stands before each first word."""
    before = np.empty_like(tokens)
    before[:1], before[1:] = END, tokens[:-1]
    return T.mix(before * U(0xD6E8FEB86659FD93) + tokens)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The hash range, in order of the hashes."""
    return ((hashes >> U(40)) * U(buckets) >> U(24)).astype(np.int64)


def _packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted block: how many, hashes, and counts in 4 bytes each if they fit, else in 8."""
    return np.int64(len(hashes)).tobytes() + hashes.tobytes() + counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64).tobytes()


def _summed(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of several blocks, sorted, and their counts."""
    hashes, counts = [], []
    for p in packed:
        n = int(np.frombuffer(p, np.int64, 1)[0])
        hashes.append(np.frombuffer(p, U, n, 8))
        counts.append(np.frombuffer(p, np.uint32 if len(p) == 8 + 12 * n else np.int64, n, 8 + 8 * n).astype(np.int64))
    hashes, counts = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(hashes), 1), bool), hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _joined(entries: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """One block for each target."""
    by: dict[int, list] = {}
    for source, target, packed in entries:
        by.setdefault(target, [source, []])[1].append(packed)
    return [(source, target, _packed(*_summed(packed))) for target, (source, packed) in by.items()]


def count_ngrams(texts: DataFrame, rules: LmRules, buckets: int) -> DataFrame:
    """Bundles of sorted blocks of hashes and counts, from column ``text``, by ``key``: the bucket for unigrams, and behind
    those for bigrams."""
    width = widths(2 * buckets, rules.fan)[0]

    def flushed(kept: list[np.ndarray], number: int) -> pa.RecordBatch:
        entries, source = [], zlib.crc32(f"{TaskContext.get().partitionId()}-{number}".encode()) % (2 * buckets)
        for kind in (UNIGRAM, BIGRAM):
            hashes, counts = np.unique(np.concatenate([bigrams(t) if kind == BIGRAM else t for t in kept]), return_counts=True)
            cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
            entries += [(source, (kind - 1) * buckets + int(b), _packed(hashes[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts))]
        return bundled(source, entries, width).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, number = [], 0, 0
        for whole in batches:
            for batch in T.pieces(whole):
                got, _ = tokens(batch.column("text"))
                kept.append(got)
                n += len(got)
                if n >= rules.flush:
                    yield flushed(kept, number)
                    kept, n, number = [], 0, number + 1
        if n:
            yield flushed(kept, number)

    return exchanged(texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, BUNDLE), 2 * buckets, rules.fan, _joined)


def _positions(hashes: np.ndarray, level: int, probe: int, n_bits: np.ndarray | int) -> np.ndarray:
    h = T.mix(hashes + U(level * 0x9E3779B97F4A7C15 % 2**64))
    return ((h & U(0xFFFFFFFF)) + U(probe) * (h >> U(32) | U(1))) % n_bits


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ...


def build_segments(bundles: DataFrame, buckets: int, rules: LmRules) -> DataFrame:
    """``kind, bucket, hashes, counts, n_distinct, n_total, bits``: exact counts (of unigrams only) and filter segments."""

    def run(group: pa.Table) -> pa.Table:
        hashes, counts = _summed([e[2] for e in entries_of(group)])
        levels = levels_of(counts)
        words = int(levels.sum()) * rules.bits_per_key // 64 + 1
        bits = np.zeros(words * 64, np.uint8)
        for level in range(1, int(levels.max()) + 1):
            own = hashes[levels >= level]
            for probe in range(rules.probes):
                bits[_positions(own, level, probe, U(words * 64))] = 1
        kind, bucket = divmod(group.column("key")[0].as_py(), buckets)
        exact = kind + 1 == UNIGRAM
        return pa.table(
            {
                "kind": pa.array([kind + 1], pa.int32()),
                "bucket": pa.array([bucket], pa.int32()),
                "hashes": pa.array([hashes.tobytes() if exact else b""], pa.binary()),
                "counts": pa.array([counts.tobytes() if exact else b""], pa.binary()),
                "n_distinct": pa.array([len(hashes)], pa.int64()),
                "n_total": pa.array([int(counts.sum())], pa.int64()),
                "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
            }
        )

    return bundles.groupBy("key").applyInArrow(run, "kind int, bucket int, hashes binary, counts binary, n_distinct long, n_total long, bits binary")


@dataclass
class Filter:
    """Segments of one kind or more, by kind and bucket; those that another part holds have no bits."""

    buckets: int
    probes: int
    data: np.ndarray
    starts: dict[int, np.ndarray]
    n_bits: dict[int, np.ndarray]

    def look_up(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram: 0 if it is unknown, or held by another part."""
        out = np.zeros(len(hashes), np.uint8)
        if kind not in self.starts:
            return out
        bucket = bucket_of(hashes, self.buckets)
        n_bits, start = self.n_bits[kind][bucket], self.starts[kind][bucket]
        alive = np.flatnonzero(n_bits)
        level = 0
        while len(alive):
            level += 1
            for probe in range(self.probes):
                at = _positions(hashes[alive], level, probe, n_bits[alive])
                set_ = self.data[start[alive] + (at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8) & 1
                alive = alive[set_ == 1]
                if not len(alive):
                    break
            out[alive] = level
            if level == 63:
                break
        return out


def _parts(sizes: list[tuple], bound: int) -> list[list[tuple]]:
    """Items in order, dealt to parts of at most ``bound`` in sum (or one item); each item ends with its size."""
    parts: list[list[tuple]] = []
    room = 0
    for item in sizes:
        if not parts or item[-1] > room:
            parts.append([])
            room = bound
        parts[-1].append(item)
        room -= item[-1]
    return parts


def train_lm(texts: DataFrame, rules: LmRules = LmRules()) -> DataFrame:
    """Count and write out the model: the table of ``build_segments``, with column ``buckets``.  A null text is an empty one."""
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // rules.bucket_bytes))
    return written(build_segments(count_ngrams(texts, rules, buckets), buckets, rules).withColumn("buckets", F.lit(buckets)), "lm")


def _load(model: DataFrame, part: list[tuple], columns: list[str]) -> list:
    wanted = F.col("bucket").isin([x[2] for x in part]) & F.col("kind").isin(list({x[1] for x in part}))
    chosen = {x[1:3] for x in part}
    return sorted((r for r in model.where(wanted).select("kind", "bucket", *columns).collect() if (r["kind"], r["bucket"]) in chosen), key=lambda r: r[:2])


def _filter(model: DataFrame, part: list[tuple], buckets: int, rules: LmRules) -> Filter:
    out = Filter(buckets, rules.probes, np.zeros(0, np.uint8), {}, {})
    at, chunks = 0, []
    for r in _load(model, part, ["bits"]):
        for d, kind in ((out.starts, np.int64), (out.n_bits, U)):
            d.setdefault(r["kind"], np.zeros(buckets, kind))
        out.starts[r["kind"]][r["bucket"]], out.n_bits[r["kind"]][r["bucket"]] = at, 8 * len(r["bits"])
        at += len(r["bits"])
        chunks.append(r["bits"])
    out.data = np.frombuffer(b"".join(chunks), np.uint8)
    return out


@dataclass
class Vocabulary:
    """Exact counts of the words of some hash ranges."""

    known: np.ndarray
    counts: np.ndarray

    def look_up(self, distinct: np.ndarray, out: np.ndarray) -> None:
        """Put the counts of those of the sorted hashes that are known here into ``out``."""
        lo, hi = np.searchsorted(distinct, self.known[[0, -1]] if len(self.known) else np.zeros(2, U))
        some = distinct[lo : hi + 1]
        if len(self.known) and len(some):
            at = np.searchsorted(self.known, some).clip(max=len(self.known) - 1)
            out[lo : hi + 1] += np.where(self.known[at] == some, self.counts[at], 0)


def _vocabulary(model: DataFrame, part: list[tuple]) -> Vocabulary:
    rows = _load(model, part, ["hashes", "counts"])
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    return Vocabulary(np.frombuffer(b"".join(r["hashes"] for r in rows), U), counts.astype(np.uint32) if len(counts) and counts.max() < 2**32 else counts)


def about(levels: np.ndarray) -> np.ndarray:
    """A count for each level: exact for 0 and 1, else a little over the level's smallest."""
    count = np.exp2(levels.astype(np.float64) - 1)
    return np.where(levels == 0, 0.0, np.where(levels == 1, 1.0, 1.3 * count))


STATE = {"_known": pa.int64(), "_logs": pa.float64(), "_levels": pa.binary()}
MADE = {"n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def score_texts(docs: DataFrame, model: DataFrame, rules: LmRules = LmRules()) -> DataFrame:
    """Adds ``n_tokens, n_known, train_tokens, base_score, score`` to the columns of ``docs``, whatever their names (those that
    are made here are replaced).

    ``base_score`` is the add-one unigram log10 probability from exact counts, ``score`` that of the bigram model, whose
    counts all come from the filter: ``(c(u w) + prior * p(w)) / (c(u) + prior)``.  A null text is an empty one, which has
    the end token alone.  Without training texts all counts are 0.  Texts are scored whole whatever their length, and
    repeated rows alike.  Rows are neither dropped nor added; an empty table gives none.

    A model of more than ``pass_bytes`` is looked at part by part; what a pass has found is written with the rows, and its
    broadcasts go, before the next begins.  The vocabulary is sorted hashes, so two words are confused with a chance of
    about V**2 / 2**65.
    """
    out, names, restored = set_aside(docs, ["text"], list(MADE))
    spark = docs.sparkSession
    sizes = model.select("kind", "bucket", "n_distinct", "n_total", F.octet_length("bits").alias("size"), "buckets").orderBy("kind", "bucket").collect()
    buckets = sizes[0]["buckets"] if sizes else 1
    words = [r for r in sizes if r["kind"] == UNIGRAM]
    n, v = sum(r["n_total"] for r in words), sum(r["n_distinct"] for r in words)
    items = [("words", UNIGRAM, r["bucket"], 16 * r["n_distinct"]) for r in words] + [("bits", r["kind"], r["bucket"], r["size"]) for r in sizes]
    parts = [part for what in ("words", "bits") for part in _parts([x for x in items if x[0] == what], rules.part_bytes)]
    passes = _parts([(part, sum(x[-1] for x in part)) for part in parts], rules.pass_bytes) or [[]]
    for i, own in enumerate(passes):
        shared = []
        for part, _ in own:
            shared.append(spark.sparkContext.broadcast(_vocabulary(model, part) if part[0][0] == "words" else _filter(model, part, buckets, rules)))
        scored = _pass(out, names, shared, i == 0, i == len(passes) - 1, n, v, rules)
        if i < len(passes) - 1:
            before, out = out, written(scored, "lm-pass")
            for x in shared:
                x.destroy()
            if i:
                discard(before)
    return scored.select(*restored, *MADE)


def word_scores(word: np.ndarray, pair: np.ndarray, rows: np.ndarray, n: int, v: int, prior: float) -> np.ndarray:
    """Each row's log10 probability from counts of its tokens and of its pairs of tokens, of N tokens and V distinct ones."""
    context = np.concatenate([word[-1:], word[:-1]])
    context[rows[:-1]] = word[rows[1:] - 1]  # an end stands before each first word, and at each row's last place
    pair = np.minimum(pair, np.minimum(context, word))
    return np.add.reduceat(np.log10((pair + prior * (word + 1) / (n + v + 1)) / (context + prior)), rows[:-1])


def _pass(docs: DataFrame, names: list[str], shared, first: bool, last: bool, n: int, v: int, rules: LmRules) -> DataFrame:
    """Look up what this part of the model holds; the levels found so far travel with the rows, two bytes a token."""
    made = MADE if last else STATE
    done = "n_tokens long, n_known long, train_tokens long, base_score double, score double" if last else "_known long, _logs double, _levels binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x.value for x in shared]
        filters, vocabularies = [x for x in held if isinstance(x, Filter)], [x for x in held if isinstance(x, Vocabulary)]
        look_up = lambda kind, hashes: np.maximum.reduce([f.look_up(kind, hashes) for f in filters] or [np.zeros(len(hashes), np.uint8)])
        bottom = np.log10(n + (v + 1))
        for whole in batches:
            for batch in T.pieces(whole, limit=T.PIECE_BYTES // 2):
                got, rows = tokens(batch.column("text"))
                distinct, where = np.unique(got, return_inverse=True)
                c = np.zeros(len(distinct), np.int64)
                for x in vocabularies:
                    x.look_up(distinct, c)
                levels = np.stack([look_up(UNIGRAM, distinct)[where], look_up(BIGRAM, bigrams(got))])
                add = lambda x: np.add.reduceat(x[where], rows[:-1])
                known, logs = add((c > 0).astype(np.int64)), add(np.log10(c + 1.0))
                if not first:
                    levels = np.maximum(levels, np.concatenate([np.frombuffer(b, np.uint8).reshape(2, -1) for b in batch.column("_levels").to_pylist()], axis=1))
                    known, logs = known + np.asarray(batch.column("_known")), logs + np.asarray(batch.column("_logs"))
                if last:
                    size = np.diff(rows)
                    values = (size, known, np.full(len(size), n), logs - size * bottom, word_scores(about(levels[0]), about(levels[1]), rows, n, v, rules.prior))
                else:
                    values = (known, logs, [np.ascontiguousarray(levels[:, a:b]).tobytes() for a, b in zip(rows[:-1], rows[1:])])
                yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + [pa.array(x, t) for x, t in zip(values, made.values())], names=[*names, *made])

    return docs.mapInArrow(run, f"{head_of(docs.select(*names))}, {done}")
