"""Importance resampling towards a target distribution, with hashed n-gram features.

One scan of a text keeps a ring of zlib states, one for each of the last starts.  A word extends every state by a space and
itself and opens a new one, so each state is the CRC-32 of the words since its start, and each is a feature's bucket.  Counts
of the buckets in the corpus and in the target give every bucket a gain; a document's weight is the sum of its features'
gains.  With a Gumbel variate added, the documents of largest score are a draw without replacement in proportion to the
weights' exponentials.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .columns import head_of, set_aside
from .decontaminate import normal_words
from .shared import written

#: Positions in a partition take this many low bits of ``monotonically_increasing_id``.
_LOW = (1 << 33) - 1


@dataclass(frozen=True)
class ResampleRules:
    buckets: int = 10_000
    #: A feature has up to so many consecutive words.
    orders: int = 3
    percent: int = 5
    least_words: int = 20
    seed: int = 42
    #: Words after which what a long text has emitted is added up.
    flush_words: int = 200_000
    #: Rows of a task of the final sort, at least as many tasks as the session shuffles into.
    rows_per_task: int = 2_000_000


def ring_hashes(words: list[bytes], orders: int, ring: list[int] | None = None) -> list[int]:
    """CRC-32 of every run of 1 to ``orders`` words that ends in these; ``ring`` holds the states of the last starts before
    them and is brought up to date."""
    ring = [] if ring is None else ring
    out: list[int] = []
    for word in words:
        spaced = b" " + word
        fresh = [crc32(word)]
        for state in ring:
            fresh.append(crc32(spaced, state))
        out += fresh
        ring[:] = fresh[: orders - 1]
    return out


def _bucket_sums(text: str | None, rules: ResampleRules, values: np.ndarray | None, counts: np.ndarray | None) -> tuple[int, int, int]:
    """Words, features and the sum of ``values`` over the features' buckets; the buckets are added to ``counts``."""
    words = normal_words((text or "").encode())
    ring: list[int] = []
    features = total = 0
    for a in range(0, len(words), rules.flush_words):
        own = np.array(ring_hashes(words[a : a + rules.flush_words], rules.orders, ring), np.uint32) % np.uint32(rules.buckets)
        features += len(own)
        if counts is not None:
            counts += np.bincount(own, minlength=rules.buckets)
        if values is not None:
            total += int(values[own].sum())
    return len(words), features, total


def bucket_counts(texts: DataFrame, rules: ResampleRules = ResampleRules()) -> DataFrame:
    """``bucket, n``: how often each bucket occurs over all rows of column ``text``; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(rules.buckets, np.int64)
        for batch in batches:
            for piece in T.pieces(batch):
                for text in piece.column("text").to_pylist():
                    _bucket_sums(text, rules, None, counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], rules: ResampleRules = ResampleRules()) -> np.ndarray:
    """Each bucket's gain, in thousandths, from add-one smoothed shares in target and corpus."""
    all_s, all_t = sum(corpus.values()), sum(target.values())
    ratio = lambda b: float(target.get(b, 0) + 1) * float(all_s + rules.buckets) / (float(corpus.get(b, 0) + 1) * float(all_t + rules.buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(rules.buckets)], np.int64)


WEIGHTS = {"n_words": pa.int64(), "n_features": pa.int64(), "weight": pa.int64()}


def feature_weights(docs: DataFrame, gain: np.ndarray, rules: ResampleRules = ResampleRules()) -> DataFrame:
    """Adds ``n_words, n_features, weight`` to the columns of ``docs``, which has a column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value
        for batch in batches:
            for piece in T.pieces(batch):
                got = [_bucket_sums(text, rules, values, None) for text in piece.column("text").to_pylist()]
                made = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(WEIGHTS))]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, *WEIGHTS])

    return docs.mapInArrow(run, f"{head_of(docs)}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, rules: ResampleRules = ResampleRules()) -> DataFrame:
    """Weigh every document by how much more likely its features are in ``target`` than in ``docs``, and draw some.

    Keeps the columns of ``docs`` but ``text``, whatever their names (those that are made here are replaced), and adds
    ``n_words, n_features, weight, score`` and ``rank``, all long.  ``rank`` is 1, 2, 3 ... by falling score for the
    ``percent`` percent, rounded down, of the documents of ``least_words`` words or more that have the largest scores, ties
    to the smaller ``doc_id``; others have none.  ``score`` is the weight plus a Gumbel variate from the hash of the id.

    A null or wordless text has no words, no features and weight 0.  A null id reads as an empty text in the hash and comes
    last among ties; rows of one id and one score are ranked in any order.  Texts are read whole whatever their length.
    Rows are neither dropped nor added: an empty table gives none, and an empty target only smoothing.

    Counts of buckets are all that reaches the driver.  Scored rows are written without their texts, sorted by range over
    all tasks (equal keys are told apart by row number, so that many of them do not meet in one), and written with their
    place in their range; the number of rows in each range gives what is to be added.
    """
    spark = docs.sparkSession
    made = [*WEIGHTS, "score", "rank"]
    inner, names, restored = set_aside(docs, ["doc_id", "text"], made)
    inner = inner.withColumn("text", F.col("text").cast("string"))
    tally = lambda texts: {r["bucket"]: r["n"] for r in bucket_counts(texts, rules).collect()}  # noqa: E731  at most one row for each bucket
    gain = gains(tally(inner.select("text")), tally(target.select("text")), rules)

    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    kept = [n for n in names if n != "text"]
    scored = feature_weights(inner, gain, rules).select(*kept, *WEIGHTS, (F.col("weight") + gumbel).cast("long").alias("score"), F.monotonically_increasing_id().alias("_row"))
    scored = written(scored, "scored")

    able = F.col("n_words") >= rules.least_words
    n = scored.where(able).count()
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rules.rows_per_task))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    placed = scored.where(able).repartitionByRange(n_tasks, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed, "placed")
    part = F.shiftright("_place", 33).cast("int")
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each task of the sort
        offsets.append((r["part"], before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, "_part int, _before long")
    rank = F.col("_before") + F.col("_place").bitwiseAND(_LOW) + 1
    ranked = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    out = ranked.select(*kept, *WEIGHTS, "score", F.when(rank <= rules.percent * n // 100, rank).alias("rank"))
    rest = scored.where(~able).select(*kept, *WEIGHTS, "score", F.lit(None).cast("long").alias("rank"))
    back = [c for c, n in zip(restored, names) if n != "text"]
    return out.unionByName(rest).select(*back, *made)


RESAMPLE_SQL = r"""
WITH crcs AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
texts AS (SELECT 0 AS part, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
worded AS (SELECT part, row_number() OVER () AS r, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM texts),
runs AS (SELECT part, r, array_to_string(w[i:i + n - 1], ' ') AS feature, count(*) AS k FROM (SELECT part, r, w, unnest(range(1, len(w) + 1)) AS i FROM worded), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w) GROUP BY ALL),
bytes AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM runs)),
hashed AS (SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, [(instr('123456789ABCDEF', h[2 * j - 1]) * 16 + instr('123456789ABCDEF', h[2 * j]))::BIGINT FOR j IN range(1, len(h) // 2 + 1)]), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crcs),
counts AS (SELECT bucket, coalesce(sum(k) FILTER (part = 0), 0) AS s, coalesce(sum(k) FILTER (part = 1), 0) AS t FROM runs JOIN hashed USING (feature) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT r, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight FROM runs JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE part = 0 GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM worded LEFT JOIN weights USING (r) WHERE part = 0),
drawn AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM drawn
"""
