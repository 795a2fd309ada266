"""Near-duplicates by MinHash and a multi-index Hamming join.

A document's set is its distinct shingles of words.  Its signature has one b-bit value per MinHash function; two sets of
similarity s differ in a share 1 - s of the slots, give or take, so a threshold on the similarity becomes one on the
number of slots that differ.  The slots are cut into chunks, of which by the pigeonhole principle one has at most one
error if there are fewer than two errors per chunk; so a document is filed under each chunk with each of its slots left
out, and any two documents within the distance meet in some file.

In each file, documents are linked with the smallest one only, if their full sets confirm it.  Those of a file that are
near by signature, and not yet connected by links, make families; the members of a family are compared by their full
sets, a tile against a tile.  So no link between components is missed, and only pairs that connect something leave a
tile, at most one for each of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .components import connected_components
from .shared import written


@dataclass(frozen=True)
class NearRules:
    shingle: int = 5
    #: Link if 100 * intersection >= percent * union.
    percent: int = 80
    slots: int = 64
    #: The chance that a pair at the threshold has a distance over the one that is searched.
    miss: float = 1e-6
    #: Files are compared inside in tiles of about so many documents.
    tile: int = 384

    @property
    def distance(self) -> int:
        """The smallest number of differing slots that a pair at the threshold exceeds with less than ``miss``."""
        p, tail = 1 - self.percent / 100, 1.0
        for t in range(self.slots + 1):
            tail -= math.comb(self.slots, t) * p**t * (1 - p) ** (self.slots - t)
            if tail < self.miss:
                return t
        return self.slots

    @property
    def chunks(self) -> list[tuple[int, int]]:
        """Ranges of slots; so many that not all chunks can have two errors."""
        n = self.distance // 2 + 1
        cut = [self.slots * i // n for i in range(n + 1)]
        return list(zip(cut, cut[1:]))


_SLOT_BITS = np.uint64(0xFF)


def _factors(slots: int) -> tuple[np.ndarray, np.ndarray]:
    x = T.mix(np.arange(1, 2 * slots + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return x[:slots] | np.uint64(1), x[slots:]


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """16 bits of each MinHash value, one row per set; zeros for an empty set."""
    out = np.zeros((len(sets), slots), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        a, b = _factors(slots)
        for j in range(slots):
            low = np.minimum.reduceat(T.mix_light(flat * a[j] + b[j]), starts)
            out[full, j] = (T.mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def features(docs: DataFrame, rules: NearRules) -> DataFrame:
    """``doc_id, n_shingles, s1, s2, signature``: the pair of longs stands for the whole set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.pieces(whole):
                sets = T.text_shingles(batch.column("text"), rules.shingle)
                some = np.array([len(s) > 0 for s in sets])
                s1 = np.array([int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                s2 = np.array([int(T.mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                sig = signatures(sets, rules.slots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, mask=~some), pa.array(s2, mask=~some), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "signature"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, signature binary")


def filed(representatives: DataFrame, rules: NearRules) -> DataFrame:
    """``key, id``: a row for each chunk and each of its slots that is left out; the key ends in the number of that slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = np.asarray(batch.column("id"))
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(n, rules.slots)
            a, b = _factors(rules.slots)
            slot = T.mix((sig.astype(np.uint64) + np.uint64(1)) * a + b)
            for lo, hi in rules.chunks:
                whole = slot[:, lo:hi].sum(axis=1, dtype=np.uint64)
                keys = [T.mix(whole - slot[:, j] + np.uint64(0x9E37 + 131 * j)) & ~_SLOT_BITS | np.uint64(j) for j in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, hi - lo))], names=["key", "id"])

    return representatives.select("id", "signature").mapInArrow(run, "key long, id long")


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def near_signatures(pairs: DataFrame, representatives: DataFrame, rules: NearRules) -> DataFrame:
    """Those of the pairs ``a, b`` whose signatures are within the distance."""
    sig = lambda k: representatives.select(F.col("id").alias(k), F.col("signature").alias(f"_{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, rules.slots) for c in ("_a", "_b"))
            near = _differing(x, y) <= rules.distance
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near))

    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, rules: NearRules) -> DataFrame:
    """Those of the pairs ``a, b`` of ids whose full shingle sets reach the similarity."""
    text = lambda k: docs.select(F.col("doc_id").cast("long").alias(k), F.col("text").alias(f"_{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.pieces(whole, "_a", T.PIECE_BYTES // 2):
                sets: list[list[np.ndarray]] = []
                for c in ("_a", "_b"):
                    coded = batch.column(c).dictionary_encode()
                    own = T.text_shingles(coded.dictionary, rules.shingle)
                    sets.append([own[i] for i in coded.indices.to_pylist()])
                keep = []
                for x, y in zip(*sets):
                    both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
                    keep.append(both > 0 and 100 * both >= rules.percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(text("a"), "a").join(text("b"), "b").where("_a IS NOT NULL AND _b IS NOT NULL").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def _tiled(members: DataFrame, key: str, rules: NearRules) -> DataFrame:
    """Rows of groups of ``size``, dealt to pairs of tiles ``t, u`` so that any two rows of a group meet in one of them."""
    tiles = members.withColumn("_n", F.ceil(F.col("size") / rules.tile).cast("int")).withColumn("_t", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    tiles = tiles.withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return tiles.withColumns({"t": F.least("_t", "_u"), "u": F.greatest("_t", "_u")}).drop("_t", "_u", "_n", "size").withColumnRenamed(key, "key")


def _joined(ids: np.ndarray, linked: np.ndarray) -> pa.Table:
    """Each id with the smallest that a symmetric matrix of links connects it to, where there is one."""
    label = np.arange(len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    by = np.argsort(ids, kind="stable")
    label = rank.copy()
    while True:
        least = np.where(linked, label[None, :], len(ids)).min(axis=1, initial=len(ids))
        new = np.minimum(label, least)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != rank)
    return pa.table({"a": pa.array(ids[by[label[moved]]], pa.int64()), "b": pa.array(ids[moved], pa.int64())})


def _first_meeting(differs: np.ndarray, left_out: int, rules: NearRules) -> np.ndarray:
    """Of rows of differing slots between members of the file of a left-out slot: whether the two meet in no file before."""
    starts = np.array([lo for lo, _ in rules.chunks])
    errors = np.add.reduceat(differs, starts, axis=-1, dtype=np.int16)
    own = int(np.searchsorted(starts, left_out, side="right")) - 1
    return (errors[..., :own] > 1).all(axis=-1) & (differs[..., left_out] | (left_out == starts[own]))


def _near_foreign(members: DataFrame, rules: NearRules) -> DataFrame:
    """Pairs that connect what is near by signature and of different components.

    A file's smallest id is left out, as it was compared before, and two documents count in the first file that they share.
    """

    def run(group: pa.Table) -> pa.Table:
        ids, component = (np.asarray(group.column(c).combine_chunks()) for c in ("id", "component"))
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(-1, rules.slots)
        left_out = group.column("key")[0].as_py() & int(_SLOT_BITS)
        near = np.zeros((len(ids), len(ids)), bool)
        for i, x in enumerate(sig):
            differs = sig != x
            near[i] = (differs.sum(axis=1) <= rules.distance) & (component != component[i]) & _first_meeting(differs, left_out, rules)
        return _joined(ids, near)

    return _tiled(members.where("id != hub").select("key", "id", "component", "signature", "size"), "key", rules).groupBy("key", "t", "u").applyInArrow(run, "a long, b long").distinct()


def _exact_links(families: DataFrame, docs: DataFrame, rules: NearRules) -> DataFrame:
    """Pairs that connect documents of different components that full sets link, within families ``family, id, component``.

    The rows of a tile are compared at once: products of their incidence with shared shingles are the intersections.
    """
    sized = families.join(families.groupBy("family").agg(F.count("*").alias("size")), "family")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(families.select("id"), "id", "left_semi").dropDuplicates(["id"])

    def run(group: pa.Table) -> pa.Table:
        ids, component = (np.asarray(group.column(c).combine_chunks()) for c in ("id", "component"))
        sets = T.text_shingles(group.column("text"), rules.shingle)
        sizes = np.array([len(s) for s in sets], np.int64)
        distinct, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        use = counts[at] > 1
        row, at = row[use], (np.cumsum(counts > 1) - 1)[at[use]]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int((counts > 1).sum()), 4096):
            some = (at >= lo) & (at < lo + 4096)
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[some], at[some] - lo] = 1
            shared += part @ part.T
        both = np.rint(shared).astype(np.int64)
        linked = (both > 0) & (100 * both >= rules.percent * (sizes[:, None] + sizes[None, :] - both)) & (component[:, None] != component[None, :])
        return _joined(ids, linked)

    return _tiled(sized.join(texts, "id"), "family", rules).groupBy("key", "t", "u").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Words lie between ASCII white space, A-Z in lower case; a text of fewer words than a shingle is one shingle.  Texts
    with equal sets are one for the search, whatever their number.  A null or wordless text is linked with nothing and is
    its own component, as is a row with a null id, whose component is null and which is kept.  Rows with equal ids are one
    document: all or none of them are kept.  An empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    feats = written(features(docs, rules), "features")
    sets = feats.where("doc_id IS NOT NULL AND s1 IS NOT NULL")
    firsts = sets.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    reps = written(firsts.join(sets.select("s1", "s2", F.col("doc_id").alias("id"), "signature"), ["s1", "s2", "id"]).dropDuplicates(["id", "s1", "s2"]), "representatives")
    keys = filed(reps, rules)
    files = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = written(keys.join(files, "key"), "members")
    hubs = near_signatures(members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), reps, rules)
    first = connected_components(confirmed(hubs, docs, rules))
    first = written(first, "components")

    named = members.where("size > 2").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    close = written(_near_foreign(named.join(mixed, "key", "left_semi").join(reps.select("id", "signature"), "id"), rules), "close")
    families = written(connected_components(close).withColumnRenamed("component", "family").join(first, "id", "left").withColumn("component", F.coalesce("component", "id")), "families")
    more = _exact_links(families, docs, rules)
    of = lambda k: first.select(F.col("id").alias(k), F.col("component").alias(f"_{k}"))
    bridges = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    second = connected_components(bridges).select(F.col("id").alias("component"), F.col("component").alias("root"))

    root = firsts.join(first, "id", "left").withColumn("component", F.coalesce("component", "id")).join(second, "component", "left")
    root = root.select("s1", "s2", F.coalesce("root", "component").alias("root"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = feats.select("doc_id", "n_shingles", "s1", "s2").join(root, ["s1", "s2"], "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


NEAR_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM docs UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
