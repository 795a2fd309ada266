"""Ranked lexical search over an inverted index of shards.

A shard holds some documents in order of their ids, and for each of its terms the postings (place in the shard, occurrences)
in blocks: places as differences, and both in as few bytes as the block's largest takes.  A search runs document at a time: a
heap holds every posting list by the first place of its next block; the least is taken off and decoded, and all places before
the next least are complete.  The best results stay in a bounded heap, by score and then id, from shard to shard of a task,
and the tasks' heaps are merged at the end.  Lists that together cannot lift a document over the worst kept result are not
merged but looked into, so the result is that of a full merge.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as T
from .decontaminate import normal_words
from .shared import written

_WIDTHS = (np.dtype(np.uint8), np.dtype(np.uint16), np.dtype(np.uint32))


@dataclass(frozen=True)
class SearchRules:
    best: int = 20
    #: Bytes of text for one shard, or one document if that is longer.
    shard_bytes: int = 8 << 20
    #: Postings of a block.
    block: int = 1024
    #: Terms of the queries that are searched for in one pass over the index.
    pass_terms: int = 200_000
    #: How much of 100 in a document's m goes by its length.
    flat: int = 25


# --- postings -------------------------------------------------------------------------------------------------------------


def _narrowest(values: np.ndarray) -> int:
    top = int(values.max()) if len(values) else 0
    return 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2


def pack(places: np.ndarray, counts: np.ndarray, block: int) -> bytes:
    """Blocks of: first place (4 bytes), widths (1), differences of the other places, occurrences."""
    out = []
    for a in range(0, len(places), block):
        own, n = places[a : a + block], counts[a : a + block]
        steps = np.diff(own)
        w, v = _narrowest(steps), _narrowest(n)
        out += [int(own[0]).to_bytes(4, "little"), bytes([w | v << 2]), steps.astype(_WIDTHS[w]).tobytes(), n.astype(_WIDTHS[v]).tobytes()]
    return b"".join(out)


class Postings:
    """A packed list, decoded block by block."""

    def __init__(self, data: bytes, n: int, block: int):
        self.data, self.left, self.block, self.at = data, n, block, 0

    def head(self) -> int:
        """The first place of the next block; -1 if there is none."""
        return int.from_bytes(self.data[self.at : self.at + 4], "little") if self.left else -1

    def next(self) -> tuple[np.ndarray, np.ndarray]:
        n = min(self.left, self.block)
        w, v = _WIDTHS[self.data[self.at + 4] & 3], _WIDTHS[self.data[self.at + 4] >> 2]
        places = np.empty(n, np.int64)
        places[0] = self.head()
        at = self.at + 5
        places[1:] = np.frombuffer(self.data, w, n - 1, at)
        np.cumsum(places, out=places)
        at += (n - 1) * w.itemsize
        counts = np.frombuffer(self.data, v, n, at).astype(np.int64)
        self.at, self.left = at + n * v.itemsize, self.left - n
        return places, counts

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        got = []
        while self.left:
            got.append(self.next())
        return (got[0] if len(got) == 1 else tuple(map(np.concatenate, zip(*got)))) if got else (np.zeros(0, np.int64),) * 2


# --- the index ------------------------------------------------------------------------------------------------------------

#: The row of the empty term is the shard's directory: ids and lengths of its documents, eight bytes each, by place.
INDEX = "shard long, term string, df long, most long, shortest long, postings binary, lengths binary, no_id long"


def _shard(number: int, ids: list[int | None], words: list[list[int]], vocabulary: dict[bytes, int], rules: SearchRules) -> Iterator[pa.RecordBatch]:
    """Rows of ``INDEX`` for documents given as lists of numbers of their terms."""
    n = len(ids)
    order = np.array(sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sizes = np.array([len(w) for w in words], np.int64)
    lengths = sizes[order]
    flat = np.fromiter((t for w in words for t in w), np.int64, int(sizes.sum()))
    pairs, counts = np.unique(flat * n + np.repeat(place, sizes), return_counts=True)
    term, where = pairs // n, pairs % n
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(term), 1), bool), term[1:] != term[:-1]]))
    ends = np.append(starts[1:], len(term)).tolist()
    cols: dict[str, list] = {c.split()[0]: [] for c in INDEX.split(", ")}
    most = np.maximum.reduceat(counts, starts).tolist() if len(starts) else []
    shortest = np.minimum.reduceat(lengths[where], starts).tolist() if len(starts) else []
    named = sorted(vocabulary, key=vocabulary.get)
    for (a, b), m, s in zip(zip(starts.tolist(), ends), most, shortest):
        for c, v in zip(cols, (number, named[term[a]].decode(), b - a, m, s, pack(where[a:b], counts[a:b], rules.block), None, None)):
            cols[c].append(v)
    missing = sum(x is None for x in ids)
    known = np.array([ids[i] or 0 for i in order], np.int64)
    for c, v in zip(cols, (number, "", n, int((sizes > 0).sum()), int(sizes.sum()), known.tobytes(), lengths.tobytes(), missing)):
        cols[c].append(v)
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    whole = pa.RecordBatch.from_arrays([pa.array(cols[c.split()[0]], types[c.split()[1]]) for c in INDEX.split(", ")], names=list(cols))
    for a in range(0, whole.num_rows, 20_000):
        yield whole.slice(a, 20_000)


def build_index(docs: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """The index of ``doc_id, text``, written: rows of ``INDEX``.

    Tasks index what they read, ``shard_bytes`` of text after each other, so texts are never shuffled and a shard has a
    bound.  Terms are the maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are in lower case, of whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        made, size = 0, 0
        ids, words, vocabulary = [], [], {}
        for batch in batches:
            for piece in T.pieces(batch):
                for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    raw = (text or "").encode()
                    ids.append(doc)
                    words.append([vocabulary.setdefault(w, len(vocabulary)) for w in normal_words(raw)])
                    size += len(raw) + 32
                    if size >= rules.shard_bytes:
                        yield from _shard(first + made, ids, words, vocabulary, rules)
                        made, size = made + 1, 0
                        ids, words, vocabulary = [], [], {}
        if ids:
            yield from _shard(first + made, ids, words, vocabulary, rules)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(run, INDEX), "index")


# --- searching ------------------------------------------------------------------------------------------------------------


@dataclass
class _Totals:
    n: int  # documents with a term
    l: int  # all their terms

    def m(self, lengths: np.ndarray, flat: int) -> np.ndarray:
        return 100 - flat + (flat * lengths * self.n) // max(self.l, 1)


def _impact(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def merged(lists: list[tuple[Postings, int]], m: np.ndarray, flush: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in order and what these lists add to their scores: a k-way merge by a heap of the lists' next blocks."""
    heap = [(p.head(), i) for i, (p, _) in enumerate(lists) if p.left]
    heapq.heapify(heap)
    open_: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    while heap:
        _, i = heap[0]
        postings, weight = lists[i]
        places, counts = postings.next()
        open_.append((places, weight * _impact(counts, m[places])))
        size += len(places)
        if postings.left:
            heapq.heapreplace(heap, (postings.head(), i))
        else:
            heapq.heappop(heap)
        if size >= flush or not heap:
            places, adds = np.concatenate([x[0] for x in open_]), np.concatenate([x[1] for x in open_])
            done = places < heap[0][0] if heap else np.ones(len(places), bool)
            open_, size = [(places[~done], adds[~done])], int((~done).sum())
            places, adds = places[done], adds[done]
            if len(places):
                order = np.argsort(places, kind="stable")
                places, adds = places[order], adds[order]
                starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
                yield places[starts], np.add.reduceat(adds, starts)
            flush = max(4096, 2 * size)


class Best:
    """The best results of a query so far: a heap with the worst first, by score and then by id, no id last."""

    def __init__(self, best: int):
        self.best, self.heap, self.count = best, [], 0

    @property
    def floor(self) -> int:
        return self.heap[0][0] if len(self.heap) == self.best else 1

    def offer(self, score: int, doc: int | None) -> None:
        entry = (score, -math.inf if doc is None else -doc, self.count)
        self.count -= 1
        if len(self.heap) < self.best:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def _search_shard(query: list[tuple[str, int]], terms: dict[str, tuple], ids: np.ndarray, m: np.ndarray, named: int, found: Best, looked: dict[str, tuple], rules: SearchRules) -> None:
    """Offer the documents of one shard; ``query`` has terms and weights (repeats counted in), ``terms`` their rows here,
    ``looked`` the lists of the shard that a query has looked into."""
    lists = []
    for term, weight in query:
        row = terms.get(term)
        if row is not None and weight > 0:
            most, least = np.array([row[1]]), np.array([row[2]])
            lists.append((int(weight * _impact(most, least)[0]), weight, row, term))
    lists.sort(key=lambda x: x[0])
    bounds = np.cumsum([x[0] for x in lists]) if lists else np.zeros(0, np.int64)
    open_ = lambda x: (Postings(x[2][3], x[2][0], rules.block), x[1])
    n_light = int(np.searchsorted(bounds, found.floor, side="left")) if len(found.heap) == rules.best else 0  # sums below the floor
    for places, scores in merged([open_(x) for x in lists[n_light:]], m):
        for i in range(n_light - 1, -1, -1):
            able = scores + bounds[i] >= found.floor
            places, scores = places[able], scores[able]
            if not len(places):
                break
            term = lists[i][3]
            if term not in looked:
                looked[term] = open_(lists[i])[0].whole()
            there, counts = looked[term]
            at = np.searchsorted(there, places).clip(max=len(there) - 1)
            hit = there[at] == places
            scores = scores + np.where(hit, lists[i][1] * _impact(counts[at], m[places]), 0)
        keep = scores >= found.floor
        for place, score in zip(places[keep].tolist(), scores[keep].tolist()):
            if score >= found.floor:
                found.offer(score, int(ids[place]) if place < named else None)


def search(index: DataFrame, queries: DataFrame, rules: SearchRules = SearchRules()) -> DataFrame:
    """The ``best`` documents of each query of ``item_id, text``: ``item_id, rank int, doc_id, score long``.

    ``rank`` is 1, 2, 3 ... by falling score, equal scores by ascending ``doc_id``; documents with no score are not in it.
    A document counts its terms' weights as often as the query has them; the scores are whole numbers, as told in
    ``_impact`` and ``_Totals``.  Rows of the documents that repeat an id are documents of their own, and one without an id
    comes last among ties; null and wordless documents count nowhere and are never found.  Queries without words, or whose
    words are in no document, have no rows; equal queries of one id are one, and different texts of one id are ranked on
    their own.  An empty table on either side gives no rows, and other columns are not looked at.

    Queries go in passes of ``pass_terms`` terms, or one query; each reads only its own terms' postings.
    """
    spark = index.sparkSession
    totals = index.where("term = ''").agg(F.coalesce(F.sum("most"), F.lit(0)).alias("n"), F.coalesce(F.sum("shortest"), F.lit(0)).alias("l")).first()
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    asked = queries.select("item_id", F.col("text").cast("string").alias("text")).distinct().withColumn("words", words).where(F.size("words") > 0)
    asked = written(asked.select("item_id", F.monotonically_increasing_id().alias("number"), "words"), "queries")
    n_terms = asked.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n_passes = max(1, -(-n_terms // rules.pass_terms))
    out = None
    for k in range(n_passes):
        own = asked.where(F.pmod(F.hash("number"), F.lit(n_passes)) == k)
        terms = own.select(F.explode("words").alias("term")).distinct()
        posted = index.join(terms, "term", "left_semi")
        df = {r["term"]: r["df"] for r in posted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the pass's terms at most
        weight = lambda t: math.floor(1000 * math.log((2 * totals["n"] + 2) / (2 * df[t] + 1)))  # noqa: B023, E731
        asks = [(r["number"], sorted((t, q * weight(t)) for t, q in Counter(r["words"]).items() if t in df)) for r in own.toLocalIterator()]
        shared = spark.sparkContext.broadcast(asks)
        rows = posted.unionByName(index.where("term = ''")).repartition("shard").sortWithinPartitions("shard", "term")
        got = rows.mapInArrow(_searcher(shared, _Totals(totals["n"], totals["l"]), rules), "number long, doc_id long, score long")
        out = got if out is None else out.unionByName(got)
    top = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= rules.best)
    return asked.select("item_id", "number").join(ranked, "number").select("item_id", "rank", "doc_id", "score")


def _searcher(shared, totals: _Totals, rules: SearchRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = shared.value
        found = [Best(rules.best) for _ in asks]
        terms: dict[str, tuple] = {}
        shard = directory = None

        def finish() -> None:
            if terms:
                ids, lengths, missing = directory
                m = totals.m(lengths, rules.flat)
                high = np.array([totals.m(np.array([r[2]]), rules.flat)[0] for r in terms.values()])
                here = {t: (r[0], r[1], int(x), r[3]) for (t, r), x in zip(terms.items(), high)}
                looked: dict[str, tuple] = {}
                for (_, query), best in zip(asks, found):
                    _search_shard(query, here, ids, m, len(ids) - missing, best, looked, rules)
                terms.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    finish()
                    shard = r["shard"]
                if r["term"]:
                    terms[r["term"]] = (r["df"], r["most"], r["shortest"], r["postings"])
                else:
                    directory = np.frombuffer(r["postings"], np.int64), np.frombuffer(r["lengths"], np.int64), r["no_id"]
        finish()
        rows = [(number, None if d == -math.inf else -d, s) for (number, _), best in zip(asks, found) for s, d, _ in best.heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["number", "doc_id", "score"])

    return run


SEARCH_SQL = r"""
WITH docs AS (SELECT doc_id, w FROM (SELECT doc_id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents) WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n_all, sum(len(w))::BIGINT AS l_all FROM docs),
held AS (SELECT doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM docs) GROUP BY doc_id, n, term),
terms AS (SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*)::BIGINT AS df FROM held GROUP BY term), totals),
asked AS (SELECT item_id, unnest(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all))))::BIGINT AS score FROM asked JOIN terms USING (term) JOIN held USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
