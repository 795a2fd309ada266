"""Benchmark decontamination with Aho-Corasick automata over normalised test items.

A text is normalised to its words in lower case, and each word to its number among the items' words (0 if it is none).  The
patterns are the windows of consecutive item words, so an edge of the automaton is a word.  One scan of the numbers finds
them all; the words' places in the original come from the same pass over the bytes.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .columns import head_of, set_aside
from .shared import discard, written

#: Every byte that is no word byte: words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are in lower case.
GAPS = np.zeros(256, bool)
GAPS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
NORMAL = bytes(0x20 if GAPS[b] else b for b in T.LOWER.tolist())


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def item_windows(items: list[tuple[str, str]], size: int) -> dict[bytes, set[str]]:
    """The items that have each window, by its words; an item of fewer words than ``size`` is one window."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        words = normal_words((text or "").encode())
        for i in range(max(1, len(words) - size + 1) if words else 0):
            found[b" ".join(words[i : i + size])].add(item)
    return found


def build_automaton(windows: dict[bytes, set[str]]) -> bytes:
    """A pickled triple: the automaton, whose values are (words, item numbers), the words' numbers, and the items by number."""
    items = sorted(set().union(*windows.values())) if windows else []
    number, vocabulary = {x: i for i, x in enumerate(items)}, {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, owners in windows.items():
        words = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in window.split(b" "))
        automaton.add_word(words, (len(words), tuple(sorted(number[x] for x in owners))))
    if windows:
        automaton.make_automaton()
    return pickle.dumps((automaton, vocabulary, items))


def _scan(text: str, automaton, vocabulary: dict[bytes, int], items: list[str]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit ranges of words, items."""
    words = normal_words(text.encode())
    if not words or not len(automaton):
        return len(words), [], set()
    hits, found = [], set()
    for last, (n, owners) in automaton.iter(tuple(vocabulary.get(w, 0) for w in words)):
        hits.append((last - n + 1, last + 1))
        found.update(owners)
    return len(words), hits, {items[i] for i in found}


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


STATE = {"_words": pa.int64(), "_hits": pa.list_(pa.int64()), "_items": pa.list_(pa.string())}
MADE = {
    "n_words": pa.int64(),
    "n_hit": pa.int64(),
    "n_items": pa.int64(),
    "items": pa.list_(pa.string()),
    "items_sha256": pa.string(),
    "contaminated": pa.bool_(),
    "hit_spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
}
STATE_SCHEMA = "_words long, _hits array<long>, _items array<string>"
MADE_SCHEMA = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, hit_spans array<struct<start:int,end:int>>"


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_words: int = 100_000) -> DataFrame:
    """Find benchmark windows in every document.

    Keeps the columns of ``docs``, whatever their names (those that are made here are replaced), and adds ``n_words, n_hit,
    n_items, items array<string>, items_sha256, contaminated, hit_spans array<struct<start int, end int>>``: half-open
    ranges of code points in the original text, from the first to the last word of joined hits.  A null or wordless text
    has no words and no hits; null and wordless items have no windows; repeated items are one.  Item ids are compared as
    strings, and a null id is the string ``null``.  Texts are scanned whole whatever their length.  Rows are neither dropped
    nor repeated; an empty table gives none, and an empty benchmark no hits.

    The automaton is broadcast.  A benchmark of more than ``block_words`` words, and so about as many windows, is dealt to
    blocks of about that size, each of one item at least.  Their passes over the rows follow each other; what one has found
    is written with the rows before the next begins, so no task and no driver holds more than one block.
    """
    spark = docs.sparkSession
    out, names, restored = set_aside(docs, ["text"], list(MADE))
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    n_words = F.regexp_count(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = rows.agg(F.coalesce(F.sum(n_words.cast("long")), F.lit(0))).first()[0]
    n_blocks = int(-(-total // block_words)) or 1
    for k in range(n_blocks):
        block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        shared = spark.sparkContext.broadcast(build_automaton(item_windows([(r.item, r.text) for r in block.toLocalIterator()], size)))
        scanned = _add_hits(out, names, shared, k == 0, k == n_blocks - 1)
        if k < n_blocks - 1:
            before, out = out, written(scanned, "hits")
            shared.destroy()
            if k:
                discard(before)
    return scanned.select(*restored, *MADE)


def _add_hits(docs: DataFrame, names: list[str], shared, first: bool, last: bool) -> DataFrame:
    made = MADE if last else STATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, vocabulary, items = pickle.loads(shared.value)
        for whole in batches:
            for batch in T.pieces(whole):
                cols = {c: [] for c in (*STATE, *MADE)}
                for i, text in enumerate(batch.column("text").to_pylist()):
                    n, hits, found = _scan(text or "", automaton, vocabulary, items)
                    if not first:
                        flat = batch.column("_hits")[i].as_py()
                        hits += list(zip(flat[::2], flat[1::2]))
                        found |= set(batch.column("_items")[i].as_py())
                    hits, found = _union(hits), sorted(found)
                    if not last:
                        values = (n, [x for h in hits for x in h], found)
                    else:
                        values = (n, sum(b - a for a, b in hits), len(found), found, hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hits), _places(text, hits) if hits else [])
                    for c, v in zip(made, values):
                        cols[c].append(v)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(cols[c], t) for c, t in made.items()], names=[*names, *made])

    return docs.mapInArrow(run, f"{head_of(docs.select(*names))}, {MADE_SCHEMA if last else STATE_SCHEMA}")


def _places(text: str, hits: list[tuple[int, int]]) -> list[dict]:
    """Code points of ranges of words in the original text."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = T.words(T.LOWER[data], np.array([0, len(data)]), GAPS)
    point = np.cumsum((data & 0xC0) != 0x80)
    return [{"start": int(point[starts[a]] - 1), "end": int(point[ends[b - 1] - 1])} for a, b in hits]


DECONTAMINATE_SQL = r"""
WITH items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
slices AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item FROM slices JOIN windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
