"""Segments of anchors do not depend on the order in which a run's rows arrive."""

import random

import numpy as np
import pyarrow as pa

from maskwork.llm import suffix_dedup as S
from maskwork.llm import textbatch as T
from tests.llm.test_suffix_dedup import brute_force


def some_rows(rng):
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    shared = [text(n) for n in (50, 51, 60, 70, 84, 120, 300)] + ["a" * 200, "xy" * 80]
    return [(i, text(rng.randrange(60)) + rng.choice(shared) + text(rng.randrange(40)) + rng.choice(shared)) for i in range(60)] + [(60, ""), (61, "short")]


def a_table(rows):
    return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "run": pa.array([0] * len(rows), pa.int32())})


def by_document(rows, rules):
    data, offsets = T.buffers(pa.array([t for _, t in rows], pa.large_string()))
    a = S.find_anchors(data, offsets, rules)
    ids = np.array([d for d, _ in rows])
    return sorted(zip(ids[a.row].tolist(), (a.at - offsets[a.row]).tolist(), (a.first - offsets[a.row]).tolist(), (a.last - offsets[a.row]).tolist(), a.fingerprint.tolist(), a.segment.tolist()))


def test_segments_in_any_order(monkeypatch):
    rng, rules = random.Random(3), S.RepeatRules()
    rows = some_rows(rng)
    whole = by_document(rows, rules)  # in one step
    for step in (1, 16, 64, 97, 1000):
        monkeypatch.setattr(S, "STEP", step)
        for _ in range(3):
            assert by_document(rng.sample(rows, len(rows)), rules) == whole
    assert by_document([(0, "x" * 49)], rules) == [] and by_document([], rules) == []


def test_rows_in_another_order_in_each_read(monkeypatch):
    rng, rules = random.Random(4), S.RepeatRules()
    rows = some_rows(rng)
    monkeypatch.setattr(S, "STEP", 64)
    for _ in range(4):
        shuffled = lambda: a_table(rng.sample(rows, len(rows)))
        prints = S._fingerprints(shuffled(), 1, rules)
        repeated = S._repeated([0], [x for _, x in prints], rules)
        blocks = S._suffix_runs(shuffled(), [0], [x for _, x in repeated], 1, rules)
        answers = S._smallest_owners([x for _, x in blocks], rules)
        got = S._removed(shuffled(), [x for _, x in answers], rules, True).to_pylist()
        assert sorted((tuple(r.values()) for r in got), key=str) == brute_force(rows, 50)
