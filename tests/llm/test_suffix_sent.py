"""What runs send one another: packed, no more than repeats need, and in even steps."""

import random

import numpy as np
import pyarrow as pa
import pytest

from maskwork.llm import suffix_dedup as S
from maskwork.llm import textbatch as T
from tests.llm.test_suffix_dedup import brute_force


def a_run(rows, run):
    return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "run": pa.array([run] * len(rows), pa.int32())})


def sent(runs, rules):
    """Bytes of fingerprints, of answers to them, and of suffixes, through one range, and the rows that are returned."""
    prints = [p for t in runs for _, p in S._fingerprints(t, 1, rules)]
    replies = S._repeated(list(range(len(runs))), prints, rules)
    coded = [p for run, t in enumerate(runs) for _, p in S._suffix_runs(t, [0], [x for r, x in replies if r == run], 1, rules)]
    answers = S._smallest_owners(coded, rules) if coded else []
    rows = [tuple(r.values()) for run, t in enumerate(runs) for r in S._removed(t, [x for r, x in answers if r == run], rules, True).to_pylist()]
    return sum(map(len, prints)), sum(len(x) for _, x in replies), sum(map(len, coded)), sorted(rows, key=str)


def some_words(rng, n):
    words = ["the", "whole", "of", "anything", "river", "between", "and", "mountain", "never", "again", "under", "silver", "lantern", "because", "water", "harbour", "every", "small", "winter", "follows"]
    return " ".join(rng.choice(words) for _ in range(n))


def test_common_anchors_without_repeats_send_no_suffixes():
    """Few words: nearly every anchor is in several documents, and hardly any string of 50 bytes."""
    rng, rules = random.Random(2), S.RepeatRules()
    rows = [(i, some_words(rng, 700)) for i in range(30)]
    n_bytes = sum(len(t) for _, t in rows)
    prints, replies, suffixes, got = sent([a_run(rows[:15], 0), a_run(rows[15:], 1)], rules)
    assert got == brute_force(rows, 50)
    assert suffixes < 0.05 * n_bytes and replies < 0.03 * n_bytes and prints < 0.3 * n_bytes


def test_exact_copies_send_nothing_more():
    rng, rules = random.Random(3), S.RepeatRules()
    rows = [(i, some_words(rng, 150)) for i in range(20)] + [(20, "short"), (21, "x" * 50), (22, "")]
    rows += [(100 + i, t) for i, t in rows] + [(None, rows[4][1]), (5, rows[5][1]), (-1, rows[6][1]), (None, "new"), (None, "new")]
    rng.shuffle(rows)
    *_, suffixes, got = sent([a_run(rows, 0)], rules)
    assert got == brute_force(rows, 50) and suffixes < 0.2 * sum(len(t) for _, t in rows) / 2


def test_suffixes_are_packed():
    """Each document has a copy with another beginning in the other run, so that all suffixes are sent, both times."""
    rng, rules = random.Random(4), S.RepeatRules()
    rows = [(i, some_words(rng, 300)) for i in range(40)]
    copies = [(100 + i, some_words(rng, 12) + t) for i, t in rows]
    *_, suffixes, got = sent([a_run(rows, 0), a_run(copies, 1)], rules)
    assert got == brute_force(rows + copies, 50) and suffixes < 1.8 * sum(len(t) for _, t in rows + copies)


def test_an_anchor_is_split_in_all_runs():
    """Most of its surroundings are in one run; the other has few of them, and must split it all the same."""
    rng, rules = random.Random(7), S.RepeatRules(hot=20)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    some = [text(16) for _ in range(20_000)]
    anchor = some[int(np.argmin(T.Hasher(np.frombuffer("".join(some).encode(), np.uint8)).windows(16)[::16]))]
    rows = [(i, text(60) + anchor + text(60)) for i in range(80)]
    others = [(100 + i, text(9) + rows[i][1][26:110] + text(9)) for i in range(2)]
    *_, got = sent([a_run(rows, 0), a_run(others, 1)], rules)
    assert got == brute_force(rows + others, 50)


def test_packed_columns():
    rng = np.random.default_rng(1)
    kinds = [S.RISING, S.BITS, S.BYTES, S.HASHES, S.IDS, S.NUMBERS, S.VALUES]
    for n in (0, 1, 2, 9, 1000, 70_000):
        for top in (1, 3, 2**31 - 1):
            columns = [np.sort(rng.integers(0, top, n)), rng.integers(0, 2, n), rng.integers(0, min(top, 256), n), rng.integers(0, 2**63, n), rng.integers(-top, 2**62, n), rng.integers(0, top, n), rng.integers(0, 2 * top, n)]
            packed = S.pack(columns, kinds)
            assert all(np.array_equal(x, y) for x, y in zip(columns, S.unpack(packed, kinds), strict=True))
    assert len(S.pack([np.full(10_000, 7)] * 2, [S.RISING, S.IDS])) < 200


def test_steps_are_even():
    """With 600 parts and a fan of 512 there were two groups of ranges, and a quarter of all went through one task."""
    assert [S.even_fan(parts, 512) for parts in (1, 512, 513, 2400, 512**2, 512**2 + 1)] == [2, 512, 23, 49, 512, 65]


def test_equal_texts_are_dealt_to_one_run_and_heavy_ones_to_several(spark):
    rng = random.Random(5)
    rows = [(i, some_words(rng, 40)) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows] + [(1000 + i, "again and again") for i in range(900)]
    dealt, n = S._dealt(spark.createDataFrame(rows, "doc_id long, text string"), S.RepeatRules(run_bytes=4000))
    runs = {}
    for r in dealt.collect():
        assert 0 <= r["run"] < n
        runs.setdefault(r["text"], set()).add(r["run"])
    assert n > 4 and len(runs) == 61 and len(runs.pop("again and again")) > 3 and {len(x) for x in runs.values()} == {1}


@pytest.mark.parametrize("rules", [S.RepeatRules(run_bytes=1200, fan=4), S.RepeatRules(run_bytes=1200, fan=4, hot=2)])
def test_copies_over_steps(spark, rules):
    rng = random.Random(6)
    rows = [(i, some_words(rng, rng.randrange(60))) for i in range(50)]
    rows += [(200 + i, rng.choice(rows)[1]) for i in range(30)] + [(300 + i, rows[3][1]) for i in range(40)] + [(None, rows[3][1]), (None, rows[4][1]), (None, None), (2, rows[40][1])]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rules, digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows, 50)
