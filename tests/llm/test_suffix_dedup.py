"""Repeated byte strings against brute force, and the merge against sorting."""

import hashlib
import random

import pytest

from maskwork.llm.suffix_dedup import FrontCoded, RepeatRules, merge_runs, remove_repeats


def brute_force(rows, n):
    first = {}
    key = lambda d: 2**63 - 1 if d is None else d
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            first[s] = min(first.get(s, 2**63), key(d))
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < key(d):
                gone[i : i + n] = [True] * n
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdeé \n\x00") for _ in range(n))
    shared = [text(60) for _ in range(6)] + [text(49), text(50), "a" * 300, "ab" * 90, "\x00" * 70]
    rows = [(i, text(rng.randrange(80)) + rng.choice(shared) + text(rng.randrange(60)) + rng.choice(shared)) for i in range(120)]
    rows += [(None, shared[0]), (None, shared[1] * 2), (7, shared[2]), (7, shared[2]), (500, None), (501, ""), (502, "short"), (-3, shared[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("doc_id", "text", "doc_id AS kept")
    got = remove_repeats(docs, RepeatRules(run_bytes=2000), digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows, 50)
    assert remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rules", [RepeatRules(run_bytes=1500, fan=3), RepeatRules(run_bytes=1500, hot=3), RepeatRules(run_bytes=900, fan=2, hot=1)])
def test_steps_of_merging_and_split_anchors(spark, rules):
    """The same rows whatever the steps of the exchange, and with a passage in every document, in other surroundings each time."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [text(70), text(55), "Licensed text 16", "z" * 40, "q" * 130]
    rows = [(i, text(rng.randrange(60)) + shared[2] + text(rng.randrange(6)) + rng.choice(shared) + text(9)) for i in range(90)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:12])] + [(None, rows[3][1]), (5, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in remove_repeats(docs, rules, digest=True).collect()), key=str) == brute_force(rows, 50)


def test_spans_and_rest(spark):
    a = "x1y2z3" * 10
    docs = spark.createDataFrame([(1, a), (2, "é" + a + "end")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert bytes(got[1]["kept"]) == a.encode() and bytes(got[2]["kept"]) == "éend".encode()
    assert [(s["start"], s["end"]) for s in got[2]["spans"]] == [(2, 62)]


def front_coded(texts):
    shared, before = [], b""
    for t in texts:
        n = 0
        while n < min(len(t), len(before)) and t[n] == before[n]:
            n += 1
        shared.append(n)
        before = t
    return FrontCoded(bytes(shared), bytes(map(len, texts)), b"".join(t[n:] for t, n in zip(texts, shared)))


def test_merge_is_a_sort_with_common_prefixes():
    rng = random.Random(1)
    for n_runs in (0, 1, 2, 3, 7, 16):
        runs = [sorted(bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 30))) for _ in range(n_runs)]
        out = list(merge_runs([front_coded(r) for r in runs]))
        texts = [runs[i][j] for i, j, _ in out]
        assert texts == sorted(t for r in runs for t in r)
        for before, now, (_, _, shared) in zip([b"", *texts], texts, out):
            n = 0
            while n < min(len(before), len(now)) and before[n] == now[n]:
                n += 1
            assert shared == n
