"""Near-duplicates against brute force on invented texts with families of edited copies."""

import random

import pytest

from maskwork.llm.near_dedup import NearRules, near_duplicates


def brute_force(rows, percent):
    def shingles(text):
        words = (text or "").encode().lower().split()
        if not words:
            return set()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and same and 100 * same >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            comp[find(i)] = min(comp.get(find(i), d), d)
    return {d: (len(sets[i]), comp[find(i)]) for i, (d, _) in enumerate(rows) if d is not None}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, percent):
    rng = random.Random(percent)
    texts = [t for n, words, edits in ((150, 150, 7), (30, 60, 3), (12, 20, 1), (8, 400, 12)) for t in family(rng, n, words, edits)]
    texts += ["", "  ", None, "one two", "ONE  two", "one two three four", texts[0], texts[0].upper()] + [f"lone text number {i} " * 3 for i in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_force(rows, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_duplicates(docs, NearRules(percent=percent, tile=24)).collect()}
    assert len(got) == len(rows)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (4, None, 3), (5, "", 4)], "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 0, 4, True), (5, 0, 5, True)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
