"""The ordinal classifier against plain Python: features, the fit by numerical gradients, and what is said of each text."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from maskwork.llm import textbatch as T
from maskwork.llm.quality_ordinal import OrdinalRules, fit, score_quality, train

SF = "/root/testdata/sf0.001"
FULL = (1 << 64) - 1


def spread(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


VALUES = [spread(i * 0x9E3779B97F4A7C15 & FULL) for i in range(1, 257)]


def hashed(data):
    total, power = 0, 1
    for b in data:
        total, power = total + VALUES[b] * power & FULL, power * int(T._BASE) & FULL
    return spread(total)


def kind(b):
    c = chr(b)
    return 1 if b >= 128 or "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if c.isdigit() else 4 if c in ".,;:!?'\"()-" else 5 if c == "|" else 6


def slots(text, bits):
    out = set()
    for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()):
        if w:
            kinds = [kind(b) for b in w]
            runs = bytes(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k)
            out |= {hashed(w.lower()) >> (64 - bits), spread(hashed(runs) ^ 0xA5A5A5A5) >> (64 - bits)}
    return out


def test_scores_of_every_document(spark):
    odd = spark.createDataFrame([(None, None), (9_000_001, ""), (9_000_002, " \n"), (9_000_003, "É1|x #A")], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd)
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    rules = OrdinalRules()
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", grade.alias("grade")), rules)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    weights = model.weights.astype(np.float32)
    got = score_quality(docs, model, rules).collect()
    assert len(got) == docs.count()
    for r in got:
        used = [float(weights[i]) for i in slots(r["text"], rules.bits) if weights[i] != 0]
        score = sum(used) / max(len(used), 1) ** 0.25
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert abs(r["expected_grade"] - sum(above)) < 1e-6 and abs(r["top_probability"] - above[1]) < 1e-6
        assert r["kept"] == (r["top_probability"] >= rules.least_top_probability)


def test_fit_by_numerical_gradients():
    """Ten steps of the fit are those of AdaGrad on the balanced likelihood, whose gradients are here taken by differences."""
    rng = random.Random(6)
    bits, n, rounds = 3, 30, 10
    rows = [sorted(rng.sample(range(1 << bits), rng.randrange(1, 6))) for _ in range(n)]
    grades = [i % 3 for i in range(n)]
    rules = OrdinalRules(bits=bits, least_documents=1, rounds=rounds, step=0.1, decay=0.01)

    def objective(p):
        weights, cuts = p[: 1 << bits], (p[-2], p[-2] + math.exp(p[-1]))
        total = 0.0
        for r, g in zip(rows, grades):
            score = sum(weights[i] for i in r) / len(r) ** 0.25
            above = [1.0, *[1 / (1 + math.exp(t - score)) for t in cuts], 0.0]
            total += math.log(above[g] - above[g + 1]) * n / (3 * grades.count(g))
        return total / n - rules.decay / 2 * sum(w * w for w in weights)

    p, seen = [0.0] * (1 << bits) + [-1.0, 0.0], [1e-8] * ((1 << bits) + 2)
    for _ in range(rounds):
        slope = []
        for i in range(len(p)):
            up, down = p.copy(), p.copy()
            up[i], down[i] = p[i] + 1e-5, p[i] - 1e-5
            slope.append((objective(up) - objective(down)) / 2e-5)
        seen = [s + g * g for s, g in zip(seen, slope)]
        p = [x + rules.step * g / math.sqrt(s) for x, g, s in zip(p, slope, seen)]
    model = fit([np.array(r, np.int32) for r in rows], np.array(grades), rules)
    assert np.allclose(model.weights, p[: 1 << bits], atol=1e-4)
    assert np.allclose(model.thresholds, [p[-2], p[-2] + math.exp(p[-1])], atol=1e-4)
