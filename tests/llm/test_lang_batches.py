"""A text's letter triples are its own, wherever its row stands in a batch."""

import random

import numpy as np

from maskwork.llm.lang_hyper import HyperRules, bundle, learn_languages, predict_languages, triples


def test_rows_in_any_order():
    rng, rules = random.Random(6), HyperRules()
    texts = ["A.", "b", "the old tree", " two  words ", "é", "x1y", None, "", "12", "...", "A.", "ab"]
    alone = [bundle([t], rules)[0] for t in texts]
    for i, t in enumerate(texts):
        assert alone[i].any() == any(c.isalpha() for c in t or "")
    for _ in range(10):
        order = rng.sample(range(len(texts)), len(texts))
        assert np.array_equal(bundle([texts[i] for i in order], rules), np.array([alone[i] for i in order]))
    row, _, counts = triples([" ab ", " ab ", " a "], rules)
    assert [counts[row == i].sum() for i in range(3)] == [2, 2, 1]


def test_texts_of_one_letter(spark):
    known = spark.createDataFrame([(1, "a tree and a house", "en"), (2, "ein Baum", "de"), (3, "é là", "fr")], "doc_id long, text string, lang string")
    model = learn_languages(known)
    rows = [(i, t) for i, t in enumerate(["zz", "A.", "é", None, "12", "a"])]
    for own in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict_languages(spark.createDataFrame(own, "doc_id long, text string").coalesce(1), model).collect()}
        assert got[3] == got[4] == ("und", 0.0)
        assert all(got[i][0] != "und" for i in (0, 1, 2, 5)) and got[1] == got[5] and got[1][0] == "en" and got[2][0] == "fr"
