"""The other corpus operators: brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwork.llm import decontaminate as D
from maskwork.llm.bloom_lm import LmRules, about, levels_of, score_texts, train_lm, word_scores
from maskwork.llm.chat_format import escape, format_chats, read_chats, unescape
from maskwork.llm.lang_hyper import HyperRules, _letters, bundle, learn_languages, predict_languages
from maskwork.llm.quality_divergence import DivergenceRules, quality_rules
from maskwork.llm.quality_ordinal import OrdinalRules, fit, score_quality, train
from maskwork.llm.secret_scan import GuessRules, find_secrets, guess_cost, learn_words, scan_secrets
from maskwork.llm.source_mixing import mix_sources

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "\n\t", "word", "é", "x" * 50_000, "a b " * 20_000]


def odd_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, i) for i, t in enumerate(ODD)] + [(None, "same same", None, None, 0), (3, "twice", "en", "s", 0), (3, "twice", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long").withColumn("Score", F.lit(7)).withColumn("_words", F.lit("mine"))


def test_ordinal_classifier(spark):
    rng = random.Random(2)
    good, bad, vile = (["the", "tree", "grows", "slow"], ["###", "buy%%", "now!!", "|"], ["scum", "idiot"])
    rows = []
    for i in range(900):
        grade = i % 3
        words = [rng.choice(good) + str(rng.randrange(50)) for _ in range(30)]
        words += [[rng.choice(vile)], [rng.choice(bad) + str(rng.randrange(9)) for _ in range(8)], []][grade]
        rng.shuffle(words)
        rows.append((i, " ".join(words), grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = train(docs.where("doc_id < 600"), docs.select("doc_id", "grade"))
    assert (np.diff(model.thresholds) > 0).all()
    held = score_quality(docs.where("doc_id >= 600"), model).collect()
    assert np.mean([r["kept"] == (r["grade"] == 2) for r in held]) > 0.95
    by = {g: np.mean([r["expected_grade"] for r in held if r["grade"] == g]) for g in range(3)}
    assert by[0] < by[1] < by[2]
    odd = score_quality(odd_docs(spark), model)
    assert odd.count() == len(ODD) + 3 and odd.columns[-3:] == ["expected_grade", "top_probability", "kept"]
    none = fit([], np.zeros(0, np.int64), OrdinalRules())
    assert score_quality(docs.limit(3), none).count() == 3


def test_ordinal_on_labels(spark):
    """Accuracy of the kept flag on held-out ratings, and rows of repeated ids."""
    folder = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    graded = labels.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1
    got = score_quality(docs.join(graded.where(held), "doc_id"), train(docs, graded.where(~held))).collect()
    right = np.mean([r["kept"] == (r["grade"] == 2) for r in got])
    print(len(got), right, np.mean([r["grade"] == 2 for r in got]))
    assert len(got) > 600 and right > 0.85
    twice = train(docs.unionByName(docs), graded, OrdinalRules(most_labelled=50))
    once = train(docs, graded, OrdinalRules(most_labelled=50, least_documents=2))
    assert len(twice.thresholds) == len(once.thresholds)


def test_ordinal_gradients():
    """One step of the fit moves thresholds and weights along numerical gradients of the likelihood."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(16, 5, replace=False)).astype(np.int32) for _ in range(40)]
    grades = np.array([i % 3 for i in range(40)])

    def likelihood(weights, base, gap):
        t = np.array([base, base + np.exp(gap)])
        value = 1 / 5**0.25
        balance = 40 / (3 * np.bincount(grades))[grades]
        score = np.array([weights[r].sum() * value for r in rows])
        p = 1 / (1 + np.exp(-(score[:, None] - t)))
        full = np.concatenate([np.ones((40, 1)), p, np.zeros((40, 1))], axis=1)
        return float((balance * np.log(full[np.arange(40), grades] - full[np.arange(40), grades + 1])).mean())

    rules = OrdinalRules(bits=4, least_documents=1, rounds=1, step=1e-3, decay=0.0)
    model, eps, zero = fit(rows, grades, rules), 1e-5, np.zeros(16)
    slope = np.array([(likelihood(zero + eps * (np.arange(16) == i), -1.0, 0.0) - likelihood(zero - eps * (np.arange(16) == i), -1.0, 0.0)) / (2 * eps) for i in range(16)])
    strong = np.abs(slope) > 1e-3
    assert (np.sign(model.weights[strong]) == np.sign(slope[strong])).all() and strong.sum() > 8
    by_base = (likelihood(zero, -1.0 + eps, 0.0) - likelihood(zero, -1.0 - eps, 0.0)) / (2 * eps)
    by_gap = (likelihood(zero, -1.0, eps) - likelihood(zero, -1.0, -eps)) / (2 * eps)
    assert np.sign(model.thresholds[0] + 1.0) == np.sign(by_base) and np.sign(np.diff(model.thresholds)[0] - 1.0) == np.sign(by_gap)


def test_mixing(spark):
    rows = [(i, "a" if i < 9000 else "b" if i < 9900 else None) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("copy_no", F.lit("old"))
    got = mix_sources(docs)
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(counts) == {"a", "b", None} and all(abs(n - 10_000 / 3) < 300 for n in counts.values())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mix_sources(docs, most_sources=1).collect()))
    given = mix_sources(docs, {"a": 3, "b": 1}, size=0.5)
    counts = {r["source"]: r["count"] for r in given.groupBy("source").count().collect()}
    assert set(counts) == {"a", "b"} and abs(counts["a"] - 3750) < 250 and abs(counts["b"] - 1250) < 150
    pairs = given.groupBy("doc_id").agg(F.max("copy_no").alias("m"), F.count("*").alias("n"), F.max("n_copies").alias("c")).where("m != n OR n != c")
    assert pairs.count() == 0
    odd = mix_sources(odd_docs(spark))
    assert "_words" in odd.columns and {r["_words"] for r in odd.collect()} <= {"mine"}
    assert mix_sources(docs.limit(0)).count() == 0


def test_poisson_spread(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"))
    n = Counter(r["n_copies"] for r in mix_sources(docs, size=2.5).select("doc_id", "n_copies").distinct().collect())
    for k in range(1, 7):
        want = 20_000 * math.exp(-2.5) * 2.5**k / math.factorial(k)
        assert abs(n[k] - want) < 5 * math.sqrt(want)


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["</s>", "[INST]", "[/INST]", "<|im_end|>\n", "<|seg|>", "\\", "<", "|", "\\<", "ok", " ", "\n", "é", "<<SYS>>", "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "a\nb\\", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(8))])) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(None, 1, "user", "x"), (99, None, "assistant", "y"), (99, 2, "assistant", "z"), (99, 2, "assistant", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in read_chats(format_chats(turns)).collect()}
    low = lambda x: (x is not None, x)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (low(r[1]), low(r[2]), low(r[3])))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c]["loss_text"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        for control in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert control not in got[c]["formatted"]
    assert format_chats(turns.limit(0)).count() == 0
    texts = spark.createDataFrame([(t,) for t in ["\\", "\\\\<|", "</s>\\", "$0\\1"]], "t string")
    assert texts.where(unescape(escape(F.col("t"))) != F.col("t")).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    got = predict_languages(docs.where("held"), learn_languages(docs.where("NOT held"))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)
    odd = predict_languages(odd_docs(spark), learn_languages(docs)).collect()
    assert {r["lang_pred"] for r in odd if r["text"] is None or not re.search(r"[^\W\d_]", r["text"])} == {"und"}
    assert {r["lang_pred"] for r in predict_languages(odd_docs(spark), learn_languages(docs.limit(0))).collect()} == {"und"}
    few = HyperRules(block=1)
    rows = lambda rules: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 5)) for r in predict_languages(docs, learn_languages(docs.where("NOT held"), rules), rules).collect())
    assert rows(few) == rows(HyperRules())


def test_cosines_by_hand():
    """The vector of a text, letter by letter."""
    rules = HyperRules(dimensions=64)
    slots, vectors = _letters(rules)
    for text in ("ab", "The tree, a tree!", "é1é"):
        want, letters = np.zeros(64), [int(slots[ord(c)]) for c in f" {text} "]
        letters = [x for i, x in enumerate(letters) if x or not i or letters[i - 1]]
        for a, b, c in zip(letters, letters[1:], letters[2:]):
            if a or b or c:
                want += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
        assert np.allclose(bundle([text], rules)[0], want)


@pytest.mark.parametrize("block", [100_000, 30])
def test_decontamination(spark, block):
    rng = random.Random(9)
    word = lambda: rng.choice(["Ab", "cd", "éf", "g1", "H"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 12, 25, 10, 0, 1, 40])] + [(7, None), (1, "cd g1")]
    rows = [(i, "  ,".join([word() for _ in range(20)] + rng.choice([[], items[2][1].split()[3:16], [items[0][1]], [items[6][1].upper()]]) + [word()])) for i in range(60)] + [(60, None), (61, ""), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_hit", F.lit("x"))
    got = D.benchmark_hits(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect()
    windows = {}
    for i, t in items:
        w = D.normal_words((t or "").encode())
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    want = []
    for d, t in rows:
        w = D.normal_words((t or "").encode())
        hit, own = set(), set()
        for win, owners in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    own |= owners
        want.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == sorted(want)
    for r in got:
        inside = [w for s in r["hit_spans"] for w in D.normal_words(r["text"][s["start"] : s["end"]].encode())]
        assert len(inside) == r["n_hit"] and r["contaminated"] == (r["n_hit"] > 0)


def base_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_quality_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality_rules(docs).collect()
    assert len(got) == 200
    for r in got:
        assert tuple(r[c] for c in names) == base_figures(r["text"])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fine = [r for r in got if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    junk = [r for r in got if labels.get(r["doc_id"]) == 0]
    assert all(r["kept"] for r in fine) and np.mean([r["kept"] for r in junk]) < 0.3
    odd = quality_rules(odd_docs(spark))
    assert odd.columns == ["doc_id", "text", "lang", "source", "Score", "_words", *names, "class_distance", "word_distance", "kept"]
    for r in odd.collect():
        assert tuple(r[c] for c in names) == base_figures(r["text"]) and r["_words"] == "mine"
    few = DivergenceRules(most_languages=1, salts=3)
    both = [sorted(map(str, quality_rules(docs, x).select("doc_id", "kept", "word_distance").collect())) for x in (few, DivergenceRules())]
    assert both[0] == both[1]
    assert quality_rules(docs.limit(0)).count() == 0


def test_guess_costs():
    strong = ["kX9#vLq2Zp", "f8a03bc1d97e45", "Tr0ub4dor&3xyzQ"]
    weak = ["password123", "qwertyuiop", "aaaaaaaaaaaa", "2024-01-31", "abcdefgh", "required", "iloveyou1"]
    assert min(map(guess_cost, strong)) > max(map(guess_cost, weak))
    assert guess_cost("") == 0 and guess_cost("ab" * 20_000) < 12


def test_guess_cost_is_least():
    """The program's sum is that of the best cut among all cuts."""
    from maskwork.llm.secret_scan import GuessRules

    rules = GuessRules(words=("ab", "cab", "b"), part_cost=0.25)
    for v in ("cabx", "abab", "xaby", "bcab"):
        n, each = len(v), math.log10(26)

        def part(s):
            out = [len(s) * each] + ([math.log10(rules.words.index(s) + 2)] if s in rules.words and len(s) > 1 else [])
            return min(out + ([2 * each + math.log10(2)] if s == "abab" else []))

        cuts = [[0, *[i for i in range(1, n) if mask >> i & 1], n] for mask in range(0, 1 << n, 2)]
        want = min(sum(part(v[a:b]) for a, b in zip(c, c[1:])) + 0.25 * (len(c) - 2) for c in cuts)
        assert abs(guess_cost(v, rules) - want) < 1e-9


def test_guess_costs_with_a_lexicon():
    learned = replace(GuessRules(), words=(*GuessRules().words, "complicated", "generated"))
    for weak in ("complicated", "P@ssw0rd", "letmein2024", "Jan2024!", "01021999abc"):
        assert guess_cost(weak, learned) < 9 < guess_cost("kX9#vLq2Zp", learned)


def test_prose_is_left_alone():
    for text in ("The token is generated by the server.", "The secret is understanding your readers", "Her password was forgotten yesterday", "the secret is state-of-the-art work", "The auth token is invalidated-on-logout then", "their passwords are Überflüssig"):
        assert find_secrets(text) == [], text
    assert [s[0] for s in find_secrets("the password is TrustNo1forever")] == ["guess"]


def test_secret_base_over_documents(spark):
    """Base spans of whole documents against plain regular expressions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rules = learn_words(docs)
    assert len(rules.words) > len(GuessRules().words) and rules.words[: len(GuessRules().words)] == GuessRules().words
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    for r in scan_secrets(docs, rules).collect():
        want = [(m.start(), i, m.end()) for i, (_, p, g, least) in enumerate(kinds) for m in p.finditer(r["text"] or "") if len(m[g]) >= least]
        got = [(s["start"], [k for k, *_ in kinds].index(s["kind"]), s["end"]) for s in r["secrets"] if s["kind"] != "guess"]
        assert got == sorted(want)


def test_callers_columns_stay(spark):
    """Dots, upper case and names that operators use inside do no harm."""
    docs = odd_docs(spark).drop("kept", "Score").withColumn("a.b", F.lit(1)).withColumn("TEXT2", F.lit("x")).withColumn("_hits", F.lit(2)).withColumn("_known", F.lit(3)).withColumn("_items", F.lit(4))
    bench = spark.createDataFrame([(1, "a b a b a b a b a b a b")], "item_id long, text string")
    model = train(docs, docs.select("doc_id", F.lit(1).alias("grade")))
    for out in (
        D.benchmark_hits(docs, bench, block_words=3),
        scan_secrets(docs),
        predict_languages(docs, learn_languages(docs)),
        score_texts(docs, train_lm(docs)),
        score_quality(docs, model),
    ):
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert len(rows) == len(ODD) + 3 and all((r["a.b"], r["_hits"], r["_known"], r["_items"]) == (1, 2, 3, 4) for r in rows)


def test_secret_scan(spark):
    key = "AKIA" + "Z9Y8X7W6V5U4T3S2"
    texts = ["password=hunter2hunter ok", f"see {key}.", "x" + "0123456789abcdef" * 2 + "g", 'TOKEN: "abcdefgh"', "secret=short", "the password is kX9#vLq2Zp.", "password is required", "é😀 api_key=12345678"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("redacted", F.lit(1))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in scan_secrets(docs).collect()}
    assert got[0] == [("assign", 0, 22)] and got[1] == [("access", 4, 24)] and got[2] == [("hex", 1, 33)] and got[3] == [("assign", 0, 16)]
    assert got[4] == [] and got[5] == [("guess", 16, 26)] and got[6] == [] and got[7] == [("assign", 3, 19)]
    assert scan_secrets(odd_docs(spark)).where("size(secrets) > 0").count() == 0
    assert find_secrets("a" * 100_000 + " token=" + "b" * 100_000)[-1][2] == 200_007


@pytest.mark.parametrize("rules", [LmRules(), LmRules(flush=500, pass_bytes=20_000, part_bytes=6_000, bucket_bytes=8_000, fan=3)])
def test_language_model(spark, rules):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1001, "")], "doc_id long, text string"))
    rows = docs.collect()
    split = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [None]
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    c = Counter(w for r in train for w in split(r["text"]))
    n, v = sum(c.values()), len(c)
    pairs = Counter(x for r in train for w in [split(r["text"])] for x in zip([None, *w], w))
    got = score_texts(docs.withColumn("score", F.lit("x")), train_lm(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2), rules), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        w = split(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
        words = np.array([float(c[x]) for x in w])
        near = word_scores(about(levels_of(words)), about(levels_of(np.array([float(pairs[x]) for x in zip([None, *w], w)]))), np.array([0, len(w)]), n, v, rules.prior)[0]
        assert -1e9 < r["score"] <= 0 and abs(r["score"] - near) < 0.03 * len(w) + 0.5
    seen = [r for r in got if r["n_tokens"] > 50 and r["n_known"] == r["n_tokens"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)
    assert {r["base_score"] for r in score_texts(docs, train_lm(docs.limit(0), rules), rules).where("doc_id = 1001").collect()} == {0.0}


@pytest.mark.parametrize("roles", [["assistant"], ["user", "assistant"]])
def test_long_conversations(spark, roles):
    """Thousands of turns, in one block or in many, and a long text: read back whole, with callers' columns left out."""
    n = 3000
    text = F.when(F.col("turn") == 7, F.repeat(F.lit("wörd <|x "), 20_000)).otherwise(F.concat(F.lit("tûrn </s> "), F.col("turn").cast("string")))
    role = F.element_at(F.array(*map(F.lit, roles)), (F.col("turn") % len(roles) + 1).cast("int"))
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("extra").alias("formatted")).withColumn("role", role).withColumn("text", text)
    chats = format_chats(turns)
    assert chats.columns == ["conv_id", "formatted", "loss_spans"]
    got = read_chats(chats).collect()[0]
    want = sorted((r["turn"], r["role"], r["text"]) for r in turns.collect())
    assert [(t["role"], t["text"]) for t in got["turns"]] == [r[1:] for r in want]
    assert got["loss_text"] == "".join(r[2] for r in want if r[1] == "assistant") and len(got["loss_spans"]) == n // len(roles)
