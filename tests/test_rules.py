"""Rules over tables of cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from maskwork.functions import display, validators as V
from maskwork.operators.registry import RULES
from maskwork.plans.planted import COPIES, NEAR_MISSES, PLANTED
from maskwork.operators.spans import explode_spans, merge_spans, resolve, resolve_rows, with_spans
from maskwork.schemas import CANDIDATE, SPANS

PAIRS = [("", ""), ('"', '"'), ("[", "]"), ("(", ");"), ("= ", "\n"), ("\t", "!?"), ("{'v':'", "'}"), ("«", "»"), ("ends:\n", "\nbegins")]


AWS = next(v for _, label, v in PLANTED if label == "AWS_ACCESS_KEY")
AI = next(v for _, label, v in PLANTED if label == "AI_API_KEY")


def spans_of(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = explode_spans(with_spans(docs, **kw), "id").collect()
    out = {i: [] for i in range(len(texts))}
    for r in rows:
        out[r["id"]].append((r["label"], r["value"], r["start"]))
    return out


def test_planted(spark):
    got = spans_of(spark, [t for t, _, _ in PLANTED])
    assert {label for _, label, _ in PLANTED} == {r.label for r in RULES}
    assert not [(PLANTED[i], got[i]) for i, (t, label, v) in enumerate(PLANTED) if got[i] != [(label, v, t.index(v))]]


def test_near_misses(spark):
    got = spans_of(spark, NEAR_MISSES)
    assert not {NEAR_MISSES[i]: v for i, v in got.items() if v}


def test_any_surroundings(spark):
    """Values that need nothing before or behind them are found between all sorts of characters."""
    free = {"EMAIL", "PHONE", "CREDIT_CARD", "IP_ADDRESS", "AWS_ACCESS_KEY", "MAC_ADDRESS", "IBAN", "GITHUB_TOKEN", "CRYPTO_WALLET", "JWT"}
    cases = [(label, value, f"one {a}{value}{b} two") for _, label, value in PLANTED[::COPIES] if label in free for a, b in PAIRS]
    got = spans_of(spark, [t for _, _, t in cases])
    assert len(cases) > 100 and not [(c, got[i]) for i, c in enumerate(cases) if (c[0], c[1], c[2].index(c[1])) not in got[i]]


@pytest.mark.parametrize("part", range(4))
def test_no_text_kills(spark, part):
    """A megabyte of what makes each rule repeat: no stack runs out, and no rule takes the square of its length."""
    units = ["-eyJaaaaaaaaa.", "token-", "token_a_", "pwd_-", "a.", "_a", "Ab1+" * 16 + "\n", " ", "\u00a0", "token_", "-eyJa", "Aa ", "1 ", "-", "@a", "a:", "<password ", "::", "\"a\\\"", ".", "A", "0"]
    size = 1_000_000
    texts = [u * (size // len(u)) for u in units]
    texts += ["x@" + "a." * 50_000 + "com", "password" + "_a" * 60_000 + "=hunter2x", "-----BEGIN PRIVATE KEY-----\n" + ("Ab1+" * 16 + "\n") * 20_000, "-----BEGIN PRIVATE KEY-----" * 30_000]
    texts += [head + u * (size // len(u)) for head in ("account", "born", "To", "password", "Hi", "bearer", "sk-", "eyJ", "SG.", "glpat-", "http://a:", 'secret="', "<token") for u in (" ", "a", "-")]
    mine = texts[part::4]
    docs = spark.createDataFrame(list(enumerate(mine)), "id int, text string").repartition(4)
    start = time.monotonic()
    assert with_spans(docs).agg(F.count("spans")).first()[0] == len(mine)
    assert time.monotonic() - start < 120


def test_long_values(spark):
    """Values, and what has to stand before them, are found whatever their length."""
    pem = "-----BEGIN PRIVATE KEY-----\n" + ("Ab1+" * 16 + "\n") * 2_000
    kind = "A" * 200 + " PRIVATE KEY"
    closed = f"-----BEGIN {kind}-----\n{'Ab1+' * 16}\n-----END {kind}-----"
    jwt = f"eyJ{'a' * 9_000}.{'b-' * 9_000}.{'c' * 9_000}"
    keys = ["password" + "_a" * 20_000, "password_" + "a" * 70, "password" + "_a" * 40, "api-key-" + "x" * 9_000 + "_id", "token_token_secret_" * 200 + "id", "token__token"]
    texts = ["x@" + "a." * 20_000 + "com", pem, closed, f"is {jwt}, yes", 'token = "' + "a1" * 60_000 + '"']
    got = spans_of(spark, texts + [f"{k}=hunter2x" for k in keys] + [f"{q}{k}{q}: {q}hunter2x{q}" for k in keys for q in "\"'"] + [f"{k}{x}=hunter2x" for k in keys[:2] for x in ("_", "--a", "_-a", "é")])
    assert got[0] == [] and got[1][0][0] == "PRIVATE_KEY" and len(got[1][0][1]) > 120_000 and len(got[4][0][1]) == 120_000
    assert got[2] == [("PRIVATE_KEY", closed, 0)] and got[3] == [("JWT", jwt, 3)]
    n = len(texts)
    assert not [i for i in range(n, n + 3 * len(keys)) if [x[:2] for x in got[i]] != [("PASSWORD_OR_SECRET", "hunter2x")]]
    assert not [got[i] for i in range(n + 3 * len(keys), len(got)) if any(x[0] == "PASSWORD_OR_SECRET" for x in got[i])]


def test_many_matches(spark):
    text = " ".join(f"a{i}@b{i}.org" for i in range(12_000))
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    with_spans(docs, categories=["contact"]).agg(F.sum(F.size("spans"))).first()
    start = time.monotonic()
    assert with_spans(docs, categories=["contact"]).agg(F.sum(F.size("spans"))).first()[0] == 12_000
    assert time.monotonic() - start < 15


def test_categories_terms_and_offsets(spark):
    text = f"mail a@b.com key {AWS}"
    assert [x[0] for x in spans_of(spark, [text], categories=["secrets"])[0]] == ["AWS_ACCESS_KEY"]
    assert [x[0] for x in spans_of(spark, [text], categories=["contact"])[0]] == ["EMAIL"]
    assert spans_of(spark, ["Project FALCON start"], categories=["secrets"], custom_terms=["project falcon"])[0] == [("CUSTOM", "Project FALCON", 0)]
    assert len(spans_of(spark, [f"OPENAI_API_KEY={AI}"])[0]) == 1
    assert spans_of(spark, ["é😀 a@b.com x c@d.org"])[0] == [("EMAIL", "a@b.com", 3), ("EMAIL", "c@d.org", 13)]


def check(spark, column, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "fn, good, bad",
    [
        (V.luhn_ok, ["4111111111111111", "4111-1111-1111-1111"], ["4111111111111112", "0000000000000000", "411111"]),
        (V.iban_ok, ["DE89 3704 0044 0532 0130 00", "gb82west12345698765432"], ["DE89 3704 0044 0532 0130 01", "DE89"]),
        (V.looks_random, ["x9Kq2LmZ7vB4nR8tW1yP3sD6"], ["aaaaaaaaaaaaaaaaaaaaaaaa", "x9Kq2", ""]),
        (V.ipv6_ok, ["::1", "fe80::1ff:fe23:4567:890a", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "fe80::1%eth0"], ["12:30:45", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7", "::ffff:1.2.3.400"]),
        (V.ipv4_ok, ["1.2.3.4", "255.255.255.255"], ["0.0.0.0", "256.1.1.1", "01.2.3.4", "1.2.3"]),
        (V.ssn_ok, ["219-09-9999"], ["000-12-3456", "666-12-3456", "900-12-3456", "219-00-9999", "219-09-0000"]),
        (V.basic_auth_ok, ["QWxhZGRpbjpvcGVuIHNlc2FtZQ=="], ["QWxhZGRpbg==", "abc"]),
        (V.valid_domain, ["example.co.uk", "x-y.org"], ["example", "a..b", "-a.com", "a.c"]),
        (V.secret_value_ok, ["hunter2"], ["https://x", "${VAR}", "****", "None", "<x>", ""]),
        (V.nanp_phone_ok, ["4155550132"], ["1155550132", "2222222222"]),
    ],
)
def test_validators(spark, fn, good, bad):
    assert check(spark, fn, good) == [True] * len(good)
    assert check(spark, fn, bad) == [False] * len(bad)


def test_display(spark):
    assert check(spark, display.pretty_label, ["AWS_ACCESS_KEY", "GITHUB_TOKEN", "HUGGINGFACE_TOKEN", "EMAIL"]) == ["AWS Access Key", "GitHub Token", "Hugging Face Token", "Email"]
    assert check(spark, display.mask_preview, ["hunter2", "hunter2hunter2", AI, None]) == ["•" * 7, "hu" + "•" * 8, AI[:4] + "•" * 8, ""]
    assert check(spark, V.shannon_entropy, ["", "aaaa", "abab", "abcd"]) == [0.0, 0.0, 1.0, 2.0]


def spans_column(n, first, label, source):
    item = lambda i: F.struct((i * 4 + first).alias("start"), (i * 4 + first + 1).alias("end"), F.lit(label).alias("label"), F.lit("secrets").alias("category"), F.lit(1.0).alias("score"), F.lit(source).alias("source"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), item)


def test_merge_many(spark):
    """12,000 spans and 12,000 others in less than a second, once warm."""
    n = 12_000
    df = spark.range(1).select(spans_column(n, 0, "R", "rule").alias("a"), spans_column(n, 2, "N", "ner").alias("b")).cache()
    merged = df.select(F.size(merge_spans("a", "b")))
    assert df.count() == 1 and merged.first()[0] == 2 * n
    times = []
    for _ in range(3):
        start = time.monotonic()
        assert merged.first()[0] == 2 * n
        times.append(time.monotonic() - start)
    assert min(times) < 1.0, times


@pytest.mark.parametrize("n", [5, 30, 33, 400])
def test_arrays_equal_greedy(spark, n):
    """Settling in arrays, in one go or by islands, and merging, against plain loops."""
    rng = random.Random(n)
    rows = [[(rng.randrange(4), s, s + rng.randrange(1, 9), f"L{i:03d}") for i in range(n) for s in [rng.randrange(6 * n)]] for _ in range(12)]
    span = lambda s, e, label: (s, e, label, "c", 1.0, "rule")
    found = spark.createDataFrame([(k, [(r, s - e, *span(s, e, x)) for r, s, e, x in own], [span(s, e, x) for _, s, e, x in own[::2]], [span(s, e, x) for _, s, e, x in own[1::2]]) for k, own in enumerate(rows)], f"k int, c array<{CANDIDATE}>, a {SPANS}, b {SPANS}")
    for r in found.select("k", resolve("c").alias("resolved"), merge_spans("a", "b").alias("merged")).collect():
        own, kept = rows[r["k"]], []
        clear = lambda s, e, kept: all(e <= a or s >= b for a, b, *_ in kept)
        for _, s, e, x in sorted(own, key=lambda z: (z[0], z[1] - z[2], z[1], z[2], z[3])):
            if clear(s, e, kept):
                kept.append((s, e, x))
        assert [(z["start"], z["end"], z["label"]) for z in r["resolved"]] == sorted(kept)
        kept = [(s, e, x) for _, s, e, x in own[::2]]
        for _, s, e, x in own[1::2]:
            if clear(s, e, kept):
                kept.append((s, e, x))
        assert [(z["start"], z["end"], z["label"]) for z in r["merged"]] == sorted(kept)


def test_islands_equal_greedy(spark):
    rng = random.Random(3)
    rows = [(d, rng.randrange(5), s, s + rng.randrange(1, 9), f"L{i}") for d in range(20) for i in range(40) for s in [rng.randrange(120)]]
    got = {(r["doc"], r["start"], r["end"], r["label"]) for r in resolve_rows(spark.createDataFrame(rows, "doc int, rank int, start int, end int, label string"), ["doc"]).collect()}
    want = set()
    for d in range(20):
        kept = []
        for _, rank, s, e, label in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], r[2] - r[3], r[2], r[3], r[4])):
            if all(e <= a or s >= b for a, b, _ in kept):
                kept.append((s, e, label))
        want |= {(d, *k) for k in kept}
    assert got == want
