"""Importance resampling, lexical search and url rules against plain Python, with odd rows, small blocks and few ranges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as S

from maskwork.llm.importance_resampling import ResampleRules, resample, ring_hashes
from maskwork.llm.lexical_search import Postings, SearchRules, build_index, pack, search
from maskwork.llm.url_rules import UrlRules, judge_urls, ranges_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n", "Word", "é—ñ Ü1", "\x00a\x00b", "x" * 60_000, "one two " * 30_000]


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def odd_docs(spark, texts=()):
    rows = [(i, t, i, "mine") for i, t in enumerate([*ODD, *texts])] + [(None, "one two three", 1, None), (3, "twice two", 2, "b"), (3, "twice two", 2, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, score long, `a.b` string")


def features(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected_draw(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)}
    rows = []
    for d, x in docs:
        f = features(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, len(words_of(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = able[: percent * len(able) // 100]
    return sorted((r[0] is None, r[0] or 0, *r[2:]) for r in rows), [(r[4], r[0]) for r in drawn]


def test_ring_hashes_are_those_of_joined_words():
    words = [w.encode() for w in "a bb ccc é ñ f".split()]
    for orders in (1, 2, 3, 5):
        want = Counter(zlib.crc32(b" ".join(words[i : i + n])) for n in range(1, orders + 1) for i in range(len(words) - n + 1))
        assert Counter(ring_hashes(words, orders)) == want
        ring = []
        assert Counter(ring_hashes(words[:2], orders, ring) + ring_hashes(words[2:], orders, ring)) == want


def test_draw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    want, drawn = expected_draw([tuple(r) for r in docs.collect()], [r["text"] for r in target.collect()], percent=30)
    got = resample(docs.repartition(7), target, ResampleRules(percent=30, flush_words=7)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_features"], r["weight"], r["score"]) for r in got) == want
    assert len(drawn) > 30 and [(r["score"], r["doc_id"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_draw_of_odd_tables(spark):
    docs = odd_docs(spark)
    out = resample(docs, docs.limit(0), ResampleRules(percent=100, least_words=1))
    assert out.columns == ["doc_id", "a.b", "n_words", "n_features", "weight", "score", "rank"]
    rows = out.collect()
    assert len(rows) == len(ODD) + 3 and sorted(r["rank"] for r in rows if r["n_words"]) == list(range(1, len(ODD) + 1))
    assert all(r["weight"] == 0 and r["n_features"] == 0 and r["rank"] is None for r in rows if not r["n_words"])
    assert {r["a.b"] for r in rows} == {"mine", None, "b"}
    assert resample(docs.limit(0), docs).count() == 0
    same = spark.range(300).select(F.lit(1).alias("doc_id"), F.lit("a b c " * 9).alias("text"))  # all of one key: no rank twice
    assert sorted(r["rank"] for r in resample(same, docs, ResampleRules(percent=50)).collect() if r["rank"]) == list(range(1, 151))


def expected_hits(docs, items, best=20):
    held = [(d, Counter(words_of(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_all, l_all = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        query = Counter(w for w in words_of(text) if w in df)
        scored = []
        for d, c in held:
            m = 75 + 25 * c.total() * n_all // l_all
            score = sum(q * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in query.items() if c[t])
            if score > 0:
                scored.append((-score, math.inf if d is None else d))
        out += [(item, i + 1, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def test_postings_round_trip():
    rng = np.random.default_rng(3)
    for top, n in ((3, 1), (300, 40), (70_000, 900), (90_000_000, 2500), (4_000_000_000, 7)):
        places = np.unique(rng.integers(0, top, n))
        counts = rng.integers(1, 1 + rng.integers(1, 70_000), len(places))
        got = Postings(pack(places, counts, 64), len(places), 64).whole()
        assert (got[0] == places).all() and (got[1] == counts).all()
    assert len(Postings(b"", 0, 64).whole()[0]) == 0


def test_search_equals_brute_force(spark):
    rng = random.Random(4)
    common, rare = ["the", "of", "and", "Is"], [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(common, k=rng.randrange(1, 30)) + rng.choices(rare, k=rng.randrange(0, 6))) for _ in range(700)] + ["the same words w1"] * 40
    docs = odd_docs(spark, texts)
    items = [(i, " ".join(rng.choices(common, k=6) + rng.choices(rare, k=4))) for i in range(12)] + [(90, None), (91, ""), (92, "unknownword"), (93, "w1 w1 the"), (None, "w2 of"), (94, "one TWO é")]
    queries = spark.createDataFrame([(i, t, 1) for i, t in items] + [(93, "w1 w1 the", 1)], "item_id long, text string, rank int")
    want = expected_hits([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    for rules in (SearchRules(), SearchRules(shard_bytes=3000, block=8), SearchRules(shard_bytes=20_000, pass_terms=40)):
        got = search(build_index(docs.repartition(5), rules), queries, rules)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert search(build_index(docs.limit(0)), queries).count() == 0
    assert search(build_index(docs), queries.limit(0)).count() == 0


def expected_url(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, otherwise))
    return host, path, best[3], best[4]


def test_urls_equal_brute_force(spark):
    rng = random.Random(5)
    labels = ["com", "net", "example", "example-x", "www", "a", "b", "\x00c", "é", "\x01", "EXAMPLE"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randrange(1, 5)))
    path = lambda: "".join("/" + rng.choice(["en", "es", "e", "\uffff", ""]) for _ in range(rng.randrange(0, 4)))
    rules = [(host().lower(), path(), rng.choice(["allow", "block"])) for _ in range(120)] + [("", "/en/es", "block"), ("com", "", "block"), ("com", "", "allow")]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q=/en', '#x://y', '/'])}" for _ in range(1500)] + ["http://hot.example.com/en/1"] * 900 + [f"http://hot.example.com{path()}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "x://?", "http://a.com" + "/en" * 20_000]
    rows = [(i, u, "mine", {"k": 1}) for i, u in enumerate(urls)] + [(3, urls[3], None, None), (None, None, None, None)]
    pages = spark.createDataFrame(rows, S.StructType([S.StructField("page_id", S.LongType()), S.StructField("url", S.StringType()), S.StructField("Host", S.StringType()), S.StructField("m.x", S.MapType(S.StringType(), S.LongType()))]))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(((r[0], *expected_url(r[1], rules)) for r in rows), key=str)
    for settings in (UrlRules(), UrlRules(range_rows=25, sampled=10)):
        out = judge_urls(pages.repartition(6), table, settings)
        assert out.columns == ["page_id", "url", "m.x", "host", "path", "rule", "verdict"]
        assert sorted((tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want
    plain = judge_urls(pages, table.limit(0), UrlRules(otherwise="block")).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in plain] == [(None, "block")]
    assert judge_urls(pages.limit(0), table).count() == 0


def test_rules_go_where_their_urls_can_be():
    cuts = [("com\x00", "/a", 0), ("com\x00", "/c", 5), ("com\x00", "/c", 9), ("com\x00www\x00", "", 1), ("net\x00", "/", 0)]
    assert ranges_of("com\x00", "/b", cuts) == [0, 1, 3, 4]  # the third range has /c alone
    assert ranges_of("com\x00", "/c", cuts) == [0, 1, 2, 3, 4]
    assert ranges_of("net\x00", "/x", cuts) == [4, 5]
    assert ranges_of("", "", cuts) == [0, 1, 2, 3, 4, 5]
