"""Geometry, rows, entities, images and streams on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwork.operators import entities as E
from maskwork.operators import geometry as G
from maskwork.operators import images as I
from maskwork.operators import layout as L
from maskwork.operators.redact import parse_terms, redact, redact_text, report, split_terms
from maskwork.sources.tables import read_images, read_text_files
from maskwork.streaming.scan import redact_stream, span_counts


def lines(spark, rows):
    return spark.createDataFrame([(p, i, t, tuple(map(float, b))) for p, i, t, b in rows], "page int, line_id int, text string, box struct<x0:double,y0:double,x1:double,y1:double>")


def test_rows_and_spans_over_boxes(spark):
    df = lines(spark, [(1, 0, "password:", (0, 0, 90, 20)), (1, 1, "hK3#9vLp", (100, 1, 180, 21)), (1, 2, "below", (0, 60, 50, 80))])
    rows = {r["row_id"]: r for r in L.group_rows(df, "page").collect()}
    assert [rows[i]["text"] for i in (1, 2)] == ["password: hK3#9vLp", "below"] and [p["offset"] for p in rows[1]["parts"]] == [0, 10]
    found = L.detect(df, "page", ["secrets"]).collect()
    assert [(d["text"], d["detection_id"]) for d in found] == [("hK3#9vLp", 1)] and found[0]["box"]["x0"] >= 95
    manual = spark.createDataFrame([(1, (1.0, 1.0, 2.0, 2.0))], "page int, box struct<x0:double,y0:double,x1:double,y1:double>")
    assert [d["label"] for d in L.with_manual(L.detect(df, "page", ["secrets"]), manual, "page").orderBy("detection_id").collect()] == ["PASSWORD_OR_SECRET", "MANUAL"]


def test_label_and_value(spark):
    df = lines(spark, [(1, 0, "Password:", (0, 0, 90, 20)), (1, 1, "opensesame", (300, 1, 400, 21)), (1, 2, "far", (900, 1, 950, 21)), (2, 0, "Password:", (0, 0, 90, 20)), (2, 1, "no", (100, 0, 120, 20)), (3, 0, "Pin", (0, 0, 40, 20)), (3, 1, "98765", (0, 25, 60, 45))])
    got = sorted((r["page"], r["label_id"], r["line_id"]) for r in L.labelled_values(df, "page").collect())
    assert got == [(1, 0, 1), (3, 0, 1)]
    assert [r["page"] for r in L.labelled_values(df, "page", below=False).collect()] == [1]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_bounds_and_boxes(spark):
    poly = "array(struct({} AS x, {} AS y), struct({} AS x, {} AS y), struct({} AS x, {} AS y), struct({} AS x, {} AS y))"
    rect = lambda x0, x1: F.expr(poly.format(*[f"double({v})" for v in (x0, 0, x1, 0, x1, 20, x0, 20)]))
    words = F.array(F.struct(F.lit("ab").alias("text"), rect(0, 40).alias("polygon")), F.struct(F.lit("cd").alias("text"), rect(100, 140).alias("polygon")))
    b = one(spark, b=G.word_bounds(F.lit("ab cd"), rect(0, 140), words))["b"]
    assert [round(x["t0"] * 140) for x in b] == [0, 20, 40, 100, 120] and [round(x["t1"] * 140) for x in b] == [20, 40, 100, 120, 140]
    wrong = one(spark, b=G.word_bounds(F.lit("zz"), rect(0, 140), words))["b"]
    assert [x["t0"] for x in wrong] == [0.0, 0.5]
    turned = F.expr(poly.format(*[f"double({v})" for v in (0, 0, 100, 100, 90, 110, -10, 10)]))
    p = one(spark, p=G.span_polygon(turned, G.uniform_bounds(F.lit(10)), F.lit(5), F.lit(10)))["p"]
    assert 45 < p[0]["x"] < 50 and p[1]["x"] > 100
    line = lambda way: F.struct(F.lit("abcdefghij").alias("text"), F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 20, 100))]).alias("box"), F.array().cast("array<struct<t0:double,t1:double>>").alias("bounds"), F.lit(way).alias("orientation"))
    cw, ccw = one(spark, a=G.span_box(line("cw"), F.lit(0), F.lit(5)), b=G.span_box(line("ccw"), F.lit(0), F.lit(5)))
    assert cw["y1"] >= 100 and cw["y0"] < 50 and ccw["y0"] <= 0 and ccw["y1"] > 50
    assert one(spark, a=G.tile_starts(F.lit(500), 640, 512), b=G.tile_starts(F.lit(1604), 640, 512)) == ([0], [0, 512, 964])
    box = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (10, 20, 30, 40))])
    back = one(spark, a=G.rotated_back(box, F.lit(100), F.lit(50), True), b=G.rotated_back(box, F.lit(100), F.lit(50), False))
    assert tuple(back["a"]) == (20, 20, 40, 40) and tuple(back["b"]) == (60, 10, 80, 30)


def test_dedupe_lines_and_tiles(spark):
    rows = [(1, 0, "a", 0.9, (0.0, 0.0, 10.0, 10.0)), (1, 1, "a", 0.8, (1.0, 0.0, 10.0, 10.0)), (1, 2, "b", 0.7, (0.0, 0.0, 10.0, 10.0)), (1, 3, "a", 0.6, (50.0, 0.0, 60.0, 10.0))]
    df = spark.createDataFrame(rows, "page int, line_id int, text string, score double, box struct<x0:double,y0:double,x1:double,y1:double>")
    assert sorted(r["line_id"] for r in G.dedupe_lines(df, ["page"]).collect()) == [0, 2, 3]
    tiles = G.tiles(spark.createDataFrame([(1, 1000, 500)], "id int, width int, height int"), 640, 512).collect()
    assert [tuple(t["box"]) for t in tiles] == [(0, 0, 640, 500), (360, 0, 1000, 500)]


def test_entities(spark):
    text = "ping Priya Raman at Acme, 12 Main St, CA 94043"
    assert E.align_pieces("Café Zoë x", ["cafe", "zo", "##e", "[UNK]", "q"]) == [[0, 4], [5, 7], [7, 8], [9, 10], None]
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    tokens = spark.createDataFrame(
        [(1, 1, "B-PERSON", "priya", 0.9, 0, 10), (1, 2, "I-PERSON", "ram", 0.7, 11, 14), (1, 6, "B-LOCATION", "12", 0.8, 26, 28), (1, 7, "I-LOCATION", "main", 0.8, 29, 33), (1, 8, "I-LOCATION", "st", 0.8, 34, 36)],
        "id int, index int, entity string, word string, score double, start int, end int",
    )
    got = {r["type"]: (text[r["start"] : r["end"]], round(r["score"], 3)) for r in E.group_entities(tokens, docs, "id").collect()}
    assert got == {"PERSON": ("Priya Raman", 0.8), "LOCATION": ("12 Main St, CA 94043", 0.8)}
    spans = E.entity_spans(E.group_entities(tokens, docs, "id"), docs, "id", ["person", "location"]).first()["spans"]
    assert [(s["label"], s["source"]) for s in spans] == [("PERSON", "ner"), ("ADDRESS", "ner")]
    people = spark.createDataFrame(
        [(0, "ask Mei, Olga and Sid or Bank Ltd", [(4, 7)]), (1, "Ann, Bob", [(0, 3)]), (2, "Ann, Bob and Cy", [(0, 3), (5, 8)]), (3, "Ann, Bob, Cy, Di, Ed, Flo", [(0, 3)]), (4, "Ann or Acme Labs, Bob", [(0, 3)]), (5, "Ann & Bo Ltd", [(0, 3)]), (6, "Ann went home", [(0, 3)]), (7, None, []), (8, "Ann,and Zoë Élan", [(0, 3)])],
        "i int, text string, people array<struct<start:int,end:int>>",
    )
    got = {r["i"]: [tuple(x) for x in r["n"] or []] for r in people.select("i", E.coordinated_names("text", "people").alias("n")).collect()}
    assert got == {0: [(9, 13), (18, 21)], 1: [(5, 8)], 2: [(13, 15)], 3: [(5, 8), (10, 12), (14, 16), (18, 20)], 4: [], 5: [], 6: [], 7: [], 8: [(8, 16)]}
    chunks = E.chunk_lines(spark.createDataFrame([(1, i, "x" * 400) for i in range(5)], "id int, line_id int, text string"), "id").orderBy("line_id")
    assert [r["chunk_no"] for r in chunks.collect()] == [0, 0, 1, 1, 2]
    assert E.run_model(docs, None, "id").count() == 0
    model = lambda: lambda texts: [[{"index": 1, "entity": "B-PERSON", "word": "x", "score": 1.0, "start": 5, "end": 10}] for _ in texts]
    assert E.run_model(docs, model, "id").first()["start"] == 5


def test_ctc(spark):
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in p]) for p in ((0.1, 0.9, 0), (0.2, 0.8, 0), (0.9, 0.1, 0), (0.1, 0.7, 0.2), (0, 0.1, 0.9))])
    got = one(spark, d=E.ctc_decode(steps, F.array(F.lit(""), F.lit("a"), F.lit("b"))), b=E.ctc_bounds(F.array(F.lit(0), F.lit(3), F.lit(4)), F.lit(5), F.lit(100), F.lit(100)))
    assert got["d"]["text"] == "aab" and got["d"]["cols"] == [0, 3, 4] and abs(got["d"]["score"] - (0.9 + 0.7 + 0.9) / 3) < 1e-9
    assert [round(x["t0"], 2) for x in got["b"]] == [0.0, 0.4, 0.8] and [round(x["t1"], 2) for x in got["b"]] == [0.4, 0.8, 1.0]


@pytest.mark.parametrize("style", I.STYLES)
def test_pixels(style):
    image = np.random.default_rng(0).integers(0, 256, (100, 200, 3), np.uint8)
    out = I.apply_redactions(image, [[(50, 20), (120, 20), (120, 60), (50, 60)]], style)
    inside = np.zeros((100, 200), bool)
    inside[20:61, 50:121] = True
    assert (out[~inside] == image[~inside]).all() and (out[inside] != image[inside]).mean() > 0.9
    assert (I.apply_redactions(image, [], style) == image).all()
    with pytest.raises(ValueError):
        I.apply_redactions(image, [], "sepia")


def test_png_and_intake(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (30, 40, 3), np.uint8)
    assert (I.decode_png(I.encode_png(image)) == image).all()
    assert I.flatten(np.full((2, 2), 9, np.uint8)).tolist() == [[[9] * 3] * 2] * 2
    assert I.flatten(np.dstack([np.zeros((1, 1, 3), np.uint8), np.zeros((1, 1), np.uint8)])).tolist() == [[[255] * 3]]
    assert max(I.shrink(np.zeros((50, 100, 3), np.uint8), 40).shape) == 40
    (tmp_path / "a.png").write_bytes(I.encode_png(image))
    (tmp_path / "b.png").write_bytes(b"not an image")
    got = {r["path"][-5:]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"]) == (40, 30) and got["b.png"]["data"] is None
    images = read_images(spark, str(tmp_path / "a.png"))
    box = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (9, 0), (9, 9), (0, 9))])
    png = I.redact_images(images, images.select("path", box.alias("polygon")), "path").first()["png"]
    assert not I.decode_png(bytes(png))[:10, :10].any()
    assert I.extract(images, None, "path", "x int").count() == 0
    assert I.extract(images, lambda: lambda im: [{"x": im.shape[1]}], "path", "x int").first()["x"] == 40


def test_filters_of_png():
    import struct
    import zlib

    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (6, 5, 3), np.uint8).astype(int)
    rows, above = b"", np.zeros((5, 3), int)
    for y, kind in enumerate([0, 1, 2, 3, 4, 4]):
        line, out = image[y], []
        for x in range(5):
            a, b, c = (line[x - 1] if x else np.zeros(3, int)), above[x], (above[x - 1] if x else np.zeros(3, int))
            p = a + b - c
            paeth = [min((abs(v - s), i, s) for i, s in enumerate(t))[2] for v, t in zip(p, zip(a, b, c))]
            out.append((line[x] - [np.zeros(3, int), a, b, (a + b) // 2, np.array(paeth)][kind]) % 256)
        rows += bytes([kind]) + np.array(out, np.uint8).tobytes()
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"0000"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (I.decode_png(png) == image).all()


def test_text_boxes():
    chances = np.zeros((40, 60))
    chances[10:18, 5:30] = 0.9
    chances[30:32, 40:41] = 0.9
    got = I.text_boxes(chances, 120, 80)
    assert len(got) == 1 and got[0]["x0"] < 10 and got[0]["x1"] > 58 and got[0]["score"] > 0.5


def test_redaction_and_report(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com or c@d.org"), (2, None), (3, "nothing")], "id int, text string")
    got = {r["id"]: r for r in redact(docs, categories=["contact"]).collect()}
    assert got[1]["redacted"] == "mail [EMAIL] or [EMAIL]" and got[2]["redacted"] is None and got[3]["redacted"] == "nothing"
    spans = redact(docs, categories=["contact"]).drop("redacted")
    assert spans.select(redact_text("text", "spans", "box")).first()[0] == "mail ███████ or ███████"
    again = redact(redact(docs, categories=["contact"]).select("id", F.col("redacted").alias("text")), categories=["contact"])
    assert again.where("size(spans) > 0").count() == 0
    text = report(spans, "id").first()["report"]
    assert "a@b.com" not in text and '"count":2' in text
    assert parse_terms("a, b\n\n c ,") == ["a", "b", "c"]
    assert docs.select(split_terms(F.lit("a, b\nc"))).first()[0] == ["a", "b", "c"]


def test_streams(spark, tmp_path):
    pd.DataFrame({"at": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:02", "2024-01-01 00:11"]), "text": ["a@b.com", "x", "c@d.org e@f.net"]}).to_parquet(tmp_path / "a.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema("at timestamp, text string").parquet(str(tmp_path))
    q = redact_stream(stream, categories=["contact"]).select("redacted").writeStream.format("memory").queryName("redacted_texts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.table("redacted_texts").collect()) == ["[EMAIL]", "[EMAIL] [EMAIL]", "x"]
    counts = span_counts(spark.read.parquet(str(tmp_path)), "at", categories=["contact"])
    assert sorted((r["window"]["start"].minute, r["n"]) for r in counts.collect()) == [(0, 1), (10, 2)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("one\ntwo")
    assert read_text_files(spark, str(tmp_path / "t")).first()["text"] == "one\ntwo"
    assert read_text_files(spark, str(tmp_path / "t"), by_line=True).count() == 2


def test_bands_leave_choices_as_they_are(spark):
    """Suppression band by band equals that over whole pages, for boxes that touch, nest and lie apart."""
    rng = np.random.default_rng(8)
    boxes = [(k, i, (float(x), float(y), float(x + w), float(y + h)), float(s)) for k in range(4) for i, (x, y, w, h, s) in enumerate(zip(rng.integers(0, 60, 90), rng.integers(0, 700, 90), rng.integers(0, 40, 90), rng.integers(0, 30, 90), rng.integers(1, 9, 90)))]
    rows = spark.createDataFrame(boxes, "page int, box_id int, box struct<x0:double,y0:double,x1:double,y1:double>, score double")
    for threshold in (0.0, 0.3, 0.7):
        want = set()
        for k in range(4):
            kept = []
            for _, i, b, s in sorted((r for r in boxes if r[0] == k), key=lambda r: (-r[3], r[1])):
                shared = lambda c: max(0.0, min(b[2], c[2]) - max(b[0], c[0])) * max(0.0, min(b[3], c[3]) - max(b[1], c[1]))  # noqa: B023, E731
                area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
                if all(shared(c) / ((area(b) + area(c) - shared(c)) or 1.0) <= threshold for c in kept):
                    kept.append(b)
                    want.add((k, i))
        assert {(r["page"], r["box_id"]) for r in G.nms(rows, ["page"], threshold).collect()} == want
    assert G.in_bands(rows, ["page"]).select("page", "_band").distinct().count() > 20
