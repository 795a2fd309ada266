"""From images to redacted images and reports; faces, codes, review pictures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwork.operators import entities as E
from maskwork.operators import geometry as G
from maskwork.operators import images as I
from maskwork.operators import layout as L
from maskwork.operators.screens import read_lines, redact_screens


def an_image(spark, width, height, key="shot"):
    pixels = np.full((height, width, 3), 200, np.uint8)
    pixels[:5, :5] = 9
    return spark.createDataFrame([(key, width, height, bytearray(pixels.tobytes())), ("broken", None, None, None)], "key string, width int, height int, data binary")


def line(text, x0, y0, x1, y1, score=0.9):
    return {"text": text, "score": score, "x0": x0, "y0": y0, "x1": x1, "y1": y1}


def upright(*lines):
    """A reader that finds the lines where the dark corner is at the top left."""
    return lambda: lambda im: list(lines) if im[0, 0, 0] == 9 else []


def test_whole_path(spark):
    images = an_image(spark, 400, 200)
    reader = upright(line("mail kim@acme.example", 20, 20, 230, 40), line("ask Runa Kessim today", 20, 60, 230, 80), line("  ", 0, 0, 9, 9), line("blurred a@b.org", 20, 120, 200, 140, 0.2))
    tagger = lambda: lambda texts: [[{"index": 1, "entity": "B-PERSON", "word": "runa", "score": 0.9, "start": 4, "end": 15}] if "Runa" in t else [] for t in texts]
    face = spark.createDataFrame([("shot", "faces", "FACE", [(300.0, 100.0), (350.0, 100.0), (350.0, 150.0), (300.0, 150.0)], 0.8, "yunet", "")], "key string, category string, label string, polygon array<struct<x:double,y:double>>, score double, source string, text string")
    got = {r["key"]: r for r in redact_screens(images, "key", reader, tagger, face).collect()}
    assert got["broken"]["png"] is None and json.loads(got["broken"]["report"])["count"] == 0
    out, report = I.decode_png(bytes(got["shot"]["png"])), json.loads(got["shot"]["report"])
    assert report["count"] == 3 and report["by_category"] == {"contact": 1, "faces": 1, "person": 1}
    assert "kim@acme" not in got["shot"]["report"] and [r["label"] for r in report["regions"]] == ["EMAIL", "PERSON", "FACE"]
    assert not out[25:35, 75:225].any() and not out[105:145, 305:345].any() and not out[65:75, 65:155].any()
    assert (out[160:] == 200).all() and (out[20:40, 25:60] == 200).all()
    only = json.loads(redact_screens(images, "key", reader, tagger, face, categories=["contact"]).where("key = 'shot'").first()["report"])
    assert only["by_category"] == {"contact": 1}


def test_reading_in_tiles_and_turned(spark):
    images = an_image(spark, 300, 100)
    corner = lambda: lambda im: [line("tall", 10, 0, 30, 50)] if im[0, 0, 0] == 9 else [line("turned", 0, 0, 40, 10)] if im.shape[0] > im.shape[1] and im[0, -1, 0] == 9 else []
    rows = read_lines(images, corner, "key").collect()
    assert {r["text"]: r["orientation"] for r in rows} == {"tall": None, "turned": "cw"}
    seen = read_lines(images, lambda: lambda im: [line(f"{im.shape[1]}x{im.shape[0]}", 1, 1, 9, 9)], "key", tile=100, overlap=20, most_turned=2, whole=100).collect()
    assert sorted(r["box"]["x0"] for r in seen) == [1, 81, 161, 201] and {r["text"] for r in seen} == {"100x100"}


def test_faces_codes_and_batches(spark):
    cells = spark.createDataFrame([(1, 8, 2, 3, 0.9, 0.9, 0.5, 0.5, 1.0, 1.0), (1, 8, 2, 4, 0.8, 0.9, -0.4, 0.5, 1.0, 1.0), (1, 16, 9, 9, 0.9, 0.1, 0.0, 0.0, 0.0, 0.0)], "id int, stride int, row int, col int, cls double, obj double, dx double, dy double, lw double, lh double")
    face = G.decode_faces(cells, ["id"]).collect()
    assert len(face) == 1 and abs(face[0]["box"]["x0"] - (28 - 4 * np.e)) < 1e-9 and abs(face[0]["score"] - 0.9) < 1e-9
    codes = spark.createDataFrame([([(3.0, 4.0), (50.0, 9.0), (40.0, 60.0)], 52, 64)], "points array<struct<x:double,y:double>>, width int, height int")
    p = G.code_regions(codes).first()["polygon"]
    assert [tuple(q) for q in p] == [(0, 0), (52, 0), (52, 64), (0, 64)]
    boxes = spark.createDataFrame([(1, i, (0.0, 0.0, float(w), 10.0)) for i, w in enumerate([90, 20, 50, 40, 30, 80, 70])], "id int, box_id int, box struct<x0:double,y0:double,x1:double,y1:double>")
    got = {r["box_id"]: r["batch_no"] for r in G.reading_batches(boxes, ["id"], 3).collect()}
    assert got == {1: 0, 4: 0, 3: 0, 2: 1, 6: 1, 5: 1, 0: 2}


def test_spans_over_polygons(spark):
    square = "array(struct({0} AS x, 0D AS y), struct({1} AS x, 0D AS y), struct({1} AS x, 10D AS y), struct({0} AS x, 10D AS y))"
    part = lambda text, x0, x1, at: F.struct(F.struct(F.lit(text).alias("text"), F.expr(square.format(f"{x0}D", f"{x1}D")).alias("polygon"), F.array().cast("array<struct<t0:double,t1:double>>").alias("bounds"), F.lit(None).cast("string").alias("orientation"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("box")).alias("line"), F.lit(at).alias("offset"))
    parts = F.array(part("abcd", 0, 40, 0), part("efgh", 60, 100, 5))
    one, two, none = spark.range(1).select(*[L.row_span_polygon(parts, F.lit(a), F.lit(b)) for a, b in ((0, 2), (2, 7), (20, 21))]).first()
    assert one[0]["x"] < 0.1 and one[1]["x"] < 25 and two[0]["x"] < 20 and two[1]["x"] > 80 and none[1]["x"] < 15


def test_concave_masks_and_areas():
    ell = [(2, 2), (12, 2), (12, 5), (5, 5), (5, 12), (2, 12)]
    mask = I.polygon_mask(16, 16, [ell])
    assert mask[3, 10] and mask[10, 3] and not mask[10, 10] and mask[2, 2:13].all() and mask[12, 2:6].all() and not mask[13].any()
    rng = np.random.default_rng(4)
    for _ in range(20):
        on = rng.random((14, 17)) < 0.35
        want, seen = set(), np.zeros_like(on)
        for y, x in zip(*np.nonzero(on)):
            if seen[y, x]:
                continue
            stack, own = [(y, x)], []
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                own.append((b, a))
                for c in range(max(0, a - 1), min(14, a + 2)):
                    for d in range(max(0, b - 1), min(17, b + 2)):
                        if on[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
            xs, ys = zip(*own)
            want.add((min(xs), min(ys), max(xs), max(ys), len(own)))
        assert sorted(map(tuple, I._areas(on).tolist())) == sorted(w[:4] for w in want)
    chances = np.zeros((400, 800))
    chances[::10, :] = 0
    for k in range(1200):
        y, x = divmod(k, 40)
        chances[y * 12 + 2 : y * 12 + 9, x * 20 + 2 : x * 20 + 14] = 0.9
    assert len(I.text_boxes(chances, 1600, 800)) == 1200 and len(I.text_boxes(chances, 1600, 800, most=5)) == 5 and I.text_boxes(np.zeros((5, 5)), 10, 10) == []


def test_review_picture():
    image = np.full((60, 80, 3), 100, np.uint8)
    square = [(20, 20), (50, 20), (50, 50), (20, 50)]
    out = I.annotate(image, [(12, "contact", square), (3, "person", [(60, 5), (70, 5), (70, 15), (60, 15)])], {12})
    assert (out[55:, :15] == 100).all() and (out[40, 40] != 100).any() and (out[10, 65] == 100).all() and (out[50, 30] != out[40, 40]).any()
    assert (out == 255).all(axis=2).any() and I.annotate(image, []).shape == image.shape


@pytest.mark.parametrize(
    "text, tokens, want",
    [
        ("Ångström’s tram", ["angstrom", "’", "s", "tra", "##m"], [[0, 8], [8, 9], [9, 10], [11, 14], [14, 15]]),
        ("a lost word here", ["a", "zzz", "word", "he", "##re"], [[0, 1], None, [7, 11], [12, 14], [14, 16]]),
        ("", ["x"], [None]),
        ("x", [], []),
    ],
)
def test_alignment(text, tokens, want):
    assert E.align_pieces(text, tokens) == want


def test_labels_and_gate(spark):
    assert E.model_wanted(None) and E.model_wanted(["person"]) and not E.model_wanted(["secrets", "network"]) and E.model_wanted(["dates"], E.ASKED_LABELS)
    texts = spark.createDataFrame([(1, "born 4 May")], "id int, text string")
    asked = spark.createDataFrame([(1, "date of birth", 5, 10, 0.7)], "id int, type string, start int, end int, score double")
    got = E.entity_spans(asked, texts, "id", ["dates"], labels=E.ASKED_LABELS).first()["spans"]
    assert [(s["label"], s["category"]) for s in got] == [("DATE_OF_BIRTH", "dates")]


def corners(x, y, length, height, angle):
    """A box turned about its top left corner."""
    c, s = np.cos(angle), np.sin(angle)
    return [(x + a * c - b * s, y + a * s + b * c) for a, b in ((0, 0), (length, 0), (length, height), (0, height))]


@pytest.mark.parametrize("angle", [np.pi / 4, np.pi / 2, -np.pi / 6])
def test_lines_at_angles(spark, angle):
    """A span of a line at an angle is hidden by its own turned corners, which words place, and what lies beside is untouched."""
    x, y = 60, 170 if angle < 0 else 60
    text = "mail kim@acme.example now"
    shape = corners(x, y, 250, 20, angle)
    along = lambda a, b: corners(x + a * np.cos(angle), y + a * np.sin(angle), b - a, 20, angle)
    words = [{"text": "mail", "polygon": along(0, 40)}, {"text": "kim@acme.example", "polygon": along(100, 200)}, {"text": "now", "polygon": along(220, 250)}]
    images = an_image(spark, 330, 330)
    found = {"text": text, "score": 0.9, "polygon": shape, "words": words}
    reader = lambda: lambda im: [found] if im[0, 0, 0] == 9 else []
    rows = read_lines(images, reader, "key").collect()
    assert len(rows) == 1 and np.allclose([(p["x"], p["y"]) for p in rows[0]["polygon"]], shape) and len(rows[0]["bounds"]) == len(text)
    got = redact_screens(images, "key", reader, categories=["custom"], custom_terms=["kim@acme.example"]).where("key = 'shot'").first()
    out = I.decode_png(bytes(got["png"]))
    black = ~out.any(axis=2)
    pad = 0.35 * 100 / 16
    want = I.polygon_mask(330, 330, [corners(x + (100 - pad) * np.cos(angle) + 1.6 * np.sin(angle), y + (100 - pad) * np.sin(angle) - 1.6 * np.cos(angle), 100 + 2 * pad, 23.2, angle)])
    assert (black ^ want).sum() < 0.03 * want.sum() and black.sum() > 1500
    around = I.polygon_mask(330, 330, [corners(x + 93 * np.cos(angle) + 4 * np.sin(angle), y + 93 * np.sin(angle) - 4 * np.cos(angle), 114, 28, angle)])
    assert (out[~around & (np.arange(330) >= 5)[:, None]] == 200).all()


def test_turned_tile_puts_polygons_back(spark):
    """A polygon that was found in a picture turned by a quarter, in a tile, lies where it is in the picture."""
    pixels = np.full((100, 300, 3), 200, np.uint8)
    pixels[:5, 200:205] = 9  # the corner of the last tile
    images = spark.createDataFrame([("a", 300, 100, bytearray(pixels.tobytes()))], "key string, width int, height int, data binary")
    turned = lambda: lambda im: [{"text": "turned", "score": 0.9, "polygon": [(10, 20), (60, 20), (60, 30), (10, 30)]}] if im[0, -1, 0] == 9 and im[0, 0, 0] != 9 else []
    rows = read_lines(images, turned, "key", tile=100, overlap=20, whole=100).collect()
    assert [[(p["x"], p["y"]) for p in r["polygon"]] for r in rows if r["orientation"] == "cw"] == [[(220, 90), (220, 40), (230, 40), (230, 90)]]
