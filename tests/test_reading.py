"""Crops as tensors against direct loops, and the chain from a map of text to hidden characters."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from maskwork.operators import images as I
from maskwork.operators import reading as R
from maskwork.operators import tensors as X
from maskwork.operators.screens import read_lines, redact_screens


def direct(image, x, y, w, h, width, height):
    """The mix of four pixels, one by one."""
    H, W, _ = image.shape
    out = np.zeros((height, width, 3), int)
    for r in range(height):
        fy = min(H - 1, max(0, y + (r + 0.5) * (h / height) - 0.5))
        for c in range(width):
            fx = min(W - 1, max(0, x + (c + 0.5) * (w / width) - 0.5))
            a, b = int(fy), int(fx)
            p = image[[a, a, min(a + 1, H - 1), min(a + 1, H - 1)], [b, min(b + 1, W - 1), b, min(b + 1, W - 1)]].astype(float)
            u, v = fy - a, fx - b
            out[r, c] = np.rint((p[0] * (1 - v) + p[1] * v) * (1 - u) + (p[2] * (1 - v) + p[3] * v) * u)
    return out


def rows_of(spark, pictures):
    rows = [(k, im.shape[1], im.shape[0], bytearray(im.tobytes())) for k, im in pictures.items()] + [("broken", None, None, None)]
    return spark.createDataFrame(rows, "key string, width int, height int, data binary")


def test_resampling():
    image = np.random.default_rng(1).integers(0, 256, (20, 31, 3), dtype=np.uint8)
    for case in ((0, 0, 31, 20, 62, 40), (3, 2, 9, 7, 30, 48), (28, 15, 10, 10, 7, 5), (0, 0, 31, 20, 3, 2)):
        assert (X.resample(image, *case) == direct(image, *case)).all()
    p = X.planes(image, 24, 40)
    assert p.shape == (3, 24, 40) and p.dtype == np.float32 and not p[:, 20:].any() and not p[:, :, 31:].any()
    assert np.allclose(p[0, :20, :31], (image[:, :, 2] / 255 - 0.5) / 0.5) and np.allclose(p[2, :20, :31], (image[:, :, 0] / 255 - 0.5) / 0.5)


def test_crops_in_batches(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (60, 500, 3), dtype=np.uint8)
    boxes = [(i, float(rng.integers(0, 40)), float(rng.integers(0, 20)), float(rng.integers(5, 440)), float(rng.integers(8, 40))) for i in range(15)]
    table = spark.createDataFrame([("a", i, (x, y, x + w, y + h)) for i, x, y, w, h in boxes] + [("a", 99, (5.0, 5.0, 5.0, 9.0)), ("none", 1, (0.0, 0.0, 9.0, 9.0))], "key string, box_id int, box struct<x0:double,y0:double,x1:double,y1:double>")
    rows = sorted(X.crop_tensors(rows_of(spark, {"a": image}), table, "key").collect(), key=lambda r: r["batch_no"])
    order = sorted(boxes, key=lambda b: (b[3] / b[4], b[0]))
    assert [i for r in rows for i in r["box_ids"]] == [b[0] for b in order] and [len(r["box_ids"]) for r in rows] == [6, 6, 3]
    for r in rows:
        own = [boxes[i] for i in r["box_ids"]]
        assert r["height"] == 48 and r["width"] == int(48 * max(320 / 48, *(b[3] / b[4] for b in own)))
        tensor = np.array(r["tensor"], np.float32).reshape(len(own), 3, 48, r["width"])
        for t, b, width in zip(tensor, own, r["widths"]):
            assert width == min(r["width"], math.ceil(48 * b[3] / b[4])) and not t[:, :, width:].any()
            assert np.allclose(t[:, :, :width], X.planes(X.resample(image, *b[1:], width, 48)))


LETTERS = list("0123456789")


def digits(text, at=40, top=10, step=48):
    """White, with a block of gray for each digit."""
    image = np.full((60, 400, 3), 255, np.uint8)
    for i, d in enumerate(text):
        image[top : top + 32, at + i * step : at + i * step + 24] = 10 + 20 * int(d)
    return image


def load_detector():
    def found(p):
        dark = p.mean(axis=0) < 0.9
        out = np.zeros(dark.shape)
        if dark.any():
            ys, xs = np.nonzero(dark)
            out[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] = 0.9
        return out

    return found


def load_recogniser():
    def read(crops):
        n, _, _, width = crops.shape
        steps = width // 8
        out = np.zeros((n, steps, 11))
        gray = (crops[:, 0, 24] * 0.5 + 0.5) * 255
        at = np.arange(steps) * 8 + 4
        flat = (np.abs(gray[:, at] - gray[:, at - 3]) < 3) & (np.abs(gray[:, at] - gray[:, np.minimum(at + 3, width - 1)]) < 3) & (gray[:, at] < 200) & (np.abs(gray[:, at] - 127.5) > 1)  # the last is what pads a batch
        letter = np.where(flat, np.rint((gray[:, at] - 10) / 20).astype(int) + 1, 0).clip(0, 10)
        np.put_along_axis(out, letter[:, :, None], 0.9, axis=2)
        return out

    return read


def test_chain_reads_and_places(spark):
    images = rows_of(spark, {"a": digits("31415"), "b": digits("0077", at=100), "blank": digits("")})
    rules = R.ReadingRules(most_turned=0)
    lines = {r["key"]: r for r in R.read_text(images, "key", load_detector, load_recogniser, LETTERS, rules).collect()}
    assert {k: r["text"] for k, r in lines.items()} == {"a": "31415", "b": "0077"}
    for key, at in (("a", 40), ("b", 100)):
        r = lines[key]
        width = r["box"]["x1"] - r["box"]["x0"]
        for i, b in enumerate(r["bounds"]):
            middle = (at + i * 48 + 12 - r["box"]["x0"]) / width
            assert b["t0"] < middle < b["t1"], (key, i)
        assert all(abs(x["t1"] - y["t0"]) < 1e-9 for x, y in zip(r["bounds"], r["bounds"][1:]))
    assert R.read_text(images, "key", None, load_recogniser, LETTERS).count() == 0
    out = redact_screens(images, "key", None, categories=["custom"], custom_terms=["41"], lines=R.read_text(images, "key", load_detector, load_recogniser, LETTERS, rules))
    got = {r["key"]: r for r in out.collect()}
    assert json.loads(got["a"]["report"])["count"] == 1 and json.loads(got["b"]["report"])["count"] == 0 and got["broken"]["png"] is None
    image = I.decode_png(bytes(got["a"]["png"]))
    assert not image[20, 40 + 2 * 48 : 40 + 3 * 48 + 24].any() and (image[20, 40 : 40 + 24] == 70).all() and (image[20, 40 + 4 * 48 : 40 + 4 * 48 + 24] == 110).all()


def test_detector_sizes_and_order():
    assert R.detector_size(400, 60) == (2016, 288) and R.detector_size(4000, 3000) == (2016, 1504) and R.detector_size(1000, 800) == (992, 800) and R.detector_size(5, 3) == (1216, 736)
    box = lambda x, y: {"x0": x, "y0": y}
    assert [(b["x0"], b["y0"]) for b in R.in_reading_order([box(50, 8), box(5, 12), box(9, 30), box(1, 21)])] == [(1, 21), (5, 12), (9, 30), (50, 8)]
    assert [(b["x0"], b["y0"]) for b in R.in_reading_order([box(50, 0), box(5, 4), box(9, 30), box(1, 33)])] == [(5, 4), (50, 0), (1, 33), (9, 30)]


def test_bounds_from_reader_to_hidden_columns(spark):
    """One wide character and many narrow ones: what is hidden goes by the characters, not by equal shares of the line."""
    text = "W a@bb.org"
    share = [0.5, 0.04, *[0.0575] * 8]
    edges = np.concatenate([[0], np.cumsum(share)])
    bounds = list(zip(edges[:-1], edges[1:]))
    image = np.full((60, 440, 3), 200, np.uint8)
    images = rows_of(spark, {"a": image})
    line = {"text": text, "score": 0.9, "x0": 20, "y0": 20, "x1": 420, "y1": 40}
    reader = lambda **more: lambda: lambda im: [line | more] if im.shape[1] > im.shape[0] else []
    rows = read_lines(images, reader(bounds=bounds), "key").collect()
    assert len(rows) == 1 and [tuple(b) for b in rows[0]["bounds"]] == [tuple(map(float, b)) for b in bounds]
    assert not read_lines(images, reader(bounds=bounds[:3]), "key").first()["bounds"]  # not one for each character

    def hidden(load):
        png = redact_screens(images, "key", load, categories=["custom"], custom_terms=["a@bb.org"]).where("key = 'a'").first()["png"]
        return np.flatnonzero(~I.decode_png(bytes(png))[30].any(axis=1))

    wide = 0.0575 * 400
    got = hidden(reader(bounds=bounds))
    assert got[0] == round(20 + 0.54 * 400 - 0.35 * wide) and got[-1] == round(420 + 0.35 * wide) and len(got) == got[-1] - got[0] + 1
    plain = hidden(reader())
    assert plain[0] == round(20 + 400 * 2 / 10 - 0.35 * 40)
