"""Pictures from files: our own PNG reader against direct loops, and Spark's source against plain arrays."""

import os
import struct
import subprocess
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwork.operators import images as I


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(raw, step, kinds):
    """Rows of bytes with a filter each, done byte by byte."""
    out, above = b"", np.zeros(raw.shape[1], int)
    for y, row in enumerate(raw.astype(int)):
        kind, line = kinds[y % len(kinds)], []
        for x, v in enumerate(row):
            left, up, corner = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = left + up - corner
            near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line.append((v - [0, left, up, (left + up) // 2, near][kind]) % 256)
        out += bytes([kind, *line])
        above = row
    return out


def png(samples, colour, depth=8, kinds=(0, 1, 2, 3, 4), interlaced=False, more=b""):
    """Samples (height, width, n) as a PNG."""
    h, w, n = samples.shape
    packed = b""
    for x, y, dx, dy in I._PASSES if interlaced else [(0, 0, 1, 1)]:
        part = samples[y::dy, x::dx]
        if part.size:
            flat = part.reshape(len(part), -1)
            if depth == 16:
                raw = flat.astype(">u2").view(np.uint8).reshape(len(part), -1)
            elif depth == 8:
                raw = flat.astype(np.uint8)
            else:
                bits = (flat[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
                raw = np.packbits(bits.reshape(len(part), -1).astype(np.uint8), axis=1)
            packed += filtered(raw, max(1, n * depth // 8), kinds)
    return I._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced))) + more + chunk(b"IDAT", zlib.compress(packed)) + chunk(b"IEND", b"")


def laid_on_white(colour, alpha):
    a = alpha[..., None] / 255
    return np.rint(colour * a + 255 * (1 - a)).astype(np.uint8)


def cases():
    """Name, file, and the pixels that it should give."""
    rng = np.random.default_rng(1)
    rgb, alpha = rng.integers(0, 256, (150, 23, 3)), rng.integers(0, 256, (150, 23))
    out = [("rgb", png(rgb, 2), rgb), ("rgba", png(np.dstack([rgb, alpha]), 6), laid_on_white(rgb, alpha)), ("interlaced", png(rgb[:19], 2, interlaced=True), rgb[:19])]
    for kinds in ((3,), (4,), (4, 0, 0, 0), (3, 4, 1, 2, 0)):
        out.append((f"filters{kinds}", png(rgb, 2, kinds=kinds), rgb))
    gray = rng.integers(0, 256, (9, 14))
    three = np.repeat(gray[..., None], 3, axis=2)
    out += [("gray", png(gray[..., None], 0), three), ("gray alpha", png(np.dstack([gray, alpha[:9, :14]]), 4), laid_on_white(three, alpha[:9, :14]))]
    deep = rng.integers(0, 65536, (8, 5, 3))
    eight = np.rint(deep / 257)
    out += [("deep", png(deep, 2, 16), eight), ("deep gray", png(deep[:, :, :1], 0, 16), np.repeat(eight[:, :, :1], 3, axis=2))]
    for depth in (1, 2, 4):
        low = rng.integers(0, 1 << depth, (6, 11))
        out.append((f"gray{depth}", png(low[..., None], 0, depth), np.repeat((low * (255 // ((1 << depth) - 1)))[..., None], 3, axis=2)))
        palette = rng.integers(0, 256, (1 << depth, 3))
        out.append((f"palette{depth}", png(low[..., None], 3, depth, more=chunk(b"PLTE", palette.astype(np.uint8).tobytes())), palette[low]))
    palette, index = rng.integers(0, 256, (40, 3)), rng.integers(0, 40, (13, 7))
    clear = rng.integers(0, 256, 10)
    see = np.concatenate([clear, np.full(30, 255)])[index]
    out.append(("palette alpha", png(index[..., None], 3, interlaced=True, more=chunk(b"PLTE", palette.astype(np.uint8).tobytes()) + chunk(b"tRNS", bytes(clear.tolist()))), laid_on_white(palette[index], see)))
    return out


@pytest.mark.parametrize("case", cases(), ids=lambda c: c[0])
def test_png_reader(case):
    assert (I.decode_png(case[1]) == case[2]).all()


def test_png_reader_is_quick():
    """A screenshot whose rows all have the filter that looks at three neighbours."""
    image = np.random.default_rng(2).integers(0, 256, (1080, 1920 * 3), dtype=np.uint8)
    rows = np.concatenate([np.full((1080, 1), 4, np.uint8), image], axis=1)
    start = time.monotonic()
    out = I.unfilter(rows, 3)
    assert time.monotonic() - start < 4 and out.shape == image.shape
    again = rows[:40, : 1 + 90]
    decoded = I.unfilter(again, 3)
    assert filtered(decoded, 3, (4,)) == again.tobytes()


def test_pictures_from_files(spark, tmp_path):
    for i, (_, raw, _) in enumerate(cases()):
        (tmp_path / f"p{i}.png").write_bytes(raw)
    (tmp_path / "broken.png").write_bytes(b"\x89PNG no picture")
    (tmp_path / "empty.png").write_bytes(b"")
    rows = I.read_pictures(spark, str(tmp_path))
    assert rows.columns == ["path", "width", "height", "channels", "data"]
    got = {os.path.basename(r["path"]): r for r in rows.collect()}
    assert len(got) == len(cases()) + 1 and got["broken.png"]["data"] is None and "empty.png" not in got  # Spark lists no empty files
    wrong = {name: int(np.abs(I.pixels_of(got[f"p{i}.png"]).astype(int) - want).max()) for i, (name, _, want) in enumerate(cases())}
    assert not {k: v for k, v in wrong.items() if v > (1 if "alpha" in k or k == "rgba" else 0)}
    own = {os.path.basename(r["path"]): r for r in I.read_images(spark, str(tmp_path)).collect()}
    assert all((I.pixels_of(own[f"p{i}.png"]) == want).all() for i, (_, _, want) in enumerate(cases())) and own["broken.png"]["data"] is None
    plan = I.read_pictures(spark, str(tmp_path), exact_gray=False)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_jpeg_and_gif(spark, tmp_path):
    """Files written by the JVM's own encoders: GIF exactly, JPEG nearly, and an even JPEG exactly."""
    jvm = spark._jvm
    even = jvm.java.awt.image.BufferedImage(40, 24, 1)
    graphics = even.createGraphics()
    graphics.setColor(jvm.java.awt.Color(200, 100, 50))
    graphics.fillRect(0, 0, 40, 24)
    for kind in ("jpg", "gif", "bmp"):
        assert jvm.javax.imageio.ImageIO.write(even, kind, jvm.java.io.File(str(tmp_path / f"even.{kind}")))
    rows = I.read_pictures(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and all((r["width"], r["height"]) == (40, 24) for r in rows)
    for r in rows:
        assert np.abs(I.pixels_of(r).astype(int) - [200, 100, 50]).max() <= (3 if r["path"].endswith("jpg") else 0)


def test_redaction_moves_no_pixels(spark, tmp_path):
    for i, (_, raw, _) in enumerate(cases()[:3]):
        (tmp_path / f"p{i}.png").write_bytes(raw)
    pictures = I.read_pictures(spark, str(tmp_path), exact_gray=False)
    square = "array(struct(2D AS x, 3D AS y), struct(6D AS x, 3D AS y), struct(6D AS x, 9D AS y), struct(2D AS x, 9D AS y))"
    regions = pictures.where(F.col("path").contains("p0")).select("path", F.expr(square).alias("polygon"))
    out = I.redact_images(pictures, regions, "path")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {os.path.basename(r["path"]): I.decode_png(bytes(r["png"])) for r in out.collect()}
    want = np.array(cases()[0][2]).copy()
    want[3:10, 2:7] = 0
    assert (got["p0.png"] == want).all() and (got["p2.png"] == cases()[2][2]).all()


def test_lanczos_equals_a_double_loop():
    image = np.random.default_rng(3).integers(0, 256, (23, 31, 3), dtype=np.uint8)

    def weight(x):
        return 0.0 if abs(x) >= 3 else 1.0 if x == 0 else 3 * np.sin(np.pi * x) * np.sin(np.pi * x / 3) / (np.pi * x) ** 2

    def along(rows, new):
        out = []
        for i in range(new):
            scale, middle = max(1.0, len(rows) / new), (i + 0.5) * len(rows) / new
            w = np.array([weight((j + 0.5 - middle) / scale) for j in range(len(rows))])
            out.append(np.rint(sum(a * b for a, b in zip(w / w.sum(), rows.astype(float)))).clip(0, 255))
        return np.array(out)

    for width, height in ((10, 7), (31, 23), (1, 1), (30, 5), (40, 30)):
        want = along(along(image.swapaxes(0, 1), width).swapaxes(0, 1), height)
        assert np.abs(I.lanczos(image, width, height).astype(int) - want).max() <= 1 and (I.lanczos(image, width, height) == want).mean() > 0.999
    assert (I.lanczos(np.full((50, 90, 3), 77, np.uint8), 13, 9) == 77).all() and max(I.shrink(np.zeros((50, 100, 3), np.uint8), 40).shape) == 40
