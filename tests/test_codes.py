"""The locator of QR codes on symbols with finders, timing and random modules, at four turns, two scales, upright and inverted."""

import numpy as np
import pytest

from maskwork.operators import codes as C


def symbol(version, seed):
    """Modules of a symbol: three finders in the corners with light borders, timing lines, and random modules elsewhere."""
    n = 17 + 4 * version
    m = np.random.default_rng(seed).random((n, n)) < 0.5
    m[6], m[:, 6] = np.arange(n) % 2 == 0, np.arange(n) % 2 == 0
    eye = np.zeros((8, 8), bool)
    eye[:7, :7] = True
    eye[1:6, 1:6] = False
    eye[2:5, 2:5] = True
    m[:8, :8], m[:8, -8:], m[-8:, :8] = eye, eye[:, ::-1], eye[::-1]
    return m


def picture(m, scale, turn=0, light_on_dark=False, at=(40, 30), size=(420, 520)):
    image = np.full((*size, 3), 255, np.uint8)
    block = np.kron(np.rot90(m, turn), np.ones((scale, scale))) > 0
    image[at[1] : at[1] + len(block), at[0] : at[0] + len(block)][block] = 20
    return 255 - image if light_on_dark else image


def text_like(seed):
    """Lines of strokes of many widths."""
    rng = np.random.default_rng(seed)
    image = np.full((300, 600, 3), 250, np.uint8)
    for y in range(10, 290, 18):
        x = 10
        while x < 580:
            w, h = rng.integers(1, 4), rng.integers(5, 13)
            image[y : y + h, x : x + w] = 10
            if rng.random() < 0.5:
                image[y + rng.integers(0, h) : y + h, x : x + rng.integers(3, 8)] = 10
            x += int(w + rng.integers(2, 8))
    return image


@pytest.mark.parametrize("scale", [3, 8])
@pytest.mark.parametrize("turn", [0, 1, 2, 3])
def test_symbols_are_covered(scale, turn):
    for version, seed, light in ((1, 1, False), (2, 2, True), (4, 3, False)):
        m = symbol(version, seed)
        shapes = C.locate_codes(picture(m, scale, turn, light))
        assert len(shapes) == 1
        xs, ys = zip(*shapes[0])
        side = len(m) * scale
        assert max(abs(min(xs) - 40), abs(min(ys) - 30), abs(max(xs) - 40 - side), abs(max(ys) - 30 - side)) < 3


def test_ordinary_pictures_have_none():
    assert not [s for s in range(12) if C.locate_codes(text_like(s))]
    assert C.locate_codes(np.full((50, 60, 3), 9, np.uint8)) == [] and C.locate_codes(np.zeros((0, 0, 3), np.uint8)) == []


def test_all_codes_of_pictures(spark):
    many = np.full((420, 620, 3), 255, np.uint8)
    places = [(20 + 100 * i, 20 + 100 * j) for i in range(6) for j in range(4)]
    for k, (x, y) in enumerate(places):
        block = np.kron(np.rot90(symbol(1, k), k % 4), np.ones((3, 3))) > 0
        many[y : y + 63, x : x + 63][block] = 0
    rows = [("many", 620, 420, bytearray(many.tobytes())), ("text", 600, 300, bytearray(text_like(3).tobytes())), ("broken", None, None, None)]
    images = spark.createDataFrame(rows, "key string, width int, height int, data binary")
    got = C.find_codes(images, "key").collect()
    assert len(got) == len(places) and {r["key"] for r in got} == {"many"} and {(r["category"], r["label"], r["text"]) for r in got} == {("codes", "QR_CODE", "")}
    corners = sorted((round(r["polygon"][0]["x"]), round(r["polygon"][0]["y"])) for r in got)
    assert all(abs(a - x + 6) <= 2 and abs(b - y + 6) <= 2 for (a, b), (x, y) in zip(corners, sorted(places)))
    decoder = lambda: lambda im: [{"points": [(20, 20), (83, 20), (83, 83), (20, 83)], "kind": "QR_CODE", "text": "told"}, {"points": [(300, 405), (400, 415)], "kind": "BARCODE", "text": "9"}] if im.shape[0] == 420 else []
    both = C.find_codes(images, "key", decoder).collect()
    assert sorted(r["text"] for r in both if r["text"]) == ["9", "told"] and len(both) == len(places) + 1
