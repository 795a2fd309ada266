"""Faces over tiles: the parts of pictures, one large picture in many tasks, margins, and pictures without any."""

import numpy as np
from pyspark.sql import functions as F

from maskwork.operators import faces as A
from maskwork.plans.pictures import _gray_squares


def starts(length, tile, step):
    return [0] if length <= tile else [*(s for s in range(0, length, step) if s + tile < length), length - tile]


def test_parts(spark):
    sizes = [(100, 50), (640, 640), (641, 10), (1500, 900), (2600, 640), (2601, 700), (5000, 3000)]
    rows = spark.createDataFrame(sizes, "w int, h int").select("w", "h", A.face_parts(F.col("w"), F.col("h")).alias("p")).collect()
    for r in rows:
        w, h = r["w"], r["h"]
        times = 2 if max(w, h) > 2600 else 1
        tiles = [(x, y, min(640 * times, w - x), min(640 * times, h - y)) for y in starts(h, 640 * times, 512 * times) for x in starts(w, 640 * times, 512 * times)]
        assert [tuple(p) for p in r["p"]] == [(0, 0, w, h), *(tiles if max(w, h) > 640 else [])], (w, h)


def test_faces_of_one_large_picture(spark):
    """Squares in a picture of 3000 by 700, on tiles' edges too, are found once each, by more than one task."""
    at = [(30, 40), (1240, 300), (1010, 500), (2800, 20)]
    image = np.full((700, 3000, 3), 255, np.uint8)
    pictures = []
    for i, (x, y) in enumerate(at):
        one = image.copy()
        one[y : y + 100, x : x + 100] = 50
        pictures.append((f"p{i}", 3000, 700, bytearray(one.tobytes())))
    pictures += [("blank", 700, 20, bytearray(np.full((20, 700, 3), 255, np.uint8).tobytes())), ("broken", None, None, None)]
    images = spark.createDataFrame(pictures, "key string, width int, height int, data binary")
    found = {r["key"]: r for r in A.find_faces(images, "key", _gray_squares).collect()}
    assert sorted(found) == ["p0", "p1", "p2", "p3"]
    for i, (x, y) in enumerate(at):
        b = found[f"p{i}"]["box"]
        want = (max(0, x - 35), max(0, y - 45.5), min(3000, x + 135), min(700, y + 135))
        assert max(abs(a - z) for a, z in zip(b, want)) < 6 and found[f"p{i}"]["label"] == "FACE", (i, b, want)
    tiles = A.face_tiles(images.where("key = 'p0'"), "key")
    assert tiles.select(F.spark_partition_id()).distinct().count() > 1 and tiles.count() == 4
    assert A.face_tiles(images.where("key = 'p0'"), "key", spread=False).select(F.spark_partition_id()).distinct().count() == 1
    assert A.find_faces(images, "key", None).count() == 0
