"""Many small pictures: handed on together, dealt out over all tasks, and as exact as one by one."""

import numpy as np
import pandas as pd

from maskwork.operators import faces
from maskwork.operators import images as I
from maskwork.plans import pictures, shapes  # noqa: F401  (registers the queries)
from maskwork.plans.queries import QUERIES


def keys_in_one_file(spark, folder, table, key, n):
    spark.range(n).coalesce(1).selectExpr(f"id AS {key}").write.parquet(f"{folder}/{table}.parquet")


def test_rows_of_small_pictures_are_handed_on_together_and_large_ones_alone():
    small = list(I.frames(((i, b"x") for i in range(1200)), ["k", "png"]))
    assert [len(f) for f in small] == [500, 500, 200] and pd.concat(small)["k"].tolist() == list(range(1200))
    assert [len(f) for f in I.frames(((i, np.zeros(5 << 20, np.uint8)) for i in range(3)), ["k", "png"])] == [1, 1, 1]
    assert list(I.frames(iter(()), ["k"])) == []


def test_keys_of_hidden_pictures_are_dealt_out(spark, tmp_path):
    keys_in_one_file(spark, tmp_path, "part", "p_partkey", 1000)
    made = QUERIES["blackened_pixels"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() > 4
    assert {r.p_partkey: r.n_black for r in made.collect()} == {k: 3 * (k % 7 + 2) * 4 for k in range(1000)}


def plain_resample(image, x, y, w, h, width, height):
    near = lambda start, size, n, length: np.clip(start + (np.arange(n) + 0.5) * (size / n) - 0.5, 0, length - 1)
    at, down = near(x, w, width, image.shape[1]), near(y, h, height, image.shape[0])
    x0, y0 = np.floor(at).astype(int), np.floor(down).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    wx, wy = (at - x0)[None, :, None], (down - y0)[:, None, None]
    row = lambda r: image[r][:, x0] * (1 - wx) + image[r][:, x1] * wx
    return np.rint(row(y0) * (1 - wy) + row(y1) * wy).clip(0, 255).astype(np.uint8)


def test_resampling_by_rows_is_that_of_each_pixel():
    from maskwork.operators import tensors as X

    some = np.random.default_rng(7)
    for _ in range(80):
        image = some.integers(0, 256, (some.integers(1, 60), some.integers(1, 70), 3)).astype(np.uint8)
        area = (some.uniform(-5, 60), some.uniform(-5, 50), some.uniform(0.5, 70), some.uniform(0.5, 60))
        size = (int(some.integers(1, 150)), int(some.integers(1, 150)))
        assert (X.resample(image, *area, *size) == plain_resample(image, *area, *size)).all()
        whole = (int(some.integers(0, 70)), int(some.integers(0, 60)), *size)
        assert (X.resample(image, *whole, *size) == plain_resample(image, *whole, *size)).all()
        shifted = (image[:, :, ::-1].transpose(2, 0, 1) * (1 / 255) - 0.5) / 0.5
        assert (X.planes(image) == shifted.astype(np.float32)).all()


def test_sums_of_crops_of_many_pictures_are_those_of_their_pixels(spark, tmp_path):
    keys_in_one_file(spark, tmp_path, "supplier", "s_suppkey", 300)
    made = QUERIES["crop_sums"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() > 4
    rows = {(r.s_suppkey, r.box_id): r for r in made.collect()}
    assert len(rows) == 900
    y, x, z = np.mgrid[:40, :64, :3]
    for k in (0, 7, 255, 256, 299):
        image = ((3 * x + 5 * y + 40 * z + k) % 256).astype(np.uint8)
        for box_id, (bx, by, w, h) in enumerate([(k % 5, k % 3, 20 + k % 7, 8 + k % 4), (10, 5, 30 + k % 9, 30), (2, 30, 60, 8)]):
            r = rows[k, box_id]
            assert r.width == -(-48 * w // h)
            assert [r.red, r.green, r.blue] == plain_resample(image, bx, by, w, h, r.width, 48).sum(axis=(0, 1), dtype=int).tolist()


def test_faces_of_pictures_that_are_dealt_out_already(spark, tmp_path):
    keys_in_one_file(spark, tmp_path, "supplier", "s_suppkey", 40)
    assert pictures._keys(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")).rdd.getNumPartitions() > 4
    images = pictures._keys(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet"))
    images = images.selectExpr("s_suppkey", "800 AS width", "300 AS height", "unhex(repeat('FFFFFF', 800 * 300)) AS data")
    inside = faces.find_faces(images, "s_suppkey", pictures._gray_squares, spread=False)
    assert inside.collect() == []
    found = QUERIES["faces_over_tiles"](spark, str(tmp_path)).collect()
    plan = QUERIES["faces_over_tiles"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert plan.count("tile#") == 0  # tiles are no rows
    want = {}
    for k in range(40):
        x, y = 60 + k * 37 % 650, 10 + k * 13 % 220
        want[k] = (x - 33, max(0, round(y - 42.9, 3)), min(800, x + 93), min(300, y + 93))
    assert {r.s_suppkey: (r.x0, r.y0, r.x1, r.y1) for r in found} == want


def test_digits_of_pictures_in_one_file_are_read_by_all_tasks(spark, tmp_path, monkeypatch):
    keys_in_one_file(spark, tmp_path, "supplier", "s_suppkey", 60)
    read, given = pictures.R.read_text, []
    monkeypatch.setattr(pictures.R, "read_text", lambda images, *rest: given.append(images) or read(images, *rest))
    made = QUERIES["read_digits"](spark, str(tmp_path))
    assert given[0].rdd.getNumPartitions() > 4
    assert {r.s_suppkey: (r.text, r.in_place) for r in made.collect()} == {k: (str(k), True) for k in range(60)}
