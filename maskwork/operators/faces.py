"""Faces in pictures of any size: a pass over the whole, and tiles as rows, so that the parts of one picture are many tasks' work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.operators.geometry import box, box_polygon, face_box, face_cells, moved, nms, tile_starts
from maskwork.operators.images import frames, pixels_of
from maskwork.operators.tensors import planes, resample

#: A model that gets planes (3, size, size) of blue, green and red from 0 to 255 and returns, for each stride, arrays of the
#: cells' chances of a face and of an object, and four numbers of their boxes: ``{stride: (cls, obj, bbox)}``.
FaceModel = Callable[[np.ndarray], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]


@dataclass(frozen=True)
class FaceRules:
    size: int = 640
    overlap: int = 128
    #: Pictures with a longer side are tiled at half their resolution.
    halved: int = 2600
    threshold: float = 0.7
    shared: float = 0.3
    #: Faces of no more pixels than this are taken for parts of others.
    least: float = 4.0


def face_parts(width: Column, height: Column, rules: FaceRules = FaceRules()) -> Column:
    """``array<struct<x, y, w, h>>``: the whole picture, and if it is larger than the model's input, tiles that overlap."""
    part = lambda x, y, w, h: F.struct(*[v.cast("int").alias(n) for n, v in (("x", x), ("y", y), ("w", w), ("h", h))])

    def tiled(times: int) -> Column:
        size, step = rules.size * times, (rules.size - rules.overlap) * times
        across, down = tile_starts(width, size, step), tile_starts(height, size, step)
        return F.flatten(F.transform(down, lambda y: F.transform(across, lambda x: part(x, y, F.least(F.lit(size), width - x), F.least(F.lit(size), height - y)))))

    longest, zero = F.greatest(width, height), F.lit(0)
    tiles = F.when(longest <= rules.size, F.slice(tiled(1), 1, 0)).when(longest > rules.halved, tiled(2)).otherwise(tiled(1))
    return F.concat(F.array(part(zero, zero, width, height)), tiles)


def _cut(r, rules: FaceRules) -> Iterator[tuple]:
    """``part_no, x, y, scale, tile`` of a picture's parts."""
    image = pixels_of(r)
    for n, p in enumerate(r.parts):
        scale = rules.size / max(p["w"], p["h"])
        wide, high = (max(1, int(np.floor(p[k] * scale + 0.5))) for k in ("w", "h"))
        yield n, p["x"], p["y"], scale, resample(image, p["x"], p["y"], p["w"], p["h"], wide, high)


def _sure(model: FaceModel, tile: np.ndarray, rules: FaceRules) -> Iterator[tuple]:
    """``stride, row, col, cls, obj`` and the four numbers of a box, of a tile's cells that are sure enough."""
    for stride, (cls, obj, shape) in model(planes(tile, rules.size, rules.size, 1.0, 0.0, 1.0)).items():
        cls, obj, shape = np.ravel(cls).astype(float), np.ravel(obj).astype(float), np.reshape(shape, (-1, 4)).astype(float)
        across = rules.size // stride
        for i in np.flatnonzero(np.sqrt(cls.clip(0, 1) * obj.clip(0, 1)) >= rules.threshold).tolist():
            yield stride, i // across, i % across, cls[i], obj[i], *shape[i]


def _parted(images: DataFrame, key: str, rules: FaceRules) -> DataFrame:
    pixels = [c for c in ("width", "height", "channels", "data") if c in images.columns]
    return images.where("data IS NOT NULL").select(key, *pixels, face_parts(F.col("width"), F.col("height"), rules).alias("parts"))


def face_tiles(images: DataFrame, key: str, rules: FaceRules = FaceRules(), spread: bool = True) -> DataFrame:
    """``key, part_no, x, y, scale, high, wide, tile``: each part of each picture, scaled to fit the model's input, as RGB bytes.

    With ``spread`` the parts are dealt out over all tasks, which moves their scaled pixels once; without it they stay where
    their picture was decoded.
    """
    kind = images.schema[key].dataType.simpleString()
    names = [key, "part_no", "x", "y", "scale", "high", "wide", "tile"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for r in b.itertuples(index=False):
                for *place, tile in _cut(r, rules):
                    yield getattr(r, key), *place, *tile.shape[:2], tile.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(cut(batches), names)

    tiles = _parted(images, key, rules).mapInPandas(run, f"{key} {kind}, part_no int, x int, y int, scale double, high int, wide int, tile binary")
    # a number is given, so that parts of few bytes, each of which is much work for a model, are not put together again
    return tiles.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key), F.col("part_no")) if spread else tiles


def find_faces(images: DataFrame, key: str, load: Callable[[], FaceModel] | None, rules: FaceRules = FaceRules(), spread: bool = True) -> DataFrame:
    """``key, category, label, box, polygon, score, source, text``: faces in pictures ``key, width, height, data``.

    A face is looked for in the whole picture and in every tile; of finds that overlap the best stays, and gets a margin, more
    for small faces and more above than below.  With ``spread`` tiles are rows of many tasks, as ``face_tiles`` has them; many
    pictures of few tiles are dealt out already, and without it each is cut and looked at in one task.  Without a model, and in pictures that can't be read, there are none.
    """
    kind = images.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, part_no int, x int, y int, scale double, stride int, row int, col int, cls double, obj double, dx double, dy double, lw double, lh double"
    names = [c.split()[0] for c in schema.split(", ")]

    def sure(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        model = load()
        for b in batches:
            for r in b.itertuples(index=False):
                parts = [(r.part_no, r.x, r.y, r.scale, np.frombuffer(r.tile, np.uint8).reshape(int(r.high), int(r.wide), 3))] if spread else _cut(r, rules)
                for *place, tile in parts:
                    for cell in _sure(model, tile, rules):
                        yield getattr(r, key), *place, *cell

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(sure(batches), names)

    if load is None:
        cells = images.sparkSession.createDataFrame([], schema)
    else:
        cells = (face_tiles(images, key, rules) if spread else _parted(images, key, rules)).mapInPandas(run, schema)
    found = face_cells(cells, rules.threshold)
    scaled = box(*[F.col(f"box.{k}") / F.col("scale") for k in ("x0", "y0", "x1", "y1")])
    found = found.withColumn("box", scaled).where((F.col("box.x1") - F.col("box.x0") > rules.least) & (F.col("box.y1") - F.col("box.y0") > rules.least))
    placed = found.select(key, F.struct("part_no", "stride", "row", "col").alias("box_id"), "score", moved(F.col("box"), F.col("x"), F.col("y")).alias("box"))
    best = nms(placed, [key], rules.shared).join(images.select(key, "width", "height").where("width IS NOT NULL"), key)
    around = best.withColumn("box", face_box(F.col("box"), F.col("width"), F.col("height")))
    fixed = {"category": "faces", "label": "FACE", "source": "yunet", "text": ""}
    return around.select(key, F.lit(fixed["category"]).alias("category"), F.lit(fixed["label"]).alias("label"), "box", box_polygon(F.col("box")).alias("polygon"), "score", F.lit(fixed["source"]).alias("source"), F.lit(fixed["text"]).alias("text"))
