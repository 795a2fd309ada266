"""Parts of pictures as a model's input: bilinear resampling, and planes of blue, green and red, with batches as rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwork.operators.images import beside, frames, pixels_of

#: New rows that are mixed together, so that what is between stays in the processor's cache.
_ROWS = 16
BATCH = "batch_no int, box_ids array<long>, widths array<int>, height int, width int, tensor array<float>"


@dataclass(frozen=True)
class CropRules:
    #: Height of all crops, the least width of a batch, and how many crops it has.
    height: int = 48
    width: int = 320
    batch: int = 6


def resample(image: np.ndarray, x: float, y: float, w: float, h: float, width: int, height: int) -> np.ndarray:
    """The region at (x, y) of w by h pixels as ``height`` by ``width`` pixels, each a mix of the four nearest to its centre."""

    def near(start: float, size: float, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(start + (np.arange(n) + 0.5) * (size / n) - 0.5, 0, length - 1)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, length - 1), at - low

    if width == w and height == h and x == int(x) >= 0 and y == int(y) >= 0 and x + w <= image.shape[1] and y + h <= image.shape[0]:
        return image[int(y) : int(y) + height, int(x) : int(x) + width].copy()  # centres lie on pixels
    x0, x1, wx = near(x, w, width, image.shape[1])
    y0, y1, wy = near(y, h, height, image.shape[0])
    # rows that are needed are mixed across once each, however many new rows lie between them
    own, at = np.unique(np.concatenate([y0, y1]), return_inverse=True)
    rows, channels = image[own], image.shape[2]
    wx = np.repeat(wx, channels)
    pick = lambda cols: np.take(rows, cols, axis=1).reshape(len(own), -1)
    across = pick(x0) * (1 - wx)
    across += pick(x1) * wx
    out = np.empty((height, width * channels), np.uint8)
    upper, lower = at[:height], at[height:]
    for a in range(0, height, _ROWS):
        b = min(height, a + _ROWS)
        mixed = np.take(across, upper[a:b], axis=0)
        mixed *= (1 - wy)[a:b, None]
        other = np.take(across, lower[a:b], axis=0)
        other *= wy[a:b, None]
        mixed += other
        out[a:b] = np.rint(mixed, out=mixed).clip(0, 255, out=mixed)
    return out.reshape(height, width, channels)


def planes(image: np.ndarray, height: int | None = None, width: int | None = None, scale: float = 1 / 255, mean: float = 0.5, std: float = 0.5) -> np.ndarray:
    """An RGB picture as three planes of blue, green and red in float32, at the top left of ``height`` by ``width`` zeros."""
    h, w = image.shape[:2]
    shade = ((np.arange(256) * scale - mean) / std).astype(np.float32)  # a sample has one of so many values
    out = np.zeros((3, height or h, width or w), np.float32)
    for plane, c in zip(out, (2, 1, 0)):
        plane[:h, :w] = shade[image[:, :, c]]
    return out


def crop_batches(image: np.ndarray, boxes: list[tuple[float, float, float, float]], rules: CropRules = CropRules()) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Numbers of boxes, widths of their crops, and a tensor (crops, 3, height, width), for boxes of like shape together.

    A crop is as wide as its box is at this height, and all crops of a batch are laid in the width of the widest.
    """
    shape = [(x1 - x0) / (y1 - y0) for x0, y0, x1, y1 in boxes]
    order = sorted(range(len(boxes)), key=shape.__getitem__)
    for a in range(0, len(order), rules.batch):
        own = order[a : a + rules.batch]
        width = int(rules.height * max(rules.width / rules.height, *(shape[i] for i in own)))
        out, widths = np.zeros((len(own), 3, rules.height, width), np.float32), []
        for n, i in enumerate(own):
            x0, y0, x1, y1 = boxes[i]
            widths.append(min(width, int(np.ceil(rules.height * shape[i]))))
            out[n, :, :, : widths[-1]] = planes(resample(image, x0, y0, x1 - x0, y1 - y0, widths[-1], rules.height))
        yield own, widths, out


def crop_tensors(images: DataFrame, boxes: DataFrame, key: str, rules: CropRules = CropRules()) -> DataFrame:
    """``key`` and ``BATCH``: a row for each batch of crops of an image, from ``boxes (key, box_id, box)``.

    ``tensor`` has the crops of ``box_ids`` one after another, each as planes of ``height`` by ``width``; ``widths`` are the
    crops' own.  Boxes without an area, and those of images that can't be read, are in none.
    """
    some = boxes.where((F.col("box.x1") > F.col("box.x0")) & (F.col("box.y1") > F.col("box.y0")))
    page = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("box_id").cast("long").alias("box_id"), *[F.col(f"box.{k}") for k in ("x0", "y0", "x1", "y1")]))).alias("_boxes"))
    rows = beside(images.where("data IS NOT NULL"), page, key, F.lit(16) + 40 * F.size("_boxes"), "inner")
    pixels = [c for c in ("width", "height", "channels", "data") if c in images.columns]
    names = [key, *(c.split()[0] for c in BATCH.split(", "))]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for r in b.itertuples(index=False):
                found = [(x["x0"], x["y0"], x["x1"], x["y1"]) for x in r.boxes]
                ids = [x["box_id"] for x in r.boxes]
                for k, (own, widths, tensor) in enumerate(crop_batches(pixels_of(r), found, rules)):
                    yield getattr(r, key), k, [ids[i] for i in own], widths, tensor.shape[2], tensor.shape[3], tensor.ravel()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(cut(batches), names)

    return rows.select(key, *pixels, F.col("_boxes").alias("boxes")).mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, {BATCH}")
