"""Reading text in pictures by two injected models: one that maps where text is, and one that reads what is there.

Pictures become rows of parts, parts rows of batches of crops, and batches rows of lines, each step within its task, so pixels
never move; then built-in functions decode the lines and place their characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwork.operators.entities import ctc_bounds, ctc_collapse
from maskwork.operators.images import frames, pixels_of, text_boxes
from maskwork.operators.screens import PARTS, parts_of, settle_lines
from maskwork.operators.tensors import CropRules, crop_batches, planes, resample

#: A model that gets planes (3, height, width) and returns chances of text (height, width).
Detector = Callable[[np.ndarray], np.ndarray]
#: A model that gets crops (n, 3, height, width) and returns chances of letters (n, steps, letters); letter 0 is the blank.
Recogniser = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class ReadingRules:
    #: Pictures are scaled so that the short side has ``short`` pixels, unless the long one would get over ``long``.
    short: int = 736
    long: int = 2000
    #: Sides of the detector's input are multiples of this.
    unit: int = 32
    #: Larger pictures are read in tiles of this size.
    tile: int = 1800
    overlap: int = 96
    #: So many tiles are read turned by a quarter either way as well.
    most_turned: int = 4
    least: float = 0.5
    crops: CropRules = field(default_factory=CropRules)


def detector_size(width: int, height: int, rules: ReadingRules = ReadingRules()) -> tuple[int, int]:
    """Width and height that the detector gets of a picture."""
    ratio = min(1.0, rules.long / max(width, height))
    if min(width, height) * ratio < rules.short:
        ratio = max(ratio, min(rules.short / min(width, height), rules.long / max(width, height)))
    whole = lambda v: max(rules.unit, int(np.floor(int(v * ratio) / rules.unit + 0.5)) * rules.unit)
    return whole(width), whole(height)


def in_reading_order(boxes: list[dict], step: float = 10.0) -> list[dict]:
    """Boxes by rows from the top, each from the left; a row ends where the next box, by its top, is ``step`` or more lower."""
    rows: list[list[dict]] = []
    last = None
    for b in sorted(boxes, key=lambda b: b["y0"]):
        if last is None or b["y0"] - last >= step:
            rows.append([])
        rows[-1].append(b)
        last = b["y0"]
    return [b for row in rows for b in sorted(row, key=lambda b: b["x0"])]


CROPS = "left int, top int, wide int, high int, turn string, boxes array<array<double>>, widths array<int>, width int, tensor array<float>"


def find_text(images: DataFrame, key: str, load: Callable[[], Detector], rules: ReadingRules = ReadingRules()) -> DataFrame:
    """``key`` and ``CROPS``: a row for each batch of crops that the detector's boxes cut out of a part of an image."""
    names = [key, *(c.split()[0] for c in CROPS.split(", "))]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        engine = load()
        for b in batches:
            for r in b.itertuples(index=False):
                for place, part in parts_of(pixels_of(r), rules.long, rules.tile, rules.overlap, rules.most_turned):
                    height, width = part.shape[:2]
                    w, h = detector_size(width, height, rules)
                    chances = np.asarray(engine(planes(resample(part, 0, 0, width, height, w, h))), np.float64)
                    boxes = [tuple(x[k] for k in ("x0", "y0", "x1", "y1")) for x in in_reading_order(text_boxes(chances, width, height))]
                    for own, widths, tensor in crop_batches(part, boxes, rules.crops):
                        yield getattr(r, key), *place, [list(boxes[i]) for i in own], widths, tensor.shape[3], tensor.ravel()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(cut(batches), names)

    pixels = [c for c in ("width", "height", "channels", "data") if c in images.columns]
    return images.where("data IS NOT NULL").select(key, *pixels).mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, {CROPS}")


def recognise(crops: DataFrame, key: str, load: Callable[[], Recogniser], rules: ReadingRules = ReadingRules()) -> DataFrame:
    """A row for each box: its part of the image, its corners, the best letter of each step, and the widths of crop and batch."""
    head = "left int, top int, wide int, high int, turn string, x0 double, y0 double, x1 double, y1 double, best array<struct<c:int,p:double>>, resized int, padded int"
    names = [key, *(c.split()[0] for c in head.split(", "))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        engine = load()
        for b in batches:
            for r in b.itertuples(index=False):
                tensor = np.asarray(r.tensor, np.float32).reshape(len(r.widths), 3, rules.crops.height, int(r.width))
                chances = np.asarray(engine(tensor), np.float64)
                letter, most = chances.argmax(axis=2), chances.max(axis=2)
                for corners, width, c, p in zip(r.boxes, r.widths, letter.tolist(), most.tolist()):
                    yield getattr(r, key), r.left, r.top, r.wide, r.high, r.turn, *map(float, corners), [{"c": a, "p": z} for a, z in zip(c, p)], int(width), int(r.width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(read(batches), names)

    return crops.mapInPandas(run, f"{key} {crops.schema[key].dataType.simpleString()}, {head}")


def read_text(images: DataFrame, key: str, load_detector: Callable[[], Detector] | None, load_recogniser: Callable[[], Recogniser] | None, letters: list[str], rules: ReadingRules = ReadingRules()) -> DataFrame:
    """Lines of text of images ``key, width, height, data``, as ``screens.read_lines`` has them, with the characters' bounds.

    ``letters`` are those of the recogniser behind the blank.  Without either model there are no lines.
    """
    kind = images.schema[key].dataType.simpleString()
    if load_detector is None or load_recogniser is None:
        return settle_lines(images.sparkSession.createDataFrame([], f"{key} {kind}, {PARTS}"), key, rules.least)
    boxes = recognise(find_text(images, key, load_detector, rules), key, load_recogniser, rules)
    named = F.array(F.lit(""), *[F.lit(x) for x in letters])
    read = boxes.withColumn("d", ctc_collapse(F.col("best"), named))
    bounds = ctc_bounds(F.col("d.cols"), F.size("best"), F.col("padded"), F.col("resized"))
    names = [c.split()[0] for c in PARTS.split(", ")]
    nothing = lambda c: F.lit(None).cast(dict(x.split(" ", 1) for x in PARTS.split(", "))[c])
    made = {"text": F.col("d.text"), "score": F.col("d.score"), "bounds": bounds, "polygon": nothing("polygon"), "words": nothing("words")}
    return settle_lines(read.select(key, *[made[c].alias(c) if c in made else F.col(c) for c in names]), key, rules.least)
