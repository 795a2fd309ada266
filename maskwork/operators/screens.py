"""From images to images with what is sensitive hidden, and reports.  Engines are injected: each ``load`` makes one per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.display import mask_preview
from maskwork.operators import entities as E
from maskwork.operators.geometry import box, dedupe_lines, moved, polygon_box, rotated_back, word_bounds
from maskwork.operators.images import pixels_of, redact_images
from maskwork.operators.layout import detect, group_rows
from maskwork.operators.redact import parse_terms
from maskwork.schemas import POLYGON
from maskwork.session import written

Reader = Callable[[np.ndarray], list[dict]]


#: What a reader's rows are before lines are settled: the part of the image, how it was turned, and the line in it.
PARTS = "left int, top int, wide int, high int, turn string, text string, score double, x0 double, y0 double, x1 double, y1 double, bounds array<struct<t0:double,t1:double>>, polygon array<struct<x:double,y:double>>, words array<struct<text:string,polygon:array<struct<x:double,y:double>>>>"


def _starts(length: int, tile: int, step: int) -> list[int]:
    return [0] if length <= tile else [*range(0, length - tile, step), length - tile]


def parts_of(image: np.ndarray, whole: int, tile: int, overlap: int, most_turned: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """``left, top, wide, high, turn`` and pixels of what is read of an image: all of it up to ``whole`` pixels a side, else
    tiles that overlap, and if these are few, each turned by a quarter either way as well."""
    height, width = image.shape[:2]
    size = max(height, width) if max(height, width) <= whole else tile
    places = [(x, y) for y in _starts(height, size, size - overlap) for x in _starts(width, size, size - overlap)]
    for x, y in places:
        part = image[y : y + size, x : x + size]
        for turn, quarter in (("", 0), ("cw", -1), ("ccw", 1))[: 3 if len(places) <= most_turned else 1]:
            yield (x, y, part.shape[1], part.shape[0], turn), np.ascontiguousarray(np.rot90(part, quarter))


def read_lines(images: DataFrame, load: Callable[[], Reader] | None, key: str, least: float = 0.5, tile: int = 1800, overlap: int = 96, most_turned: int = 4, whole: int = 2000) -> DataFrame:
    """``key, line_id, text, score, box, orientation, bounds, polygon``: lines of text that an engine reads in images of any size.

    The engine gets an RGB array and returns dicts of ``text, score, x0, y0, x1, y1`` and, if it knows, ``bounds``: for each
    character of the text where it begins and ends, as shares of the line.  A line that lies at an angle has ``polygon``, four
    points from the top left along the text, in place of the box, and may have ``words``, dicts of ``text, polygon``.  Images of more than ``whole`` pixels a side are
    read in tiles that overlap; those of few tiles are read turned by a quarter either way as well.  Blank and doubtful lines
    go, and of lines that were read twice the better stays.  Lines are numbered from the top.
    """
    schema = f"{key} {images.schema[key].dataType.simpleString()}, {PARTS}"
    names = [key, *(c.split()[0] for c in PARTS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = load()
        for b in batches:
            for r in b.itertuples(index=False):
                rows = []
                for place, part in parts_of(pixels_of(r), whole, tile, overlap, most_turned):
                    for found in engine(part):
                        rows.append((getattr(r, key), *place, *_line(found)))
                yield pd.DataFrame(rows, columns=names)

    if load is None:
        return settle_lines(images.sparkSession.createDataFrame([], schema), key, least)
    pixels = [c for c in ("width", "height", "channels", "data") if c in images.columns]
    return settle_lines(images.where("data IS NOT NULL").select(key, *pixels).mapInPandas(run, schema), key, least)


def _line(found: dict) -> tuple:
    """What an engine returned of a line, as the last columns of ``PARTS``."""
    points = lambda p: [{"x": float(x), "y": float(y)} for x, y in p]
    shape = found.get("polygon")
    xs, ys = zip(*shape) if shape else ((found["x0"], found["x1"]), (found["y0"], found["y1"]))
    bounds = [{"t0": float(a), "t1": float(z)} for a, z in found.get("bounds") or []]
    words = [{"text": w["text"], "polygon": points(w["polygon"])} for w in found.get("words") or []]
    return found["text"], float(found["score"]), float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys)), bounds, points(shape) if shape else None, words


def settle_lines(read: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Lines of whole images, as ``read_lines`` returns them, from rows ``key`` and ``PARTS``.

    Bounds that are not one for each character are left out; those of lines with words go by the words' places.
    """
    good = read.where((F.trim("text") != "") & (F.col("score") >= least))
    found = box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    back = F.when(F.col("turn") == "cw", rotated_back(found, F.col("wide"), F.col("high"), True)).when(F.col("turn") == "ccw", rotated_back(found, F.col("wide"), F.col("high"), False)).otherwise(found)
    place = F.struct("turn", "left", "top", "x0", "y0", "x1", "y1")
    bounds = F.when(F.size("bounds") == F.char_length("text"), F.col("bounds")).when(F.col("polygon").isNotNull() & (F.size("words") > 0), word_bounds(F.col("text"), F.col("polygon"), F.col("words"))).otherwise(F.slice("bounds", 1, 0))

    def put_back(p: Column) -> Column:
        x = F.when(F.col("turn") == "cw", p["y"]).when(F.col("turn") == "ccw", F.col("wide") - p["y"]).otherwise(p["x"])
        y = F.when(F.col("turn") == "cw", F.col("high") - p["x"]).when(F.col("turn") == "ccw", p["x"]).otherwise(p["y"])
        return F.struct((x + F.col("left")).alias("x"), (y + F.col("top")).alias("y"))

    polygon = F.transform("polygon", put_back).cast(POLYGON)
    lines = dedupe_lines(good.select(key, place.alias("line_id"), "text", "score", moved(back, F.col("left"), F.col("top")).alias("box"), bounds.alias("bounds"), polygon.alias("polygon")), [key])
    numbered = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("box.y0").alias("y"), F.col("box.x0").alias("x"), "line_id", "text", "score", "box", "bounds", "polygon"))).alias("_l"))
    rows = numbered.select(key, F.posexplode("_l").alias("line_id", "l"))
    turn = F.when(F.col("l.line_id.turn") != "", F.col("l.line_id.turn"))
    return rows.select(key, "line_id", "l.text", "l.score", "l.box", turn.alias("orientation"), "l.bounds", "l.polygon")


#: The report of an image in which nothing was found.
NOTHING = '{"count":0,"by_category":{},"regions":[]}'


def detection_pages(detections: DataFrame, key: str) -> DataFrame:
    """``key, polygons, report`` for each image with detections: the polygons to hide, and JSON of count, count by category and
    regions, whose values are masked."""
    region = F.struct("detection_id", "category", "label", F.round("score", 3).alias("score"), "source", *[F.round(f"box.{k}", 1).alias(k) for k in ("x0", "y0", "x1", "y1")], mask_preview(F.col("text")).alias("text"))
    rows = detections.groupBy(key).agg(F.array_sort(F.collect_list(region)).alias("regions"), F.collect_list("polygon").alias("polygons"))
    rows = rows.withColumn("kinds", F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["category"]))))
    counts = F.map_from_arrays("kinds", F.transform("kinds", lambda c: F.size(F.filter("regions", lambda r: r["category"] == c))))
    return rows.select(key, "polygons", F.to_json(F.struct(F.size("regions").alias("count"), counts.alias("by_category"), "regions")).alias("report"))


def redact_screens(
    images: DataFrame,
    key: str,
    load_reader: Callable[[], Reader] | None,
    load_tagger: Callable | None = None,
    found: DataFrame | None = None,
    categories: Sequence[str] | None = None,
    style: str = "black box",
    custom_terms: str | Sequence[str] = (),
    lines: DataFrame | None = None,
) -> DataFrame:
    """``key, png, report``: images ``key, width, height, data`` with all that is sensitive in them hidden.

    Text is read by the injected reader, or comes as ``lines`` of ``reading.read_text``; it is laid out and searched by rules and, if any of the categories is one that it knows, by a tagger of names.
    ``found (key, category, label, polygon, score, source, text)`` adds regions of faces, codes or drawn by hand, those of
    unwanted categories left out.  An image that can't be read has a null ``png`` and an empty report.

    ``images`` are looked at twice, once to read them and once to hide; what is found between is written to the shared folder,
    as several passes look at it.  Only texts, places and reports are shuffled, no pixels (see ``redact_images``).
    """
    terms = parse_terms(custom_terms) if isinstance(custom_terms, str) else list(custom_terms)
    wanted = None if categories is None else list(categories)
    lines = written(read_lines(images, load_reader, key) if lines is None else lines, "lines")
    entities = None
    if load_tagger is not None and E.model_wanted(wanted):
        rows = group_rows(lines, key).select(key, "row_id", "text", F.struct(key, "row_id").alias("_row"))
        tagged = E.run_model(rows, load_tagger, "_row")
        spans = E.entity_spans(E.group_entities(tagged, rows, "_row"), rows, "_row", wanted or sorted({c for _, c in E.ENTITY_LABELS.values()}))
        entities = spans.select(f"_row.{key}", "_row.row_id", "spans")
    detections = detect(lines, key, wanted, terms, entities)
    if found is not None:
        more = found if wanted is None else found.where(F.col("category").isin([*wanted, "custom"]))
        more = more.select(key, F.lit(None).cast("int").alias("detection_id"), "category", "label", polygon_box(F.col("polygon")).alias("box"), F.col("score").cast("double").alias("score"), "source", "text", "polygon")
        page = detections.unionByName(more).groupBy(key).agg(F.collect_list(F.struct(F.coalesce("detection_id", F.lit(2**31 - 1)).alias("o"), F.struct(*[c for c in more.columns if c not in (key, "detection_id")]).alias("d"))).alias("_all"))
        rows = page.select(key, F.posexplode(F.array_sort("_all", lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))).alias("i", "x"))
        detections = rows.select(key, (F.col("i") + 1).alias("detection_id"), "x.d.*")
    pages = written(detection_pages(detections, key), "pages")
    out = redact_images(images, pages, key, style, ["report"])
    return out.select(key, "png", F.coalesce("report", F.lit(NOTHING)).alias("report"))
