"""Boxes and polygons as columns: places of characters, spans on lines, overlap, suppression, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwork.operators.spans import let
from maskwork.schemas import BOX, POLYGON


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


def box_polygon(b: Column) -> Column:
    """Corners from the top left, clockwise."""
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    return F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in corners]).cast(POLYGON)


def polygon_box(p: Column) -> Column:
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Whether two boxes share an area, not just an edge."""
    return (F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])) & (F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"]))


def _area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def _shared(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def iou(a: Column, b: Column) -> Column:
    whole = _area(a) + _area(b) - _shared(a, b)
    return _shared(a, b) / F.when(whole == 0, 1.0).otherwise(whole)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller one; 0 where that is empty."""
    least = F.least(_area(a), _area(b))
    return F.when(least > 0, _shared(a, b) / least).otherwise(F.lit(0.0))


def suppress(items: Column | str, clash) -> Column:
    """Greedy choice in the array's order: an item stays if it clashes with none that stays."""
    items = F.col(items) if isinstance(items, str) else items
    return F.aggregate(items, F.slice(items, 1, 0), lambda acc, z: F.when(F.exists(acc, lambda k: clash(k, z)), acc).otherwise(F.concat(acc, F.array(z))))


def in_bands(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_band``: boxes of different bands of a key have no height in common, so a page is settled band by band."""
    down = Window.partitionBy(*keys).orderBy(F.col("box.y0"))
    above = F.max("box.y1").over(down.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes.withColumn("_band", F.coalesce(above <= F.col("box.y0"), F.lit(True)).cast("int"))
    return rows.withColumn("_band", F.sum("_band").over(down.rowsBetween(Window.unboundedPreceding, 0)))


def nms(boxes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Per key, the boxes left when each drops those of lower score with a larger IoU.

    ``boxes``: keys, ``box``, ``score`` and ``box_id``; equal scores go by ``box_id``.
    """
    item = F.struct((-F.col("score")).alias("order"), "box_id", "score", "box")
    bands = in_bands(boxes, keys) if threshold >= 0 else boxes.withColumn("_band", F.lit(0))
    kept = bands.groupBy(*keys, "_band").agg(F.sort_array(F.collect_list(item)).alias("_all")).withColumn("_kept", suppress("_all", lambda a, b: iou(a["box"], b["box"]) > threshold))
    return kept.select(*keys, F.explode("_kept").alias("_b")).select(*keys, "_b.box_id", "_b.score", "_b.box")


def dedupe_lines(lines: DataFrame, keys: list[str], threshold: float = 0.75) -> DataFrame:
    """Per key, lines without those that have a better line's text and cover it, or lie in it, by more than the threshold."""
    own = ["line_id", "score", "box"]
    rest = [c for c in lines.columns if c not in (*keys, "text", *own)]
    item = F.struct((-F.col("score")).alias("order"), *own, *rest)
    bands = in_bands(lines, [*keys, "text"]) if threshold >= 0 else lines.withColumn("_band", F.lit(0))
    per_text = bands.groupBy(*keys, "text", "_band").agg(F.sort_array(F.collect_list(item)).alias("_all"))
    kept = per_text.withColumn("_kept", suppress("_all", lambda a, b: overlap_ratio(a["box"], b["box"]) > threshold))
    return kept.select(*keys, "text", F.explode("_kept").alias("_b")).select(*keys, "_b.line_id", "text", "_b.score", "_b.box", *[f"_b.{c}" for c in rest])


def sort_boxes(boxes: DataFrame, keys: list[str], step: float = 10.0) -> DataFrame:
    """Adds ``row_no`` and ``place`` (from 1): a row ends where the next box, by its top, is ``step`` or more lower."""
    down = Window.partitionBy(*keys).orderBy(F.col("box.y0"), "box_id")
    new = F.coalesce((F.col("box.y0") - F.lag("box.y0").over(down) >= step).cast("int"), F.lit(0))
    rows = boxes.withColumn("_new", new).withColumn("row_no", F.sum("_new").over(down).cast("int")).drop("_new")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("row_no", F.col("box.x0"), F.col("box.y0"), "box_id")))


def tile_starts(length: Column, tile: int, step: int) -> Column:
    """Starts of tiles that cover a length, ``step`` apart, the last flush with the end."""
    steps = F.greatest(F.ceil((length - tile) / F.lit(step)).cast("int") - 1, F.lit(0))
    inner = F.transform(F.sequence(F.lit(0), steps), lambda i: i * step)
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_append(inner, length - tile)).cast("array<int>")


def tiles(images: DataFrame, size: int, step: int) -> DataFrame:
    """One row per tile of ``width`` by ``height``: adds ``tile_no``, row by row from 1, and its ``box``.  Nothing is shuffled."""
    across, down = tile_starts(F.col("width"), size, step), tile_starts(F.col("height"), size, step)
    places = F.flatten(F.transform(down, lambda y: F.transform(across, lambda x: box(x, y, F.least(x + size, F.col("width")), F.least(y + size, F.col("height"))))))
    rows = images.select(*images.columns, F.posexplode(places).alias("tile_no", "box"))
    return rows.withColumn("tile_no", F.col("tile_no") + 1)


def moved(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def rotated_back(b: Column, width: Column, height: Column, clockwise: bool) -> Column:
    """The box, in an image of this size, of one that was found in the image turned by a quarter."""
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top.cast("double")))
    x, y = (("y0", "y1"), (height - b["x1"], height - b["x0"])) if clockwise else (None, None)
    if clockwise:
        return box(clamp(b[x[0]], width), clamp(y[0], height), clamp(b[x[1]], width), clamp(y[1], height))
    return box(clamp(width - b["y1"], width), clamp(b["x0"], height), clamp(width - b["y0"], width), clamp(b["x1"], height))


def uniform_bounds(n: Column) -> Column:
    """Equal shares of a line for each of its characters."""
    share = lambda i: F.struct((i / n).cast("double").alias("t0"), ((i + 1) / n).cast("double").alias("t1"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), share)).otherwise(F.array().cast("array<struct<t0:double,t1:double>>"))


def word_bounds(text: Column, polygon: Column, words: Column) -> Column:
    """Bounds by the words' own polygons along the line's reading axis; equal shares where the words don't fit the text.

    ``words``: ``array<struct<text, polygon>>``.  Characters between words share the gap equally.
    """
    n = F.char_length(text)
    ax, ay = polygon[1]["x"] - polygon[0]["x"], polygon[1]["y"] - polygon[0]["y"]
    norm = F.when(ax * ax + ay * ay == 0, 1.0).otherwise(ax * ax + ay * ay)
    along = lambda q: ((q["x"] - polygon[0]["x"]) * ax + (q["y"] - polygon[0]["y"]) * ay) / norm
    named = F.filter(words, lambda w: F.trim(w["text"]) != "")
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("fits"), F.array().cast("array<struct<start:int,size:int,t0:double,t1:double>>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        word = F.trim(w["text"])
        found = F.call_function("locate", word, text, a["at"] + 1) - 1
        ts = F.transform(w["polygon"], along)
        item = F.struct(found.cast("int").alias("start"), F.char_length(word).alias("size"), F.array_min(ts).alias("t0"), F.array_max(ts).alias("t1"))
        return F.struct((found + F.char_length(word)).cast("int").alias("at"), (a["fits"] & (found >= 0)).alias("fits"), F.concat(a["out"], F.array(item)).alias("out"))

    placed = F.aggregate(named, start, step)

    def bound(i: Column, out: Column) -> Column:
        own = F.get(F.filter(out, lambda w: (i >= w["start"]) & (i < w["start"] + w["size"])), F.lit(0))
        left = F.element_at(F.filter(out, lambda w: w["start"] + w["size"] <= i), -1)
        right = F.get(F.filter(out, lambda w: w["start"] > i), F.lit(0))
        a, b = F.coalesce(left["t1"], F.lit(0.0)), F.coalesce(right["t0"], F.lit(1.0))
        first = F.coalesce(left["start"] + left["size"], F.lit(0))
        run = F.coalesce(right["start"], n) - first
        cut = lambda k: a + (b - a) * k / run
        each = (own["t1"] - own["t0"]) / own["size"]
        return F.struct(
            F.coalesce(own["t0"] + (i - own["start"]) * each, cut(i - first)).alias("t0"),
            F.coalesce(own["t0"] + (i - own["start"] + 1) * each, cut(i - first + 1)).alias("t1"),
        )

    fitted = F.when((F.size(named) > 0) & placed["fits"], F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: bound(i, placed["out"])))
    return F.when(n > 0, F.coalesce(fitted, uniform_bounds(n))).otherwise(F.array().cast("array<struct<t0:double,t1:double>>"))


def _padded(bounds: Column, n: Column, start: Column, end: Column, pad: float) -> tuple[Column, Column]:
    """Where a span starts and ends on its line, as shares, with a margin of part of a character."""
    s = F.greatest(F.lit(0), F.least(start, n - 1))
    e = F.greatest(s + 1, F.least(end, n))
    t0, t1 = F.get(bounds, s)["t0"], F.get(bounds, e - 1)["t1"]
    width = (t1 - t0) / F.greatest(F.lit(1), e - s)
    zero, one = F.lit(0.0), F.lit(1.0)
    low = F.when(s > 0, F.greatest(zero, t0 - pad * width)).otherwise(F.least(zero, t0 - pad * width))
    high = F.when(e < n, F.least(one, t1 + pad * width)).otherwise(F.greatest(one, t1 + pad * width))
    return low, high


def _bounds_of(line: Column) -> Column:
    n = F.char_length(line["text"])
    return F.when(F.size(line["bounds"]) > 0, line["bounds"]).otherwise(uniform_bounds(n))


def span_box(line: Column, start: Column, end: Column, pad_chars: float = 0.35, pad_y: float = 0.08) -> Column:
    """The box of characters ``start`` to ``end`` of a line struct; ``orientation`` cw or ccw is text turned by a quarter."""
    b = line["box"]
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]

    def ends(bounds: Column) -> Column:
        low, high = _padded(bounds, F.size(bounds), start, end, pad_chars)
        return F.struct(low.alias("low"), high.alias("high"))

    def placed(t: Column) -> Column:
        t0, t1 = t["low"], t["high"]
        flat = box(b["x0"] + t0 * w, b["y0"] - pad_y * h, b["x0"] + t1 * w, b["y1"] + pad_y * h)
        cw = box(b["x0"] - pad_y * w, b["y0"] + (1 - t1) * h, b["x1"] + pad_y * w, b["y0"] + (1 - t0) * h)
        ccw = box(b["x0"] - pad_y * w, b["y0"] + t0 * h, b["x1"] + pad_y * w, b["y0"] + t1 * h)
        return F.when(line["orientation"] == "cw", cw).when(line["orientation"] == "ccw", ccw).otherwise(flat).cast(BOX)

    return let(let(_bounds_of(line), ends), placed)


def span_polygon(polygon: Column, bounds: Column, start: Column, end: Column, pad_chars: float = 0.35, pad_y: float = 0.08) -> Column:
    """The same on a line that may lie at any angle, given by its corners."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    out = lambda a, b: point(a["x"] + pad_y * (a["x"] - b["x"]), a["y"] + pad_y * (a["y"] - b["y"]))
    lerp = lambda a, b, t: point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)

    def ends(b: Column) -> Column:
        low, high = _padded(b, F.size(b), start, end, pad_chars)
        return F.struct(low.alias("low"), high.alias("high"))

    def sides(p: Column) -> Column:
        tl, tr, br, bl = (p[i] for i in range(4))
        return F.array(out(tl, bl), out(tr, br), out(br, tr), out(bl, tl))

    corners = lambda t, s: F.array(lerp(s[0], s[1], t["low"]), lerp(s[0], s[1], t["high"]), lerp(s[3], s[2], t["high"]), lerp(s[3], s[2], t["low"]))
    return let(let(bounds, ends), lambda t: let(let(polygon, sides), lambda s: corners(t, s))).cast(POLYGON)


def face_box(b: Column, width: Column, height: Column) -> Column:
    """A face's box with a margin: more for small faces, and more above than below; inside the image."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    pad = F.when(F.greatest(w, h) < 64, 0.55).otherwise(0.35)
    return box(F.greatest(F.lit(0.0), b["x0"] - pad * w), F.greatest(F.lit(0.0), b["y0"] - 1.3 * pad * h), F.least(width.cast("double"), b["x1"] + pad * w), F.least(height.cast("double"), b["y1"] + pad * h))


def face_cells(cells: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``cells``, a detector's ``stride, row, col, cls, obj, dx, dy, lw, lh``, with ``score`` and ``box``; those under the threshold go.

    A cell's score is the root of its two chances, its centre is moved by ``dx, dy`` cells, and its size is the exponential
    of ``lw, lh`` in cells.
    """
    chance = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    x, y = (F.col("col") + F.col("dx")) * F.col("stride"), (F.col("row") + F.col("dy")) * F.col("stride")
    w, h = F.exp("lw") * F.col("stride"), F.exp("lh") * F.col("stride")
    found = cells.withColumn("score", F.sqrt(chance("cls") * chance("obj"))).where(F.col("score") >= threshold)
    return found.withColumn("box", box(x - w / 2, y - h / 2, x + w / 2, y + h / 2))


def decode_faces(cells: DataFrame, keys: list[str], threshold: float = 0.7, overlap: float = 0.3) -> DataFrame:
    """Faces from a detector's cells: of those that overlap the best stays."""
    found = face_cells(cells, threshold)
    return nms(found.select(*keys, F.struct("stride", "row", "col").alias("box_id"), "score", "box"), keys, overlap)


def code_regions(codes: DataFrame, pad: float = 6.0) -> DataFrame:
    """Adds ``polygon`` to found codes with ``points`` and the image's ``width, height``: the box round the points, padded."""
    b = polygon_box(F.col("points"))
    edge = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.col(top).cast("double"))
    around = box(edge(b["x0"] - pad, "width"), edge(b["y0"] - pad, "height"), edge(b["x1"] + pad, "width"), edge(b["y1"] + pad, "height"))
    return codes.withColumn("polygon", box_polygon(around))


def reading_batches(boxes: DataFrame, keys: list[str], size: int = 6) -> DataFrame:
    """Adds ``batch_no``, from 0: boxes of an image by shape, narrow ones first, so that those read together are alike."""
    shape = (F.col("box.x1") - F.col("box.x0")) / (F.col("box.y1") - F.col("box.y0"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(shape, "box_id"))
    return boxes.withColumn("batch_no", F.floor((place - 1) / size).cast("int"))
