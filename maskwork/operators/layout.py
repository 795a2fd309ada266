"""Lines of text with boxes: rows of lines, values of labels, and the detections of whole pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwork.operators.geometry import box_polygon, boxes_overlap, polygon_box, span_box, span_polygon, suppress, uniform_bounds, word_bounds
from maskwork.operators.registry import SECRET_LABEL_ONLY
from maskwork.operators.spans import let, merge_spans, with_spans
from maskwork.schemas import BOX, LINE, POLYGON, SPANS

_PART = f"struct<line:{LINE},offset:int>"


def line_struct(lines: DataFrame) -> DataFrame:
    """``lines`` with missing optional columns, and a ``line`` struct of all.

    Lines at any angle have a ``polygon``, their corners from the top left along the text, and their ``box`` is the one round
    it if they have none.  ``words array<struct<text, polygon>>`` give the characters their bounds where lines have none.
    """
    have = set(lines.columns)
    if "box" not in have:
        lines = lines.withColumn("box", polygon_box(F.col("polygon")))
    if "bounds" not in have and {"polygon", "words"} <= have:
        lines = lines.withColumn("bounds", F.when(F.col("polygon").isNotNull() & F.col("words").isNotNull(), word_bounds(F.col("text"), F.col("polygon"), F.col("words"))))
    for name, default in (("score", F.lit(1.0)), ("bounds", F.array().cast("array<struct<t0:double,t1:double>>")), ("orientation", F.lit(None).cast("string")), ("polygon", F.lit(None).cast(POLYGON))):
        if name not in lines.columns:
            lines = lines.withColumn(name, default)
    return lines.withColumn("line", F.struct(F.col("line_id").cast("int").alias("line_id"), "text", "score", "box", "bounds", "orientation", "polygon").cast(LINE))


def group_rows(lines: DataFrame, key: str, max_gap: float = 2.5) -> DataFrame:
    """``key, row_id (from 1), text, parts array<struct<line, offset>>``: boxes on one text row, close together, as one line.

    Lines are taken from the left; each joins the first row, in order of making, whose last box is of like height and
    overlaps it vertically, and starts not too far behind it.  Rows are numbered from the top.  Equal places go by
    ``line_id``.  A page's lines are settled in one aggregate, as each choice depends on those before.
    """
    page = line_struct(lines).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("box.x0").alias("x"), "line_id", "line"))).alias("_lines"))
    empty = F.array().cast(f"array<struct<text:string,parts:array<{_PART}>>>")

    def step(rows: Column, item: Column) -> Column:
        line = item["line"]
        b = line["box"]
        h = b["y1"] - b["y0"]

        def near(r: Column) -> Column:
            last = F.element_at(r["parts"], -1)["line"]["box"]
            lh, gap = last["y1"] - last["y0"], b["x0"] - last["x1"]
            level = F.least(last["y1"], b["y1"]) - F.greatest(last["y0"], b["y0"]) >= 0.6 * F.least(h, lh)
            return level & (F.abs(h - lh) <= 0.4 * F.greatest(h, lh)) & (gap >= -0.5 * h) & (gap <= max_gap * F.greatest(h, lh))

        at = F.array_position(F.transform(rows, near), True)
        joined = F.transform(
            rows,
            lambda r, i: F.when(
                i + 1 == at,
                F.struct(F.concat(r["text"], F.lit(" "), line["text"]).alias("text"), F.concat(r["parts"], F.array(F.struct(line.alias("line"), (F.char_length(r["text"]) + 1).alias("offset")).cast(_PART))).alias("parts")),
            ).otherwise(r),
        )
        new = F.struct(line["text"].alias("text"), F.array(F.struct(line.alias("line"), F.lit(0).alias("offset")).cast(_PART)).alias("parts"))
        return F.when(at > 0, joined).otherwise(F.concat(rows, F.array(new)))

    rows = page.select(key, F.explode(F.aggregate("_lines", empty, step)).alias("_r")).select(key, "_r.text", "_r.parts")
    first = F.col("parts")[0]["line"]
    return rows.withColumn("row_id", F.row_number().over(Window.partitionBy(key).orderBy(first["box"]["y0"], first["box"]["x0"], first["line_id"])))


def compact_rows(rows: DataFrame) -> DataFrame:
    """The same rows with nothing between their parts, for values that were split inside."""
    start = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{_PART}>").alias("parts"))
    step = lambda a, p: F.struct(F.concat(a["text"], p["line"]["text"]).alias("text"), F.concat(a["parts"], F.array(F.struct(p["line"].alias("line"), F.char_length(a["text"]).alias("offset")))).alias("parts"))
    return rows.withColumn("_c", F.aggregate("parts", start, step)).withColumns({"text": F.col("_c.text"), "parts": F.col("_c.parts")}).drop("_c")


def document_rows(rows: DataFrame, key: str) -> DataFrame:
    """One row per page: all its rows, with line ends between them."""
    page = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("row_id", "text", "parts"))).alias("_rows"))
    start = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{_PART}>").alias("parts"))

    def step(a: Column, r: Column) -> Column:
        text = F.when(a["text"] == "", a["text"]).otherwise(F.concat(a["text"], F.lit("\n")))
        parts = F.transform(r["parts"], lambda p: F.struct(p["line"].alias("line"), (p["offset"] + F.char_length(text)).alias("offset")))
        return F.struct(F.concat(text, r["text"]).alias("text"), F.concat(a["parts"], parts).alias("parts"))

    return page.withColumn("_d", F.aggregate("_rows", start, step)).select(key, F.lit(0).alias("row_id"), "_d.text", "_d.parts")


def row_span_box(parts: Column, start: Column, end: Column) -> Column:
    """The box around a span of a row, which may run over several of its parts; the first character's if over none."""
    n = lambda p: F.char_length(p["line"]["text"])
    own = F.filter(parts, lambda p: F.least(end, p["offset"] + n(p)) > F.greatest(start, p["offset"]))
    boxes = F.transform(own, lambda p: span_box(p["line"], F.greatest(start, p["offset"]) - p["offset"], F.least(end, p["offset"] + n(p)) - p["offset"]))
    side = lambda all_, k, f: f(F.transform(all_, lambda b: b[k]))
    around = lambda all_: F.struct(*[side(all_, k, f).alias(k) for k, f in (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max))])
    return let(boxes, lambda all_: F.when(F.size(all_) > 0, around(all_)).otherwise(span_box(parts[0]["line"], F.lit(0), F.lit(1)))).cast(BOX)


def row_span_polygon(parts: Column, start: Column, end: Column) -> Column:
    """The same on lines at any angle (``line.polygon``, else its box): a span in one part has its own corners, one over several
    the box around them, one over none the first character's."""
    n = lambda p: F.char_length(p["line"]["text"])
    turned = lambda p, a, b: span_polygon(p["line"]["polygon"], F.when(F.size(p["line"]["bounds"]) > 0, p["line"]["bounds"]).otherwise(uniform_bounds(n(p))), a, b)
    shape = lambda p, a, b: F.when(p["line"]["polygon"].isNotNull(), turned(p, a, b)).otherwise(box_polygon(span_box(p["line"], a, b)))
    own = F.filter(parts, lambda p: F.least(end, p["offset"] + n(p)) > F.greatest(start, p["offset"]))
    shapes = F.transform(own, lambda p: shape(p, F.greatest(start, p["offset"]) - p["offset"], F.least(end, p["offset"] + n(p)) - p["offset"]))
    around = lambda all_: box_polygon(let(F.flatten(all_), polygon_box))
    return let(shapes, lambda all_: F.when(F.size(all_) == 1, F.get(all_, F.lit(0))).when(F.size(all_) > 1, around(all_)).otherwise(shape(parts[0], F.lit(0), F.lit(1))))


def labelled_values(lines: DataFrame, key: str, label: str = SECRET_LABEL_ONLY, max_gap: float = 20.0, below: bool = True) -> DataFrame:
    """``key, label_id, line_id``: for each line that is only a label, the nearest line to its right, or else below it.

    The value is at least three characters long, and a label without such a neighbour has none.  A nearest-neighbour join
    within each page: an equal key, a range of places, and the smallest rank.
    """
    labels = lines.where(F.col("text").rlike(label)).select(key, F.col("line_id").alias("label_id"), F.col("box").alias("lb"))
    h = F.col("lb.y1") - F.col("lb.y0")
    b, oh = F.col("box"), F.col("box.y1") - F.col("box.y0")
    level = F.least(b["y1"], F.col("lb.y1")) - F.greatest(b["y0"], F.col("lb.y0")) >= 0.5 * F.least(h, oh)
    right = (b["x0"] >= F.col("lb.x1") - 0.5 * h) & (b["x0"] - F.col("lb.x1") <= max_gap * h) & level
    under = (b["y0"] >= F.col("lb.y1") - 0.25 * h) & (b["y0"] - F.col("lb.y1") <= 3 * h) & (F.least(b["x1"], F.col("lb.x1")) - F.greatest(b["x0"], F.col("lb.x0")) >= -0.25 * h)
    rank = F.when(right, F.struct(F.lit(0).alias("way"), b["x0"].alias("a"), F.lit(0.0).alias("b"), F.col("line_id").alias("id")))
    if below:
        rank = rank.when(under, F.struct(F.lit(1).alias("way"), b["y0"].alias("a"), b["x0"].alias("b"), F.col("line_id").alias("id")))
    pairs = lines.join(labels, key).where(F.col("line_id") != F.col("label_id")).withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = pairs.groupBy(key, "label_id").agg(F.min_by(F.struct("line_id", "text"), "_rank").alias("_v"))
    return best.where(F.char_length(F.trim("_v.text")) >= 3).select(key, "label_id", "_v.line_id")


def detect(lines: DataFrame, key: str, categories: Sequence[str] | None = None, custom_terms: Sequence[str] = (), entities: DataFrame | None = None) -> DataFrame:
    """All detections of pages of lines: ``key, detection_id, category, label, box, score, source, text, polygon``.

    Rows are scanned, then rows without the gaps between their parts, of which only what overlaps no detection is new,
    then whole pages for spans over line ends, then values beside labels.  ``entities (key, row_id, spans)`` are joined to
    the rows' own spans where they overlap none.  Detections on lines with polygons have turned corners and the box round them.
    """
    upright = "polygon" not in lines.columns
    lines = line_struct(lines)
    rows = group_rows(lines, key)
    scan = lambda r: with_spans(r, "text", categories, custom_terms)
    first = scan(rows)
    if entities is not None:
        first = first.join(entities.select(key, "row_id", F.col("spans").alias("_more")), [key, "row_id"], "left")
        first = first.withColumn("spans", merge_spans("spans", F.coalesce("_more", F.array().cast(SPANS)))).drop("_more")

    def placed(rows: DataFrame, boxed: Column, shape: Column) -> DataFrame:
        """With ``box`` and ``polygon``; the expressions of turned lines are there only if some may be."""
        if upright:
            return rows.withColumn("box", boxed).withColumn("polygon", box_polygon(F.col("box")))
        return rows.withColumn("polygon", shape).withColumn("box", polygon_box(F.col("polygon")))

    def located(r: DataFrame, stage: int) -> DataFrame:
        out = r.select(key, "row_id", "text", "parts", F.posexplode("spans").alias("n", "s"))
        at = (F.col("parts"), F.col("s.start"), F.col("s.end"))
        out = placed(out, row_span_box(*at), row_span_polygon(*at))
        return out.select(key, F.lit(stage).alias("stage"), "row_id", "n", "s.category", "s.label", "box", "polygon", "s.score", "s.source", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("text"))

    found = located(first, 1)
    found = found.unionByName(located(scan(compact_rows(rows.where(F.size("parts") > 1))), 2))
    pages = scan(document_rows(rows, key).where(F.col("text").contains("\n")))
    found = found.unionByName(located(pages, 3).where(F.col("text").contains("\n")))
    if categories is None or "secrets" in categories:
        values = labelled_values(lines, key).select(key, "line_id").distinct().join(lines.select(key, "line_id", "line"), [key, "line_id"])
        part = F.array(F.struct(F.col("line"), F.lit(0).alias("offset")))
        n = F.char_length(F.col("line")["text"])
        values = placed(values, span_box(F.col("line"), F.lit(0), n), row_span_polygon(part, F.lit(0), n)).select(key, F.lit(4).alias("stage"), F.col("line_id").cast("int").alias("row_id"), F.lit(0).alias("n"), F.lit("secrets").alias("category"), F.lit("PASSWORD_OR_SECRET").alias("label"), "box", "polygon", F.lit(0.9).alias("score"), F.lit("rule").alias("source"), F.col("line")["text"].alias("text"))
        found = found.unionByName(values)
    order = ["stage", "row_id", "n"]
    page = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in found.columns if c not in (key, *order)]))).alias("_all"))
    kept = suppress("_all", lambda k, z: z["stage"].isin(2, 4) & boxes_overlap(k["box"], z["box"]))
    return page.select(key, F.posexplode(kept).alias("_i", "_d")).select(key, (F.col("_i") + 1).alias("detection_id"), *[f"_d.{c}" for c in ("category", "label", "box", "score", "source", "text", "polygon")])


def with_manual(detections: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Detections and boxes drawn by hand (``key, box``), numbered on from the last."""
    last = detections.groupBy(key).agg(F.max("detection_id").alias("_n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(f"box.{k}") for k in ("y0", "x0", "y1", "x1")]))
    own = boxes.withColumn("_i", place).join(last, key, "left").select(
        key, (F.coalesce("_n", F.lit(0)) + F.col("_i")).alias("detection_id"), F.lit("custom").alias("category"), F.lit("MANUAL").alias("label"), "box", F.lit(1.0).alias("score"), F.lit("you").alias("source"), F.lit("").alias("text")
    )
    if "polygon" in detections.columns:
        own = own.withColumn("polygon", box_polygon(F.col("box")))
    return detections.unionByName(own)
