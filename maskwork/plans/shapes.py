"""More queries: boxes, polygons, decoding, layout and pixels on values made from the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from maskwork.operators import entities as E
from maskwork.operators import geometry as G
from maskwork.operators import images as I
from maskwork.operators import layout as L
from maskwork.plans.queries import _boxes, _form, query
from maskwork.session import by_key, dealt


def _pair(t):
    """Two boxes for each part, moved apart by its key."""
    k = F.col("p_partkey")
    one = G.box(F.lit(0), F.lit(0), 10 + k % 7, F.lit(10))
    two = G.box(k % 11, k % 5, k % 11 + 8, k % 5 + 12)
    return t("part").select("p_partkey", one.alias("a"), two.alias("b"))


@query(
    """SELECT p_partkey, round(s / (a + b - s), 6) AS iou, round(s / least(a, b), 6) AS ratio, w > 0 AND h > 0 AS touch FROM (
    SELECT *, w * h AS s FROM (SELECT p_partkey, (10 + p_partkey % 7) * 10.0 AS a, 96.0 AS b, greatest(0, least(10 + p_partkey % 7, p_partkey % 11 + 8) - p_partkey % 11) AS w, greatest(0, least(10, p_partkey % 5 + 12) - p_partkey % 5) AS h FROM part))"""
)
def box_overlaps(t):
    a, b = F.col("a"), F.col("b")
    return _pair(t).select("p_partkey", F.round(G.iou(a, b), 6).alias("iou"), F.round(G.overlap_ratio(a, b), 6).alias("ratio"), G.boxes_overlap(a, b).alias("touch"))


@query("SELECT p_partkey, y0 AS cw_x0, 50 - (x + 8)::DOUBLE AS cw_y0, greatest(0, 100 - (y0 + 12))::DOUBLE AS ccw_x0, x::DOUBLE AS ccw_y0 FROM (SELECT p_partkey, p_partkey % 11 AS x, (p_partkey % 5)::DOUBLE AS y0 FROM part)")
def turned_boxes(t):
    """Boxes found in an image of 100 by 50 turned by a quarter, put back."""
    back = lambda way: G.rotated_back(F.col("b"), F.lit(100), F.lit(50), way)
    rows = _pair(t).select("p_partkey", back(True).alias("cw"), back(False).alias("ccw"))
    return rows.select("p_partkey", F.col("cw.x0").alias("cw_x0"), F.col("cw.y0").alias("cw_y0"), F.col("ccw.x0").alias("ccw_x0"), F.col("ccw.y0").alias("ccw_y0"))


STARTS = "CASE WHEN {n} <= 640 THEN [0] ELSE list_concat(list_filter(range(0, {n}, 512), lambda s: s + 640 < {n}), [{n} - 640]) END"


@query(
    f"""SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY y, x)::INT AS tile_no, x::DOUBLE AS x0, y::DOUBLE AS y0, least(x + 640, w)::DOUBLE AS x1, least(y + 640, h)::DOUBLE AS y1
FROM (SELECT p_partkey, w, h, x, unnest({STARTS.format(n="h")}) AS y FROM (SELECT p_partkey, w, h, unnest({STARTS.format(n="w")}) AS x FROM (SELECT p_partkey, p_partkey * 37 % 3000 + 1 AS w, p_partkey * 53 % 1500 + 1 AS h FROM part)))"""
)
def image_tiles(t):
    k = F.col("p_partkey")
    images = t("part").select("p_partkey", (k * 37 % 3000 + 1).cast("int").alias("width"), (k * 53 % 1500 + 1).cast("int").alias("height"))
    return G.tiles(images, 640, 512).select("p_partkey", "tile_no", "box.x0", "box.y0", "box.x1", "box.y1")


@query(
    """WITH s AS (SELECT p_partkey, i, (p_partkey // (3 ** i)::BIGINT) % 3 AS c, 0.5 + (p_partkey + i) % 4 / 10 AS p FROM part, range(6) r(i)),
k AS (SELECT *, lag(c) OVER (PARTITION BY p_partkey ORDER BY i) AS before FROM s)
SELECT p_partkey, coalesce(string_agg(CASE c WHEN 1 THEN 'a' ELSE 'b' END, '' ORDER BY i) FILTER (c <> 0 AND before IS DISTINCT FROM c), '') AS text,
    coalesce(round(avg(p) FILTER (c <> 0 AND before IS DISTINCT FROM c), 6), 0) AS score, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (c <> 0 AND before IS DISTINCT FROM c), '') AS steps
FROM k GROUP BY p_partkey"""
)
def decoded_lines(t):
    """Six steps for each part, whose best letter is a digit of its key to base three; 0 is the blank."""
    k = F.col("p_partkey")
    best = lambda i: F.floor(k / 3**i).cast("int") % 3
    chance = lambda i, c: F.when(best(i) == c, 0.5 + (k + i) % 4 / 10).otherwise(F.lit(0.01))
    steps = F.array(*[F.array(*[chance(i, c) for c in range(3)]) for i in range(6)])
    rows = t("part").select("p_partkey", E.ctc_decode(steps, F.array(F.lit(""), F.lit("a"), F.lit("b"))).alias("d"))
    return rows.select("p_partkey", "d.text", F.round("d.score", 6).alias("score"), F.array_join("d.cols", ",").alias("steps"))


@query(
    """WITH m AS (SELECT p_partkey, g, (0.5 * 100 / 20 / 100) AS m0, ((g + 2.5) / 20) AS m1 FROM (SELECT p_partkey, p_partkey % 9 AS g FROM part))
SELECT p_partkey, round(greatest(0, m0 - (m1 - m0) / 2), 6) AS t0, round((m0 + m1) / 2, 6) AS middle, round(least(1, m1 + (m1 - m0) / 2), 6) AS t1 FROM m"""
)
def decoded_bounds(t):
    """Two characters, read at the first of 20 steps and at a later one by the key: each reaches to the middle between them."""
    cols = F.array(F.lit(0), (F.col("p_partkey") % 9 + 2).cast("int"))
    rows = t("part").select("p_partkey", E.ctc_bounds(cols, F.lit(20), F.lit(100), F.lit(100)).alias("b"))
    first, last = F.col("b")[0], F.col("b")[1]
    return rows.select("p_partkey", F.round(first["t0"], 6).alias("t0"), F.round(first["t1"], 6).alias("middle"), F.round(last["t1"], 6).alias("t1"))


COVERS = "greatest(0, least(y.x, z[1].x) + 20 - greatest(y.x, z[1].x)) * greatest(0, least(y.y, z[1].y) + 12 - greatest(y.y, z[1].y)) / 240 > 0.75"


@query(
    f"""SELECT k AS l_orderkey, u.b AS line_id, u.t AS text FROM (SELECT k, t, unnest(list_reduce(list_transform(list_sort(list({{'o': -q, 'b': b, 't': t, 'x': ax, 'y': ay}})), lambda x: [x]),
    lambda acc, z: CASE WHEN len(list_filter(acc, lambda y: {COVERS})) = 0 THEN list_concat(acc, z) ELSE acc END)) AS u
FROM (SELECT k, b, t, q, p.x AS ax, p.y AS ay FROM (SELECT l_orderkey AS k, l_linenumber::INT AS b, 't' || l_linenumber % 2 AS t, min(l_quantity) AS q, min({{'x': (l_partkey % 60 // 20)::DOUBLE, 'y': (l_suppkey % 40 // 20)::DOUBLE}}) AS p FROM lineitem GROUP BY 1, 2, 3)) GROUP BY k, t)"""
)
def deduped_lines(t):
    """Lines of two texts, a pixel or two apart: the best of each heap stays."""
    own = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = by_key(own, "l_orderkey", own.count()).groupBy("l_orderkey", F.col("l_linenumber").cast("int").alias("line_id")).agg(
        F.min(F.struct(F.floor(F.col("l_partkey") % 60 / 20).cast("double").alias("x"), F.floor(F.col("l_suppkey") % 40 / 20).cast("double").alias("y"))).alias("p"), F.min("l_quantity").alias("score")
    )
    lines = rows.select("l_orderkey", "line_id", F.concat(F.lit("t"), (F.col("line_id") % 2).cast("string")).alias("text"), "score", G.box(F.col("p.x"), F.col("p.y"), F.col("p.x") + 20, F.col("p.y") + 12).alias("box"))
    return G.dedupe_lines(lines, ["l_orderkey"]).select("l_orderkey", "line_id", "text")


@query("SELECT c_custkey, 'Password:field ' || c_custkey AS text, '0,9' AS places FROM customer WHERE c_custkey % 7 = 0")
def compacted_rows(t):
    rows = L.group_rows(_form(t), "c_custkey").where(F.size("parts") > 1)
    return L.compact_rows(rows).select("c_custkey", "text", F.array_join(F.transform("parts", lambda p: p["offset"].cast("string")), ",").alias("places"))


@query("SELECT c_custkey, 'Password:' || CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE chr(10) END || 'field ' || c_custkey || chr(10) || 'below ' || c_custkey AS text, 3 AS n_parts FROM customer")
def whole_pages(t):
    pages = L.document_rows(L.group_rows(_form(t), "c_custkey"), "c_custkey")
    return pages.select("c_custkey", "text", F.size("parts").alias("n_parts"))


@query("SELECT c_custkey, n::INT AS detection_id, CASE WHEN n = 1 THEN 'EMAIL' ELSE 'MANUAL' END AS label, CASE WHEN n = 1 THEN 'rule' ELSE 'you' END AS source FROM customer, range(1, 4) r(n) WHERE n <= 1 + c_custkey % 3")
def manual_boxes(t):
    """A detection for each customer, and none, one or two boxes drawn by hand, numbered on."""
    c = F.col("c_custkey")
    at = lambda y: G.box(F.lit(0), y, F.lit(9), y + 5)
    found = t("customer").select(c, F.lit(1).alias("detection_id"), F.lit("contact").alias("category"), F.lit("EMAIL").alias("label"), at(F.lit(0)).alias("box"), F.lit(1.0).alias("score"), F.lit("rule").alias("source"), F.lit("a@b.org").alias("text"))
    drawn = t("customer").where(c % 3 > 0).select(c, F.explode(F.sequence(F.lit(1), (c % 3).cast("int"))).alias("i")).select(c, at(F.col("i") * 10).alias("box"))
    return L.with_manual(found, drawn, "c_custkey").select("c_custkey", "detection_id", "label", "source")


@query(
    """SELECT l_orderkey, box_id, round(greatest(0, x - p * 20), 6) AS x0, round(greatest(0, y - 1.3 * p * 12), 6) AS y0, round(least(75, x + 20 + p * 20), 6) AS x1, round(least(50, y + 12 + p * 12), 6) AS y1
FROM (SELECT *, b.x AS x, b.y AS y, 0.55::DOUBLE AS p FROM (SELECT l_orderkey, l_linenumber::INT AS box_id, min({'x': (l_partkey % 60)::DOUBLE, 'y': (l_suppkey % 40)::DOUBLE}) AS b FROM lineitem GROUP BY ALL))"""
)
def face_margins(t):
    b = G.face_box(F.col("box"), F.lit(75), F.lit(50))
    return _boxes(t).withColumn("f", b).select("l_orderkey", "box_id", *[F.round(f"f.{k}", 6).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query(
    """SELECT c_custkey, round(x0 + (s / n - 0.35 / n) * 200, 6) AS x0, round(x0 + CASE WHEN e < n THEN least(1, e / n + 0.35 / n) ELSE greatest(1, e / n + 0.35 / n) END * 200, 6) AS x1, 8.4::DOUBLE AS y0, 31.6::DOUBLE AS y1
FROM (SELECT c_custkey, (c_custkey % 50)::DOUBLE AS x0, length(c_name)::DOUBLE AS n, (c_custkey % 3)::DOUBLE AS s, (c_custkey % 3 + 2)::DOUBLE AS e FROM customer)"""
)
def span_polygons(t):
    """The corners of spans on upright lines make the boxes of these spans."""
    x, s = (F.col("c_custkey") % 50).cast("double"), (F.col("c_custkey") % 3).cast("int")
    around = G.box_polygon(G.box(x, F.lit(10), x + 200, F.lit(30)))
    shape = G.span_polygon(around, G.uniform_bounds(F.char_length("c_name")), s, s + 2)
    rows = t("customer").select("c_custkey", shape.alias("p")).withColumn("b", G.polygon_box(F.col("p")))
    return rows.select("c_custkey", *[F.round(f"b.{k}", 6).alias(k) for k in ("x0", "x1", "y0", "y1")])


@query(
    """SELECT p_partkey, i - 1 AS place, (coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0))::INT AS start, (coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0) + length(w[i]))::INT AS "end"
FROM (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, string_split(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS w FROM part))"""
)
def aligned_words(t):
    """Words in lower case, put back at their places in names."""
    name = F.trim(F.regexp_replace("p_name", "[^A-Za-z0-9]+", " "))
    rows = t("part").select("p_partkey", F.posexplode(E.align_tokens(name, F.split(F.lower(name), " "))).alias("place", "o"))
    return rows.select("p_partkey", F.col("place").cast("long").alias("place"), F.col("o")[0].alias("start"), F.col("o")[1].alias("end"))


@query("SELECT p_partkey, (3 * (p_partkey % 7 + 2) * 4)::BIGINT AS n_black FROM part")
def blackened_pixels(t):
    """A white image for each part with a black box by its key, written as PNG and read again."""
    k = F.col("p_partkey")
    images = dealt(t("part").select("p_partkey")).select("p_partkey", F.lit(12).alias("width"), F.lit(8).alias("height"), F.unhex(F.repeat(F.lit("FF"), 12 * 8 * 3)).alias("data"))
    regions = t("part").select("p_partkey", G.box_polygon(G.box(F.lit(1), F.lit(2), 2 + k % 7, F.lit(5))).alias("polygon"))

    def black(batches):
        for b in batches:
            yield pd.DataFrame({"p_partkey": b["p_partkey"], "n_black": [int((I.decode_png(bytes(png)) == 0).sum()) for png in b["png"]]})

    return I.redact_images(images, regions, "p_partkey").mapInPandas(black, "p_partkey long, n_black long")
