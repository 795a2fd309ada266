"""Queries over pictures that are made, by built-in functions, from the driver's tables: crops, reading, entities, faces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwork.operators import codes as C
from maskwork.operators import entities as E
from maskwork.operators import faces as A
from maskwork.operators import geometry as G
from maskwork.operators import reading as R
from maskwork.operators import tensors as X
from maskwork.plans.queries import query
from maskwork.session import dealt


def _hex(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2, "0")


def _samples(digits: str) -> Column:
    """Samples as a string of raw bytes, which ``repeat`` and ``concat`` copy as they are; pictures are cast to binary at the end."""
    return F.unhex(F.lit(digits)).cast("string")


def _white(n: Column | int) -> Column:
    return F.repeat(_samples("FFFFFF"), n)


def _keys(t):
    """The keys that pictures are made of."""
    return dealt(t("supplier").select("s_suppkey"))


def _gradients(t):
    """A picture of 64 by 40 for each supplier, whose samples are a function of place, colour and key.

    As samples are bytes, there are 256 such pictures; these are made once and joined.
    """
    k = F.col("k")
    sample = lambda i: _hex((3 * (F.floor(i / 3) % 64) + 5 * F.floor(i / 192) + 40 * (i % 3) + k) % 256)
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(64 * 40 * 3 - 1)), sample), ""))
    rows = _keys(t)
    made = rows.sparkSession.range(256).select(F.col("id").alias("k")).select("k", data.alias("data"))
    return rows.join(F.broadcast(made), F.pmod("s_suppkey", F.lit(256)) == k).select("s_suppkey", F.lit(64).alias("width"), F.lit(40).alias("height"), "data")


@query(
    """WITH boxes AS (SELECT s_suppkey AS k, unnest([{'id': 0, 'x': s_suppkey % 5, 'y': s_suppkey % 3, 'w': 20 + s_suppkey % 7, 'h': 8 + s_suppkey % 4}, {'id': 1, 'x': 10, 'y': 5, 'w': 30 + s_suppkey % 9, 'h': 30}, {'id': 2, 'x': 2, 'y': 30, 'w': 60, 'h': 8}]) AS b FROM supplier),
crops AS (SELECT k, b.id AS box_id, b.x AS x, b.y AS y, b.w AS w, b.h AS h, ceil(48 * (b.w / b.h))::INT AS width FROM boxes),
down AS (SELECT *, greatest(0, least(39, y + (r + 0.5::DOUBLE) * (h / 48::DOUBLE) - 0.5::DOUBLE)) AS fy FROM crops, range(48) q(r)),
cells AS (SELECT *, greatest(0, least(63, x + (c + 0.5::DOUBLE) * (w / width::DOUBLE) - 0.5::DOUBLE)) AS fx FROM down, range(360) s(c) WHERE c < width),
near AS (SELECT k, box_id, width, floor(fx)::BIGINT AS x0, least(63, floor(fx) + 1)::BIGINT AS x1, fx - floor(fx) AS wx, floor(fy)::BIGINT AS y0, least(39, floor(fy) + 1)::BIGINT AS y1, fy - floor(fy) AS wy FROM cells),
mixed AS (SELECT k, box_id, width, z, round_even(((3 * x0 + 5 * y0 + 40 * z + k) % 256 * (1 - wx) + (3 * x1 + 5 * y0 + 40 * z + k) % 256 * wx) * (1 - wy) + ((3 * x0 + 5 * y1 + 40 * z + k) % 256 * (1 - wx) + (3 * x1 + 5 * y1 + 40 * z + k) % 256 * wx) * wy, 0) AS v FROM near, range(3) u(z))
SELECT k AS s_suppkey, box_id::BIGINT AS box_id, width, greatest(320, max(width) OVER (PARTITION BY k))::INT AS batch_width, red, green, blue
FROM (SELECT k, box_id, width, sum(v) FILTER (z = 0)::BIGINT AS red, sum(v) FILTER (z = 1)::BIGINT AS green, sum(v) FILTER (z = 2)::BIGINT AS blue FROM mixed GROUP BY ALL)"""
)
def crop_sums(t):
    """Three crops of each picture, resampled for a reader: the sums of their three planes, without what pads the batch."""
    k = F.col("s_suppkey")
    at = lambda i, x, y, w, h: F.struct(F.lit(i).alias("box_id"), G.box(x, y, x + w, y + h).alias("box"))
    n = F.lit
    boxes = F.array(at(0, k % 5, k % 3, 20 + k % 7, 8 + k % 4), at(1, n(10), n(5), 30 + k % 9, n(30)), at(2, n(2), n(30), n(60), n(8)))
    rows = X.crop_tensors(_gradients(t), t("supplier").select(k, F.explode(boxes).alias("b")).select(k, "b.*"), "s_suppkey")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Samples of planes are put back to 0 to 255; a crop's end where it does."""
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                planes = r.tensor.reshape(len(r.widths), 3, r.height, r.width)
                for box_id, width, own in zip(r.box_ids, r.widths, planes):
                    blue, green, red = np.rint((own[:, :, :width].astype(np.float64) * 0.5 + 0.5) * 255).sum(axis=(1, 2)).astype(np.int64).tolist()
                    rows.append((r.s_suppkey, box_id, width, r.width, red, green, blue))
            yield pd.DataFrame(rows, columns=["s_suppkey", "box_id", "width", "batch_width", "red", "green", "blue"])

    return rows.mapInPandas(sums, "s_suppkey long, box_id long, width int, batch_width int, red long, green long, blue long")


def _dark_area():
    """A stand-in for a detector: the area round everything that is not white."""

    def chances(p: np.ndarray) -> np.ndarray:
        dark = p.mean(axis=0) < 0.9
        out = np.zeros(dark.shape)
        if dark.any():
            ys, xs = np.nonzero(dark)
            out[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] = 0.9
        return out

    return chances


def _shades():
    """A stand-in for a recogniser: a digit is a shade of gray, and what is white, padded or at an edge is none."""

    def chances(crops: np.ndarray) -> np.ndarray:
        gray = (crops[:, 0, 24] * 0.5 + 0.5) * 255
        at = np.arange(crops.shape[3] // 8) * 8 + 4
        here = gray[:, at]
        even = (np.abs(here - gray[:, at - 3]) < 3) & (np.abs(here - gray[:, at + 3]) < 3) & (here < 205) & (np.abs(here - 127.5) > 1)
        out = np.zeros((*here.shape, 11))
        np.put_along_axis(out, np.where(even, np.rint((here - 10) / 20) + 1, 0).clip(0, 10).astype(int)[:, :, None], 0.9, axis=2)
        return out

    return chances


@query("SELECT s_suppkey, s_suppkey::VARCHAR AS text, 0.9::DOUBLE AS score, length(s_suppkey::VARCHAR)::INT AS n_bounds, true AS in_place FROM supplier")
def read_digits(t):
    """A picture of each supplier's key, a shade for each digit, found, cropped, read and decoded: the digits, and whether the
    middle of each one's block lies within its bounds."""
    key = F.col("s_suppkey").cast("string")
    block = lambda d: F.concat(F.repeat(F.unhex(_hex(10 + 20 * d.cast("int"))).cast("string"), 72), _white(24))
    n = F.char_length(key)
    line = F.concat(_white(40), F.array_join(F.transform(F.split(key, ""), block), ""), _white(360 - 48 * n))
    images = _keys(t).select("s_suppkey", F.lit(400).alias("width"), F.lit(60).alias("height"), F.concat(_white(4000), F.repeat(line, 32), _white(7200)).cast("binary").alias("data"))
    lines = R.read_text(images, "s_suppkey", _dark_area, _shades, list("0123456789"), R.ReadingRules(most_turned=0))
    b = F.col("box")
    middle = lambda i: (52 + 48 * i - b["x0"]) / (b["x1"] - b["x0"])
    inside = F.forall(F.transform("bounds", lambda x, i: (x["t0"] < middle(i)) & (middle(i) < x["t1"])), lambda ok: ok)
    return lines.select("s_suppkey", "text", F.round("score", 6).alias("score"), F.size("bounds").alias("n_bounds"), inside.alias("in_place"))


@query(
    """WITH lined AS (SELECT doc_id, line, i - 1 AS line_id FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
closed AS (SELECT doc_id, list_reduce(list({'size': length(line) + 1, 'chunk': 0, 'out': [0]} ORDER BY line_id), lambda a, z: {'size': CASE WHEN a.size + z.size - 1 > 900 THEN 0 ELSE a.size END + z.size, 'chunk': a.chunk + CASE WHEN a.size + z.size - 1 > 900 THEN 1 ELSE 0 END, 'out': list_append(a.out, a.chunk + CASE WHEN a.size + z.size - 1 > 900 THEN 1 ELSE 0 END)}).out AS chunks FROM lined GROUP BY doc_id),
placed AS (SELECT doc_id, line_id, line, chunk, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, chunk ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place FROM (SELECT doc_id, line_id, line, chunks[line_id + 1] AS chunk FROM lined JOIN closed USING (doc_id))),
sizes AS (SELECT doc_id, chunk, max(place + length(line)) AS n FROM placed GROUP BY ALL),
entities AS (SELECT doc_id, chunk, unnest(range(5, greatest(n, 5), 97)) AS a FROM sizes),
cut AS (SELECT doc_id, line_id, line, greatest(a - place, 0) AS s, least(a + 60 - place, length(line)) AS e FROM placed JOIN entities USING (doc_id, chunk) WHERE a < place + length(line) AND a + 60 > place),
grown AS (SELECT doc_id, line_id, line,
    s - CASE WHEN regexp_matches(substring(line, s + 1, 1), '[\\p{L}\\p{M}\\p{N}''’\\-]') THEN length(regexp_extract(substring(line, 1, s), '[\\p{L}\\p{M}\\p{N}''’\\-]*$')) ELSE 0 END AS s,
    e + CASE WHEN regexp_matches(substring(line, e, 1), '[\\p{L}\\p{M}\\p{N}''’\\-]') THEN length(regexp_extract(substring(line, e + 1), '^[\\p{L}\\p{M}\\p{N}''’\\-]*')) ELSE 0 END AS e
    FROM cut WHERE regexp_matches(substring(line, s + 1, e - s), '\\S')),
stripped AS (SELECT doc_id, line_id, s, s + length(regexp_replace(substring(line, s + 1, e - s), '[\\s,.;:]+$', '')) AS e FROM grown)
SELECT doc_id, line_id::INT AS line_id, s::INT AS start, e::INT AS "end" FROM stripped WHERE e > s"""
)
def entities_over_lines(t):
    """Sixty characters at every 97th of each chunk of a document's lines stand for entities, and are cut to the lines."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_id", "text"))
    chunks, placed = E.chunk_texts(lines, "doc_id")
    n = F.char_length("text")
    starts = chunks.where(n > 5).select("doc_id", "chunk_no", F.explode(F.sequence(F.lit(5), n - 1, F.lit(97))).alias("start"))
    found = starts.select("doc_id", "chunk_no", F.lit("USERNAME").alias("label"), F.lit("contact").alias("category"), F.lit(0.9).alias("score"), "start", (F.col("start") + 60).alias("end"))
    return E.entities_on_lines(found, placed, "doc_id").select("doc_id", "line_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def _gray_squares():
    """A stand-in for a face model: the area of the shade of gray 50, surer of it where it is sharp, and unsure where an edge cuts it."""

    def found(p: np.ndarray) -> dict:
        on = np.abs(p[0] - 50) < 12
        cells = 640 // 8
        cls, obj, shape = np.zeros(cells * cells), np.zeros(cells * cells), np.zeros((cells * cells, 4))
        if on.any():
            ys, xs = np.nonzero(on)
            x0, x1, y0, y1 = xs.min(), xs.max() + 1, ys.min(), ys.max() + 1
            cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
            i = int(cy // 8) * cells + int(cx // 8)
            whole = x0 > 0 and x1 < 640 and p[0, y0, x1] > 0
            cls[i], obj[i] = 1.0, 0.4 if not whole else 0.9 if p[0, y0, x0 - 1] > 250 and p[0, y0, x1] > 250 else 0.6
            shape[i] = (cx / 8 - cx // 8, cy / 8 - cy // 8, np.log((x1 - x0) / 8), np.log((y1 - y0) / 8))
        return {8: (cls, obj, shape)}

    return found


@query(
    """SELECT s_suppkey, round(x - 33, 3) AS x0, round(greatest(0, y - 42.9), 3) AS y0, round(least(800, x + 93), 3) AS x1, round(least(300, y + 93), 3) AS y1, round(sqrt(0.9), 6) AS score
FROM (SELECT s_suppkey, (60 + s_suppkey * 37 % 650)::DOUBLE AS x, (10 + s_suppkey * 13 % 220)::DOUBLE AS y FROM supplier)"""
)
def faces_over_tiles(t):
    """A picture of 800 by 300 for each supplier with one square, in one tile, in two or over the edge of one: found once."""
    k = F.col("s_suppkey")
    x, y = (60 + k * 37 % 650).cast("int"), (10 + k * 13 % 220).cast("int")
    line = F.concat(_white(x), F.repeat(_samples("323232"), 60), _white(740 - x))
    data = F.concat(F.repeat(_white(800), y), F.repeat(line, 60), F.repeat(_white(800), 240 - y)).cast("binary")
    images = _keys(t).select(k, F.lit(800).alias("width"), F.lit(300).alias("height"), data.alias("data"))
    found = A.find_faces(images, "s_suppkey", _gray_squares, spread=False)  # pictures are dealt out already
    return found.select(k, *[F.round(f"box.{c}", 3).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round("score", 6).alias("score"))


def _symbol() -> list[str]:
    """The rows of a QR-like symbol of 21 by 21 modules as bits: finders, timing lines, and a rule for the rest."""

    def dark(x: int, y: int) -> bool:
        for a, b in ((x, y), (20 - x, y), (x, 20 - y)):
            if a < 8 and b < 8:
                return max(abs(a - 3), abs(b - 3)) in (0, 1, 3)
        if x == 6 or y == 6:
            return (x + y) % 2 == 0
        return (7 * x + 13 * y + x * y) % 3 == 0

    return ["".join("1" if dark(x, y) else "0" for x in range(21)) for y in range(21)]


@query(
    """SELECT s_suppkey, greatest(0, x - 6)::DOUBLE AS x0, greatest(0, y - 6)::DOUBLE AS y0, least(140, x + 63 + 6)::DOUBLE AS x1, least(110, y + 63 + 6)::DOUBLE AS y1, 'QR_CODE' AS label
FROM (SELECT s_suppkey, 3 + s_suppkey * 37 % 70 AS x, 3 + s_suppkey * 13 % 40 AS y FROM supplier)"""
)
def located_codes(t):
    """A picture of 140 by 110 for each supplier with a symbol, modules of three pixels, at a place by its key, turned or not."""
    k = F.col("s_suppkey")
    x, y = (3 + k * 37 % 70).cast("int"), (3 + k * 13 % 40).cast("int")
    rows = _symbol()
    turned = ["".join(r[i] for r in rows) for i in range(21)]  # as seen in a mirror
    bits = F.when(k % 2 == 0, F.array(*[F.lit(r) for r in rows])).otherwise(F.array(*[F.lit(r) for r in turned]))
    line = lambda r: F.concat(_white(x), F.replace(F.replace(r, F.lit("1"), _samples("14" * 9)), F.lit("0"), _samples("F" * 18)), _white(77 - x))
    data = F.concat(F.repeat(_white(140), y), F.array_join(F.transform(bits, lambda r: F.repeat(line(r), 3)), ""), F.repeat(_white(140), 47 - y)).cast("binary")
    images = _keys(t).select(k, F.lit(140).alias("width"), F.lit(110).alias("height"), data.alias("data"))
    found = C.find_codes(images, "s_suppkey").withColumn("box", G.polygon_box(F.col("polygon")))
    return found.select(k, *[F.round(f"box.{c}", 3).alias(c) for c in ("x0", "y0", "x1", "y1")], "label")
