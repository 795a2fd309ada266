"""QR codes in pictures: a locator that needs no model, beside an injected decoder that also knows what codes say.

A finder, one of the three corners of a symbol, is dark, light, dark, light, dark in shares of 1:1:3:1:1 along any line through
its middle.  Such runs are found in all rows and all columns; where a row's and a column's share their middle is a finder.
Three of one size at a right angle, with modules that take turns between them, are a symbol.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwork.operators.geometry import code_regions
from maskwork.operators.images import frames, pixels_of

#: A decoder gets an RGB array and returns dicts of ``points``, ``kind`` and ``text``.
Decoder = Callable[[np.ndarray], list[dict]]
#: Modules from a finder's middle to the edge of its symbol, and the fewest between the middles of two finders.
_TO_EDGE, _APART = 3.5, 10


def _finder_runs(dark: np.ndarray) -> np.ndarray:
    """Rows ``line, middle, module, from, to`` of runs of pixels in finders' shares; from and to are those of the middle part."""
    height, width = dark.shape
    wide = np.zeros((height, width + 2), bool)
    wide[:, 1:-1] = dark
    line, edge = np.nonzero(wide[:, 1:] != wide[:, :-1])  # each line's edges, dark begins at even ones
    first = np.searchsorted(line, line)
    at = np.flatnonzero(((np.arange(len(line)) - first) % 2 == 0) & (np.arange(len(line)) + 5 < len(line)))
    at = at[line[at + 5] == line[at]] if len(at) else at
    parts = np.stack([edge[at + k + 1] - edge[at + k] for k in range(5)], axis=1) if len(at) else np.zeros((0, 5))
    module = parts.sum(axis=1) / 7
    fits = (module >= 1) & (np.abs(parts - module[:, None] * [1, 1, 3, 1, 1]) <= np.maximum(0.5 * module[:, None] * [1, 1, 3, 1, 1], 0.75)).all(axis=1)
    at, module = at[fits], module[fits]
    return np.stack([line[at], (edge[at + 2] + edge[at + 3]) / 2, module, edge[at + 2], edge[at + 3]], axis=1) if len(at) else np.zeros((0, 5))


def finders(dark: np.ndarray) -> np.ndarray:
    """Rows ``x, y, module`` of the finders of a picture of dark and light."""
    across, down = _finder_runs(dark), _finder_runs(dark.T)
    order = np.argsort(down[:, 0], kind="stable")
    down = down[order]
    met = []
    for y, x, module, _, _ in across:
        for _, middle, other, low, high in down[slice(*np.searchsorted(down[:, 0], [int(x), int(x) + 1]))]:
            if low <= y < high and abs(other - module) <= 0.4 * max(module, other):
                met.append((x, middle, (module + other) / 2))
    groups: list[list[tuple]] = []
    for p in met:
        near = next((g for g in groups if max(abs(g[0][0] - p[0]), abs(g[0][1] - p[1])) <= 2 * g[0][2]), None)
        if near is None:
            groups.append([p])
        else:
            near.append(p)
    return np.array([np.mean(g, axis=0) for g in groups]).reshape(-1, 3)


def _timed(on: np.ndarray, corner: np.ndarray, u: np.ndarray, v: np.ndarray, modules: int) -> float:
    """How much of the two lines between the finders of a corner, where dark and light modules take turns, is as it has to be."""
    k = np.arange(5, modules - 4)  # from the corner finder's middle
    right = []
    for along, beside in ((u, v), (v, u)):
        x, y = np.rint(corner[:, None] + along[:, None] * k + 3 * beside[:, None] - 0.5).astype(int)
        inside = (x >= 0) & (x < on.shape[1]) & (y >= 0) & (y < on.shape[0])
        right.append(np.where(inside, on[y.clip(0, on.shape[0] - 1), x.clip(0, on.shape[1] - 1)] == (k % 2 == 1), False))
    return float(np.mean(right))


def symbols(found: np.ndarray, on: np.ndarray, least: float = 0.8) -> list[list[tuple[float, float]]]:
    """Corners of the symbols that finders make up, the best fits first; a finder is in one symbol only."""
    fits = []
    for a in range(len(found)):
        for b in range(len(found)):
            step = found[b, :2] - found[a, :2]
            size = np.hypot(*step)
            module = (found[a, 2] + found[b, 2]) / 2
            if a == b or size < _APART * module or abs(found[a, 2] - found[b, 2]) > 0.35 * module:
                continue
            off = np.hypot(*(found[:, :2] - found[a, :2] - [-step[1], step[0]]).T)  # where the third one has to be
            for c in np.flatnonzero((off <= 0.15 * size) & (np.abs(found[:, 2] - module) <= 0.35 * module)).tolist():
                modules = size / found[[a, b, c], 2].mean()
                modules = 10 + 4 * max(1, round((modules - 10) / 4))  # sides of symbols are 17 and four more for each version
                corner, u, v = found[a, :2], step / modules, (found[c, :2] - found[a, :2]) / modules
                timed = _timed(on, corner, u, v, modules)
                if timed >= least:
                    far = modules + _TO_EDGE
                    shape = [tuple((corner + p * u + q * v).tolist()) for p, q in ((-_TO_EDGE, -_TO_EDGE), (far, -_TO_EDGE), (far, far), (-_TO_EDGE, far))]
                    fits.append((-timed, off[c] / size, (a, b, c), shape))
    used: set[int] = set()
    out = []
    for _, _, own, shape in sorted(fits):
        if not used & {*own}:
            used |= {*own}
            out.append(shape)
    return out


def locate_codes(image: np.ndarray) -> list[list[tuple[float, float]]]:
    """Corners of all QR symbols in an RGB picture, dark on light or light on dark, in any of the four turns and near to them."""
    gray = image.mean(axis=2)
    half = (float(gray.max()) + float(gray.min())) / 2 if image.size else 0.0
    dark = gray < half
    out: list[list[tuple[float, float]]] = []
    for on in (dark, ~dark):
        for shape in symbols(finders(on), on):
            middle = np.mean(shape, axis=0)
            if all(np.hypot(*(middle - np.mean(other, axis=0))) > 7 for other in out):
                out.append(shape)
    return out


CODE = "kind string, text string, points array<struct<x:double,y:double>>, width int, height int"


def find_codes(images: DataFrame, key: str, load: Callable[[], Decoder] | None = None, pad: float = 6.0) -> DataFrame:
    """``key, category, label, polygon, score, source, text``: all codes of pictures ``key, width, height, data``.

    What the decoder returns is taken as it is; symbols that the locator finds beside it, all of them if there is no decoder,
    have no text.  Polygons are the boxes round the codes, ``pad`` pixels larger and inside the picture.
    """
    names = [key, *(c.split()[0] for c in CODE.split(", "))]
    pixels = [c for c in ("width", "height", "channels", "data") if c in images.columns]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        decode = load() if load else None
        for b in batches:
            for r in b.itertuples(index=False):
                image = pixels_of(r)
                found = [(x["kind"], x.get("text") or "", [tuple(map(float, p)) for p in x["points"]]) for x in decode(image)] if decode else []
                for shape in locate_codes(image):
                    x, y = np.mean(shape, axis=0)
                    if not any(min(p[0] for p in s) <= x <= max(p[0] for p in s) and min(p[1] for p in s) <= y <= max(p[1] for p in s) for _, _, s in found):
                        found.append(("QR_CODE", "", shape))
                for kind, text, points in found:
                    yield getattr(r, key), kind, text, [{"x": float(x), "y": float(y)} for x, y in points], int(r.width), int(r.height)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(find(batches), names)

    codes = images.where("data IS NOT NULL").select(key, *pixels).mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, {CODE}")
    return code_regions(codes, pad).select(key, F.lit("codes").alias("category"), F.col("kind").alias("label"), "polygon", F.lit(1.0).alias("score"), F.lit("code").alias("source"), "text")
