"""Pixels: PNG in and out, intake, and hiding regions.  Images pass through Arrow batches, one row each."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of pixels, that are handed on together; a larger picture goes alone.
_TOGETHER, _BYTES_TOGETHER = 500, 4 << 20
STYLES = ("black box", "pixelate", "blur")
IMAGE = "width int, height int, data binary"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


#: Samples of a pixel by PNG colour type.
_DEPTHS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: The passes of an interlaced picture: first column, first row, steps between columns and rows.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Rows whose filters are undone together.
_STRIP = 128


def decode_png(raw: bytes) -> np.ndarray:
    """A PNG of any colour type, depth and interlacing as 8-bit RGB; transparency is laid on white, gray is repeated."""
    if raw[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head, palette, clear = 8, [], None, None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        at += 12 + size
    if head is None or head[3] not in _DEPTHS or head[2] not in (1, 2, 4, 8, 16) or (head[3] == 3 and palette is None):
        raise ValueError("no picture in it")
    width, height, depth, colour, _, _, interlaced = head
    n, data = _DEPTHS[colour], np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    out = np.zeros((height, width, n), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for x, y, dx, dy in _PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = len(range(x, width, dx)), len(range(y, height, dy))
        if w and h:
            line = (w * n * depth + 7) // 8
            rows = data[at : at + h * (1 + line)].reshape(h, 1 + line)
            at += rows.size
            out[y::dy, x::dx] = _samples(unfilter(rows, max(1, n * depth // 8)), w, n, depth)
    return flatten(_coloured(out, colour, depth, palette, clear))


def _samples(rows: np.ndarray, width: int, n: int, depth: int) -> np.ndarray:
    if depth == 16:
        return rows.view(">u2").reshape(len(rows), width, n)
    if depth < 8:
        parts = [(rows >> shift) & ((1 << depth) - 1) for shift in range(8 - depth, -1, -depth)]
        rows = np.stack(parts, axis=2).reshape(len(rows), -1)[:, : width * n]
    return rows.reshape(len(rows), width, n)


def _coloured(out: np.ndarray, colour: int, depth: int, palette: np.ndarray | None, clear: bytes | None) -> np.ndarray:
    """Samples in 8 bits, by the palette where there is one, and with what ``tRNS`` says of transparency."""
    if colour == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(alpha)]
        return np.concatenate([palette, alpha[:, None]], axis=1)[np.minimum(out[:, :, 0], len(palette) - 1)]
    alpha = None
    if clear is not None and colour in (0, 2):
        key = np.frombuffer(clear, ">u2")[: out.shape[2]]
        alpha = np.where((out == key).all(axis=2), 0, 255).astype(np.uint8)[:, :, None]
    eight = ((out.astype(np.uint32) + 128) // 257).astype(np.uint8) if depth == 16 else (out * (255 // ((1 << depth) - 1))).astype(np.uint8)
    return eight if alpha is None else np.concatenate([eight, alpha], axis=2)


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the filters of rows that begin with the filter's number: 0 none, 1 left, 2 above, 3 their mean, 4 whichever is
    nearest to left + above - corner.  ``step`` is how many bytes further left the left neighbour is.

    Rows of filters 0 to 2 are whole-row sums.  Strips with others go along their diagonals, all of whose bytes depend on the
    two diagonals before only.
    """
    height, width = rows.shape[0], rows.shape[1] - 1
    out = np.zeros((height + 1, width), np.uint8)
    at = 0
    while at < height:
        strip = rows[at : at + _STRIP]
        if strip[0, 0] < 3:
            out[at + 1] = _plain(int(strip[0, 0]), strip[0, 1:], out[at], step)
            at += 1
        else:
            simple = np.flatnonzero(strip[:, 0] < 3)
            n = len(strip)
            if len(simple) > n // 2:  # few that need their diagonals: only up to the next plain row
                n = int(simple[0])
            out[at + 1 : at + 1 + n] = _diagonals(strip[:n], out[at], step)
            at += n
    return out[1:]


def _plain(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    pad = np.pad(line, (0, -len(line) % step)).reshape(-1, step)
    return np.cumsum(pad, axis=0, dtype=np.uint8).ravel()[: len(line)]


def _diagonals(strip: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    n, bytes_ = len(strip), strip.shape[1] - 1
    cells = -(-bytes_ // step)
    raw = np.zeros((n, cells * step), np.int16)
    raw[:, :bytes_] = strip[:, 1:]
    kind = strip[:, 0][:, None]
    done = np.zeros((n + 1, (cells + 1) * step), np.int16)  # one row above, one cell to the left
    done[0, step : step + bytes_] = above
    flat, raw_flat = done.reshape(n + 1, cells + 1, step), raw.reshape(n, cells, step)
    for t in range(cells + n - 1):
        y = np.arange(max(0, t - cells + 1), min(n, t + 1))
        x = t - y
        left, up, corner = flat[y + 1, x], flat[y, x + 1], flat[y, x]
        own = kind[y]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.where(own == 4, nearest, np.where(own == 3, (left + up) >> 1, np.where(own == 2, up, np.where(own == 1, left, 0))))
        flat[y + 1, x + 1] = (raw_flat[y, x] + guess) & 255
    return done[1:, step : step + bytes_].astype(np.uint8)


def encode_png(image: np.ndarray) -> bytes:
    """A PNG of nothing but the pixels: no text, place or camera data goes along."""
    height, width, _ = image.shape
    rows = np.zeros((height, 1 + width * 3), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def flatten(image: np.ndarray) -> np.ndarray:
    """Gray, gray with alpha, RGB or RGBA as RGB on white."""
    image = image[:, :, None] if image.ndim == 2 else image
    colour = np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] < 3 else image[:, :, :3]
    if image.shape[2] in (2, 4):
        alpha = image[:, :, -1:].astype(np.float64) / 255
        colour = np.rint(colour * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return np.ascontiguousarray(colour)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean over the area that each new pixel covers."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        edges = np.linspace(0, len(a), n + 1)
        sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0, dtype=np.float64)])
        low = np.floor(edges).astype(int).clip(max=len(a) - 1)
        part = sums[low] + (edges - low).reshape(-1, *[1] * (a.ndim - 1)) * a[low]
        return np.diff(part, axis=0) / (len(a) / n)

    return np.rint(along(along(image, height).swapaxes(0, 1), width).swapaxes(0, 1)).clip(0, 255).astype(np.uint8)


def frames(rows: Iterator[tuple], names: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of many small ones or few large ones, for a frame costs more than a small picture does."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(v.nbytes if isinstance(v, np.ndarray) else len(v) for v in row if isinstance(v, (bytes, np.ndarray)))
        if len(held) >= _TOGETHER or size >= _BYTES_TOGETHER:
            yield pd.DataFrame(held, columns=list(names))
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=list(names))


def pixels_of(row) -> np.ndarray:
    """The RGB pixels of a row ``width, height, data``; with ``channels``, data is BGR, BGR and alpha, or gray, as Spark's own
    picture source has it."""
    shape = (int(row.height), int(row.width))
    channels = getattr(row, "channels", None)
    if channels is None:
        return np.frombuffer(row.data, np.uint8).reshape(*shape, 3)
    data = np.frombuffer(row.data, np.uint8).reshape(*shape, int(channels))
    return flatten(data if channels == 1 else data[:, :, [2, 1, 0, 3][: int(channels)]])


def sinc_taps(old: int, new: int, lobes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights, one row for each of ``new`` pixels, of the old pixels that it is a sum of: a sinc windowed by its own
    middle lobe, as wide as the picture shrinks."""
    scale = max(1.0, old / new)
    middle = (np.arange(new) + 0.5) * (old / new)
    first = np.floor(middle - lobes * scale + 0.5).astype(np.int64)
    at = first[:, None] + np.arange(int(np.ceil(2 * lobes * scale)) + 1)
    x = (at + 0.5 - middle[:, None]) / scale
    weights = np.where((np.abs(x) < lobes) & (at >= 0) & (at < old), np.sinc(x) * np.sinc(x / lobes), 0.0)
    return at.clip(0, old - 1), weights / weights.sum(axis=1, keepdims=True)


def lanczos(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampled along rows, then along columns, by the same few weights for all of them."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        at, weights = sinc_taps(len(a), n)
        out = np.zeros((n, *a.shape[1:]))
        for k in range(at.shape[1]):
            out += weights[:, k].reshape(-1, *[1] * (a.ndim - 1)) * a[at[:, k]]
        return np.rint(out).clip(0, 255).astype(np.uint8)

    return np.ascontiguousarray(along(along(image.swapaxes(0, 1), width).swapaxes(0, 1), height))


def shrink(image: np.ndarray, longest: int = 4096) -> np.ndarray:
    """The picture with its longer side at ``longest`` pixels at most."""
    side = max(image.shape[:2])
    if side <= longest:
        return image
    return lanczos(image, max(1, round(image.shape[1] * longest / side)), max(1, round(image.shape[0] * longest / side)))


def polygon_mask(height: int, width: int, polygons: list[list[tuple[float, float]]]) -> np.ndarray:
    """Pixels inside any polygon, by even-odd scan lines, or on its edge; corners are rounded to pixels."""
    mask = np.zeros((height, width), bool)
    cut = lambda low, high: slice(max(0, int(np.floor(low + 0.5))), max(0, int(np.floor(high + 0.5)) + 1))
    for points in polygons:
        p = np.rint(np.array(points, float)).astype(int)
        q = np.roll(p, -1, axis=0)
        dy = np.where(q[:, 1] == p[:, 1], 1, q[:, 1] - p[:, 1])
        slope = (q[:, 0] - p[:, 0]) / dy
        low, high = np.minimum(p[:, 1], q[:, 1]), np.maximum(p[:, 1], q[:, 1])
        for y in range(max(0, low.min()), min(height - 1, high.max()) + 1):
            crossed = np.flatnonzero((low <= y) & (y < high))
            xs = np.sort(p[crossed, 0] + (y - p[crossed, 1]) * slope[crossed])
            for a, b in zip(xs[::2], xs[1::2]):
                mask[y, cut(a, b)] = True
            for i in np.flatnonzero((low <= y) & (y <= high)):  # the part of each edge nearest to this line
                ends = p[i, 0] + (np.clip([y - 0.5, y + 0.5], low[i], high[i]) - p[i, 1]) * slope[i] if low[i] < high[i] else np.array([p[i, 0], q[i, 0]])
                mask[y, cut(ends.min(), ends.max())] = True
    return mask


def _blurred(image: np.ndarray, size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (size // 2, size // 2)
        mode = "reflect" if out.shape[axis] > size // 2 else "edge"
        wide = np.pad(out, pad, mode=mode)
        out = sum(k * np.take(wide, range(i, i + out.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return out


def apply_redactions(image: np.ndarray, polygons: list, style: str = "black box") -> np.ndarray:
    """A copy with the polygons hidden; pixels outside them are untouched.  Blocks and blur are not safe for text."""
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    out = image.copy()
    if not polygons:
        return out
    height, width = out.shape[:2]
    mask = polygon_mask(height, width, polygons)
    if style == "black box":
        out[mask] = 0
        return out
    if style == "pixelate":
        block = max(8, min(height, width) // 60)
        small = resize(out, max(1, width // block), max(1, height // block))
        rows = np.minimum(np.arange(height) * small.shape[0] // height, small.shape[0] - 1)
        cols = np.minimum(np.arange(width) * small.shape[1] // width, small.shape[1] - 1)
        effect = small[rows][:, cols]
    else:
        size = max(31, (min(height, width) // 20) | 1)
        effect = np.rint(_blurred(_blurred(out, size), size)).clip(0, 255).astype(np.uint8)
    out[mask] = effect[mask]
    return out


def read_images(spark: SparkSession, path: str, longest: int = 4096) -> DataFrame:
    """``path, width, height, data`` (RGB bytes) of the PNG files under a path; files that can't be read have null pixels."""
    return decode_files(spark.read.format("binaryFile").load(path).select("path", "content"), longest)


def decode_files(files: DataFrame, longest: int = 4096) -> DataFrame:
    """The same of rows ``path, content``.  Each picture is handed on before the next is decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                try:
                    image = shrink(decode_png(bytes(raw)), longest)
                    row = (path, image.shape[1], image.shape[0], image.tobytes())
                except (ValueError, zlib.error, struct.error, TypeError, IndexError):
                    row = (path, None, None, None)
                yield pd.DataFrame([row], columns=["path", "width", "height", "data"]).astype({"width": "Int32", "height": "Int32"})

    return files.mapInPandas(run, f"path string, {IMAGE}")


def read_pictures(spark: SparkSession, path: str, exact_gray: bool = True) -> DataFrame:
    """``path, width, height, channels, data`` of the JPEG, PNG, GIF and BMP files under a path, decoded in the JVM.

    ``data`` has BGR, BGR and alpha, or gray bytes, as ``pixels_of`` reads them; palettes, deep and interlaced colours come as
    8-bit colours.  Files that are no picture have null pixels, and empty ones no row.  The decoder takes gray samples as they are, without alpha, so
    those of gray PNGs with 16 bits or alpha are decoded anew by our own; only gray pictures are joined for that.
    ``exact_gray=False`` leaves this, and its second scan, out.
    """
    found = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    whole = F.col("width") > 0
    rows = found.select(F.col("origin").alias("path"), F.when(whole, F.col("width")).alias("width"), F.when(whole, F.col("height")).alias("height"), F.when(whole, F.col("nChannels")).alias("channels"), F.when(whole, F.col("data")).alias("data"))
    if not exact_gray:
        return rows
    kind = lambda at: F.hex(F.substring("content", at, 1))  # noqa: E731  of the first block: the 25th byte is the depth, the 26th the colour type
    deep = (F.hex(F.substring("content", 1, 8)) == _SIGNATURE.hex().upper()) & ((kind(26) == "04") | ((kind(25) == "10") & (kind(26) == "00")))
    files = spark.read.format("binaryFile").load(path).where(deep).select("path", "content")
    anew = decode_files(files, 1 << 30).select(_plain_path("path").alias("_path"), F.col("data").alias("_data"))
    gray = rows.where("channels = 1").join(anew, _plain_path("path") == F.col("_path"), "left")
    # our own decoder gives RGB; as BGR it is the same, for all three are alike
    mended = gray.select("path", "width", "height", F.when(F.col("_data").isNotNull(), 3).otherwise(F.col("channels")).alias("channels"), F.coalesce("_data", "data").alias("data"))
    return rows.where("channels IS NULL OR channels != 1").unionByName(mended)


def _plain_path(c: str):
    """A path as both sources write it: with one slash behind the scheme's colon, or three."""
    return F.regexp_replace(F.col(c), "^([a-z]+):/+", "$1:/")


#: Bytes of what is found in pictures that are sent to all tasks; if there are more, it and the pictures are dealt out by key.
MOST_BESIDE = 64 << 20


def beside(images: DataFrame, found: DataFrame, key: str, size: Column, how: str) -> DataFrame:
    """Images with what was found in each.  That is measured first, so it should be cheap to look at twice: up to
    ``MOST_BESIDE`` bytes of it are broadcast, and no pixels move."""
    small = (found.agg(F.sum(size.cast("long"))).first()[0] or 0) <= MOST_BESIDE
    return images.join(F.broadcast(found) if small else found, key, how)


def redact_images(images: DataFrame, regions: DataFrame, key: str, style: str = "black box", along: Sequence[str] = ()) -> DataFrame:
    """``key, png``: images with the regions hidden, encoded anew from their pixels; null for null pixels.

    ``regions`` are rows ``key, polygon``, or one row per image ``key, polygons`` whose columns ``along`` go along, as strings.
    Few of them leave the pixels where they are (``beside``).
    """
    if "polygons" not in regions.columns:
        regions = regions.groupBy(key).agg(F.collect_list("polygon").alias("polygons"))
    regions = regions.select(key, "polygons", *along)
    size = F.lit(64) + F.coalesce(F.aggregate("polygons", F.lit(0), lambda n, p: n + 16 + 24 * F.size(p)), F.lit(0))
    for c in along:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    rows = beside(images, regions, key, size, "left")
    pixels = [c for c in ("width", "height", "channels", "data") if c in images.columns]

    def hidden(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for r in b.itertuples(index=False):
                png = None
                if r.data is not None:
                    polygons = [[(p["x"], p["y"]) for p in q] for q in (r.polygons if r.polygons is not None else [])]
                    png = encode_png(apply_redactions(pixels_of(r), polygons, style))
                yield getattr(r, key), png, *(getattr(r, c) for c in along)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(hidden(batches), [key, "png", *along])

    made = "".join(f", {c} string" for c in along)
    return rows.select(key, *pixels, "polygons", *along).mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, png binary{made}")


def extract(images: DataFrame, load: Callable[[], Callable[[np.ndarray], list[dict]]] | None, key: str, schema: str) -> DataFrame:
    """Rows that an injected engine (text reader, face or code finder) makes of each image; none without one or of null pixels."""
    full = f"{key} {images.schema[key].dataType.simpleString()}, {schema}"
    if load is None:
        return images.sparkSession.createDataFrame([], full)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = load()
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame([{key: getattr(r, key), **x} for x in engine(pixels_of(r))], columns=[key, *names])

    return images.where("data IS NOT NULL").select(key, *[c for c in ("width", "height", "channels", "data") if c in images.columns]).mapInPandas(run, full)


def _areas(on: np.ndarray) -> np.ndarray:
    """x0, y0, x1, y1 (inclusive) of the areas of set pixels that touch at sides or corners, from runs of pixels by row."""
    edges = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (rows, first), last = np.nonzero(edges == 1), np.nonzero(edges == -1)[1] - 1
    root = np.arange(len(rows))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    cuts = np.searchsorted(rows, np.arange(on.shape[0] + 1))
    for y in range(1, on.shape[0]):
        above, own = slice(cuts[y - 1], cuts[y]), np.arange(cuts[y], cuts[y + 1])
        # runs of the row above that reach to within a pixel of each run
        low = cuts[y - 1] + np.searchsorted(last[above], first[own] - 1)
        high = cuts[y - 1] + np.searchsorted(first[above], last[own] + 1, side="right")
        for i, a, b in zip(own.tolist(), low.tolist(), high.tolist()):
            for j in range(a, b):
                root[find(i)] = find(j)
    label = np.array([find(i) for i in range(len(rows))], np.int64)
    areas, which = np.unique(label, return_inverse=True)
    out = np.empty((len(areas), 4), np.int64)
    out[:, :2], out[:, 2:] = np.iinfo(np.int64).max, -1
    np.minimum.at(out[:, 0], which, first)
    np.minimum.at(out[:, 1], which, rows)
    np.maximum.at(out[:, 2], which, last)
    np.maximum.at(out[:, 3], which, rows)
    return out


def text_boxes(chances: np.ndarray, width: int, height: int, threshold: float = 0.3, least: float = 0.5, grow: float = 1.6, smallest: int = 3, most: int | None = None) -> list[dict]:
    """Boxes of text from a map of chances: areas over the threshold, each with a mean chance, grown and scaled to the image.

    All boxes are returned unless ``most`` is given.
    """
    h, w = chances.shape
    on = np.pad(chances > threshold, ((1, 0), (1, 0)))
    area = _areas(on[1:, 1:] | on[1:, :-1] | on[:-1, 1:] | on[:-1, :-1])
    total = np.pad(chances.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    low, high = area[:, :2], area[:, 2:]
    size = high - low
    inside = total[high[:, 1] + 1, high[:, 0] + 1] - total[low[:, 1], high[:, 0] + 1] - total[high[:, 1] + 1, low[:, 0]] + total[low[:, 1], low[:, 0]]
    mean = inside / (size + 1).prod(axis=1)
    margin = size.prod(axis=1) * grow / np.maximum(2 * size.sum(axis=1), 1)
    short = size.min(axis=1, initial=np.iinfo(np.int64).max)
    limits = np.array([width, height])
    fitted = lambda v: np.clip(np.floor(v * limits / [w, h] + 0.5), 0, limits - 1)
    a, b = fitted(low - margin[:, None]), fitted(high + margin[:, None])
    kept = (short >= smallest) & (mean >= least) & (short + 2 * margin >= smallest + 2) & ((b - a) > 3).all(axis=1)
    order = np.flatnonzero(kept)
    return [{"x0": float(a[i, 0]), "y0": float(a[i, 1]), "x1": float(b[i, 0]), "y1": float(b[i, 1]), "score": float(mean[i])} for i in order[:most]]


#: Digits as rows of three pixels, for the numbers of regions.
_DIGITS = {d: [[int(c) for c in row] for row in rows.split()] for d, rows in zip("0123456789", (
    "111 101 101 101 111", "010 110 010 010 111", "111 001 111 100 111", "111 001 111 001 111", "101 101 111 001 001",
    "111 100 111 001 111", "111 100 111 101 111", "111 001 001 010 010", "111 101 111 101 111", "111 101 111 001 111"))}
COLOURS = ((214, 39, 40), (31, 119, 180), (44, 160, 44), (148, 103, 189), (255, 127, 14), (23, 190, 207))


def annotate(image: np.ndarray, regions: list[tuple[int, str, list]], chosen: set[int] | None = None) -> np.ndarray:
    """A copy for review: the regions (number, category, polygon) outlined and numbered, those that are chosen (or all) tinted.

    A category's colour depends on its name only.
    """
    height, width = image.shape[:2]
    out = image.astype(np.float64)
    colour = lambda category: np.array(COLOURS[zlib.crc32(category.encode()) % len(COLOURS)], float)
    for number, category, polygon in regions:
        if chosen is None or number in chosen:
            mask = polygon_mask(height, width, [polygon])
            out[mask] = 0.7 * out[mask] + 0.3 * colour(category)
    for number, category, polygon in regions:
        edges = [[a, b] for a, b in zip(polygon, [*polygon[1:], polygon[0]])]
        out[polygon_mask(height, width, edges)] = colour(category)
        glyphs = np.concatenate([np.pad(np.array(_DIGITS[d]), ((1, 1), (1, 1 if i == len(str(number)) - 1 else 0))) for i, d in enumerate(str(number))], axis=1)
        scale = max(1, min(height, width) // 300)
        glyphs = np.kron(glyphs, np.ones((scale, scale), int))
        x, y = int(min(max(0, min(p[0] for p in polygon)), max(0, width - 1))), int(min(max(0, min(p[1] for p in polygon)), max(0, height - 1)))
        glyphs = glyphs[: height - y, : width - x]
        out[y : y + glyphs.shape[0], x : x + glyphs.shape[1]] = np.where(glyphs[:, :, None] > 0, 255.0, colour(category))
    return np.rint(out).clip(0, 255).astype(np.uint8)
