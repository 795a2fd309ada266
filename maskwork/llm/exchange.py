"""Exchange of packed data between many sources and many targets, without a row for each pair of them.

A row bundles what one source, or a group of them, has for a group of targets.  Where there are more than ``fan`` targets,
bundles are for groups of targets first; in each step, those of ``fan`` sources are joined and cut for smaller groups.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Targets with what goes there.
Entries = list[tuple[int, bytes]]
Join = Callable[[list[tuple[int, int, bytes]]], list[tuple[int, int, bytes]]]
BUNDLE = "key int, source int, sources binary, targets binary, sizes binary, payload binary"


def bundled(source: int, entries: list[tuple[int, int, bytes]], width: int) -> pa.Table:
    """Rows by ``target // width`` of (source, target, payload)."""
    rows: dict[str, list] = {c.split()[0]: [] for c in BUNDLE.split(", ")}
    entries.sort(key=lambda e: e[1])
    for key, own in groupby(entries, lambda e: e[1] // width):
        own = list(own)
        ints = lambda k: np.array([e[k] for e in own], np.int32).tobytes()
        for c, v in zip(rows, (key, source, ints(0), ints(1), np.array([len(e[2]) for e in own], np.int64).tobytes(), b"".join(e[2] for e in own))):
            rows[c].append(v)
    return pa.table({c: pa.array(v, pa.int32() if c in ("key", "source") else pa.binary()) for c, v in rows.items()})


def entries_of(bundles: pa.Table) -> list[tuple[int, int, bytes]]:
    out = []
    for sources, targets, sizes, payload in zip(*(bundles.column(c).to_pylist() for c in ("sources", "targets", "sizes", "payload"))):
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]).tolist()
        out += [(s, t, payload[a:b]) for s, t, a, b in zip(np.frombuffer(sources, np.int32).tolist(), np.frombuffer(targets, np.int32).tolist(), cuts, cuts[1:])]
    return out


def widths(parts: int, fan: int) -> list[int]:
    """How many targets a bundle is for, on each step of the way to single ones."""
    widths = [1]
    while widths[0] * fan < parts:
        widths.insert(0, widths[0] * fan)
    return widths


def exchanged(sent: DataFrame, parts: int, fan: int, join: Join) -> DataFrame:
    """Bundles for single targets, by column ``key``, from those for groups of them; ``join`` makes one payload of several."""
    for width in widths(parts, fan)[1:]:
        sent = sent.withColumn("source", F.floor(F.col("source") / fan).cast("int")).groupBy("key", "source").applyInArrow(_regroup(width, join), BUNDLE)
    return sent


def _regroup(width: int, join: Join):
    return lambda bundles: bundled(bundles.column("source")[0].as_py(), join(entries_of(bundles)), width)
