"""The text operators on streams.  They look at one row at a time, so a stream needs no state for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwork.operators.redact import redact


def redact_stream(stream: DataFrame, text: str = "text", categories: Sequence[str] | None = None, custom_terms: Sequence[str] = (), style: str = "label") -> DataFrame:
    """``redact`` on a stream (or on a table)."""
    return redact(stream, text, categories, custom_terms, style)


def span_counts(stream: DataFrame, time: str, text: str = "text", window: str = "5 minutes", late: str = "10 minutes", categories: Sequence[str] | None = None) -> DataFrame:
    """Spans by time window and label; rows later than the watermark are left out of windows that have closed."""
    found = redact(stream, text, categories).withWatermark(time, late)
    return found.select(time, F.explode("spans").alias("s")).groupBy(F.window(time, window), "s.label").agg(F.count("*").alias("n"))
