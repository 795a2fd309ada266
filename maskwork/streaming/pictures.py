"""Pictures as a stream: files that arrive under a path become redacted pictures and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from maskwork.operators.images import decode_files
from maskwork.operators.screens import redact_screens


def redact_picture_stream(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    load_reader: Callable | None,
    load_tagger: Callable | None = None,
    find: Callable[[DataFrame], DataFrame] | None = None,
    categories: Sequence[str] | None = None,
    style: str = "black box",
    custom_terms: str | Sequence[str] = (),
    files_per_batch: int = 1000,
    once: bool = True,
) -> StreamingQuery:
    """Redact the PNG files under a path as they arrive: ``path, png, report`` as Parquet under ``out``, a folder for each batch.

    A batch overwrites its own folder, ``batch=<number>``, so one that was broken off and runs again after a restart from the
    ``checkpoint`` loses and repeats nothing.  ``find`` gets a batch's pictures and returns further regions, as
    ``redact_screens`` takes them (faces, codes).  Files that can't be read have a null ``png`` and an empty report.  With
    ``once`` the stream ends when all that is there now is done.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.png").option("maxFilesPerTrigger", files_per_batch).load(path)

    def redact_batch(batch: DataFrame, number: int) -> None:
        images = decode_files(batch.select("path", "content"))
        more = find(images) if find else None
        done = redact_screens(images, "path", load_reader, load_tagger, more, categories, style, custom_terms)
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(redact_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
