"""Reading texts and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwork.operators.images import read_images  # noqa: F401


def read_text_files(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """``path, text`` of whole files, or ``path, text`` of each line (with the line end taken off)."""
    rows = spark.read.text(path, wholetext=not by_line)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_lines(docs: DataFrame, key: str, text: str = "text", char_width: float = 8.0, line_height: float = 16.0) -> DataFrame:
    """Lines of plain texts as boxes on a grid, so that layout operators work on text without images."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_id", "text"))
    top = F.col("line_id") * line_height
    box = F.struct(F.lit(0.0).alias("x0"), top.cast("double").alias("y0"), (F.char_length("text") * char_width).cast("double").alias("x1"), (top + 0.75 * line_height).cast("double").alias("y1"))
    return rows.withColumn("box", box)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").text(path) if reports.columns == ["report"] else reports.write.mode("overwrite").json(path)


def write_images(pngs: DataFrame, path: str) -> None:
    """PNG bytes as Parquet, which any number of tasks can write."""
    pngs.write.mode("overwrite").parquet(path)
