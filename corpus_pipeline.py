"""The corpus pipeline: five stages, each of which reads what the one before has written and decides on all of it.

All stages take null ids, texts, languages and sources, empty and very long texts, repeated rows and empty tables, as their
operators' docstrings say: a null or empty text fails the quality rules, rows of one id share their fate, and columns beyond
those of ``documents`` are carried along with their values, whatever their names.  Only those that the last stage makes
(``n_copies, copy_no, shuffle_key``) replace callers' columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwork.llm.columns import set_aside
from maskwork.llm.decontaminate import benchmark_hits
from maskwork.llm.near_dedup import near_duplicates
from maskwork.llm.quality_divergence import quality_rules
from maskwork.llm.secret_scan import learn_words, scan_secrets
from maskwork.llm.shared import written
from maskwork.llm.source_mixing import mix_sources
from maskwork.session import configure, table

OWN = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    configure(spark)
    docs, _, restored = set_aside(docs, OWN, [])
    return quality_rules(docs).where("kept").select(*restored)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at a similarity of 0.8, the document with the smallest id stays."""
    configure(spark)
    docs, _, restored = set_aside(docs, OWN, [])
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*restored)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    configure(spark)
    docs, _, restored = set_aside(docs, OWN, [])
    return benchmark_hits(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*restored)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked, and ``n_chars`` is counted anew where they were."""
    configure(spark)
    docs, names, restored = set_aside(docs, OWN, [])
    found = scan_secrets(docs, learn_words(docs))
    changed = {"text": F.col("redacted"), "n_chars": F.when(F.size("secrets") > 0, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[changed[n].alias(n) if n in changed else column for n, column in zip(names, restored)])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to equal shares, and all rows shuffled."""
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("source mixing", mixing_stage),
]

#: SQL can express neither guess costs nor, at this size, connected components; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
