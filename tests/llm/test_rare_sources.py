"""A document alone in its source: its many copies are those that plain Python draws, and no task makes them all."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskwork.llm.source_mixing import BLOCK_PARTS, mix_sources


def copies_of(doc_id, rate, seed=17):
    parts = max(math.ceil(rate / 16), 1)
    mean, total = rate / parts, 0
    p = math.exp(-mean)
    cdf = [p]
    for k in range(1, 81):
        p *= mean / k
        cdf.append(cdf[-1] + p)
    for i in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}|{doc_id}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        total += sum(c <= u for c in cdf)
    return total


@pytest.mark.parametrize("most_sources", [20_000, 1])
def test_copies_of_rare_documents(spark, most_sources):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rare = spark.createDataFrame([(50_000, "one", "only"), (None, None, "null"), (50_001, "two", "a"), (50_001, "two", "b")], "doc_id long, source string, text string")
    got = mix_sources(docs.unionByName(rare).withColumn("_block", F.lit("mine")), most_sources=most_sources).cache()
    rate = 30_004 / 4
    assert rate / 16 > BLOCK_PARTS  # the one and the null; each row of "two" has half of it, and two texts
    by = {(r["doc_id"], r["text"]): r for r in got.where("source IS NULL OR source != 'hot'").groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.max("copy_no").alias("m"), F.min("n_copies").alias("c"), F.countDistinct("shuffle_key").alias("k")).collect()}
    for (d, text), want in {(50_000, "only"): copies_of(50_000, rate), (None, "null"): copies_of("null", rate), (50_001, "a"): copies_of(50_001, rate / 2), (50_001, "b"): copies_of(50_001, rate / 2)}.items():
        r = by[d, text]
        assert (r["n"], r["d"], r["m"], r["c"], r["k"]) == (want,) * 5
    hot = Counter(r["doc_id"] for r in got.where("source = 'hot'").select("doc_id").collect())
    assert all(hot[i] == copies_of(i, rate / 30_000) for i in range(500))
    assert {r["_block"] for r in got.select("_block").distinct().collect()} == {"mine"}
    got.unpersist()


def test_copies_are_made_by_many_tasks(spark):
    from maskwork.llm.source_mixing import _many_copies, repetition_rates

    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "one").otherwise("hot").alias("source"))
    rates = repetition_rates(docs).select(F.col("source").alias("_source"), F.col("n_parts").alias("_parts"), F.col("cdf").alias("_cdf"))
    made = _many_copies(docs, rates.where("_parts > 64"), ["doc_id", "source"], 17, True, 64)
    by_task = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) == 4 and sum(by_task) == copies_of(0, 50_000.0) and max(by_task) < 0.5 * sum(by_task)
