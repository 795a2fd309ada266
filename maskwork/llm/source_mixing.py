"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, where k is the inverse of a Poisson distribution at a number that depends on the
seed and the document's id only.  The mean is what the source needs to reach its share of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import set_aside

#: The distribution is inverted for means up to this; a larger mean is a sum of such parts, each with its own number.
PART_MEAN = 16.0
#: So many terms of a distribution with such a mean leave less than 2**-52.
TERMS = 80
#: Parts of one row that are drawn together; the copies of a row with more are made by as many tasks as it has such blocks.
BLOCK_PARTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """Per source: ``source, n_docs, rate, n_parts, cdf``.

    ``weights`` are the sources' shares of the output, in any unit (a source that is not named gets 0); without them, all
    sources get the same.  ``size`` is the number of rows out for each row in.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighted = counts.withColumn("_weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, _weight double")
        weighted = counts.join(given.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["_weight"])
    total = weighted.agg(F.sum("n_docs").alias("_docs"), F.sum("_weight").alias("_weights"))
    rate = F.when(F.col("_weights") > 0, F.col("_docs") * F.lit(float(size)) * F.col("_weight") / F.col("_weights") / F.col("n_docs")).otherwise(0.0)
    rates = weighted.join(F.broadcast(total)).withColumn("rate", rate).withColumn("n_parts", F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("n_parts")
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * F.col("_mean") / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["all"], F.array(a["sum"] + p)).alias("all"))

    rates = rates.withColumn("_mean", mean)
    return rates.select("source", "n_docs", "rate", "n_parts", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step, lambda a: a["all"]).alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 17, most_sources: int = 20_000, salts: int = 64) -> DataFrame:
    """Repeat documents so that the sources reach their target shares, and shuffle all rows.

    Adds ``n_copies`` (of this document), ``copy_no`` (from 1) and ``shuffle_key``; rows are dealt to partitions by the
    key and sorted by it, so the order is random over the whole output and the same on every run.  A null source is a
    source of its own.  Rows with equal ids (null included) draw the same count, and text plays no part.  An empty table
    gives none.  The rates are broadcast up to ``most_sources`` of them; beyond, they are joined by a shuffle in which
    each source is dealt over ``salts`` keys.  A row that is to be repeated more than some thousand times is dealt to tasks
    in blocks of its parts.
    """
    made = ["n_copies", "copy_no", "shuffle_key"]
    docs, keep, restored = set_aside(docs, ["doc_id", "source"], made)
    rates = repetition_rates(docs, weights, size).select(F.col("source").alias("_source"), F.col("n_parts").alias("_parts"), F.col("cdf").alias("_cdf"))
    bounds = rates.agg(F.count("*").alias("n"), F.max("_parts").alias("parts")).first()
    few = bounds["n"] <= most_sources
    rows = docs.select(*keep)
    common = _with_rates(rows, rates.where(F.col("_parts") <= BLOCK_PARTS), few, salts)
    common = common.withColumn("n_copies", _drawn(F.lit(1), F.col("_parts"), seed)).where("n_copies > 0")
    copies = common.select(*keep, "n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy_no"))
    if (bounds["parts"] or 0) > BLOCK_PARTS:
        copies = copies.unionByName(_many_copies(rows, rates.where(F.col("_parts") > BLOCK_PARTS), keep, seed, few, salts))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), _id_text(), F.col("copy_no").cast("string")))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*restored, *made)


def _id_text() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def _drawn(first: Column, last: Column, seed: int) -> Column:
    """How many copies the parts from ``first`` to ``last`` of a row draw together."""
    drawn = F.transform(F.sequence(first, last), lambda i: uniform(F.lit(str(seed)), _id_text(), i.cast("string")))
    return F.aggregate(drawn, F.lit(0), lambda a, u: a + F.size(F.filter("_cdf", lambda c: c <= u))).cast("long")


def _with_rates(rows: DataFrame, rates: DataFrame, few: bool, salts: int) -> DataFrame:
    same = F.col("source").eqNullSafe(F.col("_source"))
    if few:
        return rows.join(F.broadcast(rates), same)
    salted = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, same & (F.col("_deal") == F.col("_salt")))


def _many_copies(rows: DataFrame, rates: DataFrame, keep: list[str], seed: int, few: bool, salts: int) -> DataFrame:
    """The copies of rows of rare sources.  Blocks of a row's parts are dealt to all tasks, first to draw and then, with the
    row's text, to make copies: about a thousand from each block, whatever the row draws in all.

    What is drawn depends on id and source only, so it is counted once for all rows that have both in common.
    """
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = F.floor((F.col("_parts") - 1) / BLOCK_PARTS).cast("int")
    blocks = lambda df: df.withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
    ids = rows.select("doc_id", "source").distinct()
    dealt = blocks(_with_rates(ids, rates, few, salts)).select("doc_id", "source", "_block", "_parts", "_cdf").repartition(tasks, "doc_id", "source", "_block")
    begin = F.col("_block") * BLOCK_PARTS + 1
    drawn = dealt.select(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("_block").alias("_at"), _drawn(begin, F.least(begin + BLOCK_PARTS - 1, F.col("_parts")), seed).alias("_k"))
    by_row = Window.partitionBy("_id", "_from")
    placed = drawn.withColumn("_end", F.sum("_k").over(by_row.orderBy("_at"))).withColumn("n_copies", F.sum("_k").over(by_row))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_from")) & (F.col("_block") == F.col("_at"))
    spread = blocks(_with_rates(rows, rates.drop("_cdf"), few, salts)).join(placed.where("_k > 0"), same)
    spread = spread.select(*keep, "n_copies", "_end", "_k", "_block").repartition(tasks, "doc_id", "source", "_block")
    return spread.select(*keep, "n_copies", F.explode(F.sequence(F.col("_end") - F.col("_k") + 1, F.col("_end"))).alias("copy_no"))


MIX_SQL = """
WITH counts AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n_docs) FROM counts)::DOUBLE * 1.0 * 1.0 / (SELECT count(*) FROM counts)::DOUBLE / n_docs AS rate FROM counts),
parts AS (SELECT source, greatest(ceil(rate / 16.0), 1)::INT AS n_parts, rate / greatest(ceil(rate / 16.0), 1)::INT AS mean FROM rates),
terms AS (SELECT source, k, mean, sum(CASE WHEN k = 0 THEN -mean ELSE ln(mean / k) END) OVER (PARTITION BY source ORDER BY k) AS lp FROM parts, range(81) t(k)),
cdf AS (SELECT source, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS f FROM terms),
drawn AS (SELECT d.doc_id, d.source, i, ('0x' || substr(md5(concat_ws('|', '17', d.doc_id::VARCHAR, i::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0 AS u
    FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, 1000) r(i) WHERE i <= p.n_parts),
copies AS (SELECT doc_id, drawn.source, sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM drawn.source AND f <= u))::BIGINT AS n_copies FROM drawn GROUP BY ALL)
SELECT doc_id, source, n_copies, c AS copy_no, md5(concat_ws('|', '17', 'order', doc_id::VARCHAR, c::VARCHAR)) AS shuffle_key
FROM copies, range(1, 10000) r(c) WHERE c <= n_copies
"""
