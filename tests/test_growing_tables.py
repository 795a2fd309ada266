"""Tables that grow: tasks get more, not larger, and the rows are the same."""

import pytest

from maskwork.plans import queries, shapes
from maskwork.session import by_key


def test_parts_grow_with_rows(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    assert by_key(rows, "k", 100).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert by_key(rows, "k", 950_001).rdd.getNumPartitions() == 10


@pytest.fixture
def folder(spark, tmp_path):
    lines = "id div 4 AS l_orderkey, cast(id % 4 + 1 AS int) AS l_linenumber, id * 7 % 200 AS l_partkey, id * 3 % 10 AS l_suppkey, cast(id % 50 AS double) AS l_quantity"
    spark.range(400).coalesce(1).selectExpr(*lines.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).coalesce(1).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["bio_entities", "deduped_lines", "page_detections"])
def test_rows_are_the_same_in_many_parts(spark, folder, monkeypatch, name):
    rows = lambda: sorted(map(repr, queries.QUERIES[name](spark, folder).collect()))
    few = rows()
    dealt = []

    def finely(table, key, n_rows):
        dealt.append(by_key(table, key, n_rows, 10))
        return dealt[-1]

    for module in (queries, shapes):
        monkeypatch.setattr(module, "by_key", finely)
    assert rows() == few and few
    assert dealt[0].rdd.getNumPartitions() >= 40


def test_planted_texts_of_customers_in_one_file_are_dealt_out(spark, folder):
    made = queries.QUERIES["planted_spans"](spark, folder)
    assert made.rdd.getNumPartitions() > 4
