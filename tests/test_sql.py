"""The SQL functions against the DataFrame operators, and their plans."""

from pyspark.sql import functions as F

from maskwork import sql
from maskwork.operators.redact import redact, redact_text
from maskwork.operators.spans import explode_spans, find_spans, with_spans
from maskwork.plans.planted import NEAR_MISSES, PLANTED

ODD = [None, "", "it's \"quoted\" \\ and a'b@c.org", "é😀 a@b.com", "line\nend 10.1.2.3\t"]


def test_functions_equal_operators(spark):
    names = sql.register(spark, "mw", custom_terms="it's, falcon")
    assert names == ["mw_find", "mw_redact", "mw_spans"]
    texts = [t for t, _, _ in PLANTED[::2]] + NEAR_MISSES + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    terms = ["it's", "falcon"]
    found = with_spans(docs, custom_terms=terms).withColumn("box", F.when(F.size("spans") > 0, redact_text("text", "spans", "box")).otherwise(F.col("text")))
    want = {r["id"]: (r["spans"], r["redacted"], r["box"]) for r in redact(found, custom_terms=terms).select("id", "spans", "redacted", "box").collect()}
    got = {r["id"]: (r["s"], r["a"], r["b"]) for r in spark.sql("SELECT id, mw_find(text) AS s, mw_redact(text) AS a, mw_redact(text, 'box') AS b FROM {d}", d=docs).collect()}
    assert got == want and sum(len(s) for s, _, _ in want.values()) > 60
    rows = spark.sql("SELECT id, s.start, s.end, s.label, s.value FROM {d}, LATERAL mw_spans(text) s", d=docs)
    flat = explode_spans(found, "id").select("id", "start", "end", "label", "value")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, flat.collect()))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_text_of_columns(spark):
    """Operators, doubles, quotes and lambdas come back as they were."""
    rows = spark.createDataFrame([("it's 5 \\d", 4.5, 3)], "t string, x double, n int")
    columns = [F.col("x") * 0.5 + 1 - F.lit(2.0) / F.col("n"), F.when((F.col("n") >= 3) & (F.col("n") != 4), F.lit("a'b\\")), F.col("t").rlike(r"\d \\d$"), F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i % 2 - F.col("n")), F.aggregate(F.array(F.lit(1.5)), F.lit(0.0), lambda a, v: a + v), -F.col("n"), ~(F.col("n") <= 2)]
    want = rows.select(*columns).first()
    got = rows.selectExpr(*[sql.sql_text(c) for c in columns]).first()
    assert tuple(want) == tuple(got)
    assert sql.sql_text(find_spans("t", ["network"])).count("transform") > 5
