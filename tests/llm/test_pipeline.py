"""The pipeline's stages against plain Python over the operators' own row functions."""

import corpus_pipeline
from pyspark.sql import functions as F

from maskwork.llm.decontaminate import item_windows, normal_words
from maskwork.llm.quality_divergence import quality_rules
from maskwork.llm.secret_scan import find_secrets, learn_words, redact
from tests.llm.test_near_dedup import brute_force

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"]: r for r in quality_rules(docs).where("kept").collect()}
    near = brute_force([(d, r["text"]) for d, r in kept.items()], 80)
    kept = {d: r for d, r in kept.items() if near[d][1] == d}
    windows = item_windows([(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 10)
    sizes = {w.count(b" ") + 1 for w in windows}

    def clean(text):
        w = normal_words(text.encode())
        return not any(b" ".join(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    kept = {d: r for d, r in kept.items() if clean(r["text"])}
    rules = learn_words(docs.where(F.col("doc_id").isin(list(kept))))
    want = {d: redact(r["text"], find_secrets(r["text"], rules)) for d, r in kept.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {r["doc_id"] for r in got} <= set(want)
    for r in got:
        assert r["text"] == want[r["doc_id"]] and r["n_chars"] == len(r["text"])
        assert 1 <= r["copy_no"] <= r["n_copies"]
    assert len(got) == sum({r["doc_id"]: r["n_copies"] for r in got}.values())
    assert abs(len(got) - len(want)) < 5 * len(want) ** 0.5 + 5


CALLERS = {"kept": "mine", "n_words": -5, "contaminated": "no", "Secrets": 1, "a.b": "dotted", "redacted": "r", "component_id": 7, "_other0": "o"}


def with_callers(docs):
    return docs.select("*", *[F.lit(v).alias(c) for c, v in CALLERS.items()])


def test_stages_keep_columns_and_values(spark):
    """Columns with the names of what operators make keep their values; null ids, texts and repeated rows go through all stages."""
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b c", "en", None, 5), (9_000_001, None, "en", "s", 0), (9_000_002, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    docs = with_callers(whole.unionByName(odd).unionByName(whole.where("doc_id < 9")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        made = ["n_copies", "copy_no", "shuffle_key"] if name == "source mixing" else []
        assert out.columns == docs.columns + made, name
        assert out.dtypes[: len(docs.columns)] == docs.dtypes and out.count() > 50, name
        got = out.select(*[F.col(f"`{c}`") for c in CALLERS]).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(CALLERS.values())], name
        if name not in ("secret scan", "source mixing"):
            assert out.select(*whole.columns).exceptAll(docs.select(*whole.columns)).count() == 0, name
        if name == "near-duplicates":  # a null id, and a document without words, is nobody's copy
            assert out.where("doc_id IS NULL").count() == 2 and out.where("doc_id > 9000000").count() == 2
        if name == "secret scan":
            assert out.where("text IS NULL").count() == 2 and out.count() == docs.count()
        out.unpersist()


def test_stages_of_empty_tables(spark):
    docs = with_callers(spark.read.parquet(f"{SF}/documents.parquet").limit(0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
