"""The mixing query repeats and shuffles whole documents, not their ids alone."""

from maskwork.llm import queries

SF = "/root/testdata/sf0.001"


def test_whole_documents_are_mixed(spark, monkeypatch):
    kept, write = [], queries.written
    monkeypatch.setattr(queries, "written", lambda df, name: kept.append(write(df, name)) or kept[-1])
    got = queries.op2_source_mixing(spark, SF)
    assert got.columns == ["doc_id", "source", "n_copies", "copy_no", "shuffle_key"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = kept[0]
    assert mixed.columns == [*docs.columns, "n_copies", "copy_no", "shuffle_key"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = mixed.collect()
    assert rows and all(r["text"] == texts[r["doc_id"]] for r in rows)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[c] for c in got.columns) for r in rows)
