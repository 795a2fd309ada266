"""Words that begin with U+0000 are words like others."""

from pyspark.sql import functions as F

from maskwork.llm.quality_divergence import language_references, quality_rules


def test_words_that_begin_with_nul(spark):
    words = "the old tree grows slowly near a river and all birds come to it in the spring".split()
    odd = ["\x00abc", "\x005", "\x00n", "\x000", "\x00", "\x00n9"]
    rows = [(i, " ".join(words[(i + k) % len(words)] for k in range(70)) + " " + " ".join(odd[: i % 7]), "en" if i % 3 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = docs.withColumn("text", F.translate("text", "\x00", "~"))  # a character of the same class
    read = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert read(language_references(docs)) == read(language_references(plain))
    assert read(quality_rules(docs).drop("text")) == read(quality_rules(plain).drop("text"))
    shares = {r["_lang"]: r["_class_shares"] for r in language_references(docs).collect()}
    for lang, got in shares.items():
        own = [t for _, t, x in rows if (x or "") == lang]
        chars = sum(map(len, own))
        want = [sum(t.count(" ") for t in own), sum(c.islower() for t in own for c in t), 0, 0, sum(c.isdigit() for t in own for c in t), 0, sum(t.count("\x00") for t in own)]
        assert all(abs(g - w / chars) < 1e-12 for g, w in zip(got, want)), (got, want)
