"""Words of the secret scan's lexicon: exactly as many as there is room for, most frequent first, of any script."""

from collections import Counter

from maskwork.llm.secret_scan import GuessRules, learn_words


def test_lexicon_has_as_many_words_as_there_is_room_for(spark):
    alike = [f"{a}{b}{c}word" for a in "abcdefghij" for b in "abcdef" for c in "vwxyz"]  # 300 words, each in three documents
    texts = [" ".join(alike)] * 3 + ["often Größe пароль often"] * 5 + ["rare tooshort" + "x" * 20]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string").repartition(4)
    counts = Counter(w for t in texts for w in {x.lower() for x in t.split() if 4 <= len(x) <= 16})
    order = sorted((w for w, n in counts.items() if n >= 3), key=lambda w: (-counts[w], w))
    assert len(order) == 303 and order[:3] == ["größe", "often", "пароль"]
    for room in (1000, 303, 302, 299, 3, 2, 0):
        assert list(learn_words(docs, GuessRules(words=("first",), most_words=room)).words) == ["first", *order[:room]]
