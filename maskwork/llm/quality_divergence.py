"""Quality rules by distribution divergence, in DataFrame functions only.

A reference per language holds the share of each character class and of its common short words over all documents.
A document is rejected if its own shares are too far from those of its language, in Jensen-Shannon distance (base 2,
0 to 1).  Each test has a minimum length, below which shares are too noisy to judge by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import set_aside

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: Removed one after another, after white space; what each step takes away is one class, what is left is the last.
CLASSES = [("lower", r"[a-z]+"), ("letter", r"[^\x00-\x7F]+"), ("upper", r"[A-Z]+"), ("digit", r"[0-9]+"), ("symbol", SYMBOL + "+")]


@dataclass(frozen=True)
class DivergenceRules:
    common_words: int = 24
    longest_common_word: int = 5
    min_chars: int = 200
    min_words: int = 50
    max_class_distance: float = 0.33
    #: Shares of n words scatter by about 1 / sqrt(n), so the largest distance is this plus noise / sqrt(n).
    max_word_distance: float = 0.20
    word_noise: float = 1.3
    #: A word below one in so many of its language's short words is never common; so few words can be above.
    rarest: int = 1000
    #: The references are broadcast up to this many languages; beyond, they are joined by a shuffle with salted keys.
    most_languages: int = 1000
    salts: int = 64


def _levels(docs: DataFrame, levels: list[dict[str, Column]]) -> DataFrame:
    """One projection for each level: what needs the same columns is computed together, as each projection copies its rows."""
    for columns in levels:
        docs = docs.withColumns(columns)
    return docs


def _class_levels() -> list[dict[str, Column]]:
    """From ``_text`` to ``_words`` to ``_classes``."""
    chars, left = F.char_length, "_solid"
    levels = [{"_words": F.array_remove(F.split("_text", SPACE + "+"), ""), "_chars": chars("_text")}, {"_solid": F.array_join("_words", ""), "_n_words": F.size("_words")}]
    counts = [F.col("_chars") - F.col("_solid_n")]
    for name, pattern in CLASSES:
        levels.append({f"_left_{name}": F.regexp_replace(left, pattern, ""), f"{left}_n": chars(left)})
        counts.append(F.col(f"{left}_n") - F.col(f"_left_{name}_n"))
        left = f"_left_{name}"
    levels.append({f"{left}_n": chars(left)})
    levels.append({"_classes": F.array(*counts, F.col(f"{left}_n")), "_symbols": counts[-1]})
    return levels


def _repeat_levels(size: int = 8) -> list[dict[str, Column]]:
    """From ``_words`` to ``n_repeat_words``, the number of words in windows of 8 that occur twice or more.

    Hashes of 2, 4 and 8 words are made by doubling.  Where fewer than 5 windows of 4 words repeat, none of 8 can, and
    the rest is skipped.  At the end of a document the shorter hashes are of fewer words, which only adds to the repeats.
    """
    doubled = lambda c, n: F.zip_with(c, F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    windows = F.slice(doubled("_four", 4), 1, F.greatest(F.size("_four") - size + 1, F.lit(0)))
    pairs = F.when(F.col("_windows").isNotNull(), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda i, j: F.get("_pairs", i)["h"].eqNullSafe(F.get("_pairs", j)["h"])
    twice = F.filter("_pairs", lambda x, i: same(i, i - 1) | same(i, i + 1))
    covered = F.aggregate(
        F.array_sort(F.transform("_twice", lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + size - F.greatest(a["end"], i)).alias("n"), (i + size).alias("end")),
        lambda a: a["n"],
    )
    return [
        {"_two": doubled("_words", 1)},
        {"_four": doubled("_two", 2)},
        {"_windows": F.when(F.size("_four") - F.size(F.array_distinct("_four")) > 4, windows)},
        {"_pairs": pairs},
        {"_twice": twice},
        {"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")},
    ]


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_text": F.coalesce(F.col("text"), F.lit("")), "_lang": F.coalesce(F.col("lang"), F.lit(""))})


def language_references(docs: DataFrame, rules: DivergenceRules = DivergenceRules()) -> DataFrame:
    """One row per language (null counts as ``''``): ``_lang``, class shares, common words and their shares of all words.

    One pass over all documents counts words and characters together: behind its words, each document adds how many
    characters of each class and how many words it has.  Which is which is told by place alone, never by what a word holds.
    """
    split = _levels(_named(docs), _class_levels())
    n_classes = len(CLASSES) + 2
    figures = [F.col("_classes")[i].cast("string") for i in range(n_classes)]
    keys = F.concat("_words", F.array(*figures, F.col("_n_words").cast("string")))
    placed = split.select("_lang", "_n_words", F.posexplode(keys).alias("_at", "_entry"))
    is_word = F.col("_at") < F.col("_n_words")
    keyed = placed.where(~is_word | (F.char_length("_entry") <= rules.longest_common_word)).select(
        "_lang",
        F.when(~is_word, F.col("_at") - F.col("_n_words")).alias("_figure"),
        F.when(is_word, F.col("_entry")).alias("_key"),
        F.when(is_word, F.lit(1).cast("long")).otherwise(F.col("_entry").try_cast("long")).alias("_amount"),
    )
    read = keyed.groupBy("_lang", "_figure", "_key").agg(F.sum("_amount").cast("double").alias("_n"))
    total = lambda k: F.sum(F.when(F.col("_figure") == k, F.col("_n")).otherwise(0.0))
    sums = F.array(*[total(i) for i in range(n_classes)])
    shares = read.where(F.col("_figure").isNotNull()).groupBy("_lang").agg(total(n_classes).alias("_total"), sums.alias("_sums"))
    shares = shares.withColumn("_all", F.aggregate("_sums", F.lit(0.0), lambda a, x: a + x)).select("_lang", "_total", F.transform("_sums", lambda x: x / F.greatest(F.col("_all"), F.lit(1.0))).alias("_class_shares"))
    frequent = read.where(F.col("_figure").isNull() & F.col("_key").rlike(r"^\p{Ll}+$")).join(shares.select("_lang", "_total"), "_lang").where(F.col("_n") * rules.rarest >= F.col("_total"))
    ranked = frequent.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_n"), "_key"))).where(F.col("_rank") <= rules.common_words)
    common = ranked.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("_rank", "_key", (F.col("_n") / F.col("_total")).alias("_share")))).alias("_common"))
    return shares.join(common, "_lang", "left").select(
        "_lang",
        "_class_shares",
        F.coalesce(F.transform("_common", lambda x: x["_key"]), F.array().cast("array<string>")).alias("_common_words"),
        F.coalesce(F.transform("_common", lambda x: x["_share"]), F.array().cast("array<double>")).alias("_word_shares"),
    )


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def quality_rules(docs: DataFrame, rules: DivergenceRules = DivergenceRules(), references: DataFrame | None = None) -> DataFrame:
    """Judge every document by length, repetition, and distance from its language.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
    kept``; the columns of ``docs`` stay (those of these names are replaced).  A null or blank text has no words and
    fails.  A null ``lang`` is a language of its own.  A distance is null where the text is below the minimum length of
    that test, and a null distance rejects nothing.  Repeated rows are judged alike; an empty table gives none.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
    docs, keep, restored = set_aside(docs, ["text", "lang"], made)
    spark = docs.sparkSession
    references = language_references(docs, rules) if references is None else references
    head = references.limit(rules.most_languages + 1).collect()
    classes, repeats = _class_levels(), _repeat_levels()
    few = len(head) <= rules.most_languages
    known = sorted({w for r in head for w in r["_common_words"]}) if few else []
    classes[0]["_lines"] = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    classes[1]["n_dup_lines"] = (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    if few:
        classes[1]["_hits"] = F.filter("_words", lambda w: w.isin(known)) if known else F.array().cast("array<string>")
        classes[2]["_joined"] = F.concat(F.lit(" "), F.array_join("_hits", "  "), F.lit(" "))
    else:
        classes[1]["_joined"] = F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" "))
    for level, more in zip(classes[1:], repeats):
        level |= more
    out = _levels(_named(docs), classes)
    out = out.select(*keep, "_lang", "_text", "_chars", "_joined", "_classes", "n_dup_lines", "n_repeat_words", F.col("_n_words").cast("long").alias("n_words"), F.col("_solid_n").cast("long").alias("word_chars"), F.col("_symbols").cast("long").alias("n_symbols"))
    if few:
        out = out.join(F.broadcast(spark.createDataFrame(head, references.schema)), "_lang", "left")
    else:
        salted = references.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))))
        out = out.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(rules.salts)).cast("int")).join(salted, ["_lang", "_salt"], "left")
    left = lambda c: F.char_length(F.replace("_joined", F.concat(F.lit(" "), c, F.lit(" "))))
    counted = F.transform("_common_words", lambda c: (F.char_length("_joined") - left(c)) / (F.char_length(c) + 2) / F.greatest(F.col("n_words"), F.lit(1)))
    out = out.withColumns({"_p": F.transform("_classes", lambda x: x / F.greatest(F.col("_chars"), F.lit(1))), "_counted": counted})
    rest = lambda x: F.concat(x, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(x, F.lit(0.0), lambda a, v: a + v))))
    out = out.withColumns({"_pw": rest(F.col("_counted")), "_qw": rest(F.col("_word_shares"))})
    out = (
        out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .withColumn("class_distance", F.when(F.col("_chars") >= rules.min_chars, F.round(_distance("_p", "_class_shares"), 6)))
        .withColumn("word_distance", F.when((F.col("n_words") >= rules.min_words) & (F.size("_common_words") > 0), F.round(_distance("_pw", "_qw"), 6)))
    )
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > rules.max_class_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > rules.max_word_distance + rules.word_noise / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))))
    # The id is never negative.  It keeps a filter on the verdict from being moved below all these projections, which the
    # optimizer would have to repeat in it, each several times.
    return out.withColumn("kept", F.when(F.monotonically_increasing_id() >= 0, ~F.col("base_failed") & ~far)).select(*restored, *made)


QUALITY_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT *, array_to_string(w, '') AS s0 FROM docs),
b AS (SELECT *, regexp_replace(s0, '[a-z]+', '', 'g') AS s1 FROM a),
c AS (SELECT *, regexp_replace(s1, '[^\x00-\x7F]+', '', 'g') AS s2 FROM b),
d AS (SELECT *, regexp_replace(s2, '[A-Z]+', '', 'g') AS s3 FROM c),
e AS (SELECT *, regexp_replace(s3, '[0-9]+', '', 'g') AS s4 FROM d),
f AS (SELECT *, regexp_replace(s4, '[#*$%&|<>]+', '', 'g') AS s5 FROM e),
g AS (SELECT doc_id, lang, t, w, len(w) AS n, length(s0) AS word_chars, length(s4) - length(s5) AS n_symbols,
    [length(t) - length(s0), length(s0) - length(s1), length(s1) - length(s2), length(s2) - length(s3), length(s3) - length(s4), length(s4) - length(s5), length(s5)] AS cs FROM f),
shares AS (SELECT lang, sum(n)::DOUBLE AS total, sum(length(t))::DOUBLE AS al, [sum(cs[1])::DOUBLE, sum(cs[2])::DOUBLE, sum(cs[3])::DOUBLE, sum(cs[4])::DOUBLE, sum(cs[5])::DOUBLE, sum(cs[6])::DOUBLE, sum(cs[7])::DOUBLE] AS sums FROM g GROUP BY lang),
counted AS (SELECT lang, word, count(*) AS k FROM (SELECT lang, unnest(w) AS word FROM g) WHERE length(word) <= 5 AND regexp_matches(word, '^\p{Ll}+$') GROUP BY ALL),
ranked AS (SELECT lang, word, k / total AS share, row_number() OVER (PARTITION BY lang ORDER BY k DESC, word) AS r FROM counted JOIN shares USING (lang) WHERE k * 1000 >= total),
common AS (SELECT lang, list(word ORDER BY r) AS words, list(share ORDER BY r) AS qs FROM ranked WHERE r <= 24 GROUP BY lang),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(n - 7, 0) + 1)) AS i FROM g)),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM windows SEMI JOIN (SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1) USING (doc_id, win)) GROUP BY doc_id),
p AS (SELECT g.*, list_transform(cs, lambda x: x / greatest(length(t), 1)) AS pc, list_transform(sums, lambda x: x / greatest(al, 1)) AS qc, words, qs,
    list_transform(words, lambda x: len(list_filter(w, lambda y: y = x)) / greatest(n, 1)) AS pw, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM g JOIN shares USING (lang) LEFT JOIN common USING (lang)),
q AS (SELECT *, list_append(pw, greatest(0, 1 - list_sum(pw))) AS pw2, list_append(qs, greatest(0, 1 - list_sum(qs))) AS qw2 FROM p),
distances AS (SELECT *,
    CASE WHEN length(t) >= 200 THEN round(sqrt(greatest(0, list_sum(list_transform(range(1, len(pc) + 1), lambda i: CASE WHEN pc[i] > 0 THEN pc[i] * log2(2 * pc[i] / (pc[i] + qc[i])) ELSE 0 END + CASE WHEN qc[i] > 0 THEN qc[i] * log2(2 * qc[i] / (pc[i] + qc[i])) ELSE 0 END)) / 2)), 6) END AS class_distance,
    CASE WHEN n >= 50 AND len(words) > 0 THEN round(sqrt(greatest(0, list_sum(list_transform(range(1, len(pw2) + 1), lambda i: CASE WHEN pw2[i] > 0 THEN pw2[i] * log2(2 * pw2[i] / (pw2[i] + qw2[i])) ELSE 0 END + CASE WHEN qw2[i] > 0 THEN qw2[i] * log2(2 * qw2[i] / (pw2[i] + qw2[i])) ELSE 0 END)) / 2)), 6) END AS word_distance
    FROM q)
SELECT doc_id, n::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    n < 20 OR 100 * coalesce(n_repeat, 0) > 30 * n AS base_failed, class_distance, word_distance,
    NOT (n < 20 OR 100 * coalesce(n_repeat, 0) > 30 * n) AND coalesce(class_distance, 0) <= 0.33 AND coalesce(word_distance, 0) <= 0.20 + 1.3 / sqrt(greatest(n, 1)) AS kept
FROM distances LEFT JOIN repeated USING (doc_id)
"""
