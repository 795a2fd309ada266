"""The queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwork.session import configure, table

from .bloom_lm import score_texts, train_lm
from .chat_format import CHAT_SQL, format_chats, read_chats
from .decontaminate import DECONTAMINATE_SQL, benchmark_hits
from .importance_resampling import RESAMPLE_SQL, resample
from .lang_hyper import held_out, learn_languages, predict_languages
from .lexical_search import SEARCH_SQL, build_index, search
from .near_dedup import NEAR_SQL, NearRules, near_duplicates
from .quality_divergence import QUALITY_SQL, quality_rules
from .quality_ordinal import score_quality, train
from .secret_scan import learn_words, scan_secrets
from .shared import written
from .source_mixing import MIX_SQL, mix_sources
from .suffix_dedup import REPEAT_SQL, remove_repeats
from .url_rules import FIXED_RULES, URL_SQL, judge_urls


def op1_quality_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(configure(spark), folder, "documents").select("doc_id", "text")
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    model = train(docs, table(spark, folder, "labels").select("doc_id", grade.alias("grade")))
    return score_quality(docs, model).select("doc_id", "expected_grade", "top_probability", "kept")


def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents are repeated, shuffled and written; the result has the columns of the SQL, read from that table."""
    mixed = written(mix_sources(table(configure(spark), folder, "documents")), "mixed")
    return mixed.select("doc_id", "source", "n_copies", "copy_no", "shuffle_key")


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(configure(spark), folder, "conversations").select("conv_id", "turn", "role", "text")
    spoken = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", spoken), (-7, 1, "assistant", spoken)], "conv_id long, turn long, role string, text string")
    chats = read_chats(format_chats(turns.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_lang_hyper(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(configure(spark), folder, "documents").select("doc_id", "text", "lang", held_out(1, 3).alias("held_out"))
    model = learn_languages(docs.where(~F.col("held_out")))
    return predict_languages(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(configure(spark), folder, "documents").select("doc_id", "text")
    return benchmark_hits(docs, table(spark, folder, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules(table(configure(spark), folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(configure(spark), folder, "documents").select("doc_id", "text")
    found = scan_secrets(docs, learn_words(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(configure(spark), folder, "documents"), NearRules(percent=85))


def op9_bloom_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(configure(spark), folder, "documents").select("doc_id", "text", held_out(2, 7).alias("held_out"))
    model = train_lm(docs.where(~F.col("held_out")))
    return score_texts(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(configure(spark), folder, "documents"), digest=True)


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(configure(spark), folder, "documents").select("doc_id", "text")
    return resample(docs, table(spark, folder, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    index = build_index(table(configure(spark), folder, "documents"))
    return search(index, table(spark, folder, "benchmark"))


def op13_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(FIXED_RULES, "verdict string, host string, path string")
    return judge_urls(table(configure(spark), folder, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_quality_ordinal, op2_source_mixing, op3_chat_format, op4_lang_hyper, op5_decontaminate, op6_quality_divergence, op7_secret_scan, op8_near_dedup, op9_bloom_lm, op10_suffix_dedup, op11_importance_resampling, op12_lexical_search, op13_url_rules)}
ORACLES = {"op2_source_mixing": MIX_SQL, "op3_chat_format": CHAT_SQL, "op5_decontaminate": DECONTAMINATE_SQL, "op6_quality_divergence": QUALITY_SQL, "op8_near_dedup": NEAR_SQL, "op10_suffix_dedup": REPEAT_SQL, "op11_importance_resampling": RESAMPLE_SQL, "op12_lexical_search": SEARCH_SQL, "op13_url_rules": URL_SQL}
