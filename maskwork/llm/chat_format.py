r"""Chat formatting, in Spark expressions only.

A conversation's turns are collected, sorted, merged where neighbours have one role, and written as

    <|im_start|>role\ntext<|im_end|>\n

The texts of merged turns are joined by ``<|seg|>``, so that the turns can be read back.  Text is escaped: a backslash is
doubled, and one is put behind the first character of each control string, whether of this template or of another
common one.  ``unescape`` takes every backslash away that stands before a character and keeps that character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.operators.spans import running

START, END, SEGMENT = "<|im_start|>", "<|im_end|>", "<|seg|>"
#: Control strings of common chat templates.  All that begin with ``<|`` are covered by that beginning.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
#: Spans are read in runs of so many, each cut out of the conversation once.
RUN = 64
#: A control string's first character where the rest of one follows.
CONTROL_STARTS = r"\[(?=/?INST\])|<(?=\||/?s>|</?SYS>>|(?:start|end)_of_turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({CONTROL_STARTS})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per ``conv_id``: ``conv_id, formatted string, loss_spans array<struct<start int, end int>>``.

    Turns are sorted by turn, role and text (nulls first), so ties and repeated rows have one order and all stay.  A null
    text or role is empty; a null ``conv_id`` is a conversation of its own.  Spans are half-open, in code points of
    ``formatted``, one for each turn of the trained role, and cover its text only.  An empty table gives none.  A
    conversation is one row, as long as its turns together; other columns of ``turns``, whatever their names, are left out.  Work
    is near to linear in turns, and texts are read whole.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), _by_turn).alias("_turns"))
    chats = chats.withColumn("_turns", F.transform("_turns", lambda t: F.struct(F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")).alias("role"), escape(t["text"]).alias("text"))))
    changes = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: (i == 0) | (F.get("_turns", i)["role"] != F.get("_turns", i - 1)["role"]))
    chats = chats.withColumn("_changes", changes)
    merged = F.transform("_changes", lambda i, k: F.struct(F.get("_turns", i)["role"].alias("role"), F.transform(F.slice("_turns", i + 1, F.coalesce(F.get("_changes", k + 1), F.size("_turns")) - i), lambda t: t["text"]).alias("texts")))
    chats = chats.withColumn("_blocks", merged)
    written = F.transform("_blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEGMENT), F.lit(f"{END}\n")))
    n = F.char_length
    opens = lambda i: (i == 0) | (F.get("_turns", i)["role"] != F.get("_turns", i - 1)["role"])
    before = lambda t, i: F.when(opens(i), n(t["role"]) + F.when(i == 0, len(START) + 1).otherwise(len(END) + 1 + len(START) + 1)).otherwise(len(SEGMENT))
    chats = chats.withColumn("_ends", running(F.transform("_turns", lambda t, i: before(t, i) + n(t["text"])), lambda a, b: a + b))
    placed = F.transform("_turns", lambda t, i: F.struct((F.get("_ends", i) - n(t["text"])).alias("start"), F.get("_ends", i).alias("end"), t["role"].alias("role")))
    spans = F.transform(F.filter(placed, lambda s: s["role"] == escape(F.lit(trained_role))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return chats.select("conv_id", F.array_join(written, "").alias("formatted"), spans.alias("loss_spans"))


def _by_turn(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        out = F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns and loss text read back from ``formatted`` and ``loss_spans``: adds ``turns array<struct<role, text>>, loss_text``."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")
    header = rf"(?s)^{START}((?:[^\\\n]|\\.)*+)\n(.*)$".replace("|", r"\|", 2)
    parsed = F.transform(
        blocks,
        lambda b: F.struct(unescape(F.regexp_extract(b, header, 1)).alias("role"), F.split(F.regexp_extract(b, header, 2), r"<\|seg\|>", -1).alias("texts")),
    )
    pairs = F.transform(parsed, lambda p: F.transform(p["texts"], lambda t: F.struct(p["role"].alias("role"), unescape(t).alias("text"))))
    size = F.size("loss_spans")
    runs = F.transform(
        F.filter(F.sequence(F.lit(0), F.ceil(size / RUN).cast("int")), lambda k: k * RUN < size),
        lambda k: F.struct(F.get("loss_spans", k * RUN)["start"].alias("start"), F.slice("loss_spans", k * RUN + 1, F.lit(RUN)).alias("spans")),
    )
    cut = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["spans"].alias("spans"), F.substring(F.col("formatted"), r["start"] + 1, F.element_at(r["spans"], -1)["end"] - r["start"]).alias("text")))
    texts = F.transform(cut, lambda r: F.array_join(F.transform(r["spans"], lambda s: unescape(F.substring(r["text"], s["start"] - r["start"] + 1, s["end"] - s["start"]))), ""))
    return formatted.withColumn("turns", F.flatten(pairs)).withColumn("loss_text", F.array_join(texts, ""))


CHAT_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k,
    regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>|(?:start|end)_of_turn>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS safe
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(length(safe)) + sum(CASE WHEN before IS NOT DISTINCT FROM role THEN 7 ELSE 12 + length(role) + 1 + 10 + 1 END))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
