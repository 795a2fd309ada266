"""A SQL surface: the text operators as functions of the session, of built-in functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from maskwork.operators.redact import parse_terms, redact_text
from maskwork.operators.registry import Rule
from maskwork.operators.spans import find_spans, let
from maskwork.schemas import SPANS

#: String literals, which stay; operators in the place of a function's name, which have to be quoted there; and doubles,
#: which would be read as decimals.
_PARTS = re.compile(r"'(?:[^'\\]|\\.)*'|(<=>|<=|>=|==|!=|[-+*/%<>=!&|^~])(?=\()|((?<![\w.])\d+\.\d+(?:E-?\d+)?(?![\w.]))", re.S)


def sql_text(column: Column) -> str:
    """The expression of a column as SQL that the session's parser reads."""
    text = str(column)
    shown = re.fullmatch(r"Column<'(.*)'>", text, re.S)
    return _PARTS.sub(lambda m: f"`{m[1]}`" if m[1] else f"{m[2]}D" if m[2] else m[0], shown[1] if shown else text)


def register(spark: SparkSession, prefix: str = "maskwork", categories: Sequence[str] | None = None, custom_terms: str | Sequence[str] = (), rules: Sequence[Rule] | None = None, settle: bool = True) -> list[str]:
    """Make temporary SQL functions, and return their names:

    * ``<prefix>_find(text)``: the array of spans of a text,
    * ``<prefix>_redact(text, style)``: the text with its spans hidden, in style ``label``, ``box`` or ``mask``,
    * ``<prefix>_spans(text)``: a table of the spans, for ``FROM docs, LATERAL <prefix>_spans(text)``.

    They have the rules of the categories, or all, or a caller's own (``rules`` and ``settle`` are those of ``with_spans``), and are plain expressions, so that Spark plans and prunes what calls them
    as if it had been written out.
    """
    terms = parse_terms(custom_terms) if isinstance(custom_terms, str) else list(custom_terms)
    text = F.col("text")
    find, hide, table = (f"{prefix}_{x}" for x in ("find", "redact", "spans"))
    make = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    found = find_spans(text, categories, terms, rules, settle)

    def hidden(spans: Column) -> Column:
        out = F.when(F.col("style") == "label", redact_text(text, spans, "label"))
        for style in ("box", "mask"):
            out = out.when(F.col("style") == style, redact_text(text, spans, style))
        return F.when(F.size(spans) > 0, out.otherwise(F.raise_error(F.lit("style must be one of label, box, mask")).cast("string"))).otherwise(text)

    make(f"{find}(text STRING) RETURNS {SPANS}", sql_text(found))
    make(f"{hide}(text STRING, style STRING DEFAULT 'label') RETURNS STRING", sql_text(let(found, hidden)))
    fields = "start INT, end INT, label STRING, category STRING, score DOUBLE, source STRING, value STRING"
    make(f"{table}(text STRING) RETURNS TABLE ({fields})", f"SELECT s.start, s.end, s.label, s.category, s.score, s.source, substring(text, s.start + 1, s.end - s.start) FROM (SELECT explode(found) AS s FROM (SELECT {sql_text(found)} AS found))")
    return [find, hide, table]
