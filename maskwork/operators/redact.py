"""Redaction of text and reports about it; reports never hold raw values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.display import mask_preview, pretty_label
from maskwork.operators.registry import Rule
from maskwork.operators.spans import _col, explode_spans, let, numbered, with_spans


def redact_text(text: Column | str, spans: Column | str, style: str = "label") -> Column:
    """The text with each span replaced: by ``[LABEL]``, by one ``█`` per character (``box``), or by its preview (``mask``)."""
    text, n = _col(text), F.char_length
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    if style == "label":
        shown = lambda s: F.concat(F.lit("["), s["label"], F.lit("]"))
    elif style == "box":
        shown = lambda s: F.repeat(F.lit("█"), s["end"] - s["start"])
    elif style == "mask":
        shown = lambda s: mask_preview(cut(s["start"], s["end"]))
    else:
        raise ValueError("style must be one of label, box, mask")
    def stitched(all_: Column) -> Column:
        end = lambda i: F.coalesce(F.get(all_, i)["end"], F.lit(0))
        parts = F.transform(all_, lambda s, i: F.concat(cut(end(i - 1), s["start"]), shown(s)))
        return F.array_join(F.concat(parts, F.array(cut(end(F.size(all_) - 1), n(text)))), "")

    return let(_col(spans), stitched)


def redact(docs: DataFrame, text: str = "text", categories: Sequence[str] | None = None, custom_terms: str | Sequence[str] = (), style: str = "label", rules: Sequence[Rule] | None = None) -> DataFrame:
    """``docs`` with ``spans`` and ``redacted``.  Custom terms may be one string with commas or line ends between them; ``rules``
    are a caller's own, in the place of ours and of terms."""
    terms = parse_terms(custom_terms) if isinstance(custom_terms, str) else custom_terms
    found = with_spans(docs, text, categories, terms, rules=rules)
    return found.withColumn("redacted", F.when(F.size("spans") > 0, redact_text(text, "spans", style)).otherwise(F.col(text)))


def parse_terms(terms: str) -> list[str]:
    return [t.strip() for t in terms.replace("\n", ",").split(",") if t.strip()]


def split_terms(terms: Column | str) -> Column:
    """The same for a column."""
    return F.filter(F.transform(F.split(_col(terms), "[,\n]"), lambda t: F.trim(t)), lambda t: t != "")


def summary(spans: DataFrame) -> DataFrame:
    """Spans by category, most first; ties by name."""
    return spans.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def report(docs: DataFrame, key: str, text: str = "text", spans: str = "spans", kept: Column | None = None) -> DataFrame:
    """One JSON per key, as a rule of one document: count, count by category, and regions with masked values, numbered by start;
    ``kept`` marks spans left visible."""
    rows = numbered(explode_spans(docs, key, spans, text), key)
    rows = rows.withColumn("redacted", ~kept if kept is not None else F.lit(True))
    region = F.struct("ordinal", "category", "label", pretty_label(F.col("label")).alias("name"), mask_preview(F.col("value")).alias("text"), F.round("score", 3).alias("score"), "source", "start", "end")
    per = rows.groupBy(key, "category").agg(F.count("*").alias("n"), F.collect_list(F.struct("redacted", region.alias("region"))).alias("rows"))
    one = per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"), F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"), F.sum("n").alias("count"))
    pick = lambda on: F.array_sort(F.transform(F.filter("rows", lambda r: r["redacted"] == on), lambda r: r["region"]))
    return one.select(key, F.to_json(F.struct("count", "by_category", pick(True).alias("redacted"), pick(False).alias("kept_visible"))).alias("report"))


def select_spans(spans: DataFrame, chosen: DataFrame | None, keys: list[str]) -> DataFrame:
    """All spans, or those whose keys, which may be null, and ordinal are chosen."""
    if chosen is None:
        return spans
    same = [F.col(f"_s.`{c}`").eqNullSafe(F.col(f"_c.`{c}`")) for c in [*keys, "ordinal"]]
    return spans.alias("_s").join(chosen.alias("_c"), same, "left_semi").select("_s.*")
