"""Finding spans in text and settling which of them stand, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwork.operators.registry import CUSTOM_RANK, RULES, Rule
from maskwork.functions.validators import more_of_secret
from maskwork.schemas import CANDIDATE, SPANS

#: ``head`` is text before the value of 32 characters or more, or all there is; ``tail`` is what is behind it, up to the
#: eighth match from there; ``alone`` says whether the text is this value and white space.
MATCHES = "array<struct<start:int,end:int,value:string,head:string,tail:string,alone:boolean>>"
#: Put round the parts of a match; a noncharacter, which a text may not have, and is read as another one where it has it.
MARK = "\ufdd0"
#: Up to so many spans are settled in one go; more are cut into islands first.
FEW = 32
_BLOCK = 32


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _places(n: Column) -> Column:
    """0 to n - 1; none for 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)


def _part(items: Column, start: Column, end: Column) -> Column:
    """Items from one place up to another, of which there is one at least; ``slice`` would go through the whole array."""
    return F.transform(F.sequence(start, end - 1), lambda i: F.get(items, i))


def running(values: Column, fold: Callable[[Column, Column], Column], levels: int = 1) -> Column:
    """For each of some integers the fold, from 0, of all up to it.  Blocks keep the work near to linear."""
    total = lambda x, start: F.aggregate(x, start, fold)
    if not levels:
        return let(values, lambda v: F.transform(v, lambda _, i: total(F.slice(v, F.lit(1), i + 1), F.lit(0))))

    def by_blocks(blocks: Column) -> Column:
        inside = lambda b, before: F.transform(b, lambda _, i: total(F.slice(b, F.lit(1), i + 1), before))
        after = lambda totals: F.flatten(F.transform(blocks, lambda b, k: let(F.coalesce(F.get(totals, k - 1), F.lit(0)), lambda before: inside(b, before))))
        return let(running(F.transform(blocks, lambda b: total(b, F.lit(0))), fold, levels - 1), after)

    def whole(v: Column) -> Column:
        blocks = F.transform(_places(F.ceil(F.size(v) / _BLOCK).cast("int")), lambda b: _part(v, b * _BLOCK, F.least((b + 1) * _BLOCK, F.size(v))))
        return let(blocks, by_blocks)

    return let(values, whole)


def _marked(text: Column, value: str, before: str = "", after: str = "", groups: int = 0, flags: str = "", value_groups: int = 0) -> Column:
    """The text with a mark before and behind each of the three parts of each match."""
    return F.regexp_replace(text, f"{flags}({before})({value})({after})", "".join(f"{MARK}${g}" for g in (1, 2 + groups, 3 + groups + value_groups)) + MARK)


def _unmarked(text: Column) -> Column:
    return F.when(text.contains(MARK), F.translate(text, MARK, "\ufdd1")).otherwise(text)


def _matches(marked: Column, context: Column) -> Column:
    """Matches of a marked text: the running lengths of the pieces between marks are their places."""

    def found(pieces: Column) -> Column:
        n = ((F.size(pieces) - 1) / 4).cast("int")
        join = lambda first, count: F.array_join(_part(pieces, first, first + count), "")

        def match(ends: Column, k: Column) -> Column:
            first = F.greatest(4 * k - 32, F.lit(0))
            alone = (n == 1) & (F.trim(F.concat(join(F.lit(0), F.lit(2)), join(F.lit(3), F.lit(2)))) == "")
            fields = {
                "start": F.get(ends, 4 * k + 1),
                "end": F.get(ends, 4 * k + 2),
                "value": F.get(pieces, 4 * k + 2),
                "head": F.when(context, join(first, 4 * k + 2 - first)),
                "tail": F.when(context, join(4 * k + 3, F.lit(34))),
                "alone": F.when(context, alone),
            }
            return F.struct(*[v.alias(name) for name, v in fields.items()])

        return let(running(F.transform(pieces, lambda p: F.char_length(p)), lambda x, y: x + y), lambda ends: F.transform(_places(n), lambda k: match(ends, k)))

    return F.when(marked.contains(MARK), let(F.split(marked, MARK, -1), found)).otherwise(F.array().cast(MATCHES))


def find_matches(text: Column | str, value: str, before: str = "", after: str = "", groups: int = 0, flags: str = "", value_groups: int = 0) -> Column:
    """All matches of ``before value after``, left to right without overlap: an array of ``struct<start, end, value>``.

    Offsets are half-open, count code points, and are those of the value.  One pass puts marks round the parts of each
    match, and the text is split at them.  ``groups`` and ``value_groups`` are the numbers of capturing groups in ``before``
    and ``value``.
    """
    found = let(_marked(_unmarked(_col(text)), value, before, after, groups, flags, value_groups), lambda m: _matches(m, F.lit(False)))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def _candidate(rank: int, start: Column, end: Column, label: str, category: str, score: float, source: str = "rule") -> Column:
    return F.struct(
        F.lit(rank).alias("rank"),
        (start - end).cast("int").alias("shorter"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        F.lit(label).alias("label"),
        F.lit(category).alias("category"),
        F.lit(score).alias("score"),
        F.lit(source).alias("source"),
    )


def _gated(t: Column, rule: Rule) -> Column:
    """The text marked by a rule; null where a cheap test says that nothing matches.  ``t`` has ``text, low, digit``."""
    gate = F.lit(True)
    if rule.digit:
        gate = gate & t["digit"]
    if rule.words:
        gate = gate & _any(t["text"].contains(w) for w in rule.words)
    if rule.folded:
        gate = gate & _any(t["low"].contains(w) for w in rule.folded)
    if rule.trigger:
        gate = gate & t["text"].rlike(rule.trigger)
    return F.when(gate, _marked(t["text"], rule.value, rule.before, rule.after, rule.groups, "(?i)" if rule.ignore_case else "", rule.value_groups))


def _checked(matches: Column, rule: Rule) -> Column:
    """Candidates of a rule's matches; one that fails its check gives none, and no shorter one is tried."""
    if rule.check:
        matches = F.filter(matches, lambda m: F.coalesce(rule.check(m["value"], m), F.lit(False)))
    end = (lambda m: m["end"] + more_of_secret(m["tail"])) if rule.extend else (lambda m: m["end"])
    return F.transform(matches, lambda m: _candidate(rule.rank, m["start"], end(m), rule.label, rule.category, rule.score))


def _all_candidates(text: Column, rules: list[Rule]) -> Column:
    """Candidates of all rules.  What is alike for all is one expression over an array of marked texts, so plans stay small."""
    context = F.array(*[F.lit(r.context or r.extend) for r in rules])
    facts = F.struct(text.alias("text"), F.lower(text).alias("low"), text.rlike("[0-9]").alias("digit"))
    marked = let(facts, lambda t: F.array(*[_gated(t, r) for r in rules]))
    matched = F.transform(marked, lambda m, i: F.coalesce(_matches(m, F.get(context, i)), F.array().cast(MATCHES)))
    return let(matched, lambda found: F.concat(*[_checked(F.get(found, F.lit(i)), r) for i, r in enumerate(rules)]))


def rule_candidates(text: Column, rule: Rule) -> Column:
    """Candidates of one rule, in a text that is not null."""
    return _all_candidates(_unmarked(text), [rule])


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def wanted_rules(categories: Sequence[str] | None) -> list[Rule]:
    return [r for r in RULES if categories is None or r.category in categories]


_built: dict[tuple, Column] = {}


def rules_candidates(text: Column | str, rules: Sequence[Rule]) -> Column:
    """What a caller's own rules find, before overlaps are settled; none in a null text."""
    return _all_candidates(_unmarked(F.coalesce(_col(text), F.lit(""))), list(rules))


def as_spans(found: Column | str) -> Column:
    """Candidates as spans, by start, with overlaps left as they are."""
    return F.sort_array(F.transform(_col(found), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "label", "category", "score", "source")]))).cast(SPANS)


def candidates(text: Column | str, categories: Sequence[str] | None = None, custom_terms: Sequence[str] = ()) -> Column:
    """What all rules of the categories find, before overlaps are settled.  Custom terms are found whatever the categories."""
    key = (SparkContext._active_spark_context.applicationId, text, None if categories is None else tuple(categories), tuple(custom_terms)) if isinstance(text, str) else None
    if key in _built:
        return _built[key]
    text = _unmarked(F.coalesce(_col(text), F.lit("")))
    rules = [_custom(t) for t in sorted({t.strip() for t in custom_terms if t and t.strip()}, key=lambda t: (-len(t), t))] + wanted_rules(categories)
    out = _all_candidates(text, rules) if rules else F.array().cast(f"array<{CANDIDATE}>")
    if key:
        if len(_built) > 32:
            _built.clear()
        _built[key] = out  # to build it takes seconds, as each function is a call to the JVM
    return out


def _custom(term: str) -> Rule:
    """A term in upper or lower case, taken literally."""
    quoted = term.replace("\\E", r"\E\\E\Q")
    return Rule("CUSTOM", "custom", rf"(?iu)\Q{quoted}\E", rank=CUSTOM_RANK)


def _apart(a: Column, b: Column) -> Column:
    return (a["end"] <= b["start"]) | (a["start"] >= b["end"])


def _islands(items: Column, body: Callable[[Column], Column]) -> Column:
    """The items that ``body`` leaves of each island: a group that no other item reaches into."""
    placed = F.sort_array(F.transform(items, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c.alias("item"))))

    def cut(rows: Column) -> Column:
        n = F.size(rows)

        def at(reach: Column) -> Column:
            heads = F.filter(_places(n), lambda i: F.coalesce(F.get(reach, i - 1) <= F.get(rows, i)["start"], F.lit(True)))
            own = lambda h, j, all_: F.transform(_part(rows, h, F.coalesce(F.get(all_, j + 1), n)), lambda r: r["item"])
            return let(heads, lambda all_: F.flatten(F.transform(all_, lambda h, j: let(own(h, j, all_), lambda x: F.when(F.size(x) == 1, x).otherwise(body(x))))))

        return let(running(F.transform(rows, lambda r: r["end"]), lambda x, y: F.greatest(x, y)), at)

    return let(placed, cut)


def _settled(items: Column, body: Callable[[Column], Column]) -> Column:
    return F.when(F.size(items) <= FEW, body(items)).otherwise(_islands(items, body))


def _greedy(items: Column) -> Column:
    return F.aggregate(F.sort_array(items), F.slice(items, 1, 0), lambda acc, z: F.when(F.forall(acc, lambda k: _apart(k, z)), F.concat(acc, F.array(z))).otherwise(acc))


def resolve(found: Column | str) -> Column:
    """Greedy choice by rank, then length, then start: what overlaps nothing chosen so far is chosen.  Sorted by start."""
    kept = let(_col(found), lambda c: _settled(c, _greedy))
    spans = F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "label", "category", "score", "source")]))
    return F.sort_array(spans).cast(SPANS)


def find_spans(text: Column | str, categories: Sequence[str] | None = None, custom_terms: Sequence[str] = (), rules: Sequence[Rule] | None = None, settle: bool = True) -> Column:
    """Non-overlapping sensitive spans of a text, sorted by start.

    Categories choose the rules before overlaps are settled, so a rule that is left out takes no span away from another.
    A null text has none.  ``rules`` and ``settle`` are those of ``with_spans``.
    """
    found = candidates(text, categories, custom_terms) if rules is None else rules_candidates(text, rules)
    return F.when(F.size(found) > 0, resolve(found) if settle else as_spans(found)).otherwise(F.array().cast(SPANS))


def merge_spans(sure: Column | str, others: Column | str) -> Column:
    """All of the first spans, and those of the others, in their order, that overlap nothing taken so far; by start."""
    tagged = lambda spans, kind: F.transform(_col(spans).cast(SPANS), lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), z["start"].alias("start"), z["end"].alias("end"), z.alias("span")))

    def taken(items: Column) -> Column:
        return F.aggregate(F.sort_array(items), F.slice(items, 1, 0), lambda acc, z: F.when((z["kind"] == 0) | F.forall(acc, lambda k: _apart(k, z)), F.concat(acc, F.array(z))).otherwise(acc))

    merged = let(F.concat(tagged(sure, 0), tagged(others, 1)), lambda c: _settled(c, taken))
    return F.sort_array(F.transform(merged, lambda m: m["span"]))


def once(column: Column) -> Column:
    """The column behind a fence: being indeterminate, it is not moved into filters, which would compute it again."""
    return F.when(F.rand(0) + 1 > 0, column)


def with_spans(docs: DataFrame, text: str = "text", categories: Sequence[str] | None = None, custom_terms: Sequence[str] = (), name: str = "spans", rules: Sequence[Rule] | None = None, settle: bool = True) -> DataFrame:
    """``docs`` with their spans.  Candidates are made in a projection of their own, so that each is computed once.

    ``rules`` are a caller's own, in the place of ours; without ``settle`` all that is found is kept, overlaps included.
    """
    found = docs.withColumn("_found", once(candidates(text, categories, custom_terms) if rules is None else rules_candidates(text, rules)))
    return found.withColumn(name, F.when(F.size("_found") > 0, resolve("_found") if settle else as_spans("_found")).otherwise(F.array().cast(SPANS))).drop("_found")


def explode_spans(docs: DataFrame, key: str | list[str], spans: str = "spans", text: str = "text") -> DataFrame:
    """One row per span: the keys, the span's fields, its ordinal (from 1) and its value."""
    keys = [key] if isinstance(key, str) else key
    rows = docs.select(*keys, text, F.posexplode(spans).alias("ordinal", "_s"))
    return rows.select(*keys, (F.col("ordinal") + 1).alias("ordinal"), "_s.*", F.substring(F.col(text), F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")).alias("value"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Spans with ordinals by key and start, where texts may have one key, or none; ties by label, end and value."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("start", "label", "end", "value")))


def resolve_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The greedy choice over rows ``keys, rank, start, end, ...``, for documents with more spans than an array should hold.

    Rows are cut into islands that no span reaches across; a choice in one cannot touch another, so each island is settled
    on its own, and only an island's spans are ever held together.
    """
    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", (F.coalesce(reach, F.lit(0)) <= F.col("start")).cast("int")).withColumn("_island", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in rows.columns if c not in (*keys, "rank", "start", "end")]
    item = F.struct(F.col("rank"), (F.col("start") - F.col("end")).alias("shorter"), F.col("start"), F.col("end"), *[F.col(c) for c in rest])
    islands = marked.groupBy(*keys, "_island").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    kept = islands.withColumn("_kept", F.aggregate("_items", F.slice("_items", 1, 0), lambda acc, z: F.when(F.forall(acc, lambda k: _apart(k, z)), F.concat(acc, F.array(z))).otherwise(acc)))
    return kept.select(*keys, F.explode("_kept").alias("_s")).select(*keys, "_s.rank", "_s.start", "_s.end", *[f"_s.{c}" for c in rest])
