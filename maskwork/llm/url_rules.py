"""URL filters: a sort-merge range join of urls with nested rules.

A host becomes a key of its labels in reverse, each closed by a separator that sorts before all else, so a host and its
subdomains are one interval of keys.  Urls and rules are dealt to ranges of keys, a rule to every range that its interval
meets, and sorted.  One sweep over a range keeps a stack of the hosts with rules that are open at this place; each has its
rules' paths in order, and every path knows the longest other one that it starts with.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import set_aside

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Closes a label.  In labels it and the character behind it are written as two of the latter and more.
_END, _MARK = "\x00", "\x01"


@dataclass(frozen=True)
class UrlRules:
    #: The verdict where no rule fits.
    otherwise: str = "allow"
    #: Urls of a range on average, and how many of them are looked at to find the ranges' borders, for each range.
    range_rows: int = 1_000_000
    sampled: int = 40


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, its A-Z in lower case, and path, without query and fragment; both empty where the url is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """A string that starts with the keys of all hosts of which ``host`` is a subdomain, and of no others; that of no host is empty."""
    safe = F.replace(F.replace(host, F.lit(_MARK), F.lit(_MARK + "\x02")), F.lit(_END), F.lit(_MARK + _MARK))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(safe, "[.]")), _END), F.lit(_END)))


class Paths:
    """The paths of one host's rules, in order, each with its string and verdict."""

    def __init__(self):
        self.paths: list[str] = []
        self.rules: list[tuple[str, str]] = []
        self.inside: list[int] = []  # the place of the longest other path that this one starts with, or -1

    def add(self, path: str, rule: str, verdict: str) -> None:
        """Paths come in order; of equal ones, the first that blocks is kept, else the first."""
        if self.paths and self.paths[-1] == path:
            if verdict == "block":
                self.rules[-1] = (rule, verdict)
            return
        i = len(self.paths) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.inside[i]
        self.paths.append(path)
        self.rules.append((rule, verdict))
        self.inside.append(i)

    def find(self, path: str) -> tuple[str, str] | None:
        """The rule of the longest path that ``path`` starts with."""
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.inside[i]
        return self.rules[i] if i >= 0 else None


class Sweep:
    """Rules and urls in the order of their keys; a key's rules come before its urls."""

    def __init__(self):
        self.stack: list[tuple[str, Paths]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, rule: str, verdict: str) -> None:
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, Paths()))
        self.stack[-1][1].add(path, rule, verdict)

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self._close(key)
        best = None
        for _, paths in reversed(self.stack):  # the longest string of host and path; of two, that of the longer host
            got = paths.find(path)
            if got and (best is None or len(got[0]) > len(best[0])):
                best = got
        return best


def judge_urls(pages: DataFrame, rules: DataFrame, settings: UrlRules = UrlRules()) -> DataFrame:
    """Judge every ``url`` by rules of ``host, path, verdict``.

    Keeps the columns of ``pages``, whatever their names (those that are made here are replaced), and adds ``host, path, rule,
    verdict``.  A rule fits its host and all subdomains where the path starts with the rule's; the longest, by characters of
    host and path together, wins, then that of the longer host, and of equal rules one that blocks.  ``rule`` is its host and
    path; it is null, and the verdict ``otherwise``, where none fits.  Hosts of rules are compared in lower case (A-Z); a null
    host or path of a rule is an empty one, and an empty host fits all urls.  A null url, or one without ``://``, has an empty
    host and path.  Long urls are read whole, repeated rows are judged alike, rows are neither dropped nor added, and an
    empty table on either side has a result.

    The borders of the ranges come from a sample of keys, ``sampled`` for each range.  A url with a key that many others have
    is told from them by its path and then by a hash, so no key has to be in one range; a range within one host gets only the
    rules whose paths it can have.  Urls and rules move once.
    """
    spark = pages.sparkSession
    inner, names, restored = set_aside(pages, ["url"], ["host", "path", "rule", "verdict"])
    host, path = split_url(F.col("url").cast("string"))
    rows = inner.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("_key", host_key(F.col("host"))).withColumn("_tie", F.xxhash64(*[c for c in names if not _unordered(inner, c)]))
    listed = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("verdict").alias("verdict")).distinct()
    listed = listed.select(host_key(F.col("host")).alias("_key"), "path", F.concat("host", "path").alias("rule"), "verdict")

    n = pages.count()
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // settings.range_rows))
    wanted = n_ranges * settings.sampled
    sample = rows.select("_key", "path", "_tie").sample(min(1.0, wanted / max(n, 1)), seed=11).collect()
    sample.sort()
    cuts = sorted({tuple(sample[len(sample) * i // n_ranges]) for i in range(1, n_ranges)}) if sample else []
    borders = spark.sparkContext.broadcast(cuts)

    dealt = rows.mapInArrow(_deal_rows(borders), _schema(rows) + ", _range int, _rule string, _verdict string")
    spread = listed.mapInArrow(_deal_rules(borders), "_key string, path string, rule string, verdict string, _range int")
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
    as_rows = spread.select(*empty, F.lit(None).cast("string").alias("host"), "path", "_key", F.lit(None).cast("long").alias("_tie"), "_range", F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    merged = dealt.unionByName(as_rows).withColumn("_is_url", F.col("_rule").isNull())
    merged = merged.repartitionById(n_ranges, F.col("_range")).sortWithinPartitions("_range", "_key", "_is_url", "path", "_verdict")
    judged = merged.mapInArrow(_sweep(settings.otherwise, names), _schema(inner.select(*names)) + ", host string, path string, rule string, verdict string")
    return judged.select(*restored, "host", "path", "rule", "verdict")


def _unordered(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString() or "variant" in df.schema[column].dataType.simpleString()


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _deal_rows(borders):
    """The range of each url: how many borders are not above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = borders.value
        for batch in batches:
            at = [bisect_right(cuts, x) for x in zip(*(batch.column(c).to_pylist() for c in ("_key", "path", "_tie")))]
            nothing = pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), nothing, nothing], names=[*batch.schema.names, "_range", "_rule", "_verdict"])

    return run


def ranges_of(key: str, path: str, cuts: list[tuple[str, str, int]]) -> list[int]:
    """The ranges that can have a url whose key starts with ``key`` and whose path starts with ``path``."""
    first, last = (bisect_left(cuts, (key,)), bisect_left(cuts, (key[: -len(_END)] + _MARK,))) if key else (0, len(cuts))
    out = []
    for r in range(first, last + 1):
        low, high = cuts[r - 1] if r else None, cuts[r] if r < len(cuts) else None
        if low and high and low[0] == high[0] and (high[1] < path or (low[1] > path and not low[1].startswith(path))):
            continue  # all of one host, and of paths before or behind
        out.append(r)
    return out


def _deal_rules(borders):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = borders.value
        for batch in batches:
            for i, (key, path) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("path").to_pylist())):
                at = ranges_of(key, path, cuts)
                for a in range(0, len(at), 10_000):
                    own = at[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array([i] * len(own))).columns, pa.array(own, pa.int32())], names=[*batch.schema.names, "_range"])

    return run


def _sweep(otherwise: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, now = Sweep(), None
        for batch in batches:
            at, rules, verdicts = [], [], []
            cols = (batch.column(c).to_pylist() for c in ("_range", "_key", "path", "_rule", "_verdict"))
            for i, (range_, key, path, rule, verdict) in enumerate(zip(*cols)):
                if range_ != now:
                    sweep, now = Sweep(), range_
                if rule is not None:
                    sweep.rule(key, path, rule, verdict)
                    continue
                got = sweep.judge(key, path)
                at.append(i)
                rules.append(got[0] if got else None)
                verdicts.append(got[1] if got else otherwise)
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in (*names, "host", "path")), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=[*names, "host", "path", "rule", "verdict"])

    return run


#: The rules of the query, as fixed by its contract: verdict, host, path.
FIXED_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URL_SQL = r"""
WITH rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r(verdict, rhost, rpath)),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""
