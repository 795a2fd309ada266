r"""Secret scans: fixed token shapes, and values in a credential context that would cost many guesses.

The guess cost of a value is the smallest sum, over all ways to cut it into words, dates, repeats, keyboard walks and
brute-force spans, of the decimal logarithms of how many guesses each part takes.  Dynamic programming over end positions
finds it.  A value is a secret if that is much, and not far below what as many random characters would cost: addresses, times
and phrases of words are long, but cheap for their length.  So a pass phrase of known words is no guess.  A word takes as many guesses as its rank among common passwords and then among the words of the corpus, by the
number of documents that have them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .columns import head_of, set_aside
from .shared import discard, written

#: Fixed patterns: kind, pattern, and the fewest characters of the measured group; shorter matches are dropped.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Fixed words: what stands before a value that may be a secret.
CONTEXT_WORDS = ["password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "api key", "access key", "private key", "credential", "login", "auth"]
#: The second group is there where prose leads to the value ("the password is ..."): then the value has to look like no word.
CONTEXT = re.compile(r"(?<![a-z])(?:" + "|".join(CONTEXT_WORDS) + r""")s?["']?(?:\s*(?:=>|->|[:=])\s*|(\s+(?:is|was|are)\s+:?\s*))["']?([^\s"'<>,;()\[\]{}]{6,})""", re.I | re.A)
PROSE_VALUE = re.compile(r".[^A-Za-z'\u2019\u0080-\U0010ffff-]+.|[a-z][A-Z].*[a-z]?[A-Z]")
DIGIT, BESIDE_NUMBERS = re.compile(r"[0-9]"), re.compile(r"[^0-9.,:/-]")
#: Fixed words, most common first: a word's rank is its guess count.
COMMON_WORDS = (
    "password the and pass admin user secret token key test login qwerty love abc letmein welcome dragon monkey master hello "
    "root guest default none null true false required example your here value string change changeme name data info code "
    "this that with from have not you for are was but all can one out day get has him how man new now old see two way who "
    "api access private public server database client system file text word number email account service config production "
    "summer winter spring autumn monday friday january october december sunshine princess football baseball iloveyou shadow "
    "superman batman trustno starwars computer internet michael jordan hunter killer soccer hockey ranger daniel charlie"
).split()
#: Fixed rows of a keyboard, for walks along one of them in either direction.
KEY_ROWS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz"]
_YEAR, _MONTH, _DAY, _GAP = r"(?:19|20)\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])", r"[-/._]?"
_NAMED = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}"
#: Dates in each usual order of their parts, each with the logarithm of how many there are; found at every place.
DATES = [
    (re.compile(rf"(?=({_YEAR}{_GAP}{_MONTH}{_GAP}{_DAY}))"), math.log10(36_500)),
    (re.compile(rf"(?=({_DAY}{_GAP}{_MONTH}{_GAP}(?:{_YEAR}|\d\d)))"), math.log10(2 * 36_500)),
    (re.compile(rf"(?=({_MONTH}{_GAP}{_DAY}{_GAP}(?:{_YEAR}|\d\d)))"), math.log10(2 * 36_500)),
    (re.compile(rf"(?=({_NAMED}{_GAP}(?:{_DAY}{_GAP})?{_YEAR}))", re.I), math.log10(4 * 36_500)),
    (re.compile(rf"(?=({_YEAR}{_GAP}{_MONTH}))"), math.log10(1_200)),
    (re.compile(rf"(?=({_YEAR}))"), 2.0),
]
#: Fixed parts of addresses and times, each with the logarithm of how many there are; found at every place, as dates are.
SHAPES = [
    (re.compile(r"(?=((?:https?|ftp|ssh|wss?)://(?:www\.)?))", re.I), 1.0),
    (re.compile(r"(?=(\.(?:com|org|net|edu|gov|io|dev|app|info|html?|php|co\.uk|de|fr|es|it|uk)(?![A-Za-z0-9])))", re.I), 1.5),
    (re.compile(r"(?=(T?(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,6})?)?(?:Z|[+-]\d\d:?\d\d)?))"), math.log10(86_400)),
]
#: Characters between words, which take no guess but for the place of the cut.
SEPARATORS = frozenset("-_./")
#: Characters that stand for letters in passwords, in two readings.
SPELLINGS = [str.maketrans("@4310$57!+", "aaeiossitt"), str.maketrans("@43!0$57|1", "aeeiosstll")]
REPEAT = re.compile(r"(.{1,4}?)\1+", re.S)
SETS = [(re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[0-9]"), 10), (re.compile(r"[^A-Za-z0-9]"), 33)]


@dataclass(frozen=True)
class GuessRules:
    #: Words from the most to the least common; ``learn_words`` makes a longer list.
    words: tuple[str, ...] = tuple(COMMON_WORDS)
    #: How many words of a corpus are learned at most, and in how many documents one has to be.
    most_words: int = 50_000
    least_documents: int = 3
    #: Decimal logarithm of guesses from which on a value counts as a secret.
    least_cost: float = 9.0
    #: And what share of the cost of random characters, of the same sets and as many, it has to take at least.
    least_share: float = 0.5
    #: The same for a value that may be a word or words: letters, hyphens and apostrophes only, or one capital at the front.
    least_word_share: float = 0.9
    #: What each part after the first adds, for the guesser has to try where to cut.
    part_cost: float = 0.5
    shortest_walk: int = 3


_NEIGHBOURS = {(a, b): d for row in KEY_ROWS for x, y in zip(row, row[1:]) for a, b, d in ((x, y, 1), (y, x, -1))}


def _walks(lower: str, shortest: int) -> Iterator[tuple[int, int]]:
    """Maximal runs along a key row in one direction."""
    start, way = 0, 0
    for i in range(1, len(lower) + 1):
        step = _NEIGHBOURS.get((lower[i - 1], lower[i]), 0) if i < len(lower) else 0
        if step and step == way:
            continue
        if i - start >= shortest and way:
            yield start, i
        start, way = (i - 1, step) if step else (i, 0)


@lru_cache(maxsize=8)
def _ranks(words: tuple[str, ...]) -> tuple[dict[str, float], int]:
    ranks: dict[str, float] = {}
    for i, w in enumerate(words):
        ranks.setdefault(w.lower(), math.log10(i + 2))
    return ranks, max(map(len, ranks), default=0)


def no_word(value: str) -> bool:
    """Whether a value has digits among other characters, signs inside, or capitals inside."""
    return bool((DIGIT.search(value) and BESIDE_NUMBERS.search(value)) or PROSE_VALUE.search(value))


def random_cost(value: str) -> float:
    """Decimal logarithm of the guesses for as many characters drawn from the sets that the value's characters are from."""
    return len(value) * math.log10(sum(size for pattern, size in SETS if pattern.search(value)) or 1)


def is_secret(value: str, rules: GuessRules, word_like: bool) -> bool:
    """Whether a value costs enough, by itself and beside random characters, of which words and dates take far less.

    What is cheap may stand before or behind the secret, so a stretch that only brute force finds is also enough, if it looks
    like no word.
    """
    cost, stretches = cheapest_cut(value, rules)
    if cost < rules.least_cost:
        return False
    random = random_cost(value)
    if cost >= (rules.least_word_share if word_like else rules.least_share) * random:
        return True
    return any((b - a) * random / len(value) >= rules.least_cost and no_word(value[a:b]) for a, b in stretches)


def guess_cost(value: str, rules: GuessRules = GuessRules()) -> float:
    """Decimal logarithm of the guesses that a value takes."""
    return cheapest_cut(value, rules)[0]


def cheapest_cut(value: str, rules: GuessRules = GuessRules()) -> tuple[float, list[tuple[int, int]]]:
    """The guess cost, and the brute-force spans of the cut that has it."""
    n, lower = len(value), value.lower()
    if not n:
        return 0.0, []
    ranks, longest = _ranks(rules.words)
    readings = {lower, *(lower.translate(x) for x in SPELLINGS)} if any(c in "@4310$57!+|" for c in lower) else {lower}
    each = math.log10(sum(size for pattern, size in SETS if pattern.search(value)))
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i in range(1, n - 1):
        if value[i] in SEPARATORS:
            ends[i + 1].append((i, 0.0))
    for pattern, cost in (*DATES, *SHAPES):
        for m in pattern.finditer(value):
            ends[m.end(1)].append((m.start(1), cost))
    for m in REPEAT.finditer(value):
        if m.end() - m.start() >= 3:
            ends[m.end()].append((m.start(), len(m[1]) * each + math.log10((m.end() - m.start()) / len(m[1]))))
    for a, b in _walks(lower, rules.shortest_walk):
        ends[b].append((a, math.log10(47 * 2 * (b - a))))
    best, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)  # brute: the last part is a brute-force span
    opens, last = [0] * (n + 1), [0] * (n + 1)  # where that span starts, and where the best cut's last part does
    for i in range(1, n + 1):
        opened = best[i - 1] + (rules.part_cost if i > 1 else 0.0)
        opens[i] = i - 1 if opened <= brute[i - 1] else opens[i - 1]
        brute[i] = min(brute[i - 1], opened) + each
        parts = [(best[a] + cost + (rules.part_cost if a else 0.0), a) for a, cost in ends[i]]
        for a in range(max(0, i - longest), i - 1):
            for read in readings:
                rank = ranks.get(read[a:i])
                if rank is not None:
                    changed = (0.0 if value[a:i] == lower[a:i] else 0.5) + (0.0 if read[a:i] == lower[a:i] else 1.0)
                    parts.append((best[a] + rank + changed + (rules.part_cost if a else 0.0), a))
        best[i], last[i] = min(parts, default=(math.inf, 0))
        if brute[i] <= best[i]:
            best[i], last[i] = brute[i], -1
    spans, i = [], n
    while i:
        if last[i] < 0:
            spans.append((opens[i], i))
        i = opens[i] if last[i] < 0 else last[i]
    return best[n], spans


def find_secrets(text: str, rules: GuessRules = GuessRules()) -> list[tuple[str, int, int]]:
    """Base spans, then guessed spans that lie in no base span: (kind, start, end), by start and then as kinds are listed.

    A value that a base span covers in part only is judged whole, and its span stands beside the base one.
    """
    low = text.lower()
    found: list[tuple[str, int, int]] = []
    context = any(w in low for w in CONTEXT_WORDS)
    if context:
        kind, pattern, group, least = BASE[0]
        found += [(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    if "AKIA" in text:
        kind, pattern, group, least = BASE[1]
        found += [(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    found += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    if context:
        base = sorted((x, y) for _, x, y in found)
        reach = list(accumulate((y for _, y in base), max))
        for m in CONTEXT.finditer(text):
            a, b = m.span(2)
            while b > a and text[b - 1] in ".:!?":
                b -= 1
            word_like = not no_word(text[a:b])
            if b - a < 6 or (word_like and (m[1] or not text[a:b].isascii())):
                continue
            before = bisect_right(base, (a, math.inf))  # the base spans that start no later; the furthest end tells
            if not (before and reach[before - 1] >= b) and is_secret(text[a:b], rules, word_like):
                found.append(("guess", a, b))
    order = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
    return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by one mask."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def learn_words(docs: DataFrame, rules: GuessRules = GuessRules()) -> GuessRules:
    """The rules with more words: behind their own, the ``most_words`` words of 4 to 16 letters, of any script, that are in most
    documents of the corpus, and of those in as many the first in order.

    All texts count; null ones have no words.  The bound is on what each task holds, about 5 MB at its default: a value made
    of rarer words is judged by its letters, so it costs more guesses than it should and may be masked without need, while no
    value costs fewer.  Counts are put in levels, a sixteenth of a doubling each, so that only the level that the bound cuts
    is sorted, and only the chosen words, and a count for each level, get to the driver.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{M}]+"), lambda w: F.char_length(w).between(4, 16)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rules.least_documents)
    counts = written(counts.withColumn("level", F.floor(16 * F.log2("n")).cast("int")), "words")
    room, least, cut = rules.most_words, 1 << 30, None
    for r in counts.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():
        if r["k"] > room:
            cut = r["level"]
            break
        room, least = room - r["k"], r["level"]
    found = counts.where(F.col("level") >= least).select("n", "word").collect()
    if cut is not None and room:
        found += counts.where(F.col("level") == cut).orderBy(F.desc("n"), "word").limit(room).select("n", "word").collect()
    found.sort(key=lambda r: (-r["n"], r["word"]))
    discard(counts)
    return replace(rules, words=(*rules.words, *(r["word"] for r in found)))


def scan_secrets(docs: DataFrame, rules: GuessRules = GuessRules()) -> DataFrame:
    """Find secrets in every text: keeps the columns of ``docs``, whatever their names (those that are made here are replaced),
    and adds ``secrets array<struct<kind, start, end>>`` and ``redacted`` (null where the text is null).

    Offsets are half-open and count code points.  A null or empty text has no secrets.  Repeated rows are scanned alike,
    rows are neither dropped nor added, and texts are scanned whole whatever their length; an empty table gives none.
    """
    made = ["secrets", "redacted"]
    docs, names, restored = set_aside(docs, ["text"], made)
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        for whole in batches:
            for batch in T.pieces(whole):
                texts = batch.column("text").to_pylist()
                spans = [find_secrets(t, rules) if t else [] for t in texts]
                secrets = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], SPAN_TYPE)
                redacted = pa.array([redact(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [secrets, redacted], names=[*names, *made])

    return docs.mapInArrow(run, f"{head_of(docs)}, secrets array<struct<kind:string,start:int,end:int>>, redacted string").select(*restored, *made)
