"""Removal of long repeated byte strings with a sparse suffix array, built by a common-prefix-aware merge sort.

Each string of ``length`` bytes has an anchor: the k-byte substring of the smallest hash in it.  The anchor depends on the
string alone, so equal strings have it at the same place, and only suffixes that start at anchors need sorting.

1. Texts are dealt to runs, equal ones to the same run, where all but those of the smallest id are set aside: they are
   repeats as a whole.  Runs exchange fingerprints of what stands at their anchors, up to the middle of the strings that
   lie before and behind: where both are in one document only, no string of the anchor can be a repeat, and its suffix goes
   no further.  The answer is one bit for each, in the order in which they were sent.  An anchor with very many surroundings
   is split: each of its strings becomes a suffix of its own, which starts at the string and is filed by the string's hash,
   so that no range holds them all.
2. Each run sorts its remaining suffixes, up to the end of the last string of that anchor, joins equal ones, and sends
   them front-coded: the length of the prefix shared with the one before, and the rest.
3. Each range of anchors merges its runs by a loser tree that knows, for each contender, the prefix shared with the last
   suffix put out.  The longer one wins without a look at the bytes; at a tie the comparison goes on behind it.
4. The common prefixes of neighbours, and those of what stands before the anchors, say which strings are equal, and so
   which is the smallest document that has each.  Runs get this back and remove what a smaller document has.

No run sends a row to every range of many.  Where there are more than ``fan`` of them, rows go to groups of ranges first, and
there blocks of as many runs are merged and sent on to smaller groups.  Groups are as even as the number of steps allows, so
that a task between two steps has no more than one at the end of them.  All that is sent is packed by columns.
"""
from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as T
from .exchange import Entries, widths

U = np.uint64
LAST = np.int64(2**63 - 1)  # stands for a null id
STEP = 1 << 19


@dataclass(frozen=True)
class RepeatRules:
    length: int = 50
    #: Bytes of an anchor: fewer make fewer anchors, more make fewer that are alike by chance.
    seed: int = 16
    #: Bytes of text in a run.  Runs and anchor ranges are as many as the text has such parts.
    run_bytes: int = 4 << 20
    #: Into so many groups of ranges at most a run sends its rows, and so many runs at most are merged at once.
    fan: int = 512
    #: An anchor with more distinct surroundings than this, counted to a power of two in each run, is split by its strings, and
    #: so are those that are counted together with it.
    hot: int = 100_000

    @property
    def reach(self) -> int:
        """The largest offset of an anchor in a string."""
        return self.length - self.seed

    @property
    def half(self) -> int:
        """Strings whose anchor is no further in have what is ahead of it in common, the others what is behind."""
        return self.reach // 2


@dataclass
class Anchors:
    """By anchor: its place, the first and last start of the strings that it anchors, its row, and hashes: of the anchor, of its
    segment, and of the anchor with what follows and with what precedes it in each string of the one and of the other half;
    these are odd, and 0 where there is no such string."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray
    fingerprint: np.ndarray
    segment: np.ndarray
    ahead: np.ndarray
    behind: np.ndarray

    def __getitem__(self, chosen) -> Anchors:
        return Anchors(*(x[chosen] for x in (self.at, self.first, self.last, self.row, self.fingerprint, self.segment, self.ahead, self.behind)))

    def strings(self, data: np.ndarray, size: int) -> Anchors:
        """Each string of these anchors as an anchor of its own, at its start."""
        n = self.last - self.first + 1
        at = np.repeat(self.first - np.cumsum(n) + n, n) + np.arange(n.sum())
        whole = np.zeros(len(at), U)
        for base in range(0, len(data), STEP):
            own = slice(*np.searchsorted(at, [base, base + STEP]))
            if own.stop > own.start:
                whole[own] = T.Hasher(data[base : base + STEP + size])(at[own] - base, at[own] - base + size)
        none = np.zeros(len(at), U)
        return Anchors(at, at, at, np.repeat(self.row, n), whole >> U(1), T.mix(whole), none, none)


def find_anchors(data: np.ndarray, offsets: np.ndarray, rules: RepeatRules, halves: bool = True) -> Anchors:
    """Anchors of all rows, the same for a row wherever it stands: each step has the anchors that lie in it, and reads as
    far before it as their strings may begin, so a border never cuts a segment in two.  Without ``halves`` there are no hashes of
    what is ahead and behind."""
    n, size = len(data), rules.length
    parts = []
    ends = np.repeat(offsets[1:], np.diff(offsets))  # of the row that each byte is in
    for base in range(0, n - rules.seed + 1 if n >= size else 0, STEP):
        begin = max(0, base - rules.reach)
        piece = data[begin : base + STEP + size - 1]
        hasher = T.Hasher(piece)
        seeds = hasher.windows(rules.seed)
        key = seeds & U(2**64 - 2**24) | np.arange(len(seeds), dtype=U)  # the leftmost of equal ones is the smallest
        width, done = rules.reach + 1, 1
        while 2 * done <= width:
            key = np.minimum(key[:-done], key[done:])
            done *= 2
        if done < width:
            key = np.minimum(key[: len(key) - (width - done)], key[width - done :])
        starts = np.flatnonzero(ends[begin : begin + len(key)] - np.arange(begin, begin + len(key)) >= size)
        at = (key[starts] & U(2**24 - 1)).astype(np.int64)
        own = (at + begin >= base) & (at + begin < base + STEP)
        starts, at = starts[own], at[own]
        if not len(starts):
            continue
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        first, last, at = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1], at[new]
        segment = T.mix(hasher(first, last + size) + (at - first).astype(U))
        ahead, behind = np.zeros(len(at), U), np.zeros(len(at), U)
        own = np.flatnonzero(last + rules.half >= at) if halves else []
        if len(own):
            ahead[own] = hasher(at[own], at[own] + size - rules.half) | U(1)
        own = np.flatnonzero(first + rules.half < at) if halves else []
        if len(own):
            behind[own] = hasher(at[own] - rules.half - 1, at[own] + rules.seed) | U(1)
        parts.append((at + begin, first + begin, last + begin, T.mix(seeds[at]) >> U(1), segment, ahead, behind))  # mixed again: anchors have small hashes
    if not parts:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none, *[none.astype(U)] * 4)
    at, first, last, *hashes = (np.concatenate(x) for x in zip(*parts))
    return Anchors(at, first, last, np.searchsorted(offsets, at, side="right") - 1, *hashes)


def _set_apart(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The rows of a run, and those whose whole text a row of a smaller id has."""
    if not table.num_rows:
        return table, table
    ids = np.asarray(pc.fill_null(table.column("doc_id"), int(LAST)), np.int64)
    texts = pa.chunked_array([pc.fill_null(table.column("text"), "").combine_chunks()])
    codes = np.asarray(texts.dictionary_encode().chunk(0).indices)
    least = np.full(codes.max() + 1, LAST)
    np.minimum.at(least, codes, ids)
    copy = least[codes] < ids
    return (table.filter(pa.array(~copy)), table.filter(pa.array(copy))) if copy.any() else (table, table.slice(0, 0))


def _rows(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of the texts of a run, piece by piece."""
    T.release()
    for piece in (p.combine_chunks() for p in T.pieces(table, limit=1 << 19)):
        ids = piece.column("doc_id").combine_chunks() if isinstance(piece.column("doc_id"), pa.ChunkedArray) else piece.column("doc_id")
        data, offsets = T.buffers(piece.column("text"))
        yield np.asarray(ids.fill_null(int(LAST)), np.int64), data, offsets


def _range_of(fingerprint: np.ndarray, ranges: int) -> np.ndarray:
    return ((fingerprint >> U(39)) * U(ranges) >> U(24)).astype(np.int64)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and where each group of equal keys starts in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]]))


def _least_most(keys: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place for each distinct key, with the least and the most of its group."""
    order, new = _grouped(keys)
    return order[new], np.minimum.reduceat(least[order], new), np.maximum.reduceat(most[order], new)


# Packed columns

ZSTD = pa.Codec("zstd")
#: Kinds of columns: of bytes, of bits, and of numbers that are stored byte by byte, or as differences byte by byte.
BYTES, BITS, HASHES, IDS, NUMBERS, RISING, VALUES = ("u1", "bytes"), ("u1", "bits"), ("<u8", "planes"), ("<i8", "planes"), ("<i4", "planes"), ("<i4", "steps"), ("<u4", "steps")
Kind = tuple[str, str]


def _squeezed(plane: bytes) -> bytes:
    """One byte for a plane of equal ones, else whichever is shorter of the plane and what zstd makes of it."""
    if plane.count(plane[:1]) == len(plane):
        return plane[:1]
    small = ZSTD.compress(plane, asbytes=True)
    return small if len(small) < len(plane) else plane


def pack(columns: list[np.ndarray], kinds: list[Kind]) -> bytes:
    lengths, planes = [], []
    for x, (kind, how) in zip(columns, kinds):
        x = np.ascontiguousarray(x, kind)
        if how == "bits":
            x = np.packbits(x)
        elif how == "steps":
            x = np.diff(x, prepend=x.dtype.type(0))
        lengths.append(len(x))
        planes += [_squeezed(p.tobytes()) for p in x.view(np.uint8).reshape(len(x), x.itemsize).T] if len(x) else [b""] * x.itemsize
    return np.array(lengths + [len(p) for p in planes], np.int32).tobytes() + b"".join(planes)


def unpack(packed: bytes, kinds: list[Kind]) -> list[np.ndarray]:
    counts = [np.dtype(kind).itemsize for kind, _ in kinds]
    head = np.frombuffer(packed, np.int32, len(kinds) + sum(counts)).tolist()
    sizes, at, out = iter(head[len(kinds) :]), 4 * len(head), []
    for (kind, how), n, count in zip(kinds, head, counts):
        planes = np.empty((count, n), np.uint8)
        for k in range(count):
            size = next(sizes)
            if size == n:
                planes[k] = np.frombuffer(packed, np.uint8, n, at)
            elif size == 1:
                planes[k] = packed[at]
            else:
                planes[k] = np.frombuffer(ZSTD.decompress(packed[at : at + size], n), np.uint8)
            at += size
        x = planes[0] if count == 1 else np.ascontiguousarray(planes.T).view(kind).ravel()
        if how == "steps":
            x = np.cumsum(x, dtype=x.dtype)
        elif how == "bits":
            x = np.unpackbits(x, count=len(out[0]))
        out.append(x)
    return out


def _gathered(packed: list[bytes], kinds: list[Kind]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(unpack(p, kinds) for p in packed))]


def _parted(columns: list[np.ndarray], kinds: list[Kind], width: int) -> Entries:
    """Rows that are sorted by their target, the first column, packed for each group of ``width`` targets."""
    keys, cuts = np.unique(columns[0] // width, return_index=True)
    return [(int(k), pack([c[a:b] for c in columns], kinds)) for k, a, b in zip(keys, cuts, [*cuts[1:], len(columns[0])])]


def _regrouped(packed: list[bytes], kinds: list[Kind], width: int) -> Entries:
    """Rows of several sources for smaller groups of targets; those for one target stay in the order of sources."""
    columns = _gathered(packed, kinds)
    order = np.argsort(columns[0], kind="stable")
    return _parted([c[order] for c in columns], kinds, width)


# 1. fingerprints

#: A range has but so many fingerprints, so of each only so many bits are sent.  Two that agree in these by chance count as
#: one: that sends suffixes in vain and changes no result.
SENT = 26
#: Anchors of a range are counted in so many parts by their own fingerprints; all of a part are split where one of them is hot.
COUNTED = 6
#: Range, run, fingerprint, and if several documents have it; or a part of the anchors, with its number of segments.
PRINTS = [RISING, RISING, VALUES, BYTES]
#: Run, and if several have the fingerprint, or if anchors of the part are to be split.
REPLIES = [RISING, BITS]


def _keyed(prints: np.ndarray, ranges: int, anchors: bool = False) -> np.ndarray:
    """A range, if it is a part of the anchors, and the sent bits of a fingerprint, in one number."""
    return _range_of(prints >> U(1), ranges).astype(U) << U(SENT + 1) | U(int(anchors) << SENT) | prints >> U(1) & U(2 ** (COUNTED if anchors else SENT) - 1)


def _prints(found: list[Anchors], owners: list[np.ndarray], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """What a run sends: sorted keys of fingerprints, and a byte for each: one bit for several documents, above the number of
    bits of how many segments a part of the anchors has.  Each run sends all parts that it has, so that all learn which to split."""
    ids = np.concatenate(owners)
    ahead, behind, anchors, segments = (np.concatenate([getattr(a, x) for a in found]) for x in ("ahead", "behind", "fingerprint", "segment"))
    keys = np.concatenate([_keyed(x[x > 0], ranges) for x in (ahead, behind)])
    if not len(keys):
        return np.zeros(0, U), np.zeros(0, np.uint8)
    one, least, most = _least_most(keys, *[np.concatenate([ids[ahead > 0], ids[behind > 0]])] * 2)
    anchors = _keyed(anchors << U(1), ranges, anchors=True)
    order = np.lexsort([segments, anchors])
    anchors, segments = anchors[order], segments[order]
    changed = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    new = np.flatnonzero(changed)
    distinct = np.add.reduceat((changed | np.concatenate([[True], segments[1:] != segments[:-1]])).astype(np.int64), new)
    count = np.log2(distinct).astype(np.uint8).clip(max=30) + np.uint8(1)
    keys, flags = np.concatenate([keys[one], anchors[new]]), np.concatenate([(least != most).astype(np.uint8), count << np.uint8(1)])
    order = np.argsort(keys)
    return keys[order], flags[order]


def _anchored(table: pa.Table, rules: RepeatRules, halves: bool = True) -> tuple[list[Anchors], list[np.ndarray], list[np.ndarray]]:
    """Anchors of each piece of a run, the ids of the documents they are in, and the piece's bytes."""
    found, owners, texts = [], [], []
    for ids, data, offsets in _rows(table):
        found.append(find_anchors(data, offsets, rules, halves))
        owners.append(ids[found[-1].row])
        texts.append(data)
    return found, owners, texts


def _numbered(found: list[Anchors]) -> np.ndarray:
    """The segments of a run, sorted; by their place among these, which is the same in whatever order rows come, runs and ranges speak of them."""
    return np.unique(np.concatenate([a.segment for a in found]))


def _fingerprints(table: pa.Table, ranges: int, rules: RepeatRules, width: int = 1) -> Entries:
    """For each group of ranges, the run's fingerprints."""
    found, owners, _ = _anchored(_set_apart(table)[0], rules)
    keys, flags = _prints(found, owners, ranges)
    run = np.full(len(keys), table.column("run")[0].as_py(), np.int32)
    return _parted([(keys >> U(SENT + 1)).astype(np.int32), run, (keys & U(2 ** (SENT + 1) - 1)).astype(np.uint32), flags], PRINTS, width)


def _repeated(sources: list[int], packed: list[bytes], rules: RepeatRules, width: int = 1) -> Entries:
    """For each group of runs, the answers to their fingerprints, in the order of those."""
    _, runs, values, flags = _gathered([p for _, p in sorted(zip(sources, packed))], PRINTS)
    order, new = _grouped(values)
    several = (np.diff(np.append(new, len(order))) > 1) | (np.bitwise_or.reduceat(flags[order], new) & 1 == 1)
    count = (flags[order] >> 1).astype(np.int64)
    hot = np.add.reduceat(np.where(count > 0, np.int64(1) << (count - 1).clip(min=0), 0), new) > rules.hot
    answer = np.where(values[order][new] >> np.uint32(SENT) > 0, hot, several)
    reply = np.empty(len(order), np.uint8)
    reply[order] = np.repeat(answer, np.diff(np.append(new, len(order))))
    order = np.argsort(runs, kind="stable")
    return _parted([runs[order], reply[order]], REPLIES, width)


# 2. sorted, front-coded suffixes


def _matrix(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
    """Rows of ``width`` bytes from each start, zero behind each size; or those before each start, the nearest first."""
    out = np.zeros((len(starts), width), np.uint8)
    for k in range(width if len(data) else 0):
        at = starts - 1 - k if backwards else starts + k
        out[:, k] = np.where(k < sizes, data[at.clip(0, len(data) - 1)], 0)
    return out


def _sort_keys(matrix: np.ndarray) -> list[np.ndarray]:
    """Columns of eight bytes each, the last first, as lexsort wants them."""
    width = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), width), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    words = padded.view(">u8")
    return [words[:, i] for i in reversed(range(words.shape[1]))]


def _common(matrix: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before; 0 for the first."""
    out = np.zeros(len(matrix), np.int64)
    if len(matrix) > 1:
        differs = matrix[1:] != matrix[:-1]
        out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), matrix.shape[1])
        out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


#: The columns of a ``Block``.
SUFFIXES = [RISING, BYTES, BYTES, BYTES, BYTES, BYTES, IDS, BYTES, HASHES, NUMBERS, BYTES]


@dataclass
class Block:
    """Suffixes sorted by range and bytes, front-coded: ``shared`` with the one before in the range and the ``rest``; and of
    each what stands before its anchor, the smallest document and whether there are several, its segment's number in the run,
    its run, and whether it is one of a split anchor, which has a hash in place of the number."""

    part: np.ndarray
    shared: np.ndarray
    right: np.ndarray
    left: np.ndarray
    rest: np.ndarray
    before: np.ndarray
    least: np.ndarray
    several: np.ndarray
    segment: np.ndarray
    run: np.ndarray
    split: np.ndarray

    def pack(self) -> bytes:
        return pack([getattr(self, x) for x in self.__dataclass_fields__], SUFFIXES)

    @staticmethod
    def unpack(packed: bytes) -> Block:
        return Block(*unpack(packed, SUFFIXES))

    def parted(self, width: int) -> Entries:
        """The suffixes for each group of ``width`` ranges, packed."""
        keys, cuts = np.unique(self.part // width, return_index=True)
        ends = {"rest": np.cumsum(np.append(0, self.right.astype(np.int64) - self.shared)), "before": np.cumsum(np.append(0, self.left.astype(np.int64)))}
        own = lambda name, a, b: getattr(self, name)[ends[name][a] : ends[name][b]] if name in ends else getattr(self, name)[a:b]
        return [(int(k), Block(*(own(x, a, b) for x in self.__dataclass_fields__)).pack()) for k, a, b in zip(keys, cuts, [*cuts[1:], len(self.part)])]

    def readers(self) -> list[tuple[int, int, FrontCoded]]:
        """By range: its number, the place of its first suffix, and its suffixes."""
        parts, cuts = np.unique(self.part, return_index=True)
        cuts = [*cuts.tolist(), len(self.part)]
        rests = np.cumsum(np.append(0, self.right.astype(np.int64) - self.shared))[cuts].tolist()
        shared, right, rest = self.shared.tobytes(), self.right.tobytes(), self.rest.tobytes()
        return [(p, a, FrontCoded(shared[a:b], right[a:b], rest[x:y])) for p, a, b, x, y in zip(parts.tolist(), cuts, cuts[1:], rests, rests[1:])]


def _ragged(matrix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes from low to high of each row, one row after another."""
    steps = np.arange(matrix.shape[1], dtype=np.uint8)[None, :]
    return matrix[(steps >= low.astype(np.uint8)[:, None]) & (steps < high.astype(np.uint8)[:, None])]


def _suffix_runs(table: pa.Table, sources: list[int], packed: list[bytes], ranges: int, rules: RepeatRules, width: int = 1) -> Entries:
    """For each group of ranges, the run's distinct suffixes, sorted and front-coded."""
    if not packed or not table.num_rows:
        return []
    found, owners, texts = _anchored(_set_apart(table)[0], rules)
    keys, _ = _prints(found, owners, ranges)
    _, replies = _gathered([p for _, p in sorted(zip(sources, packed))], REPLIES)
    if len(replies) != len(keys):
        raise ValueError("texts of a run differ from those of its fingerprints")

    def told(prints: np.ndarray, anchors: bool = False) -> np.ndarray:
        own = _keyed(prints, ranges, anchors)
        at = np.searchsorted(keys, own).clip(max=len(keys) - 1)
        return (keys[at] == own) & (replies[at] == 1)

    parts = []
    for a, ids, data in zip(found, owners, texts):
        hit = (a.ahead > 0) & told(a.ahead) | (a.behind > 0) & told(a.behind)
        a, ids = a[hit], ids[hit]
        a.row = np.arange(len(a.at))
        hot = told(a.fingerprint << U(1), anchors=True)
        for chosen, split in ((a[~hot], 0), (a[hot], 1)):
            if not len(chosen.at):
                continue
            if split:
                chosen = chosen.strings(data, rules.length)
            own = ids[chosen.row]
            one, least, most = _least_most(chosen.segment, own, own)
            c = chosen[one]
            right, left = c.last + rules.length - c.at, c.at - c.first
            small = [x.astype(np.uint8) for x in (right, left, np.full(len(right), split))]
            parts.append((c.segment, c.fingerprint, least, most, *small, _matrix(data, c.at, right, rules.length), _matrix(data, c.at, left, rules.reach, True)))
    if not parts:
        return []
    segment, print_, least, most, right, left, split, rights, lefts = (np.concatenate(x) for x in zip(*parts))
    del parts
    one, least, most = _least_most(segment, least, most)
    part = _range_of(print_[one], ranges)
    order = np.lexsort([*_sort_keys(lefts[one]), left[one], right[one], *_sort_keys(rights[one]), part])
    least, several, part, one = least[order], (least != most)[order].astype(np.uint8), part[order], one[order]
    segment, right, left, split, rights, lefts = segment[one], right[one], left[one], split[one], rights[one], lefts[one]
    segment = np.where(split == 1, segment, np.searchsorted(_numbered(found), segment).astype(U))
    shared = _common(rights, right).astype(np.uint8)
    shared[np.flatnonzero(np.diff(part, prepend=-1))] = 0
    run = np.full(len(part), table.column("run")[0].as_py(), np.int32)
    rest, before = _ragged(rights, shared, right), _ragged(lefts, np.zeros(len(left)), left)
    return Block(part, shared, right, left, rest, before, least, several, segment, run, split).parted(width)


# 3. merging


class FrontCoded:
    """A sorted run read one suffix at a time: ``text`` is the current one, ``shared`` its prefix with the one before."""

    def __init__(self, shared: bytes, sizes: bytes, rest: bytes):
        self.lengths, self.sizes, self.rest = shared, sizes, rest
        self.row, self.at, self.text, self.shared = -1, 0, b"", 0

    def advance(self) -> bool:
        self.row += 1
        if self.row == len(self.lengths):
            return False
        self.shared = self.lengths[self.row]
        size = self.sizes[self.row] - self.shared
        self.text = self.text[: self.shared] + self.rest[self.at : self.at + size]
        self.at += size
        return True


def merge_runs(runs: list[FrontCoded]) -> Iterator[tuple[int, int, int]]:
    """(run, row in it, prefix shared with the suffix before) of all suffixes in order, by a loser tree.

    ``known[i]`` is the prefix that run i's current suffix shares with the last winner on its path, -1 if it has ended.
    Of two contenders, the one that shares more is smaller, and the other shares no more with it than is known; only at
    equal lengths are bytes compared, from there on, and the loser keeps how far they agree.
    """
    n = len(runs)
    known = [0 if r.advance() else -1 for r in runs]
    losers = [-1] * max(n, 1)

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        h = known[a]
        if h < 0:
            return a, b
        x, y = runs[a].text, runs[b].text
        least = min(len(x), len(y))
        while h + 8 <= least and x[h : h + 8] == y[h : h + 8]:
            h += 8
        while h < least and x[h] == y[h]:
            h += 1
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    # Leaves are n to 2n - 1; an inner node's winner goes up, its loser stays.
    up = [-1] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        up[node], losers[node] = play(up[2 * node], up[2 * node + 1])
    winner = up[1] if n else -1
    while n and known[winner] >= 0:
        run = runs[winner]
        yield winner, run.row, known[winner]
        known[winner] = run.shared if run.advance() else -1
        node = (winner + n) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


def merge_blocks(blocks: list[Block], rules: RepeatRules, texts: bool) -> tuple[Block, np.ndarray]:
    """One sorted block of all, and what stands before each anchor as rows; the rests of suffixes only if asked for."""
    places, shared, rests = array("q"), bytearray(), []
    first = np.cumsum([0] + [len(b.shared) for b in blocks]).tolist()
    ranges: dict[int, list[tuple[int, FrontCoded]]] = {}
    for i, b in enumerate(blocks):
        for part, place, reader in b.readers():
            ranges.setdefault(part, []).append((first[i] + place, reader))
    for part in sorted(ranges):
        starts, readers = zip(*ranges.pop(part))
        for i, row, common in merge_runs(readers):
            places.append(starts[i] + row)
            shared.append(common)
            if texts:
                rests.append(readers[i].text[common:])
    at = np.frombuffer(places, np.int64)
    joined = lambda name: np.concatenate([getattr(b, name) for b in blocks])
    left = joined("left")
    begins = np.cumsum(left, dtype=np.int64) - left
    lefts = _matrix(joined("before"), begins[at], left[at], rules.reach)
    rest = np.frombuffer(b"".join(rests), np.uint8)
    gathered = {name: joined(name)[at] for name in ("part", "right", "least", "several", "segment", "run", "split")}
    before = _ragged(lefts, np.zeros(len(at)), left[at]) if texts else rest
    return Block(shared=np.frombuffer(bytes(shared), np.uint8), left=left[at], rest=rest, before=before, **gathered), lefts


# 4. which strings are equal


def _smallest_owners(packed: list[bytes], rules: RepeatRules, width: int = 1) -> Entries:
    """For each group of runs: segments with the offsets of the anchor in strings that a smaller document may have, and its id."""
    T.release()
    b, lefts = merge_blocks([Block.unpack(x) for x in packed], rules, texts=False)
    shared, right, left, n = b.shared.astype(np.int64), b.right.astype(np.int64), b.left.astype(np.int64), len(b.run)
    order = np.lexsort([left, *_sort_keys(lefts)])
    alike = _common(lefts[order], left[order])
    del lefts
    group = np.empty(n, np.int64)
    open_, start, known = np.zeros(n, bool), np.zeros(n, np.uint8), np.full(n, LAST)
    found: list[tuple] = []
    for offset in range(rules.reach + 2):  # one more, at which all that is open ends
        asked, least = np.zeros(n, bool), np.full(n, LAST)
        own = np.flatnonzero((offset <= left) & (rules.length - offset <= right) & (offset <= rules.reach))
        if len(own):
            group[order] = np.cumsum(alike < offset)
            by, new = _grouped(np.cumsum(shared < rules.length - offset)[own] * (n + 1) + group[own])
            smallest = np.repeat(np.minimum.reduceat(b.least[own][by], new), np.diff(np.concatenate([new, [len(own)]])))
            own = own[by]
            least[own] = smallest
            asked[own] = (smallest < b.least[own]) | (b.several[own] == 1)
        same = open_ & asked & (least == known)
        ended, begun = np.flatnonzero(open_ & ~same), np.flatnonzero(asked & ~same)
        found.append((ended, start[ended].copy(), np.full(len(ended), max(offset - 1, 0), np.uint8), known[ended]))
        start[begun] = offset
        open_, known = asked, least
    row, low, high, least = (np.concatenate(x) for x in zip(*found))
    high[b.split[row] == 1] = SPLIT
    by = np.argsort(b.run[row], kind="stable")
    row, low, high, least = row[by], low[by], high[by], least[by]
    return _parted([b.run[row], b.segment[row], low, high, least], ANSWERS, width)


#: Run, number or hash of a segment, the first and last offset, and the smallest document.
ANSWERS = [RISING, HASHES, BYTES, BYTES, IDS]
#: In place of the last offset: the answer is on one string of a split anchor.
SPLIT = 255


@dataclass
class Answers:
    segment: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray

    @staticmethod
    def unpack(packed: list[bytes]) -> Answers:
        segment, low, high, least = _gathered(packed, ANSWERS)[1:] if packed else (np.zeros(0, k) for k in (U, np.uint8, np.uint8, np.int64))
        order = np.argsort(segment, kind="stable")
        return Answers(segment[order], low[order], high[order], least[order])

    def where(self, mask: np.ndarray) -> Answers:
        return Answers(self.segment[mask], self.low[mask], self.high[mask], self.least[mask])

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place among the hashes and one among the answers."""
        lo, hi = np.searchsorted(self.segment, hashes), np.searchsorted(self.segment, hashes, side="right")
        times = hi - lo
        which = np.repeat(np.arange(len(times)), times)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + lo[which]


def _split_hits(data: np.ndarray, offsets: np.ndarray, answers: Answers, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of strings that answers on split anchors are about, and those answers; most places go by a table of bits."""
    some = np.zeros(1 << 20, bool)
    some[answers.segment >> U(44)] = True
    starts, which = [], []
    for base in range(0, len(data) - size + 1, STEP):
        hashes = T.mix(T.Hasher(data[base : base + STEP + size - 1]).windows(size))
        at = np.flatnonzero(some[hashes >> U(44)])
        at = at[np.searchsorted(offsets, at + base, side="right") == np.searchsorted(offsets, at + base + size - 1, side="right")]
        own, answer = answers.look_up(hashes[at])
        starts.append(at[own] + base)
        which.append(answer)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(which or none)


def _removed(table: pa.Table, packed: list[bytes], rules: RepeatRules, digest: bool) -> pa.Table:
    """Per document: what is left, and the removed ranges; or, as a digest, the hash of what is left."""
    answers = Answers.unpack(packed)
    whole, answers = answers.where(answers.high == SPLIT), answers.where(answers.high != SPLIT)
    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64()}
    types |= {"kept_sha256": pa.string()} if digest else {"kept": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
    out: dict[str, list] = {c: [] for c in types}

    def put(id_: int, text: np.ndarray, covered: np.ndarray) -> None:
        edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        out["doc_id"].append(None if id_ == LAST else int(id_))
        out["n_bytes"].append(len(text))
        out["n_removed"].append(int(covered.sum()))
        out["n_spans"].append(len(edges))
        rest = text[~covered] if len(edges) else text
        if digest:
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
        else:
            out["kept"].append(rest.tobytes())
            out["spans"].append([{"start": int(p), "end": int(q)} for p, q in edges])

    table, copies = _set_apart(table)
    for ids, data, offsets in _rows(copies):
        for id_, x, y in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
            put(id_, data[x:y], np.full(y - x, y - x >= rules.length))
    if len(answers.segment):
        found, *_ = _anchored(table, rules, halves=False)
        answers.segment, anchors = _numbered(found)[answers.segment.astype(np.int64)], iter(found)  # rising, as the numbers are
    for ids, data, offsets in _rows(table):
        change = np.zeros(len(data) + 1, np.int32)
        if len(answers.segment):
            a = next(anchors)
            which, answer = answers.look_up(a.segment)
            use = answers.least[answer] < ids[a.row[which]]
            which, answer = which[use], answer[use]
            np.add.at(change, a.at[which] - answers.high[answer], 1)
            np.add.at(change, a.at[which] - answers.low[answer] + rules.length, -1)
        if len(whole.segment):
            starts, answer = _split_hits(data, offsets, whole, rules.length)
            use = whole.least[answer] < ids[np.searchsorted(offsets, starts, side="right") - 1]
            np.add.at(change, starts[use], 1)
            np.add.at(change, starts[use] + rules.length, -1)
        covered = np.cumsum(change[:-1]) > 0
        for id_, x, y in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
            put(id_, data[x:y], covered[x:y])
    return pa.table({c: pa.array(v, types[c]) for c, v in out.items()})


def _merged(packed: list[bytes], rules: RepeatRules, width: int) -> Entries:
    """The blocks of several sources as one, for smaller groups of ranges."""
    blocks = [Block.unpack(p) for p in packed]
    return (merge_blocks(blocks, rules, texts=True)[0] if len(blocks) > 1 else blocks[0]).parted(width)


# Exchange

#: What a source, or a group of them, has for a group of targets.
PARCEL = "key int, source int, payload binary"


def _parcels(source: int, entries: Entries) -> pa.Table:
    keys, payloads = zip(*entries) if entries else ((), ())
    return pa.table({"key": pa.array(keys, pa.int32()), "source": pa.array([source] * len(keys), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _opened(parcels: pa.Table) -> tuple[list[int], list[bytes]]:
    return parcels.column("source").to_pylist(), parcels.column("payload").to_pylist()


def even_fan(parts: int, most: int) -> int:
    """The least fan with which parts are reached in as few steps as with the most."""
    steps, fan = len(widths(parts, most)), 1
    while fan**steps < parts:
        fan += 1
    return max(fan, 2)


def _sent_on(sent: DataFrame, parts: int, fan: int, join: Callable[[list[bytes], int], Entries]) -> DataFrame:
    """Parcels for single targets from those for groups of them."""

    def step(width: int) -> Callable[[pa.Table], pa.Table]:
        def regroup(parcels: pa.Table) -> pa.Table:
            T.release()
            sources, packed = _opened(parcels)
            return _parcels(sources[0] // fan, join([p for _, p in sorted(zip(sources, packed))], width))

        return regroup

    for width in widths(parts, fan)[1:]:
        sent = sent.groupBy("key", F.floor(F.col("source") / fan)).applyInArrow(step(width), PARCEL)
    return sent


def _dealt(texts: DataFrame, rules: RepeatRules) -> tuple[DataFrame, int]:
    """Texts with their run, and the number of runs.  Equal texts go to one run, or to one for each quarter of a run that they fill."""
    most = rules.run_bytes // 4
    size = F.octet_length("text").cast("long")
    same = texts.groupBy(F.xxhash64("text").alias("same")).agg(F.sum(size).alias("size"), F.sum(size + 64).alias("weight"))
    total, heavy = same.agg(F.coalesce(F.sum("size"), F.lit(0)), F.collect_list(F.when(F.col("weight") > most, F.struct("same", F.ceil(F.col("weight") / most).alias("parts"))))).first()
    runs = max(1, -(-total // rules.run_bytes))
    texts = texts.withColumn("same", F.xxhash64("text"))
    if heavy:
        parts = texts.sparkSession.createDataFrame([tuple(x) for x in heavy], "same long, parts long")
        texts = texts.join(F.broadcast(parts), "same", "left").withColumn("same", F.when(F.col("parts").isNull(), F.col("same")).otherwise(F.xxhash64("same", F.pmod(F.xxhash64("doc_id"), "parts"))))
    return texts.select("doc_id", "text", F.pmod("same", F.lit(runs)).cast("int").alias("run")), runs


def remove_repeats(docs: DataFrame, rules: RepeatRules = RepeatRules(), digest: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary, spans array<struct<start int, end int>>``, a row for each row.

    A byte of a text's UTF-8 is removed if a string of ``length`` bytes that covers it also starts in a document with a
    smaller id.  Strings are judged on the input; overlaps count; none crosses documents.  ``kept`` holds the other bytes,
    ``spans`` the removed ranges in bytes.  A null text is empty, a text shorter than ``length`` stays whole, a null id is
    larger than any other, and rows of equal ids remove nothing from one another.  An empty table gives none; columns other
    than ``doc_id`` and ``text`` are not carried along.  With ``digest``, ``kept_sha256`` stands in place of ``kept`` and
    ``spans``.

    Strings are compared byte by byte in the merge; equal segments within a run are joined by a 64-bit hash of theirs.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts, runs = _dealt(texts, rules)
    fan = even_fan(runs, rules.fan)
    first = widths(runs, fan)[0]
    number = lambda t, name: t.column(name)[0].as_py()

    def fingerprints(t: pa.Table) -> pa.Table:
        return _parcels(number(t, "run"), _fingerprints(t, runs, rules, first))

    def repeated(t: pa.Table) -> pa.Table:
        return _parcels(number(t, "key"), _repeated(*_opened(t), rules, first))

    def suffixes(t: pa.Table, r: pa.Table) -> pa.Table:
        return _parcels(number(t, "run") if t.num_rows else 0, _suffix_runs(t, *_opened(r), runs, rules, first))

    def owners(t: pa.Table) -> pa.Table:
        return _parcels(number(t, "key"), _smallest_owners(_opened(t)[1], rules, first))

    def regrouped(kinds: list[Kind]) -> Callable[[list[bytes], int], Entries]:
        return lambda packed, width: _regrouped(packed, kinds, width)

    prints = _sent_on(texts.groupBy("run").applyInArrow(fingerprints, PARCEL), runs, fan, regrouped(PRINTS))
    known = _sent_on(prints.groupBy("key").applyInArrow(repeated, PARCEL), runs, fan, regrouped(REPLIES))
    coded = _sent_on(texts.groupBy("run").cogroup(known.groupBy("key")).applyInArrow(suffixes, PARCEL), runs, fan, lambda packed, width: _merged(packed, rules, width))
    answers = _sent_on(coded.groupBy("key").applyInArrow(owners, PARCEL), runs, fan, regrouped(ANSWERS))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary, spans array<struct<start:int,end:int>>")
    return texts.groupBy("run").cogroup(answers.groupBy("key")).applyInArrow(lambda t, a: _removed(t, _opened(a)[1], rules, digest), schema)


REPEAT_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, 500 * k AS base, substr(h, 1000 * k + 1, 1098) AS p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1000 + 1)) AS k FROM bytes)),
starts AS (SELECT doc_id, base + i AS i, substr(p, 2 * i + 1, 100) AS s FROM (SELECT doc_id, base, p, unnest(range(0, least(greatest(length(p) // 2 - 49, 0), 500))) AS i FROM pieces)),
least AS (SELECT s, min(doc_id) AS m FROM starts GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM starts JOIN least USING (s) WHERE m < doc_id),
marked AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hits),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM marked GROUP BY ALL),
gaps AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM spans UNION ALL SELECT doc_id, coalesce(max(b), 0), length(any_value(h)) // 2 FROM bytes LEFT JOIN spans USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_spans, 0)::BIGINT AS n_spans, k.kept_sha256
FROM bytes LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) r USING (doc_id)
JOIN (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x))) AS kept_sha256 FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id) k USING (doc_id)
"""
