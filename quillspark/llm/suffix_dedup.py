"""Suffix-array dedup by prefix doubling: passages that an earlier document holds are cut out, byte for byte.

Prefix doubling ranks positions by the strings that start there: pairs of ranks at a growing offset give the ranks of strings
twice as long, and positions whose rank is their own leave, until the threshold. Here ranks are 128-bit hashes, so that a
rank is the same in every task, and the first ranks are those of strings of HALF bytes. Of those only positions are
ranked that some LENGTH-byte window elects (the smallest hash among the window's HALF-byte strings; equal windows elect
equal places, so that no match is missed). Each round shuffles ranks with the smallest id that holds them, reranks, and
sends what it found back to the groups of documents that asked:

1. strings of HALF bytes at elected places; a place whose rank no other document holds leaves,
2. the runs of windows that elected what is left, as one string each: three ranks at offsets HALF apart. Of equal runs all but the
   smallest id's are matched; a run stays only where the rank of its first round goes on in more than one way. Along with them
   strings of HALF and MORE bytes, before and after the place: a window holds one of the two, and leaves with its rank,
3. the windows that stay: pairs of ranks at offset HALF are the ranks of LENGTH bytes, which is the threshold.

Texts lie in groups, bucketed on disk, so that no round shuffles a text; a rank travels once a group, however often the group's
texts hold it. Equal texts count as one. Long texts are worked on in pieces.

Cases: a null text is empty; matches never cross texts; a repeated text is cut whole (if long enough) in all but its
smallest id, rows that repeat an id and a text fare alike; a null id counts as larger than all others; an empty table
gives an empty result. Other columns pass through; n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept are added.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import join_salted, new_path, stored

HALF, MORE, LENGTH = 25, 13, 50
WINDOW = LENGTH - HALF + 1  # strings of HALF bytes in a window
#: Ranks that a task compares at once, bytes of text of a group, bytes of text that are ranked at once.
BUCKET, GROUP, PIECE = 1_000_000, 8_000_000, 1 << 17
#: Files that the groups lie in, and tasks that rank the buckets of a round, at most: each then takes several, one after the other.
FILES = TASKS = 20_000
NO_ID = 2**63 - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


CODES, BASE = mixed(np.arange(1, 257, dtype=np.uint64)), 0x2545F4914F6CDD1D
#: BASE and its inverse modulo 2 to the 64, to the power of each place of a piece.
POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    if not POWERS:
        POWERS.extend(np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE + LENGTH, b, np.uint64)]), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 2**64)))
    return POWERS


def first_ranks(data: np.ndarray) -> np.ndarray:
    """A 64-bit rank of the HALF bytes at each place: the difference of two running sums."""
    (up, down), n = powers(), len(data) - HALF + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[HALF:] - sums[:n]) * down[:n])


def ranks_at(data: np.ndarray, places: np.ndarray, size: int = HALF) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit ranks, by halves, of the strings of so many bytes at some places."""
    words = np.zeros((len(places), -(-size // 8) * 8), np.uint8)
    if len(places):
        words[:, :size] = np.lib.stride_tricks.sliding_window_view(data, size)[places]
    return tuple(paired(np.full(len(places), seed, np.uint64), *words.view("<u8").T) for seed in (1, 2))


def paired(*ranks: np.ndarray) -> np.ndarray:
    """The rank of a tuple of ranks."""
    out = ranks[0]
    for r in ranks[1:]:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + r)
    return out


class Places(NamedTuple):
    """Elected places of a piece, in order: rank, text (its number), place, first and last of the windows that elected it; and the bytes."""

    rank: np.ndarray
    text: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    data: np.ndarray

    def runs(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks, by halves, of the runs of windows of some places."""
        first, end = self.first[some], self.last[some] + LENGTH
        parts = zip(*(ranks_at(self.data, at) for at in (first, first + HALF, end - HALF)), strict=True)
        return tuple(paired(*part, (end - first).astype(np.uint64)) for part in parts)

    def longer(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some places those with a window from MORE bytes before them on, with the ranks of HALF and MORE bytes from there; and those
        with a later window, with the ranks of as many bytes from the place on."""
        before, after = np.flatnonzero(self.first[some] <= self.place[some] - MORE), np.flatnonzero(self.last[some] > self.place[some] - MORE)
        at = self.place[some]
        return before, ranks_at(self.data, at[before] - MORE, HALF + MORE)[0], after, ranks_at(self.data, at[after], HALF + MORE)[1]

    def windows(self, some: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The place (as an index into some), start and ranks, by halves, of each window of some places: of those that start MORE bytes
        before the place or earlier, and of those that start later, where before and after say so."""
        split = self.place[some] - MORE
        low = np.where(before, self.first[some], np.maximum(self.first[some], split + 1))
        counts = np.maximum(0, np.where(after, self.last[some], np.minimum(self.last[some], split)) - low + 1)
        place = np.repeat(np.arange(len(some)), counts)
        start = low[place] + np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
        halves = zip(ranks_at(self.data, start), ranks_at(self.data, start + HALF), strict=True)
        return (place, start, *(paired(*h) for h in halves))


def elected(texts: list[bytes]) -> Places:
    """The elected places of texts, which are laid end to end."""
    data, none = np.frombuffer(b"".join(texts), np.uint8), np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return Places(np.zeros(0, np.uint64), none, none, none, none, data)
    ends = np.cumsum([len(t) for t in texts])
    ranks = first_ranks(data)
    low = (ranks & np.uint64(0xFFFFFFFF80000000)) | np.arange(len(ranks), dtype=np.uint64)
    for width in (1, 2, 4, 8):
        low = np.minimum(low[:-width], low[width:])
    low = np.minimum(low[: -(WINDOW - 16)], low[WINDOW - 16 :])  # of each window; the first of equals
    places = (low & np.uint64(0x7FFFFFFF)).astype(np.int64)
    inside = np.ones(len(places), bool)
    for start, end in zip([0, *ends[:-1]], ends, strict=True):
        inside[max(start, end - LENGTH + 1) : end] = False
    new = inside.copy()
    new[1:] &= (places[1:] != places[:-1]) | ~inside[:-1]
    old = inside.copy()
    old[:-1] &= (places[1:] != places[:-1]) | ~inside[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(old)
    return Places(ranks[places[first]], np.searchsorted(ends, first, "right"), places[first], first, last, data)


class Piece(NamedTuple):
    """Parts of texts that are ranked together: the numbers of their texts in the group, and where each part starts there."""

    parts: list[bytes]
    texts: np.ndarray
    offsets: np.ndarray

    def at(self, places: Places, some: np.ndarray, local: np.ndarray) -> np.ndarray:
        """Places within the piece as places within their texts."""
        starts = np.cumsum([0, *map(len, self.parts)])[:-1]
        return local - starts[places.text[some]] + self.offsets[places.text[some]]


def pieces(group: pa.Table) -> Iterator[Piece]:
    """The texts (column z, compressed) of a group, PIECE bytes or so at a time; parts of a text overlap by a window less one."""
    reader = zstandard.ZstdDecompressor()
    parts, texts, offsets, held = [], [], [], 0
    for i, z in enumerate(z for chunk in group.column("z").chunks for z in chunk):
        text = reader.decompress(z.as_buffer())
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if held + len(part) > PIECE + LENGTH - 1:
                yield Piece(parts, np.array(texts), np.array(offsets))
                parts, texts, offsets, held = [], [], [], 0
            parts.append(part)
            texts.append(i)
            offsets.append(at)
            held += len(part)
    if parts:
        yield Piece(parts, np.array(texts), np.array(offsets))


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column]) if len(column) else np.zeros(0, kind)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), part


def bucket_of(ranks: np.ndarray, buckets: int) -> np.ndarray:
    return (ranks % np.uint64(buckets)).astype(np.int64)


ASKED = "round int, bucket int, grp int, a binary, b binary, c binary"
TOLD = "grp int, round int, a binary, b binary, c binary"


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.int32() if k == "int" else pa.binary()) for n, k, c in zip(names, kinds, columns, strict=True)})


class Ranks(NamedTuple):
    """Distinct ranks (a, b), sorted, each with a number c."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray

    @staticmethod
    def least(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> Ranks:
        """Each (a, b) with its smallest c."""
        order = np.lexsort((c, b, a))
        a, b, c = a[order], b[order], c[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return Ranks(a[new], b[new], c[new])

    def of(self, a: np.ndarray, b: np.ndarray, default: np.ndarray) -> np.ndarray:
        """The numbers of ranks (a, b); default where they aren't here. Two ranks that share a and differ in b are searched on."""
        if not len(self.a):
            return default
        at = np.searchsorted(self.a, a)
        out = default.copy()
        todo = np.arange(len(a))
        while len(todo):
            todo = todo[at[todo] < len(self.a)]
            todo = todo[self.a[at[todo]] == a[todo]]
            hit = self.b[at[todo]] == b[todo]
            out[todo[hit]] = self.c[at[todo[hit]]]
            todo = todo[~hit]
            at[todo] += 1
        return out


def extremes(rank: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct rank with its smallest and its largest value."""
    order = np.lexsort((value, rank))
    rank, value = rank[order], value[order]
    edge = np.concatenate([[True], rank[1:] != rank[:-1], [True]]) if len(rank) else np.zeros(1, bool)
    return rank[edge[:-1]], value[edge[:-1]], value[edge[1:]]


def ask_first(group: pa.Table, grp: int, buckets: int) -> list[tuple]:
    """Round 1: the group's first ranks, and whether two ids hold them here."""
    ids, kept = group.column("id").to_numpy(), []
    for piece in pieces(group):
        places = elected(piece.parts)
        rank, low, high = extremes(places.rank, ids[piece.texts[places.text]])
        kept += [(rank, low), (rank[low != high], high[low != high])]
    if not kept:
        return []
    rank, low, high = extremes(*(np.concatenate(x) for x in zip(*kept, strict=True)))
    return filtered(1, grp, buckets, rank, low != high)


def filtered(round_: int, grp: int, buckets: int, rank: np.ndarray, many: np.ndarray) -> list[tuple]:
    """32 bits of each rank, and whether two ids hold it here."""
    return [(round_, b, grp, blob((rank[at] >> np.uint64(32)).astype(np.uint32)), blob(many[at]), b"") for b, at in by_bucket(bucket_of(rank, buckets))]


def tell_shared(round_: int, bucket: int, rows: pa.Table) -> list[tuple]:
    """Of 32 bits of each rank in a bucket those that two groups hold, or two ids of one group. Other ranks may share the bits: a place
    too many stays."""
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("a")]
    every = np.sort(np.concatenate([*keys, *(k[np.frombuffer(m.as_buffer(), bool)] for k, m in zip(keys, rows.column("b"), strict=True))]))
    shared = every[1:][every[1:] == every[:-1]]
    out = []
    for g, k in zip(rows.column("grp").to_pylist(), keys, strict=True):
        at = np.searchsorted(shared, k)
        at[at == len(shared)] = 0
        mine = k[shared[at] == k] if len(shared) else k[:0]
        if len(mine):
            out.append((g, round_, bucket.to_bytes(8, "little"), blob(mine), b""))
    return out


class Filter:
    """Ranks that others hold too, by 32 of their bits and their buckets."""

    def __init__(self, told: pa.Table, buckets: int):
        self.buckets, parts = buckets, zip(told.column("a"), told.column("b"), strict=True)
        keys = [np.frombuffer(b.as_buffer(), np.uint32).astype(np.uint64) * np.uint64(buckets) + np.uint64(int.from_bytes(a.as_py(), "little")) for a, b in parts]
        self.keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)

    def holds(self, rank: np.ndarray) -> np.ndarray:
        return among(self.keys, (rank >> np.uint64(32)) * np.uint64(self.buckets) + rank % np.uint64(self.buckets))


def among(some: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is one of some, which are sorted."""
    if not len(some):
        return np.zeros(len(values), bool)
    at = np.searchsorted(some, values)
    at[at == len(some)] = 0
    return some[at] == values


class Survivors:
    """What the rounds have told a group."""

    def __init__(self, told: pa.Table, buckets: int):
        part = {r: told.filter(pa.compute.equal(told.column("round"), r)) for r in (1, 2, 3, 4, 5)}
        self.shared, self.longer = Filter(part[1], buckets), Filter(part[4], buckets)
        self.runs, self.windows = (Ranks.least(*(joined(part[r].column(c), t) for c, t in (("a", np.uint64), ("b", np.uint64), ("c", np.int64)))) for r in (2, 5))
        self.open = np.sort(joined(part[3].column("a"), np.uint64))


class Group:
    """The places of a group's texts that stay after round 1; kept at hand unless the group holds an unusually long text."""

    def __init__(self, group: pa.Table, told: Survivors):
        self.table, self.told, self.ids = group, told, group.column("id").to_numpy()
        self.known: list | None = None

    def small(self) -> bool:
        """Whether what is made of the group may be kept."""
        return self.table.column("z").nbytes <= GROUP

    def each(self) -> Iterator[tuple[Piece, Places, np.ndarray]]:
        """Each piece with its places and the indexes of those that stay."""
        if self.known is None and self.small():
            self.known = list(self.made())
        yield from self.known if self.known is not None else self.made()

    def made(self) -> Iterator[tuple[Piece, Places, np.ndarray]]:
        for piece in pieces(self.table) if len(self.told.shared.keys) else ():
            places = elected(piece.parts)
            yield piece, places, np.flatnonzero(self.told.shared.holds(places.rank))

    def owner(self, piece: Piece, places: Places, some: np.ndarray) -> np.ndarray:
        return self.ids[piece.texts[places.text[some]]]


def ask_runs(group: Group, grp: int, buckets: int) -> list[tuple]:
    """Round 2: the ranks of runs with their smallest ids here; as round 3, of each first rank the smallest and largest of its runs; and as
    round 4 the ranks of longer strings at the places."""
    runs, ways, longer = [], [], []
    for piece, places, some in group.each():
        a, b = places.runs(some)
        own = group.owner(piece, places, some)
        runs.append(Ranks.least(a, b, own))
        ways.append((places.rank[some], a))
        before, left, after, right = places.longer(some)
        longer += [(left, own[before]), (right, own[after])]
    if not runs:
        return []
    least = Ranks.least(*(np.concatenate(x) for x in zip(*runs, strict=True)))
    every = extremes(*(np.concatenate(x) for x in zip(*ways, strict=True)))
    rank, low, high = extremes(*(np.concatenate(x) for x in zip(*longer, strict=True)))
    out = [(n, x, grp, *(blob(c[at]) for c in columns)) for n, columns in ((2, least), (3, every)) for x, at in by_bucket(bucket_of(columns[0], buckets))]
    return out + filtered(4, grp, buckets, rank, low != high)


def owned(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b, c = joined(rows.column("a"), np.uint64), joined(rows.column("b"), np.uint64), joined(rows.column("c"), np.int64)
    return a, b, c, np.repeat(np.arange(len(rows)), [len(x.as_buffer()) // 8 for x in rows.column("a")])


def tell_least(round_: int, rows: pa.Table) -> list[tuple]:
    """To each group the ranks that a smaller id of another group holds, with that id."""
    a, b, c, row = owned(rows)
    least = Ranks.least(a, b, c).of(a, b, c)
    out = []
    for r, g in enumerate(rows.column("grp").to_pylist()):
        lo, hi = np.searchsorted(row, [r, r + 1])
        mine = lo + np.flatnonzero(least[lo:hi] < c[lo:hi])
        if len(mine):
            out.append((g, round_, blob(a[mine]), blob(b[mine]), blob(least[mine])))
    return out


def tell_open(rows: pa.Table) -> list[tuple]:
    """To each group those of its first ranks that have more than one run."""
    a, low, high, row = owned(rows)
    high = high.view(np.uint64)
    order = np.argsort(a, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(a[order]) != 0])) if len(a) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(a)]]))
    several = np.zeros(len(a), bool)
    if len(a):
        several[order] = np.repeat(np.minimum.reduceat(low[order], starts) != np.maximum.reduceat(high[order], starts), sizes)
    out = []
    for r, g in enumerate(rows.column("grp").to_pylist()):
        lo, hi = np.searchsorted(row, [r, r + 1])
        mine = a[lo:hi][several[lo:hi]]
        if len(mine):
            out.append((g, 3, blob(mine), b"", b""))
    return out


def settled(group: Group) -> Iterator[tuple[Piece, Places, np.ndarray, np.ndarray]]:
    """For each piece the places whose runs are matched as a whole, and those whose first rank goes on in several ways."""
    found = [(*places.runs(some), group.owner(piece, places, some)) for piece, places, some in group.each()]
    if not found:
        return
    here = Ranks.least(*(np.concatenate(x) for x in zip(*found, strict=True)))
    here = here._replace(c=np.minimum(here.c, group.told.runs.of(here.a, here.b, here.c)))
    for (piece, places, some), (a, b, own) in zip(group.each(), found, strict=True):
        whole = own > here.of(a, b, own)
        yield piece, places, some[whole], some[~whole & among(group.told.open, places.rank[some])]


def open_windows(group: Group, places: Places, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places.windows of those windows whose longer strings others hold."""
    before, left, after, right = places.longer(some)
    sides = np.zeros((2, len(some)), bool)
    sides[0, before], sides[1, after] = group.told.longer.holds(left), group.told.longer.holds(right)
    return places.windows(some, *sides)


def window_ranks(group: Group, pieces_left: list) -> Ranks:
    """The windows that are open in a group, with their smallest ids here."""
    kept = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for piece, places, _, left in pieces_left:
        place, _, a, b = open_windows(group, places, left)
        kept.append(Ranks.least(a, b, group.owner(piece, places, left)[place]))
    return Ranks.least(*(np.concatenate(x) for x in zip(*kept, strict=True)))


def ask_windows(group: Group, grp: int, buckets: int) -> list[tuple]:
    """Round 5: the ranks of windows with their smallest ids here."""
    windows = window_ranks(group, settled(group))
    return [(5, x, grp, *(blob(c[at]) for c in windows)) for x, at in by_bucket(bucket_of(windows.a, buckets))]


def spans_of(group: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matched spans (text, start, end) of a group's texts, apart from each other and in order."""
    found, again = [], list(settled(group)) if group.small() else None
    here = window_ranks(group, again if again is not None else settled(group))
    here = here._replace(c=np.minimum(here.c, group.told.windows.of(here.a, here.b, here.c)))
    for piece, places, gone, left in again if again is not None else settled(group):
        place, start, a, b = open_windows(group, places, left)
        own = group.owner(piece, places, left)[place]
        lost = own > here.of(a, b, own)
        left, start = left[place[lost]], start[lost]
        first = np.concatenate([piece.at(places, gone, places.first[gone]), piece.at(places, left, start)])
        size = np.concatenate([places.last[gone] - places.first[gone], np.zeros(len(left), np.int64)]) + LENGTH
        found.append(merged(np.concatenate([piece.texts[places.text[gone]], piece.texts[places.text[left]]]), first, first + size))
    none = np.zeros(0, np.int64)
    return merged(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (none, none, none)


def merged(text: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch made one."""
    if not len(text):
        return text, first, end
    order = np.lexsort((first, text))
    text, first, end = text[order], first[order], end[order]
    far = int(end.max()) + 1  # texts laid apart
    reach = np.maximum.accumulate(end + text * far)
    new = np.concatenate([[True], (first + text * far)[1:] > reach[:-1]])
    starts = np.flatnonzero(new)
    return text[new], first[new], reach[np.concatenate([starts[1:], [len(text)]]) - 1] - text[new] * far


def cut(group: pa.Table, told: Survivors, with_text: bool) -> pa.Table:
    """h1, h2, n_removed, n_spans, kept_sha256 (and kept, if asked for) of each text of a group."""
    texts, first, end = spans_of(Group(group, told))
    reader, out = zstandard.ZstdDecompressor(), []
    lows, highs = (np.searchsorted(texts, np.arange(len(group)), side) for side in ("left", "right"))
    for i, z in enumerate(z for chunk in group.column("z").chunks for z in chunk):
        text, kept, at = reader.decompress(z.as_buffer()), [], 0
        spans = range(int(lows[i]), int(highs[i]))
        for k in spans:
            kept.append(text[at : first[k]])
            at = int(end[k])
        kept = b"".join([*kept, text[at:]])
        out.append((len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    kinds = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    return pa.table({c: group.column(c) for c in ("h1", "h2")} | {c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate(kinds.items())})


def bucketed(texts: DataFrame, files: int) -> tuple[DataFrame, str]:
    """texts in a table of so many files by grp, in the shared folder, and its name: grouping them by grp needs no shuffle."""
    spark, name = texts.sparkSession, f"quillspark_texts_{uuid.uuid4().hex}"
    texts.repartition(files, "grp").write.bucketBy(files, "grp").sortBy("grp").option("path", new_path(spark, "text-groups")).saveAsTable(name)
    return spark.table(name), name


def told_by(asked: DataFrame, buckets: int, name: str) -> DataFrame:
    """What each round's buckets tell the groups. A task has about one bucket, up to 10,000 of them, and holds one at a time beyond."""

    def rank(key: tuple, rows: pa.Table) -> pa.Table:
        round_, bucket = key[0].as_py(), key[1].as_py()
        return table_of(tell_shared(round_, bucket, rows) if round_ in (1, 4) else tell_open(rows) if round_ == 3 else tell_least(round_, rows), TOLD)

    return stored(asked.repartition(min(2 * buckets, TASKS), "round", "bucket").groupBy("round", "bucket").applyInArrow(rank, TOLD), name)


def passages(texts: DataFrame, buckets: int, with_text: bool) -> DataFrame:
    """h1, h2, n_removed, n_spans, kept_sha256 and kept of texts (id, h1, h2, grp, z)."""
    by_group = texts.groupBy("grp")

    def asked(ask, told: DataFrame) -> DataFrame:
        def run(key: tuple, group: pa.Table, told: pa.Table) -> pa.Table:
            return table_of(ask(Group(group, Survivors(told, buckets)), key[0].as_py(), buckets), ASKED)

        return by_group.cogroup(told.groupBy("grp")).applyInArrow(run, ASKED)

    told = told_by(by_group.applyInArrow(lambda key, group: table_of(ask_first(group, key[0].as_py(), buckets), ASKED), ASKED), buckets, "first-ranks")
    told = told.unionByName(told_by(asked(ask_runs, told), buckets, "run-ranks"))
    told = told.unionByName(told_by(asked(ask_windows, told), buckets, "window-ranks"))
    kept = "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return by_group.cogroup(told.groupBy("grp")).applyInArrow(lambda group, told: cut(group, Survivors(told, buckets), with_text), kept)


def text_keys(text: Column) -> dict[str, Column]:
    return {"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)}


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes).

    Each byte goes that a LENGTH-byte string covers which also starts in a document with a smaller id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    short = F.when(F.octet_length(text) < LENGTH, F.sha2(text.cast("binary"), 256))
    rows = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "n_bytes": F.octet_length(text).cast("long"), "__short": short, **text_keys(text)})
    if with_text:
        rows = rows.withColumn("__raw", text.cast("binary"))
    same = ["__h1", "__h2"]
    firsts = stored(rows.groupBy(*same).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"), F.first("n_bytes").alias("size")), "first-ids")
    total = firsts.agg(F.sum("size")).first()[0] or 0
    groups, buckets = 1 + total // GROUP, 1 + int(total * 2 / (WINDOW + 1)) // BUCKET

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = pa.array([writer.compress((x.as_py() or "").encode()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], z], names=["id", "h1", "h2", "z"])

    # One text of each group of copies: the smallest id's; rows that repeat it meet in its group.
    pressed = rows.select(F.col("__id").alias("id"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), text.alias("text")).mapInArrow(press, "id long, h1 long, h2 long, z binary")
    own = (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")) & (F.col("id") == F.col("__first"))
    texts = pressed.join(firsts, own).select("id", "h1", "h2", F.pmod(F.xxhash64("h1", "h2", F.lit(2)), F.lit(groups)).cast("int").alias("grp"), "z")
    table, name = bucketed(texts, min(FILES, 1 + groups // 2))
    results = passages(table, buckets, with_text)
    few = stored(results.dropDuplicates(["h1", "h2"]).withColumnsRenamed({"h1": "__h1", "h2": "__h2"}).join(firsts.drop("size"), same), "cut-texts")
    docs.sparkSession.sql(f"DROP TABLE {name}")  # nothing reads it any more
    out = join_salted(rows, few, same, ["__id"])
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    own, lost = F.col("__id") == F.col("__first"), F.col("n_bytes") >= LENGTH
    return out.withColumns(
        {
            "n_removed": F.when(own, F.col("n_removed")).when(lost, F.col("n_bytes")).otherwise(0),
            "n_spans": F.when(own, F.col("n_spans")).when(lost, 1).otherwise(0).cast("long"),
            "kept_sha256": F.when(own, F.col("kept_sha256")).when(lost, empty).otherwise(F.col("__short")),
        }
        | ({"kept": F.when(own, F.col("kept")).when(lost, F.lit(b"")).otherwise(F.col("__raw"))} if with_text else {})
    ).drop("__id", "__h1", "__h2", "__first", "__short", "__raw", *([] if with_text else ["kept"]))


def digests(docs: DataFrame) -> DataFrame:
    out = cut_passages(docs.select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
