"""Packing of tokenised documents into sequences of fixed length.

Tokenising maps each document to pieces of at most the sequence length.  The pieces are dealt to
groups by a hash; within a group a best-fit start is improved by local search: moves, and exchanges of
one for one, one for two and two for one piece between underfull bins that increase the sum of squared
fills, until none is left.  Groups have about GROUP pieces whatever the input, so a task's
memory is bounded and a group costs about one unfilled sequence in a few thousand.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import each_copy, stored
from .token_count import PATTERN, SHORT, byte_letters, counter

GROUP = 4096
REMEMBERED = 300_000  # parts whose identifiers a worker keeps


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level BPE file; identifiers follow the ranks of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = {letter: b for b, letter in enumerate(byte_letters())}
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


class Identifiers(dict):
    """Identifiers of split parts, as little-endian bytes.  Texts are split as token_count splits them; a short part goes to the
    tiktoken library, a longer one, of any length, to the merger of token_count."""

    def __init__(self, path: str):
        self.counter, self.short = counter(path), encoding(path).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        if len(part) > SHORT:
            return np.array(self.counter.identifiers(part), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[part] = ids = np.array(self.short(part), "<u4").tobytes()
        return ids

    def of(self, text: str) -> np.ndarray:
        split, found, at = self.counter.split, [], 0
        for m in self.counter.added.finditer(text) if self.counter.added else ():
            found += map(self.__getitem__, split(text[at : m.start()]))
            found.append(np.array([self.counter.added_ids[m[0]]], "<u4").tobytes())
            at = m.end()
        found += map(self.__getitem__, split(text[at:] if at else text))
        return np.frombuffer(b"".join(found), "<u4")


@lru_cache(maxsize=2)
def identifiers(path: str) -> Identifiers:
    """A worker's identifiers, which keep what they have looked up."""
    return Identifiers(path)


def _pieces(path: str, length: int, end: int, keys: int):
    def run(batches):
        encode = identifiers(path).of
        for batch in batches:
            rows = [[] for _ in range(5)]
            for i, text in enumerate(batch.column(keys)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % length or length
                at = 0
                for piece in range(1 + (len(ids) - first) // length):
                    to = first if piece == 0 else at + length
                    for column, value in zip(rows, (i, piece, at, to - at, zlib.crc32(ids[at:to].tobytes())), strict=True):
                        column.append(value)
                    at = to
            of = pa.array(rows[0], pa.int64())
            arrays = [batch.column(k).take(of) for k in range(keys)]
            arrays += [pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])]
            yield pa.RecordBatch.from_arrays(arrays, [*(f"key{k}" for k in range(keys)), "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that takes it."""
    bins, by_room, open_rooms = [], [[] for _ in range(capacity + 1)], 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = open_rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        room -= size
        if room:
            by_room[room].append(b)
            open_rooms |= 1 << room
    return bins


def improve(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search between underfull bins, until a pass over them changes nothing.

    Each step makes a bin at least as full as its partner fuller. The sum of squared fills rises with it, so the search ends."""
    full = [b for b in bins if b and sizes[b].sum() >= capacity]
    under = [b for b in bins if b and sizes[b].sum() < capacity]
    if not under:
        return full
    of = np.concatenate(under)  # full bins take no part, so items and bins are numbered anew without them
    ends = np.cumsum([len(b) for b in under])
    search = Search(sizes[of].astype(np.int64), [list(range(e - len(b), e)) for b, e in zip(under, ends.tolist(), strict=True)], capacity)
    while search.step_all():
        pass
    return full + [[int(of[i]) for i in b] for b in search.bins if b]


class Search:
    """Bins that were underfull, with an index of the sums of their pairs."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.bins, self.capacity = sizes, bins, capacity
        self.fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
        self.where = np.empty(len(sizes), np.int64)
        self.at = np.arange(len(bins))
        self.next_sum = np.empty((len(bins), capacity + 1), np.int32)  # the least sum of two items of the bin from a number on
        for b, held in enumerate(bins):
            self.where[held] = b
            self.index(b)

    def sums(self, b: int) -> np.ndarray:
        """The distinct sums of two of the bin's items."""
        own, times = np.unique(self.sizes[self.bins[b]], return_counts=True)
        both = np.add.outer(own, own)[np.triu_indices(len(own), 1)]
        return np.unique(np.concatenate((both, 2 * own[times > 1])))

    def index(self, b: int) -> None:
        found = self.sums(b)
        row = self.next_sum[b]
        row[:] = self.capacity + 1
        row[found] = found
        row[:] = np.minimum.accumulate(row[::-1])[::-1]

    def pair(self, b: int, total: int) -> tuple[int, int]:
        """Two items of the bin whose sizes make total."""
        seen: dict[int, int] = {}
        for y in self.bins[b]:
            if (z := seen.get(total - int(self.sizes[y]))) is not None:
                return z, y
            seen[int(self.sizes[y])] = y
        raise KeyError(total)

    def put(self, s: int, d: int, there: tuple[int, ...], back: tuple[int, ...] = ()) -> None:
        for item in there:
            _put(item, s, d, self.bins, self.fill, self.where, self.sizes)
        for item in back:
            _put(item, d, s, self.bins, self.fill, self.where, self.sizes)
        self.index(s)
        self.index(d)

    def able(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        room = self.capacity - self.fill
        able = (room > 0) & (self.fill >= self.fill[s]) & (self.fill > 0)
        able[s] = False
        return able, room

    def step_all(self) -> bool:
        """A pass, the least filled bins first; whether it changed anything."""
        changed = False
        open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        for s in open_[np.argsort(self.fill[open_], kind="stable")].tolist():
            for x in sorted(self.bins[s], key=lambda i: -self.sizes[i]):
                changed |= self.one(s, x)
            while self.two(s):
                changed = True
        return changed

    def one(self, s: int, x: int) -> bool:
        """Moves x out of s, or exchanges it for one or two smaller items of another bin."""
        able, room = self.able(s)
        size = int(self.sizes[x])
        fits = np.flatnonzero(able & (room >= size))
        if len(fits):
            self.put(s, int(fits[np.argmin(room[fits])]), (x,))
            return True
        gain = size - self.sizes
        items = np.flatnonzero(able[self.where] & (gain > 0) & (gain <= room[self.where]))
        if len(items):
            y = int(items[np.argmax(gain[items])])
            self.put(s, int(self.where[y]), (x,), (y,))
            return True
        total = self.next_sum[self.at, np.maximum(size - room, 0)]
        bins = np.flatnonzero(able & (total < size))
        if len(bins):
            d = int(bins[np.argmin(total[bins])])
            self.put(s, d, (x,), self.pair(d, int(total[d])))
            return True
        return False

    def two(self, s: int) -> bool:
        """Exchanges two items of s for one of another bin that is smaller than both together."""
        found = self.sums(s)
        able, room = self.able(s)
        items = np.flatnonzero(able[self.where])
        if not len(found) or not len(items):
            return False
        items = items[np.lexsort((items, -room[self.where[items]], self.sizes[items]))]
        items = items[np.unique(self.sizes[items], return_index=True)[1]]  # of each size the one in the emptiest bin
        gain = found[:, None] - self.sizes[items][None, :]
        gain[gain > room[self.where[items]][None, :]] = 0
        best = int(np.argmax(gain))
        k, n = divmod(best, len(items))
        if gain[k, n] <= 0:
            return False
        y = int(items[n])
        self.put(s, int(self.where[y]), self.pair(s, int(found[k])), (y,))
        return True


def _put(item, source, target, bins, fill, where, sizes) -> None:
    bins[source].remove(item)
    bins[target].append(item)
    fill[source] -= sizes[item]
    fill[target] += sizes[item]
    where[item] = target


def _packed(length: int, keys: int, names: list[str]):
    def run(key, table):
        group = key[0].as_py()
        order = [(name, "ascending") for name in table.column_names[1:]]
        table = table.sort_by(order).combine_chunks()  # the same whatever order the rows came in
        sizes = table.column("length").to_numpy().astype(np.int64)
        bins = improve(sizes, best_fit(sizes, length), length)
        sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for b, held in enumerate(bins):
            at = 0
            for i in held:
                sequence[i], offset[i] = (group << 24) + b, at
                at += int(sizes[i])
        columns = table.columns[1:] + [pa.array(sequence), pa.array(offset)]
        return pa.Table.from_arrays(columns, names=[*names, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed_pieces(documents: DataFrame, vocabulary: str, length: int = 1024, end: int = 2, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The pieces of all rows with their places: keys, piece, start, length, ids_crc32, sequence_id and offset.

    A row's identifiers are those of its text and then end; only rows longer than a sequence are
    cut, into pieces of a whole sequence after a first one that may be shorter.  A null or
    empty text is end alone.  Every row is packed, repeated ones each by itself; equal lengths are
    dealt in the order of keys, so reruns agree.  keys are long columns that are carried along, other columns are
    ignored.  An empty table gives an empty result.
    """
    docs = documents.select(*(F.col(k).cast("long").alias(f"key{n}") for n, k in enumerate(keys)), F.col("text").cast("string").alias("text"))
    held = ", ".join(f"key{n} long" for n in range(len(keys)))
    shape = "piece int, start long, length long, ids_crc32 long"
    pieces = stored(docs.mapInArrow(_pieces(vocabulary, length, end, len(keys)), f"{held}, {shape}"), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    # Equal pieces are counted and numbered, so that a key of many rows is dealt to all groups.
    dealt = each_copy(pieces, "copy").select(F.pmod(F.xxhash64(*pieces.columns, "copy"), F.lit(groups)).alias("attestry_group"), *pieces.columns)
    names = ", ".join(f"`{k}` long" for k in keys)
    return dealt.groupBy("attestry_group").applyInArrow(_packed(length, len(keys), list(keys)), f"{names}, {shape}, sequence_id long, offset long")
