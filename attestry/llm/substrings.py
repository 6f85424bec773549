"""Removal of word sequences that occur elsewhere, found by recompression.

Recompression shrinks a sequence of symbols in rounds.  A block round names each run of an equal
symbol, a pair round names each neighbouring pair whose left symbol falls into one half of the
alphabet and whose right symbol into the other.  A name is a fingerprint of what it stands for
and the halves are drawn from the name and the round, so all Spark tasks give equal substrings
the same interior symbols without exchanging a dictionary.  Each symbol also carries the interval
of words that decided it: a window that holds this interval holds the symbol wherever it occurs.

Every window of the text picks one symbol by its content alone (the highest round whose deciding
interval it holds, then the least hashed name, then the leftmost).  Equal windows pick equal
symbols with equal deciding intervals, so only those that occur again can stand for a repeat;
names only propose.  What they propose is settled by the words themselves, as 128-bit BLAKE2 digests of
the words joined by spaces: first of the whole range of windows that picked the symbol, then,
where such ranges differ, window by window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SLICE_BYTES, U64, column, fresh, mapped, mix64, parts, powers, signed, slices, stored, word_hashes, word_spans

ROUNDS = 4
RUN_ROUNDS = {0, 2}
LONGEST = 8  # a symbol of more words isn't paired further
SHIFT = 30  # places are packed as the first window << SHIFT | windows after it; no text has 2 ** SHIFT words
_ROLL = 0x5851F42D4C957F2D
_UNROLL = pow(_ROLL, -1, 1 << 64)


class Ranges:
    """Hashes of word ranges by prefix sums, which name symbols but prove nothing."""

    def __init__(self, words: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(words * powers(_ROLL, len(words)), dtype=U64)))
        self.back = powers(_UNROLL, len(words) + 1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(U64) * U64(0x9E3779B97F4A7C15))


class Words:
    """The words of texts with one space behind each, and digests of ranges of them."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        sizes = ends - starts + 1
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        parts, lo = [], 0
        while lo < len(starts):  # a very long text goes through in blocks of words
            hi = max(lo + 1, int(np.searchsorted(self.at, self.at[lo] + SLICE_BYTES)) - 1)
            at = self.at[lo : hi + 1] - self.at[lo]
            out = data[np.minimum(np.repeat(starts[lo:hi] - at[:-1], sizes[lo:hi]) + np.arange(at[-1]), len(data) - 1)]
            out[at[1:] - 1] = 32
            parts.append(out.tobytes())
            lo = hi
        self.text = b"".join(parts)

    def digests(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two 64-bit halves of a digest for each range of words a to b."""
        text, of = memoryview(self.text), hashlib.blake2b
        out = b"".join([of(text[x:y], digest_size=16).digest() for x, y in zip(self.at[a].tolist(), self.at[b].tolist(), strict=True)])
        return np.frombuffer(out, np.int64).reshape(-1, 2)


def symbol_levels(words: np.ndarray, row: np.ndarray):
    """(name, first word, end, deciding interval's first word, its end) of the symbols, round after round.

    row: the text of each word; symbols never cross texts.  The edge of a text decides too, which
    no window can hold, so there an interval reaches one word over the edge.  Starts and ends of
    the intervals never decrease from symbol to symbol.
    """
    place = np.arange(len(words))
    name, s, e, ds, de, of = words, place, place + 1, place, place + 1, row
    yield name, s, e, ds, de
    for k in range(ROUNDS):
        m = len(name)
        next_here = np.append(of[1:] == of[:-1], False)  # the next symbol is of the same text
        last_here = np.insert(next_here[:-1], 0, False)
        left = np.where(last_here, np.insert(ds[:-1], 0, 0), s - 1)  # start of what decides it with the symbol before it
        right = np.where(next_here, np.append(de[1:], 0), e + 1)
        if k in RUN_ROUNDS:
            first = np.insert((name[1:] != name[:-1]) | ~next_here[:-1], 0, True)
            at = np.flatnonzero(first)
            end = np.append(at[1:], m) - 1
            count = (end - at + 1).astype(U64)
            name = np.where(count > 1, mix64(name[at] + count * U64(0xC2B2AE3D27D4EB4F)), name[at])
            s, e, ds, de, of = s[at], e[end], left[at], right[end], of[at]
            yield name, s, e, ds, de
            m = len(name)
            next_here = np.append(of[1:] == of[:-1], False)
            last_here = np.insert(next_here[:-1], 0, False)
            left = np.where(last_here, np.insert(ds[:-1], 0, 0), s - 1)
            right = np.where(next_here, np.append(de[1:], 0), e + 1)
        short = e - s <= LONGEST
        half = (mix64(name + U64((k + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1)) >> U64(63)).astype(bool)
        opens, closes = short & ~half, short & half
        pair = opens & np.append(closes[1:], False) & next_here
        second = np.insert(pair[:-1], 0, False)
        # a symbol that opens looks at the next one, one that closes at the last one
        ds = np.where(closes & ~second, left, ds)
        de = np.where(opens, right, de)
        after = np.append(name[1:], U64(0))
        name = np.where(pair, mix64(name * U64(0xFF51AFD7ED558CCD) + after * U64(0xC4CEB9FE1A85EC53) + U64(1)), name)
        e = np.where(pair, np.append(e[1:], 0), e)
        keep = ~second
        name, s, e, ds, de, of = name[keep], s[keep], e[keep], ds[keep], de[keep], of[keep]
        yield name, s, e, ds, de


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the least of values[a:b] for each a < b, the first where equal."""
    best = np.arange(len(values))
    tables, width = [best], 1
    longest = int((b - a).max())
    while width * 2 <= longest:
        x, y = best[: len(best) - width], best[width:]
        best = np.where(values[y] < values[x], y, x)
        tables.append(best)
        width *= 2
    depth = np.floor(np.log2(b - a)).astype(np.int64)
    out = np.empty(len(a), np.int64)
    for d, table in enumerate(tables):
        at = np.flatnonzero(depth == d)
        x, y = table[a[at]], table[b[at] - (1 << d)]
        out[at] = np.where(values[y] < values[x], y, x)
    return out


def picks(words: np.ndarray, rows: np.ndarray, window: int, ranges: Ranges):
    """(name with its deciding interval, range's first window, its last window) for the symbols that windows pick.

    rows: where each text's words begin, with the end; windows are named by their first word."""
    lengths = np.diff(rows)
    row = np.repeat(np.arange(len(lengths)), lengths)
    n = len(words)
    valid = np.zeros(n, bool)
    if n >= window:
        valid[: n - window + 1] = row[: n - window + 1] == row[window - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return None
    chosen, place = np.zeros(n, U64), np.full(n, -1, np.int64)
    for level, (name, s, e, ds, de) in reversed(list(enumerate(symbol_levels(words, row)))):
        a = np.searchsorted(ds, at, side="left")
        b = np.searchsorted(de, at + window, side="right")
        seen = np.flatnonzero(b > a)
        if len(seen):
            rank = mix64(name + U64(0x1B873593))
            got = _least(rank, a[seen], b[seen])
            chosen[at[seen]] = mix64(ranges(ds[got], de[got]) + name[got] + U64(level + 1))
            place[at[seen]] = s[got] * (2 * ROUNDS + 2) + level
            left = np.ones(len(at), bool)
            left[seen] = False
            at = at[left]
        if not len(at):
            break
    at = np.flatnonzero(valid)
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = at[new]
    last = at[np.concatenate((np.flatnonzero(new)[1:], [len(at)])) - 1]
    return chosen[first], first, last


def _places(row: np.ndarray, name: np.ndarray, content: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Ranges of equal texts, names and contents as one: (index of the first, ranges, list offsets, packed places).

    A text that repeats itself, above all one with a period, has many such ranges; neighbouring
    ones become one place.  The lists of ranges that stand alone in their text are empty.
    """
    order = np.lexsort((first, content[:, 1], content[:, 0], name, row))
    r, n, c, f, l = row[order], name[order], content[order], first[order], last[order]
    new = np.insert((r[1:] != r[:-1]) | (n[1:] != n[:-1]) | (c[1:] != c[:-1]).any(axis=1), 0, True)
    heads = np.flatnonzero(new)
    copies = np.diff(np.append(heads, len(order)))
    begins = new.copy()
    begins[1:] |= f[1:] != l[:-1] + 1
    starts = np.flatnonzero(begins)
    size = l[np.append(starts[1:], len(order)) - 1] - f[starts]
    several = np.repeat(copies > 1, copies)[starts]
    starts, size = starts[several], size[several]
    offsets = np.searchsorted(starts, np.append(heads, len(order)))
    return order[heads], copies, offsets, f[starts] << SHIFT | size


def _names(window: int):
    """How often the windows of texts picked each name."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                starts, ends, rows = word_spans(data, offsets)
                words = word_hashes(data, starts, ends)
                found = picks(words, rows, window, Ranges(words))
                if found is not None:
                    name, n = np.unique(found[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(n)], ["name", "n"])

    return run


SYMBOLS = "name long, c1 long, c2 long, k1 long, k2 long, at long, copies long, places array<long>"


def _symbols(window: int):
    """A row of SYMBOLS for each name and content of a text."""

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, data, offsets in slices(batch.column(2)):
                starts, ends, rows = word_spans(data, offsets)
                words = word_hashes(data, starts, ends)
                found = picks(words, rows, window, Ranges(words))
                if found is None:
                    continue
                name, first, last = found
                content = Words(data, starts, ends).digests(first, last + window)
                row = np.searchsorted(rows, first, side="right") - 1
                first, last = first - rows[row], last - rows[row]
                one, copies, offsets, places = _places(row, name, content, first, last)
                first, last = first[one], last[one]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int64()), mask=pa.array(copies == 1))
                of = lo + row[one]
                columns = (signed(name[one]), content[one, 0], content[one, 1], k1[of], k2[of], first << SHIFT | (last - first), copies)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], [x.split()[0] for x in SYMBOLS.split(", ")])

    return run


WINDOWS = "name long, w1 long, w2 long, k1 long, k2 long, begin long, copies long"


def _windows(window: int):
    """A row of WINDOWS for each window of the ranges that are listed with a text."""

    def run(batches):
        for batch in batches:
            listed = batch.column(3).to_pylist()
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, data, offsets in slices(batch.column(2)):
                starts, ends, rows = word_spans(data, offsets)
                words = Words(data, starts, ends)
                for i in range(lo, hi):
                    own = listed[i] or []
                    names, at, copies = (np.array([x[k] for x in own], np.int64) for k in ("name", "at", "copies"))
                    first, size = at >> SHIFT, (at & ((1 << SHIFT) - 1)) + 1
                    begin = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    if len(begin):
                        w = words.digests(begin + rows[i - lo], begin + rows[i - lo] + window)
                        arrays = (np.repeat(names, size), w[:, 0], w[:, 1], np.full(len(begin), k1[i]), np.full(len(begin), k2[i]), begin, np.repeat(copies, size))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [x.split()[0] for x in WINDOWS.split(", ")])

    return run


def covered(n: int, ranges: list, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the (first, last) ranges."""
    steps = np.zeros(n + window + 1, np.int64)
    for x in ranges:
        steps[x["first"]] += 1
        steps[x["last"] + window] -= 1
    return np.cumsum(steps)[:n] > 0


def _cut(window: int, columns: list[str], text: int, digest: bool):
    """The last column has the ranges. digest: only sizes and the kept words' hash."""

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, text)):
            texts, found = batch.column(text), batch.column(len(columns)).to_pylist()
            total, removed = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            out: list[str | None] = []
            for i, whole in enumerate(texts.to_pylist()):
                words = np.array((whole or "").encode().split(), object)  # of bytes: splits at the same six as word_spans
                gone = covered(len(words), found[i] or [], window)
                total[i], removed[i] = len(words), gone.sum()
                if digest:
                    out.append(hashlib.sha256(b" ".join(words[~gone])).hexdigest())
                else:
                    out.append(b" ".join(words[~gone]).decode() if removed[i] else whole)
            arrays = [batch.column(k) for k in range(len(columns))]
            if digest:
                yield pa.RecordBatch.from_arrays([arrays[0], pa.array(total), pa.array(removed), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                arrays[text] = pa.array(out, texts.type)
                yield pa.RecordBatch.from_arrays(arrays, columns)

    return run


K1, K2, RANGES = "attestry_k1", "attestry_k2", "attestry_ranges"


def repeated_ranges(documents: DataFrame, window: int = 35) -> DataFrame:
    """(K1, K2, ranges): the windows of a keyed text, by first and last start, whose words also start elsewhere."""
    docs = documents.select(K1, K2, "text")
    names = docs.select("text").mapInArrow(_names(window), "name long, n long")
    again = names.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")
    shared = stored(docs.mapInArrow(_symbols(window), SYMBOLS).join(again, "name", "left_semi"), "symbols")
    kinds = shared.groupBy("name", "c1", "c2").agg(F.sum("copies").alias("copies"), F.min(F.struct("k1", "k2", "at")).alias("one"))
    kinds = stored(kinds.select("name", "c1", "c2", "copies", "one.*"), "kinds")
    whole = shared.join(kinds.where("copies > 1").select("name", "c1", "c2"), ["name", "c1", "c2"], "left_semi")
    # Where the ranges of a name differ, one of each kind is compared with the others window by window.
    mixed = kinds.groupBy("name").count().where("count > 1").select("name")
    asked = kinds.join(mixed, "name", "left_semi").groupBy(F.col("k1").alias(K1), F.col("k2").alias(K2)).agg(F.collect_list(F.struct("name", "at", "copies")).alias("asked"))
    of_asked = docs.join(asked, [K1, K2]).dropDuplicates([K1, K2]).select(K1, K2, "text", "asked")  # equal rows are asked once
    windows = stored(of_asked.mapInArrow(_windows(window), WINDOWS), "windows")
    twice = windows.groupBy("name", "w1", "w2").count().where("count > 1").select("name", "w1", "w2")
    single = windows.where("copies = 1").join(twice, ["name", "w1", "w2"], "left_semi")
    whole = whole.select("k1", "k2", F.explode(F.coalesce("places", F.array("at"))).alias("at"))
    first = F.shiftrightunsigned("at", SHIFT)
    ranges = whole.select("k1", "k2", first.alias("first"), (first + F.col("at").bitwiseAND((1 << SHIFT) - 1)).alias("last"))
    ranges = ranges.unionByName(single.select("k1", "k2", F.col("begin").alias("first"), F.col("begin").alias("last"))).distinct()
    return ranges.groupBy(F.col("k1").alias(K1), F.col("k2").alias(K2)).agg(F.collect_list(F.struct("first", "last")).alias(RANGES))


def keyed(documents: DataFrame, k1: str = K1, k2: str = K2) -> DataFrame:
    """documents with the keys of their texts: the id and a hash of the text, or two hashes of it where the id is null."""
    text = F.col("text").cast("string")
    return documents.withColumns({k1: F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), text)), k2: F.xxhash64(text)})


def without_repeats(documents: DataFrame, window: int = 35) -> DataFrame:
    """documents with the words of repeated windows taken out of text, other columns as they are.

    A word goes if a window of so many consecutive words holds it whose words also start anywhere
    else, in this document or another; all windows are judged on the input.  A text that loses words
    keeps the others, joined by one space; other texts stay as they are.  Null, empty and blank
    texts and texts shorter than a window lose nothing.  Rows that repeat a doc_id and its text are
    places of their own, so all their windows repeat; the texts of a doc_id that has several are
    judged and cut each by itself, as are those of rows with a null doc_id.  An empty table stays empty.
    """
    columns, names = documents.columns, [fresh(documents, x) for x in (K1, K2, RANGES)]
    ranges = repeated_ranges(keyed(documents.select("doc_id", "text")), window).select(K1, K2, RANGES).toDF(*names)
    held = keyed(documents, *names[:2]).join(ranges, names[:2], "left")
    return mapped(held.select(*map(column, columns), names[2]), _cut(window, columns, columns.index("text"), False), documents.schema)


def repeat_digests(documents: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space, under the rules of without_repeats."""
    docs = keyed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    held = docs.join(repeated_ranges(docs, window), [K1, K2], "left").select("doc_id", "text", RANGES)
    return held.mapInArrow(_cut(window, ["doc_id", "text"], 1, True), "doc_id long, n_words long, n_removed long, kept_sha256 string")
