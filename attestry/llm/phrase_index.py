"""A positional inverted index of a corpus and searches for the phrases of test items in it.

The corpus is cut into segments of whole documents.  A segment is a row of a stored table: its documents, a sorted
directory of its terms and, by term, the places where they stand.  A search goes through the segments in any
number of tasks.  It takes each phrase whose terms the segment has, starts from the places of its rarest
term and keeps those that, moved by the terms' offsets, stand in the lists of the next rarest ones.  Test items are
sent to the tasks in blocks of bounded size, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import NOT_ALNUM, U64, slices, stored, word_hashes, word_spans

SEGMENT_BYTES = 1 << 19  # of text; a longer text is a segment of its own
BLOCK_WORDS = 1 << 19  # of test items that a task holds at a time
ITEM_WORDS = 1 << 15  # a longer item is cut into overlapping parts
CANDIDATES = 1 << 20  # places that are tested together
INDEX = "segment long, doc_ids array<long>, n_words array<long>, terms binary, counts binary, places binary"


def hashed_words(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of their words with A-Z as a-z, where each row's words begin) for about limit bytes of text at a time."""
    for lo, hi, data, offsets in slices(texts, limit):
        starts, ends, rows = word_spans(data, offsets, NOT_ALNUM)
        yield lo, hi, word_hashes(data, starts, ends, fold=True), rows


def _indexed(batches):
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for lo, hi, words, rows in hashed_words(batch.column(1), SEGMENT_BYTES):
            n = np.diff(rows)
            # A place is a word's number in the segment and one more for each document before, so no phrase runs across documents.
            place = np.arange(len(words), dtype=np.uint32) + np.repeat(np.arange(hi - lo, dtype=np.uint32), n)
            order = np.argsort(words, kind="stable")
            terms, counts = np.unique(words[order], return_counts=True)
            held = [terms.tobytes(), counts.astype(np.uint32).tobytes(), place[order].tobytes()]
            ids = pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([n.tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in held)], ["segment", "doc_ids", "n_words", "terms", "counts", "places"])
            number += 1


def positional_index(documents: DataFrame) -> DataFrame:
    """The stored segments of documents (doc_id, text): any rows, also of null or repeated ids; a null text has no words."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_indexed, INDEX), "index")


def _cut(width: int):
    def run(batches):
        for batch in batches:
            items, held = [], []
            for lo, hi, words, rows in hashed_words(batch.column(1), SEGMENT_BYTES):
                for k in range(hi - lo):
                    own = words[rows[k] : rows[k + 1]]
                    for at in range(0, max(1, len(own) - width + 1), ITEM_WORDS):
                        if len(own):
                            items.append(batch.column(0)[lo + k])
                            held.append(own[at : at + ITEM_WORDS + width - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in items], pa.int64()), pa.array(held, pa.binary())], ["item_id", "words"])

    return run


@dataclass
class Phrases:
    """A block of phrases of at most width terms: their items, lengths, distinct terms and, by phrase, the terms' numbers there.

    Where a phrase is shorter its row ends in the number of no term."""

    items: list[int | None]
    of: np.ndarray  # the item of each phrase
    lengths: np.ndarray
    terms: np.ndarray
    numbers: np.ndarray

    @classmethod
    def windows(cls, rows: list[tuple[int | None, bytes]], width: int) -> Phrases:
        """All runs of width words of each row's words; a row of fewer is one run."""
        if not rows:
            return cls([], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64), np.empty((0, width), np.int64))
        words = [np.frombuffer(w, U64) for _, w in rows]
        terms, numbers = np.unique(np.concatenate(words), return_inverse=True)
        ends = np.cumsum([len(w) for w in words])
        of, lengths, table = [], [], []
        for k, (w, end) in enumerate(zip(words, ends.tolist(), strict=True)):
            own = numbers[end - len(w) : end]
            runs = np.lib.stride_tricks.sliding_window_view(own, width) if len(own) >= width else np.pad(own, (0, width - len(own)), constant_values=len(terms))[None]
            runs = np.unique(runs, axis=0)
            table.append(runs)
            of.append(np.full(len(runs), k))
            lengths.append(np.full(len(runs), min(width, len(own))))
        return cls([i for i, _ in rows], np.concatenate(of), np.concatenate(lengths), terms, np.concatenate(table))


class Segment:
    """A row of the index, ready to be searched."""

    def __init__(self, n_words: np.ndarray, terms: bytes, counts: bytes, places: bytes):
        self.n_words = n_words
        self.first = np.concatenate(([0], np.cumsum(n_words + 1)))  # the place of each document's first word
        self.terms = np.frombuffer(terms, U64)
        self.counts = np.frombuffer(counts, np.uint32).astype(np.int64)
        self.at = np.cumsum(self.counts) - self.counts
        self.places = np.frombuffer(places, np.uint32).astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) << 32 | self.places  # rises: lists by term, in each the places

    def own(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """The phrases of which the segment has all terms, and the terms' numbers in the segment: -1 behind a phrase's end."""
        if not len(self.terms):
            return np.empty(0, np.int64), np.empty((0, phrases.numbers.shape[1]), np.int64)
        at = np.minimum(np.searchsorted(self.terms, phrases.terms), len(self.terms) - 1)
        number = np.append(np.where(self.terms[at] == phrases.terms, at, -2), -1)
        able = np.ones(len(phrases.of), bool)
        for column in phrases.numbers.T:
            able &= number[column] != -2
        rows = np.flatnonzero(able)
        return rows, number[phrases.numbers[rows]]

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers < 0, np.iinfo(np.int64).max, self.counts[np.maximum(numbers, 0)])

    def exact(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and place of each occurrence: lists are intersected from the rarest term on."""
        rows, numbers = self.own(phrases)
        order = np.argsort(self.sizes(numbers), axis=1, kind="stable")
        rarest = np.take_along_axis(numbers, order[:, :1], 1)[:, 0]
        out = []
        ends = np.cumsum(self.counts[rarest])
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, side="right")))
            n = self.counts[rarest[at:end]]
            k = np.repeat(np.arange(at, end), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = self.places[self.at[rarest[k]] + inside] - order[k, 0]
            k, start = k[start >= 0], start[start >= 0]
            for r in range(1, numbers.shape[1]):
                offset = order[k, r]
                number = numbers[k, offset]
                key = number << 32 | start + offset
                kept = (number < 0) | (self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key)
                k, start = k[kept], start[kept]
                if not len(k):
                    break
            out.append((rows[k], start))
            at = end
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (rows, rows)

    def near(self, phrases: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, place of the first and place of the last word of each stretch of at most the phrase's length and slop words of one
        document that begins with one of its words and holds them all, in any order; the shortest such stretch of each beginning."""
        rows, numbers = self.own(phrases)
        found = [(np.empty(0, np.int64),) * 3]
        for row, own in zip(rows.tolist(), numbers, strict=True):
            distinct = np.unique(own[own >= 0])
            distinct = distinct[np.argsort(self.counts[distinct], kind="stable")]
            lists = [self.places[self.at[t] : self.at[t] + self.counts[t]] for t in distinct]
            span = int(phrases.lengths[row]) + slop
            start = np.unique(np.concatenate([x[_next(lists[0], x)[1] < x + span] for x in lists]))  # the rarest term is within reach
            last = start
            for x in lists:
                here, place = _next(x, start)
                kept = here & (place < start + span)
                start, last = start[kept], np.maximum(last[kept], place[kept])
            inside = self.document(start) == self.document(last)
            found.append((np.full(inside.sum(), row), start[inside], last[inside]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1


def _next(held: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a list has a place at or behind each of places, and the first such, else a place beyond all."""
    at = np.searchsorted(held, places)
    there = at < len(held)
    return there, np.where(there, held[np.minimum(at, len(held) - 1)], np.iinfo(np.int64).max)


def _found(phrases: Phrases, slop: int | None, first: bool):
    """Rows of documents (of the first block, one each without an item) and their stretches by item, overlapping ones joined where exact."""
    ids = pa.array([*phrases.items, None], pa.int64())

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                segment, doc_ids, n_words, *held = (column[i] for column in batch.columns)
                n = np.array(n_words.as_py(), np.int64)
                s = Segment(n, *(x.as_py() for x in held))
                if slop is None:
                    phrase, start = s.exact(phrases)
                    item, last = phrases.of[phrase], start + phrases.lengths[phrase] - 1
                    item, start, last = _joined(item, start, last)
                else:
                    phrase, start, last = s.near(phrases, slop)
                    item = phrases.of[phrase]
                doc = s.document(start)
                start, last = start - s.first[doc], last - s.first[doc]
                every = np.arange(len(n) if first else 0)
                none = np.full(len(every), -1)
                doc, item, start, last = (np.concatenate(x) for x in ((every, doc), (none, item), (none, start), (none, last)))
                absent = item < 0
                columns = [pa.array(np.full(len(doc), segment.as_py(), np.int64)), pa.array(doc), doc_ids.values.take(pa.array(doc)), pa.array(n[doc]), ids.take(pa.array(item, mask=absent))]
                columns += [pa.array(~absent), pa.array(start, mask=absent), pa.array(last + 1, mask=absent)]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "number", "doc_id", "n_words", "item_id", "met", "start", "end"])

    return run


FOUND = "segment long, number long, doc_id long, n_words long, item_id long, met boolean, start long, end long"


def _joined(item: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the stretches of each item; places of two documents are never next to each other."""
    order = np.lexsort((start, item))
    item, start, last = item[order], start[order], last[order]
    if not len(item):
        return item, start, last
    reach = np.maximum.accumulate(last + (item << 40)) - (item << 40)  # within an item, as its number outweighs places
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (start[1:] > reach[:-1] + 1)
    at = np.flatnonzero(new)
    return item[at], start[at], np.maximum.reduceat(last, at)


def _searched(index: DataFrame, items: DataFrame, width: int, slop: int | None) -> DataFrame:
    cut = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut(width), "item_id long, words binary")
    cut = stored(cut.withColumn("n", F.monotonically_increasing_id()), "items")
    words = (cut.agg(F.sum(F.length("words"))).first()[0] or 0) // 8
    blocks = 1 + 2 * words // BLOCK_WORDS  # dealt by number, so a block's words are near half the bound
    out, first = None, True
    for b in range(blocks):
        rows = cut.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).select("item_id", "words").collect()
        found = index.mapInArrow(_found(Phrases.windows([(r.item_id, bytes(r.words)) for r in rows], width), slop, first), FOUND)
        out, first = found if out is None else out.unionByName(found), False
    return out


def exact_matches(index: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """segment, number, doc_id, n_words, item_id, start and end of the words of each document of the index that occurrences of windows of items cover.

    items (item_id, text): a window is width consecutive words of an item; an item of fewer words, but not none, is one window.  Words are
    compared by 64-bit hashes with A-Z as a-z.  A row is a stretch of words [start, end) by document and item, joined where
    occurrences overlap or touch; where an item has several rows or parts, stretches may repeat.  Documents without a match have one
    row with nulls; documents with matches have that row too.  met tells which rows are matches."""
    return _searched(index, items, width, None)


def proximity_matches(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 5) -> DataFrame:
    """Like exact_matches, but a row is a stretch of at most width + slop words of a document that begins with one of a window's words and holds them all in any order.

    A window's repeated words need to be there once.  Of stretches with one beginning the shortest is given, without joining."""
    return _searched(index, items, width, slop)


def contaminated_documents(documents: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words that occurrences cover), n_items (items met), items_sha256 (their ids in string order, by commas) and contaminated (n_hit > 0).

    Every row of documents gives a row, so repeated or null ids stay apart.  Null and empty texts have no words; items without words are met nowhere, items without an id cover
    words but aren't counted or listed, and items of one id are one item.  Without documents or items the result is empty or has no hits.  Other
    columns are ignored.
    """
    found = exact_matches(positional_index(documents), items, width)
    own = F.filter("spans", lambda s: s["start"].isNotNull())
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    covered = F.aggregate(F.array_sort(own), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), step, lambda a: a["n"])
    docs = found.groupBy("segment", "number").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set("item_id").alias("items"), F.collect_set(F.struct("start", "end")).alias("spans"))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return docs.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (covered > 0).alias("contaminated"))
