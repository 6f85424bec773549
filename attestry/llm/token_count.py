"""Token counts of texts under a byte-level BPE vocabulary, without making identifiers.

A text is split at the file's added tokens and then by the pattern of byte-level BPE.  A split
part starts as one symbol per byte, in a linked list; the pair of neighbours of the lowest rank
is popped from a heap and merged until no pair has a rank.  The count is the initial symbols
minus the merges.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .kernel import slices

# Fixed values of byte-level BPE: the split pattern, and the bytes that stand for themselves in vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

REMEMBERED = 600_000  # parts whose counts a worker keeps
SHORT = 48  # characters of a part that is kept


def byte_letters() -> list[str]:
    """The character by which vocabulary files write each byte."""
    letters, spare = [""] * 256, 0x100
    for b in range(256):
        if b in PRINTABLE:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


class Counter(dict):
    """Counts by part; a missing one is computed."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab, self.ranks = spec["model"]["vocab"], {}
        self.symbols = [vocab[x] for x in byte_letters()]
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.added_ids = {x["content"]: x["id"] for x in spec["added_tokens"]}
        added = self.added_ids
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, part: str) -> int:
        raw = part.encode()
        n = len(raw) - self.merges([self.symbols[b] for b in raw])
        if len(part) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = n
        return n

    def merges(self, symbol: list[int]) -> int:
        """How many merges the symbols undergo; of those merged the first stands for them, others become -1."""
        n, ranks = len(symbol), self.ranks
        heap = []
        for i in range(n - 1):
            met = ranks.get(symbol[i] << 20 | symbol[i + 1])
            if met is not None:
                heap.append(met >> 20 << 40 | i)
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done, pop, push = 0, heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top & (1 << 40) - 1
            j = after[i]
            if j >= n or symbol[i] < 0:
                continue
            met = ranks.get(symbol[i] << 20 | symbol[j])
            if met is None or met >> 20 != top >> 40:  # the pair that was pushed has gone
                continue
            done += 1
            symbol[i], symbol[j] = met & (1 << 20) - 1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                met = ranks.get(symbol[i] << 20 | symbol[k])
                if met is not None:
                    push(heap, met >> 20 << 40 | i)
            h = before[i]
            if h >= 0:
                met = ranks.get(symbol[h] << 20 | symbol[i])
                if met is not None:
                    push(heap, met >> 20 << 40 | h)
        return done

    def identifiers(self, part: str) -> list[int]:
        """The identifiers of a split part."""
        symbols = [self.symbols[b] for b in part.encode()]
        self.merges(symbols)
        return [s for s in symbols if s >= 0]

    def count(self, text: str) -> int:
        if self.added is None:
            return sum(map(self.__getitem__, self.split(text)))
        total, at = 0, 0
        for m in self.added.finditer(text):
            total += 1 + sum(map(self.__getitem__, self.split(text[at : m.start()])))
            at = m.end()
        return total + sum(map(self.__getitem__, self.split(text[at:] if at else text)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """A worker's counter, which keeps what it has counted."""
    return Counter(path)


def _counts(path: str, limit: int):
    def run(batches):
        count = counter(path).count
        for batch in batches:
            size = np.zeros(len(batch), np.int64)
            for lo, hi, _, offsets in slices(batch.column(1)):
                size[lo:hi] = np.diff(offsets)
            tokens = np.fromiter((count(x.as_py() or "") for x in batch.column(1)), np.int64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (of UTF-8), n_tokens and over_limit (more than limit tokens) of each row.

    vocabulary: the path of a byte-level BPE file in the tokenizers library's JSON form, readable
    on each executor.  The file's added tokens count as one token wherever a text has them, none
    is put in.  A null or empty text has 0 bytes and 0 tokens.  Each row is counted by itself, so
    repeated rows give repeated results and an empty table an empty one; other columns are ignored.
    """
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return docs.mapInArrow(_counts(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
