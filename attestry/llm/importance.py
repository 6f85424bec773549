"""Importance resampling of documents towards a target, over hashed runs of words.

A text is scanned once.  A ring keeps the zlib state of the runs that begin at each of the last words; a
further word extends each of them by a space and itself, so that no run is put together or hashed
from its start.  Each state, taken as a run's crc32, names a bucket.  Buckets are counted over all documents and over
the target; a bucket's gain is the logarithm of how much likelier the target is to hold it.  A document's score is
the sum of its gains and a Gumbel variate of its id, so the highest scores are a draw without replacement.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import NOT_ALNUM, parts, stored

RUN_WORDS = 3
BUCKETS = 10_000
BLOCK = 1 << 14  # words that are extended together
_FOLD = bytes(32 if NOT_ALNUM[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and what is not ASCII, in UTF-8, with A-Z as a-z."""
    return (text or "").encode().translate(_FOLD).split()


class Ring:
    """The zlib states of the runs of 1 to n words that end at the last word."""

    def __init__(self, n: int):
        self.n, self.states = n, []

    def extend(self, words: list[bytes]) -> list[list[int]]:
        """The states of all runs that end in these words, which follow those before: a list for each length."""
        spaced = [b" " + w for w in words]
        found = [list(map(crc32, words))]
        for k in range(1, self.n):
            before = chain(self.states[k - 1 : k], found[k - 1])  # what a word of these extends, in order
            have = min(len(self.states[k - 1 : k]) + len(found[k - 1]) - 1, len(words))
            found.append(list(map(crc32, islice(spaced, len(words) - have, None), before)))
        self.states = [own[-1] for own in found if own]
        return found


def run_buckets(text: str | None, n: int = RUN_WORDS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words and the bucket of each run of 1 to n words."""
    words, ring, out = words_of(text), Ring(n), []
    for at in range(0, len(words), BLOCK):
        out += [np.array(own, np.uint32) % np.uint32(buckets) for own in ring.extend(words[at : at + BLOCK])]
    return len(words), np.concatenate(out) if out else np.empty(0, np.uint32)


def _featured(n: int, buckets: int):
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, 2)):
            found = [run_buckets(text.as_py(), n, buckets) for text in batch.column(2)]
            counts = [pa.array([w for w, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64())]
            held = pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, held], ["row", "doc_id", "n_words", "n_features", "buckets"])

    return run, kind


def _counted(kind: type, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column(0):
                total += np.bincount(np.frombuffer(held.as_py(), kind), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    return run


def features(texts: DataFrame, row: Column, doc_id: Column, n: int = RUN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words, n_features and buckets (one number a feature) of each row's text, stored."""
    rows = texts.select(row.alias("row"), doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_featured(n, buckets)[0], "row long, doc_id long, n_words long, n_features long, buckets binary"), "features")


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features of all rows fall into each bucket: at most that many sums reach the driver."""
    held = featured.select("buckets").mapInArrow(_counted(_featured(1, buckets)[1], buckets), "bucket int, n long")
    out = [0] * buckets
    for r in held.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """1000 times the logarithm of each bucket's share of the target over that of the source, both counts raised by one."""
    b, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source, target, strict=True)]


def luck(doc_id: int | None, seed: int) -> int:
    """1000 times a Gumbel variate that depends on the id and the seed."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: list[int], kind: type, seed: int):
    def run(batches):
        of = np.array(gain, np.int64)
        for batch in (part for whole in batches for part in _slices(whole)):
            weight = np.array([of[np.frombuffer(b.as_py(), kind)].sum() for b in batch.column(4)], np.int64)
            chance = np.array([luck(i, seed) for i in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(weight), pa.array(weight + chance)], ["row", "doc_id", "n_words", "n_features", "weight", "score"])

    return run


def _slices(batch: pa.RecordBatch, rows: int = 1024):
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """rows (row, score, ...) with rank: 1, 2, ... by falling score, then doc_id, for the draw first ones.

    Rows are dealt by ranges of this order, the row number last, so that equal ones can be parted; each range counts from where the ranges before it end."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    dealt = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    reached = dealt.join(F.broadcast(before), "part").where(F.col("before") < draw)
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return reached.withColumn("rank", place.cast("long")).where(F.col("rank") <= draw).drop("part", "before")


def resampled(documents: DataFrame, target: DataFrame, percent: int = 5, fewest_words: int = 20, n: int = RUN_WORDS, buckets: int = BUCKETS, seed: int = 42, row: Column | None = None) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score and rank of every row of documents (doc_id, text) against target (text).

    row numbers the rows, by a column that is given or else anew.  Of the N rows with at least fewest_words words, floor(percent * N / 100) are drawn: rank counts them from the
    highest score, ties to the smaller doc_id, null last; of rows equal in both the one with fewer features.  Undrawn rows
    have a null rank.  Null and empty texts have no words, no features and the weight 0.  A null id counts as an empty one in its
    Gumbel variate, so rows without an id or with the same one share it.  An empty target gives every bucket the same count;
    an empty table gives an empty result.  Other columns are ignored.
    """
    featured = features(documents, F.monotonically_increasing_id() if row is None else row, F.col("doc_id").cast("long"), n, buckets)
    wanted = features(target, F.lit(0).cast("long"), F.lit(None).cast("long"), n, buckets)
    kind = _featured(n, buckets)[1]
    gain = gains(bucket_counts(featured, buckets), bucket_counts(wanted, buckets))
    scored = stored(featured.mapInArrow(_scored(gain, kind, seed), "row long, doc_id long, n_words long, n_features long, weight long, score long"), "scores")
    able = scored.where(F.col("n_words") >= fewest_words)
    draw = percent * able.count() // 100
    ranks = ranked(able, draw).select("row", "rank")
    return scored.join(ranks, "row", "left")


def drawn_documents(documents: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of documents that resampled() draws, in no order and with all their columns."""
    held = stored(documents.select(F.struct("*").alias("all"), F.monotonically_increasing_id().alias("id")), "held")
    ranks = resampled(held.select("id", "all.doc_id", "all.text"), target, row=F.col("id"), **how).where("rank is not null")
    return held.join(ranks, F.col("id") == F.col("row"), "left_semi").select("all.*")
