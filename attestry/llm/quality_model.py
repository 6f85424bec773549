"""Quality scores by gradient-boosted trees over histograms of document statistics.

Statistics of whole texts are found with numpy over Arrow batches.  A model is fitted on a
bounded sample of labelled documents (SAMPLE), its trees are flattened into arrays, and each
task scores its documents by walking all trees level by level with array operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, mapped, mix64, slices, word_hashes, word_spans

SAMPLE = 20_000  # labelled documents at most that the model is fitted on
TREES, DEPTH, BINS, RATE, LEAST = 80, 4, 64, 0.15, 1.0  # LEAST: hessian of a leaf

_CLASSES = {
    "symbols": b"#*$%&|<>", "shouts": b"!", "marks": b".,;:?", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digits": b"0123456789",
    "wide": bytes(range(0xC2, 0xF5)), "lines": b"\n", "tabs": b"\t", "ats": b"@", "slashes": b"/\\", "braces": b"(){}[]=_+-", "quotes": b"'\"`", "bars": b"|", "stars": b"*", "controls": bytes([*range(9), *range(14, 32), 127]),
}
FEATURES = [*_CLASSES, "bytes", "words", "word_bytes", "long_words", "distinct_words", "top_word", "repeated_3", "distinct_lines", "line_words", "upper_words", "single_bytes"]


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; shares are of bytes, words or lines, and 0 where there are none."""
    out = np.zeros((len(texts), len(FEATURES)))
    at = {name: k for k, name in enumerate(FEATURES)}
    tables = {name: np.isin(np.arange(256), list(chars)) for name, chars in _CLASSES.items()}
    for lo, hi, data, offsets in slices(texts):
        rows = out[lo:hi]
        size = np.maximum(np.diff(offsets), 1)
        for name, table in tables.items():
            rows[:, at[name]] = _per_row(table[data], offsets) / size
        starts, ends, bounds = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        n = np.diff(bounds)
        some = np.maximum(n, 1)
        length = ends - starts
        rows[:, at["bytes"]], rows[:, at["words"]] = np.log1p(size), np.log1p(n)
        rows[:, at["word_bytes"]] = np.diff(np.concatenate(([0], np.cumsum(length)))[bounds]) / some
        rows[:, at["long_words"]] = _per_row(length > 20, bounds) / some
        rows[:, at["single_bytes"]] = _per_row(length == 1, bounds) / some
        first = data[starts] if len(starts) else np.zeros(0, np.uint8)
        rows[:, at["upper_words"]] = _per_row((first >= 65) & (first <= 90), bounds) / some
        threes = mix64(words[:-2] * U64(0x9E3779B97F4A7C15) + words[1:-1] * U64(0xC2B2AE3D27D4EB4F) + words[2:]) if len(words) > 2 else words[:0]
        breaks = np.flatnonzero(data == 10)
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(words, dtype=U64)))
        for r in range(hi - lo):
            a, b = bounds[r], bounds[r + 1]
            if a == b:
                continue
            own = np.sort(words[a:b])
            new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            rows[r, at["distinct_words"]] = len(new) / (b - a)
            rows[r, at["top_word"]] = np.diff(np.append(new, b - a)).max() / (b - a)
            if b - a > 2:
                own = np.sort(threes[a : b - 2])
                rows[r, at["repeated_3"]] = np.count_nonzero(own[1:] == own[:-1]) / (b - a - 2)
            inner = breaks[np.searchsorted(breaks, offsets[r]) : np.searchsorted(breaks, offsets[r + 1])]
            edges = np.concatenate(([a], np.searchsorted(starts, inner), [b]))
            filled = edges[1:] > edges[:-1]
            lines = (sums[edges[1:]] - sums[edges[:-1]])[filled]  # equal lines have equal sums
            rows[r, at["distinct_lines"]] = len(np.unique(lines)) / len(lines)
            rows[r, at["line_words"]] = np.log1p((b - a) / len(lines))
    return out


@dataclass
class Trees:
    """All nodes of all trees in arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        of = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = np.where(x[of, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting; trees grow level by level on sums of gradients over BINS bins of each feature."""
    n, width = x.shape
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    rate = (y.sum() + 1) / (n + 2)
    base, roots = float(np.log(rate / (1 - rate))), []

    def node() -> int:
        me = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", me), ("right", me), ("value", 0.0)):
            nodes[k].append(v)
        return me

    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(n, base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            root = node()
            roots.append(root)
            where, level = np.full(n, root), [root]
            for depth in range(DEPTH + 1):
                place = {m: k for k, m in enumerate(level)}
                of = np.fromiter((place.get(m, -1) for m in where), np.int64, n) if depth else np.zeros(n, np.int64)
                on = np.flatnonzero(of >= 0)
                gs, hs = np.bincount(of[on], g[on], len(level)), np.bincount(of[on], h[on], len(level))
                for k, m in enumerate(level):
                    nodes["value"][m] = RATE * gs[k] / (hs[k] + 1)
                if depth == DEPTH:
                    break
                best = [(1e-6, -1, -1)] * len(level)
                for f in range(width):
                    cell = of[on] * BINS + binned[on, f]
                    gl = np.cumsum(np.bincount(cell, g[on], len(level) * BINS).reshape(-1, BINS), axis=1)
                    hl = np.cumsum(np.bincount(cell, h[on], len(level) * BINS).reshape(-1, BINS), axis=1)
                    gr, hr = gs[:, None] - gl, hs[:, None] - hl
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gs**2 / (hs + 1))[:, None]
                    gain[(hl < LEAST) | (hr < LEAST)] = 0
                    for k, c in enumerate(gain[:, : len(cuts[f])].argmax(axis=1) if len(cuts[f]) else []):
                        if gain[k, c] > best[k][0]:
                            best[k] = (gain[k, c], f, int(c))
                following = []
                for k, m in enumerate(level):
                    _, f, c = best[k]
                    if f < 0:
                        continue
                    a, b = node(), node()
                    nodes["feature"][m], nodes["threshold"][m], nodes["left"][m], nodes["right"][m] = f, float(cuts[f][c]), a, b
                    mine = on[of[on] == k]
                    where[mine] = np.where(binned[mine, f] <= c, a, b)
                    following += [a, b]
                level = following
                if not level:
                    break
            margin += np.array(nodes["value"])[where]
    return Trees(base, np.array(roots, np.int64), *(np.array(nodes[k], t) for k, t in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float))))


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sampled(batches):
    for batch in batches:
        x = statistics(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "doc_id"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """A model of labels.quality from at most sample labelled documents outside the held-out ones.

    The documents of the sample are those with the least hashes of their ids; so many ids and labels
    are broadcast, and so many rows of statistics go to the driver.  Of rows that share an id one text
    counts, the one with the least hash.  Several labels of a document count by their mean; null labels don't count.  Without labels of both kinds all scores are alike.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known.where(~held_out(F.col("doc_id"))).join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    found = one.select("text", "y", "doc_id").mapInArrow(_sampled, "x array<double>, y double, doc_id long")
    rows = sorted(found.collect(), key=lambda r: (r.doc_id, r.x))
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows]))


def _scored(trees: Trees, text: int, columns: list[str], least: float | None):
    def run(batches):
        for batch in batches:
            score = trees.scores(statistics(batch.column(text)))
            if least is not None:
                yield batch.filter(pa.array(score >= least))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*columns, "score"])

    return run


def scored_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of each row.

    A null text is an empty one; empty texts are scored by their statistics, which are 0. Each row is scored by itself, so
    repeated rows give repeated results; a null doc_id isn't held out.  Columns other than doc_id and text
    are ignored.  An empty table gives an empty result.
    """
    trees = train(documents, labels, sample)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scores = docs.mapInArrow(_only(trees), "doc_id long, score double")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _only(trees: Trees):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.scores(statistics(batch.column(1))))], ["doc_id", "score"])

    return run


def accepted_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of documents whose score reaches threshold, with all their columns."""
    trees = train(documents, labels, sample)
    return mapped(documents, _scored(trees, documents.columns.index("text"), documents.columns, threshold), documents.schema)
