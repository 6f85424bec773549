"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's target is turned into exact quotas: a first epoch of distinct blocks and, beyond the
source's size, a second one.  A binary tree over the output shards splits the vector of block
quotas: each node draws its left half's share of every source from the multivariate hypergeometric
distribution, as if all drawn blocks had been shuffled at once.  The leaves tell how many blocks of
each source a shard draws.  Blocks of a source stand in a permuted order, of which the shards draw
disjoint stretches, one after the other; a block that no shard's stretch reaches isn't drawn.
Blocks are shuffled again inside their shard.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import column, fresh, mapped, parts, stored

BLOCK = 256  # words
SHARD_WORDS = 1 << 20
TREE_CELLS = 1 << 20  # shards times quotas that a task may hold: with more, shards grow instead
BUCKET_BLOCKS = 4096
DIRECT = 1_000_000_000  # numpy draws from smaller populations itself
WEIGHTS = (5, 2, 1)
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight; one that exceeds most times its size stops there and the excess is shared again."""
    out: list[float | None] = [None] * len(sizes)
    left = total
    while True:
        open_ = [i for i, x in enumerate(out) if x is None]
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            break
        for i in full:
            out[i] = most * sizes[i]
        left = total - sum(x for x in out if x is not None)
    return [left * weights[i] / weight if x is None else x for i, x in enumerate(out)]


def split(rng: np.random.Generator, quotas: np.ndarray, n: int, direct: int = DIRECT) -> np.ndarray:
    """How many of each quota are among n draws without replacement from all.

    For populations beyond numpy's range each unit is drawn by itself with equal chance; of too many drawn
    ones the surplus, itself such a draw from them, goes back, and too few are filled up by a draw from
    the rest.  All sets of n are equally likely at each step, so this is exact; the number that is still
    to be moved shrinks to about its root each time."""
    total = int(quotas.sum())
    if total < direct:
        return rng.multivariate_hypergeometric(quotas, n, method="marginals")
    if n <= 64:  # one by one
        out = np.zeros_like(quotas)
        for _ in range(n):
            ends = np.cumsum(quotas - out)
            out[np.searchsorted(ends, rng.integers(ends[-1]), side="right")] += 1
        return out
    out = rng.binomial(quotas, n / total)
    more = int(out.sum()) - n
    if more > 0:
        return out - split(rng, out, more, direct)
    return out + split(rng, quotas - out, -more, direct) if more else out


class Tree:
    """The splitting tree over shards; every task grows the same nodes from the seed."""

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.quotas, self.shards, self.seed, self.nodes = np.array(quotas, np.int64), shards, seed, {}

    def left(self, lo: int, hi: int, quotas: np.ndarray) -> np.ndarray:
        if (lo, hi) not in self.nodes:
            total, half = int(quotas.sum()), (hi - lo) // 2
            n = total * half // (hi - lo)
            self.nodes[lo, hi] = split(np.random.default_rng([self.seed, lo, hi]), quotas, n)
        return self.nodes[lo, hi]

    def shard(self, kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The shard that draws each rank of the permuted blocks of a kind, -1 where none does."""
        out = np.full(len(kind), -1)
        drawn = np.flatnonzero(rank < self.quotas[kind])
        todo = [(0, self.shards, self.quotas, drawn, rank[drawn])]
        while todo:
            lo, hi, quotas, rows, rank = todo.pop()
            if hi - lo == 1 or not len(rows):
                out[rows] = lo
                continue
            share = self.left(lo, hi, quotas)
            mid, bound = lo + (hi - lo) // 2, share[kind[rows]]
            inside = rank < bound
            todo.append((lo, mid, share, rows[inside], rank[inside]))
            todo.append((mid, hi, quotas - share, rows[~inside], (rank - bound)[~inside]))
        return out


@lru_cache(maxsize=2)
def _tree(quotas: tuple[int, ...], shards: int, seed: int) -> Tree:
    return Tree(list(quotas), shards, seed)


def _dealt(quotas: tuple[int, ...], shards: int, seed: int):
    def run(batches):
        tree = _tree(quotas, shards, seed)
        for batch in batches:
            kind, rank = (batch.column(k).to_numpy().astype(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.shard(kind, rank))], ["kind", "rank", "row", "doc_id", "epoch", "block", "first", "taken", "shard"])

    return run


def _plan(sized: DataFrame, ratio: float, weights: tuple[float, ...]) -> list[dict]:
    """Sources by code point, null last, with size and target: a row for each source, of which there are few."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], ratio * sum(sizes)) if sizes else []
    return [{"source": r.source, "source_size": r["size"], "target": t, "number": i} for i, (r, t) in enumerate(zip(rows, goal, strict=True))]


def draws(sized: DataFrame, plan: list[dict], seed: int = 0) -> DataFrame:
    """row, doc_id, epoch, block, first (word), taken (words), shard and place of all draws from sized (row, doc_id, source, size, mark).

    mark, a hash of the text, deals out rows with a null id and orders rows of one doc_id before their row does."""
    spark = sized.sparkSession
    quotas = []
    for p in plan:
        whole = min(round(p["target"]), 2 * p["source_size"])
        quotas += [(p["number"], p["source"], e, q) for e, q in ((0, min(whole, p["source_size"])), (1, max(0, whole - p["source_size"]))) if q]
    kinds = spark.createDataFrame([(k, *q) for k, q in enumerate(quotas)], "kind int, number int, source string, epoch int, quota long")
    blocks = sized.where("size > 0").join(F.broadcast(kinds), sized.source.eqNullSafe(kinds.source)).select("row", "doc_id", "mark", "size", "kind", "epoch", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK))).alias("block"))
    unnamed = F.when(F.col("doc_id").isNull(), F.col("mark"))  # a null changes no hash
    blocks = blocks.select("*", (F.col("block") * BLOCK).alias("first"), F.least(F.lit(BLOCK), F.col("size") - F.col("block") * BLOCK).alias("words"), F.xxhash64(F.lit(seed), "epoch", "doc_id", unnamed, "block").alias("order"))
    bits = max(0, (max(1, sized.agg(F.sum(F.ceil(F.col("size") / BLOCK))).first()[0] or 0) // BUCKET_BLOCKS).bit_length())
    blocks = blocks.withColumn("bucket", F.shiftrightunsigned("order", 64 - bits) if bits else F.lit(0).cast("long"))
    # Permuted ranks: a running count within small buckets of the order, from the counts of the buckets before, which
    # are themselves counted from those of stretches of buckets.
    counts = blocks.groupBy("kind", "bucket").agg(F.sum("words").alias("w"), F.count("*").alias("n")).withColumn("stretch", F.shiftright("bucket", 12))
    before = lambda c, w: F.sum(c).over(w) - F.col(c)
    over = Window.partitionBy("kind").orderBy("stretch")
    stretches = counts.groupBy("kind", "stretch").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).select("kind", "stretch", before("w", over).alias("w1"), before("n", over).alias("n1"))
    inside = Window.partitionBy("kind", "stretch").orderBy("bucket")
    counts = counts.select("kind", "stretch", "bucket", before("w", inside).alias("w0"), before("n", inside).alias("n0")).join(stretches, ["kind", "stretch"])
    counts = counts.select("kind", "bucket", (F.col("w0") + F.col("w1")).alias("w0"), (F.col("n0") + F.col("n1")).alias("n0"))
    order = Window.partitionBy("kind", "bucket").orderBy("order", "doc_id", "block", "mark", "row")
    ranked = blocks.withColumns({"w": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(order)}).join(counts, ["kind", "bucket"])
    start = F.col("w0") + F.col("w") - F.col("words")
    ranked = stored(ranked.select("kind", (F.col("n0") + F.col("n") - 1).alias("rank"), "row", "doc_id", "epoch", "block", "first", F.least("words", F.col("quota") - start).alias("words")), "ranked")
    # A kind's quota of blocks is what its quota of words reaches into; the last block is cut.
    of = {r.kind: r.n for r in ranked.groupBy("kind").agg(F.count_if(F.col("words") > 0).alias("n")).collect()}
    shards = min(max(1, TREE_CELLS // max(1, len(quotas))), max(1, -(-sum(q[3] for q in quotas) // SHARD_WORDS)))
    dealt = ranked.mapInArrow(_dealt(tuple(of.get(k, 0) for k in range(len(quotas))), shards, seed), "kind int, rank long, row long, doc_id long, epoch int, block long, first long, taken long, shard long").where("shard >= 0")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "kind", "rank"), "kind", "rank")
    return dealt.select("row", "doc_id", "epoch", "block", "first", "taken", "shard", (F.row_number().over(local) - 1).cast("long").alias("place"))


def _sized(documents: DataFrame, row: Column | None = None) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("mark"))


def mixture(documents: DataFrame, ratio: float = 1.5, weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """doc_id, size (words), source_size, target, taken, n_shards, first_shard and first_place of each row.

    Sources by code point, null last, have the weights in turn and share ratio of all words; a
    target stops at twice its source's size.  A source's taken words, summed over the shards' draws, are its target rounded
    to a whole word.  first_shard and first_place tell where the first of the row's blocks stands in the mix.
    Null, empty and blank texts have size 0 and nothing taken.  Repeated rows are drawn
    from one by one.  An empty table gives an empty result; other columns are ignored.  The order of
    draws depends on doc_id, of rows that share or lack it on their texts, so reruns agree.
    """
    spark = documents.sparkSession
    sized = stored(_sized(documents), "sized")
    plan = _plan(sized, ratio, weights)
    if not plan:
        return spark.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long, n_shards long, first_shard long, first_place long")
    taken = draws(sized, plan, seed).groupBy("row").agg(F.sum("taken").alias("taken"), F.count_distinct("shard").alias("n_shards"), F.min(F.struct("shard", "place")).alias("spot"))
    sources = spark.createDataFrame([(p["source"], p["source_size"], float(p["target"])) for p in plan], "of string, source_size long, target double")
    out = sized.join(F.broadcast(sources), sized.source.eqNullSafe(sources.of)).join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("n_shards", F.lit(0)).alias("n_shards"), F.col("spot.shard").alias("first_shard"), F.col("spot.place").alias("first_place"))


def _written(columns: list[str], text: int, shard: str, place: str):
    """Rows with their drawn (first, taken) behind the columns: the text becomes the drawn words."""

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole, text)):
            out = []
            for whole, own in zip(batch.column(text).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                words = (whole or "").encode().split()
                own = sorted((p["first"], p["taken"]) for p in own)
                out.append(whole if sum(n for _, n in own) == len(words) else b" ".join(w for a, n in own for w in words[a : a + n]).decode())
            arrays = [batch.column(k) for k in range(len(columns))]
            arrays[text] = pa.array(out, arrays[text].type)
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(len(columns) + 1), batch.column(len(columns) + 2)], [*columns, shard, place])

    return run


def mixed_documents(documents: DataFrame, ratio: float = 1.5, weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The mix as rows of documents: a row for each epoch in which a document is drawn, with the drawn words as text.

    Rows of a shard stand together, each at the place of the first of its blocks in the shard's shuffled order.
    A text that is drawn whole stays as it is; of others the drawn blocks follow each other, joined
    by one space.  Rows of which nothing is drawn go.  Rows with a null or repeated id are drawn from one by
    one; they are ordered by their texts, so reruns agree but for which of two equal texts of one id is drawn.
    An empty table stays empty; other columns go along, whatever their names.
    """
    columns, (row, drawn_, shard, place) = documents.columns, (fresh(documents, f"attestry_{x}") for x in ("row", "drawn", "shard", "place"))
    held = stored(documents.withColumn(row, F.monotonically_increasing_id()), "held")
    sized = stored(_sized(held, F.col(row)), "sized")
    plan = _plan(sized, ratio, weights)
    if not plan:
        return documents.limit(0)
    drawn = draws(sized, plan, seed).groupBy("row", "epoch").agg(F.collect_list(F.struct("first", "taken")).alias("drawn"), F.min(F.struct("shard", "place")).alias("spot"))
    drawn = drawn.select(F.col("row").alias(row), F.col("drawn").alias(drawn_), F.col("spot.shard").alias(shard), F.col("spot.place").alias(place))
    shape = T.StructType([*documents.schema, T.StructField(shard, T.LongType()), T.StructField(place, T.LongType())])
    own = [column(c) for c in columns]
    mixed = mapped(held.join(drawn, row).select(*own, drawn_, shard, place), _written(columns, columns.index("text"), shard, place), shape)
    return mixed.repartition(F.col(shard)).sortWithinPartitions(shard, place).select(*own)
