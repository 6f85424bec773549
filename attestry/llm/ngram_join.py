"""Similarity self-join of documents on word n-grams: prefix filtering, rare n-grams first.

A document's set holds its distinct n-grams.  All n-grams have one total order: how often their
cell of a frequency table was met in all documents (the table grows with them, up to MOST_BITS), then
their hash.  Two sets whose Jaccard similarity reaches t share an n-gram within the first
n - ceil(t * n) + 1 of each, so only those are exchanged.  Candidates pass these filters:

* length and position, where the two sets meet at an n-gram;
* the number of n-grams at which their prefixes meet: sets with an intersection of o have at least
  min(k - (n - o)) of them in common, k and n being a set's prefix and size;
* the suffix filter, then the exact intersection, once for each pair.

An n-gram of more than FEW sets would make too many pairs.  There each set meets a leader instead, which
keeps the pairs linear in a group of copies.  Sets with so little behind the n-gram that only smaller
sets can match (weak ones) never match each other, so an n-gram of weak sets alone, as of a common
line in unlike texts, makes no pair at all.  Members that their leader doesn't connect are held
against its other members in cells of bounded size, by neighbouring size classes and with weak
ones left out on one side, by parity bitmaps that bound the similarity from above.  The most similar
ones are verified first, and rounds go on until no pair that could join two components is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, constants, dropped, fresh, mix64, signed, slices, stored, word_hashes, word_spans

LEAST_BITS, MOST_BITS = 16, 23  # the frequency table has a cell for 64 n-grams; 8 MiB at most are broadcast
CHUNK = 4096
LEADER_SHARE = 128  # members that are compared with one copy of their leader
FEW = 8  # sets of an n-gram that all meet each other
HOT = 50_000  # an n-gram of more sets is dealt to several tasks
PART = 16_384  # rows of an n-gram that are paired in one step
FOREST_ROWS = 500_000  # edges that a task joins
CELL_BYTES, CELL_ROWS = 1 << 22, 4096  # bitmaps of one side of a cell


def sets_of(texts: pa.Array, n: int, seed: int = 7) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct n-gram hashes) for each row; fewer than n words count as one n-gram."""
    weights = constants(seed, n + 1)
    for lo, hi, data, offsets in slices(texts):
        starts, ends, rows = word_spans(data, offsets)
        words = word_hashes(data, starts, ends, fold=True)
        grams = np.zeros(0, U64)
        if len(words) >= n:
            grams = sum((words[k : len(words) - n + 1 + k] * weights[k] for k in range(1, n)), words[: len(words) - n + 1] * weights[0])
            grams = mix64(grams)
        for row in range(hi - lo):
            a, b = rows[row], rows[row + 1]
            if b - a >= n:
                own = np.sort(grams[a : b - n + 1])
                yield lo + row, own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own
            elif b > a:
                yield lo + row, mix64((words[a:b] * weights[: b - a]).sum(keepdims=True, dtype=U64) + weights[n] * U64(b - a))
            else:
                yield lo + row, words[:0]


def prefix_size(n: int, t: Fraction) -> int:
    return n - -(-n * t.numerator // t.denominator) + 1


def _buckets(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> U64(64 - bits)).astype(np.int64)


def _print(own: np.ndarray, seed: int = 0xE7037ED1A0B428DB) -> int:
    """A 64-bit fingerprint of a set; two of them, with the set's size, stand for the set."""
    return int(mix64(own * U64(0xA0761D6478BD642F) + U64(seed)).sum(dtype=U64).astype(np.int64))


def bitmap(own: np.ndarray) -> bytes:
    """The parity of the set's hashes in each of 4 to 8 cells a member; folding halves keeps it a parity bitmap."""
    size = max(64, 1 << (4 * len(own) - 1).bit_length()) if len(own) else 64
    return np.packbits(np.bincount((own & U64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps folded to width bytes."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, width), axis=1)


def _differences(x: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """For each row of maps a lower bound of the symmetric difference with x."""
    width = min(len(x), maps.shape[1])
    return np.bitwise_count(_folded(x[None, :], width) ^ _folded(maps, width)).sum(axis=1, dtype=np.int64)


def _enough(na, nb, t: Fraction):
    """The smallest intersection with similarity t: the least integer o with o * (1 + t) >= t * (na + nb)."""
    p, q = t.numerator, t.denominator
    return -(-(na + nb) * p // (p + q))


def _alike(na, nb, t: Fraction):
    return np.minimum(na, nb) * t.denominator >= np.maximum(na, nb) * t.numerator


def _met(na, nb, t: Fraction):
    """At how many n-grams at least the prefixes of two similar sets meet."""
    spare = lambda n: 1 - (-(-n * t.numerator // t.denominator))
    return np.minimum(spare(na), spare(nb)) + _enough(na, nb, t)


def _cell_pairs(t: Fraction, most: int):
    """Rows of cells (a, class, strong, i, j), first members that stand apart (role 0), then others: for each apart one
    the most likely links to other components, and whether there are more of them."""

    def emit(rows):
        left, right = [r for r in rows if r[5] == 0], [r for r in rows if r[5] == 1]
        out = []
        if not left or not right:
            return out
        node, n, label, rest, many = (np.array([r[k] for r in right], np.int64) for k in range(6, 11))
        width = np.array([len(r[11]) for r in right])
        groups = [(at := np.flatnonzero(width == w), np.frombuffer(b"".join(right[i][11] for i in at), np.uint8).reshape(len(at), -1)) for w in np.unique(width)]
        for r in left:
            x, nx, lx, rx, cx, mx = *r[6:11], np.frombuffer(r[11], np.uint8)
            met, gaps = [], []
            for at, maps in groups:
                ok = (label[at] != lx) & _alike(n[at], nx, t) & (np.minimum(rest[at], rx) >= _enough(n[at], nx, t)) & (np.minimum(many[at], cx) >= _met(n[at], nx, t))
                some = np.flatnonzero(ok)
                if len(some):
                    gap = _differences(mx, maps[some])
                    able = n[at[some]] + nx - gap >= 2 * _enough(n[at[some]], nx, t)  # the intersection is at most half of that
                    met.append(at[some][able])
                    gaps.append(gap[able])
            if met:
                met, gaps = np.concatenate(met), np.concatenate(gaps)
                order = np.lexsort((node[met], gaps / (n[met] + nx)))[:most]
                for k in met[order].tolist():
                    out.append((r[0], min(x, int(node[k])), max(x, int(node[k])), len(met) > most))
        return out

    def batch_of(out):
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(columns[k], pa.int64()) for k in range(3)), pa.array(columns[3], pa.bool_())], ["lead", "a", "b", "more"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(12)), strict=True):
                if row[:5] != key:
                    if out := emit(rows):
                        yield batch_of(out)
                    key, rows = row[:5], []
                rows.append(row)
        if out := emit(rows):
            yield batch_of(out)

    return run


def _summaries(n: int, bits: int):
    """A row for each document, and this task's share of the frequency table in chunks."""

    def run(batches):
        counts = np.zeros(1 << bits, np.int64)

        def add(held):
            cells, times = np.unique(np.concatenate(held), return_counts=True)
            counts[cells] += times

        held, waiting = [], 0
        for batch in batches:
            size, mark, more = (np.zeros(len(batch), np.int64) for _ in range(3))
            for row, own in sets_of(batch.column(1), n):
                size[row] = len(own)
                if len(own):
                    mark[row], more[row] = _print(own), _print(own, 0x8EBC6AF09C88C6E3)
                    held.append(_buckets(own, bits))
                    waiting += len(own)
                if waiting > 1 << 20:
                    add(held)
                    held, waiting = [], 0
            none = pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(mark), pa.array(more), none, pa.nulls(len(batch), pa.binary())], ["doc_id", "n", "mark", "more", "chunk", "counts"])
        if held:
            add(held)
        used = np.flatnonzero(counts.reshape(-1, CHUNK).any(axis=1))
        if len(used):
            rows = counts.reshape(-1, CHUNK)[used]
            none = pa.nulls(len(used), pa.int64())
            small = np.uint8 if rows.max() < 1 << 8 else np.uint16 if rows.max() < 1 << 16 else np.int64
            blobs = [pa.compress(r.astype(small).tobytes(), "zstd", asbytes=True) for r in rows]
            sizes = pa.array(np.full(len(used), np.dtype(small).itemsize))
            yield pa.RecordBatch.from_arrays([none, sizes, none, none, pa.array(used), pa.array(blobs, pa.binary())], ["doc_id", "n", "mark", "more", "chunk", "counts"])

    return run


def _total(batches):
    """Sums a chunk's shares as they stream by."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, width, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kind = {1: np.uint8, 2: np.uint16, 8: np.int64}[width]
            part = np.frombuffer(pa.decompress(blob, CHUNK * width, "zstd", asbytes=True), kind)
            sums[chunk] = sums[chunk] + part if chunk in sums else part.astype(np.int64)
    if sums:
        levels = [np.minimum(255, 6 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(levels, pa.binary())], ["chunk", "levels"])


def _prefixes(n: int, t: Fraction, bits: int, levels, hot: int):
    """(n-gram, set's fingerprint, set's size and place in the order, share) for the prefix of each set that is new to the
    task.  share deals the sets of a hot n-gram to several tasks; it is -1 for the others."""

    def run(batches):
        rank = np.frombuffer(levels.value, np.uint8)
        shares = (2.0 ** (np.arange(256) / 6) / hot).astype(np.int64)  # of each level
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for _, own in sets_of(batch.column(0), n):
                if not len(own):
                    continue
                mark = _print(own)
                if (mark, len(own)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add((mark, len(own)))
                k = prefix_size(len(own), t)
                level = rank[_buckets(own, bits)]
                if k < len(own):
                    top = np.flatnonzero(level <= np.partition(level, k - 1)[k - 1])
                else:
                    top = np.arange(len(own))
                top = top[np.argsort(level[top], kind="stable")][:k]  # own is sorted, so ties stand by hash
                dealt = shares[level[top]]
                out[0].append(signed(own[top]))
                out[1].append(np.full(k, mark))
                out[2].append(len(own) << 32 | np.arange(k))
                out[3].append(np.where(dealt > 0, (mark & 0x7FFFFFFF) % np.maximum(dealt, 1), -1).astype(np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["gram", "mark", "at", "share"])

    return run


STARS = "gram long, la long, na long, lb long, nb long, kind long, times long, good long, rest long"
PAIR, MEMBER, COUNT = 0, 1, 2


def _merged(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Equal (gram, la, na, lb, nb, kind) as one row: times are summed, good and rest are the greatest."""
    columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
    same = mix64(sum((x.view(U64) * w for x, w in zip(columns[:6], constants(11, 6), strict=True)), np.zeros(len(columns[0]), U64)))
    order = np.argsort(same, kind="stable")
    columns = [x[order] for x in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns[:6]], axis=0)
    first = np.flatnonzero(new)
    values = [np.add.reduceat(columns[6], first), np.maximum.reduceat(columns[7], first), np.maximum.reduceat(columns[8], first)] if len(first) else columns[6:]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*(c[first] for c in columns[:6]), *values)], [x.split()[0] for x in STARS.split(", ")])


def _stars(t: Fraction, part: int):
    """Rows sorted by n-gram, share and fingerprint to pairs of sets, as rows of STARS.

    An n-gram of at most FEW sets pairs all of them that are of like size (PAIR); good: whether one place allows the
    similarity.  With more sets, those that can have a partner there become members of a leader (MEMBER), with
    the n-grams that they have left (rest), and the place counts for each set (COUNT).  For a hot n-gram, gram names it."""

    def pairs(gram, mark, n, pos, share, open_):
        """Of whole n-grams; open_: the first one comes in parts, each of which begins with the n-gram's first row."""

        def grouped():
            first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (share[1:] != share[:-1])))
            group = np.cumsum(first) - 1
            return np.flatnonzero(first), group, np.bincount(group)

        keep = np.ones(len(gram), bool)  # copies of a set from several tasks stand together
        keep[1:] = (gram[1:] != gram[:-1]) | (mark[1:] != mark[:-1]) | (n[1:] != n[:-1])
        gram, mark, n, pos, share = (x[keep] for x in (gram, mark, n, pos, share))
        first, group, size = grouped()
        place = np.arange(len(gram)) - first[group]
        cut = (group == 0) & open_
        many = (size[group] > FEW) | (share >= 0) | cut
        found = []
        for step in range(1, FEW):
            b = np.flatnonzero(~many & (place >= step))
            if not len(b):
                break
            a = b - step
            like = _alike(n[a], n[b], t)
            a, b = a[like], b[like]
            good = 1 + np.minimum(n[a] - pos[a] - 1, n[b] - pos[b] - 1) >= _enough(n[a], n[b], t)
            zero = np.zeros(len(a), np.int64)
            found.append((zero, mark[a], n[a], mark[b], n[b], zero + PAIR, zero + 1, good.astype(np.int64), zero))
        at = np.flatnonzero(many)
        zero = np.zeros(len(at), np.int64)
        counts = (zero, zero, zero, mark[at], n[at], zero + COUNT, zero + 1, zero, zero)
        rest = n - pos
        strong = rest >= _enough(n, n, t)
        keep = many & ((share >= 0) | cut | _partnered(group, n, strong, t))
        gram, mark, n, share, rest, strong, cut = (x[keep] for x in (gram, mark, n, share, rest, strong, cut))
        if len(gram):
            first, group, size = grouped()
            # The leader is the first strong set; a part's first row stays it for all parts.
            lead = np.minimum.reduceat(np.where(strong & ~cut, np.arange(len(gram)), len(gram)), first)
            lead = np.where(lead < len(gram), lead, first)[group]
            hot = np.where(share >= 0, gram, 0)
            zero = np.zeros(len(gram), np.int64)
            good = (np.minimum(rest[lead], rest) >= _enough(n[lead], n, t)) & _alike(n[lead], n, t)
            found.append((hot, mark[lead], n[lead], mark, n, zero + MEMBER, zero, good.astype(np.int64), rest))
        return found, counts

    def run(batches):
        rest, open_ = tuple(np.zeros(0, np.int64) for _ in range(5)), False
        counted, waiting = [], 0
        for batch in batches:
            columns = [batch.column(k).to_numpy().astype(np.int64) for k in range(4)]
            columns = (columns[0], columns[1], columns[2] >> 32, columns[2] & 0xFFFFFFFF, columns[3])
            rows = tuple(np.concatenate(x) for x in zip(rest, columns, strict=True))
            if not len(rows[0]):
                continue
            same = (rows[0] == rows[0][-1]) & (rows[4] == rows[4][-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            results = []
            if last:  # all n-grams but the last one are whole
                results.append(pairs(*(x[:last] for x in rows), open_))
                open_ = False
            rest = tuple(x[last:] for x in rows)
            if len(rest[0]) > part:  # a very frequent n-gram goes in parts, its first set with each
                results.append(pairs(*rest, True))
                rest, open_ = tuple(x[:1] for x in rest), True
            for found, counts in results:
                if found:
                    yield _merged(found)
                counted.append(counts)
                waiting += len(counts[0])
            if waiting > 1 << 20:
                yield _merged(counted)
                counted, waiting = [], 0
        if len(rest[0]):
            found, counts = pairs(*rest, open_)
            if found:
                yield _merged(found)
            counted.append(counts)
        if counted:
            yield _merged(counted)

    return run


def _partnered(group: np.ndarray, n: np.ndarray, strong: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether a set's group has another set of like size, not both of them weak."""
    p, q = t.numerator, t.denominator
    low, high = -(-n * p // q), n * q // p
    out = np.zeros(len(n), bool)
    for own, others in ((strong, np.ones(len(n), bool)), (~strong, strong)):
        keys = np.sort(group[others] << 32 | n[others])
        met = np.searchsorted(keys, group << 32 | np.minimum(high, 0xFFFFFFFF), side="right") - np.searchsorted(keys, group << 32 | low, side="left")
        out |= own & (met > (own & others))
    return out


def _may_reach(a: np.ndarray, b: np.ndarray, need: int, depth: int = 3) -> bool:
    """Suffix filter: halving b by its middle value bounds the intersection from above."""

    def bound(a, b, depth):
        if not len(a) or not len(b):
            return 0
        if not depth:
            return min(len(a), len(b))
        middle = len(b) // 2
        at = int(np.searchsorted(a, b[middle]))
        met = int(at < len(a) and a[at] == b[middle])
        return met + bound(a[:at], b[:middle], depth - 1) + bound(a[at + met :], b[middle + 1 :], depth - 1)

    return bound(a, b, depth) >= need


def similar(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    need = _enough(len(a), len(b), t)
    if min(len(a), len(b)) < need or not _may_reach(a, b, need):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum()) >= need


def _verified(n: int, t: Fraction):
    """Rows sorted by leader and share, the leader's own text first."""

    def run(batches):
        key, leaders = None, []
        for batch in batches:
            left, share, member, role = (batch.column(k).to_pylist() for k in range(4))
            a, b = [], []
            for row, own in sets_of(batch.column(4), n):
                if role[row] == 0:
                    if key != (left[row], share[row]):
                        key, leaders = (left[row], share[row]), []
                    leaders.append(own)
                elif key == (left[row], share[row]) and any(similar(x, own, t) for x in leaders):
                    a.append(left[row])
                    b.append(member[row])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified_pairs(docs: DataFrame, pairs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts reach the similarity.  Texts move once to meet the requests for
    them and once to the leaders; a leader of many members is copied for each LEADER_SHARE of them."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_SHARE).alias("shares"))
    dealt = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), "b")
    members = dealt.select(F.col("b").alias("want"), "a", "share", "b", F.lit(1).alias("role"))
    leaders = dealt.select(F.col("a").alias("want"), "a", "share", F.col("a").alias("b"), F.lit(0).alias("role")).distinct()
    wanted = members.unionByName(leaders)
    met = wanted.join(docs.select(F.col("doc_id").alias("want"), "text"), "want").select("a", "share", "b", "role", "text")
    laid = met.repartition("a", "share").sortWithinPartitions("a", "share", "role")
    return laid.mapInArrow(_verified(n, t), "a long, b long")


def _forest(batches):
    """Joins the edges that one task reads: (node, smallest node that they connect it to)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component: its smallest node) for all nodes of the stored edges (a, b).

    Tasks join the edges they read, FOREST_ROWS each; what several tasks found is laid together by steps
    of a large and a small star, which only aggregate minima and join them back, so that a hub
    needs no gathered list, until one task is enough or nothing changes."""
    before = None
    while True:
        rows = edges.count()
        tasks = max(1, -(-rows // FOREST_ROWS))
        e = edges.coalesce(tasks).mapInArrow(_forest, "a long, b long")
        if tasks == 1:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))  # small star: to the least of a node's lower neighbours
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x"))
        edges = e = stored(small.select("x.a", "x.b").where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), "b")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _mapped(n: int):
    """Texts with the fingerprint and the bitmap of their sets."""

    def run(batches):
        for batch in batches:
            marks, maps = np.zeros(len(batch), np.int64), [b""] * len(batch)
            for row, own in sets_of(batch.column(1), n):
                if len(own):
                    marks[row], maps[row] = _print(own), bitmap(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks), pa.array(maps, pa.binary())], ["doc_id", "text", "mark", "map"])

    return run


def _table_bits(docs: DataFrame, n: int) -> int:
    """The frequency table's size for the n-grams of all documents, at about six bytes a word."""
    grams = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    return min(MOST_BITS, max(LEAST_BITS, (grams // 64).bit_length()))


def candidates(stars: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """Of stored STARS the pairs (ma, na, mb, nb) to verify, and the members (la, na, lb, nb, rest, many) of leaders."""
    p, q = t.numerator, t.denominator
    members = stars.where(f"kind = {MEMBER}")
    # The shares of a hot n-gram each have a leader of their own: the least of these leads them all.
    hot = members.where("gram <> 0")
    heads = hot.groupBy("gram").agg(F.min(F.struct("la", "na")).alias("head"))
    hot = hot.join(heads, "gram").select(F.col("head.la").alias("la"), F.col("head.na").alias("na"), "lb", "nb", F.lit(1).cast("long").alias("good"), "rest")
    members = members.where("gram = 0").select("la", "na", "lb", "nb", "good", "rest").unionByName(hot)
    many = stars.where(f"kind = {COUNT}").groupBy("lb", "nb").agg(F.sum("times").alias("many"))
    both = stars.where(f"kind = {PAIR}").select("la", "na", "lb", "nb", "good", "times").unionByName(members.where("la <> lb or na <> nb").select("la", "na", "lb", "nb", "good", F.lit(0).cast("long").alias("times")))
    one, two = F.struct(F.col("la").alias("m"), F.col("na").alias("n")), F.struct(F.col("lb").alias("m"), F.col("nb").alias("n"))
    led = F.when(F.col("times") == 0, one)
    both = both.groupBy(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).agg(F.sum("times").alias("times"), F.max("good").alias("good"), F.max(led).alias("led"))
    turned = F.coalesce(F.col("led") == F.col("y"), F.lit(False))  # a leader comes first, so that its text meets those of its members
    both = both.select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("one"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("two"), "times", "good")
    both = both.select(F.col("one.m").alias("ma"), F.col("one.n").alias("na"), F.col("two.m").alias("mb"), F.col("two.n").alias("nb"), "times", "good")
    for side in "ab":
        both = both.join(many.select(F.col("lb").alias(f"m{side}"), F.col("nb").alias(f"n{side}"), F.col("many").alias(f"many_{side}")), [f"m{side}", f"n{side}"], "left")
    both = both.withColumn("many", F.coalesce(F.least(F.coalesce("many_a", F.lit(0)), F.coalesce("many_b", F.lit(0))), F.lit(0)))
    spare = lambda c: f"(1 - ({c} * {p} + {q - 1}) div {q})"
    least = F.expr(f"least({spare('na')}, {spare('nb')}) + ((na + nb) * {p} + {p + q - 1}) div {p + q}")
    both = both.where(((F.col("good") == 1) | (F.col("many") > 0)) & (F.col("times") + F.col("many") >= least))
    members = members.groupBy("la", "na", "lb", "nb").agg(F.max("rest").alias("rest")).join(many, ["lb", "nb"])
    return both.select("ma", "na", "mb", "nb"), members


def _apart(group: DataFrame, of: DataFrame, t: Fraction) -> DataFrame:
    """Rows of cells (a, class, strong, i, j, role, x, n, label, rest, many) for the leaders' members that stand apart."""
    label = of.select(F.col("node").alias("x"), F.col("component").alias("label"))
    lead = of.select(F.col("node").alias("a"), F.col("component").alias("lead"))
    known = group.join(label, "x", "left").join(lead, "a", "left").withColumns({"label": F.coalesce("label", "x"), "lead": F.coalesce("lead", "a")})
    step = float(np.log(1 / float(t)) * 1.0001)  # sizes that may be similar lie in one class or in neighbours
    enough = F.expr(f"(2 * n * {t.numerator} + {t.numerator + t.denominator - 1}) div {t.numerator + t.denominator}")
    known = known.withColumns({"class": F.floor(F.log(F.col("n").cast("double")) / step).cast("int"), "strong": F.col("rest") >= enough})
    room = F.greatest(F.lit(32.0), F.least(F.lit(float(CELL_ROWS)), CELL_BYTES / F.exp((F.col("class") + 1) * step)))
    near = F.explode(F.array(*(F.struct((F.col("class") + d).alias("class"), F.lit(s).alias("strong")) for d in (-1, 0, 1) for s in (True, False)))).alias("to")
    left = known.where("label <> lead").select("a", near, "x", "mark", "n", "label", "rest", "many", F.col("strong").alias("own")).where("to.strong or own")
    left = left.select("a", "to.class", "to.strong", "x", "mark", "n", "label", "rest", "many")
    right = known.select("a", "class", "strong", "x", "mark", "n", "label", "rest", "many")
    key = ["a", "class", "strong"]
    sides = left.groupBy(key).agg(F.count("*").alias("l"), F.lit(0).alias("r")).unionByName(right.groupBy(key).agg(F.lit(0).alias("l"), F.count("*").alias("r"))).groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    sides = sides.where("l > 0 and r > 0").select(*key, F.ceil(F.col("l") / room).alias("is"), F.ceil(F.col("r") / room).alias("js"))
    spot, all_ = F.xxhash64("x"), lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    held = ["x", "mark", "n", "label", "rest", "many"]
    left = left.join(sides, key).select(*key, F.pmod(spot, "is").alias("i"), all_("js").alias("j"), F.lit(0).alias("role"), *held)
    right = right.join(sides, key).select(*key, all_("is").alias("i"), F.pmod(spot, "js").alias("j"), F.lit(1).alias("role"), *held)
    return left.unionByName(right)


def linked_documents(documents: DataFrame, n: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """doc_id, n_shingles and component_id of each document.

    Words are compared with A-Z folded.  A null, empty or blank text has no n-gram and is linked with
    nothing; a text of fewer than n words is one n-gram of its own.  Equal sets always link.  Rows
    that share a doc_id are one document to link: each of their texts is compared, and each row is
    returned. A null doc_id takes the component of an equal set, else null.
    An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    t = threshold
    bits = _table_bits(docs, n)
    first = stored(docs.mapInArrow(_summaries(n, bits), "doc_id long, n long, mark long, more long, chunk long, counts binary"), "sets")
    shares = first.where("chunk is not null").select("chunk", "n", "counts")
    levels = bytearray(1 << bits)
    for chunk, part in shares.repartition("chunk").mapInArrow(_total, "chunk long, levels binary").collect():
        levels[chunk * CHUNK : (chunk + 1) * CHUNK] = part
    table = docs.sparkSession.sparkContext.broadcast(bytes(levels))
    size = first.where("chunk is null").select("doc_id", "n", "mark", "more")
    named = size.where("n > 0").groupBy("mark", "more", "n").agg(F.min("doc_id").alias("node"))

    # Sets of rows without an id have no node: none of them may lead an n-gram's group.
    laid = docs.where("doc_id is not null").select("text").mapInArrow(_prefixes(n, t, bits, table, HOT), "gram long, mark long, at long, share int")
    laid = laid.repartition("gram", "share").sortWithinPartitions("gram", "share", "mark")
    stars = laid.mapInArrow(_stars(t, PART), STARS).groupBy("gram", "la", "na", "lb", "nb", "kind").agg(F.sum("times").alias("times"), F.max("good").alias("good"), F.max("rest").alias("rest"))
    stars = stored(stars, "stars")
    both, members = candidates(stars, t)
    a, b = (named.select(F.col("mark").alias(f"m{x}"), F.col("n").alias(f"n{x}"), F.col("node").alias(x)) for x in "ab")
    tested = both.join(a, ["ma", "na"]).join(b, ["mb", "nb"]).where("a <> b")
    tested = tested.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("a").alias("a"))
    tested = stored(tested.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"), "x", "y"), "tested")
    a, b = (named.select(F.col("mark").alias(f"l{x}"), F.col("n").alias(f"n{x}"), F.col("node").alias(node)) for x, node in (("a", "a"), ("b", "x")))
    group = stored(members.join(a, ["la", "na"]).join(b, ["lb", "nb"]).select("a", "x", F.col("lb").alias("mark"), F.col("nb").alias("n"), "rest", "many"), "group")
    dropped(stars)
    # Texts of all that may link move once, whatever their number; later rounds read only these.
    nodes = tested.select("a").union(tested.select("b")).union(group.select("x")).distinct()
    texts = docs.hint("merge").join(nodes.withColumnRenamed("a", "doc_id"), "doc_id").select("doc_id", "text")
    texts = stored(texts.mapInArrow(_mapped(n), "doc_id long, text string, mark long, map binary"), "texts")
    links = stored(verified_pairs(texts, tested.select("a", "b"), n, t), "links")
    known = tested.select(F.col("x").alias("a"), F.col("y").alias("b"))
    of = stored(components(links), "components")

    most = 2
    while True:
        cells = stored(_apart(group, of, t), "cells")
        maps = texts.select(F.col("doc_id").alias("x"), "mark", "map").join(cells.select("x", "mark").distinct(), ["x", "mark"], "left_semi").dropDuplicates(["x", "mark"])
        laid = cells.join(maps, ["x", "mark"]).select("a", "class", F.col("strong").cast("int").alias("strong"), "i", "j", "role", "x", "n", "label", "rest", "many", "map")
        laid = laid.repartition("a", "class", "strong", "i", "j").sortWithinPartitions("a", "class", "strong", "i", "j", "role")
        found = stored(laid.mapInArrow(_cell_pairs(t, most), "lead long, a long, b long, more boolean"), "found")
        fresh = stored(found.select("a", "b").distinct().join(known, ["a", "b"], "left_anti"), "fresh")
        if not fresh.isEmpty():
            before, links = links, stored(links.union(verified_pairs(texts, fresh, n, t)), "links")
            dropped(before, of)
            known = known.union(fresh)
            of = stored(components(links), "components")
        unsure = found.where("more").select(F.col("lead").alias("a")).distinct()
        if unsure.isEmpty():
            break
        group = stored(group.join(unsure, "a", "left_semi"), "group")  # only leaders with more candidates than were verified
        dropped(cells)
        most *= 64
    dropped(texts)

    held = size.join(named, ["mark", "more", "n"], "left").select("doc_id", "n", F.coalesce("node", "doc_id").alias("node"))
    return held.join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def distinct_documents(documents: DataFrame, n: int = 5, threshold: Fraction = Fraction(3, 4)) -> DataFrame:
    """The rows of documents whose doc_id is the smallest of its component; rows with a null id stay, and repeated rows of what stays."""
    links, name = linked_documents(documents, n, threshold), fresh(documents, "attestry_gone")
    gone = links.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return documents.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
