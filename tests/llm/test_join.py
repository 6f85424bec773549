"""The n-gram join against brute force where its n-grams are frequent, and words that collide under weaker hashes."""

import random

import pyarrow as pa
import pytest

from attestry.llm import kernel, ngram_join


def mirrored(k):
    """A word of 2 ** k letters in the Thue-Morse pattern, and its mirror."""
    bits = [bin(i).count("1") % 2 for i in range(1 << k)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def brute(rows):
    """component_id by id of rows (id, text)."""
    sets = {}
    for i, text in rows:
        x = text.lower().split()
        sets.setdefault(i, []).append({tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set())
    up = {i: i for i in sets}
    ids = sorted(up)
    for a in ids:
        for b in ids[: ids.index(a)]:
            if up[a] != up[b] and any(s & q and 100 * len(s & q) >= 75 * len(s | q) for s in sets[a] for q in sets[b]):
                low, high = sorted((up[a], up[b]))
                up = {i: low if u == high else u for i, u in up.items()}
    return up


@pytest.mark.parametrize("hot,part", [(50_000, 16_384), (2, 16_384), (2, 12), (50_000, 12)])
def test_frequent_ngrams(spark, monkeypatch, hot, part):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "PART", part)
    rng = random.Random(hot + part)
    passages = [[f"p{p}w{k}" for k in range(rng.randint(6, 14))] for p in range(6)]
    rows = []
    for i in range(330):
        x = sum((passages[p] for p in rng.sample(range(6), rng.randint(1, 5))), []) if i % 3 or not rows else rows[-1][1].split()
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice(["new", f"n{i}", "p0w1"])
        x += [f"own{i}x{k}" for k in range(rng.choice([0, 0, 1, 2, 5]))]
        rows.append((i if i % 50 else 7, " ".join(x)))
    got = {r.doc_id: r.component_id for r in ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_common_line_in_unlike_texts(spark):
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(1 + i % 7)), "all rights reserved by us", *(f"b{i}x{k}" for k in range(i % 5))])) for i in range(2000)]
    got = ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 2000 and all(r.doc_id == r.component_id for r in got)


def test_weak_sets_pair_nothing():
    """Sets whose n-gram stands at a place past 1 / 7 of them make no member rows, whatever their number."""
    n = 50
    gram, mark = pa.array([5] * n), pa.array(range(n))
    rows = pa.RecordBatch.from_arrays([gram, mark, pa.array([100 << 32 | 20] * n), pa.array([-1] * n, pa.int32())], ["gram", "mark", "at", "share"])
    out = [r for b in ngram_join._stars(ngram_join.Fraction(3, 4), 1000)([rows]) for r in b.to_pylist()]
    assert len(out) == n and all(r["kind"] == ngram_join.COUNT for r in out)


def test_patterned_words_differ(spark):
    a, b = mirrored(11)
    for texts in ((a, b), ("a" * 5000, "a" * 5001)):
        words = []
        for _, _, data, offsets in kernel.slices(pa.array(texts)):
            starts, ends, _ = kernel.word_spans(data, offsets)
            words += kernel.word_hashes(data, starts, ends).tolist()
        assert len(set(words)) == 2
    rest = [f"w{k}" for k in range(34)]
    rows = [(0, " ".join(rest[:17] + [a] + rest[17:])), (1, " ".join(rest[:17] + [b] + rest[17:])), (2, a), (3, b)]
    got = {r.doc_id: r.component_id for r in ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}
