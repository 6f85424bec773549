"""Importance resampling, phrase search and spelling groups against brute force, and odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from attestry.llm import importance, phrase_index, spelling

SHAPE = "doc_id long, text string, row long, part long, n long, word string, key string, item_id long, segment long, start long, rank long, all string, id long"


def table(spark, rows):
    """(doc_id, text) with columns named as the operators' own."""
    return spark.createDataFrame([(i, t, 9, 9, 9, "w", "k", 9, 9, 9, 9, "a", 9) for i, t in rows], SHAPE)


def alnum(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(7)
    words = "the of And être naïve 12 x-ray Ünder a ab".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(45)))) for k in range(60)]
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(60_000))
    return rows + [(60, None), (61, ""), (62, " \t.,"), (None, rows[3][1]), (None, rows[4][1]), (5, rows[5][1]), (5, "other text"), (63, long), (64, "x" * 300_000)]


def test_ring_extends_states():
    text = "One two THREE four two ünder " * 9000  # beyond a block of words
    words = alnum(text)
    n, found = importance.run_buckets(text, 4, 10_000)
    runs = [b" ".join(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1)]
    assert n == len(words) and collections.Counter(found.tolist()) == collections.Counter(zlib.crc32(x) % 10_000 for x in runs)
    ring, split = importance.Ring(3), []
    for w in words[:7]:
        split += [s for own in ring.extend([w]) for s in own]
    assert sorted(split) == sorted(zlib.crc32(b" ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(8 - k))


def test_importance_equals_brute_force(spark, odd_rows):
    target = [(1, "être the naïve of"), (2, None), (3, "x-ray 12")]
    runs = lambda t: [b" ".join(w[i : i + k]) for w in [alnum(t)] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    s = collections.Counter(zlib.crc32(r) % 10_000 for _, t in odd_rows for r in runs(t))
    t_ = collections.Counter(zlib.crc32(r) % 10_000 for _, t in target for r in runs(t))
    s_all, t_all = s.total() + 10_000, t_.total() + 10_000
    gain = lambda b: math.floor(1000 * math.log((t_[b] + 1) * s_all / ((s[b] + 1) * t_all)))
    want = []
    for i, text in odd_rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(r) % 10_000) for r in runs(text))
        want.append([i, len(alnum(text)), len(runs(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    for percent in (5, 60):
        drawn = [(r[0], r[4], k + 1) for k, r in enumerate(able[: percent * len(able) // 100])]
        got = importance.resampled(table(spark, odd_rows), table(spark, target), percent=percent).collect()
        assert sorted(map(repr, ([r.doc_id, r.n_words, r.n_features, r.weight, r.score] for r in got))) == sorted(map(repr, want))
        assert sorted(((r.doc_id, r.score, r["rank"]) for r in got if r["rank"]), key=lambda r: r[2]) == drawn
    docs = table(spark, odd_rows)
    out = importance.drawn_documents(docs, table(spark, target), percent=60)
    assert out.columns == docs.columns and out.count() == len(drawn)
    assert importance.resampled(docs.limit(0), table(spark, target)).count() == 0
    assert importance.resampled(docs, table(spark, target).limit(0)).count() == len(odd_rows)


def test_ranks_of_equal_rows(spark):
    """Thousands of rows that share id and score are parted by their numbers."""
    rows = spark.range(4000).select(F.col("id").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("n_features"), F.lit(5).cast("long").alias("score"))
    assert [r["rank"] for r in importance.ranked(rows, 1500).orderBy("rank").collect()] == list(range(1, 1501))


def contaminated(docs, items, width):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[k : k + width])].add(i)
    sizes, out = {len(w) for w in windows}, []
    for i, t in docs:
        w, hit, met = alnum(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    met |= windows[tuple(w[k : k + n])]
        names = sorted(str(x) for x in met if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(phrase_index, "SEGMENT_BYTES", 3000)
    monkeypatch.setattr(phrase_index, "BLOCK_WORDS", 60)
    monkeypatch.setattr(phrase_index, "ITEM_WORDS", 40)
    monkeypatch.setattr(phrase_index, "CANDIDATES", 50)


def test_contamination_equals_brute_force(spark, odd_rows, small_blocks):
    long = odd_rows[67][1].split()
    items = [(1, odd_rows[10][1]), (2, "the of"), (2, "naïve ÊTRE"), (3, None), (4, " "), (None, odd_rows[20][1]), (10, " ".join(long[500:640])), (11, "of of of of of of of of of of of"), (12, odd_rows[30][1])]
    for width in (2, 10):
        got = phrase_index.contaminated_documents(table(spark, odd_rows), spark.createDataFrame(items, "item_id long, text string"), width)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, contaminated(odd_rows, items, width)))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert phrase_index.contaminated_documents(table(spark, odd_rows), empty).where("n_hit = 0 and not contaminated").count() == len(odd_rows)
    assert phrase_index.contaminated_documents(table(spark, []), empty).count() == 0


def test_blocks_give_what_one_block_gives(spark, odd_rows, small_blocks):
    docs, items = table(spark, odd_rows), spark.createDataFrame([(k, t) for k, t in odd_rows[:25]], "item_id long, text string")
    some = phrase_index.contaminated_documents(docs, items, 6).collect()
    phrase_index.BLOCK_WORDS = 1 << 19
    assert sorted(map(repr, some)) == sorted(map(repr, phrase_index.contaminated_documents(docs, items, 6).collect()))


def test_proximity_equals_brute_force(spark, odd_rows):
    items = [(1, "the of naïve"), (2, "12 x ray"), (3, "a absent word"), (4, "w1 w2 w3")]
    index = phrase_index.positional_index(table(spark, odd_rows))
    got = phrase_index.proximity_matches(index, spark.createDataFrame(items, "item_id long, text string"), width=3, slop=4).where("met")
    want = []
    for i, text in odd_rows:
        w = alnum(text)
        for item, phrase in items:
            asked = set(alnum(phrase))
            for k, x in enumerate(w):
                if x in asked:
                    ends = [e for e in range(k + 1, min(k + 7, len(w)) + 1) if asked <= set(w[k:e])]
                    want += [(i, item, k, ends[0])] if ends else []
    assert want and sorted(map(repr, ((r.doc_id, r.item_id, r.start, r.end) for r in got.collect()))) == sorted(map(repr, want))


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    stem = ["étoiles", "colours", "aaaaaaa", "abababab", "word"]
    words = {w for s in stem for _ in range(160) for w in ["".join(rng.choice("abcoé") if rng.random() < 0.2 else c for c in s)[: rng.randrange(5, 9)] + rng.choice(["", "a", "s"])]}
    words |= {f"prefixshared{a}{b}" for a in "abcdefgh" for b in "abcdefgh"} | {"z" * 400, "z" * 401}
    want = {tuple(sorted((a, b))) for a in words for b in words if a < b and one_edit(a, b)}
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    for crowd in (1, 40, 10**9):
        got = spelling.near_pairs(df, crowd).collect()
        assert len(got) == len(want) and {tuple(sorted((r.a, r.b))) for r in got} == want
        assert all(r.a_n == len(r.a) and r.b_n == len(r.b) for r in got)


def test_spelling_groups_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["colour", "honour", "théâtre", "letters", "NATION", "groups", "ÉTOILE", "x×y÷zab"]
    vary = lambda w: w if rng.random() < 0.6 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "e", "u"]) + w[k + 1 :]
    rows = [(k if k % 9 else None, " ".join(vary(rng.choice(base)) for _ in range(60))) for k in range(80)]
    rows += [(5, rows[5][1]), (90, None), (91, ""), (92, "12 34"), (93, "q" * 200_000)] * 3
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[a-zà-ÿÀ-ß]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]] is not None:
            root[w] = form[root[w]]
    got = spelling.spelling_groups(table(spark, rows)).collect()
    assert any(form.values()) and any(form[w] and root[w] != form[w] for w in n)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((w, form[w], root[w], n[w], len(near[w]), n.get(form[w]))) for w in n)
    assert spelling.spelling_groups(table(spark, [])).count() == 0
