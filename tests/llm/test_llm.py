"""The operators against plain Python on small tables, with nulls, empty texts, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import itertools
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from attestry.llm import host_rules, media, mixing, ngram_join, packing, quality_model, queries, sharding, substrings, token_count, warc

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, name string, count long"


def table(spark, texts, sources="ab"):
    rows = [(i, t, "en", sources[i % len(sources)] if i % 11 else None, len(t or ""), "k", "n", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [rng.choice("abcdefghijklmnop") for _ in range(70)]
    out = [None, "", " \n\t", "one two", "One TWO", "a b c d e f", "<|endoftext|> x", "é" * 300, "w " * 400, "日本 語\n\nx"]
    for _ in range(90):
        x = list(base[: rng.randint(20, 70)])
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice("xyzXYZabc")
        out.append(" ".join(x) + ("\nline two\nline two" if rng.random() < 0.3 else ""))
    return out + out[10:14] + [" ".join(str(rng.random()) for _ in range(5000))]


def test_similar_documents(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_documents(table(spark, texts)).collect()}
    sets = []
    for t in texts:
        x = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(t)]
        sets.append({tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set())
    up = list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            met = len(sets[a] & sets[b])
            if met and 100 * met >= 75 * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    assert got == {i: (len(s), u) for i, (s, u) in enumerate(zip(sets, up, strict=True))}


def test_null_id_leads_no_group(spark):
    body = " ".join(f"w{k}" for k in range(60))
    texts = [f"{body} end{k}" for k in range(14)]
    prints = [ngram_join._print(own) for _, own in ngram_join.sets_of(pa.array(texts), 5)]
    led = prints.index(min(prints))
    rows = [(None if k == led else k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in ngram_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = sorted(k for k, _ in rows if k is not None)
    assert got == {None: None} | dict.fromkeys(ids, ids[0])


def test_bitmap_bounds_from_below():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate((a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64))))
        x, y = (np.frombuffer(ngram_join.bitmap(s), np.uint8) for s in (a, b))
        assert ngram_join._differences(x, y[None, :])[0] <= len(np.setxor1d(a, b))


def test_repeated_windows(spark, texts):
    texts = texts + ["x " * 90, "p q " * 50, "start " + " ".join("abcdefghijklmnop" * 3) + " end", " ".join("abcdefghijklmnop" * 3)]
    texts += [f"{k} lead " + "u v " * (60 + k) + f"cut {k} " + "u v " * 40 for k in range(3)] + ["1 2 3 " * 30 + "u v w"]
    got = sorted(tuple(r) for r in substrings.repeat_digests(table(spark, texts)).collect())
    starts = collections.Counter(tuple(x[k : k + 35]) for x in map(words, texts) for k in range(len(x) - 34))
    want = []
    for i, x in enumerate(map(words, texts)):
        gone = {p for k in range(len(x) - 34) if starts[tuple(x[k : k + 35])] > 1 for p in range(k, k + 35)}
        want.append((i, len(x), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(x) if k not in gone)).hexdigest()))
    assert got == want
    kept = {r.doc_id: r for r in substrings.without_repeats(table(spark, texts)).collect()}
    assert len(kept) == len(texts) and kept[1].text == "" and kept[0].text is None and kept[3].name == "n"
    assert all(hashlib.sha256(b" ".join(words(kept[i].text))).hexdigest() == h for i, _, _, h in want)


def test_repeats_of_shared_and_null_ids(spark):
    """Rows are judged by their own texts, whatever ids they share; words that collide in a weaker hash differ."""
    rng = random.Random(8)
    a, b, c = (" ".join(f"{x}{rng.random()}" for _ in range(60)) for x in "abc")
    bits = [bin(k).count("1") % 2 for k in range(1 << 11)]
    long = ["".join("ab"[k ^ flip] for k in bits) for flip in (0, 1)]
    near = [" ".join([f"w{k}" for k in range(17)] + [w] + [f"v{k}" for k in range(17)]) for w in long]
    rows = [(1, a), (1, b), (2, a + " tail"), (None, c), (None, near[0]), (4, near[1]), (5, None), (5, ""), (None, "x " + c), (6, "u " * 34), (6, "y " * 36)]
    starts = collections.Counter(tuple(x[k : k + 35]) for x in (words(t) for _, t in rows) for k in range(len(x) - 34))
    want = []
    for i, t in rows:
        x = words(t)
        gone = {p for k in range(len(x) - 34) if starts[tuple(x[k : k + 35])] > 1 for p in range(k, k + 35)}
        want.append((i, len(x), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(x) if k not in gone)).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in substrings.repeat_digests(docs).collect()))) == sorted(map(str, want))
    kept = substrings.without_repeats(docs).collect()
    assert sorted(hashlib.sha256(b" ".join(words(r.text))).hexdigest() for r in kept) == sorted(w[3] for w in want)


def test_mixing(spark, texts):
    rows = mixing.mixture(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["size"] == len(words(texts[r.doc_id])) and 0 <= r.taken <= 2 * r["size"]
        b = by[None if r.doc_id % 11 == 0 else "ab"[r.doc_id % 2]]
        b[0], b[1], b[2] = b[0] + r["size"], b[1] + r.taken, r.target
    assert all(abs(taken - goal) <= 1 for _, taken, goal in by.values())
    assert sum(b[2] for b in by.values()) == pytest.approx(1.5 * sum(b[0] for b in by.values()))
    assert mixing.targets([10, 100, 100], [5, 2, 1], 315) == pytest.approx([20, 590 / 3, 295 / 3])
    again = mixing.mixture(table(spark, texts)).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}
    mixed = collections.Counter()
    for r in mixing.mixed_documents(table(spark, texts)).collect():
        mixed[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in mixed.items()} == {r.doc_id: r.taken for r in rows if r.taken}


def test_mixing_draws_from_every_row(spark):
    rng = random.Random(3)
    rows = [([None, 7, k][k % 3], " ".join(f"r{k}w{n}" for n in range(rng.randint(1, 900))), "en", "ab"[k % 2], 0, "k", f"row {k}", 1) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    source, taken, of = {r[6]: r[3] for r in rows}, collections.Counter(), {r[6]: r for r in rows}
    mixed = mixing.mixed_documents(docs).collect()
    for r in mixed:
        assert r.doc_id == of[r.name][0] and len(words(r.text)) and set(words(r.text)) <= set(words(of[r.name][1]))
        taken[source[r.name]] += len(words(r.text))
    goal = {x: mixing.targets([sum(len(words(r[1])) for r in rows if r[3] == s) for s in "ab"], [5, 2], 1.5 * sum(len(words(r[1])) for r in rows))[k] for k, x in enumerate("ab")}
    assert all(abs(taken[x] - goal[x]) <= 1 for x in "ab")
    again = mixing.mixed_documents(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_splitting_tree_keeps_quotas():
    tree = mixing.Tree([700, 0, 311], 7, 3)
    shard = {k: tree.shard(np.full(n, k), np.arange(n)) for k, n in ((0, 700), (2, 311))}
    per = np.bincount(np.concatenate(list(shard.values())), minlength=7)
    assert per.sum() == 1011 and per.max() - per.min() <= 3


def test_splits_of_large_populations_are_exact():
    """Drawn by the rule for large populations, counts follow the hypergeometric distribution of numpy's own sampler."""
    quotas, n, times = np.array([400, 250, 50]), 300, 4000
    by = [np.array([f(k) for k in range(times)]) for f in (lambda k: mixing.split(np.random.default_rng([1, k]), quotas, n, 0), lambda k: mixing.split(np.random.default_rng([2, k]), quotas, n))]
    assert (by[0].sum(axis=1) == n).all() and (by[0] >= 0).all() and (by[0] <= quotas).all()
    for k in range(3):
        a, b = (np.bincount(x[:, k], minlength=401) / times for x in by)
        assert np.abs(np.cumsum(a) - np.cumsum(b)).max() < 1.95 * np.sqrt(2 / times)  # Kolmogorov-Smirnov, 0.1 %
    huge = np.array([3 * 10**13, 10**12, 5])
    out = mixing.split(np.random.default_rng(3), huge, 10**13)
    assert out.sum() == 10**13 and (out <= huge).all() and abs(out[0] / 10**13 - 30 / 31) < 1e-5


def test_draws_by_brute_force(spark, texts):
    """Each draw is of the shard whose stretch of its source's permuted blocks, by the tree's leaves, reaches it; places are a shuffle of each shard."""
    docs = table(spark, texts * 3, "abc")
    sized = mixing.stored(mixing._sized(docs), "sized")
    plan = mixing._plan(sized, 1.5, mixing.WEIGHTS)
    got = mixing.draws(sized, plan).collect()
    blocks = collections.defaultdict(set)
    for r in sized.collect():
        for k in range(-(-r["size"] // mixing.BLOCK)):
            blocks[r.source].add((r.row, k, min(mixing.BLOCK, r["size"] - k * mixing.BLOCK)))
    source = {r.row: r.source for r in sized.collect()}
    for p in plan:
        for epoch in (0, 1):
            own = [r for r in got if source[r.row] == p["source"] and r.epoch == epoch]
            quota = min(round(p["target"]), p["source_size"]) if epoch == 0 else max(0, round(p["target"]) - p["source_size"])
            assert sum(r.taken for r in own) == quota and len({(r.row, r.block) for r in own}) == len(own)
            size = {(row, k): n for row, k, n in blocks[p["source"]]}
            assert sum(size[r.row, r.block] != r.taken for r in own) <= 1  # one block is cut
    for s in {r.shard for r in got}:
        own = [r for r in got if r.shard == s]
        assert sorted(r.place for r in own) == list(range(len(own)))
        own.sort(key=lambda r: r.place)
        assert [r.row for r in own] != sorted(r.row for r in own)
    # small shards: the tree's leaves are exact quotas, and stretches follow each other
    tree = mixing.Tree([50, 31], 8, 0)
    at = np.arange(60)
    shards = [tree.shard(np.full(60, k), at) for k in (0, 1)]
    assert all((s[q:] == -1).all() and (np.diff(s[:q]) >= 0).all() and (s[:q] >= 0).all() for s, q in zip(shards, (50, 31), strict=True))


def test_mixed_rows_stand_in_the_shards_order(spark, texts, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    docs = table(spark, texts * 2)
    sized = mixing.stored(mixing._sized(docs), "sized")
    drawn = mixing.draws(sized, mixing._plan(sized, 1.5, mixing.WEIGHTS)).collect()
    assert len({r.shard for r in drawn}) > 4
    first = {}
    for r in drawn:
        first[r.doc_id, r.epoch] = min(first.get((r.doc_id, r.epoch), (r.shard, r.place)), (r.shard, r.place))
    wanted = collections.defaultdict(list)
    for (doc, _), spot in sorted(first.items(), key=lambda x: x[1]):
        wanted[spot[0]].append(doc)
    rows = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    for own in wanted.values():
        assert any(rows[k : k + len(own)] == own for k in range(len(rows)))


def test_packing(spark, texts):
    t = Tokenizer.from_file(VOCABULARY)
    ids = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.packed_pieces(table(spark, texts), VOCABULARY).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for i, own in enumerate(ids):
        p = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in p] == [sum(x.length for x in p[:k]) for k in range(len(p))] and sum(r.length for r in p) == len(own)
        assert all(r.length == 1024 for r in p[1:])
    for s in sequences.values():
        s.sort()
        assert all(o == sum(n for _, n in s[:k]) for k, (o, _) in enumerate(s)) and sum(n for _, n in s) <= 1024
    assert len(sequences) <= -(-sum(map(len, ids)) // 1024) + 1


def test_local_search_empties_a_bin():
    sizes = np.array([6, 5, 4, 3, 2])
    assert len(packing.improve(sizes, [[0], [1], [2, 3, 4]], 10)) == 2


def test_local_search_leaves_no_exchange():
    rng = np.random.default_rng(4)
    for capacity in (100, 1024):
        for _ in range(4):
            sizes = rng.integers(capacity // 5, capacity // 2, 300)
            bins = packing.improve(sizes, packing.best_fit(sizes, capacity), capacity)
            assert sorted(i for b in bins for i in b) == list(range(300))
            own = [[0, *sizes[b].tolist(), *(int(sizes[x] + sizes[y]) for x, y in itertools.combinations(b, 2))] for b in bins]
            singles = [1 + len(b) for b in bins]  # 0 and the items; pairs follow
            for s, d in itertools.permutations(range(len(bins)), 2):
                room = capacity - int(sizes[bins[d]].sum())
                if room and room <= capacity - int(sizes[bins[s]].sum()):
                    steps = ((x, y) for i, x in enumerate(own[s]) for j, y in enumerate(own[d]) if i < singles[s] or 0 < j < singles[d])
                    assert not any(0 < x - y <= room for x, y in steps)


def test_repeated_ids_fill_no_single_group(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    docs = spark.createDataFrame([(None, "one text" if k % 2 else f"text {k}") for k in range(640)], "doc_id long, text string")
    packed = packing.packed_pieces(docs, VOCABULARY).collect()
    groups = collections.Counter(r.sequence_id >> 24 for r in packed)
    assert len(packed) == 640 and len(groups) == 10 and max(groups.values()) < 128


def test_token_counts(spark, texts):
    t = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(table(spark, texts), VOCABULARY).collect()}
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert got == {i: (len((x or "").encode()), k, k > 512) for i, (x, k) in enumerate(zip(texts, n, strict=True))}


def test_shards(spark, texts):
    rows = sharding.shard_table(table(spark, texts * 20)).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id % len(texts)] or "").encode())
    assert sorted(size) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((x or "").encode()) + 1 for x in texts)
    assert max(size.values()) - min(size.values()) <= 2 * largest


def test_ogg(spark, texts):
    rows = {r.doc_id: r for r in media.media_facts(media.with_media(table(spark, texts))).collect()}
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    for n in (64, 255 * 255, 65_024, 200_000):
        raw = os.urandom(n)
        payload = media.padded(raw)
        whole = media.encode(payload, n)
        assert media.decode(whole)[:2] == (payload, n)
        for at in (10, len(whole) // 2, len(whole) - 1):
            with pytest.raises((ValueError, KeyError)):
                media.decode(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
    crc = 0
    for b in b"check":  # bit by bit
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    assert media.page_checksum(b"check") == crc


def test_warc(spark):
    pages = [(3, "http://a.example.com/x", "same"), (1, "http://b.example.com/", "same"), (2, None, None), (4, "http://a.example.com/x", ""), (5, "http://[bad", "other"), (6, "http://c.org:81/q?a=1", "é")]
    got = {r.page_id: tuple(r)[1:] for r in warc.archived_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    assert got == {
        1: (4, digest("same"), "response", None), 3: (4, digest("same"), "revisit", 1), 2: (0, digest(""), "response", None), 4: (0, digest(""), "revisit", 2),
        5: (5, digest("other"), "response", None), 6: (2, digest("é"), "response", None),
    }
    assert warc.url_key("http://WWW.Example.com:80/p?q") == "com,example,www)/p?q"


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.scored_documents(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.9
    x = np.random.default_rng(0).normal(size=(500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert np.mean((quality_model.fit(x, y).scores(x) > 0.5) == y) > 0.9


def test_host_rules(spark):
    good, bad = " ".join(str(i) for i in range(60)), "x x x x"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(40)] + [(100 + i, bad if i % 10 else good, "poor") for i in range(40)] + [(200, None, None)]
    got = {r.doc_id: r for r in host_rules.judged_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].kept and not got[0].kept and not got[100].kept and got[100].host_failed and got[0].n_repeat_words == 4 and not got[200].kept


def test_empty_tables(spark):
    none = table(spark, [])
    assert mixing.mixture(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    for f in (ngram_join.linked_documents, substrings.repeat_digests, substrings.without_repeats, sharding.shard_table, host_rules.judged_documents, media.with_media):
        assert f(none).count() == 0
    assert packing.packed_pieces(none, VOCABULARY).count() == 0 and token_count.token_counts(none, VOCABULARY).count() == 0
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert quality_model.scored_documents(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rel.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        before = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}
