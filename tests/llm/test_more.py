"""Brute-force versions and odd tables: nulls, long texts, ties, repeated rows, clashing names, empty tables."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from attestry.llm import host_rules, importance, kernel, media, mixing, packing, quality_model, sharding, substrings, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, name string, gram long, key string, digest string, shard long, row long, x long, n long, host string, n_words long, place long"


def clashing(spark, rows):
    """A table of (doc_id, text, source) with columns named as the operators' own."""
    return spark.createDataFrame([(i, t, None, s, None, "n", 1, "k", "d", 1, 1, 1, 1, "h", 1, 1) for i, t, s in rows], CLASHING)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    body = " ".join(f"b{k}" for k in range(80))
    rows = [(1, body, "a"), (1, body, "a"), (1, "other text of one id", "b"), (None, body, None), (None, None, None), (2, "", "a"), (3, " \n ", None), (4, None, "b"), (5, long, "a"), (6, body + " end", "b")]
    return rows + [(10 + k, f"tie tie tie {k % 3}", "ab"[k % 2]) for k in range(12)]


def test_stages_on_odd_tables(spark, odd_rows, tmp_path):
    labels = spark.createDataFrame([(6, 1), (10, 0), (11, 1), (None, 1), (12, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(spark, odd_rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        ids = collections.Counter(r.doc_id for r in rows)
        if name == "substring_dedup":
            assert len(rows) == len(odd_rows)
        if name == "ngram_jaccard_join":  # 6 is a near copy of 1; rows of one id stay together, null ids stay
            assert ids[1] == 3 and ids[None] == 2 and 6 not in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(i for i, _, _ in odd_rows)


def test_hosts_fail_by_rule(spark):
    """Each rule is counted, shrunk and limited by itself, checked by plain arithmetic."""
    rng = random.Random(4)
    good = lambda k: " ".join(f"g{k}x{j}" for j in range(60))
    rows, n = [], 0
    for h in range(12):
        for _ in range(30):
            short, rep = rng.random() < (0.5 if h == 3 else 0.05), rng.random() < (0.4 if h == 7 else 0.05)
            rows.append((n, "too short" if short else "again and again " * 40 if rep else good(n), f"h{h}" if h else None))
            n += 1
    got = {r.doc_id: r for r in host_rules.judged_documents(clashing(spark, rows)).collect()}
    failed = set()
    for rule in ("short", "repetitive"):
        per = collections.defaultdict(lambda: [0, 0])
        for i, t, h in rows:
            x = t.split()
            bad = len(x) < 50 if rule == "short" else t.startswith("again")
            assert got[i][rule] == bad
            per[h][0] += bad
            per[h][1] += 1
        m = sum(f for f, _ in per.values()) / len(rows)
        v = np.var([f / k for f, k in per.values()])
        w = min(max(m * (1 - m) / v - 1, 1.0), 1e6)
        failed |= {h for h, (f, k) in per.items() if (f + m * w) / (k + w) > m + math.sqrt(m * (1 - m) / (w + 1))}
    assert {"h3", "h7"} <= failed < {h for _, _, h in rows}
    assert all(got[i].host_failed == (h in failed) and got[i].kept == (not got[i].base_failed and h not in failed) for i, _, h in rows)
    assert any(not got[i].base_failed and not got[i].kept for i, _, _ in rows)
    alike = host_rules.judged_documents(clashing(spark, [(k, good(k), "ab"[k % 2]) for k in range(20)])).collect()
    assert all(r.kept for r in alike)


def test_shards_by_brute_force(spark, odd_rows):
    rng = random.Random(6)
    rows = odd_rows[:8] + odd_rows[9:] + [(100 + k, rng.choice(["copy " * 9, f"t{k} " * rng.randint(1, 60)]), "a") for k in range(1500)]
    docs = clashing(spark, rows)
    key = sharding.sort_key(sharding.group_key(F.col("text")), F.col("doc_id"), F.lit(0).cast("long"))
    keyed = docs.select(key.alias("k"), sharding.byte_size(F.col("text")).alias("size")).collect()
    order = sorted((r.k, r["size"]) for r in keyed)
    total = sum(s for _, s in order)
    bounds = sharding.splitters(sharding.stored(docs.select(key.alias("key"), sharding.byte_size(F.col("text")).alias("size")), "sizes"), 8)
    at_key = collections.Counter()
    for k, s in order:
        at_key[k] += s
    for k, bound in enumerate(bounds, 1):
        below = sum(s for key, s in order if key < bound)
        beside = [at_key[x] for x in (max((key for key, _ in order if key < bound), default=0), min((key for key, _ in order if key >= bound), default=0))]
        assert abs(below - total * k / 8) <= max(0.001 * total / 8, *beside), k
    got = sharding.shard_table(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1) for i, t, _ in rows)
    of = collections.defaultdict(set)
    moved = sharding.sharded_documents(docs)
    assert moved.columns == [*docs.columns, "attestry_shard"]
    for r in moved.collect():
        of[r.text or ""].add(r.attestry_shard)
    cut = {t for t, s in of.items() if len(s) > 1}
    assert all(sum(len((t or "").encode()) + 1 for _, t, _ in rows if (t or "") == c) > 0.001 * total / 8 for c in cut)
    bytes_of = collections.Counter()
    for r in got:
        bytes_of[r.shard] += r["size"]
    assert max(bytes_of.values()) - min(bytes_of.values()) < 0.02 * total / 8 + 2 * max(s for _, s in order)


def test_equal_rows_are_parted(spark):
    """Thousands of rows of one (null id, text) beside ordinary ones: shards stay even, places stay gapless, reruns agree."""
    one, other = "same words " * 3, "other words "
    rows = [(None, one, "a")] * 9000 + [(7, one, "a")] * 3000 + [(k, other * (k % 5), "b") for k in range(2000)]
    docs = clashing(spark, rows)
    got = sharding.shard_table(docs).collect()
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(size) == 8 and max(size.values()) - min(size.values()) < 0.01 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, sharding.shard_table(docs.repartition(3)).collect()))
    even = collections.Counter(r.attestry_shard for r in sharding.sharded_documents(docs.where("doc_id is null")).collect())
    assert max(even.values()) - min(even.values()) < 0.02 * 9000 / 8 + 2
    pieces = packing.packed_pieces(docs, VOCABULARY).collect()
    assert collections.Counter((r.doc_id, r.length) for r in pieces).total() == len(rows)
    fill = collections.Counter()
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.02 * sum(fill.values()) / 1024 + 4
    mixed = mixing.mixture(docs).collect()
    assert len(mixed) == len(rows) and all(r.taken <= 2 * r["size"] for r in mixed)


def test_each_copy_counts_equal_rows(spark):
    rows = [(None, "x")] * 9001 + [(1, None)] * 3 + [(2, "y")]
    got = collections.Counter(map(tuple, kernel.each_copy(spark.createDataFrame(rows, "a long, b string"), "c").collect()))
    want = {(None, "x", k) for k in range(9001)} | {(1, None, k) for k in range(3)} | {(2, "y", 0)}
    assert set(got) == want and max(got.values()) == 1


@pytest.mark.parametrize("text", ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x" * 2_000_000, "a" + "\u00a0" * 30_000 + " \t" * 1000 + "b<|endoftext|>  c"])
def test_pack_takes_long_runs(spark, text, tmp_path):
    """Runs of two million white-space characters or letters, as the tokenizers library tokenises them, in op4 and in the pipeline's last stage."""
    want = np.array([*Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids, 2], "<u4")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sorted(packing.packed_pieces(docs, VOCABULARY).collect(), key=lambda r: r.piece)
    assert sum(r.length for r in got) == len(want)
    assert [r.ids_crc32 for r in got] == [zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in got]
    if text[1] == "\n":
        assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == len(got)


def test_columns_named_as_the_library_names_its_own(spark, tmp_path):
    """Every name that the library gives a column stands beside doc_id, text and source, with a value of its own."""
    folder = os.path.dirname(kernel.__file__)
    source = "".join(open(f"{folder}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(folder)) if f.endswith(".py"))
    names = set(re.findall(r'"([A-Za-z_][A-Za-z_0-9]*)"', source)) | {f"attestry_{x}" for x in ("k1", "k2", "ranges", "row", "drawn", "shard", "place", "gone")} | {"dotted.name", "all", "tick`ed"}
    seen = {"doc_id", "text", "source"}
    names = [n for n in sorted(names) if n.lower() not in seen and not seen.add(n.lower())]
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(90)) for _ in range(12)]
    rows = [(k, texts[k % 12] + ("" if k < 12 else " more"), "ab"[k % 2]) for k in range(20)] + [(None, None, None)]
    docs = spark.createDataFrame([(*r, *(77_000 + 100 * k + i for i in range(len(names)))) for k, r in enumerate(rows)], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(n, T.LongType()) for n in names)]))
    spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    held = {r[3:] for r in docs.collect()}
    stages = [f for _, f in corpus_pipeline.STAGES[:-1]] + [lambda s, d, f: importance.drawn_documents(d, d.select("text"), percent=50, fewest_words=1)]
    for stage in stages:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = [r[3:] for r in out.collect()]
        assert got and set(got) <= held
    moved = sharding.sharded_documents(docs.withColumn("attestry_shard_", F.lit(5)))
    assert moved.columns[-1] == "attestry_shard__" and {r[3:-2] for r in moved.collect()} == held
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).where("piece = 0").count() == len(rows)


def test_tree_walk_and_first_split():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 2] + 0.3 * rng.normal(size=400) > 0.4).astype(float)
    trees = quality_model.fit(x, y)
    for row in x[:40]:
        margin = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            margin += trees.value[node]
        assert trees.scores(row[None, :])[0] == pytest.approx(1 / (1 + math.exp(-margin)))
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(len(y), p * (1 - p))
    best = (0.0, -1, 0.0)
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_model.BINS + 1)[1:-1])):
            left = x[:, f] <= cut
            if h[left].sum() >= quality_model.LEAST and h[~left].sum() >= quality_model.LEAST:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, f, cut))
    root = trees.roots[0]
    assert (trees.feature[root], trees.threshold[root]) == (best[1], pytest.approx(best[2]))


def test_statistics_by_plain_python():
    texts = [None, "", "A b!\nA b!\n\nc # d", "x " * 30 + "y", "é 日本 |*|\tq", "Ab ab AB 12 12 12 12"]
    got = quality_model.statistics(pa.array(texts))
    for row, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        x = raw.split()
        of = dict(zip(quality_model.FEATURES, row, strict=True))
        size = max(len(raw), 1)
        assert of["words"] == pytest.approx(math.log1p(len(x))) and of["bytes"] == pytest.approx(math.log1p(size))
        assert of["symbols"] == pytest.approx(sum(c in b"#*$%&|<>" for c in raw) / size) and of["digits"] == pytest.approx(sum(48 <= c <= 57 for c in raw) / size)
        if x:
            threes = collections.Counter(tuple(x[k : k + 3]) for k in range(len(x) - 2))
            lines = [tuple(l.split()) for l in raw.split(b"\n") if l.split()]
            assert of["distinct_words"] == pytest.approx(len(set(x)) / len(x)) and of["top_word"] == pytest.approx(max(collections.Counter(x).values()) / len(x))
            assert of["repeated_3"] == pytest.approx((sum(threes.values()) - len(threes)) / sum(threes.values()) if threes else 0)
            assert of["distinct_lines"] == pytest.approx(len(set(lines)) / len(lines)) and of["single_bytes"] == pytest.approx(sum(len(w) == 1 for w in x) / len(x))


def test_scores_of_odd_tables(spark, odd_rows):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 22)] + [(1, 0), (999, 1)], "doc_id long, quality int")
    rows = quality_model.scored_documents(clashing(spark, odd_rows), labels).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _, _ in odd_rows)
    assert len({r.score for r in rows if r.doc_id in (2, 4)}) == 1  # an empty and a null text
    assert all(r.predicted == (r.score >= 0.3) for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    kept = quality_model.accepted_documents(clashing(spark, odd_rows), labels)
    assert kept.count() == sum(r.predicted for r in rows)


def test_archives_of_odd_pages(spark):
    long = "".join(f"<p>{k}</p>" for k in range(200_000))
    pages = [(k, f"http://h{k % 3}.org/{k % 5}", "same") for k in range(40)] + [(7, "http://h1.org/2", "same"), (50, None, long), (51, "http://x.org", long), (51, "http://x.org", "second"), (None, "u", "same"), (None, None, None)]
    docs = spark.createDataFrame([(i, u, h, "f", 1, "d", 2) for i, u, h in pages], "page_id long, url string, html string, file string, offset long, digest string, first long")
    got = collections.Counter(tuple(r) for r in warc.archived_pages(docs).collect())
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    want = collections.Counter()
    for i, _, h in pages:
        own = [j for j, _, g in pages if (g or "") == (h or "") and j is not None]
        first = min(own, default=None)
        again = first is not None and i != first
        want[i, len((h or "").encode()), digest(h or ""), "revisit" if again else "response", first if again else None] += 1
    assert got == want


def test_media_digests_and_times(spark, odd_rows):
    docs = clashing(spark, odd_rows)
    files = {(r.doc_id, r.media) for r in media.with_media(docs).collect()}
    facts = media.media_facts(media.with_media(docs)).collect()
    assert len(facts) == len(odd_rows) and media.media_facts(media.with_media(docs.limit(0))).count() == 0
    by = collections.defaultdict(set)
    for i, m in files:
        by[hashlib.sha256(m).hexdigest()].add((i, m))
    for r in facts:
        raw = [t for i, t, _ in odd_rows if i == r.doc_id]
        pads = [media.padded((t or "").encode()) for t in raw]
        pad = next(p for p in pads if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        m = next(m for _, m in by[r.media_sha256])
        assert r.tail_crc32 == zlib.crc32(pad[-64:]) and r.media_bytes == len(m) and media.decode(m)[0] == pad
        of = dict(x.split("=") for x in r.feature.split(";"))
        x = np.frombuffer(pad, np.uint8).astype(float) - 128
        assert float(of["seconds"]) == pytest.approx(len(pad) / 8000) and float(of["rms"]) == pytest.approx(np.sqrt((x**2).mean()), abs=1e-3) and int(of["peak"]) == abs(x).max()
        assert float(of["last_packet"]) == pytest.approx((len(pad) - 1) // media.PACKET * media.PACKET / 8000) and int(of["crossings"]) == np.count_nonzero(np.diff(x < 0))
    stream = media.read_streams(media.encode(bytes(100_000), 5))[zlib.crc32(bytes(100_000))]
    sizes = [4000] * 25
    assert media.packet_times(stream, sizes, 1, 8000) == [(k / 2, (k + 1) / 2) for k in range(25)]
    stream.granules = [g + 1 for g in stream.granules]
    with pytest.raises(ValueError):
        media.packet_times(stream, sizes, 1, 8000)


def test_identifiers_equal_the_library(spark):
    """tiktoken with the file's merges gives the identifiers of tokenizers on all texts of a table."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    t, e = Tokenizer.from_file(VOCABULARY), packing.encoding(VOCABULARY)
    for text, x in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.encode(text, allowed_special="all") == x.ids


def test_mix_of_odd_tables(spark, odd_rows):
    docs = clashing(spark, odd_rows)
    rows = mixing.mixture(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in rows) == sorted((i is None, i or 0, len((t or "").encode().split())) for i, t, _ in odd_rows)
    assert all(r.taken <= 2 * r["size"] and (r.first_place is None) == (r.taken == 0) for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(len(r.text.encode().split()) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_repeats_of_odd_tables(spark, odd_rows):
    got = collections.Counter(r.doc_id for r in substrings.repeat_digests(clashing(spark, odd_rows)).collect())
    assert got == collections.Counter(i for i, _, _ in odd_rows)
