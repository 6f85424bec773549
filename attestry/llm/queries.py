"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_rules, importance, media, mixing, ngram_join, packing, phrase_index, quality_model, sharding, spelling, substrings, token_count, warc

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judged_documents(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(_table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_table(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_facts(media.with_media(_table(spark, sf_dir, "documents")))


def op8_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contaminated_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_host_rules, op3_ngram_join, op4_pack, op5_token_counts, op6_histogram_shards, op7_ogg_media, op8_repeated_words, op9_quality, op10_warc, op11_importance, op12_decontaminate, op13_spelling)
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

# Words of letters and digits in their order, A-Z as a-z.
_ALNUM = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

# The table of CRC-32 by four bits.
_CRC_STEPS = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"


def _crc32(digits: str) -> str:
    """SQL for the crc32 of a text by the hexadecimal digits of its UTF-8: of each byte the lower one goes first through the register."""
    own = f"list_transform(range(0, length({digits})), lambda i: CAST(instr('0123456789ABCDEF', substr({digits}, CAST(i + 2 - 2 * (i % 2) AS INT), 1)) - 1 AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {own}), lambda c, b: xor(c >> 4, ({_CRC_STEPS})[CAST(1 + (xor(c, b) & 15) AS INT)])))"


ORACLE_SQL = {
    "op2_host_rules": rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS met FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE met > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE short) AS s, count(*) FILTER (WHERE repetitive) AS r FROM f GROUP BY source),
p AS (SELECT rule, least(greatest(sum(failed) / sum(n), 1e-6), 1 - 1e-6) AS m, greatest(var_pop(failed / n), 1e-12) AS v
  FROM (SELECT 's' AS rule, n, s AS failed FROM h UNION ALL SELECT 'r', n, r FROM h) GROUP BY rule),
k AS (SELECT rule, m, least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) AS k FROM p),
j AS (SELECT source, bool_or((CASE rule WHEN 's' THEN s ELSE r END + m * k) / (n + k) > m + sqrt(m * (1 - m) / (k + 1))) AS host_failed FROM h, k GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed, NOT (short OR repetitive) AND NOT host_failed AS kept
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source""",
    "op3_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform({_WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * met >= 75 * (p.n + q.n - met)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, u.y FROM reach JOIN u ON reach.y = u.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = d.doc_id""",
    "op8_repeated_words": rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS met FROM p) WHERE met > 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 10 * CAST(k // 8 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""",
    "op11_importance": rf"""
WITH w AS (SELECT 'd' AS kind, doc_id AS id, {_ALNUM} AS words FROM documents UNION ALL SELECT 't', item_id, {_ALNUM} FROM benchmark),
g AS (SELECT kind, id, unnest(list_concat(words,
    list_transform(range(1, len(words)), lambda i: array_to_string(words[i : i + 1], ' ')),
    list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' ')))) AS run FROM w),
c AS (SELECT run, {_crc32("digits")} % 10000 AS b FROM (SELECT run, hex(encode(run)) AS digits FROM (SELECT DISTINCT run FROM g))),
f AS (SELECT kind, id, b FROM g JOIN c USING (run)),
n AS (SELECT b, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 't') AS t FROM f GROUP BY b),
a AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM n),
v AS (SELECT b, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM n, a),
x AS (SELECT id, count(*) AS n_features, sum(gain) AS weight FROM f JOIN v USING (b) WHERE kind = 'd' GROUP BY id),
d AS (SELECT id AS doc_id, len(words) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN x USING (id) WHERE kind = 'd'),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 5 * count(*) OVER () // 100 AS draw FROM e WHERE n_words >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= draw THEN rank END AS rank FROM e LEFT JOIN r ON e.doc_id = r.doc_id""",
    "op12_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS words FROM documents),
b AS (SELECT item_id, {_ALNUM} AS words FROM benchmark),
g AS (SELECT DISTINCT item_id, words[i : i + 9] AS win FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
l AS (SELECT DISTINCT len(win) AS n FROM g),
p AS (SELECT doc_id, i, n, words[i : i + n - 1] AS win FROM (SELECT doc_id, words, n, unnest(range(1, CAST(len(words) - n + 2 AS BIGINT))) AS i FROM d, l WHERE len(words) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM p JOIN g USING (win)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, CAST(i + n AS BIGINT))) AS k FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN o ON d.doc_id = o.doc_id""",
    "op13_spelling": rf"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_crc32("digits")} AS h FROM (SELECT run, n, hex(encode(doc_id || ':' || run)) AS digits FROM k)),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) + 2 AS INT)) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
o AS (SELECT word, n, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i + 2 AS INT)) AS rest, i FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
e AS (SELECT x.word, y.word AS near, y.n AS m FROM o x JOIN o y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM o x JOIN v y ON x.rest = y.word UNION SELECT y.word, x.word, x.n FROM o x JOIN v y ON x.rest = y.word),
t AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM e GROUP BY word),
f AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN t ON v.word = t.word),
s AS (SELECT word, word AS root FROM f UNION SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL),
z AS (SELECT s.word, s.root FROM s JOIN f ON s.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON f.word = z.word""",
}
