"""Groups of words that differ by one letter, by a pigeonhole join.

Two words that differ by one inserted, deleted or replaced code point agree in one of two segments, if the shorter one
is cut evenly: one edit cannot touch both.  Each word is indexed by both of its segments, whose lengths depend on its own.  Words of
equal length probe with the same segments, words that are one longer with those shifted by the place where a letter may be
too many.  Where many words share a segment, what they have left is cut evenly in the same way, until few words
share a key or one letter is left, so no group outgrows the alphabet.  Pairs that meet are verified.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import parts, stored

RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
HELD = 500_000  # words that a task counts before it hands them on
CROWD = 4096  # pairs that may meet on one key before it is cut further
HOLE = "\u0001"


def _runs(noise: int, shortest: int):
    def run(batches):
        total: Counter = Counter()
        for batch in (part for whole in batches for part in parts(whole, 1)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lead = crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in Counter(RUN.findall((text or "").encode().translate(_LOWER).decode())).items():
                    if len(word) >= shortest:
                        h = crc32(word.encode(), lead)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        total[word] += n
            if len(total) >= HELD:
                yield _counts(total, shortest)
                total.clear()
        yield _counts(total, shortest)

    return run


def _counts(total: Counter, shortest: int) -> pa.RecordBatch:
    kept = {w: n for w, n in total.items() if len(w) >= shortest}
    return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])


def vocabulary(documents: DataFrame, shortest: int = 5, fewest: int = 3, noise: int = 97) -> DataFrame:
    """word and n of the words of at least `shortest` code points that occur at least `fewest` times, stored.

    A word is a run of a-z, A-Z and U+00C0 to U+00FF, with A-Z as a-z; where noise divides the crc32 of "<doc_id>:<run>", the run lacks one code
    point.  Texts are counted as they pass, so what is exchanged are sums."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_runs(noise, shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.where(F.col("n") >= fewest), "words")


def _part(word: str, start: Column, length: Column) -> Column:
    return F.substr(F.col(word), start + 1, length)


def _cut(entries: DataFrame) -> DataFrame:
    """Two entries for each of entries (word, n, longer, lo, hi): what is left open between lo and hi, counted in the indexed word, is cut evenly.

    longer: the word has one letter more than the indexed ones it looks for, in the part that stays open."""
    more, h = F.col("longer").cast("int"), F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
    first = F.struct((F.col("lo") + h).alias("lo"), F.col("hi"))
    second = F.struct(F.col("lo"), (F.col("lo") + h).alias("hi"))
    out = entries.select("word", "n", "longer", F.explode(F.array(first, second)).alias("open")).select("word", "n", "longer", "open.*")
    length = F.length("word")
    return out.withColumn("key", F.concat(_part("word", F.lit(0), F.col("lo")), F.lit(HOLE), _part("word", F.col("hi") + more, length - F.col("hi") - more), F.lit(HOLE), F.col("hi") - F.col("lo")))


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Each pair of words (word, n) that differ by one edit, once: a, a_n, b, b_n; words are distinct.

    The longer word is b, of words of one length the later one.  A crowd of words on a key is cut further; it takes as many rounds as
    the longest word can be halved at most."""
    length = F.length("word")
    start = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")).withColumns({"lo": F.lit(0), "hi": length - F.col("longer").cast("int")})
    entries, pairs = _cut(start.where("hi > 0")), None
    while True:
        entries = stored(entries, "segments")
        indexed = F.count_if(~F.col("longer"))
        crowds = stored(entries.groupBy("key").agg(indexed.alias("i"), F.count("*").alias("all"), F.any_value(F.col("hi") - F.col("lo")).alias("left")).where((F.col("i") * F.col("all") > crowd) & (F.col("left") > 1)).select("key"), "crowds")
        last = crowds.isEmpty()
        fit = entries if last else entries.join(crowds, "key", "left_anti")
        found = _met(fit)
        pairs = found if pairs is None else pairs.unionByName(found)
        if last:
            return pairs.distinct()
        entries = _cut(entries.join(crowds, "key", "left_semi").drop("key"))


def _met(entries: DataFrame) -> DataFrame:
    left = entries.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = entries.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    one = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, (left["key"] == right["key"]) & one).select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form): each round doubles how far a word looks, until all look at a word without a form."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_groups(documents: DataFrame, shortest: int = 5, fewest: int = 3, noise: int = 97, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of documents (doc_id, text).

    n: how often the word occurs.  n_near: how many words are one edit away.  form: of these the one that occurs most, ties to the first in
    code-point order, if it occurs at least times as often as the word; else null, as form_n, its count.  root: the last word on the way from form
    to form, the word itself if it has none; counts at least double on the way, so it ends.  Null and empty texts have no
    words; a null id counts as an empty one where letters are dropped; repeated rows count again.  An empty table gives an empty
    result; other columns are ignored.
    """
    words = vocabulary(documents, shortest, fewest, noise)
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near"))).alias("top"))
    joined = words.join(best, "word", "left")
    likelier = -F.col("top.less") >= times * F.col("n")
    judged = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likelier, F.col("top.near")).alias("form"), F.when(likelier, -F.col("top.less")).alias("form_n")), "forms")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
