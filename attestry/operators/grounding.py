"""Quotes that stand in a text word for word but for a few words: seeds by rare words, then an ordered alignment of each candidate."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Brackets that a text leaves to its reader, marks of left-out words, and how much a quote must say and may miss.
PARAMETER = r"(?i)\[(?:Assignment|Selection)[^\]]*\]"
ELLIPSIS = r"\.\.\.|…"
FRAGMENT_WORDS, QUOTE_WORDS = 3, 4
MISSES, EXACT_BELOW = 0.15, 6


def words(text: Column, parameters: bool = True) -> Column:
    """Lower-case [a-z0-9]+ runs; parameters: those in bracketed parameters too."""
    text = text if parameters else F.regexp_replace(text, PARAMETER, " ")
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def fragments(quote: Column) -> Column:
    """The words of the parts of a quote between ellipses, without parameters; parts without words are left out."""
    return F.filter(F.transform(F.split(quote, ELLIPSIS), lambda f: words(f, False)), lambda f: F.size(f) > 0)


def may_miss(n: int) -> int:
    """How many words of a fragment of n words a text may lack."""
    return max(1, int(n * MISSES)) if n >= EXACT_BELOW else 0


SEPARATORS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def tokens_of(lowered: bytes) -> list[bytes]:
    """What words() gives for a text in lower case, from its UTF-8."""
    return lowered.translate(SEPARATORS).split()


EXTRA = 4  # words of a fragment that a candidate must have, and a window of it


class Fragment:
    """A fragment's words as bits, by which a text is aligned to it one word at a time."""

    def __init__(self, own: list[bytes]):
        self.n, self.needed = len(own), len(own) - may_miss(len(own))
        self.bits: dict[bytes, int] = {}
        for k, w in enumerate(own):
            self.bits[w] = self.bits.get(w, 0) | 1 << k
        self.heads = set(own[: self.n - self.needed + 1])  # one of them is the first word that is found
        self.marks = set(sorted(self.bits, key=lambda w: (-len(w), w))[: self.n - self.needed + EXTRA])  # long words are rare
        self.met = len(self.marks) - (self.n - self.needed)  # so many marks are in each window that lacks no more than it may

    def starts(self, tokens: list[bytes], at: int) -> Iterator[int]:
        """The places from one on, in order, where a window with enough marks begins."""
        if self.met <= 0:
            yield from range(at, len(tokens))
            return
        hits = [k for k, token in enumerate(tokens) if token in self.marks and k >= at]
        held: dict[bytes, int] = {}
        first = 0
        for k in hits:
            held[tokens[k]] = held.get(tokens[k], 0) + 1
            while held[tokens[hits[first]]] > 1 or len(held) > self.met:  # the last place from which on there are enough
                w = tokens[hits[first]]
                held[w] -= 1
                if not held[w]:
                    del held[w]
                first += 1
            if len(held) == self.met:
                at = max(at, k - 2 * self.n + 1)
                yield from range(at, hits[first] + 1)
                at = max(at, hits[first] + 1)

    def end(self, tokens: list[bytes], at: int) -> int | None:
        """Where the fragment's words, enough of them and in order, end in the tokens from a place on: of its first window of twice
        its length that begins with one of its heads, the shortest part with all that the window has of it.

        A set bit of open is a word that no longer common subsequence ends with; each token clears at most one."""
        every = (1 << self.n) - 1
        for start in self.starts(tokens, at):
            if tokens[start] not in self.heads:
                continue
            open_, found, last = every, 0, start
            for k, token in enumerate(tokens[start : start + 2 * self.n], start + 1):
                met = open_ & self.bits.get(token, 0)
                open_ = ((open_ + met) | (open_ - met)) & every
                if self.n - open_.bit_count() > found:
                    found, last = found + 1, k
            if found >= self.needed:
                return last
        return None


def stands(own: list[list[bytes]], readings: list[list[bytes]], title: list[bytes], fewest: int = QUOTE_WORDS) -> bool:
    """Whether a quote's fragments stand one after the other in one of a text's readings.

    A first fragment that is the text's title names it: the others are then looked for behind the title, none of them
    may be the title again, and their words must suffice alone."""
    named = bool(title) and len(own) > 1 and own[0] == title
    rest = own[1:] if named else own
    least = max(FRAGMENT_WORDS, fewest - len(title)) if named else fewest
    if not rest or sum(map(len, rest)) < least or named and title in rest:
        return False
    if len(rest) > 1 and min(map(len, rest)) < FRAGMENT_WORDS:
        return False
    parts = [Fragment(f) for f in rest]
    for tokens in readings:
        at: int | None = len(title) if named and tokens[: len(title)] == title else 0
        for part in parts:
            at = part.end(tokens, at)
            if at is None:
                break
        else:
            return True
    return False


def _held(batches: Iterator):
    """id and word, by its CRC-32, of each different word of texts (id, lower-case UTF-8)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            names = [np.fromiter(map(zlib.crc32, set(tokens_of(text))), np.int64) for text in part.column(1).to_pylist()]
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), [len(x) for x in names])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(names))], ["id", "word"])


def seeds(asked: DataFrame, held: DataFrame, extra: int = EXTRA) -> DataFrame:
    """quote, word, times and need of asked (quote, fragments): of one fragment, the rarest words by held (id, word), `extra` more than it may miss, or all.
    A word is its CRC-32: words that share one only add texts to look at.

    A text that has the quote lacks at most so many of the fragment's words as it may miss, so it has the others of these: need of them, each word counted as
    often as the fragment has it.  Of several fragments the first may be a title; among the others the one with the fewest texts to look at is taken."""
    longest = F.when(F.size("fragments") > 1, F.slice("fragments", F.lit(2), F.size("fragments") - 1)).otherwise(F.col("fragments"))
    f = asked.select("quote", F.posexplode(longest).alias("fragment", "words"))
    allowed = F.when(F.size("words") >= EXACT_BELOW, F.greatest(F.lit(1), F.floor(F.size("words") * MISSES))).otherwise(0)
    w = f.select("quote", "fragment", allowed.cast("int").alias("allowed"), F.posexplode("words").alias("pos", "word")).withColumn("word", F.crc32(F.col("word").cast("binary")))
    df = held.groupBy("word").agg(F.count("id").alias("df"))  # with id, so that Spark deals the words out once for this and for the join
    w = w.join(df, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    own = Window.partitionBy("quote", "fragment")
    w = w.withColumn("n", F.row_number().over(own.orderBy("df", "pos"))).where(F.col("n") <= F.col("allowed") + extra)
    each = Window.partitionBy("quote")
    w = w.withColumn("cost", F.sum("df").over(own)).withColumn("best", F.min(F.struct("cost", "fragment")).over(each)).where(F.col("best.fragment") == F.col("fragment"))
    w = w.withColumn("need", F.count("*").over(each) - F.col("allowed"))
    return w.groupBy("quote", "word").agg(F.count("*").alias("times"), F.first("need").alias("need"))


def grounded(quotes: DataFrame, texts: DataFrame, fewest: int = QUOTE_WORDS) -> DataFrame:
    """Distinct (quote, id) of quotes (quote, text) that stand in texts (id, text, heading).

    A quote has at least `fewest` words, in fragments between ellipses that have at least three where there are several.  Each fragment's words stand in
    order within twice its length, but for 15 % of them in fragments of six words or more; fragments follow each other.  A text is read with and without
    its bracketed parameters.  A first fragment that is the text's heading sets it aside.  Null quotes and texts ground nothing.

    Quotes and texts meet on words, rarest first; only candidates are aligned, each once.  No side is broadcast but by its measured size.
    Texts are cut into words where they lie, once for the words to meet on, and again for the candidates alone."""
    asked = quotes.where("text is not null").select("quote", fragments(F.col("text")).alias("fragments"))
    total = F.aggregate("fragments", F.lit(0), lambda n, f: n + F.size(f))
    asked = asked.where(total >= min(fewest, FRAGMENT_WORDS))
    lowered = lambda text: F.lower(text).cast("binary")
    key = texts.schema["id"].dataType.simpleString()
    texts = texts.where("text is not null")
    held = texts.select("id", lowered(F.col("text")).alias("text")).mapInArrow(_held, f"id {key}, word long").where("id is not null and word is not null").repartition("word")
    near = held.join(seeds(asked, held), "word").groupBy("quote", "id").agg(F.sum("times").alias("times"), F.first("need").alias("need")).where("times >= need").select("quote", "id")
    plain = lowered(F.regexp_replace("text", PARAMETER, " "))
    title = words(F.coalesce("heading", F.lit("")), False)
    pairs = near.join(asked, "quote").join(texts.select("id", "text", "heading"), "id").select("quote", "id", "fragments", plain.alias("plain"), lowered(F.col("text")).alias("full"), title.alias("title"))
    kinds = dict(near.dtypes)

    def aligned(batches: Iterator):
        import pyarrow as pa

        texts, readings = None, []
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                kept = []
                for own, plain, full, title in zip(*(part.column(k) for k in (2, 3, 4, 5)), strict=True):
                    if (plain.as_py(), full.as_py()) != texts:  # quotes of one text mostly follow each other
                        texts = plain.as_py(), full.as_py()
                        readings = [tokens_of(text) for text in dict.fromkeys(texts)]
                    kept.append(stands([[w.encode() for w in f] for f in own.as_py()], readings, [w.encode() for w in title.as_py()], fewest))
                yield part.select(["quote", "id"]).filter(pa.array(kept, pa.bool_()))

    return pairs.mapInArrow(aligned, f"quote {kinds['quote']}, id {kinds['id']}")


def whole_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (quote, id) where the quote's words are all of the text's, parameters aside: for texts too short to quote from."""
    own = lambda c: words(F.col(c), False)
    q = quotes.select("quote", own("text").alias("words")).where("size(words) > 0")
    return q.join(texts.select("id", own("text").alias("words")), "words").select("quote", "id").distinct()
