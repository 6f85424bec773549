"""Answers held against the passages that they were written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Citations, quotes and how long those are that must be verbatim, periods, placeholders, and words that admit to what a source lacks.
MARK = r"\[(\d+)\]"
QUOTE = r"\"([^\"]*)\"|“([^”]*)”"
QUOTE_CHARS = 25
PERIOD = r"(?i)\b(?:quarterly|annually|annual|biannually|semi-annually|monthly|weekly|daily|fortnightly|hourly|continuously|\d+\s*(?:hour|day|week|month|year|business day)s?)\b"
PLACEHOLDER = r"\[(?!\d)([A-Z][^\[\]\n]{1,59})\](?!\()"
ADMITS_UNFILLED = r"(?i)placeholder|unfilled|not filled|generic|bracket|left blank|undecided|not specif|no specific|not stat|not name|not identif|not assign|not set|no value|has not|have not|to be determined"
ADMITS_UNOWNED = r"(?i)supporting|unowned|no declared owner|not claimed|unclaimed|no owner|nobody has claimed|does not name an owner"
# Characters that are drawn like plain ones, and those that aren't drawn.
LIKE = {"'": "‘’‚‛′´", '"': "“”„‟″«»", "-": "‐‑‒–—―−"}
UNSEEN = "​‌‍﻿"


def visible(text: Column) -> Column:
    """The words that a reader sees: without emphasis marks and letters bracketed for their case, in plain characters, with single spaces."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\*\*|__|\*|`", ""), r"\[([A-Za-z])\]", "$1")
    odd, like = ("".join(x) for x in zip(*((o, k) for k, chars in LIKE.items() for o in chars), strict=True))
    plain = F.replace(F.translate(plain, odd + UNSEEN, like), F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def marks(text: Column) -> Column:
    """The passages that a text cites, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARK), 1), lambda n: n.cast("bigint")))


def _each(when: Column, kind: str, values: Column) -> Column:
    return F.when(when, F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("what"))))


def findings(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """id, kind and what of what is wrong with answers (id, question, text) to passages (id, n, text, label, trusted), n from 1.

    unknown: a cited number without a passage.  uncited, empty: an answer that cites nothing, with or without text.  quote: a quote of 25 characters or more, marks around
    it aside, that no passage holds.  value: a period in neither a passage nor the question.  placeholder: a bracketed placeholder that the answer nowhere calls one.  unowned:
    the label of a cited passage that isn't trusted, in an answer that nowhere says so.  Case doesn't matter in quotes and values.  Each finding is given once.

    An answer meets only its own passages, put together once."""
    own = passages.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "text", "label", "trusted"))).alias("own"))
    x = answers.join(own, "id", "left").withColumns({"own": F.coalesce("own", F.array().cast(dict(own.dtypes)["own"])), "text": F.coalesce("text", F.lit("")), "question": F.lower(F.coalesce("question", F.lit("")))})
    held = F.lower(visible(F.array_join(F.transform("own", lambda p: F.coalesce(p["text"], F.lit(""))), " ")))
    x = x.withColumns({"held": held, "cited": marks(F.col("text"))})
    known = F.transform("own", lambda p: p["n"].cast("bigint"))
    none = F.size("cited") == 0
    quotes = F.zip_with(F.regexp_extract_all("text", F.lit(QUOTE), 1), F.regexp_extract_all("text", F.lit(QUOTE), 2), lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(F.coalesce(b, F.lit(""))))
    quotes = F.array_distinct(F.filter(quotes, lambda q: (F.length(q) >= QUOTE_CHARS) & ~F.contains(F.col("held"), F.lower(F.btrim(visible(q), F.lit(" .,;:"))))))
    values = F.transform(F.regexp_extract_all(visible(F.col("text")), F.lit(PERIOD), 0), F.lower)
    values = F.array_distinct(F.filter(values, lambda v: ~F.contains(F.col("held"), v) & ~F.contains(F.col("question"), v)))
    unowned = F.filter("own", lambda p: F.array_contains(F.col("cited"), p["n"].cast("bigint")) & ~F.coalesce(p["trusted"], F.lit(False)))
    blank = F.array(F.lit("").alias("what"))
    found = F.flatten(F.array_compact(F.array(
        _each(F.lit(True), "unknown", F.array_except("cited", known)),
        _each(none & (F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != ""), "uncited", blank),
        _each(none & (F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == ""), "empty", blank),
        _each(F.lit(True), "quote", quotes),
        _each(F.lit(True), "value", values),
        _each(~F.col("text").rlike(ADMITS_UNFILLED), "placeholder", F.array_distinct(F.regexp_extract_all("text", F.lit(PLACEHOLDER), 0))),
        _each(~F.col("text").rlike(ADMITS_UNOWNED), "unowned", F.array_distinct(F.transform(unowned, lambda p: p["label"]))),
    )))
    return x.select("id", F.explode(found).alias("f")).select("id", "f.*")


def disagreements(answers: DataFrame, spans: DataFrame, passages: DataFrame) -> DataFrame:
    """id, unsupported and unmarked of answers (id, text): passages that the text marks and no span quotes, and the reverse, both sorted.

    spans (id, passage) tell which passages were quoted, passages (id, n) which exist, both from 1; others are ignored.  Answers without spans, or where both agree, are left out."""
    said = spans.groupBy("id").agg(F.collect_set(F.col("passage").cast("bigint")).alias("said"))
    known = passages.groupBy("id").agg(F.collect_set(F.col("n").cast("bigint")).alias("known"))
    x = answers.join(said, "id").join(known, "id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<bigint>")))
    marked, said = F.array_intersect(marks(F.coalesce("text", F.lit(""))), "known"), F.array_intersect("said", "known")
    x = x.select("id", F.array_sort(F.array_except(marked, said)).alias("unsupported"), F.array_sort(F.array_except(said, marked)).alias("unmarked"))
    return x.where(F.size("unsupported") + F.size("unmarked") > 0)
