"""Quality rules of documents and of the hosts that they come from, with DataFrame functions only.

Each document is measured and judged by rules.  The failures of each rule are counted by host, and
the hosts' failure rates are shrunk towards the rate of all hosts by a beta prior that is fitted
to them.  A host of which the shrunk rate of a rule lies above the prior's mean by more than so many
of its standard deviations takes its documents with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import stored

SEPARATORS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"


def measured(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each text; a text is read once and its repeats are found by sorting its windows."""
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumns({
        "words": F.filter(F.split("text", SEPARATORS), lambda w: w != ""),
        "word_chars": F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)),
    }).drop("text")
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    d = d.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    twice = F.filter("placed", lambda x, k: (x["h"] == F.get("placed", k - 1)["h"]) | (x["h"] == F.get("placed", k + 1)["h"]))
    d = d.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("placed")
    fresh = F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3))))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(fresh, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("at")


def beta_prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """The beta distribution with the hosts' mean failure rate and the spread of their rates (method of moments)."""
    r = hosts.agg(F.sum(rule).alias("f"), F.sum("n").alias("n"), F.var_pop(F.col(rule) / F.col("n")).alias("v")).first()
    if not r.n:
        return 1.0, 1.0
    mean = min(max(r.f / r.n, 1e-6), 1 - 1e-6)
    weight = min(max(mean * (1 - mean) / max(r.v, 1e-12) - 1, 1.0), 1e6)
    return mean * weight, (1 - mean) * weight


def judged_documents(documents: DataFrame, host: str = "source", fewest_words: int = 50, most_repeat_percent: int = 50, deviations: float = 1.0) -> DataFrame:
    """The counts of each row with short, repetitive, base_failed, host_failed and kept.

    short: fewer words than fewest_words; repetitive: more than most_repeat_percent of them in repeated
    3-word windows; base_failed: either.  host_failed: the host's rate of either rule, shrunk by that rule's prior, exceeds
    the prior's mean by more than deviations of its standard deviations.  With one host, or hosts of equal rates, none fails.  A
    null text has no words and fails.  Rows without a host are judged as one host.  Rows are
    judged one by one, so repeated rows count repeatedly; an empty table gives an empty result;
    other columns are ignored.
    """
    rules = {"short": F.col("n_words") < fewest_words, "repetitive": 100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words")}
    docs = stored(measured(documents, host).withColumns(rules), "rules")
    hosts = docs.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in rules))
    failed = F.lit(False)
    for rule in rules:
        a, b = beta_prior(hosts, rule)
        limit = a / (a + b) + deviations * (a * b / (a + b + 1)) ** 0.5 / (a + b)
        failed = failed | ((F.col(rule) + a) / (F.col("n") + a + b) > limit)
    verdicts = hosts.select(F.col("host").alias("judged"), failed.alias("host_failed"))
    out = docs.join(verdicts, F.col("host").eqNullSafe(F.col("judged")), "left").drop("judged")
    out = out.withColumn("base_failed", F.col("short") | F.col("repetitive"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
