"""Answer checks, close names and line changes against fixtures and plain Python."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import answers, similar

PASSAGE = "Accounts are **reviewed every 30 days** by the account’s owner – always. Records are kept 6 years."


def found(spark, text, question=None, passages=((1, PASSAGE, "Standard", True), (2, "An unowned runbook.", "Runbook", False))):
    a = spark.createDataFrame([(1, question, text)], "id int, question string, text string")
    p = spark.createDataFrame([(1, *x) for x in passages], "id int, n int, text string, label string, trusted boolean")
    return sorted((r.kind, r.what) for r in answers.findings(a, p).collect())


@pytest.mark.parametrize("text,question,want", [
    ("Accounts are reviewed [1].", None, []),
    ("Accounts are reviewed [1] [7] [7].", None, [("unknown", "7")]),
    ("Accounts are reviewed.", None, [("uncited", "")]),
    (" \n", None, [("empty", "")]), (None, None, [("empty", "")]),
    ('It says "accounts are reviewed every 30 days by the account\'s owner - always," [1].', None, []),
    ('It says “[A]ccounts are reviewed   every 30 days by” [1].', None, []),
    ('It says "accounts are reviewed every 90 or so" [1].', None, [("quote", "accounts are reviewed every 90 or so")]),
    ('It says "made up" [1].', None, []),
    ("Reviews are quarterly, kept 6 years [1].", None, [("value", "quarterly")]),
    ("Not quarterly but every 30 days [1].", "Is it Quarterly?", []),
    ("The [Ticketing System] logs [Assignment: x] it [1].", None, [("placeholder", "[Assignment: x]"), ("placeholder", "[Ticketing System]")]),
    ("The [Ticketing System] is a placeholder [1].", None, []), ("See [Link](x) and [lower] [1].", None, []),
    ("A runbook says so [2].", None, [("unowned", "Runbook")]), ("Supporting content says so [2].", None, []),
])
def test_findings(spark, text, question, want):
    assert found(spark, text, question) == want


def test_findings_without_passages(spark):
    assert found(spark, "So it is [1], daily.", passages=()) == [("unknown", "1"), ("value", "daily")]


def test_capitals_keep_their_number(spark):
    from attestry.plans import bindings, checks  # noqa: F401  (bindings first: the others add to it)

    _capitals = checks._capitals

    row = spark.createDataFrame([("ßie, ŉ é",)], "t string").select(_capitals(F.col("t")).alias("c"), F.lower(_capitals(F.col("t"))).alias("l")).first()
    assert (row.c, row.l) == ("ẞIE, ŉ É", "ßie, ŉ é")


def test_disagreements(spark):
    a = spark.createDataFrame([(1, "x [1] [2] [9]"), (2, "y [1]"), (3, "z"), (4, None)], "id int, text string")
    s = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (4, 1), (4, 9)], "id int, passage int")
    p = spark.createDataFrame([(i, n) for i in (1, 2, 3, 4) for n in (1, 2, 3)], "id int, n int")
    assert sorted((r.id, r.unsupported, r.unmarked) for r in answers.disagreements(a, s, p).collect()) == [(1, [1], [3]), (4, [], [1])]


def test_misspelled_equals_all_pairs(spark):
    rng = random.Random(4)
    frameworks = ["HIPAA Security Rule", "FedRAMP", "GovRAMP", "ARC-AMPE", "NIST 800-53", "aaaa bbbb", "Cybersecurity Framework 2.0"]
    edit = lambda s: "".join(c for c in s if rng.random() > 0.12) + rng.choice(["", " x", "e"])
    names = ["HIPPA Security Rule", "HIPAA", "hipaa  security RULE", "FedRAMP ", "FedRAMMP", "Security", "bbbb aaaa", ""] + [edit(rng.choice(frameworks)) for _ in range(80)]
    catalogs = [(f, f"{k}.{i}", f == "NIST 800-53") for k, f in enumerate(frameworks) for i in range(4)]
    overlays = [(n, f"{rng.randrange(7)}.{i}") for n in names for i in range(3)] + [("HIPPA Security Rule", "0.1"), ("HIPAA", "0.1"), ("NIST 800-5", "4.1"), (None, "0.1")]
    key = lambda s: " ".join(s.split()).lower()
    want = {
        (n, f) for n, i in overlays for f, j, anchor in catalogs
        if n is not None and i == j and not anchor and key(n) not in {key(x) for x in frameworks}
        and (difflib.SequenceMatcher(None, key(n), key(f)).ratio() >= 0.8 or set(key(n).split()) <= set(key(f).split()))
    }
    got = similar.misspelled(spark.createDataFrame(overlays, "name string, id string"), spark.createDataFrame(catalogs, "framework string, id string, anchor boolean")).collect()
    assert {(r.name, r.framework) for r in got} == want and len(got) == len(want) > 10
    assert {("HIPPA Security Rule", "HIPAA Security Rule"), ("HIPAA", "HIPAA Security Rule")} <= want


def test_line_changes_equal_unified_diffs(spark):
    rng = random.Random(8)
    line = lambda: rng.choice(["a", "b", "c", "++ plus", "-- minus", "", "long " * 3])
    rows = []
    for slug in "pqrs":
        text: list = []
        for k in range(30):
            if rng.random() < 0.8:
                at = rng.randrange(len(text) + 1)
                text = text[:at] + [line() for _ in range(rng.randrange(4))] + text[at + rng.randrange(3) :]
            rows.append((slug, k, rng.choice(["\n", "\r\n"]).join(text)))
    rows += [("big", 0, "\n".join("same" for _ in range(400))), ("big", 1, "\n".join(["same"] * 200 + ["other"] + ["same"] * 150)), ("none", 0, ""), ("none", 1, "")]
    want, last = set(), {}
    for slug, k, text in rows:
        before, n = last.get(slug, (None, 0))
        if text != before:
            d = list(difflib.unified_diff((before or "").splitlines(keepends=True), text.splitlines(keepends=True), "x", "y"))
            want.add((slug, k, n + 1, sum(x.startswith("+") and not x.startswith("+++") for x in d), sum(x.startswith("-") and not x.startswith("---") for x in d)))
            last[slug] = (text, n + 1)
    got = similar.line_changes(spark.createDataFrame(rows, "slug string, ord int, content string").repartition(5)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 60
