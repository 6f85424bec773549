"""Joins whose output may outgrow their input: results against plain Python, and plans that neither group nor exchange what was expanded."""

import collections
import math
import random
import re

from pyspark.sql import functions as F

from attestry.operators import coverage, deontic, drift, evidence, grounding, lint, retrieval, search, selection, sync


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_claims_are_not_grouped(spark):
    rng = random.Random(1)
    req = [(str(i), rng.choice(["p", "q", None])) for i in range(30) for _ in range(2)]
    anchors = [(o, a) for o in "xyz" for a in ["p", "q", *map(str, range(0, 30, 3))] if rng.random() < 0.5] * 2
    direct = {(i, o) for i, _ in req for o, a in anchors if i == a}
    want = {(i, o, True) for i, o in direct} | {(i, o, False) for i, p in req for o, a in anchors if i and p == a and i not in {d for d, _ in direct}}
    got = coverage.claims_of(spark.createDataFrame(req, "id string, parent string"), spark.createDataFrame(anchors, "owner string, anchor string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert not re.search(r"Aggregate \[id#\d+, owner#\d+", plan(got))


def test_control_matches_are_not_grouped(spark):
    queries = spark.createDataFrame([(1, "AC-2"), (1, "AC-2(1)"), (1, "AC-2"), (2, "AC-2(1)"), (3, "AC-3"), (4, None)], "query int, control string")
    chunks = spark.createDataFrame([(7, "AC-2(1)"), (7, "AC-2(1)"), (8, "AC-2"), (9, "AC-22"), (9, ""), (9, None)], "id int, control string")
    got = retrieval.control_matches(queries, chunks)
    assert sorted(map(tuple, got.collect())) == [(1, 7, "AC-2(1)"), (1, 8, "AC-2"), (2, 7, "AC-2(1)")]
    assert not re.search(r"Aggregate \[query#\d+, id#\d+, control#\d+", plan(got))


def test_document_evidence_is_not_grouped(spark):
    cited = spark.createDataFrame([(1, "a", "1"), (1, "a", "2"), (1, "f", "x"), (2, "a", "2"), (2, "a", "2"), (3, "a", "9"), (3, "f", "?")], "doc int, framework string, id string")
    index = spark.createDataFrame([("a", "1"), ("a", "2"), ("f", "x"), ("f", "y"), ("g", "x")], "framework string, id string")
    walk = spark.createDataFrame([("1", "f", "x"), ("1", "f", "y"), ("2", "f", "y"), ("2", "f", "y"), ("2", "g", "x"), ("9", "g", "x")], "anchor_id string, framework string, id string")
    accepted = spark.createDataFrame([("f", "y", "2", "reviewed"), ("g", "x", "1", "never")], "framework string, id string, anchor_id string, provenance string")
    got = evidence.document_evidence(cited, index, walk, accepted, "a")
    reached = [(r.doc, r.framework, r.id, r.via, r.provenance) for r in got.where("state = 'reached'").collect()]
    assert sorted(reached) == [(1, "f", "y", "1", "published"), (1, "g", "x", "2", "published"), (2, "f", "y", "2", "reviewed"), (2, "g", "x", "2", "published")]
    assert sorted((r.doc, r.framework, r.id, r.state, r.occurrences) for r in got.where("state <> 'reached'").collect()) == [
        (1, "a", "1", "cited", 1), (1, "a", "2", "cited", 1), (1, "f", "x", "cited", 1), (2, "a", "2", "cited", 2), (3, "a", "9", "unknown", 1), (3, "f", "?", "unknown", 1),
    ]
    assert not re.search(r"Aggregate \[doc#\d+, framework#\d+, id#\d+\], \[[^\]]*min\(", plan(got))


def test_document_evidence_of_one_class_is_dealt_out(spark):
    rng = random.Random(2)
    names, anchors = [(f, str(i)) for f in "fg" for i in range(60)], "1 2 3".split()
    cited = [(d, "a", a) for d in range(300) for a in anchors if rng.random() < 0.8] + [(d, *rng.choice(names)) for d in range(300) for _ in range(d % 4)] + [(None, "a", "2"), (7, "f", None)]
    walk = [(a, *n) for n in names for a in (anchors if n[0] == "f" else ["1"])] + [("3", "h", "solo"), (None, "h", "none")]
    accepted = [("f", str(i), "2", "reviewed") for i in range(0, 60, 7)]
    index = {("a", a) for a in anchors} | {n for n in names if n[1] != "13"}
    has = collections.defaultdict(set)
    for d, *n in cited:
        has[d].add(tuple(n))
    want = []
    for d, own in has.items():
        for n in {w[1:] for w in walk}:
            via = min((a for a, *m in walk if tuple(m) == n and ("a", a) in own), default=None)
            if via and (d is None or not (n in own and n in index)):
                want.append((d, *n, via, "reviewed" if (*n, via, "reviewed") in accepted else "published"))
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    given = frame(cited, "doc int, framework string, id string"), frame(index, "framework string, id string"), frame(walk, "anchor_id string, framework string, id string")
    got = evidence.document_evidence(*given, frame(accepted, "framework string, id string, anchor_id string, provenance string"), "a", block=16, pieces=32).where("state = 'reached'")
    rows = got.select("doc", "framework", "id", "via", "provenance", F.spark_partition_id()).collect()
    assert sorted(map(repr, (tuple(r)[:-1] for r in rows))) == sorted(map(repr, want))
    assert max(collections.Counter(r[-1] for r in rows).values()) < len(rows) / 8


def test_fingerprints_send_nothing_through_the_driver(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "name string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "3"), ("y", "8")], "name string, hash string")
    got = sync.fingerprints(old, new)
    assert sorted(map(tuple, got.collect())) == [("a", "same"), ("b", "changed"), ("c", "renamed"), ("d", "removed"), ("y", "added"), ("z", "renamed")]
    assert "Broadcast" not in plan(got, "executedPlan")


def test_impact_meets_changes_without_copies(spark):
    changes = spark.createDataFrame([("1",), ("1",), ("2",)], "id string")
    rows = lambda key: spark.createDataFrame([("1", "n"), ("1", "n"), ("3", "n")], f"{key} string, name string")
    got = drift.impact(changes, rows("anchor"), rows("cited"), rows("control_id"))
    assert sorted(map(tuple, got.collect())) == [("1", "document", "n"), ("1", "parameter", "n"), ("1", "topic", "n")]
    assert "Join LeftSemi" in plan(got) and "Join Inner" not in plan(got)


def test_words_are_stemmed_where_they_lie(spark):
    texts = spark.createDataFrame([(1, "MFA doors, door DOORS authentication"), (1, "a door"), (2, None), (3, "")], "id int, text string")
    posts = retrieval.postings(texts)
    assert sorted(map(tuple, posts.collect())) == [(1, "authent", 1), (1, "authentication", 1), (1, "door", 4), (1, "factor", 1), (1, "mfa", 1), (1, "multi", 1)]
    forms = search.surface_forms(texts.where("text <> 'a door'"))
    assert sorted(map(tuple, forms.collect())) == [(1, "authent", "authentication"), (1, "door", "doors"), (1, "mfa", "mfa")]
    assert "Join" not in plan(posts) and "Join" not in plan(forms)


def test_expansion_terms_cut_a_reply_once(spark):
    rows = [(1, 'Keys, "doors",keys\nKEYS, - a b c d\n'), (2, "one two three four five, x"), (3, None), (4, ""), (5, ",".join(f"W{k % 15},w{k % 15}" for k in range(40)))]
    x = spark.createDataFrame(rows, "id int, text string").select("id", selection.expansion_terms(F.col("text")).alias("t"))
    assert {r.id: r.t for r in x.collect()} == {1: ["Keys", "doors", "a b c d"], 2: [], 3: None, 4: [], 5: [f"W{k}" for k in range(12)]}
    assert plan(x).count("[,") == 1


def test_ranked_chunks_are_not_joined_with_terms(spark):
    rng = random.Random(3)
    words = "access door doors key keys locked review reviewed staff tested MFA authentication x1".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(60)] + [(60, None), (61, "")]
    asked = [(q, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for q in range(20)] + [(20, None), (21, "nowhere")]
    chunks, queries = spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame(asked, "query int, text string")
    terms = lambda text: [t for w in re.findall("[a-z0-9]+", (text or "").lower()) for t in retrieval.terms_of(w)]
    held = {k: collections.Counter(terms(x)) for k, x in rows}
    df, average = collections.Counter(t for c in held.values() for t in c), sum(c.total() for c in held.values()) / len(held)
    want = []
    for q, x in asked:
        score = {}
        for k, c in held.items():
            parts = [math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / average)) for t in set(terms(x)) & set(c)]
            score |= {k: round(sum(parts), 4)} if parts else {}
        best = sorted(score, key=lambda k: (-score[k], k))[:7]
        want += [(q, k, score[k], n) for n, k in enumerate(best, 1)]
    counted = retrieval.term_counts(chunks, {"text": 1}, ["id"])
    assert {(r.id, t): n for r in counted.collect() for t, n in zip(r.terms, r.tfs)} == {(k, t): n for k, c in held.items() for t, n in c.items()}
    got = retrieval.bm25(chunks, queries, 7)
    assert sorted(map(tuple, got.select("query", "id", "score", "rank").collect())) == sorted(want)
    assert not re.search(r"Aggregate \[query#\d+, id#\d+", plan(got))
    assert got.where("false").count() == 0 and retrieval.bm25(chunks.where("false"), queries, 7).count() == 0 and retrieval.bm25(chunks, queries.where("false"), 7).count() == 0


def test_each_text_of_a_tag_is_split_once(spark):
    docs = [(k, f"# One\nsaid [ACME 1.2 High | 3] and [ACME 1.2 High | 3]\n\n## [ACME 9] Two\nagain [Beta {k % 2}.1]\nnothing") for k in range(20)]
    known, ids = spark.createDataFrame([("ACME", "acme")], "name string, key string"), spark.createDataFrame([("acme", "1.2")], "key string, id string")
    got = evidence.document_citations(spark.createDataFrame(docs, "id int, body string"), known, ids)
    want = {(k, n, tag, pos, *rest) for k in range(20) for n, tag, pos, *rest in [
        (2, 0, 0, "ACME", "acme", "1.2", "High", "One"), (2, 0, 1, "ACME", "acme", "3", "", "One"), (2, 1, 0, "ACME", "acme", "1.2", "High", "One"), (2, 1, 1, "ACME", "acme", "3", "", "One"),
        (4, 0, 0, "ACME", "acme", "9", "", "Two"), (5, 0, 0, "Beta", None, f"{k % 2}.1", "", "Two"),
    ]}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert not re.search(r"Aggregate \[\w+#\d+\.?\w*\], \[[^\]]*max_by", plan(got)) or "named_struct(id" not in plan(got)


def test_rules_and_phrases_look_at_first_letters(spark):
    plain = [re.sub(r"^(\(\?\w+\))\(\?=\[?\w+\]?\)", r"\1", p) for _, p in lint.INJECTION_RULES]
    assert sum(p != q for p, (_, q) in zip(plain, lint.INJECTION_RULES, strict=True)) == 8  # all but the one that is bound to a line's start
    said = "ignore İgnore ıgnore ſkip Skip the rules your ſystem prompt its THE system persona instructions you are now an from on act as a pretend to be \n . ! please reply Äsay with only exactly do not never cite dear model INSUFFICIENT_CONTEXT BEGIN END pf-1 new instructions:".split(" ")
    rng = random.Random(5)
    texts = spark.createDataFrame([(k, " ".join(rng.choices(said, k=40))) for k in range(1500)], "id int, text string").cache()
    rules = [(str(n), p) for n, (_, p) in enumerate(lint.INJECTION_RULES)]
    got, want = (sorted(map(tuple, lint.injections(texts, r).collect())) for r in (rules, list(zip(map(str, range(9)), plain, strict=True))))
    assert got == want and len({g[1] for g in got}) == 9
    slow = re.compile(deontic._MODAL.pattern.removeprefix("(?=[mswioca])"), re.I)
    words = "must MAY ſhould shall ıs İs is not allowed permitted are required To to at the discretion of optional can elect will be ought".split()
    assert deontic._MODAL.pattern != slow.pattern
    for _ in range(3000):
        x = " ".join(rng.choices(words, k=12))
        assert [(m.span(), m.lastgroup) for m in deontic._MODAL.finditer(x)] == [(m.span(), m.lastgroup) for m in slow.finditer(x)]


def test_windows_without_rare_words_are_not_aligned():
    class Counted(list):
        windows = 0

        def __getitem__(self, k):
            self.windows += isinstance(k, slice)
            return super().__getitem__(k)

    rng = random.Random(5)
    own = b"the keeper of a reliquary and the warden in the lighthouse is to be by on observatory".split()
    common = b"the of a and in is to be by on".split()
    tokens = Counted(rng.choices(common, k=4000) + own[:4] + [b"or"] + own[5:] + rng.choices(common, k=4000))
    assert grounding.Fragment(own).end(tokens, 0) == 4000 + len(own)
    assert grounding.Fragment(own).end(tokens, 4010) is None
    assert 0 < tokens.windows < 100


def test_texts_are_cut_into_words_once_and_again_for_candidates(spark):
    quotes = spark.createDataFrame([(1, "access is reviewed each quarter"), (2, "none of this is there"), (3, None)], "quote int, text string")
    texts = [(str(k), f"Word{k} Access [Selection: x] is \u00e4reviewed, each \u212aquarter" if k % 2 else f"word{k} access is\u00e9 REVIEWED; each quarter") for k in range(40)] + [("x", None), ("x", "access is reviewed each quarter"), (None, "access is reviewed each quarter")]
    got = grounding.grounded(quotes, spark.createDataFrame([(*t, None) for t in texts], "id string, text string, heading string"))
    assert sorted(map(tuple, got.collect())) == sorted([(1, str(k)) for k in range(0, 40, 2)] + [(1, "x")])
    final = plan(got, "executedPlan").split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") == 2 and "array_distinct" not in final
