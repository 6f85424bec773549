"""Strengths, blocks and headings by hand-written expectations; statements of composed documents by how they were composed."""

import pytest
from pyspark.sql import functions as F

from attestry.operators import deontic
from attestry.operators.deontic import document_statements, strength

A, B = "[NIST 800-53 AC-2]", "[HIPAA Security Rule 164.308(a)(3)(i)]"


def read(text):
    return [(s["line"], s["text"], s["citations"]) for s in document_statements(text) if not s["heading"]]


@pytest.mark.parametrize(
    ("sentence", "expected"),
    [
        ("Keys **must** be held by two people, who may be absent.", "obligation"),
        ("Guests MAY NOT enter.", "prohibition"),
        ("Vendors should ask and may wait.", "recommendation"),
        ("A second copy is optional.", "permission"),
        ("Doors are blue.", "none"),
        ("", "none"),
        ("Sign-off is required.", "obligation"),
        ("Keys and doors, is required To.", "none"),
        ("If so, staff is required To.", "obligation"),
        ("So, is required to stay.", "obligation"),
        ("Now, Is Required To Stay.", "obligation"),
        ("NOW, ARE REQUIRED TO STAY.", "obligation"),
        ("No sign-off is required.", "none"),
        ("Nothing here is mandatory, they say.", "none"),
        ("Say what is required.", "none"),
        ("If a badge is required, ask.", "none"),
        ("When staff are not permitted to leave, guards shall open.", "obligation"),
        ("Features are required or addressable.", "none"),
        ("A pass (see the list; page 2) is required.", "obligation"),
        ("A pass, where there is a gate, is required.", "obligation"),
        ("Phones -- tablets among them -- are not allowed.", "prohibition"),
        ("information that: (i) Is not permitted by law", "none"),
        ("Terms such that no consent and no notice are required", "none"),
        ("While plans are required for some, others wait.", "none"),
        ("Approval may be required.", "permission"),
        ("Interviews may not always be possible.", "none"),
        ("These may also be known as last accounts.", "none"),
        ("The code may not be known to anyone.", "prohibition"),
        ("Tools may not be left open.", "prohibition"),
        ("It may not be possible, but it shall be tried.", "obligation"),
        ("The night team is responsible for closing doors.", "obligation"),
        ("The owner of this Standard is accountable for reviewing it.", "obligation"),
        ("This Standard is responsible for setting terms.", "none"),
        ("Testing is responsible for finding faults.", "none"),
        ("Engineering is responsible for finding faults.", "obligation"),
        ("IT is responsible for patching hosts.", "obligation"),
        ("It is responsible for patching hosts.", "none"),
        ("The team is responsible for any use of it.", "none"),
        ("NIST suggests that a team is responsible for finding faults.", "none"),
        ("The desk files reports; and is accountable for keeping them.", "obligation"),
        ("This policy covers desks and is responsible for keeping order.", "none"),
    ],
)
def test_strength(sentence, expected):
    assert strength(sentence) == expected


@pytest.mark.parametrize(
    ("sentence", "marked", "plain"),
    [
        ("Rooms as of +1 (787) 555-9138 the desk is required.", "none", "obligation"),
        ("Rooms, of (787) as such, is required.", "obligation", "obligation"),
        ("Rooms (of desks, and so, as such) as is required.", "none", "none"),
        ("Rooms that*** is required.", "none", "obligation"),
        ("Rooms, so, *** is required.", "obligation", "none"),
        ("Rooms — so — is required.", "obligation", "none"),
        ("Rooms -- as it is -- is required.", "obligation", "none"),
        ("Rooms, so, is required.", "obligation", "obligation"),
        ("If so (787) it is required.", "none", "obligation"),
        ("No room (as such) is required.", "none", "none"),
        ("INGRE, is required TO.", "none", "none"),
    ],
)
def test_strength_of_plain_words(sentence, marked, plain):
    assert (strength(sentence), strength(sentence, marked=False)) == (marked, plain)


PHONE = "Rooms as on +1 (787) 555-9138 are the room of is the."
LINES = [PHONE, "Rooms as (no in of, in (so in as) to is the.", "Doors that*** is it is the, of, *** is to.", "As -- so -- is (to) on, in, it (in a, b, is the.", "INGRE!! , is TO!! *** OF."]


@pytest.mark.parametrize("name", ["dnt_analyze", "dnt_weak", "gnd_claims"])
def test_phones_and_marks_are_read_as_by_sql(spark, tmp_path, name):
    import duckdb

    from attestry.plans import bindings

    rows = [(3 * shift + tagged, "\n".join(["x"] * shift + LINES * 3)) for shift in range(8) for tagged in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = bindings.QUERIES[name](spark, str(tmp_path))
    want = con.execute(bindings.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want.fetchall())


def test_a_long_sentence_of_exempt_predicates_takes_one_pass():
    assert strength("no pass is required and " * 40_000) == "none"
    assert strength(" " * 1_000_000 + "must") == "obligation"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (f"Logs must be read. {A}\nDoors open.", [(1, "Logs must be read.", [A]), (2, "Doors open.", [])]),
        (f"Logs must be read.\n{A} | {B}.\n\nDoors open.", [(1, "Logs must be read.", [A, B]), (4, "Doors open.", [])]),
        (f"Logs must be read {B} at dawn. Next.", [(1, f"Logs must be read {B} at dawn.", [B]), (1, "Next.", [])]),
        (f"Logs must be read.\n- doors shall close {A}.", [(1, "Logs must be read.", []), (2, f"- doors shall close {A}.", [A])]),
        (f"- one must read\n- two shall read {A}", [(1, "- one must read", []), (2, f"- two shall read {A}", [A])]),
        (f"Keep for no fewer than\n90) days {A}.", [(1, f"Keep for no fewer than 90) days {A}.", [A])]),
        (f"Keep rounds, and\n1. rounds are kept {A}.", [(1, "Keep rounds, and", []), (2, f"1. rounds are kept {A}.", [A])]),
        (f"Staff must list:\n\n- keys {A}\n\n  kept for a year {B}\n- doors\n\nthen they rest", [(1, f"Staff must list: - keys {A} kept for a year {B} - doors", [A, B]), (8, "then they rest", [])]),
        (f"Staff must list: {A}\n- keys\n- doors\n\n{B}\n\nThe end.", [(1, f"Staff must list: {A} - keys - doors {B}", [A, B]), (7, "The end.", [])]),
        (f"## Part\n{A}\nLogs must be read.", [(3, "Logs must be read.", [A])]),
        (f"end without stop\n\nnew paragraph {A}", [(1, "end without stop", []), (3, f"new paragraph {A}", [A])]),
        (f"Logs wait\n***\n{A} and after", [(1, "Logs wait", []), (3, "and after", [A])]),
        ("The U.S. Department asks. J. Smith says.", [(1, "The U.S. Department asks.", []), (1, "J. Smith says.", [])]),
        ("", []),
        (None, []),
        (" \n\n \t", []),
    ],
)
def test_blocks_and_citations(text, expected):
    assert read(text) == expected


def test_headings():
    text = f"# What Staff Must Do\nPlain {A}\ntext must stand\n---\nAfter.\n\n> ## Doors Must Close {B} ##\n- item\n---\n##\nTitle\n===\nShall Statements\n----\nCameras are prohibited\n==\n### Rooms That Must Be Shut"
    got = [(s["line"], s["text"], s["modality"], s["citations"]) for s in document_statements(text) if s["heading"]]
    assert got == [
        (1, "What Staff Must Do", "none", []), (2, f"Plain {A} text must stand", "obligation", [A]), (7, f"Doors Must Close {B}", "obligation", [B]), (11, "Title", "none", []),
        (13, "Shall Statements", "none", []), (15, "Cameras are prohibited", "prohibition", []), (17, "Rooms That Must Be Shut", "none", []),
    ]
    assert read(text) == [(5, "After.", []), (8, "- item", [])]


def test_composed_documents(spark):
    """Every order of parts whose statements are known alone gives those statements, at the lines where the parts stand."""
    parts = [
        ("# Part 1\n", [(1, "Part 1", "none", [], True)]),
        (f"Guards must watch.\n{A}\n", [(1, "Guards must watch.", "obligation", [A], False)]),
        (f"Gates, doors and\nwindows should close {B}. Bells ring.\n", [(1, f"Gates, doors and windows should close {B}.", "recommendation", [B], False), (2, "Bells ring.", "none", [], False)]),
        ("Staff may not carry:\n- knives\n* ropes\n", [(1, "Staff may not carry: - knives * ropes", "prohibition", [], False)]),
        (f"Doors Must Close\n---\n1. first\n2) second must hold {A}\n", [(1, "Doors Must Close", "obligation", [], True), (3, "1. first", "none", [], False), (4, f"2) second must hold {A}", "obligation", [A], False)]),
    ]
    rows, want = [], []
    for a in range(5):
        for b in range(5):
            for c in range(5):
                body, id_ = "", len(rows)
                for text, known in (parts[a], parts[b], parts[c]):
                    body += "***\n" if body else ""
                    want += [(id_, body.count("\n") + line, *rest) for line, *rest in known]
                    body += text
                rows.append((id_, body, "x"))
    docs = spark.createDataFrame([*rows, (900, None, "y"), (901, "", "y")], "id long, body string, citations string")
    got = deontic.analyzed(docs.repartition(3))
    assert sorted((r.id, r.line, r.text, r.modality, r.citations, r.heading) for r in got.collect()) == sorted(want)
    twice = deontic.analyzed(docs.unionByName(docs))
    assert twice.count() == 2 * len(want)
    assert deontic.analyzed(docs.where("false")).count() == 0


def test_weakened_unsupported_and_claims(spark):
    voluntary = "[NIST AI RMF Playbook Govern 1.1 Action 1 | Govern 1.2]"
    mixed = "[NIST AI RMF Playbook Govern 1.1 Action 1 | NIST 800-53 AC-2]"
    body = f"Logs should be read {A}. Doors must close {A} {B} {A}. Gates are green. Rooms shall be shut. NIST suggests lists {voluntary}. NIST suggests more {mixed}."
    s = deontic.analyzed(spark.createDataFrame([("d", body)], "id string, body string"))
    firsts = lambda df: [r.text.split()[0] + str(r.pos) for r in df.orderBy("pos").collect()]
    assert firsts(deontic.weakened(s)) == ["Logs0", "NIST4", "NIST5"]
    assert firsts(deontic.weakened(s, ["NIST AI RMF Playbook"], ["NIST 800-53", "HIPAA Security Rule"])) == ["Logs0", "NIST5"]
    assert firsts(deontic.unsupported(s)) == ["Rooms3"]


def test_claims_take_the_tags_of_their_lines(spark):
    body = f"One must go. Two shall stay.\n{A}\nfree line {B}\n\nThree must run. {B} Four may.\n{A}\n# Doors Must Close {A}\n\nlast"
    docs = spark.createDataFrame([("d", body), ("e", f"Five must sit {B} {B}."), ("n", None)], "id string, body string")
    s = deontic.analyzed(docs)
    got = {(r.id, r.line, r.citation) for r in deontic.claims(s, docs).collect()}
    assert [(r.pos, r.line) for r in s.where("id = 'd'").orderBy("pos").collect()] == [(0, 1), (1, 1), (2, 3), (3, 5), (4, 5), (5, 7), (6, 9)]
    assert got == {("d", 1, A), ("d", 5, B), ("d", 7, A), ("e", 1, B)}
    twos = {(r.pos, r.citation) for r in deontic.claims(s, docs).where("id = 'd'").collect()}
    assert twos == {(1, A), (3, B), (5, A)}  # of two statements that start on a line, the later one holds the lines below


def test_bullets(spark):
    docs = spark.createDataFrame([(1, f"- Keep keys. Always. {A}\r\n  * doors {B} \ntext\n-\n-- x\n"), (2, None), (3, "")], "id int, body string")
    got = [(r.id, r.line, r.text, r.tags) for r in deontic.bullets(docs).orderBy("id", "line").collect()]
    assert got == [(1, 1, f"Keep keys. Always. {A}", [A]), (1, 2, f"doors {B}", [B]), (1, 5, "- x", [])]


def test_cited_sentences(spark):
    rows = [
        (1, "Keys burn. [1] Doors [2] close [1][2]. Bells ring [9]. [3][03]; Rooms wait.", 3), (2, "[1] Alone. After [0].", 2), (3, None, 2), (4, "Nothing [1].", None), (5, "", 1),
        (6, "The U.S. Department [1] asks. [2]", 2),
    ]
    got = [(r.id, r.pos, r.sentence, r.cited) for r in deontic.cited_sentences(spark.createDataFrame(rows, "id int, text string, passages int")).orderBy("id", "pos").collect()]
    assert got == [(1, 0, "Keys burn.", [1]), (1, 1, "Doors close .", [2, 1]), (1, 2, "Bells ring .", [3]), (6, 0, "The U.S. Department asks.", [1, 2])]


def test_document_citations(spark):
    from attestry.operators import evidence

    known = spark.createDataFrame([("NIST 800-53", "nist-800-53"), ("HIPAA Security Rule", "hipaa-security-rule"), ("HITRUST", "hitrust")], "name string, key string")
    ids = spark.createDataFrame([("nist-800-53", "AC-2"), ("nist-800-53", "AC-3"), ("hipaa-security-rule", "164.308"), ("hitrust", "01.a Level 1")], "key string, id string")
    body = "free [NIST 800-53 AC-2 Low | AC-3]\n## Keys [HITRUST 01.a Level 1 Extra | HIPAA 164.308]\ntext [NIST 800-53 ZZ-9 High] [Other 1.2]\n#### Doors\n[nope] [HITRUST 01.a Level 1]"
    docs = spark.createDataFrame([("d", body), ("e", None), ("f", "none")], "id string, body string")
    got = [(r.line, r.framework, r.key, r.id, r.qualifier, r.section) for r in evidence.document_citations(docs, known, ids).orderBy("line", "tag", "pos").collect()]
    assert got == [
        (1, "NIST 800-53", "nist-800-53", "AC-2", "Low", ""), (1, "NIST 800-53", "nist-800-53", "AC-3", "", ""), (2, "HITRUST", "hitrust", "01.a Level 1", "Extra", "Keys"),
        (2, "HIPAA", "hipaa-security-rule", "164.308", "", "Keys"), (3, "NIST 800-53", "nist-800-53", "ZZ-9 High", "", "Keys"), (3, "Other", None, "1.2", "", "Keys"), (5, "HITRUST", "hitrust", "01.a Level 1", "", "Doors"),
    ]


def test_zero_reasons(spark):
    from attestry.operators import coverage

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    need = frame([(f, i) for f in "abcdefg" for i in ("1", "2", "3")] + [("a", "1")], "framework string, id string")
    reached = frame([("a", "1", "full"), ("a", "1", "partial"), ("b", "1", "partial"), ("c", "9", "full")], "framework string, id string, reach string")
    mapped = frame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "3"), ("g", "8")], "framework string, id string")
    known = frame([("b", "searched", "x"), ("d", "design", "never"), ("e", "upstream", None), ("f", "searched", "none there")], "framework string, kind string, reason string")
    got = sorted((tuple(r) for r in coverage.zero_reasons(need, reached, mapped, known).collect()))
    assert got == [("b", "mapped", 1, 1, 1, None), ("c", "mapped", 0, 1, 2, None), ("d", "design", None, None, None, "never"), ("e", "upstream", None, None, None, ""), ("f", "searched", None, None, None, "none there"), ("g", "mapped", 0, 0, 3, None)]
