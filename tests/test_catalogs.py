"""Catalogs assembled from export rows and read from OSCAL, against small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from attestry.operators import learning, params
from attestry.sources import catalogs, oscal


def sources(spark, lines, **how):
    return {r.source for r in learning.learned_sources(spark.createDataFrame([(x,) for x in lines], "line string"), **how).collect()}


def test_names_end_where_words_vary(spark):
    lines = [f"Guide One r5 AC-{k}" for k in range(8)] + [f"Guide One r4 AC-{k}" for k in range(8)] + [f"Rule § 164.{k}" for k in range(7)]
    assert sources(spark, lines) == {"Guide One r5", "Guide One r4", "Rule"}
    few = [f"Rare Source {k}" for k in range(3)]
    assert sources(spark, few) == {"Rare Source"}  # a name that never branches leaves one word
    assert sources(spark, ["alone", "", None]) == {"alone"}
    iso = [f"ISO/IEC {n}:2022 {k}(2)" for n in (27001, 27002, 27799) for k in range(7)] + [f"ISO/IEC {23890 + k}" for k in range(4)]
    assert sources(spark, iso) == {"ISO/IEC 27001:2022", "ISO/IEC 27002:2022", "ISO/IEC 27799:2022", "ISO/IEC"}
    assert sources(spark, [f"A {k}" for k in range(3)], branches=3) == {"A"}
    long = " ".join(f"w{k}" for k in range(30))
    assert sources(spark, [long]) == {"w0"}


def record(seq, reference, level, statement="", **more):
    row = dict.fromkeys([x.split(" ")[0] for x in learning.RECORD.split(", ")])
    return tuple((row | {"seq": seq, "reference": reference, "level": level, "statement": statement} | more).values())


def test_assembly(spark):
    cut = "Level Digital Personal Data Protecti"
    rows = [
        record(0, "01.b  User Registration", "Level 2", "short", category="of the shorter record"),
        record(1, "01.a Access Control Policy", "Level FedRAMP", "overlay", mapping="Guide r5 AC-1\r\nGuide r5 AC-2\nGuide r5 AC-1\n\xa0\nLaw § 1"),
        record(2, "01.b User Registration", "Level 2", "the longer statement", category="01.0 - Access Control", objective="01.02 Authorized Access", specification=" Users\n are registered. ", factor_type="System", mapping="Law § 2"),
        record(3, "01.a Access Control Policy", "Level 1", "one", organizational_factors="a\r\n b \n\n", mapping="Guide r5 AC-3\nGuide r5 AC-4"),
        record(4, "01.a Access Control Policy", cut, "cut"),
        record(5, "No number", cut + "on Act", "whole", mapping="Guide r5 AC-5\nGuide r5 AC-6\nGuide r5 AC-7"),
        record(6, "", "Level 1", "no reference"), record(7, "01.c X", None, "no level"),
    ]
    got = {r.control_id: r for r in learning.assembled(spark.createDataFrame(rows, learning.RECORD)).collect()}
    assert set(got) == {"01.a", "01.b", "No number"}
    a, b = got["01.a"], got["01.b"]
    assert (b.pos, b.title, b.family, b.family_abbr) == (0, "User Registration", "Access Control", "01.0") and a.family is None
    assert (b.objective_id, b.objective_title, b.control_statement, b.factor_type) == ("01.02", "Authorized Access", "Users are registered.", "System")
    assert [(r.level, r.level_kind, r.requirement_id) for r in a.requirements] == [("Level 1", "maturity", "01.a Level 1"), (cut + "on Act", "overlay", f"01.a {cut}on Act"), ("Level FedRAMP", "overlay", "01.a Level FedRAMP")]
    assert a.baseline == f"Level 1, {cut}on Act, Level FedRAMP" and a.pos == 1 and a.title == "Access Control Policy"
    assert a.requirements[0].organizational_factors == ["a", "b"] and a.requirements[0].mappings == {"Guide r5": ["AC-3", "AC-4"]}
    assert a.requirements[2].mappings == {"Guide r5": ["AC-1", "AC-2"], "Law": ["1"]}
    assert b.requirements[0].statement == "the longer statement" and b.requirements[0].mappings == {"Law": ["2"]}
    assert learning.assembled(spark.createDataFrame([], learning.RECORD)).count() == 0


def test_parameters_nest_and_end(spark):
    known = [("s", "a", "[Assignment: organization-defined time]"), ("s", "b", "[Selection: {{ insert: param, a }}; never]"), ("s", "c", "x {{ insert: param, d }}"), ("s", "d", "y {{insert: param,c}}"), ("t", "a", "other scope")]
    texts = [(1, "s", "within {{ insert: param, b }} or {{ insert: param, a }}."), (2, "s", "{{ insert: param, c }}"), (3, "s", "no {{ insert: param, zz }} here"), (4, "t", "{{ insert: param, a }}"), (5, "s", ""), (6, "s", None)]
    got = params.resolved(spark.createDataFrame(texts, "key int, scope string, text string"), spark.createDataFrame(known, "scope string, id string, text string"))
    assert {r.key: r.text for r in got.collect()} == {
        1: "within [Selection: [Assignment: organization-defined time]; never] or [Assignment: organization-defined time].",
        2: "x y [Assignment: organization-defined parameter]", 3: "no {{ insert: param, zz }} here", 4: "other scope", 5: "",
    }
    rows = spark.createDataFrame([("frequency", None, None), ("organization-defined roles", None, None), (None, [" a ", "b"], "one-or-more"), ("x", ["c"], None), ("", None, None)], "label string, choices array<string>, many string")
    assert [r.p for r in rows.select(params.printed(F.col("label"), F.col("choices"), F.col("many")).alias("p")).collect()] == [
        "[Assignment: organization-defined frequency]", "[Assignment: organization-defined roles]", "[Selection (one or more): a; b]", "[Selection: c]", "[Assignment: organization-defined parameter]",
    ]


def control(id_, label, title, statement=None, guidance=None, **more):
    parts = [{"name": "statement", **({"prose": statement} if isinstance(statement, str) else {"parts": statement})}] if statement else []
    parts += [{"name": "guidance", "prose": guidance}] if guidance else []
    return {"id": id_, "title": title, "props": [{"name": "label", "value": "PAD", "class": "zero-padded"}, {"name": "label", "value": label}], "parts": parts, **more}


def item(label, prose=None, *parts):
    return {"name": "item", "props": [{"name": "label", "value": label}], **({"prose": prose} if prose else {}), **({"parts": list(parts)} if parts else {})}


def catalog(*controls, **more):
    return {"catalog": {"metadata": {"version": "9.1"}, "groups": [{"id": "ac", "title": "Access Control", "controls": list(controls)}], **more}}


WITHDRAWN = [{"name": "status", "value": "withdrawn"}]


@pytest.fixture
def read(spark, tmp_path):
    def run(content, baselines=None, **how):
        (tmp_path / "catalog.json").write_text(json.dumps(content), encoding="utf-8")
        held = None
        if baselines:
            for name, ids in baselines.items():
                (tmp_path / f"{name}.profile").write_text(json.dumps({"profile": {"imports": [{"include-controls": [{"with-ids": ids}]}]}}), encoding="utf-8")
            held = oscal.profile_ids(spark, {n: str(tmp_path / f"{n}.profile") for n in baselines})
        return {r.control_id: r for r in oscal.controls(oscal.catalog_json(spark, str(tmp_path / "catalog.json")), held, **how).collect()}

    return run


def test_oscal_controls(read):
    first = control(
        "ac-1", "AC-1", "Policy", [item("a.", "Develop {{ insert: param, ac-01_odp.01 }}:", item("1.", "first ", item("(a)", "deep {{ insert: param, ac-01.01_odp }}")), item("2.")), item("b.", "Review.")], " Guidance. ",
        params=[{"id": "ac-01_odp.01", "select": {"how-many": "one-or-more", "choice": ["organization-level", "{{ insert: param, ac-01_odp.02 }} "]}}, {"id": "ac-01_odp.02", "label": "level"}],
        links=[{"rel": "related", "href": "#ia-1"}, {"rel": "reference", "href": "#x"}, {"rel": "related", "href": "#ac-2.1"}, {"rel": "related", "href": "#ia-1"}],
        controls=[control("ac-1.1", "AC-1(1)", "Enhanced", "Uses {{ insert: param, ac-01_odp.02 }}.", params=[{"id": "ac-01.01_odp"}]), control("ac-1.2", "AC-1(2)", "Gone", "x", props=WITHDRAWN)],
    )
    got = read(catalog(first, control("ac-2", "AC-2", "Accounts"), control("ac-3", "AC-3", "Old", "y", props=WITHDRAWN, controls=[control("ac-3.1", "AC-3(1)", "Old too")])), {"Moderate": ["ac-1", "ac-1.1"], "Low": ["ac-1"], "Own": ["ac-1", "ac-2"]})
    assert set(got) == {"AC-1", "AC-2"}
    r = got["AC-1"]
    assert r.control_statement == "a. Develop [Selection (one or more): organization-level; [Assignment: organization-defined level]]:\n  1. first\n    (a) deep [Assignment: organization-defined parameter]\nb. Review."
    assert r.discussion == "Guidance." and r.related_controls == ["IA-1", "AC-2(1)"] and r.baseline == "Low, Moderate, Own" and (r.pos, r.family, r.family_abbr) == (1, "Access Control", "AC")
    assert (r.framework, r.framework_version) == ("NIST 800-53", "Rev 5 (9.1)")
    assert [(e.enhancement_id, e.title, e.baseline, e.description) for e in r.enhancements] == [("AC-1(1)", "Enhanced", "Moderate", "Uses [Assignment: organization-defined level].")]
    assert (got["AC-2"].control_statement, got["AC-2"].enhancements, got["AC-2"].baseline, got["AC-2"].pos) == ("", [], "Own", 2)


def test_oscal_refuses_to_lose_controls(read):
    inner = control("ac-1", "AC-1", "Policy", "x")
    with pytest.raises(ValueError, match="declares 2 controls, of which 1 are read and 0 withdrawn: 1 would be lost"):
        read({"catalog": {"metadata": {"version": "1"}, "groups": [{"id": "ac", "controls": [inner], "groups": [{"id": "in", "controls": [inner]}]}]}})
    deep = control("ac-1", "AC-1", "P", "x", controls=[control("ac-1.1", "AC-1(1)", "E", "y", controls=[inner])])
    with pytest.raises(ValueError, match="1 would be lost"):
        read(catalog(deep))


def test_oscal_sorted_ids(read):
    c = {"id": "sp_1", "title": "Accounts", "props": [{"name": "label", "value": "Account Management (03.01.01)"}, {"name": "sort-id", "value": "03.01.01"}], "parts": [{"name": "statement", "parts": [item("SR-03.01.01.a", "Define."), item("odd", "Keep.")]}]}
    got = read({"catalog": {"metadata": {"version": "3"}, "groups": [{"id": "g", "title": "Access", "props": [{"name": "sort-id", "value": "03.01"}], "controls": [c]}]}}, dialect=oscal.SP800_171)
    assert got["03.01.01"].control_statement == "a Define.\nodd Keep." and got["03.01.01"].family_abbr == "03.01"


def test_labels_of_ids(spark):
    rows = spark.createDataFrame([("ac-2",), ("ac-2.1",), ("ac-02.010",), ("x",)], "i string")
    assert [r.l for r in rows.select(oscal.label_of(F.col("i")).alias("l")).collect()] == ["AC-2", "AC-2(1)", "AC-2(10)", "X"]


def test_a_crosswalk_is_not_overwritten_with_losses(spark, tmp_path):
    shape, path = "anchor_id string, framework string, requirement_id string", str(tmp_path / "xw")
    edges = spark.createDataFrame([("AC-1", "A", "r1"), ("AC-1", "A", "r2"), ("AC-2", "B", "r1")], shape)
    catalogs.write_crosswalk(edges, path)
    held = lambda: sorted((r.anchor_id, r.framework, r.requirement_ids) for r in spark.read.json(path).collect())
    assert held() == [("AC-1", "A", ["r1", "r2"]), ("AC-2", "B", ["r1"])]
    with pytest.raises(ValueError, match="1 anchors would lose a framework's edges: AC-2 -> B"):
        catalogs.write_crosswalk(edges.where("framework = 'A'"), path)
    assert len(held()) == 2
    catalogs.write_crosswalk(edges.unionByName(spark.createDataFrame([("AC-3", "A", "r1")], shape)), path)
    assert len(held()) == 3
    catalogs.write_crosswalk(edges.where("framework = 'A'"), path, allow_loss=True)
    assert held() == [("AC-1", "A", ["r1", "r2"])]
