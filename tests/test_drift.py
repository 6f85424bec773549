"""Changes between catalog loads and what they reach, on small fixtures."""

from attestry.operators import drift
from attestry.sources.catalogs import CONTROL


def control(id_, statement="", enhancements=(), **more):
    names = [c.split(" ")[0] for c in CONTROL.replace("map<string,array<string>>", "m").replace("map<string,string>", "m").split(", ")]
    row = dict.fromkeys(["control_id", "title", "framework", "framework_version", "baseline", "control_statement", "discussion", "related_controls", "source_crosswalk", "parameter_values", "enhancements", "requirements"])
    assert set(row) <= set(names) | set(row)
    return tuple((row | {"control_id": id_, "control_statement": statement, "enhancements": [(e[0], e[1], e[2], e[3], e[4], None) for e in enhancements], **more}).values())


def load(spark, *controls):
    return spark.createDataFrame(controls, CONTROL)


def test_changes_of_controls_and_enhancements(spark):
    kept = ("AC-2(1)", "One", "High", "text", {"a": "x"})
    old = load(
        spark, control("AC-1", "Flow\n of words", title="T"), control("AC-2", "Review [Assignment: organization-defined time].", [kept, ("AC-2(2)", "Two", "", "gone", None), ("AC-2(3)", "Three", "Low", "reflowed  text", {"p": "1"})], related_controls=["B", "A"]),
        control("AC-3", "gone", [("AC-3(1)", "E", "", "with it", None)]), control("AC-5", None, None or (), discussion="same  words"),
    )
    new = load(
        spark, control("AC-1", "Flow of words", title="T"), control("AC-2", "Review [Assignment: organization-defined period].", [("AC-2(1)", "One", "Low", "text", {"b": "x"}), ("AC-2(3)", " Three", "Low", "reflowed text", {"p": "2"}), ("AC-2(4)", "New", "", "", None)], related_controls=["A", "B"], baseline="Low"),
        control("AC-4", "new", [("AC-4(1)", "E", "", "with it", None)]), control("AC-5", "", (), discussion="same words", title="Named", related_controls=["C"]),
    )
    got = {r.id: (r.parent, r.kind, r.fields) for r in drift.catalog_changes(old, new).collect()}
    assert got == {
        "AC-2": (None, "changed", "control_statement,baseline,enhancements,parameters"), "AC-2(1)": ("AC-2", "changed", "baseline,parameters"), "AC-2(2)": ("AC-2", "removed", ""), "AC-2(4)": ("AC-2", "added", ""),
        "AC-3": (None, "removed", ""), "AC-4": (None, "added", ""), "AC-5": (None, "changed", "title,related_controls"),
    }
    assert drift.catalog_changes(old, old).count() == 0 and drift.catalog_changes(old.limit(0), old.limit(0)).count() == 0


def test_rules_of_reach(spark):
    changes = spark.createDataFrame([("AC-2(3)",), ("Govern 1.1",), ("AC-9",)], "id string")
    topics = spark.createDataFrame([("ac-2", "accounts"), ("Govern 1", "governing"), ("AC-2(3)", "own")], "anchor string, name string")
    documents = spark.createDataFrame([("AC-2", "a.md"), ("AC-2(1)", "b.md"), ("AC-22", "c.md"), ("Govern 1.1", "d.md")], "cited string, name string")
    decisions = spark.createDataFrame([("ac-9/time", "k1"), ("AC-9(1)/x", "k2")], "key string, name string")
    run = lambda rule: {(r.id, r.what, r.name) for r in drift.reached(changes, topics, documents, decisions, rule).collect()}
    others = {("AC-2(3)", "document", "a.md"), ("AC-2(3)", "document", "b.md"), ("Govern 1.1", "document", "d.md"), ("AC-9", "parameter", "k1")}
    own = {("AC-2(3)", "topic", "accounts"), ("AC-2(3)", "topic", "own")}
    assert run("anchored") == others | own | {("Govern 1.1", "topic", "governing")}
    assert run("base") == others | own and run("none") == others
