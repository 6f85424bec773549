"""Regulations from small documents in the code's XML."""

import pytest
from pyspark.sql import functions as F

from attestry.sources import regulations


def document(*sections):
    return "<DIV6>" + "".join(f'<DIV8 N="{n}" TYPE="SECTION">\n<HEAD>{head}</HEAD>' + "".join(f"<P>{p}</P>\n" for p in ps) + "</DIV8>" for n, head, ps in sections) + "</DIV6>"


SECURITY = document(
    ("164.304", "&#xA7; 164.304   Definitions.", ["<I>Access</I> means access."]),
    ("164.308", "&#xA7; 164.308 Administrative safeguards.", [
        "(a) A covered entity must, in accordance with &#xA7; 164.306:",
        "(1)(i) <I>Standard: Security management process.</I> Implement policies &amp; procedures.",
        "(ii) <I>Implementation specifications:</I>",
        "(A) <I>Risk analysis (Required).</I> Conduct an assessment.",
        "(B) <I>Risk management (Addressable).</I> Reduce risks",
        "(<I>1</I>) to a level;",
        "(2) <I>Standard: Assigned responsibility.</I> Identify the official.",
        "(b)(1) <I>Business associate contracts.</I> May permit.",
        "(2) <I>Implementation specifications (Required)</I>&#x2014;(i) <I>Contracts.</I> The contract must&#x2014;",
        "(A) Comply with this; and", "(B) Report &#x201C;it&#x201D;.",
    ]),
    ("164.312", "&#xA7; 164.312 Technical safeguards.", [
        "(c)(1) <I>Standard: Integrity.</I> Protect.", "(2) <I>Implementation specification: Mechanism (Addressable).</I> Confirm.", "(d) <I>Standard: Authentication.</I> Verify.", "(i) <I>Standard: Ninth.</I> Go on.",
    ]),
)


@pytest.fixture
def written(tmp_path):
    def run(xml):
        (tmp_path / "rule.xml").write_text(xml, encoding="utf-8")
        return str(tmp_path / "rule.xml")

    return run


def test_security_rule(spark, written):
    got = {r.control_id: r for r in regulations.security_rule(spark, written(SECURITY)).collect()}
    assert list(sorted(got)) == ["164.308(a)(1)(i)", "164.308(a)(2)", "164.308(b)(1)", "164.308(b)(2)(i)", "164.312(c)(1)", "164.312(d)", "164.312(i)"]
    first = got["164.308(a)(1)(i)"]
    assert (first.title, first.control_statement, first.related_controls) == ("Security management process", "Implement policies & procedures.", ["164.306"])
    assert [tuple(e) for e in first.enhancements] == [("164.308(a)(1)(ii)(A)", "Risk analysis", "Required", "Conduct an assessment."), ("164.308(a)(1)(ii)(B)", "Risk management", "Addressable", "Reduce risks (1) to a level;")]
    assert got["164.308(b)(1)"].enhancements == [] and got["164.308(b)(1)"].related_controls == []  # its specification says nothing of its own
    assert got["164.308(b)(2)(i)"].control_statement == "The contract must— Comply with this; and Report “it”." and got["164.308(b)(2)(i)"].title == "Contracts"
    assert [tuple(e) for e in got["164.312(c)(1)"].enhancements] == [("164.312(c)(2)", "Implementation specification: Mechanism", "Addressable", "Confirm.")]
    assert got["164.312(d)"].title == "Authentication"


@pytest.mark.parametrize("tokens,want", [
    (["(a)", "(1)", "(i)", "(A)", "(B)", "(ii)", "(2)", "(b)"], ["(a)", "(a)(1)", "(a)(1)(i)", "(a)(1)(i)(A)", "(a)(1)(i)(B)", "(a)(1)(ii)", "(a)(2)", "(b)"]),
    (["(a)(1)(i)", "(c)", "(2)", "(d)", "(1)", "(v)", "(l)"], ["(a)(1)(i)", "(c)", "(c)(2)", "(d)", "(d)(1)", "(d)(1)(v)", "(l)"]),
    (["(h)", "(i)", "no token", "(1)(x)"], ["(h)", "(i)", "(i)", "(i)(1)(x)"]),
])
def test_citations_follow_from_order(spark, tokens, want):
    rows = spark.createDataFrame([(tokens,)], "p array<string>").select(regulations.citations(F.col("p"), F.lit("9.9")).alias("c"))
    assert rows.first().c == [f"9.9{w}" for w in want]


def test_security_rule_refuses_losses(spark, written):
    with pytest.raises(ValueError, match="164.312a"):
        regulations.security_rule(spark, written(SECURITY.replace('N="164.312"', 'N="164.312a"')))
    with pytest.raises(ValueError, match="relates no standard"):
        regulations.security_rule(spark, written(document(("164.310", "&#xA7; 164.310 X.", ["(z) As &#xA7; 164.306 says:", "(a) <I>Standard: A.</I> B."]))))
    with pytest.raises(ValueError, match="relates no standard"):
        regulations.security_rule(spark, written(document(("164.310", "&#xA7; 164.310 X.", ["See &#xA7; 999 first:", "(a) <I>Standard: A.</I> B."]))))
    with pytest.raises(ValueError, match="can't be read: all"):
        regulations.security_rule(spark, written("<DIV6></DIV6>"))
    assert regulations.security_rule(spark, written(document(("164.302", "&#xA7; 164.302 Applicability.", ["Applies to all."])))).count() == 0


PART = document(
    ("2.16", "§ 2.16 Security for records.", [
        "Framing text.", "(a) <I>Requirements for policies.</I> Have <I>formal</I> ones:", "(1) Paper:", "(i) first;", "(v) fifth;", "(2) [Reserved]", "(b) Second.", "(d) not a letter that follows", "(c) <I>Named elsewhere</I>", "(1) a", "(d) Fourth.",
    ]),
    ("2.19", "§ 2.19 Disposition.", [f"({c}) Text {c}." for c in "abcdefghi"] + ["(1) x", "(j) [Reserved]", "(j) y"]),
    ("2.2", "§ 2.2 Purpose.", ["Nothing."]),
)


def test_lettered_rule(spark, written):
    got = {r.control_id: r for r in regulations.lettered_rule(spark, written(PART), r"^2\.\d{1,2}$", ["2.16", "2.19"]).collect()}
    r = got["2.16"]
    assert (r.title, r.control_statement) == ("Security for records.", "Framing text.")
    assert [tuple(e) for e in r.enhancements] == [
        ("2.16(a)", "Requirements for policies", "", "Have formal ones: (1) Paper: (i) first; (v) fifth;"), ("2.16(b)", "", "", "Second. (d) not a letter that follows"), ("2.16(c)", "Named elsewhere", "", "(1) a"), ("2.16(d)", "", "", "Fourth."),
    ]
    assert [e.enhancement_id for e in got["2.19"].enhancements] == [f"2.19({c})" for c in "abcdefghij"]  # (i) follows (h) where no list is open
    with pytest.raises(ValueError, match="2.99"):
        regulations.lettered_rule(spark, written(PART), r"^2\.\d{1,2}$", ["2.16", "2.99"])
    with pytest.raises(ValueError, match="2.19"):
        regulations.lettered_rule(spark, written(PART), r"^2\.1?[0-8]?$", ["2.16"])
