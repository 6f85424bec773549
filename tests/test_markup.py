"""Markdown of pages by hand-written expectations; people and references by expressions."""

import pytest
from pyspark.sql import functions as F

from attestry.operators import markup
from attestry.operators.markup import page_text

CODE = '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">sh</ac:parameter><ac:plain-text-body><![CDATA[a < b\n\n  c ]]]]><![CDATA[> d\n]]></ac:plain-text-body></ac:structured-macro>'


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        (None, ""),
        ("", ""),
        ("<p> </p><!-- x --><script>var a = '<p>';</script>", ""),
        ("<h1>A <b>big</b> title</h1><p>Some *text* with a_b [NIST IA-5]</p>", "# A **big** title\n\nSome \\*text\\* with a\\_b [NIST IA-5]"),
        ("<p>one<p>two <em>half", "one\n\ntwo *half*"),
        ("a &amp; b &lt;c&gt;<br/>d", "a & b <c>  \nd"),
        ("<ul><li>a<ul><li>b</li><li>c</li></ul></li><li><p>d</p><p>e</p></li></ul>", "- a\n  - b\n  - c\n- d\n\n  e"),
        ('<ol start="9"><li>a<li>b<ul><li>c</ul></ol>', "9. a\n10. b\n    - c"),
        ("<table><tbody><tr><th>h</th><th>i</th></tr><tr><td><p>x</p><p>y|z</p></td><td></td></tr><tr><td>w</td></tr></tbody></table>", "| h | i |\n| --- | --- |\n| x y\\|z |  |\n| w |  |"),
        ("<blockquote><p>a</p><p>b</p></blockquote><hr/>c", "> a\n>\n> b\n\n---\n\nc"),
        ('<pre><code class="language-py">x *= 1\n  y\n</code></pre>', "```py\nx *= 1\n  y\n```"),
        (f"<p>before</p>{CODE}<p>after</p>", "before\n\n```sh\na < b\n\n  c ]]> d\n```\n\nafter"),
        ('<p>See <a href="/x?a=1&amp;b=2">the list</a>, <code>a_b</code>.</p>', "See [the list](/x?a=1&b=2), `a_b`."),
        ('<p>Ask <ac:link><ri:user ri:account-id="u1"/></ac:link> or <ac:link><ri:user ri:userkey="u2" /></ac:link>.</p>', "Ask Ann or @unresolved-user."),
        ('<p><ac:link><ri:page ri:space-key="S" ri:content-title="Keys &amp; Doors"/></ac:link> <ac:link><ri:page ri:content-title="P"/><ac:plain-text-link-body><![CDATA[the page]]></ac:plain-text-link-body></ac:link></p>', "Keys & Doors the page"),
        ('<p>x <ac:image ac:height="2"><ri:attachment ri:filename="a.png"/></ac:image><ac:image></ac:image></p>', "x [image: a.png][image]"),
        ("</p></ul>a</b> <i> </i>b", "a b"),
        ("1 < 2 and <b>3 <", "1 < 2 and **3 <**"),
    ],
)
def test_page_text(source, expected):
    assert page_text(source, {"u1": "Ann"}) == expected


def test_deep_nesting_ends():
    assert page_text("<div>" * 5000 + "x").strip() == "x"
    assert "y" in page_text("<ul><li>" * 60 + "y")


def test_mentions_references_and_names(spark):
    page = '<ac:link><ri:user ri:account-id="b"/></ac:link><ac:link><ri:user ri:account-id="a"/></ac:link><ac:link a="1"><ri:page ri:content-title="T2"/></ac:link><ac:link>\n<ri:page ri:content-title="T1"/></ac:link><ac:link><ri:page ri:content-title="T2"/></ac:link>'
    pages = spark.createDataFrame([(1, page, "n"), (1, page, "n"), (None, page, "n"), (2, "<p>x</p>", "n"), (3, None, "n")], "id int, html string, name string")
    got = pages.where("id = 1").select(markup.user_ids(F.col("html")).alias("u"), markup.references(F.col("html")).alias("r")).first()
    assert (got.u, got.r) == (["a", "b"], ["T2", "T1"])
    names = spark.createDataFrame([("b", "Bea"), ("b", "Bob"), ("a", None), ("c", "Cy")], "user string, name string")
    rows = sorted((str(r.id), r.text) for r in markup.as_markdown(pages, names).collect())
    said = "Bea@unresolved-userT2T1T2"
    assert rows == [("1", said), ("1", said), ("2", "x"), ("3", ""), ("None", said)]
    assert markup.as_markdown(pages).where("id = 2").first().text == "x"
    assert markup.as_markdown(pages.where("false"), names).count() == 0


def test_references_without_semicolon_are_text_to_the_query(spark):
    from attestry.plans import bindings, deontics  # noqa: F401  (bindings first: the others add to it)

    _terminated = deontics._terminated

    pages = spark.createDataFrame([(1, "<h1>cut&amp</h1><p>R&D &lt;b&gt; &#39; x&</p>")], "id int, html string").select("id", _terminated(F.col("html")).alias("html"))
    assert markup.as_markdown(pages).first().text == "# cut&amp\n\nR&D <b> ' x&"
    assert page_text("<h1>cut&amp</h1>") == "# cut&"
