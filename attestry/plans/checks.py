"""Checks of answers, versions and names, bound to marked-up copies of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, similar
from .bindings import query

# What assistants said, with citations, quotes, periods and placeholders put in by the turn; a conversation has three test items as passages.
_ANSWERS = """SELECT c.conv_id * 1000 + c.turn AS id, CASE WHEN c.turn % 3 = 0 THEN 'Is it Quarterly or not?' END AS question, CASE c.conv_id % 7 WHEN 0 THEN c.text || ' [1][2] and [4]' WHEN 1 THEN c.text || ' "' || upper(substr(b.text, 3, 40)) || '," [1]'
  WHEN 2 THEN '“never said in any passage at all” [3] ' || c.text WHEN 3 THEN c.text || ' Reviews are quarterly, every **30 days** and ANNUALLY [2].' WHEN 4 THEN 'The [Ticketing System] and [x] log it [1]' || CASE WHEN c.turn % 2 = 0 THEN ' (a placeholder)' ELSE '' END
  WHEN 5 THEN CASE WHEN c.turn % 2 = 0 THEN ' ' ELSE c.text END ELSE c.text || ' as supporting content says [1] [3] "short"' END AS text
  FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 20 WHERE role = 'assistant'"""
_PASSAGES = """SELECT a.conv_id * 1000 + a.turn AS id, k AS n, b.text || CASE WHEN b.item_id % 4 = 1 THEN ' kept for 30 days' ELSE '' END AS text, 'item ' || b.item_id AS label, b.item_id % 2 = 0 AS trusted
  FROM conversations a, range(1, 4) r(k), benchmark b WHERE role = 'assistant' AND b.item_id = a.conv_id % 20 + k - 1"""


def _capitals(text):
    """text in capitals, letter by letter as SQL has them: ß is ẞ, and no letter becomes two."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "ß", "ẞ"))), "")


def _answers(t):
    c = t.conversations.where("role = 'assistant'").join(t.benchmark.select("item_id", F.col("text").alias("item")), F.col("item_id") == F.col("conv_id") % 20)
    even, shape, join = F.col("turn") % 2 == 0, F.col("conv_id") % 7, lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    text = (
        F.when(shape == 0, join(F.col("text"), " [1][2] and [4]")).when(shape == 1, join(F.col("text"), ' "', _capitals(F.substring("item", 3, 40)), '," [1]'))
        .when(shape == 2, join("“never said in any passage at all” [3] ", F.col("text"))).when(shape == 3, join(F.col("text"), " Reviews are quarterly, every **30 days** and ANNUALLY [2]."))
        .when(shape == 4, join("The [Ticketing System] and [x] log it [1]", F.when(even, " (a placeholder)").otherwise(""))).when(shape == 5, F.when(even, " ").otherwise(F.col("text")))
        .otherwise(join(F.col("text"), ' as supporting content says [1] [3] "short"'))
    )
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") % 3 == 0, "Is it Quarterly or not?").alias("question"), text.alias("text"))


def _passages(t):
    a = t.conversations.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") % 20).alias("first"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"))
    b = a.join(t.benchmark, F.col("item_id") == F.col("first") + F.col("n") - 1)
    text = F.concat("text", F.when(F.col("item_id") % 4 == 1, " kept for 30 days").otherwise(""))
    return b.select("id", "n", text.alias("text"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("label"), (F.col("item_id") % 2 == 0).alias("trusted"))


_LIKE = "''" * 6 + '"' * 7 + "-" * 7
_VISIBLE = rf"trim(regexp_replace(replace(translate(regexp_replace(regexp_replace({{0}}, '\*\*|__|\*|`', '', 'g'), '\[([A-Za-z])\]', '\1', 'g'), '‘’‚‛′´“”„‟″«»‐‑‒–—―−', '{_LIKE}'), '…', '...'), '\s+', ' ', 'g'))"


@query(rf"""WITH a AS ({_ANSWERS}), p AS ({_PASSAGES}), h AS (SELECT id, lower({_VISIBLE.format("string_agg(text, ' ' ORDER BY n)")}) AS held FROM p GROUP BY id),
x AS (SELECT a.id, lower(coalesce(question, '')) AS question, text, coalesce(held, '') AS held, list_distinct(list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda m: CAST(m AS BIGINT))) AS cited FROM a LEFT JOIN h ON a.id = h.id),
q AS (SELECT id, held, unnest(list_transform(regexp_extract_all(text, '"[^"]*"|“[^”]*”'), lambda m: m[2 : -2])) AS quote FROM x),
v AS (SELECT id, held, question, lower(unnest(regexp_extract_all({_VISIBLE.format('text')}, '(?i)\b(?:quarterly|annually|annual|biannually|semi-annually|monthly|weekly|daily|fortnightly|hourly|continuously|\d+\s*(?:hour|day|week|month|year|business day)s?)\b'))) AS value FROM x)
SELECT id, 'unknown' AS kind, CAST(n AS VARCHAR) AS what FROM (SELECT id, unnest(cited) AS n FROM x) c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = c.id AND p.n = c.n)
UNION ALL SELECT id, CASE WHEN trim(text) = '' THEN 'empty' ELSE 'uncited' END, '' FROM x WHERE len(cited) = 0
UNION ALL SELECT DISTINCT id, 'quote', quote FROM q WHERE length(quote) >= 25 AND NOT contains(held, lower(trim({_VISIBLE.format('quote')}, ' .,;:')))
UNION ALL SELECT DISTINCT id, 'value', value FROM v WHERE NOT contains(held, value) AND NOT contains(question, value)
UNION ALL SELECT DISTINCT id, 'placeholder', unnest(regexp_extract_all(text, '\[[A-Z][^\[\]\n]{{1,59}}\]')) FROM x WHERE NOT regexp_matches(text, '(?i)placeholder|unfilled|not filled|generic|bracket|left blank|undecided|not specif|no specific|not stat|not name|not identif|not assign|not set|no value|has not|have not|to be determined')
UNION ALL SELECT DISTINCT x.id, 'unowned', label FROM x JOIN p ON p.id = x.id AND list_contains(cited, n) WHERE NOT trusted AND NOT regexp_matches(x.text, '(?i)supporting|unowned|no declared owner|not claimed|unclaimed|no owner|nobody has claimed|does not name an owner')""")
def ans_check(t):
    return answers.findings(_answers(t), _passages(t))


@query(rf"""WITH a AS ({_ANSWERS}), p AS ({_PASSAGES}), s AS (SELECT DISTINCT id, n FROM p WHERE (id + n) % 3 > 0),
m AS (SELECT DISTINCT id, CAST(unnest(regexp_extract_all(text, '\[(\d+)\]', 1)) AS BIGINT) AS n FROM a), k AS (SELECT m.id, m.n FROM m JOIN p ON p.id = m.id AND p.n = m.n),
u AS (SELECT id, n, 1 AS marked FROM k WHERE (id, n) NOT IN (SELECT id, n FROM s) UNION ALL SELECT id, n, 0 FROM s WHERE (id, n) NOT IN (SELECT id, n FROM k))
SELECT id, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (WHERE marked = 1), '') AS unsupported, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (WHERE marked = 0), '') AS unmarked FROM u WHERE id IN (SELECT id FROM s) GROUP BY id""")
def ans_disagree(t):
    spans = _passages(t).where("(id + n) % 3 > 0").select("id", F.col("n").alias("passage")).unionByName(_passages(t).where("id % 2 = 0 and n = 1").select("id", F.lit(9).alias("passage")))
    out = answers.disagreements(_answers(t), spans, _passages(t))
    # An answer of which only passages that don't exist were quoted has spans, but none that count.
    return out.join(_passages(t).where("(id + n) % 3 > 0").select("id").distinct(), "id", "left_semi").select("id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("unsupported", "unmarked")))


# Documents of a language and source are versions of 97 texts; SQL has no matching of sequences.
@query()
def win_line_diff(t):
    return similar.line_changes(t.documents.select(F.concat_ws("/", "lang", "source", (F.col("doc_id") % 97).cast("string")).alias("slug"), F.col("doc_id").alias("ord"), F.col("text").alias("content")))


# Part types are catalogs of their parts; suppliers list parts under a type's name with a letter left out, a word left out, or as another one's.
@query()
def xw_typo(t):
    kinds = t.part.select(F.col("p_type").alias("framework"), F.col("p_partkey").alias("id"), F.col("p_type").startswith("PROMO").alias("anchor"))
    how, cut = F.col("l_suppkey") % 4, F.col("l_suppkey") % 9 + 2
    name = F.when(how == 0, F.concat(F.expr("substring(p_type, 1, 3)"), F.expr("substring(p_type, 5)"))).when(how == 1, F.regexp_extract("p_type", r"^(\S+ \S+)", 1)).when(how == 2, F.concat(F.lit("  "), F.lower("p_type"))).otherwise(F.concat(F.substr("p_type", F.lit(1), cut), F.lit("x"), F.substr("p_type", cut + 1)))
    overlays = t.lineitem.where("l_returnflag = 'R'").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(name.alias("name"), F.col("l_partkey").alias("id"))
    return similar.misspelled(overlays, kinds)
