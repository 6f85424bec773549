"""Stems, questions with ids and acronyms, and quotes, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, stem
from ..operators import grounding, retrieval, search
from . import stemming
from .bindings import _TOK, query


@query(f"WITH vocab AS (SELECT DISTINCT unnest({_TOK.format('text')}) AS word FROM documents UNION SELECT DISTINCT unnest({_TOK.format('html')}) FROM pages), {stemming.TERMS} SELECT word, stem FROM stems")
def txt_stem(t):
    words = t.documents.select(F.explode(keys.tokens(F.col("text"))).alias("word")).unionByName(t.pages.select(F.explode(keys.tokens(F.col("html"))).alias("word")))
    return stem.stems(words)


# Texts open with ids of three kinds and acronyms, in shapes that the row's numbers choose.
_MARKED = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'MFA and SSO, ' WHEN 1 THEN 'see AC-' || doc_id % 23 || '(' || doc_id % 4 || '): ' WHEN 2 THEN '164.' || doc_id % 400 || '(a) ' WHEN 3 THEN doc_id % 13 || '.a ' || doc_id % 9 || '.1' || doc_id % 10 || ' ' ELSE '' END || text AS text FROM documents"""


def _marked(t):
    n = lambda k: (F.col("doc_id") % k).cast("string")
    lead = F.when(F.col("doc_id") % 5 == 0, "MFA and SSO, ").when(F.col("doc_id") % 5 == 1, F.concat(F.lit("see AC-"), n(23), F.lit("("), n(4), F.lit("): ")))
    lead = lead.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("164."), n(400), F.lit("(a) "))).when(F.col("doc_id") % 5 == 3, F.concat(n(13), F.lit(".a "), n(9), F.lit(".1"), n(10), F.lit(" "))).otherwise("")
    return t.documents.select("doc_id", F.concat(lead, "text").alias("text"), "lang", "source")


@query(f"""WITH m AS ({_MARKED}), d AS (SELECT doc_id AS id, unnest(range(len(t))) AS pos, unnest(t) AS word FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM m)), vocab AS (SELECT DISTINCT word FROM d), {stemming.TERMS}
SELECT id, stem, arg_min(word, pos) AS form FROM d JOIN stems USING (word) GROUP BY 1, 2""")
def txt_surface(t):
    return search.surface_forms(_marked(t).select(F.col("doc_id").alias("id"), "text"))


@query(f"""WITH m AS ({_MARKED}), d AS (SELECT doc_id AS id, unnest({_TOK.format('text')}) AS word FROM m), vocab AS (SELECT DISTINCT word FROM d), {stemming.TERMS}
SELECT id, term, count(*) AS tf FROM d JOIN terms USING (word) GROUP BY 1, 2""")
def txt_tokens(t):
    return retrieval.postings(_marked(t).select(F.col("doc_id").alias("id"), "text"))


# Questions are the test items, with an id, a citation's cue or an acronym; their second sentence is the expansion.
_ASK = """SELECT item_id AS query, CASE item_id % 6 WHEN 1 THEN 'What does AC-' || item_id % 40 || ' say? ' WHEN 2 THEN 'section 4.1' || item_id % 10 || ' ' WHEN 3 THEN 'HIPAA 164.' || item_id || ' ' WHEN 4 THEN 'MFA ' WHEN 5 THEN 'CSF 77.' || (10 + item_id % 80) || ' ' ELSE '' END
  || CASE WHEN item_id % 8 = 7 THEN '' ELSE text END AS text, split_part(text, '. ', 2) AS expansion FROM benchmark"""
_CITES = """list_distinct(list_concat(list_concat(list_transform(regexp_extract_all({0}, '\\b([A-Za-z]{{2}}-[0-9]+(?:\\([0-9]+\\))?)', 1), lambda x: upper(x)), regexp_extract_all({0}, '\\b([0-9]{{3}}\\.[0-9]+(?:\\([A-Za-z0-9]+\\))*)', 1)),
  list_transform(regexp_extract_all({0}, '(?i)\\b([0-9]{{1,2}}\\.(?:[a-z]{{1,2}}|[0-9]{{2}}))\\b', 1), lambda x: lower(x))))"""


@query(f"""WITH m AS (SELECT m.doc_id, m.text, lang, source, m.doc_id % 3 = 0 AS trusted FROM ({_MARKED}) m JOIN documents d ON m.doc_id = d.doc_id), a AS ({_ASK}),
d AS (SELECT doc_id AS id, unnest({_TOK.format('text')}) AS word, 1 AS n FROM m UNION ALL SELECT doc_id, unnest({_TOK.format('lang')}), 3 FROM m UNION ALL SELECT doc_id, unnest({_TOK.format('source')}), 2 FROM m),
g AS (SELECT query, unnest(range(len(t))) AS pos, unnest(t) AS word FROM (SELECT query, {_TOK.format('text')} AS t FROM a)),
e AS (SELECT query, unnest({_TOK.format('expansion')}) AS word FROM a),
vocab AS (SELECT word FROM d UNION SELECT word FROM g UNION SELECT word FROM e), {stemming.TERMS},
x AS (SELECT id, term, sum(n) AS tf FROM d JOIN terms USING (word) GROUP BY ALL),
l AS (SELECT doc_id AS id, coalesce(sum(tf), 0) AS len FROM m LEFT JOIN x ON m.doc_id = x.id GROUP BY 1), w AS (SELECT count(*) AS n, avg(len) AS avg FROM l),
own AS (SELECT query, pos, term FROM g JOIN terms USING (word)),
ask AS (SELECT DISTINCT query, term, 1.0::DOUBLE AS weight FROM own UNION SELECT query, term, 0.6::DOUBLE FROM e JOIN terms USING (word) WHERE (query, term) NOT IN (SELECT query, term FROM own)),
f AS (SELECT term, count(*) AS df FROM x WHERE term IN (SELECT term FROM ask) GROUP BY 1),
h AS (SELECT query, id, sum(weight * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))) AS s, bool_or(df <= 0.5 * n) AS rare
  FROM x JOIN f USING (term) JOIN ask USING (term) JOIN l USING (id), w GROUP BY 1, 2),
v AS (SELECT query, id, count(DISTINCT pos) AS covered FROM own JOIN x USING (term) GROUP BY 1, 2),
i AS (SELECT query, text, unnest({_CITES.format('text')}) AS id FROM a),
s AS (SELECT query, upper(id) AS asked, bool_or(regexp_full_match(id, '[A-Za-z]{{2}}-[0-9]+(\\([0-9]+\\))?') OR regexp_matches(text, '(?i)(\\b(hitrust|csf|cfr|hipaa)\\b|§|\\[)[^\\]\\n]{{0,12}}' || replace(replace(replace(id, '.', '\\.'), '(', '\\('), ')', '\\)'))) AS sure FROM i GROUP BY 1, 2),
c AS (SELECT query, doc_id AS id, count(DISTINCT cited) AS cited FROM s JOIN (SELECT doc_id, unnest({_CITES.format('text')}) AS cited FROM m) ON cited = asked OR starts_with(cited, asked || '(') GROUP BY 1, 2),
z AS (SELECT query, (SELECT count(*) FROM g WHERE g.query = a.query) AS size, query IN (SELECT query FROM c) AS found, query IN (SELECT query FROM s WHERE sure) AS sure FROM a),
y AS (SELECT coalesce(h.query, c.query) AS query, coalesce(h.id, c.id) AS id, coalesce(s, 0) + 8 * coalesce(cited, 0) AS bare, CAST(coalesce(cited, 0) AS INT) AS cited, coalesce(rare, false) AS rare FROM h FULL JOIN c ON h.query = c.query AND h.id = c.id),
o AS (SELECT y.query, y.id, round(bare + CASE WHEN trusted THEN 0.5::DOUBLE ELSE 0 END, 6) AS score, CAST(coalesce(covered, 0) AS INT) AS covered, y.cited
  FROM y JOIN m ON m.doc_id = y.id JOIN z ON z.query = y.query LEFT JOIN v ON v.query = y.query AND v.id = y.id
  WHERE bare > 0 AND (found OR NOT sure AND size > 0) AND (y.cited > 0 OR rare OR size > 0 AND coalesce(covered, 0) >= 0.75 * size))
SELECT query, id, score, covered, cited, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INT) AS rank FROM o QUALIFY rank <= 10""")
def ret_gate(t):
    n = lambda k: (F.col("item_id") % k).cast("string")
    when = lambda k, *parts: (F.col("item_id") % 6 == k, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    lead = F.when(*when(1, "What does AC-", n(40), " say? ")).when(*when(2, "section 4.1", n(10), " ")).when(*when(3, "HIPAA 164.", F.col("item_id").cast("string"), " ")).when(*when(4, "MFA "))
    lead = lead.when(*when(5, "CSF 77.", (F.col("item_id") % 80 + 10).cast("string"), " ")).otherwise("")
    text = F.concat(lead, F.when(F.col("item_id") % 8 == 7, "").otherwise(F.col("text")))
    asked = t.benchmark.select(F.col("item_id").alias("query"), text.alias("text"), F.split_part("text", F.lit(". "), F.lit(2)).alias("expansion"))
    chunks = _marked(t).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("section"), F.col("source").alias("title"), (F.col("doc_id") % 3 == 0).alias("trusted"))
    return search.search(chunks, asked, 10)


# Items are quoted with a word left out or put in, or with an ellipsis in place of words, from texts with bracketed parameters; SQL has no such alignment.
@query()
def gnd_grounded(t):
    cut = F.col("item_id") % 4
    text = F.when(cut == 1, F.regexp_replace("text", r"^(\S+ \S+ \S+ \S+) \S+", "$1")).when(cut == 2, F.regexp_replace("text", r"^(\S+ \S+ \S+) ", "$1 also ")).when(cut == 3, F.regexp_replace("text", r"^((?:\S+ ){6})\S+ \S+ ", "$1... ")).otherwise(F.col("text"))
    texts = t.documents.select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"^(\S+ \S+) ", "$1 [Assignment: as often as needed] ").alias("text"), F.col("source").alias("heading"))
    return grounding.grounded(t.benchmark.select(F.col("item_id").alias("quote"), text.alias("text")), texts)


@query(r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(regexp_replace(text, '(?i)\[(?:Assignment|Selection)[^\]]*\]', ' ', 'g')), '[a-z0-9]+') AS words FROM documents)
SELECT a.id AS quote, b.id FROM w a JOIN w b ON a.words = b.words WHERE len(a.words) > 0 AND a.id % 50 = 0""")
def gnd_whole(t):
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    return grounding.whole_quotes(texts.where("id % 50 = 0").select(F.col("id").alias("quote"), "text"), texts)
