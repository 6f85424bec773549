"""Selection, candidate, proposal, catalog and reply operators as queries, with the SQL of the same question."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import selection
from .bindings import _BM25, query

# Topics are nations, anchored at their suppliers; parts are enhancements of their brands, in frameworks by type.
@query("""WITH top AS (SELECT s_nationkey AS topic, s_suppkey AS pos, CAST(s_suppkey AS VARCHAR) AS anchor FROM supplier),
held AS (SELECT 'suppliers' AS framework, CAST(s_suppkey AS VARCHAR) AS id, CAST(s_suppkey AS VARCHAR) AS control FROM supplier WHERE s_suppkey % 7 <> 0
  UNION ALL SELECT p_type, CAST(p_partkey AS VARCHAR), p_brand FROM part WHERE p_size > 10),
edges AS (SELECT CAST(l_suppkey AS VARCHAR) AS anchor_id, p_type AS framework, CAST(l_partkey AS VARCHAR) AS requirement_id, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
x AS (SELECT topic, pos, anchor AS id, 'suppliers' AS framework, 0 AS step, CAST(NULL AS BIGINT) AS seq FROM top UNION ALL SELECT topic, pos, requirement_id, framework, 1, seq FROM top JOIN edges ON anchor = anchor_id),
y AS (SELECT topic, framework, control, pos, step, seq, row_number() OVER (PARTITION BY topic, framework, control ORDER BY pos, step, seq) AS n FROM x JOIN held USING (framework, id))
SELECT topic, framework, control, pos, step, seq FROM y WHERE n = 1""")
def syn_select(t):
    text = lambda c: F.col(c).cast("string")
    topics = t.supplier.select(F.col("s_nationkey").alias("topic"), F.col("s_suppkey").alias("pos"), text("s_suppkey").alias("anchor"))
    own = t.supplier.where("s_suppkey % 7 <> 0").select(F.lit("suppliers").alias("framework"), text("s_suppkey").alias("id"), text("s_suppkey").alias("control"))
    parts = t.part.where("p_size > 10").select(F.col("p_type").alias("framework"), text("p_partkey").alias("id"), F.col("p_brand").alias("control"))
    edges = t.lineitem.where("l_returnflag = 'R'").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    edges = edges.select(text("l_suppkey").alias("anchor_id"), F.col("p_type").alias("framework"), text("l_partkey").alias("requirement_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return selection.topic_controls(topics, own.unionByName(parts), edges, ["suppliers"])


# Documents are controls of the family of their language; each item was published with the document of its number.
_CANDIDATES = _BM25.replace("doc_id AS id", "lang || '-' || doc_id AS id").replace("* 2.5 /", "* 2.4 /").replace("+ 1.5 *", "+ 1.4 *")


@query(_CANDIDATES + """, m AS (SELECT query, id FROM r WHERE rank <= 15),
k AS (SELECT query, split_part(id, '-', 1) || '-1' AS id FROM m UNION SELECT item_id, 'en-' || item_id FROM benchmark)
SELECT query, id FROM m UNION SELECT query, id FROM k WHERE id IN (SELECT id FROM c)""")
def ret_candidates(t):
    entries = t.documents.select(F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("id"), "text")
    published = t.benchmark.select(F.col("item_id").alias("query"), F.concat(F.lit("en-"), F.col("item_id").cast("string")).alias("id"))
    return selection.candidates(entries, t.benchmark.select(F.col("item_id").alias("query"), "text"), published)


# Orders propose suppliers; those of the first fifteen nations are candidates.
@query("""WITH c AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 15),
x AS (SELECT l_orderkey AS requirement, l_linenumber AS pos, l_suppkey % 50 AS control, l_returnflag <> 'A' AND l_discount > 0.02 AS good, l_suppkey % 50 IN (SELECT s_suppkey FROM c) AS named FROM lineitem),
y AS (SELECT *, min(pos) FILTER (WHERE good AND named) OVER (PARTITION BY requirement, control) AS first FROM x)
SELECT requirement, pos, control, CASE WHEN NOT named THEN 'nameless' WHEN good AND pos = first THEN 'kept' ELSE 'refused' END AS state FROM y""")
def prp_validate(t):
    control = (F.col("l_suppkey") % 50).alias("control")
    relationship = F.when(F.col("l_returnflag") == "A", "related").when(F.col("l_returnflag") == "N", "equal").otherwise("subset")
    rows = t.lineitem.select(F.col("l_orderkey").alias("requirement"), F.col("l_linenumber").alias("pos"), control, relationship.alias("relationship"), (F.col("l_discount") > 0.02).alias("grounded"))
    named = t.supplier.where("s_nationkey < 15").select(F.col("s_suppkey").alias("control"))
    return selection.proposals(rows, rows.select("requirement", "control").join(named, "control", "left_semi"))


@query("""SELECT lower(p_type || ' ' || p_brand) AS name, arg_min('k' || p_size, p_partkey) AS key, count(DISTINCT p_size) > 1 AS collides FROM part WHERE p_size % 5 <> 0 GROUP BY 1""")
def key_declared(t):
    key = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("k"), F.col("p_size").cast("string")))
    return selection.declared_keys(t.part.select(F.concat(F.lit("  "), "p_type", F.lit(" \t"), "p_brand").alias("name"), key.alias("key"), F.col("p_partkey").alias("ord")))


# Documents were recorded as they are, or with one more character.
@query("""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'unrecorded' WHEN 1 THEN 'mismatch' ELSE 'ok' END AS state FROM documents WHERE text IS NOT NULL""")
def prv_catalog(t):
    d = t.documents.where("text is not null").select(F.col("doc_id").alias("id"), "text")
    crlf = d.select("id", F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("content"))
    return selection.catalog_states(crlf, d.where("id % 3 <> 0").select("id", F.sha2(F.concat("text", F.when(F.col("id") % 3 == 1, "!").otherwise("")), 256).alias("digest")))


_ROUTE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{h}')" for h in hints) + f" THEN '{name}'" for name, hints in selection.ROUTES.items()) + f" ELSE '{selection.NO_ROUTE}' END"


@query(f"SELECT 'turn' AS kind, conv_id AS id, turn, {_ROUTE} AS skill FROM conversations UNION ALL SELECT 'document', doc_id, 0, {_ROUTE} FROM documents")
def cnv_route(t):
    turns = t.conversations.select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", selection.route(F.col("text")).alias("skill"))
    return turns.unionByName(t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).alias("turn"), selection.route(F.col("text")).alias("skill")))


@query("""WITH p AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '[,\\n]'), lambda s: trim(trim(trim(trim(trim(s, WS), '-*•'), WS), '"'), WS)), lambda s: s <> '') AS kept FROM documents),
s AS (SELECT id, kept, list_filter(kept, lambda s: len(regexp_split_to_array(s, '\\s+')) <= 4) AS short FROM p),
l AS (SELECT *, list_transform(short, lambda s: lower(s)) AS low FROM s)
SELECT id, CASE WHEN (len(kept) - len(short)) * 2 >= len(kept) THEN '' ELSE array_to_string(list_slice(list_filter(short, lambda s, i: list_position(low, lower(s)) = i), 1, 12), '|') END AS terms FROM l""".replace("WS", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"))
def exp_parse(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.array_join(selection.expansion_terms(F.col("text")), "|").alias("terms"))


@query()
def txt_pack(t):
    x = t.documents.select(F.col("doc_id").alias("id"), F.posexplode(selection.packed(F.col("text"))).alias("piece", "text"))
    return x.select("id", "piece", F.length("text").alias("n_chars"), keys.digest(F.col("text")).alias("digest"))


# An order's document cites the last digits of its parts, its source those of its suppliers.
@query("""WITH t AS (SELECT l_orderkey AS id, list(DISTINCT CAST(l_suppkey % 10 AS VARCHAR)) AS want, list(DISTINCT CAST(l_partkey % 10 AS VARCHAR)) AS have FROM lineitem GROUP BY 1),
x AS (SELECT id, list_sort(list_filter(want, lambda w: NOT list_contains(have, w))) AS missing FROM t)
SELECT id, CAST(len(missing) AS INT) AS n, array_to_string(missing, ',') AS missing FROM x WHERE len(missing) > 0""")
def chk_citations(t):
    cited = lambda c: t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set((F.col(c) % 10).cast("string")).alias("tags"))
    return selection.lost_citations(cited("l_partkey"), cited("l_suppkey")).select("id", "n", F.array_join("missing", ",").alias("missing"))


@query("""SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'standard' ELSE 'procedure' END AS tier FROM documents WHERE doc_id % 4 < 2 AND doc_id % 3 <> 0
AND NOT coalesce(regexp_matches(text, '\\[[A-Z][A-Za-z0-9]*(?:[ -][A-Z0-9][A-Za-z0-9]*)*\\s+[^\\]\\s]*\\d[^\\]]*\\]'), false)""")
def chk_uncited(t):
    tier = F.when(F.col("doc_id") % 4 == 0, "standard").when(F.col("doc_id") % 4 == 1, "procedure").otherwise("policy")
    body = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " [NIST AC-2]").otherwise(""))
    return selection.uncited(t.documents.select(F.col("doc_id").alias("id"), tier.alias("tier"), body.alias("body")))


# Paragraphs and links of the pages stand for macros, one kind of them supported.
@query("""WITH x AS (SELECT page_id AS id, regexp_extract_all(html, '<(p|a|h1|div)[ >]', 1) AS f FROM pages)
SELECT id, array_to_string(list_sort(list_distinct(list_filter(f, lambda m: m <> 'p'))), ',') AS macros FROM x WHERE len(list_filter(f, lambda m: m <> 'p')) > 0""")
def edit_macros(t):
    marked = F.regexp_replace("html", "<(p|a|h1|div)[ >]", '<ac:structured-macro ac:name="$1"')
    return selection.unsupported_macros(t.pages.select(F.col("page_id").alias("id"), F.replace(marked, F.lit('"p"'), F.lit('"code"')).alias("html")))


@query("""WITH l AS (SELECT doc_id AS id, regexp_replace(lower(unnest(string_split(text, chr(10)))), '[*_`]+', '', 'g') AS s FROM documents),
m AS (SELECT id, regexp_matches(s, '\\b(must|shall|may|should)\\s+not\\b|\\b(is|are)\\s+(prohibited|forbidden|not\\s+(permitted|allowed))\\b|\\bcannot\\b|\\b(must|shall)\\b|\\b(is|are)\\s+(required|mandatory)\\b') AS binds, regexp_matches(s, '\\b(should|may)\\b') AS other FROM l)
SELECT id, count(*) FILTER (WHERE binds) AS binding, count(*) FILTER (WHERE binds OR other) AS modal FROM m GROUP BY 1""")
def agg_binding(t):
    lines = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line"))
    return selection.binding_shares(lines.select("id", keys.modality(F.col("line")).alias("modality")))
