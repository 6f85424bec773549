"""Catalog loads that differ in controls and enhancements, what they reach, and crosswalks from free text, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crosswalk, drift
from .bindings import query

# Nations are controls of two loads, suppliers their enhancements; the second load drops, adds and rewords some of both.
_ITEMS = """n AS (SELECT n_nationkey AS k, 'NA-' || n_nationkey AS id FROM nation),
e AS (SELECT s_nationkey AS k, s_suppkey AS s, 'NA-' || s_nationkey || '(' || s_suppkey || ')' AS id, s_name AS name FROM supplier),
o AS (SELECT k, id FROM n WHERE k % 6 <> 1), w AS (SELECT k, id FROM n WHERE k % 6 <> 2),
oe AS (SELECT * FROM e WHERE k IN (SELECT k FROM o) AND s % 7 <> 1), we AS (SELECT * FROM e WHERE k IN (SELECT k FROM w) AND s % 7 <> 2)"""
_CHANGES = f"""WITH {_ITEMS},
c AS (SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN w.id IS NULL THEN 'removed' ELSE 'changed' END AS kind, coalesce(o.k, w.k) AS k,
  (SELECT coalesce(string_agg(id, ',' ORDER BY id), '') FROM oe WHERE oe.k = o.k) <> (SELECT coalesce(string_agg(id, ',' ORDER BY id), '') FROM we WHERE we.k = w.k) AS below FROM o FULL JOIN w ON o.k = w.k),
p AS (SELECT coalesce(oe.id, we.id) AS id, coalesce(oe.k, we.k) AS k, coalesce(oe.s, we.s) AS s, CASE WHEN oe.id IS NULL THEN 'added' WHEN we.id IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM oe FULL JOIN we ON oe.id = we.id WHERE coalesce(oe.k, we.k) IN (SELECT o.k FROM o JOIN w ON o.k = w.k)),
d AS (SELECT id, NULL::VARCHAR AS parent, kind, CASE WHEN kind = 'changed' THEN concat_ws(',', CASE WHEN k % 4 = 0 THEN 'control_statement' END, CASE WHEN k % 5 = 3 THEN 'baseline' END, CASE WHEN below THEN 'enhancements' END, CASE WHEN k % 4 = 0 THEN 'parameters' END,
    CASE WHEN k % 9 = 5 THEN 'title' END, CASE WHEN k % 8 = 6 THEN 'related_controls' END) ELSE '' END AS fields FROM c
  UNION ALL SELECT id, 'NA-' || k, kind, CASE WHEN kind = 'changed' THEN concat_ws(',', CASE WHEN s % 4 = 1 THEN 'description' END, CASE WHEN s % 9 = 4 THEN 'baseline' END, CASE WHEN s % 11 = 3 THEN 'parameters' END) ELSE '' END FROM p),
g AS (SELECT * FROM d WHERE kind <> 'changed' OR fields <> '')
"""


def _load(t, second: bool):
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    when = lambda c: F.lit(second) & c
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    e = t.supplier.where(s % 7 != (2 if second else 1)).select(F.col("s_nationkey").alias("n_nationkey"), F.struct(
        text("NA-", F.col("s_nationkey"), "(", s, ")").alias("enhancement_id"), F.when(when(s % 3 == 0), F.concat(F.lit("Title  of "), "s_name")).otherwise(F.concat(F.lit("Title of "), "s_name")).alias("title"),
        F.when(when(s % 9 == 4), "Low").otherwise("High").alias("baseline"), F.concat("s_name", F.when(when(s % 4 == 1), " reworded").when(when(s % 4 == 2), "\n ").otherwise("")).alias("description"),
        F.create_map(F.when(when(s % 11 == 3), "b").otherwise("a"), F.when(F.lit(second), "new").otherwise("old")).alias("parameter_values"),
    ).alias("e")).groupBy("n_nationkey").agg(F.collect_list("e").alias("enhancements"))
    c = t.nation.where(k % 6 != (2 if second else 1)).join(e, "n_nationkey", "left")
    statement = F.concat("n_name", F.lit(" reviews [Assignment: organization-defined frequency]"), F.when(when(k % 4 == 0), " and [Selection: a; b]").when(when(k % 4 == 1), "\n").otherwise(""))
    related = F.when(when(k % 8 == 6), F.array(F.lit("B"), F.lit("C"))).when(F.lit(second), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("B"), F.lit("A")))
    return c.select(
        text("NA-", k).alias("control_id"), F.concat("n_name", F.when(when(k % 9 == 5), "!").otherwise("")).alias("title"), statement.alias("control_statement"), F.when(when(k % 5 == 3), "Low").otherwise("Low, High").alias("baseline"),
        F.lit("Same.").alias("discussion"), related.alias("related_controls"), "enhancements",
    )


@query(_CHANGES + "SELECT id, parent, kind, fields FROM g")
def drf_catalog(t):
    return drift.catalog_changes(_load(t, False), _load(t, True))


@query(_CHANGES + """SELECT DISTINCT id, what, name FROM (
  SELECT id, 'topic' AS what, a.name FROM g JOIN (SELECT DISTINCT 'na-' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '(' || c_custkey % 50 || ')' ELSE '' END AS anchor, c_mktsegment AS name FROM customer) a ON upper(anchor) = upper(id) OR upper(anchor) = upper(parent)
  UNION ALL SELECT id, 'document', a.name FROM g JOIN (SELECT DISTINCT 'NA-' || doc_id % 40 || CASE WHEN doc_id % 2 = 0 THEN '(' || doc_id % 9 || ')' ELSE '' END AS cited, source AS name FROM documents) a ON split_part(cited, '(', 1) = split_part(id, '(', 1)
  UNION ALL SELECT id, 'parameter', a.name FROM g JOIN (SELECT 'na-' || p_partkey % 30 || '/' || p_size AS key, p_brand AS name FROM part) a ON upper(split_part(key, '/', 1)) = upper(id))""")
def drf_reached(t):
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    anchor = text("na-", F.col("c_nationkey"), F.when(F.col("c_custkey") % 3 == 0, text("(", F.col("c_custkey") % 50, ")")).otherwise(""))
    cited = text("NA-", F.col("doc_id") % 40, F.when(F.col("doc_id") % 2 == 0, text("(", F.col("doc_id") % 9, ")")).otherwise(""))
    topics = t.customer.select(anchor.alias("anchor"), F.col("c_mktsegment").alias("name")).distinct()
    decisions = t.part.select(text("na-", F.col("p_partkey") % 30, "/", F.col("p_size")).alias("key"), F.col("p_brand").alias("name"))
    return drift.reached(drift.catalog_changes(_load(t, False), _load(t, True)), topics, t.documents.select(cited.alias("cited"), F.col("source").alias("name")), decisions, "anchored")


# Cells name controls in free text: two ids, doubled, in either case, beside words and numbers that are none.
@query(r"""WITH c AS (SELECT p_type AS framework, p_partkey AS requirement_id, 'see ' || lower(substr(p_name, 1, 2)) || '-' || p_size || ', AC-' || p_partkey % 30 || '(' || p_partkey % 4 || ') & ' || CASE WHEN p_size % 2 = 0 THEN 'ac-' || p_partkey % 30 ELSE 'AC-' || p_partkey % 30 || '(' || p_partkey % 4 || ')' END || ' or 12-3, ' || p_brand AS cell FROM part),
i AS (SELECT framework, requirement_id, upper(m[x]) AS anchor_id, x - 1 AS ord FROM (SELECT framework, requirement_id, m, unnest(range(1, len(m) + 1)) AS x FROM (SELECT *, regexp_extract_all(cell, '[A-Za-z]{1,4}-\d+(\([A-Za-z0-9]+\))?') AS m FROM c))),
a AS (SELECT anchor_id, framework, requirement_id, 0 AS k FROM i WHERE requirement_id % 3 = 0 UNION ALL SELECT anchor_id, framework, requirement_id, 1 FROM i WHERE requirement_id % 2 = 0 UNION ALL SELECT anchor_id, framework, requirement_id, 2 FROM i)
SELECT anchor_id, framework, requirement_id, min(k) AS "pass" FROM a GROUP BY 1, 2, 3""")
def xw_cells(t):
    text = lambda c: F.col(c).cast("string")
    n, e = (F.col("p_partkey") % 30).cast("string"), (F.col("p_partkey") % 4).cast("string")
    own = F.concat(F.lit("AC-"), n, F.lit("("), e, F.lit(")"))
    cell = F.concat(F.lit("see "), F.lower(F.substring("p_name", 1, 2)), F.lit("-"), text("p_size"), F.lit(", "), own, F.lit(" & "), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ac-"), n)).otherwise(own), F.lit(" or 12-3, "), F.col("p_brand"))
    edges = crosswalk.cell_edges(t.part.select(F.col("p_type").alias("framework"), F.col("p_partkey").alias("requirement_id"), cell.alias("cell")))
    return crosswalk.build(edges.where("requirement_id % 3 = 0"), edges.where("requirement_id % 2 = 0"), edges)
