"""Source names learned from mapping lines, bound to lines that are put together from several columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning
from .bindings import query

# Mapping lines in six shapes: section marks, numbers of standards with a year, colons, ids in brackets, one word, and doubled spaces.
_LINES = """SELECT CASE p_size % 6 WHEN 0 THEN p_type || ' § ' || p_partkey WHEN 1 THEN 'ISO/IEC ' || (27000 + p_partkey % 4) || ':20' || (10 + p_size) || ' ' || p_partkey % 50 || '.' || p_partkey % 7
  WHEN 2 THEN p_brand || ': ' || p_name WHEN 3 THEN 'NIST SP 800-' || (53 + p_size % 2) || ' r' || p_partkey % 3 || ' ' || upper(substr(p_name, 1, 2)) || '-' || p_partkey % 30 || '(' || p_partkey % 4 || ')'
  WHEN 4 THEN p_name WHEN 5 THEN p_brand || '  ' || p_type || ' ' || p_partkey % 11 END AS line FROM part UNION ALL SELECT l_shipmode FROM (SELECT DISTINCT o_orderpriority AS l_shipmode FROM orders)"""


@query(rf"""WITH l AS (SELECT DISTINCT line, string_split(line, ' ') AS t FROM ({_LINES}) WHERE line <> ''),
c AS (SELECT line, t, n, array_to_string(t[1 : n], ' ') AS name, t[n + 1] AS next, len(t) AS size FROM (SELECT line, t, unnest(range(1, least(len(t), 12) + 1)) AS n FROM l)),
b AS (SELECT name FROM c WHERE next IS NOT NULL GROUP BY name HAVING count(DISTINCT next) >= 6),
k AS (SELECT line, min(n) FILTER (WHERE (name IN (SELECT name FROM b) OR n = size - 1) AND NOT coalesce(regexp_full_match(next, '[0-9]{{3,5}}([:\-.][0-9]{{1,4}})*'), false)) AS n FROM c GROUP BY line)
SELECT DISTINCT source FROM (SELECT trim(coalesce(array_to_string(t[1 : n], ' '), t[1]), ' §¶#:,-–') AS source FROM k JOIN l USING (line)) WHERE source <> ''""")
def hit_learn(t):
    text = lambda c: F.col(c).cast("string")
    part = lambda k: (F.col("p_partkey") % k).cast("string")
    join = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    shape = F.col("p_size") % 6
    line = (
        F.when(shape == 0, join(F.col("p_type"), " § ", text("p_partkey")))
        .when(shape == 1, join("ISO/IEC ", (F.col("p_partkey") % 4 + 27000).cast("string"), ":20", (F.col("p_size") + 10).cast("string"), " ", part(50), ".", part(7)))
        .when(shape == 2, join(F.col("p_brand"), ": ", F.col("p_name")))
        .when(shape == 3, join("NIST SP 800-", (F.col("p_size") % 2 + 53).cast("string"), " r", part(3), " ", F.upper(F.substring("p_name", 1, 2)), "-", part(30), "(", part(4), ")"))
        .when(shape == 4, F.col("p_name")).otherwise(join(F.col("p_brand"), "  ", F.col("p_type"), " ", part(11)))
    )
    return learning.learned_sources(t.part.select(line.alias("line")).unionByName(t.orders.select(F.col("o_orderpriority").alias("line")).distinct()))
