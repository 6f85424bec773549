"""Each operator as a query over the driver's tables, with the SQL of the same question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import coverage, crosswalk, documents, drift, ledger, lint, retrieval, sync
from . import stemming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Requirements are parts below their brands; a nation owns the parts that it had returned in bulk, and a
# brand once it owns four of its parts.
def _requirements(t):
    parts = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("parent"))
    return parts


def _anchors(t):
    own = t.lineitem.where("l_returnflag = 'R' and l_quantity > 48").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    own = own.select(F.col("s_nationkey").cast("string").alias("owner"), F.col("p_partkey").cast("string").alias("part"), F.col("p_brand").alias("brand")).distinct()
    brands = own.groupBy("owner", "brand").agg(F.count("*").alias("n")).where("n >= 4")
    return own.select("owner", F.col("part").alias("anchor")).unionByName(brands.select("owner", F.col("brand").alias("anchor")))


_COVER = """WITH own AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS owner, CAST(p_partkey AS VARCHAR) AS part, p_brand AS brand
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 48),
brands AS (SELECT owner, brand FROM own GROUP BY owner, brand HAVING count(*) >= 4),
anchors AS (SELECT owner, part AS anchor FROM own UNION ALL SELECT owner, brand FROM brands),
req AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS parent FROM part),
direct AS (SELECT id, owner FROM req JOIN anchors ON id = anchor),
claims AS (SELECT id, owner, true AS direct FROM direct UNION ALL
  SELECT DISTINCT id, owner, false FROM req JOIN anchors ON parent = anchor WHERE id NOT IN (SELECT id FROM direct))
"""


@query(_COVER + """SELECT req.id, count(owner) AS owners, coalesce(bool_or(direct), false) AS direct,
CASE count(owner) WHEN 0 THEN 'orphaned' WHEN 1 THEN 'covered' ELSE 'contested' END AS status FROM req LEFT JOIN claims ON req.id = claims.id GROUP BY req.id""")
def cov_analyze(t):
    return coverage.coverage(_requirements(t), _anchors(t))


@query(_COVER + "SELECT CAST(n_nationkey AS VARCHAR) AS owner, count(id) AS n FROM nation LEFT JOIN claims ON CAST(n_nationkey AS VARCHAR) = owner GROUP BY 1")
def agg_owner(t):
    return coverage.owner_totals(t.nation.select(F.col("n_nationkey").cast("string").alias("owner")), coverage.claims_of(_requirements(t), _anchors(t)))


@query(_COVER + """SELECT owner, anchor, CASE WHEN anchor NOT IN (SELECT id FROM req) THEN 'unknown' ELSE 'out-of-scope' END AS problem FROM anchors
WHERE anchor NOT IN (SELECT id FROM req) OR anchor NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 40)""")
def cov_unknown_anchors(t):
    scope = t.part.where("p_size <= 40").select(F.col("p_partkey").cast("string").alias("id"))
    return coverage.unknown_anchors(_anchors(t), _requirements(t), scope)


# Edges run from suppliers (anchors) to parts (requirements) of frameworks, the parts' types.
def _edges(t):
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    relationship = F.when(F.col("l_returnflag") == "A", "superset").when(F.col("l_returnflag") == "N", "equal").otherwise("intersects")
    return x.select(F.col("l_suppkey").alias("anchor_id"), F.col("p_type").alias("framework"), F.col("l_partkey").alias("requirement_id"), relationship.alias("relationship"), F.col("l_returnflag").alias("flag"), F.struct("l_orderkey", "l_linenumber").alias("seq"), F.col("l_tax").alias("tax"))


def _overlay(t):
    status = F.when(F.col("flag") == "A", "accepted").when(F.col("flag") == "N", "rejected").otherwise("proposed")
    return _edges(t).where("tax > 0.07").select("anchor_id", "framework", "requirement_id", status.alias("status"), "relationship", "seq")


_EDGES = """WITH edges AS (SELECT l_suppkey AS anchor_id, p_type AS framework, l_partkey AS requirement_id,
  CASE l_returnflag WHEN 'A' THEN 'superset' WHEN 'N' THEN 'equal' ELSE 'intersects' END AS relationship, l_returnflag AS flag, l_orderkey, l_linenumber, l_tax AS tax
  FROM lineitem JOIN part ON l_partkey = p_partkey),
overlay AS (SELECT *, CASE flag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'rejected' ELSE 'proposed' END AS status FROM edges WHERE tax > 0.07)
"""


@query(_EDGES + """SELECT anchor_id, framework, requirement_id, min(CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS "pass" FROM edges GROUP BY 1, 2, 3""")
def xw_build(t):
    e = _edges(t)
    return crosswalk.build(e.where("flag = 'A'"), e.where("flag = 'N'"), e.where("flag = 'R'"))


@query(_EDGES + """SELECT anchor_id, framework, requirement_id FROM (SELECT DISTINCT anchor_id, framework, requirement_id FROM edges) e
WHERE NOT EXISTS (SELECT 1 FROM overlay o WHERE o.framework = e.framework AND o.requirement_id = e.requirement_id)
UNION ALL SELECT DISTINCT anchor_id, framework, requirement_id FROM overlay WHERE status = 'accepted'""")
def xw_overlay_apply(t):
    return crosswalk.apply_overlay(_edges(t).select("anchor_id", "framework", "requirement_id").distinct(), _overlay(t))


@query(_EDGES + """SELECT anchor_id, framework, requirement_id, relationship, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY framework, requirement_id, anchor_id ORDER BY l_orderkey DESC, l_linenumber DESC) AS n
FROM overlay WHERE status = 'accepted') WHERE n = 1""")
def xw_accepted(t):
    return crosswalk.accepted(_overlay(t)).select("anchor_id", "framework", "requirement_id", "relationship", "seq.*")


@query(_EDGES + """SELECT problem, count(*) AS n FROM (
SELECT 'unknown requirement' AS problem FROM overlay o WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.flag <> 'R' AND e.framework = o.framework AND e.requirement_id = o.requirement_id)
UNION ALL SELECT 'unknown anchor' FROM overlay o WHERE anchor_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)
UNION ALL SELECT 'proposed' FROM overlay WHERE status = 'proposed') GROUP BY problem""")
def xw_overlay_check(t):
    return crosswalk.check_overlay(_overlay(t), _edges(t).where("flag <> 'R'"), t.supplier.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("anchor_id")))


@query(_EDGES + "SELECT framework, requirement_id, count(DISTINCT anchor_id) AS anchors FROM edges GROUP BY 1, 2")
def xw_requirement(t):
    return _edges(t).groupBy("framework", "requirement_id").agg(F.countDistinct("anchor_id").alias("anchors"))


@query(_EDGES + """SELECT framework, requirement_id, CASE WHEN bool_or(relationship = 'equal') THEN 'full' ELSE 'partial' END AS reach FROM edges
WHERE anchor_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) GROUP BY 1, 2""")
def cov_framework(t):
    return coverage.framework_reach(_edges(t), t.supplier.where("s_nationkey < 5").select(F.col("s_suppkey").alias("id")))


@query(_EDGES + """SELECT framework, count(DISTINCT requirement_id) AS n FROM edges WHERE anchor_id IN
(SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(n_name) = 'nation_3') GROUP BY 1""")
def bun_team(t):
    topics = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("owner"), F.col("s_suppkey").alias("anchor"))
    return coverage.team_bundle(topics, _edges(t), "NATION_3")


@query(_EDGES + "SELECT requirement_id, CAST(s_nationkey AS INT) AS owner, min(anchor_id) AS via FROM edges JOIN supplier ON anchor_id = s_suppkey GROUP BY 1, 2")
def bun_view(t):
    return coverage.reverse_lookup(_edges(t), t.supplier.select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("anchor")))


@query("""SELECT p_type AS framework, CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_type IN (SELECT p_type FROM part WHERE p_size = 50 AND p_type IN ('ECONOMY', 'LARGE', 'MEDIUM')) THEN 'in-scope'
WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) THEN 'reachable' ELSE 'unadopted' END AS scope FROM part""")
def fil_split_adoption(t):
    req = t.part.select(F.col("p_type").alias("framework"), F.col("p_partkey").cast("string").alias("id"))
    return coverage.split_adoption(req, t.part.where("p_size = 50 and p_type in ('ECONOMY', 'LARGE', 'MEDIUM')").select(F.col("p_type").alias("framework")), t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").cast("string").alias("id")))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN 'published' WHEN s_acctbal > 5000 THEN 'reviewed' WHEN s_nationkey % 4 = 1 THEN 'published' ELSE 'unreviewed' END AS provenance FROM supplier""")
def ev_prov(t):
    sources = F.when(F.col("s_nationkey") % 4 == 0, F.lit(None)).when(F.col("s_nationkey") % 4 == 1, F.array(F.lit("published"))).otherwise(F.array(F.lit("model")))
    return t.supplier.select("s_suppkey", crosswalk.provenance(sources, F.col("s_acctbal") > 5000).alias("provenance"))


@query("""WITH r AS (SELECT c_custkey AS key, CASE WHEN c_nationkey % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS status, c_acctbal > 6000 AS reviewed, c_mktsegment AS relationship FROM customer WHERE c_custkey % 3 <> 0),
a AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS said FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(r.key, a.key) AS key, coalesce(status, 'proposed') AS status, coalesce(relationship, said) AS relationship,
CASE WHEN status IS NULL OR reviewed OR status = 'rejected' THEN '' WHEN said IS NULL THEN 'not-confirmed' WHEN said <> relationship THEN 'relationship-proposed' ELSE '' END AS flag FROM r FULL JOIN a ON r.key = a.key""")
def prp_merge(t):
    c = t.customer
    rows = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_nationkey") % 3 == 0, "rejected").otherwise("accepted").alias("status"), (F.col("c_acctbal") > 6000).alias("reviewed"), F.col("c_mktsegment").alias("relationship"))
    said = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("relationship"))
    return crosswalk.merge_proposals(rows, said)


@query("""WITH f AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS fde FROM customer WHERE c_custkey % 7 <> 0), r AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS rde FROM customer WHERE c_custkey % 5 <> 0),
o AS (SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(c_nationkey AS VARCHAR) AS olir FROM customer)
SELECT o.key, fde, rde, olir, fde IS NULL OR rde IS NULL AS gap FROM o LEFT JOIN f ON o.key = f.key LEFT JOIN r ON o.key = r.key""")
def src_cprt(t):
    def table(prefix, value, keep):
        return t.customer.where(keep).select(F.concat(F.lit(prefix), F.col("c_custkey").cast("string")).alias("key"), F.col(value).cast("string").alias("value"))
    return crosswalk.joined_columns(table("FDE-", "c_name", "c_custkey % 7 <> 0"), table("RDE-", "c_mktsegment", "c_custkey % 5 <> 0"), table("OE-", "c_nationkey", "true"))


# Two versions of the orders: some dropped, some new, some with other text or only other spacing.
def _versions(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    new = o.where("id % 10 <> 0").withColumn("priority", F.when(F.col("id") % 7 == 0, F.concat(F.col("priority"), F.lit(" X"))).when(F.col("id") % 7 == 1, F.concat(F.lit("  "), F.col("priority"))).otherwise(F.col("priority")))
    return o.where("id % 10 <> 1"), new.withColumn("status", F.when(F.col("id") % 11 == 0, "Z").otherwise(F.col("status")))


_DIFF = """WITH o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 1), n AS (SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0),
d AS (SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS kind,
CASE WHEN o.id IS NULL OR n.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN n.id % 11 = 0 AND o_orderstatus <> 'Z' THEN 'status' END, CASE WHEN n.id % 7 = 0 THEN 'priority' END) END AS fields FROM n FULL JOIN o ON n.id = o.id)
"""


@query(_DIFF + "SELECT * FROM d WHERE kind <> 'changed' OR fields <> ''")
def drf_diff(t):
    return drift.diff(*_versions(t), ["status", "priority"])


@query(_DIFF + """, c AS (SELECT id FROM d WHERE kind <> 'changed' OR fields <> '')
SELECT DISTINCT id, what, name FROM (SELECT o_orderkey AS id, 'topic' AS what, CAST(o_custkey AS VARCHAR) AS name FROM orders UNION ALL SELECT l_orderkey, 'document', CAST(l_suppkey AS VARCHAR) FROM lineitem
UNION ALL SELECT l_orderkey, 'parameter', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 1) WHERE id IN (SELECT id FROM c)""")
def drf_impact(t):
    li = t.lineitem
    return drift.impact(
        drift.diff(*_versions(t), ["status", "priority"]), t.orders.select(F.col("o_orderkey").alias("anchor"), F.col("o_custkey").cast("string").alias("name")),
        li.select(F.col("l_orderkey").alias("cited"), F.col("l_suppkey").cast("string").alias("name")), li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("control_id"), F.col("l_partkey").cast("string").alias("name")),
    )


def _calls(t):
    e = t.events
    return e.select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("tokens"), F.when(F.col("event_type") != "view", F.col("value")).alias("cost"), F.when(F.col("event_id") % 13 == 0, "e").alias("error"))


@query("""SELECT CASE WHEN event_id % 9 <> 0 THEN event_type ELSE '(unattributed)' END AS key, count(*) AS calls, CAST(sum(CASE WHEN event_id % 5 <> 0 THEN user_id ELSE 0 END) AS BIGINT) AS tokens,
round(sum(CASE WHEN event_type <> 'view' THEN value ELSE 0 END), 4) AS cost, bool_or(event_type <> 'view' AND value IS NOT NULL) AS priced, count(*) FILTER (WHERE event_id % 13 = 0) AS errors FROM events GROUP BY 1""")
def agg_ledger(t):
    return ledger.summarize(_calls(t), "kind")


@query("""WITH m AS (SELECT user_id AS scope, event_type AS model, min(event_id) AS first, sum(CASE WHEN event_type <> 'view' THEN value END) AS cost FROM events GROUP BY 1, 2)
SELECT scope, string_agg(model, ',' ORDER BY first) AS models, round(sum(cost), 4) AS cost FROM m GROUP BY 1""")
def agg_scope(t):
    return ledger.scopes(t.events.select(F.col("user_id").alias("scope"), F.col("event_type").alias("model"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("value")).alias("cost")))


@query("""WITH o AS (SELECT doc_id % 50 AS suite, quality = 1 AS passed, toxic = 1 AS errored FROM labels),
x AS (SELECT suite, count(*) AS runs, count(*) FILTER (WHERE NOT errored) AS graded, count(*) FILTER (WHERE passed AND NOT errored) AS passes FROM o GROUP BY 1)
SELECT *, round(passes / nullif(graded, 0), 6) AS rate, passes > 0 AND passes < graded AS flaky FROM x""")
def agg_eval(t):
    return ledger.evaluations(t.labels.select((F.col("doc_id") % 50).alias("suite"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("errored")))


@query("""SELECT slug, ord, CAST(row_number() OVER (PARTITION BY slug ORDER BY ord) AS INT) AS version, substr(sha256(content), 1, 12) AS content_hash FROM
(SELECT user_id AS slug, event_id AS ord, event_type AS content, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events) WHERE last IS NULL OR content <> last""")
def win_version(t):
    return ledger.versions(t.events.select(F.col("user_id").alias("slug"), F.col("event_id").alias("ord"), F.col("event_type").alias("content")))


@query("""SELECT source, lang, doc_id AS seq, n_chars AS length FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1 AND source <> '' AND lang <> ''""")
def win_dedupe_longest(t):
    return ledger.longest(t.documents.select("source", "lang", F.col("doc_id").alias("seq"), F.col("n_chars").alias("length")), ["source", "lang"])


@query("""WITH n AS (SELECT DISTINCT substr(p_name, 1, 6 + CAST(p_partkey % 5 AS INT)) AS name FROM part)
SELECT a.name, max_by(b.name, (length(b.name), b.name)) AS longest FROM n a JOIN n b ON starts_with(b.name, a.name) GROUP BY 1""")
def win_longest_name(t):
    return ledger.longest_names(t.part.select(F.expr("substring(p_name, 1, cast(6 + p_partkey % 5 as int))").alias("name")).distinct())


@query("""SELECT seq, CASE WHEN n > 1 THEN id || '-' || n ELSE id END AS id FROM (SELECT p_partkey AS seq, p_name AS id, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def dedup_ids(t):
    return ledger.unique_ids(t.part.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("id")))


@query("""WITH r AS (SELECT p_partkey AS id, p_size % 2 = 0 AS low, p_size % 3 = 0 AS moderate, p_size % 5 <> 0 AS high FROM part)
SELECT id, concat_ws(', ', CASE WHEN low THEN 'low' END, CASE WHEN moderate THEN 'moderate' END, CASE WHEN high THEN 'high' END) AS marked,
concat_ws(', ', CASE WHEN low AND NOT moderate THEN 'moderate' END, CASE WHEN (low OR moderate) AND NOT high THEN 'high' END) AS missing
FROM r WHERE (low AND NOT moderate) OR ((low OR moderate) AND NOT high)""")
def gov_nesting(t):
    return lint.tier_gaps(t.part.selectExpr("p_partkey AS id", "p_size % 2 = 0 AS low", "p_size % 3 = 0 AS moderate", "p_size % 5 <> 0 AS high"), ["low", "moderate", "high"])


@query("""SELECT conv_id, turn, substr(sha256(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 1, 12) AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL""")
def qst_digest(t):
    stripped = F.regexp_replace("text", r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")
    return t.conversations.where("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", keys.digest(stripped).alias("question"))


_PARAMS = """WITH p AS (SELECT p_partkey AS key, p_brand AS label FROM part), d AS (SELECT l_partkey AS key, max(CASE WHEN l_quantity > 20 THEN l_returnflag ELSE '' END) AS value, min(CASE WHEN l_tax > 0.02 THEN 'x' ELSE '' END) AS rationale
FROM lineitem WHERE l_discount > 0.08 GROUP BY 1 UNION ALL SELECT -1, 'v', 'r')
"""


def _decisions(t):
    d = t.lineitem.where("l_discount > 0.08").groupBy(F.col("l_partkey").alias("key")).agg(F.max(F.when(F.col("l_quantity") > 20, F.col("l_returnflag")).otherwise("")).alias("value"), F.min(F.when(F.col("l_tax") > 0.02, "x").otherwise("")).alias("rationale"))
    return d.union(t.spark.createDataFrame([(-1, "v", "r")], "key long, value string, rationale string"))


@query(_PARAMS + "SELECT label, count(*) AS total, count(*) FILTER (WHERE value <> '') AS decided FROM p LEFT JOIN d ON p.key = d.key GROUP BY 1")
def agg_label(t):
    return ledger.parameters_by_label(t.part.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("label")), _decisions(t))


@query(_PARAMS + "SELECT CASE WHEN p.key IS NULL THEN 'stale' WHEN coalesce(value, '') = '' THEN 'undecided' WHEN coalesce(rationale, '') = '' THEN 'unreasoned' ELSE 'decided' END AS state, count(*) AS n FROM p FULL JOIN d ON p.key = d.key GROUP BY 1")
def agg_param_report(t):
    return ledger.parameter_report(t.part.select(F.col("p_partkey").alias("key")), _decisions(t))


@query("""SELECT l_orderkey AS claim, CASE WHEN bool_or(l_returnflag = 'A') THEN 'supported' WHEN bool_or(l_returnflag = 'R') THEN 'contradicted' ELSE 'unsupported' END AS verdict,
least(count(*) FILTER (WHERE l_returnflag = 'A'), 1) * count(*) FILTER (WHERE l_returnflag = 'R') AS conflicts FROM lineitem GROUP BY 1""")
def ent_verdicts(t):
    v = F.when(F.col("l_returnflag") == "A", "supports").when(F.col("l_returnflag") == "R", "contradicts").otherwise("silent")
    return ledger.verdicts(t.lineitem.select(F.col("l_orderkey").alias("claim"), v.alias("verdict")))


@query("""SELECT id, kept FROM (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_type, lower(p_brand), lower(p_name)) AS kept FROM part) WHERE id <> kept""")
def chk_claims(t):
    return lint.double_claims(t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("place"), F.col("p_name").alias("title")))


@query("SELECT l_orderkey, l_linenumber, l_suppkey AS target FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def chk_refs(t):
    return lint.dangling(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("target")), t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("target")))


@query("""SELECT c_custkey AS id, unnest(list_filter([CASE WHEN c_nationkey % 6 = 0 THEN 'space' END, CASE WHEN c_acctbal < 0 THEN 'tier' END, CASE WHEN c_custkey % 8 = 0 THEN 'owner' END], lambda x: x IS NOT NULL)) AS field FROM customer""")
def chk_publishable(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 6 != 0, "s").alias("space"), F.when(F.col("c_acctbal") >= 0, "t").otherwise("").alias("tier"), F.when(F.col("c_custkey") % 8 != 0, "o").alias("owner"))
    return lint.missing_fields(c, ["space", "tier", "owner"])


@query("""SELECT doc, section, line FROM (SELECT l_suppkey AS doc, l_partkey % 7 AS section, l_orderkey * 10 + l_linenumber AS line, l_returnflag <> 'N' AS binding, l_discount > 0.09 AS cited,
bool_or(l_discount > 0.09) OVER (PARTITION BY l_suppkey, l_partkey % 7) AS cites FROM lineitem) WHERE binding AND NOT cited AND cites""")
def gnd_unanchored(t):
    x = t.lineitem.select(F.col("l_suppkey").alias("doc"), (F.col("l_partkey") % 7).alias("section"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), (F.col("l_returnflag") != "N").alias("binding"), (F.col("l_discount") > 0.09).alias("cited"))
    return lint.unanchored(x)


_RULES = [("mail", "[a-z0-9._]+@[a-z0-9]"), ("license", "licen[sc]e"), ("digits", "[0-9]{3}\\.[0-9]+"), ("table", "\\| [^|]+ \\|")]


@query("""WITH l AS (SELECT doc_id AS id, lower(unnest(string_split(text, chr(10)))) AS line FROM documents),
r AS (SELECT * FROM (VALUES ('mail', '[a-z0-9._]+@[a-z0-9]'), ('license', 'licen[sc]e'), ('digits', '[0-9]{3}\\.[0-9]+'), ('table', '\\| [^|]+ \\|')) v(rule, pattern))
SELECT id, rule, count(*) AS lines FROM l, r WHERE regexp_matches(line, pattern) GROUP BY 1, 2""".replace("\\\\", "\\"))
def rule_lines(t):
    return lint.rule_hits(t.documents.select(F.col("doc_id").alias("id"), "text"), _RULES)


_TOK = """list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace({0}, '\\b([A-Za-z]{{2}}-[0-9]+(?:\\([0-9]+\\))?)', ' ', 'g'),
  '\\b([0-9]{{3}}\\.[0-9]+(?:\\([A-Za-z0-9]+\\))*)', ' ', 'g'), '(?i)\\b([0-9]{{1,2}}\\.(?:[a-z]{{1,2}}|[0-9]{{2}}))\\b', ' ', 'g')), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in keys.STOPWORDS) + "))"
_BM25 = f"""WITH c AS (SELECT doc_id AS id, {_TOK.format('text')} AS t FROM documents),
i AS (SELECT item_id AS query, {_TOK.format('text')} AS t FROM benchmark),
vocab AS (SELECT unnest(t) AS word FROM c UNION SELECT unnest(t) FROM i),
{stemming.TERMS},
x AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS word FROM c) JOIN terms USING (word) GROUP BY ALL),
l AS (SELECT c.id, coalesce(sum(tf), 0) AS len FROM c LEFT JOIN x ON c.id = x.id GROUP BY c.id), w AS (SELECT count(*) AS n, avg(len) AS avg FROM l),
q AS (SELECT DISTINCT query, term FROM (SELECT query, unnest(t) AS word FROM i) JOIN terms USING (word)),
p AS (SELECT id, len, term, tf FROM x JOIN l USING (id) WHERE term IN (SELECT term FROM q)),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg))), 4) AS score FROM p JOIN f USING (term) JOIN q USING (term), w GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INT) AS rank FROM s)
"""


def _bm25(t, k):
    return retrieval.bm25(t.documents.select(F.col("doc_id").alias("id"), "text"), t.benchmark.select(F.col("item_id").alias("query"), "text"), k)


@query(_BM25 + "SELECT query, id, score, rank FROM r WHERE rank <= 10")
def ret_bm25(t):
    return _bm25(t, 10)


@query(f"""WITH d AS (SELECT doc_id, unnest({_TOK.format('text')}) AS word FROM documents), vocab AS (SELECT DISTINCT word FROM d), {stemming.TERMS}
SELECT term, count(DISTINCT doc_id) AS df FROM d JOIN terms USING (word) GROUP BY 1""")
def agg_df(t):
    return retrieval.document_frequency(retrieval.postings(t.documents.select(F.col("doc_id").alias("id"), "text")))


_DENSE = """WITH d AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
dr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INT) AS rank FROM d WHERE score >= 0.2)
"""


@query(_DENSE + "SELECT query, id, score, rank FROM dr WHERE rank <= 20")
def ret_dense(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense(e, e.where("id % 50 = 0"), 0.2, 20)


def _rankings(t):
    x = t.lineitem.select((F.col("l_suppkey") % 40).alias("query"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("score"), F.col("l_extendedprice").alias("price"))
    one = x.groupBy("query", "id").agg(F.max("score").alias("score"), F.max("price").alias("price"))
    return retrieval.best(one.select("query", "id", "score"), "query", 20), retrieval.best(one.select("query", "id", F.col("price").alias("score")), "query", 20)


_RANKS = """WITH o AS (SELECT l_suppkey % 40 AS query, l_partkey AS id, max(l_quantity) AS score, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
a AS (SELECT query, id, rank AS ra FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM o) WHERE rank <= 20),
b AS (SELECT query, id, rank AS rb FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY price DESC, id) AS rank FROM o) WHERE rank <= 20),
x AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.id, b.id) AS id, ra, rb FROM a FULL JOIN b ON a.query = b.query AND a.id = b.id)
"""


@query(_RANKS + """, s AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0), 9) AS score FROM x),
r AS (SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, ra IS NULL, coalesce(ra, rb), id) AS INT) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def ret_rrf(t):
    return retrieval.fuse(*_rankings(t), 10)


@query(_RANKS + "SELECT query, count(*) FILTER (WHERE rb IS NULL) AS only_live, count(*) FILTER (WHERE ra IS NULL) AS only_shadow, count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) AS agreed, bool_and(ra IS NOT NULL AND rb IS NOT NULL) AS same_set FROM x GROUP BY 1")
def ret_shadow(t):
    return retrieval.compare(*_rankings(t))


@query(_RANKS + """, s AS (SELECT a.query, a.id, ra, CASE WHEN a.query % 2 = 0 OR a.id % 3 <> 0 THEN a.id % 17 END AS score FROM a),
w AS (SELECT *, bool_and(score IS NOT NULL) OVER (PARTITION BY query) AS whole FROM s)
SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN whole THEN -score ELSE ra END, ra, id) AS INT) AS new_rank FROM w""")
def ret_rerank(t):
    live = _rankings(t)[0].select("query", "id", "rank")
    return retrieval.rerank(live, live.where("query % 2 = 0 or id % 3 <> 0").select("query", "id", (F.col("id") % 17).cast("double").alias("score")))


@query("SELECT item_id AS quote, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gnd_quote(t):
    return retrieval.quoted(t.benchmark.select(F.col("item_id").alias("quote"), "text"), t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("""SELECT lower(s_name) AS title, s_suppkey AS id, 'tree' AS origin FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT lower(s_name), s_suppkey, 'pages' FROM supplier WHERE s_suppkey % 2 = 0 AND lower(s_name) NOT IN (SELECT lower(s_name) FROM supplier WHERE s_suppkey % 3 <> 0)""")
def sync_merge(t):
    s = t.supplier.select(F.col("s_name").alias("title"), F.col("s_suppkey").alias("id"))
    return sync.merge_trees(s.where("id % 3 <> 0"), s.where("id % 2 = 0"))


def _pages(t):
    c = t.customer
    docs = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"), (F.col("c_custkey") % 4).alias("recorded"), F.when(F.col("c_custkey") % 9 != 0, "x").alias("target"), (F.col("c_nationkey") == 3).alias("licensed"), (F.col("c_custkey") % 17 == 0).alias("forced"))
    live = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("other").alias("body"), (F.col("c_nationkey") % 4).cast("long").alias("version"), (F.col("c_custkey") % 7 == 0).alias("stamped"), (F.col("c_nationkey") % 10 == 0).cast("int").alias("macros"))
    return docs, live


_MOVED = "c_custkey % 7 <> 0 AND c_nationkey % 4 <> c_custkey % 4 AND c_custkey % 3 <> 0"


@query(f"SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'ABSENT' WHEN {_MOVED} THEN 'MOVED' ELSE 'IN_SYNC' END AS state FROM customer")
def sync_state(t):
    return sync.page_state(*_pages(t))


@query(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'UNDECLARED' WHEN c_nationkey = 3 THEN 'SKIPPED' WHEN c_custkey % 5 <> 0 AND c_nationkey % 10 = 0 THEN 'SKIPPED' WHEN c_custkey % 5 = 0 THEN 'CREATED'
WHEN {_MOVED} AND c_custkey % 17 <> 0 THEN 'MOVED' ELSE 'UPDATED' END AS action FROM customer""")
def pub_plan(t):
    return sync.publish_plan(*_pages(t))


@query("""WITH o AS (SELECT p_name || p_partkey AS name, sha256(p_brand || p_partkey) AS old FROM part WHERE p_partkey % 6 <> 0), n AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'new' ELSE '' END || p_name || p_partkey AS name,
sha256(p_brand || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '!' ELSE '' END) AS new FROM part WHERE p_partkey % 7 <> 0), x AS (SELECT coalesce(o.name, n.name) AS name, old, new FROM o FULL JOIN n ON o.name = n.name),
b AS (SELECT old AS h FROM x WHERE new IS NULL INTERSECT SELECT new FROM x WHERE old IS NULL)
SELECT name, CASE WHEN (old IS NULL OR new IS NULL) AND coalesce(old, new) IN (SELECT h FROM b) THEN 'renamed' WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'same' ELSE 'changed' END AS what FROM x""")
def prompt_fp(t):
    p = t.part
    key = F.concat(F.col("p_name"), F.col("p_partkey").cast("string"))
    own = F.concat(F.col("p_brand"), F.col("p_partkey").cast("string"))
    old = p.where("p_partkey % 6 <> 0").select(key.alias("name"), F.sha2(own, 256).alias("hash"))
    new = p.where("p_partkey % 7 <> 0").select(F.concat(F.when(F.col("p_partkey") % 10 == 0, "new").otherwise(""), key).alias("name"), F.sha2(F.concat(own, F.when(F.col("p_partkey") % 4 == 0, "!").otherwise("")), 256).alias("hash"))
    return sync.fingerprints(old, new)


@query(f"""SELECT conv_id, turn, len(list_intersect(regexp_extract_all(lower(text), '[a-z'']+'), ['it','its','that','this','these','those','they','them','their','there','same','one','ones','above','below','former','latter'])) > 0 OR len({_TOK.format('text')}) <= 1 AS followup FROM conversations WHERE role = 'user'""")
def cnv_followup(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", keys.is_followup(F.col("text")).alias("followup"))


@query("""SELECT doc_id, unnest(list_distinct(list_concat(list_transform(regexp_extract_all(text, '\\b([A-Za-z]{2}-[0-9]+(?:\\([0-9]+\\))?)', 1), lambda x: upper(x)),
regexp_extract_all(text, '\\b([0-9]{3}\\.[0-9]+(?:\\([A-Za-z0-9]+\\))*)', 1), list_transform(regexp_extract_all(text, '(?i)\\b([0-9]{1,2}\\.(?:[a-z]{1,2}|[0-9]{2}))\\b', 1), lambda x: lower(x))))) AS id FROM documents""".replace("\\\\", "\\"))
def txt_ids(t):
    return t.documents.select("doc_id", F.explode(keys.identifiers(F.col("text"))).alias("id"))


@query("""SELECT page_id AS id, CAST(len(f) AS BIGINT) AS n, trim(regexp_replace(regexp_replace(f[1], '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS first FROM
(SELECT page_id, regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1) AS f FROM pages) WHERE len(f) > 0""".replace("\\\\", "\\"))
def htm_items(t):
    return documents.html_items(t.pages.select(F.col("page_id").alias("id"), "html"), "p")


_URLS = (
    "https://localhost:8080/x http://api.localhost/ http://127.0.0.1/ http://10.0.0.1/ https://x.internal/a https://box.local https://example.com/ no-url http://172.20.1.1:9 http://172.40.1.1 https://127.example.com "
    "https://10.example.com/ http://[::1]:80/ http://u@[fd00::1]/ http://[fe80::1] http://[2606:4700::1]/ http://256.1.1.1 http://10.0.0.1.nip.io http://user:pw@192.168.1.1/ http://240.0.0.1"
).split()
_SCHEME, _OCTET = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?", r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(rf"""WITH u AS (SELECT url FROM pages UNION ALL SELECT unnest({_URLS!r}) AS url),
h AS (SELECT url, lower(coalesce(nullif(regexp_extract(url, '{_SCHEME}\[([0-9A-Fa-f:.]+)\]', 1), ''), nullif(regexp_extract(url, '{_SCHEME}([^\[\]:/?#]+)', 1), ''))) AS h FROM u),
q AS (SELECT *, regexp_matches(h, '^{_OCTET}(\.{_OCTET}){{3}}$') AS quad, contains(h, ':') AS six FROM h)
SELECT url, CASE WHEN h IS NULL THEN 'third-party' WHEN h = 'localhost' OR h LIKE '%.localhost' OR (quad AND starts_with(h, '127.')) OR (six AND h = '::1') THEN 'local'
WHEN h LIKE '%.local' OR h LIKE '%.internal' OR (quad AND regexp_matches(h, '{keys.PRIVATE}')) OR (six AND regexp_matches(h, '{keys.PRIVATE6}')) THEN 'self-hosted' ELSE 'third-party' END AS exposure FROM q""")
def cls_provider(t):
    fixture = t.spark.range(1).select(F.explode(F.array(*map(F.lit, _URLS))).alias("url"))
    return t.pages.select("url").unionByName(fixture).select("url", keys.exposure(F.col("url")).alias("exposure"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS calls, round(sum(value), 2) AS value FROM events GROUP BY 1, 2""")
def stream_ledger(t):
    from ..streaming.ledger import windowed_calls

    return windowed_calls(t.events)


from . import catalogs, checks, citations, deontics, drifts, searches, selections  # noqa: E402, F401  (they add their queries to the same registry)
