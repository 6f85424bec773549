"""Which requirements are owned, and what ownership reaches in other catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claims_of(requirements: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, owner, direct): an anchor claims its id directly and the children of its id by inheritance.

    requirements: id, parent (nullable); anchors: owner, anchor.  A direct claim beats an inherited one.

    Ids without a direct claim are put to the set of their parents, and the owners of each set are found once. Claims are thus distinct as they
    are made and aren't grouped afterwards, when there may be many more of them than ids."""
    anchors = anchors.select("owner", "anchor").distinct()
    direct = requirements.select("id").distinct().join(anchors, F.col("id") == F.col("anchor")).select("id", "owner", F.lit(True).alias("direct"))
    rest = requirements.where("parent is not null").join(anchors.select(F.col("anchor").alias("id")), "id", "left_anti")
    rest = rest.groupBy("id").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    owners = rest.select("parents").distinct().select("parents", F.explode("parents").alias("anchor")).join(anchors, "anchor").select("parents", "owner").distinct()
    return direct.unionByName(rest.join(owners, "parents").select("id", "owner", F.lit(False).alias("direct")))


def coverage(requirements: DataFrame, anchors: DataFrame) -> DataFrame:
    """id, owners and status: orphaned without owner, covered by one, contested by more."""
    owners = claims_of(requirements, anchors).groupBy("id").agg(F.count("*").alias("owners"), F.max("direct").alias("direct"))
    n = F.coalesce("owners", F.lit(0))
    status = F.when(n == 0, "orphaned").when(n == 1, "covered").otherwise("contested")
    return requirements.select("id").distinct().join(owners, "id", "left").select("id", n.alias("owners"), F.coalesce("direct", F.lit(False)).alias("direct"), status.alias("status"))


def owner_totals(owners: DataFrame, claims: DataFrame) -> DataFrame:
    """owner and number of claims, owners without any included."""
    return owners.select("owner").distinct().join(claims, "owner", "left").groupBy("owner").agg(F.count("id").alias("n"))


def unknown_anchors(anchors: DataFrame, requirements: DataFrame, in_scope: DataFrame) -> DataFrame:
    """Anchors that name nothing (unknown) or something outside the scope (out-of-scope)."""
    unknown = anchors.join(requirements, anchors.anchor == requirements.id, "left_anti").select("owner", "anchor", F.lit("unknown").alias("problem"))
    known = anchors.join(requirements, anchors.anchor == requirements.id, "left_semi")
    outside = known.join(in_scope, known.anchor == in_scope.id, "left_anti").select("owner", "anchor", F.lit("out-of-scope").alias("problem"))
    return unknown.unionByName(outside)


def framework_reach(edges: DataFrame, owned: DataFrame) -> DataFrame:
    """framework, requirement_id and reach (full or partial) of what owned anchors map to.

    edges: anchor_id, framework, requirement_id, relationship.  Only superset and intersects reach in part."""
    met = edges.join(owned, edges.anchor_id == owned.id, "left_semi")
    part = F.col("relationship").isin("superset", "intersects")
    return met.groupBy("framework", "requirement_id").agg(F.when(F.max((~part).cast("int")) == 1, "full").otherwise("partial").alias("reach"))


def team_bundle(topics: DataFrame, edges: DataFrame, owner: str) -> DataFrame:
    """For an owner, by exact name in any case: each framework with the requirements that its anchors reach."""
    anchors = topics.where(F.lower("owner") == owner.lower()).select("anchor").distinct()
    return edges.join(anchors, edges.anchor_id == anchors.anchor, "left_semi").groupBy("framework").agg(F.countDistinct("requirement_id").alias("n"))


def reverse_lookup(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """requirement_id, owner and the smallest anchor via which the owner addresses it."""
    return edges.join(anchors, edges.anchor_id == anchors.anchor).groupBy("requirement_id", "owner").agg(F.min("anchor_id").alias("via"))


def split_adoption(requirements: DataFrame, adopted: DataFrame, reachable: DataFrame) -> DataFrame:
    """framework and id with scope in-scope, reachable or unadopted; adopting nothing puts everything in scope."""
    a = adopted.select("framework").distinct().withColumn("a", F.lit(True))
    none = adopted.agg((F.count("*") == 0).alias("none"))
    r = reachable.select("id").distinct().withColumn("r", F.lit(True))
    x = requirements.join(a, "framework", "left").join(r, "id", "left").join(F.broadcast(none))
    scope = F.when(F.col("none") | F.coalesce("a", F.lit(False)), "in-scope").when(F.col("r"), "reachable").otherwise("unadopted")
    return x.select("framework", "id", scope.alias("scope"))


def adopted_frameworks(catalog: DataFrame, anchors: DataFrame) -> DataFrame:
    """The frameworks of catalog (framework, id) with any id among anchors (anchor)."""
    return catalog.join(anchors.select(F.col("anchor").alias("id")).distinct(), "id", "left_semi").select("framework").distinct()


def admitted(content: DataFrame, providers: DataFrame, ceilings: DataFrame) -> DataFrame:
    """content's rows (content, provider) with whether the provider's exposure is at most the content class's ceiling; without a ceiling none is.

    providers (provider, exposure), ceilings (content, ceiling); from least to most exposed: local, self-hosted, third-party."""
    order = F.array(F.lit("local"), F.lit("self-hosted"), F.lit("third-party"))
    place = lambda c: F.array_position(order, F.col(c))
    x = content.join(providers, "provider", "left").join(ceilings, "content", "left").withColumn("exposure", F.coalesce("exposure", F.lit("third-party")))
    return x.select(*content.columns, F.coalesce((place("exposure") > 0) & (place("exposure") <= place("ceiling")), F.lit(False)).alias("admitted"))


def zero_reasons(requirements: DataFrame, reached: DataFrame, mapped: DataFrame, known: DataFrame) -> DataFrame:
    """framework, kind, partial, unowned, unmapped and reason of each framework of requirements (framework, id) that nothing covers in full.

    reached (framework, id, reach) holds what is owned in full or in part, mapped (framework, id) what a crosswalk names, and known (framework,
    kind, reason) what was found out before: 'design', never to be mapped; 'upstream', published but not read; 'searched', none found. The
    first of design and upstream is the kind; else 'mapped' where anything is reached in part or named by a crosswalk, with the three counts,
    which add up to the framework's requirements; else 'searched' or 'none'. Counts of the other kinds are null."""
    r = requirements.select("framework", "id").distinct()
    reach = reached.groupBy("framework", "id").agg(F.max((F.col("reach") == "full").cast("int")).alias("full"))
    named = mapped.select("framework", "id").distinct().withColumn("named", F.lit(True))
    x = r.join(reach, ["framework", "id"], "left").join(named, ["framework", "id"], "left")
    part, rest = F.col("full") == 0, F.col("full").isNull()
    x = x.groupBy("framework").agg(
        F.count_if(F.col("full") == 1).alias("covered"), F.count_if(part).alias("partial"), F.count_if(rest & F.col("named").isNotNull()).alias("unowned"), F.count_if(rest & F.col("named").isNull()).alias("unmapped")
    )
    said = known.groupBy("framework").agg(*(F.min(F.when(F.col("kind") == k, F.coalesce("reason", F.lit("")))).alias(k) for k in ("design", "upstream", "searched")))
    x = x.where("covered = 0").join(mapped.select("framework").distinct().withColumn("any", F.lit(True)), "framework", "left").join(said, "framework", "left")
    carried = (F.col("partial") > 0) | F.col("any").isNotNull()
    kind = F.when(F.col("design").isNotNull(), "design").when(F.col("upstream").isNotNull(), "upstream").when(carried, "mapped").when(F.col("searched").isNotNull(), "searched").otherwise("none")
    x = x.withColumn("kind", kind)
    counts = (F.when(F.col("kind") == "mapped", F.col(c)).alias(c) for c in ("partial", "unowned", "unmapped"))
    reason = F.when(F.col("kind") == "design", F.col("design")).when(F.col("kind") == "upstream", F.col("upstream")).when(F.col("kind") == "searched", F.col("searched"))
    return x.select("framework", "kind", *counts, reason.alias("reason"))
