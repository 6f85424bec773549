"""Reconciling document trees with published pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_trees(tree: DataFrame, pages: DataFrame) -> DataFrame:
    """All documents by title in any case; where both sides have a title, the tree's counts: title, id, origin."""
    t = tree.select(F.lower("title").alias("title"), "id", F.lit("tree").alias("origin"))
    p = pages.select(F.lower("title").alias("title"), "id", F.lit("pages").alias("origin"))
    return t.unionByName(p.join(t.select("title").distinct(), "title", "left_anti").select("title", "id", "origin"))


def page_state(docs: DataFrame, live: DataFrame) -> DataFrame:
    """id and state: ABSENT without a live page; MOVED where someone else changed the page since it was
    pulled and its content differs; else IN_SYNC."""
    p = live.select("id", F.col("body").alias("live_body"), F.col("version").alias("live_version"), "stamped")
    x = docs.join(p, "id", "left")
    state = F.when(F.col("live_version").isNull(), "ABSENT").when(~F.col("stamped") & ~F.col("live_version").eqNullSafe(F.col("recorded")) & (F.col("live_body") != F.col("body")), "MOVED").otherwise("IN_SYNC")
    return x.select("id", state.alias("state"))


def publish_plan(docs: DataFrame, live: DataFrame) -> DataFrame:
    """id and action: UNDECLARED, SKIPPED (licence, unsupported macros), MOVED, UPDATED or CREATED."""
    p = live.select("id", F.col("body").alias("live_body"), F.col("version").alias("live_version"), "stamped", "macros")
    moved = ~F.col("stamped") & ~F.col("live_version").eqNullSafe(F.col("recorded")) & (F.col("live_body") != F.col("body")) & ~F.col("forced")
    action = (
        F.when(F.col("target").isNull(), "UNDECLARED").when(F.col("licensed"), "SKIPPED").when(F.coalesce(F.col("macros") > 0, F.lit(False)), "SKIPPED")
        .when(F.col("live_version").isNull(), "CREATED").when(moved, "MOVED").otherwise("UPDATED")
    )
    return docs.join(p, "id", "left").select("id", action.alias("action"))


def fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """name and change of prompts (name, hash): same, changed, removed, added, or renamed where the hash lives on under a new name.

    The joins are merged, as both sides grow with the prompts; none is sent whole through the driver."""
    x = old.select("name", F.col("hash").alias("old")).hint("merge").join(new.select("name", F.col("hash").alias("new")), "name", "full_outer")
    gone, fresh = x.where("new is null").select(F.col("old").alias("h")).distinct(), x.where("old is null").select(F.col("new").alias("h")).distinct()
    both = gone.hint("merge").join(fresh, "h").withColumn("r", F.lit(True))
    x = x.join(both.hint("merge"), F.coalesce("old", "new") == F.col("h"), "left")
    what = F.when(F.col("r") & (F.col("old").isNull() | F.col("new").isNull()), "renamed").when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return x.select("name", what.alias("what"))
