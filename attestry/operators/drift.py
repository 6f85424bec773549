"""Differences between versions of a catalog and what they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import parent
from .documents import PARAMETER


def flowed(text: Column) -> Column:
    """text with runs of white space as one space, so that reflowing is no change."""
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "))


def diff(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """id, kind (added, removed, changed) and the changed fields, joined by commas."""
    o = old.select(F.col("id").alias("old_id"), *(F.col(f).alias(f"old_{f}") for f in fields))
    x = new.join(o, F.col("id") == F.col("old_id"), "full_outer")
    changed = F.array_compact(F.array(*(F.when(~flowed(F.col(f).cast("string")).eqNullSafe(flowed(F.col(f"old_{f}").cast("string"))), F.lit(f)) for f in fields)))
    kind = F.when(F.col("old_id").isNull(), "added").when(F.col("id").isNull(), "removed").otherwise("changed")
    x = x.select(F.coalesce("id", "old_id").alias("id"), kind.alias("kind"), F.when(kind == "changed", F.array_join(changed, ",")).otherwise("").alias("fields"))
    return x.where("kind <> 'changed' or fields <> ''")


def impact(changes: DataFrame, topics: DataFrame, documents: DataFrame, parameters: DataFrame) -> DataFrame:
    """What a change reaches: (id, what, name) from topics (anchor, name), documents (cited, name) and parameters (control_id, name)."""
    reach = [topics.select(F.col("anchor").alias("id"), F.lit("topic").alias("what"), "name"), documents.select(F.col("cited").alias("id"), F.lit("document").alias("what"), "name"), parameters.select(F.col("control_id").alias("id"), F.lit("parameter").alias("what"), "name")]
    return reach[0].unionByName(reach[1]).unionByName(reach[2]).join(changes.select("id"), "id", "left_semi").distinct()


CONTROL_FIELDS = ("control_statement", "baseline", "enhancements", "parameters", "discussion", "title", "related_controls")
ENHANCEMENT_FIELDS = ("description", "baseline", "parameters", "title")
SAME = "\u0001"  # between the members of a set that is compared as one text


def catalog_rows(catalog: DataFrame) -> DataFrame:
    """id, parent (null of a control) and what is compared of each control and enhancement of a catalog: texts, and sets in sorted order.

    A control's parameters are the labels that its statement leaves open, an enhancement's are those that it has values for."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), SAME)
    held = F.coalesce("enhancements", F.array().cast(dict(catalog.dtypes)["enhancements"]))
    empty = lambda c: F.coalesce(c, F.lit(""))
    open_ = F.transform(F.regexp_extract_all(empty(F.col("control_statement")), F.lit(PARAMETER), 1), lambda p: flowed(F.lower(p)))
    none = F.lit(None).cast("string")
    own = F.struct(
        F.col("control_id").alias("id"), none.alias("parent"), empty(F.col("control_statement")).alias("text"), empty(F.col("baseline")).alias("baseline"), joined(F.transform(held, lambda e: e["enhancement_id"])).alias("below"),
        joined(open_).alias("parameters"), empty(F.col("discussion")).alias("discussion"), empty(F.col("title")).alias("title"), F.array_join(F.array_sort(F.coalesce("related_controls", F.array().cast("array<string>"))), SAME).alias("related"),
    )
    parts = F.transform(held, lambda e: F.struct(
        e["enhancement_id"].alias("id"), F.col("control_id").alias("parent"), empty(e["description"]).alias("text"), empty(e["baseline"]).alias("baseline"), F.lit("").alias("below"),
        joined(F.coalesce(F.map_keys(e["parameter_values"]), F.array().cast("array<string>"))).alias("parameters"), F.lit("").alias("discussion"), empty(e["title"]).alias("title"), F.lit("").alias("related"),
    ))
    return catalog.select(F.explode(F.concat(F.array(own), parts)).alias("x")).select("x.*")


def catalog_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, parent, kind (added, removed, changed) and fields (by commas) of what differs between two loads of a catalog: controls, and the enhancements of controls that both have.

    White space that only flows otherwise is no change, in a control's title and baseline it is.  A control names its enhancements as changed if one came or went."""
    a, b = (catalog_rows(d) for d in (old, new))
    both = old.select(F.col("control_id").alias("parent")).join(new.select(F.col("control_id").alias("parent")), "parent", "left_semi")
    inside = lambda d: d.where("parent is null").unionByName(d.where("parent is not null").join(both.distinct(), "parent", "left_semi").select(*d.columns))
    was = [F.col(c).alias(f"old_{c}") for c in a.columns]
    x = inside(b).join(inside(a).select(*was), F.col("id").eqNullSafe(F.col("old_id")) & F.col("parent").eqNullSafe(F.col("old_parent")), "full_outer")
    kind = F.when(F.col("old_id").isNull(), "added").when(F.col("id").isNull(), "removed").otherwise("changed")
    control = F.coalesce("parent", "old_parent").isNull()
    raw = lambda c: F.col(c) != F.col(f"old_{c}")
    flow = lambda c: flowed(F.col(c)) != flowed(F.col(f"old_{c}"))
    said = lambda name, differs: F.when(differs, F.lit(name))
    of_control = zip(CONTROL_FIELDS, (flow("text"), raw("baseline"), raw("below"), raw("parameters"), flow("discussion"), raw("title"), raw("related")), strict=True)
    of_part = zip(ENHANCEMENT_FIELDS, (flow("text"), raw("baseline"), raw("parameters"), flow("title")), strict=True)
    fields = F.when(control, F.array_join(F.array_compact(F.array(*(said(*f) for f in of_control))), ",")).otherwise(F.array_join(F.array_compact(F.array(*(said(*f) for f in of_part))), ","))
    x = x.select(F.coalesce("id", "old_id").alias("id"), F.coalesce("parent", "old_parent").alias("parent"), kind.alias("kind"), F.when(kind == "changed", fields).otherwise("").alias("fields"))
    return x.where("kind <> 'changed' or fields <> ''")


def base(id_: Column) -> Column:
    """An id without what stands in brackets, in upper case."""
    return F.upper(F.trim(F.split(id_, r"\(")[0]))


def reached(changes: DataFrame, topics: DataFrame, documents: DataFrame, decisions: DataFrame, rule: str = "base") -> DataFrame:
    """Distinct id, what and name of what changes (id) reach.

    topics (anchor, name): rule says which anchors claim a changed id: its own and its parent's ('anchored', of catalogs that topics anchor), its own and its base
    ('base'), or none ('none').  documents (cited, name): those that cite the id, or one with its base.  decisions (key, name): those whose key, up to
    a slash, is the id in any case."""
    c = changes.select("id").distinct()
    own = F.array(F.upper("id"), F.upper(parent(F.col("id")))) if rule == "anchored" else F.array(F.upper("id"), base(F.col("id")))
    keys = c.select("id", F.explode(F.array_compact(own)).alias("anchor")).distinct()
    if rule == "none":
        keys = keys.limit(0)
    by_topic = keys.join(topics.select(F.upper("anchor").alias("anchor"), "name"), "anchor").select("id", F.lit("topic").alias("what"), "name")
    by_base = c.select("id", base(F.col("id")).alias("base")).join(documents.select(base(F.col("cited")).alias("base"), "name").distinct(), "base").select("id", F.lit("document").alias("what"), "name")
    decided = decisions.select(F.upper(F.split("key", "/")[0]).alias("said"), "name")
    by_key = c.join(decided, F.upper("id") == F.col("said")).select("id", F.lit("parameter").alias("what"), "name")
    return by_topic.unionByName(by_base).unionByName(by_key).distinct()
