"""Parameters of catalogs: texts that refer to parameters, whose texts may refer to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a text refers to a parameter, and what is printed for one.
INSERT = r"\{\{\s*insert:\s*param,\s*([^\s}]+)\s*\}\}"
UNNAMED = "[Assignment: organization-defined parameter]"


def printed(label: Column, choices: Column, how_many: Column) -> Column:
    """What stands for a parameter: its choices, which may refer to parameters, else its label as an assignment."""
    several = F.when(how_many == "one-or-more", " (one or more)").otherwise("")
    own = F.when(F.lower(label).startswith("organization-defined"), label).otherwise(F.concat(F.lit("organization-defined "), label))
    selection = F.concat(F.lit("[Selection"), several, F.lit(": "), F.array_join(F.transform(choices, lambda c: F.trim(c)), "; "), F.lit("]"))
    return F.when(choices.isNotNull(), selection).when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("[Assignment: "), own, F.lit("]"))).otherwise(UNNAMED)


def _pieces(text: Column) -> Column:
    """The text between references and the references, in order, as (text, ref)."""
    plain = F.transform(F.split(text, INSERT), lambda x: F.struct(x.alias("text"), F.lit(None).cast("string").alias("ref")))
    refs = F.zip_with(F.regexp_extract_all(text, F.lit(INSERT), 0), F.regexp_extract_all(text, F.lit(INSERT), 1), lambda x, r: F.struct(x.alias("text"), r.alias("ref")))
    return F.flatten(F.zip_with(plain, refs, lambda p, r: F.when(r.isNull(), F.array(p)).otherwise(F.array(p, r))))


def resolved(texts: DataFrame, params: DataFrame) -> DataFrame:
    """key and text of texts (key, scope, text) with references to params (scope, id, text; one row an id) replaced by their texts, and the references
    in those in turn.

    A reference inside its own parameter's text, at any depth, is an unnamed assignment; one to no parameter stays as it is.  Null texts
    give no row.  Each round joins the references that are left with their parameters; there are as many as parameters are nested."""
    params = params.select("scope", F.col("id").alias("ref"), F.col("text").alias("inner"))
    open_ = texts.where("text is not null").select("key", "scope", F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("seen"), "text", F.lit(None).cast("string").alias("ref"))
    take = lambda d: d.select("key", "scope", "at", "seen", F.posexplode(_pieces(F.col("text"))).alias("n", "p")).select("key", "scope", F.concat("at", F.array("n")).alias("at"), "seen", "p.text", "p.ref")
    open_, done = take(open_), None
    while True:
        closed = open_.where("ref is null")
        done = closed if done is None else done.unionByName(closed)
        left = open_.where("ref is not null")
        if left.isEmpty():
            break
        met = left.join(params, ["scope", "ref"], "left")
        again = F.array_contains("seen", F.col("ref"))
        text = F.when(F.col("inner").isNull(), F.col("text")).when(again, UNNAMED)
        done = done.unionByName(met.where(F.col("inner").isNull() | again).select("key", "scope", "at", "seen", text.alias("text"), F.lit(None).cast("string").alias("ref")))
        open_ = take(met.where(F.col("inner").isNotNull() & ~again).select("key", "scope", "at", F.concat("seen", F.array("ref")).alias("seen"), F.col("inner").alias("text")))
    parts = done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return parts.select("key", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
