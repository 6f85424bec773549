"""Mappings between catalogs as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import CROSSWALK_ID


def cell_edges(cells: DataFrame) -> DataFrame:
    """(anchor_id, framework, requirement_id, ord) from free-text cells: requirement_id, framework, cell; the first of equal edges counts."""
    found = cells.select("framework", "requirement_id", F.posexplode(F.regexp_extract_all("cell", F.lit(f"({CROSSWALK_ID})"), 1)).alias("ord", "anchor_id"))
    return found.groupBy(F.upper("anchor_id").alias("anchor_id"), "framework", "requirement_id").agg(F.min("ord").alias("ord"))


def build(*passes: DataFrame) -> DataFrame:
    """Distinct edges of all passes with the first pass that has them; each pass: anchor_id, framework, requirement_id."""
    whole = None
    for k, p in enumerate(passes):
        p = p.select("anchor_id", "framework", "requirement_id", F.lit(k).alias("pass"))
        whole = p if whole is None else whole.unionByName(p)
    return whole.groupBy("anchor_id", "framework", "requirement_id").agg(F.min("pass").alias("pass"))


def accepted(overlay: DataFrame) -> DataFrame:
    """The last accepted row of each (framework, requirement_id, anchor_id) in the order of seq."""
    last = Window.partitionBy("framework", "requirement_id", "anchor_id").orderBy(F.desc("seq"))
    return overlay.where("status = 'accepted'").withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def apply_overlay(edges: DataFrame, overlay: DataFrame) -> DataFrame:
    """Edges where each requirement that the overlay lists has its accepted rows instead of all it had."""
    key = ["framework", "requirement_id"]
    kept = edges.join(overlay.select(*key).distinct(), key, "left_anti").select("anchor_id", *key)
    return kept.unionByName(overlay.where("status = 'accepted'").select("anchor_id", *key).distinct())


def check_overlay(overlay: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """problem and n: rows of unknown requirements, of unknown anchors, and those still proposed."""
    r = overlay.join(edges.select("framework", "requirement_id").distinct(), ["framework", "requirement_id"], "left_anti")
    a = overlay.join(anchors, "anchor_id", "left_anti")
    rows = r.select(F.lit("unknown requirement").alias("problem")).union(a.select(F.lit("unknown anchor"))).union(overlay.where("status = 'proposed'").select(F.lit("proposed")))
    return rows.groupBy("problem").agg(F.count("*").alias("n"))


def provenance(sources: Column, reviewed: Column) -> Column:
    """published without a row or when its sources say so, reviewed when someone did, else unreviewed."""
    return F.when(sources.isNull(), "published").when(reviewed, "reviewed").when(F.array_contains(sources, "published"), "published").otherwise("unreviewed")


def merge_proposals(rows: DataFrame, asserted: DataFrame) -> DataFrame:
    """rows (key, status, reviewed, relationship) merged with asserted (key, relationship): decisions stay as they are,
    unreviewed rows get a flag where the proposal differs or is missing, new keys become proposed rows."""
    a = asserted.select("key", F.col("relationship").alias("said"))
    x = rows.join(a, "key", "full_outer")
    flag = (
        F.when(F.col("status").isNull() | F.col("reviewed") | (F.col("status") == "rejected"), F.lit(""))
        .when(F.col("said").isNull(), "not-confirmed").when(F.col("said") != F.col("relationship"), "relationship-proposed").otherwise("")
    )
    return x.select("key", F.coalesce("status", F.lit("proposed")).alias("status"), F.coalesce("relationship", "said").alias("relationship"), flag.alias("flag"))


def joined_columns(fde: DataFrame, rde: DataFrame, olir: DataFrame) -> DataFrame:
    """Three published tables joined by key without its prefix (FDE-, RDE-, OE-); rows that a table lacks are listed as gaps."""
    def short(d: DataFrame, name: str) -> DataFrame:
        return d.select(F.regexp_replace("key", "^(FDE|RDE|OE)-", "").alias("key"), F.col("value").alias(name))
    x = short(fde, "fde").join(short(rde, "rde"), "key", "full_outer").join(short(olir, "olir"), "key", "full_outer")
    return x.select("key", "fde", "rde", "olir", (F.col("fde").isNull() | F.col("rde").isNull() | F.col("olir").isNull()).alias("gap"))


def split_mappings(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """line, source and id of mapping lines: the longest source that a line begins with, and the rest; '' and the whole line if none does.

    A source ends where no letter or digit follows.  Each distinct line is cut at such places, so lines and sources meet by equality."""
    x = lines.select("line").distinct().select("line", F.trim(F.regexp_replace("line", r"\s+", " ")).alias("text"))
    ends = F.filter(F.sequence(F.lit(1), F.length("text")), lambda n: ~F.col("text").substr(n + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]"))
    cuts = x.where("text <> ''").select("line", F.explode(ends).alias("n"), "text").select("line", F.expr("substring(text, 1, n)").alias("source"))
    found = cuts.join(sources.select("source").distinct(), "source").groupBy("line").agg(F.max_by("source", F.length("source")).alias("source"))
    x = x.join(found, "line", "left").withColumn("source", F.coalesce("source", F.lit("")))
    rest = F.regexp_replace(F.expr("substring(text, length(source) + 1)"), r"^[\s§¶#:,–-]+|[\s§¶#:,–-]+$", "")
    return lines.join(x.select("line", "source", F.when(F.col("source") == "", F.col("text")).otherwise(rest).alias("id")), "line")
