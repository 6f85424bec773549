"""Headings, chunks, tags, statements and parameters of markdown and HTML documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import modality, slug

# Fixed value: a source tag is a capitalised name and an id in single brackets that is no link.
TAG = r"(?<!\[)(\[(?!\[)[A-Z][A-Za-z0-9]*(?:[ -][A-Z0-9][A-Za-z0-9]*)*\s+(?=[^\]\s]*\d)[^\]]*\])(?!\()"
PARAMETER = r"(\[(?:Assignment|Selection)[^\]]*\])"


def lines(docs: DataFrame) -> DataFrame:
    """(id, line, text, fenced, level, heading) of each line of docs (id, body); headings inside fences don't count."""
    x = docs.select("id", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    before = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("text").rlike(r"^\s*(```|~~~)")
    x = x.withColumn("fenced", (F.sum(mark.cast("int")).over(before) - mark.cast("int")) % 2 == 1).withColumn("mark", mark)
    head = F.when(~F.col("fenced") & ~F.col("mark"), F.nullif(F.regexp_extract("text", r"^(#{1,6})\s+\S", 1), F.lit("")))
    return x.select("id", "line", "text", "fenced", F.length(head).alias("level"), F.when(head.isNotNull(), F.trim(F.regexp_replace("text", r"^#{1,6}\s+", ""))).alias("heading"))


def heading_paths(docs: DataFrame) -> DataFrame:
    """lines with path, the headings that stand above each line, outermost first."""
    x = lines(docs)
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    at = {k: F.last(F.when(F.col("level") == k, F.struct("line", "heading")), True).over(w) for k in range(1, 7)}
    x = x.withColumns({f"h{k}": c for k, c in at.items()})
    keep = []
    for k in range(1, 7):  # a heading stands above a line while no later one of its level or above does
        newer = [F.coalesce(F.col(f"h{j}.line"), F.lit(-1)) for j in range(1, k)]
        alive = F.col(f"h{k}.line") > (F.greatest(*newer) if len(newer) > 1 else newer[0]) if newer else F.col(f"h{k}.line").isNotNull()
        keep.append(F.when(alive, F.col(f"h{k}.heading")))
    return x.select("id", "line", "text", "fenced", "level", F.array_compact(F.array(*keep)).alias("path"))


def chunks(docs: DataFrame) -> DataFrame:
    """(id, index, path, text): what stands between headings, without empty chunks."""
    x = heading_paths(docs)
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("part", F.sum(F.col("level").isNotNull().cast("int")).over(w)).where("level is null")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n")
    x = x.groupBy("id", "part").agg(F.first("path").alias("path"), F.regexp_replace(joined, r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    return x.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("part")) - 1).alias("index"), "path", "text")


def tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TAG), 1)


def tag_parts(docs: DataFrame) -> DataFrame:
    """(id, framework, part): the parts of tags split at bars; a part without a name takes the one before it."""
    x = docs.select("id", F.posexplode(tags(F.col("body"))).alias("tag", "t"))
    x = x.select("id", "tag", F.posexplode(F.split(F.regexp_replace("t", r"^\[|\]$", ""), r"\s*\|\s*")).alias("pos", "part"))
    name = F.nullif(F.regexp_extract("part", r"^([A-Z][A-Za-z0-9]*(?:[ -][A-Z0-9][A-Za-z0-9]*)*)\s+\S*\d", 1), F.lit(""))
    w = Window.partitionBy("id", "tag").orderBy("pos")
    x = x.withColumn("own", name)
    return x.select("id", F.last("own", True).over(w).alias("framework"), F.when(F.col("own").isNull(), F.col("part")).otherwise(F.trim(F.expr("substring(part, length(own) + 1)"))).alias("part"))


def sentences(text: Column) -> Column:
    """text split after . ! ? where white space and a capital, quote or bracket follow, but not after a single initial."""
    return F.split(text, r"(?<=[.!?])(?<!\b[A-Z]\.)\s+(?=[\"'\[(A-Z])")


def statements(docs: DataFrame) -> DataFrame:
    """(id, pos, sentence, modality, cited)."""
    x = docs.select("id", F.posexplode(sentences(F.col("body"))).alias("pos", "sentence"))
    return x.select("id", "pos", "sentence", modality(F.col("sentence")).alias("modality"), (F.size(tags(F.col("sentence"))) > 0).alias("cited"))


def parameters(controls: DataFrame) -> DataFrame:
    """(key, control_id, label, occurrences) of the open parameters in controls (control_id, statement)."""
    x = controls.select("control_id", F.explode(F.regexp_extract_all("statement", F.lit(PARAMETER), 1)).alias("marker"))
    inner = F.regexp_extract("marker", r"^\[(?:Assignment|Selection)[^:]*:\s*([^\]]*)\]$", 1)
    label = F.when(F.col("marker").startswith("[Selection"), "selection").otherwise(F.trim(F.regexp_replace(inner, "^organization-defined ", "")))
    x = x.groupBy("control_id", label.alias("label")).agg(F.count("*").alias("occurrences"))
    return x.select(F.concat_ws("/", "control_id", slug(F.col("label"))).alias("key"), "control_id", "label", "occurrences")


def resolved(controls: DataFrame, decisions: DataFrame) -> DataFrame:
    """control_id and statement with each decided marker replaced; decisions: control_id, marker, value."""
    pairs = decisions.groupBy("control_id").agg(F.sort_array(F.collect_list(F.struct("marker", "value"))).alias("pairs"))
    x = controls.join(pairs, "control_id", "left")
    text = F.aggregate(F.coalesce("pairs", F.expr("cast(array() as array<struct<marker:string,value:string>>)")), F.col("statement"), lambda t, p: F.replace(t, p["marker"], p["value"]))
    return x.select("control_id", text.alias("statement"))


def html_items(pages: DataFrame, tag: str) -> DataFrame:
    """(id, n, first): number of elements tag in pages (id, html) and the first one's text without markup."""
    found = F.regexp_extract_all("html", F.lit(f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), 1)
    x = pages.select("id", found.alias("found")).where(F.size("found") > 0)
    return x.select("id", F.size("found").cast("long").alias("n"), F.trim(F.regexp_replace(F.regexp_replace(F.get("found", 0), "<[^>]+>", " "), "[ \\t\\r\\n]+", " ")).alias("first"))
