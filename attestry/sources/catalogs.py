"""Readers and writers of catalogs, document trees and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENHANCEMENT = "struct<enhancement_id:string,title:string,baseline:string,description:string,parameter_values:map<string,string>,source_crosswalk:map<string,string>>"
REQUIREMENT = "struct<requirement_id:string,level:string,statement:string,level_kind:string,mappings:map<string,array<string>>>"
CONTROL = (
    "control_id string, title string, framework string, framework_version string, baseline string, control_statement string, discussion string, "
    f"related_controls array<string>, source_crosswalk map<string,string>, parameter_values map<string,string>, enhancements array<{ENHANCEMENT}>, requirements array<{REQUIREMENT}>"
)
CALL = (
    "timestamp string, provider string, model string, subject string, site string, content_class string, input_tokens long, output_tokens long, cost_usd double, "
    "prompt_sha string, error string, items long, stop_reason string"
)


def controls(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file or folder of JSON arrays of controls; missing lists are empty."""
    d = spark.read.schema(CONTROL).json(path, multiLine=True)
    return d.withColumns({c: F.coalesce(c, F.expr(f"cast(array() as {t})")) for c, t in (("enhancements", f"array<{ENHANCEMENT}>"), ("requirements", f"array<{REQUIREMENT}>"))})


def calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALL).json(path)


def control_ids(catalog: DataFrame) -> DataFrame:
    """framework, id and parent of controls, enhancements and requirements."""
    ids = F.concat(
        F.array(F.struct(F.col("control_id").alias("id"), F.lit(None).cast("string").alias("parent"))),
        F.transform("enhancements", lambda e: F.struct(e["enhancement_id"].alias("id"), F.col("control_id").alias("parent"))),
        F.transform("requirements", lambda r: F.struct(r["requirement_id"].alias("id"), F.col("control_id").alias("parent"))),
    )
    return catalog.select("framework", F.explode(ids).alias("x")).select("framework", "x.id", "x.parent")


def for_baseline(catalog: DataFrame, baseline: str) -> DataFrame:
    """Controls whose baseline contains the name in any case, each with only such enhancements."""
    has = lambda c: F.contains(F.lower(c), F.lit(baseline.lower()))
    return catalog.where(has(F.col("baseline"))).withColumn("enhancements", F.filter("enhancements", lambda e: has(e["baseline"])))


def markdown_tree(spark: SparkSession, path: str) -> DataFrame:
    """path, tier (by folder), title (first H1, else the file name) and body of the .md files below path."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    tier = F.regexp_extract("path", "/(policies|standards|procedures)/", 1)
    tier = F.when(tier == "policies", "policy").when(tier == "standards", "standard").when(tier == "procedures", "procedure").otherwise("")
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("body", r"(?m)^#\s+(.+)$", 1)), F.lit("")), F.regexp_extract("path", r"([^/]+)\.md$", 1))
    return d.select("path", tier.alias("tier"), title.alias("title"), "body")


def lost_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that a parse lost; a load is refused unless this is empty."""
    return before.select(key).join(after.select(key), key, "left_anti")


def write_crosswalk(edges: DataFrame, path: str, allow_loss: bool = False) -> None:
    """Edges as JSON, one object for each anchor and framework.

    Raises ValueError, and leaves what stands at the path as it is, if an anchor that has edges to a framework there would have none, unless allow_loss."""
    spark = edges.sparkSession
    rows = edges.groupBy("anchor_id", "framework").agg(F.sort_array(F.collect_set("requirement_id")).alias("requirement_ids"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not allow_loss and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        key = F.struct("anchor_id", "framework").alias("key")
        held = spark.read.schema("anchor_id string, framework string").json(path).select(key)
        lost = lost_keys(held, edges.select(F.col("anchor_id").cast("string").alias("anchor_id"), F.col("framework").cast("string").alias("framework")).select(key), "key")
        if not lost.isEmpty():
            some = ", ".join(sorted(f"{r.key.anchor_id} -> {r.key.framework}" for r in lost.limit(5).collect()))
            raise ValueError(f"{lost.count()} anchors would lose a framework's edges: {some}")
    rows.write.mode("overwrite").json(path)
