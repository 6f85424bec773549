"""OSCAL catalogs and baseline profiles as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.params import printed, resolved

# Baselines in the order in which they are named.
BASELINES = ("Low", "Moderate", "High")


@dataclass(frozen=True)
class Dialect:
    """How a publisher writes ids: by the label without a class (sorted=False) or by the sort-id; parts then name the control again."""

    framework: str
    version: str
    sorted: bool = False


SP800_53 = Dialect("NIST 800-53", "Rev 5 ({})")
SP800_171 = Dialect("NIST 800-171", "Rev 3 ({})", True)


def _get(item: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(item) if isinstance(item, str) else item, f"$.{path}", kind)


def _list(item: str | Column, path: str) -> Column:
    return F.coalesce(_get(item, path, "array<variant>"), F.array().cast("array<variant>"))


def _prop(item: str, name: str, unclassed: bool = False) -> Column:
    """The first value of a property; unclassed: of one without a class, if there is any."""
    own = F.filter(_list(item, "props"), lambda p: _get(p, "name") == name)
    first = _get(F.get(own, F.lit(0)), "value")
    return F.coalesce(_get(F.get(F.filter(own, lambda p: _get(p, "class").isNull()), F.lit(0)), "value"), first) if unclassed else first


def _withdrawn(item: str | Column) -> Column:
    return F.exists(_list(item, "props"), lambda p: F.coalesce((_get(p, "name") == "status") & (_get(p, "value") == "withdrawn"), F.lit(False)))


def _identifier(item: str, dialect: Dialect) -> Column:
    own = _prop(item, "sort-id") if dialect.sorted else _prop(item, "label", unclassed=True)
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.upper(_get(item, "id")))


def label_of(oscal_id: Column) -> Column:
    """AC-2(1) of ac-2.1; other ids in upper case."""
    shape = r"^([a-z]{2})-0*(\d+?)(?:\.0*(\d+?))?$"
    family, number, part = (F.regexp_extract(oscal_id, shape, k) for k in (1, 2, 3))
    whole = F.concat(F.upper(family), F.lit("-"), number)
    return F.when(family == "", F.upper(oscal_id)).when(part == "", whole).otherwise(F.concat(whole, F.lit("("), part, F.lit(")")))


def catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """path and catalog of JSON files, each read whole."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v")).select("path", F.variant_get("v", "$.catalog", "variant").alias("catalog"))


def profile_ids(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """baseline and id of the controls that baseline profiles include, by the baselines' names."""
    out = None
    for name, path in paths.items():
        v = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v")).select(F.explode(_list("v", "profile.imports")).alias("i"))
        ids = v.select(F.explode(_list("i", "include-controls")).alias("c")).select(F.explode(_get("c", "with-ids", "array<string>")).alias("id"))
        ids = ids.select(F.lit(name).alias("baseline"), "id").distinct()
        out = ids if out is None else out.unionByName(ids)
    return out


def declared(catalogs: DataFrame) -> int:
    """How many controls the JSON holds at any depth, whatever this reader makes of them."""
    level, total = catalogs.select(F.col("catalog").alias("node")), 0
    while True:
        children = level.select(F.explode(F.concat(
            F.transform(_list("node", "controls"), lambda c: F.struct(c.alias("node"), F.lit(1).alias("n"))), F.transform(_list("node", "groups"), lambda g: F.struct(g.alias("node"), F.lit(0).alias("n")))
        )).alias("x")).select("x.*")
        met = children.agg(F.count("*").alias("nodes"), F.sum("n").alias("n")).first()
        if not met.nodes:
            return total
        total, level = total + (met.n or 0), children.select("node")


def _rendered(items: DataFrame, name: str, dialect: Dialect) -> DataFrame:
    """key and text (still with references) of the first part of a name of items (key, item, identifier): its own prose, or a line for each part below it with
    prose, indented by depth and opened by its label."""
    part = F.get(F.filter(_list("item", "parts"), lambda p: _get(p, "name") == name), F.lit(0))
    top = items.select("key", "identifier", part.alias("part")).where("part is not null")
    below = F.size(_list("part", "parts")) > 0
    alone = top.where(~below).select("key", F.array().cast("array<int>").alias("at"), F.trim(F.coalesce(_get("part", "prose"), F.lit(""))).alias("line"))
    level, lines, depth = top.where(below).select("key", "identifier", F.array().cast("array<int>").alias("at"), "part"), alone, 0
    while not level.isEmpty():
        level = level.select("key", "identifier", "at", F.posexplode(_list("part", "parts")).alias("n", "part")).select("key", "identifier", F.concat("at", F.array("n")).alias("at"), "part")
        label = F.coalesce(_prop("part", "label", unclassed=True), F.lit(""))
        if dialect.sorted:  # parts are labelled with the control's id in front of their own
            at = F.instr(label, F.concat(F.col("identifier"), F.lit(".")))
            label = F.when((at > 0) & (F.length(label) >= at + F.length("identifier") + 1), F.substr(label, at + F.length("identifier") + 1)).otherwise(label)
        prose = F.trim(F.coalesce(_get("part", "prose"), F.lit("")))
        line = F.concat(F.lit("  " * depth), F.when(label == "", "").otherwise(F.concat(label, F.lit(" "))), prose)
        lines = lines.unionByName(level.where(prose != "").select("key", "at", line.alias("line")))
        depth += 1
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("key").agg(text.alias("text"))


def _texts(items: DataFrame, params: DataFrame, name: str, dialect: Dialect) -> DataFrame:
    held = _rendered(items, name, dialect).join(items.select("key", "scope"), "key")
    return resolved(held, params)


def controls(catalogs: DataFrame, baselines: DataFrame | None = None, dialect: Dialect = SP800_53) -> DataFrame:
    """Controls of catalogs (path, catalog): pos, control_id, title, framework, framework_version, family, family_abbr, baseline, control_statement, discussion,
    related_controls and enhancements (enhancement_id, title, baseline, description).

    Withdrawn controls, with what stands below them, and withdrawn enhancements are left out.  A reference in a text may mean a parameter of its control or
    of any of the control's enhancements.  baselines (baseline, id): names in their order.  Raises ValueError if the JSON declares a control that is neither given nor
    withdrawn, as those of nested groups or below enhancements are."""
    groups = catalogs.select("path", _get("catalog", "metadata.version").alias("version"), F.posexplode(_list("catalog", "groups")).alias("g", "group"))
    raw = groups.select("path", "version", "g", "group", F.posexplode(_list("group", "controls")).alias("c", "item"))
    raw = raw.withColumn("scope", F.concat_ws("/", "path", F.col("g").cast("string"), F.col("c").cast("string")))
    live = raw.where(~_withdrawn("item"))
    parts = live.select("scope", F.posexplode(_list("item", "controls")).alias("e", "item"))
    kept = parts.where(~_withdrawn("item"))
    gone = raw.where(_withdrawn("item")).agg(F.sum(F.size(_list("item", "controls")) + 1)).first()[0] or 0
    gone += parts.where(_withdrawn("item")).count()
    given, all_ = live.count() + kept.count(), declared(catalogs)
    if given + gone != all_:
        raise ValueError(f"the catalog declares {all_} controls, of which {given} are read and {gone} withdrawn: {all_ - given - gone} would be lost")
    owned = live.select("scope", F.lit(-1).alias("e"), "item").unionByName(parts)
    params = owned.select("scope", "e", F.posexplode(_list("item", "params")).alias("n", "p"))
    select_ = _get("p", "select", "variant")
    text = printed(_get("p", "label"), F.when(select_.isNotNull(), F.coalesce(_get(select_, "choice", "array<string>"), F.array().cast("array<string>"))), _get(select_, "how-many"))
    params = params.select("scope", "e", "n", _get("p", "id").alias("id"), text.alias("text")).groupBy("scope", "id").agg(F.max(F.struct("e", "n", "text"))["text"].alias("text"))  # the last of an id
    items = live.select(F.concat("scope", F.lit("/-1")).alias("key"), "scope", F.lit(-1).alias("e"), "item").unionByName(kept.select(F.concat_ws("/", "scope", F.col("e").cast("string")).alias("key"), "scope", "e", "item"))
    items = items.withColumn("identifier", _identifier("item", dialect))
    known = items.select("key", _get("item", "id").alias("id"))
    if baselines is None:
        labels = known.select("key", F.lit("").alias("baseline"))
    else:
        order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, BASELINES)), F.col("baseline")), F.lit(0)), F.lit(len(BASELINES) + 1))
        named = known.join(baselines, "id").groupBy("key").agg(F.array_sort(F.collect_set(F.struct(order.alias("at"), "baseline"))).alias("names"))
        labels = known.join(named, "key", "left").select("key", F.coalesce(F.array_join(F.transform("names", lambda x: x["baseline"]), ", "), F.lit("")).alias("baseline"))
    said = _texts(items, params, "statement", dialect).withColumnRenamed("text", "said")
    about = _texts(items.where("e = -1"), params, "guidance", dialect).withColumnRenamed("text", "about")
    x = items.join(labels, "key").join(said, "key", "left").withColumns({"said": F.coalesce("said", F.lit("")), "title": F.coalesce(_get("item", "title"), F.lit(""))})
    enhancement = F.struct("e", F.col("identifier").alias("enhancement_id"), "title", "baseline", F.col("said").alias("description"))
    below = x.where("e >= 0").groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(enhancement)), lambda s: s.dropFields("e")).alias("enhancements"))
    related = F.transform(F.filter(_list("item", "links"), lambda link: _get(link, "rel") == "related"), lambda link: F.regexp_replace(_get(link, "href"), "^#+", ""))
    heads = live.select("scope", "path", "g", "c", F.lit(dialect.framework).alias("framework"), F.format_string(dialect.version.replace("{}", "%s"), "version").alias("framework_version"), F.coalesce(_get("group", "title"), F.lit("")).alias("family"), (_identifier("group", dialect) if dialect.sorted else F.upper(F.coalesce(_get("group", "id"), F.lit("")))).alias("family_abbr"))
    y = x.where("e = -1").join(heads, "scope").join(below, "scope", "left").join(about, "key", "left")
    pos = F.row_number().over(Window.partitionBy("path").orderBy("g", "c"))  # one catalog's controls
    none = F.array().cast("array<struct<enhancement_id:string,title:string,baseline:string,description:string>>")
    return y.select(
        "path", pos.alias("pos"), F.col("identifier").alias("control_id"), "title", "framework", "framework_version", "family", "family_abbr", "baseline", F.col("said").alias("control_statement"),
        F.coalesce("about", F.lit("")).alias("discussion"), F.array_distinct(F.transform(related, label_of)).alias("related_controls"), F.coalesce("enhancements", none).alias("enhancements"),
    )
