"""Catalogs assembled from the rows of an export whose mapping lines name their sources without a mark between source and citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crosswalk import split_mappings
from .ledger import longest_names

# How many continuations end a source's name, how long names are, what isn't part of them, and numbers of standards, which are.
BRANCHES, NAME_TOKENS = 6, 12
NAME_TRIM = " §¶#:,-–"
STANDARD_NUMBER = r"^\d{3,5}(?:[:\-.]\d{1,4})*$"
# How references, objectives, categories and levels are written.
REFERENCE = r"^\s*(\d{1,2}\.[a-z]{1,2})\s+(.*\S)?\s*$"
OBJECTIVE = r"^\s*(\d{1,2}\.\d{2})(?![\d.])\s+(.*\S)?\s*$"
CATEGORY = r"^\s*(\d{1,2}\.0)(?![\d.])\s*[-–]?\s*(.*\S)?\s*$"
MATURITY = r"(?i)^Level\s+[123]$"

RECORD = (
    "seq long, category string, objective string, objective_statement string, reference string, specification string, factor_type string, level string, "
    "statement string, organizational_factors string, system_factors string, regulatory_factors string, mapping string"
)


def learned_sources(lines: DataFrame, branches: int = BRANCHES, tokens: int = NAME_TOKENS) -> DataFrame:
    """The distinct source names of mapping lines (line).

    Names begin lines, and what follows a whole name varies: of a line's beginnings by words, at most `tokens`, its source is the shortest that
    at least `branches` different words follow in all lines, or that leaves one word, unless a standard's number comes next; else it is the
    first word.  Marks around a name aren't part of it.  Null and empty lines name nothing.

    Beginnings are counted by their distinct next words in two steps, so one that most lines share is no group of one task."""
    x = lines.where("line <> ''").select("line").distinct().select("line", F.split("line", " ").alias("t"))
    x = x.select("line", "t", F.explode(F.sequence(F.lit(1), F.least(F.size("t"), F.lit(tokens)))).alias("n"))
    x = x.select("line", "n", F.array_join(F.slice("t", F.lit(1), F.col("n")), " ").alias("name"), F.get("t", F.col("n")).alias("next"), F.size("t").alias("size"), F.get("t", F.lit(0)).alias("word"))
    follows = x.where("next is not null").select("name", "next").distinct().groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= branches)
    x = x.join(follows.select("name", F.lit(True).alias("ends")), "name", "left")
    whole = (F.col("ends").isNotNull() | (F.col("n") == F.col("size") - 1)) & ~F.coalesce(F.col("next").rlike(STANDARD_NUMBER), F.lit(False))
    chosen = x.groupBy("line").agg(F.min(F.when(whole, F.struct("n", "name")))["name"].alias("name"), F.first("word").alias("word"))
    return chosen.select(F.btrim(F.coalesce("name", "word"), F.lit(NAME_TRIM)).alias("source")).where("source <> ''").distinct()


def squashed(text: Column) -> Column:
    """text with one space for each run of white space and none around it."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def cell_lines(cell: Column) -> Column:
    """The lines of a cell without white space around them; blank ones are left out."""
    lines = F.split(F.regexp_replace(F.coalesce(cell, F.lit("")), "\r\n?", "\n"), "\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def numbered(text: Column, pattern: str) -> tuple[Column, Column]:
    """The number that opens a title, by a pattern, and the title behind it; '' and the whole text without one."""
    text = F.coalesce(text, F.lit(""))
    number = F.regexp_extract(text, pattern, 1)
    return number, squashed(F.when(number == "", text).otherwise(F.regexp_extract(text, pattern, 2)))


def deduped(records: DataFrame) -> DataFrame:
    """One record of each reference and level, white space aside: the longest statement's, of equal ones the first; seq is the first one's of
    the key.  Records without a reference or a level go."""
    x = records.where("reference <> '' and level <> ''").withColumns({"of": squashed(F.col("reference")), "at": squashed(F.col("level"))})
    rest = [c for c in records.columns if c != "seq"]
    best = F.min(F.struct((-F.length(F.coalesce("statement", F.lit("")))).alias("less"), F.col("seq").alias("own"), *rest))
    return x.groupBy("of", "at").agg(F.min("seq").alias("seq"), best.alias("x")).select("seq", "of", "at", *(F.col(f"x.{c}") for c in rest))


def assembled(records: DataFrame) -> DataFrame:
    """A control of each reference of records (RECORD): control_id, title, family, family_abbr, objective_id, objective_title, objective_statement,
    factor_type, control_statement, baseline (its levels), requirements (requirement_id, level, level_kind, statement, the factors' lines and mappings: ids
    by source) and pos, its place by first record.

    Records are deduplicated; sources are learned from all their mapping lines; a level that was cut off has the longest level that it begins.  A control's
    head is its first record.  Requirements stand by maturity level first, then by name."""
    kept = deduped(records)
    levels = longest_names(kept.select(F.col("at").alias("name")).where("name <> ''").distinct()).select(F.col("name").alias("at"), F.col("longest").alias("label"))
    cells = kept.select("of", "at", F.posexplode(cell_lines(F.col("mapping"))).alias("pos", "line"))
    lines = cells.select("line").distinct()
    named = split_mappings(lines, learned_sources(lines)).where("id <> ''")
    ids = cells.join(named, "line").groupBy("of", "at", "source", "id").agg(F.min("pos").alias("pos"))
    by_source = ids.groupBy("of", "at", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    mappings = by_source.groupBy("of", "at").agg(F.map_from_entries(F.collect_list(F.struct("source", "ids"))).alias("mappings"))
    x = kept.join(levels, "at", "left").join(mappings, ["of", "at"], "left").withColumn("label", F.coalesce("label", "at"))
    (number, title), (category, family), (objective, aim) = numbered(F.col("reference"), REFERENCE), numbered(F.col("category"), CATEGORY), numbered(F.col("objective"), OBJECTIVE)
    x = x.withColumn("control_id", F.when(number == "", F.col("of")).otherwise(number))
    kind = F.when(F.col("label").rlike(MATURITY), "maturity").otherwise("overlay")
    empty = F.create_map().cast("map<string,array<string>>")
    requirement = F.struct(
        kind.alias("level_kind"), F.col("label").alias("level"), F.col("seq"), F.trim(F.concat_ws(" ", "control_id", "label")).alias("requirement_id"), squashed(F.col("statement")).alias("statement"),
        *(cell_lines(F.col(f"{f}_factors")).alias(f"{f}_factors") for f in ("organizational", "system", "regulatory")), F.coalesce("mappings", empty).alias("mappings"),
    )
    head = F.struct(
        "seq", title.alias("title"), F.nullif(family, F.lit("")).alias("family"), F.nullif(category, F.lit("")).alias("family_abbr"), objective.alias("objective_id"), aim.alias("objective_title"), squashed(F.col("objective_statement")).alias("objective_statement"),
        squashed(F.col("factor_type")).alias("factor_type"), squashed(F.col("specification")).alias("control_statement"),
    )
    before = lambda a, b: F.when(a["level_kind"] != b["level_kind"], F.when(a["level_kind"] == "maturity", -1).otherwise(1)).when(a["level"] != b["level"], F.when(a["level"] < b["level"], -1).otherwise(1)).otherwise(F.when(a["seq"] < b["seq"], -1).otherwise(1))
    out = x.select("control_id", head.alias("head"), requirement.alias("requirement")).groupBy("control_id").agg(F.min("head").alias("head"), F.array_sort(F.collect_list("requirement"), before).alias("requirements"))
    out = out.select("control_id", "head.*", F.array_join(F.transform("requirements", lambda r: r["level"]), ", ").alias("baseline"), F.transform("requirements", lambda r: r.dropFields("seq")).alias("requirements"))
    return out.withColumnRenamed("seq", "pos")
