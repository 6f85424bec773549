"""Topics that page titles and citations propose, and questions that lean on earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import identifiers, tokens

# The words of a title that name its tier, and those that carry no subject.
TIER_WORDS = {
    "policy": "policy", "policies": "policy", "standard": "standard", "standards": "standard", "procedure": "procedure", "procedures": "procedure",
    "sop": "procedure", "runbook": "procedure", "guideline": "standard", "guidelines": "standard",
}
NOISE_WORDS = "the a an and or of for to in on at is are our your their this that v1 v2 draft final wip copy new old".split()


def title_parts(title: Column) -> Column:
    """subject and tier of a title: the tier by its first tier word ('' without one), the subject without that word and the noise words, or the title if nothing is left."""
    words = F.regexp_extract_all(title, F.lit(r"([A-Za-z0-9&/']+)"), 1)
    tiers = F.create_map(*(F.lit(x) for kv in TIER_WORDS.items() for x in kv))
    first = F.array_position(F.transform(words, lambda w: F.lower(w).isin(list(TIER_WORDS))), F.lit(True))
    kept = F.filter(words, lambda w, i: (i + 1 != first) & ~F.lower(w).isin(NOISE_WORDS))
    subject = F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), F.trim(title))
    tier = F.when(first > 0, F.try_element_at(tiers, F.lower(F.get(words, (first - 1).cast("int"))))).otherwise("")
    return F.struct(F.when(F.size(words) > 0, subject).otherwise(F.trim(title)).alias("subject"), tier.alias("tier"))


def conventions(pages: DataFrame) -> DataFrame:
    """subject, pages and tiers (distinct, sorted, by commas) of the pages (title) whose titles name a tier; the others are left over."""
    x = pages.select(title_parts(F.col("title")).alias("t")).select("t.*").where("tier <> ''")
    return x.groupBy("subject").agg(F.count("*").alias("pages"), F.array_join(F.sort_array(F.collect_set("tier")), ",").alias("tiers"))


def anchor_counts(texts: DataFrame) -> DataFrame:
    """group, control and n: how many texts of texts (group, text) cite a control or an enhancement of it, each enhancement by itself."""
    x = texts.select("group", F.explode(identifiers(F.col("text"))).alias("id"))
    return x.select("group", F.regexp_extract("id", r"^([A-Z]{2}-[0-9]+)", 1).alias("control")).where("control <> ''").groupBy("group", "control").agg(F.count("*").alias("n"))


def carried_questions(turns: DataFrame) -> DataFrame:
    """conv, turn and resolved of turns (conv, turn, text): the question, and the one before it, as asked, where that has terms of its own."""
    before = F.lag("text").over(Window.partitionBy("conv").orderBy("turn"))
    x = turns.withColumn("before", before)
    bare = lambda c: F.trim(F.regexp_replace(c, r"\?+\z", ""))
    new = F.size(F.array_except(tokens(F.col("before")), tokens(F.col("text")))) > 0
    return x.select("conv", "turn", F.when(new, F.concat(bare("text"), F.lit(" \u2014 "), bare("before"))).otherwise(F.col("text")).alias("resolved"))
