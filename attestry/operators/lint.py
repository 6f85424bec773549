"""Findings about documents and their links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def double_claims(docs: DataFrame) -> DataFrame:
    """Documents that claim a place and title that an earlier one has: id, kept (the first one's id)."""
    w = Window.partitionBy("kind", F.lower("place"), F.lower("title")).orderBy("id")
    return docs.withColumn("kept", F.first("id").over(w)).where("id <> kept").select("id", "kept")


def dangling(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links whose target names no known document."""
    return links.join(targets.select("target").distinct(), "target", "left_anti")


def missing_fields(docs: DataFrame, fields: list[str]) -> DataFrame:
    """id and field for each field that a publishable document lacks."""
    lacks = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields)))
    return docs.select("id", F.explode(lacks).alias("field"))


def unanchored(statements: DataFrame) -> DataFrame:
    """Binding statements without a citation in sections where others have one."""
    cites = F.max(F.col("cited").cast("int")).over(Window.partitionBy("doc", "section"))
    return statements.withColumn("section_cites", cites).where("binding and not cited and section_cites = 1").select("doc", "section", "line")


def premises(claims: DataFrame, bullets: DataFrame) -> DataFrame:
    """Distinct (claim, bullet) that share a tag."""
    return claims.select("claim", F.explode("tags").alias("tag")).join(bullets.select("bullet", F.explode("tags").alias("tag")), "tag").select("claim", "bullet").distinct()


def rule_hits(texts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """id, rule and the number of lines that match it; rules are (name, pattern) and tested in one pass over the lines."""
    lines = texts.select("id", F.explode(F.split("text", "\n")).alias("line"))
    hit = F.array_compact(F.array(*(F.when(F.lower("line").rlike(p), F.lit(n)) for n, p in rules)))
    return lines.select("id", F.explode(hit).alias("rule")).groupBy("id", "rule").agg(F.count("*").alias("lines"))


# What addresses the reader of a text rather than its organisation, by rule. The letters that a match can begin with are
# looked at first, as a word's border by Unicode's letters costs far more at each place of a text.
INJECTION_RULES = [
    ("countermands earlier instructions", r"(?imdU)(?=[idfobs])\b(?:ignore|disregard|forget|override|bypass|skip)\b[^.!?\n]{0,40}?\b(?:instruction|instructions|rule|rules|prompt|prompts|directive|directives|guideline|guidelines|constraint|constraints|everything above|all of the above|the above|prior|previous|preceding)\b"),
    ("refers to the prompt or the model's own rules", r"(?imdU)(?=[yti])\b(?:your\s+(?:system\s+)?(?:prompt|instructions|directives|persona)|(?:the|this|its)\s+system\s+prompt)\b"),
    ("reassigns the reader's role", r"(?imdU)(?=[yfaprb])\b(?:you\s+are\s+(?:now|actually|really)|from\s+now\s+on|act\s+as\s+(?:a|an|the)\b|pretend\s+(?:to\s+be|that\s+you|you)|roleplay|role-play|behave\s+as\s+(?:a|an|if))\b"),
    ("dictates what the reader should output", r"(?imdU)(?=[raopswy])(?:^|(?<=[.!?]\s)|(?<=[.!?]\n)|\bplease\s+|\byou\s+(?:must|should|will)\s+)(?:reply|respond|answer|output|print|return|state|say|write|report)\s+(?:with|only|exactly|that|the\s+following|as\s+follows)\b"),
    ("addresses the reader as a model or assistant", r"(?imdU)(?=[yad])\b(?:you\s+are\s+(?:an?\s+)?(?:helpful\s+|honest\s+)*(?:ai|a\.i\.|language\s+model|llm|chatbot|chat\s+bot|assistant|copilot)|as\s+an?\s+(?:ai|language\s+model|llm|chatbot|assistant)\s*,\s*you|dear\s+(?:ai|assistant|model|chatbot))\b"),
    ("asks for citations or grounding to be dropped", r"(?imdU)(?=[dnsyp])(?:^|(?<=[.!?:;]\s)|(?<=\n)|\byou\s+|\bplease\s+)(?:do\s+not|don't|never|no\s+need\s+to|stop)\s+(?:\w+\s+){0,2}(?:cite|citing|citation|citations|quote|quoting)\b"),
    ("claims to speak for the operator", r"(?imdU)^[ \t>*_-]*(?:revised|updated|new|additional|amended|replacement)\s+(?:operator\s+)?instructions?\s*:"),
    ("contains the refusal sentinel", r"(?dU)(?=I)\bINSUFFICIENT_CONTEXT\b"),
    ("imitates this system's fence markers", r"(?dU)(?=[BE])\b(?:BEGIN|END)\s+pf-[0-9A-Za-z]+\b"),
]


def injections(texts: DataFrame, rules: list[tuple[str, str]] = INJECTION_RULES, longest: int = 90) -> DataFrame:
    """id, kind, line and excerpt of every stretch of texts (id, text) that a rule matches; of rules with the same span the first counts.

    Each rule marks its matches in the whole text, which is then cut at the marks; lines count from 1.  Marks that a
    text has of its own read as U+FFFD.  Excerpts are one line of at most the longest number of characters."""
    opened, closed = "\u0001", "\u0002"
    clean = texts.select("id", F.translate("text", opened + closed, "\ufffd\ufffd").alias("text"))
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(i).alias("ord"), F.lit(k).alias("kind"), F.regexp_replace("text", p, f"{opened}$0{closed}").alias("marked"))) for i, (k, p) in enumerate(rules))))
    x = clean.select("id", F.explode(hit).alias("h")).select("id", "h.ord", "h.kind", F.split("h.marked", opened).alias("parts"))
    x = x.select("id", "ord", "kind", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n"))
    before = F.translate(F.array_join(F.slice("parts", 1, F.col("n")), ""), closed, "")
    found = F.substring_index(F.get("parts", F.col("n")), closed, 1)
    x = x.select("id", "ord", "kind", F.length(before).alias("start"), (F.length(before) - F.length(F.translate(before, "\n", "")) + 1).alias("line"), found.alias("found"))
    x = x.groupBy("id", "start", "found").agg(F.min_by(F.struct("kind", "line"), "ord").alias("x"))
    words = F.trim(F.regexp_replace("found", r"(?U)\s+", " "))
    return x.select("id", "x.kind", "x.line", F.when(F.length(words) <= longest, words).otherwise(F.concat(F.substring(words, 1, longest - 1), F.lit("\u2026"))).alias("excerpt"))


def all_findings(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def section_changes(before: DataFrame, after: DataFrame, planned: DataFrame) -> DataFrame:
    """heading and what an edit did to it: removed, added, or changed though it wasn't planned."""
    b = before.select(F.col("heading").alias("h"), F.col("body").alias("old"))
    x = after.join(b, F.col("heading") == F.col("h"), "full_outer").join(planned.select("heading").distinct().withColumn("p", F.lit(True)), "heading", "left")
    what = F.when(F.col("h").isNull(), "added").when(F.col("heading").isNull(), "removed").when((F.col("body") != F.col("old")) & F.col("p").isNull(), "unplanned")
    return x.select(F.coalesce("heading", "h").alias("heading"), what.alias("what")).where("what is not null")


def tier_gaps(rows: DataFrame, tiers: list[str]) -> DataFrame:
    """id, marked and missing tiers of rows marked at a tier but not at every stricter one; tiers are boolean columns, mildest first, null is no mark."""
    named = F.array(*(F.struct(F.lit(t).alias("tier"), F.coalesce(F.col(t), F.lit(False)).alias("on")) for t in tiers))
    above = F.filter("named", lambda x: ~x.on & F.exists(F.slice("named", 1, F.array_position(F.transform("named", lambda y: y.tier), x.tier).cast("int")), lambda y: y.on))
    names = lambda c: F.array_join(F.transform(c, lambda x: x.tier), ", ")
    return rows.withColumn("named", named).select("id", names(F.filter("named", lambda x: x.on)).alias("marked"), names(above).alias("missing")).where("missing <> ''")
