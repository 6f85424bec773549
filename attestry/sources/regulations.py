"""Regulations in the XML of the federal code: flat paragraphs whose places in the text's hierarchy follow from their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Sections and paragraphs, paragraphs that go on behind a dash, citations at their head, and how specifications are marked.
SECTION = r'(?s)<DIV8 N="([^"]*)"[^>]*>\s*<HEAD>(.*?)</HEAD>(.*?)</DIV8>'
DIVISION = r'<DIV8 N="([^"]*)"'
PARAGRAPH = r"(?s)<P>(.*?)</P>"
RUN_IN = r"&#x2014;(?=\([a-zA-Z0-9]+\))"
LEADING = r"^((?:\([a-zA-Z0-9]+\))+)\s*"
TOKEN = r"\(([a-zA-Z0-9]+)\)"
ITALIC = r"(?s)^<I>(.*?)</I>\s*(.*)$"
MARKED = r"\((Required|Addressable)\)"
LABELS = ("Implementation specifications", "Implementation specification")
ROMAN = "^(i|ii|iii|iv|v|vi|vii|viii|ix|x)$"
RESERVED = r"(?i)^\([a-z0-9ivx]{1,4}\)\s*\[reserved\]\.?$"
ENTITIES = {"&#xA7;": "§", "&#x2014;": "—", "&#x201C;": "“", "&#x201D;": "”", "&quot;": '"', "&amp;": "&"}
SECURITY_SECTION = r"^164\.\d+$"
CITED = r"\b(164\.\d+)\b"

_ENHANCEMENT = "array<struct<enhancement_id:string,title:string,baseline:string,description:string>>"


def plain(xml: Column, between: str = "") -> Column:
    """Text without tags, with characters for entities and single spaces; between stands for each tag."""
    text = F.regexp_replace(xml, "<[^>]+>", between)
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sections(spark: SparkSession, path: str, numbers: str) -> DataFrame:
    """path, section, head and paragraphs (XML) of the sections in files of XML, each read whole; raises ValueError if a section's number isn't one of numbers, a
    pattern, or a section can't be read."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    parts = F.arrays_zip(*(F.regexp_extract_all("xml", F.lit(SECTION), k).alias(f"x{k}") for k in (1, 2, 3)))
    found = d.select("path", F.explode(parts).alias("x")).select("path", F.col("x.x1").alias("section"), F.col("x.x2").alias("head"), F.regexp_extract_all("x.x3", F.lit(PARAGRAPH), 1).alias("paragraphs"))
    declared = d.select("path", F.explode(F.regexp_extract_all("xml", F.lit(DIVISION), 1)).alias("section")).where("section <> ''")
    missed = sorted(r.section for r in declared.join(found.where(F.col("section").rlike(numbers)), ["path", "section"], "left_anti").limit(12).collect())
    if missed or found.isEmpty():
        raise ValueError(f"sections that the document has and that can't be read: {', '.join(missed) or 'all'}")
    return found


def citations(pieces: Column, section: Column) -> Column:
    """The full citation at each of an array of paragraphs that begin with parts of one, in their order.

    A number stands second, a capital fourth.  A small letter that may be a Roman numeral stands third below a number that is open, else, as others
    do, first."""

    def depth(path: Column, token: Column) -> Column:
        roman = (F.size(path) >= 2) & token.rlike(ROMAN)
        return F.when(token.rlike("^[0-9]+$"), 2).when(token.rlike("^[A-Z0-9]*[A-Z][A-Z0-9]*$"), 4).when(roman, 3).otherwise(1)

    def at(path: Column, token: Column) -> Column:
        return F.concat(F.slice(path, F.lit(1), depth(path, token) - 1), F.array(token))

    def step(state: Column, piece: Column) -> Column:
        tokens = F.regexp_extract_all(F.regexp_extract(piece, LEADING, 1), F.lit(TOKEN), 1)
        path = F.aggregate(tokens, state["path"], at)
        return F.struct(path.alias("path"), F.concat(state["out"], F.array(F.concat(section, F.array_join(F.transform(path, lambda t: F.concat(F.lit("("), t, F.lit(")"))), "")))).alias("out"))

    none = F.array().cast("array<string>")
    return F.aggregate(pieces, F.struct(none.alias("path"), none.alias("out")), step, lambda s: s["out"])


def security_rule(spark: SparkSession, path: str) -> DataFrame:
    """path, control_id, title, control_statement, related_controls and enhancements of a rule whose named paragraphs are standards, or specifications that are marked as
    required or addressable.

    A specification belongs to the standard before it.  Paragraphs without a name go to what was named last; those before any name are lead-ins: the
    sections that they cite are related to the standards below their citation, and one that relates nothing raises ValueError.  Specifications without a text, definitions and bare labels
    are left out."""
    s = sections(spark, path, SECURITY_SECTION).where(F.lower(_title("head")) != "definitions")
    pieces = F.flatten(F.transform("paragraphs", lambda p: F.split(p, RUN_IN)))
    s = s.withColumn("pieces", pieces)
    x = s.select("path", "section", F.posexplode(F.arrays_zip("pieces", citations(F.col("pieces"), F.col("section")).alias("at"))).alias("pos", "x")).select("path", "section", "pos", F.col("x.at").alias("citation"), F.regexp_replace("x.pieces", LEADING, "").alias("raw"))
    raw = F.trim("raw")
    named = raw.rlike(ITALIC)
    x = x.withColumns({"name": F.when(named, plain(F.regexp_extract(raw, ITALIC, 1))), "said": F.when(named, plain(F.regexp_extract(raw, ITALIC, 2))).otherwise(plain(F.col("raw")))})
    kind = F.when(F.col("name").isNull(), "text").when(F.rtrim(F.regexp_replace("name", ":+$", "")).isin(*LABELS), "label").when(F.col("name").rlike(MARKED), "specification").otherwise("standard")
    x = x.withColumn("kind", kind).where("kind <> 'label' and not (kind = 'text' and said = '')")
    order = Window.partitionBy("path", "section").orderBy("pos")  # one section's paragraphs
    x = x.withColumn("item", F.max(F.when(F.col("kind") == "standard", F.col("pos"))).over(order))
    leads = x.where("item is null and kind = 'text'").select("path", "section", "citation", "said", F.array_distinct(F.regexp_extract_all("said", F.lit(CITED), 1)).alias("cited"))
    leads = leads.where((F.size("cited") > 0) | F.col("said").contains("§"))
    x = x.where("item is not null").withColumn("part", F.max(F.when(F.col("kind") == "specification", F.col("pos"))).over(Window.partitionBy("path", "section", "item").orderBy("pos")))
    text = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda p: p["said"]), lambda p: p != ""), " ")
    first = lambda c: F.min_by(c, "pos").alias(c)
    y = x.groupBy("path", "section", "item", "part").agg(text.alias("text"), first("citation"), first("name"))
    bare = lambda c: F.btrim(c, F.lit(" :."))
    spec = F.struct("part", F.col("citation").alias("enhancement_id"), bare(F.regexp_replace("name", rf"{MARKED}(?s:.*)$", "")).alias("title"), F.regexp_extract("name", MARKED, 1).alias("baseline"), F.col("text").alias("description"))
    below = y.where("part is not null and text <> ''").groupBy("path", "section", "item").agg(F.transform(F.array_sort(F.collect_list(spec)), lambda e: e.dropFields("part")).alias("enhancements"))
    title = F.trim(F.regexp_replace(bare(F.col("name")), "(?i)^standard:", ""))
    heads = y.where("part is null").select("path", "section", "item", F.col("citation").alias("control_id"), title.alias("title"), F.col("text").alias("control_statement"))
    under = (F.col("control_id") == F.col("citation")) | F.col("control_id").startswith(F.concat(F.col("citation"), F.lit("(")))
    framed = leads.join(heads.select("path", "section", "item", "control_id"), ["path", "section"]).where(under)
    lost = leads.where(F.size("cited") == 0).unionByName(leads.join(framed.select("path", "section", "citation").distinct(), ["path", "section", "citation"], "left_anti").select(*leads.columns))
    if bad := lost.select("citation", "said").first():
        raise ValueError(f"the lead-in at {bad.citation} ({bad.said[:80]!r}) relates no standard to a section that can be read")
    related = framed.select("path", "section", "item", F.explode("cited").alias("cited")).groupBy("path", "section", "item").agg(F.array_sort(F.collect_set("cited")).alias("related_controls"))
    out = heads.join(below, ["path", "section", "item"], "left").join(related, ["path", "section", "item"], "left")
    return out.select(
        "path", "section", F.col("item").alias("pos"), "control_id", "title", "control_statement", F.coalesce("related_controls", F.array().cast("array<string>")).alias("related_controls"),
        F.coalesce("enhancements", F.array().cast(_ENHANCEMENT)).alias("enhancements"),
    )


def lettered(paragraphs: Column) -> Column:
    """owner, opens and text of each of an array of plain paragraphs: the letter that it belongs to, null before (a), and whether it opens it.

    Letters follow each other from (a); other ones are numerals.  One that is a Roman numeral too opens nothing while a list of numbers is open.  Reserved
    paragraphs are left out."""
    out = F.array().cast("array<struct<owner:string,opens:boolean,text:string>>")
    start = F.struct(F.lit(None).cast("string").alias("owner"), F.lit(False).alias("listed"), out.alias("out"))

    def step(state: Column, text: Column) -> Column:
        letter = F.regexp_extract(text, r"^\(([a-z])\)", 1)
        next_ = F.when(state["owner"].isNull(), "a").otherwise(F.char(F.ascii(state["owner"]) + 1))
        opens = (letter != "") & (letter == next_) & ~(state["listed"] & letter.isin("i", "v", "x"))
        owner = F.when(opens, letter).otherwise(state["owner"])
        body = F.when(opens, F.regexp_replace(text, r"^\([a-z]\)\s*", "")).otherwise(text)
        row = F.struct(owner.alias("owner"), opens.alias("opens"), body.alias("text"))
        listed = F.when(opens, F.lit(False)).otherwise(state["listed"] | text.rlike(r"^\(\d+\)"))
        return F.struct(owner.alias("owner"), listed.alias("listed"), F.concat(state["out"], F.array(row)).alias("out"))

    return F.aggregate(F.filter(paragraphs, lambda t: (t != "") & ~t.rlike(RESERVED)), start, step, lambda s: s["out"])


def lettered_rule(spark: SparkSession, path: str, numbers: str, controls: list[str]) -> DataFrame:
    """path, control_id, title, control_statement and enhancements of the sections that are controls: each lettered paragraph is a requirement with all below it, what
    stands before the first is the statement, an italic name at a paragraph's head its title.

    Raises ValueError where a section of the document can't be read, a control is missing, or two requirements would have one citation."""
    s = sections(spark, path, numbers)
    missing = sorted(set(controls) - {r.section for r in s.where(F.col("section").isin(controls)).select("section").distinct().collect()})
    if missing:
        raise ValueError(f"controls that the document doesn't have: {', '.join(missing)}")
    s = s.where(F.col("section").isin(controls))
    names = F.transform("paragraphs", lambda p: plain(F.regexp_extract(p, r"(?s)<I>(.*?)</I>", 1), " "))
    held = F.transform("paragraphs", lambda p: plain(p, " "))
    # A name goes with its paragraph: the text is looked up again, as paragraphs may be left out.
    x = s.select("path", "section", "head", F.posexplode(lettered(held)).alias("pos", "x"), F.arrays_zip(held.alias("text"), names.alias("name")).alias("named"))
    own = F.get(F.filter("named", lambda n: F.regexp_replace(n["text"], r"^\([a-z]\)\s*", "") == F.col("x.text")), F.lit(0))["name"]
    name = F.regexp_replace(F.coalesce(own, F.lit("")), r"\.+$", "")
    x = x.select("path", "section", "head", "pos", "x.*", name.alias("name"))
    named = F.col("opens") & (F.col("name") != "") & F.startswith(F.col("text"), F.col("name"))
    x = x.withColumn("text", F.when(named, F.regexp_replace(F.substr("text", F.length("name") + 1), r"^[ .]+", "")).otherwise(F.col("text")))
    text = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), lambda p: p != ""), " ")
    y = x.groupBy("path", "section", "head", "owner").agg(text.alias("text"), F.count_if("opens").alias("opened"), F.min("pos").alias("pos"), F.max(F.when(F.col("opens"), F.col("name"))).alias("name"))
    if twice := y.where("opened > 1").select("section", "owner").first():
        raise ValueError(f"two requirements would be {twice.section}({twice.owner})")
    requirement = F.struct("pos", F.concat("section", F.lit("("), "owner", F.lit(")")).alias("enhancement_id"), F.col("name").alias("title"), F.lit("").alias("baseline"), F.col("text").alias("description"))
    z = y.groupBy("path", "section", "head").agg(F.coalesce(F.max(F.when(F.col("owner").isNull(), F.col("text"))), F.lit("")).alias("control_statement"), F.transform(F.array_sort(F.collect_list(F.when(F.col("owner").isNotNull(), requirement))), lambda e: e.dropFields("pos")).alias("enhancements"))
    title = F.trim(F.regexp_replace(plain(F.col("head"), " "), r"^[§\s]*\S+\s*", ""))
    return z.select("path", F.col("section").alias("control_id"), title.alias("title"), "control_statement", "enhancements")


def _title(head: str) -> Column:
    """A heading without its section mark and number."""
    return F.regexp_replace(F.regexp_replace(plain(F.col(head)), r"^\S+\s+\S+\s+", ""), r"\.+$", "")
