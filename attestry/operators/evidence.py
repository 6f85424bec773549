"""Citations resolved against catalogs, and what documents can be shown against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import parent
from .documents import TAG, tags


def resolve_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """written and key of names (written): the catalog that a framework's name points at, null if none or several do.

    known (name, key) declares the catalogs.  A key or a declared name, in any case, stands for its catalog; else
    the beginning of exactly one key does, if it ends where no letter or digit follows.  Each key is exploded into
    such beginnings, so the names meet them by equality."""
    k = known.select(F.lower("name").alias("name"), F.lower("key").alias("key")).distinct()
    cut = F.filter(F.sequence(F.lit(1), F.length("key") - 1), lambda n: F.col("key").substr(n + 1, F.lit(1)).rlike(r"[^\p{L}\p{N}]"))
    short = k.where(F.length("key") > 1).select("key", F.explode(cut).alias("n")).select(F.expr("substring(key, 1, n)").alias("said"), "key", F.lit(2).alias("step"))
    exact = k.select(F.col("key").alias("said"), "key", F.lit(0).alias("step")).unionByName(k.select(F.col("name").alias("said"), "key", F.lit(1).alias("step")))
    found = exact.unionByName(short).groupBy("said", "step").agg(F.min("key").alias("key"), F.count_distinct("key").alias("n"))
    found = found.groupBy("said").agg(F.min_by(F.when(F.col("n") == 1, F.col("key")), "step").alias("key"))
    return names.select("written", F.lower(F.trim("written")).alias("said")).distinct().join(found, "said", "left").select("written", "key")


def split_citations(parts: DataFrame, known: DataFrame, ids: DataFrame) -> DataFrame:
    """seq, framework, key, id and qualifier of parts (seq, part), citations such as 'NAME 12.3 Low'; seq is unique.

    The framework is the longest declared name of known (name, key) that the part's words begin with, else its first
    word.  The id is then the longest run of words that ids (key, id) has under that framework, and the qualifier
    what follows.  A part whose id no catalog has keeps all its words as the id.  Runs of white space count as one space."""
    words = F.filter(F.split("part", r"\s+"), lambda w: w != "")
    p = parts.select("seq", words.alias("w"))
    run = lambda w, n: F.array_join(F.slice(w, 1, n), " ")
    heads = p.where(F.size("w") > 1).select("seq", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("n"))
    names = known.select(F.col("name").alias("declared"), F.lower("name").alias("head")).distinct()
    named = heads.select("seq", "n", F.lower(run("w", F.col("n"))).alias("head")).join(names, "head").groupBy("seq").agg(F.max(F.struct("n", "declared")).alias("best"))
    x = p.join(named, "seq", "left").withColumn("n", F.coalesce("best.n", F.lit(1)))
    x = x.select("seq", F.coalesce("best.declared", F.get("w", F.lit(0)), F.lit("")).alias("framework"), F.expr("slice(w, n + 1, greatest(size(w) - n, 0))").alias("rest"))
    x = x.join(resolve_names(x.select(F.col("framework").alias("written")), known).withColumnRenamed("written", "framework"), "framework", "left")
    runs = x.where("size(rest) > 0 and key is not null").select("seq", "key", "rest", F.explode(F.sequence(F.lit(1), F.size("rest"))).alias("n"))
    held = runs.select("seq", "key", "n", run("rest", F.col("n")).alias("id")).join(ids.select(F.lower("key").alias("key"), "id").distinct(), ["key", "id"], "left_semi").groupBy("seq").agg(F.max("n").alias("n"))
    x = x.join(held, "seq", "left")
    whole, qualifier = F.array_join("rest", " "), F.array_join(F.expr("slice(rest, n + 1, size(rest))"), " ")
    return x.select("seq", "framework", "key", F.when(F.col("n").isNull(), whole).otherwise(run("rest", F.col("n"))).alias("id"), F.when(F.col("n").isNull(), "").otherwise(qualifier).alias("qualifier"))


def document_citations(docs: DataFrame, known: DataFrame, ids: DataFrame) -> DataFrame:
    """doc, line, tag, pos, framework, key, id, qualifier and section of each citation in docs (id, body; ids unique).

    A tag's parts stand between bars. A part that begins with no declared name, and whose first word points at no catalog, is of the framework
    of the part before it. The section is the nearest heading above, or the heading that holds the tag, without its tags; '' above the first.

    What a tag cites is settled by its text, so each text is split once; only lines that are headings or hold tags are exchanged."""
    x = docs.select("id", F.posexplode(F.split("body", r"\r?\n")).alias("line", "text"))
    title = F.nullif(F.regexp_extract("text", r"^\s*#{1,6}\s+(.*?)\s*$", 1), F.lit(""))
    x = x.select("id", "line", F.trim(F.regexp_replace(title, TAG, "")).alias("title"), tags(F.col("text")).alias("tags")).where("title is not null or size(tags) > 0")
    above = F.last("title", True).over(Window.partitionBy("id").orderBy("line"))
    x = x.select("id", "line", F.coalesce(above, F.lit("")).alias("section"), "tags").select("id", "line", "section", F.posexplode("tags").alias("tag", "t"))
    split = split_tags(x.select("t").distinct(), known, ids)
    return x.join(split, "t").select(F.col("id").alias("doc"), (F.col("line") + 1).cast("long").alias("line"), F.col("tag").cast("long").alias("tag"), F.col("pos").cast("long").alias("pos"), "framework", "key", F.col("cited").alias("id"), "qualifier", "section")


def split_tags(distinct: DataFrame, known: DataFrame, ids: DataFrame) -> DataFrame:
    """t, pos, framework, key, cited and qualifier of the parts of distinct tags (t) that cite an id."""
    x = distinct.select("t", F.posexplode(F.split(F.regexp_replace("t", r"^\[|\]$", ""), r"\|")).alias("pos", "part"))
    x = x.select(F.struct("t", "pos").alias("seq"), F.filter(F.split("part", r"\s+"), lambda w: w != "").alias("w")).where("size(w) > 0")
    heads = x.where("size(w) > 1").select("seq", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda n: F.array_join(F.slice("w", 1, n), " "))).alias("said"))
    named = heads.withColumn("head", F.lower("said")).join(known.select(F.lower("name").alias("head")).distinct(), "head").groupBy("seq").agg(F.max_by("said", F.length("said")).alias("named"))
    first = F.get("w", F.lit(0))
    short = resolve_names(x.where("size(w) > 1").select(first.alias("written")), known).where("key is not null").select(F.col("written").alias("short"))
    x = x.join(named, "seq", "left").join(short, (first == F.col("short")) & (F.size("w") > 1), "left")
    own = F.coalesce("named", "short")
    before = F.last(own, True).over(Window.partitionBy("seq.t").orderBy("seq.pos"))
    x = x.select("seq", F.concat_ws(" ", F.when(own.isNull(), before), F.array_join("w", " ")).alias("part"))
    return split_citations(x, known, ids).where("id <> ''").select("seq.t", "seq.pos", "framework", "key", F.col("id").alias("cited"), "qualifier")


def document_evidence(citations: DataFrame, index: DataFrame, crosswalk: DataFrame, accepted: DataFrame, anchor: str, block: int = 4096, pieces: int = 256) -> DataFrame:
    """doc, framework, id, state, occurrences, via and provenance of citations (doc, framework, id).

    cited: the index (framework, id) has it.  unknown: it hasn't.  reached: not cited, but the crosswalk (anchor_id,
    framework, id) leads there from a cited id of the framework anchor, via the least such one; its provenance is
    that of accepted (framework, id, anchor_id, provenance), else published.

    What the same anchors lead to is one class. The least cited anchor is found for each document and class, with those of the class that the
    document cites itself; members then follow their class, so that what is reached, which may be documents times the crosswalk, is exchanged nowhere.

    There may be few classes: documents and members of a class are dealt into blocks of about block by a hash, and each meeting of two blocks into
    one of pieces partitions, or of spark.sql.shuffle.partitions if that is more. Members come as lists, which are read off for each document."""
    known = index.select("framework", "id").distinct().withColumn("known", F.lit(True))
    said = citations.groupBy("doc", "framework", "id").agg(F.count("*").alias("occurrences")).join(known, ["framework", "id"], "left")
    cited = said.where("known")
    none = F.lit(None).cast("string")
    own = said.select("doc", "framework", "id", F.when(F.col("known"), "cited").otherwise("unknown").alias("state"), "occurrences", none.alias("via"), none.alias("provenance"))
    members = crosswalk.where("framework is not null and id is not null").groupBy("framework", "id").agg(F.array_sort(F.collect_set("anchor_id")).alias("class"))
    from_ = cited.where(F.col("framework") == anchor).select("doc", F.col("id").alias("via"))
    least = members.select("class").distinct().select("class", F.explode("class").alias("via")).join(from_, "via").groupBy("doc", "class").agg(F.min("via").alias("via"))
    held = cited.select("doc", "framework", "id").join(members, ["framework", "id"]).groupBy("doc", "class").agg(F.collect_set(F.struct("framework", "id")).alias("held"))
    least = least.join(held, ["doc", "class"], "left")
    targets = members.withColumn("via", F.explode("class")).join(accepted.select("framework", "id", F.col("anchor_id").alias("via"), "provenance"), ["framework", "id", "via"], "left")
    reached = _met(least, targets.select("class", "via", "framework", "id", F.coalesce("provenance", F.lit("published")).alias("provenance")), block, pieces)
    reached = reached.where(F.col("held").isNull() | ~F.array_contains("held", F.struct("member.framework", "member.id")))
    return own.unionByName(reached.select("doc", "member.framework", "member.id", F.lit("reached").alias("state"), F.lit(0).cast("long").alias("occurrences"), "via", "member.provenance"))


def _met(least: DataFrame, targets: DataFrame, block: int, pieces: int) -> DataFrame:
    """doc, held, via and member, a struct, of least (class, via, doc, held) and targets (class, via, framework, id, provenance) of the same class and via."""
    keys = ["class", "via"]
    blocks = lambda rows, name: rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias(name))
    sizes = blocks(least, "nd").join(blocks(targets, "nm"), keys)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n))
    pieces = max(pieces, int(least.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    meeting = [*keys, "d", "m"]
    docs = least.join(sizes, keys).select(*keys, "doc", "held", dealt("nd", "doc").alias("d"), every("nm").alias("m"))
    members = targets.join(sizes, keys).select(*keys, "nd", dealt("nm", "framework", "id").alias("m"), F.struct("framework", "id", "provenance").alias("member"))
    members = members.groupBy(*keys, "nd", "m").agg(F.collect_list("member").alias("members")).select(*keys, "m", "members", every("nd").alias("d"))
    met = docs.repartition(pieces, *meeting).join(members.repartition(pieces, *meeting).hint("merge"), meeting)  # small lists aren't sent to the driver either
    return met.select("doc", "held", "via", F.explode("members").alias("member"))


def anchors_not_cited(documents: DataFrame, topics: DataFrame, cited: DataFrame) -> DataFrame:
    """doc, anchor and documents: the anchors of a document's topic that none of the topic's documents cites, and how many were searched.

    documents (doc, topic), topics (topic, anchor), cited (doc, id).  Citing a child cites its parent."""
    said = cited.select("doc", F.explode(F.array_compact(F.array(F.col("id"), parent(F.col("id"))))).alias("anchor")).distinct()
    answered = said.join(documents, "doc").select("topic", "anchor").distinct()
    searched = documents.groupBy("topic").agg(F.count("*").alias("documents"))
    gaps = topics.select("topic", "anchor").distinct().join(answered, ["topic", "anchor"], "left_anti").join(searched, "topic")
    return documents.join(gaps, "topic").select("doc", "anchor", "documents")
