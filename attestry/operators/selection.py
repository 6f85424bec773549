"""What belongs to a topic or a question, and what is refused: controls, candidates, proposals, catalogs, replies, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import tags
from .retrieval import bm25

# The skill that a question's wording names, first match first, and the one without a match.
ROUTES = {
    "coverage": ("orphan", "nobody own", "no one own", "no-one own", "unowned", "contested", "uncovered", "not covered", "who owns nothing"),
    "parameters": ("undecided", "organization-defined", "odp", "parameter"),
    "satisfies": ("resolve to nothing", "resolves to nothing", "resolving to nothing"),
    "drift": ("changed in the catalog", "catalog change", "catalog changed", "framework update", "framework changed", "new version", "version bump"),
    "check": ("broken link", "content tree", "dangling"),
    "frameworks": ("which frameworks", "catalog version", "licence", "license"),
    "hitrust": ("hitrust catalog", "csf catalog", "hitrust level", "csf level", "requirement statement", "control reference", "hitrust overlay", "hitrust map", "csf map"),
    "roles": ("what roles", "role keys", "which placeholders"),
}
NO_ROUTE = "documents"
# Relationships that a proposal may assert, the tiers that bind, and how a page names its macros and the one that survives an edit.
ASSERTABLE = ("equal", "subset", "superset", "intersects")
BINDING_TIERS = ("standard", "procedure")
MACRO = r'<ac:structured-macro\s+ac:name="([^"]+)"'
KEPT_MACROS = ("code",)


def topic_controls(topics: DataFrame, controls: DataFrame, edges: DataFrame, anchor_frameworks: list[str]) -> DataFrame:
    """(topic, framework, control, pos, step, seq): each topic's controls once, placed where they are first seen.

    topics (topic, pos, anchor) name ids of anchor_frameworks; edges (anchor_id, framework, requirement_id, seq) lead on to
    other frameworks' ids.  controls (framework, id, control): an id is a control's own or an enhancement's, which stands for
    its control; where one id is both, the control of that id is meant.  Order is by pos, anchors (step 0) before what is
    reached from them (step 1), then seq; step 0 has a null seq.  Ids that nothing carries give no row."""
    own = F.struct((F.col("id") != F.col("control")).alias("lesser"), F.col("control"))
    held = controls.groupBy("framework", "id").agg(F.min(own)["control"].alias("control"))
    kind = dict(edges.dtypes)["seq"]
    direct = topics.select("topic", "pos", F.col("anchor").alias("id"), F.explode(F.array(*map(F.lit, anchor_frameworks))).alias("framework"), F.lit(0).alias("step"), F.lit(None).cast(kind).alias("seq"))
    reached = topics.join(edges, F.col("anchor") == F.col("anchor_id")).select("topic", "pos", F.col("requirement_id").alias("id"), "framework", F.lit(1).alias("step"), "seq")
    x = direct.unionByName(reached).join(held, ["framework", "id"])
    return x.groupBy("topic", "framework", "control").agg(F.min(F.struct("pos", "step", "seq")).alias("first")).select("topic", "framework", "control", "first.*")


def candidates(entries: DataFrame, requirements: DataFrame, published: DataFrame, k: int = 15) -> DataFrame:
    """Distinct (query, id): the k entries (id, text) nearest in words to each requirement (query, text), the published pairs
    (query, id) that are entries, and the first control of each family that the words found."""
    found = bm25(entries, requirements, k, k1=1.4).select("query", "id")
    policy = found.select("query", F.concat(F.split_part("id", F.lit("-"), F.lit(1)), F.lit("-1")).alias("id")).distinct()
    known = policy.unionByName(published.select("query", "id")).join(entries.select("id").distinct(), "id", "left_semi")
    return found.unionByName(known.select("query", "id")).distinct()


def proposals(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """rows (requirement, pos, control, relationship, grounded) with state: kept, refused, or nameless where the control is no
    candidate (requirement, control) of the requirement.

    Kept is the first row by pos of each control that has an assertable relationship and grounded quotes; nulls are refused.
    The first is found by aggregation, so a control named many times is no group of one task."""
    named = candidates.select("requirement", "control", F.lit(True).alias("named")).distinct()
    x = rows.join(named, ["requirement", "control"], "left")
    valid = F.coalesce(F.col("named") & F.col("relationship").isin(*ASSERTABLE) & F.col("grounded"), F.lit(False))
    x = x.withColumn("valid", valid)
    first = x.where("valid").groupBy("requirement", "control").agg(F.min("pos").alias("first"))
    x = x.join(first, ["requirement", "control"], "left")
    state = F.when(F.col("named").isNull(), "nameless").when(F.col("valid") & (F.col("pos") == F.col("first")), "kept").otherwise("refused")
    return x.select("requirement", "pos", "control", state.alias("state"))


def declared_keys(declarations: DataFrame) -> DataFrame:
    """name, key and collides of declarations (name, key, ord): the key declared first for a name without regard to case and
    white space, and whether another one is declared too.  Empty keys declare nothing."""
    name = F.array_join(F.filter(F.split(F.lower("name"), r"\s+"), lambda w: w != ""), " ")
    x = declarations.where("key <> ''").select(name.alias("name"), "key", "ord")
    return x.groupBy("name").agg(F.min(F.struct("ord", "key"))["key"].alias("key"), (F.min("key") != F.max("key")).alias("collides"))


def catalog_states(catalogs: DataFrame, recorded: DataFrame) -> DataFrame:
    """id and state of catalogs (id, content) against recorded (id, digest): ok, mismatch or unrecorded; line ends count as LF."""
    digest = F.sha2(F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n")), 256)
    x = catalogs.select("id", digest.alias("found")).join(recorded.select("id", "digest"), "id", "left")
    return x.select("id", F.when(F.col("digest").isNull(), "unrecorded").when(F.col("digest") == F.col("found"), "ok").otherwise("mismatch").alias("state"))


def route(question: Column) -> Column:
    """The skill whose hint the question holds."""
    asked, out = F.lower(question), F.lit(NO_ROUTE)
    for name, hints in reversed(ROUTES.items()):
        held = asked.contains(hints[0])
        for hint in hints[1:]:
            held = held | asked.contains(hint)
        out = F.when(held, name).otherwise(out)
    return out


def expansion_terms(reply: Column, most: int = 12) -> Column:
    """The terms of a reply by commas and lines, the first of those equal but for case, at most `most`; none of a reply half of
    whose parts or more exceed four words, else those parts are left out."""
    bare = lambda s, marks: F.regexp_replace(s, f"^{marks}+|{marks}+$", "")
    words = lambda s: F.size(F.split(s, r"\s+"))
    space = r"[\s]"
    parts = F.transform(F.split(reply, "[,\n]"), lambda s: bare(bare(bare(bare(bare(s, space), "[-*•]"), space), '"'), space))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  (else each use, also for each element, evaluates the value again)

    def first(short, low):
        return F.transform(F.slice(F.array_distinct(low), 1, most), lambda w: F.get(short, F.array_position(low, w).cast("int") - 1))

    def of(kept, short):
        terms = once(F.transform(short, F.lower), lambda low: first(short, low))
        return F.when((F.size(kept) - F.size(short)) * 2 >= F.size(kept), F.array().cast("array<string>")).otherwise(terms)

    return once(F.filter(parts, lambda s: s != ""), lambda kept: once(F.filter(kept, lambda s: words(s) <= 4), lambda short: of(kept, short)))


def packed(text: Column, most: int = 1500) -> Column:
    """The pieces of a text: paragraphs (between blank lines) put together until one more would pass `most` characters; a
    longer paragraph stays whole.  A text of `most` or fewer characters is one piece."""
    paragraphs = F.split(text, "\n\n")
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("size"), F.lit(0).alias("i"))

    def add(s, p):
        full = (s["size"] > 0) & (s["size"] + F.length(p) > most)
        ends = F.when(full, F.concat(s["ends"], F.array(s["i"]))).otherwise(s["ends"])
        size = F.when(full, F.lit(0)).otherwise(s["size"]) + F.length(p) + 2
        return F.struct(ends.alias("ends"), size.alias("size"), (s["i"] + 1).alias("i"))

    ends = F.aggregate(paragraphs, start, add, lambda s: F.concat(F.array(F.lit(0)), s["ends"], F.array(s["i"])))
    piece = lambda a, b: F.array_join(F.slice(paragraphs, a + 1, b - a), "\n\n")
    pairs = F.zip_with(F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1), piece)
    return F.when(F.length(text) <= most, F.array(text)).otherwise(pairs)


def lost_citations(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """id, n and missing (sorted) of docs (id, tags) that lack tags of their source (id, tags); docs without a source have none."""
    gone = F.array_sort(F.array_except(F.col("s.tags"), F.coalesce(F.col("d.tags"), F.array().cast("array<string>"))))
    x = docs.alias("d").join(sources.alias("s"), F.col("d.id") == F.col("s.id")).select("d.id", gone.alias("missing"))
    return x.where(F.size("missing") > 0).select("id", F.size("missing").alias("n"), "missing")


def uncited(docs: DataFrame) -> DataFrame:
    """id and tier of docs (id, tier, body) of a binding tier without a source tag."""
    return docs.where(F.col("tier").isin(*BINDING_TIERS) & (F.size(tags(F.coalesce("body", F.lit("")))) == 0)).select("id", "tier")


def unsupported_macros(pages: DataFrame) -> DataFrame:
    """id and macros (distinct, sorted, by commas) of pages (id, html) with macros that an edit would lose."""
    found = F.array_except(F.array_distinct(F.regexp_extract_all("html", F.lit(MACRO), 1)), F.array(*map(F.lit, KEPT_MACROS)))
    return pages.select("id", F.array_join(F.array_sort(found), ",").alias("macros")).where("macros <> ''")


def binding_shares(statements: DataFrame) -> DataFrame:
    """id, binding and modal of statements (id, modality): those that oblige or forbid, and those with any modality."""
    return statements.groupBy("id").agg(F.count_if(F.col("modality").isin("obligation", "prohibition")).alias("binding"), F.count_if(F.col("modality") != "none").alias("modal"))
