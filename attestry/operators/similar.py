"""What resembles what: names close to a known one, and lines that a version adds to the one before."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how alike a misspelling and its name are.
ALIKE = 0.8


def name_key(name: Column) -> Column:
    """A name as it is read: without regard to case and white space."""
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def resembles(wanted: str, key: str, alike: float = ALIKE) -> bool:
    """Whether two names are alike by their matching blocks, or all words of the first are words of the second."""
    return SequenceMatcher(None, wanted, key).ratio() >= alike or set(wanted.split()) <= set(key.split())


def misspelled(overlays: DataFrame, catalogs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Distinct name and framework: overlays (name, id) that no catalog (framework, id, anchor) is called like, and catalogs that they seem to mean.

    Names are meant that are alike and share an id; a catalog that anchors the mappings is never meant.  A name that is a framework's, case and white
    space aside, is right.  Pairs meet on ids.  Two bounds on what two names can have in common, by lengths and by letters, leave out pairs that can't
    be alike, so each other pair's matching blocks are found once."""
    known = catalogs.select(name_key(F.col("framework")).alias("key")).distinct()
    wrong = overlays.select("name", "id").distinct().withColumn("key", name_key(F.col("name"))).join(known, "key", "left_anti")
    owners = catalogs.where("not anchor").select("framework", "id").distinct()
    pairs = wrong.join(owners, "id").select("name", F.col("key").alias("wanted"), "framework").distinct().withColumn("key", name_key(F.col("framework")))
    a, b = F.length("wanted"), F.length("key")
    letters = lambda c: F.split(c, "")
    shared = F.aggregate(F.array_distinct(letters("wanted")), F.lit(0), lambda n, x: n + F.least(a - F.length(F.replace(F.col("wanted"), x, F.lit(""))), b - F.length(F.replace(F.col("key"), x, F.lit("")))))
    inside = F.size(F.array_except(F.filter(F.split("wanted", " "), lambda w: w != ""), F.split("key", " "))) == 0
    pairs = pairs.where(inside | ((2.0 * F.least(a, b) >= alike * (a + b)) & (2.0 * shared >= alike * (a + b))))

    def compared(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)
            yield batch.select(["name", "framework"]).filter(pa.array([resembles(w, k, alike) for w, k in rows], pa.bool_()))

    return pairs.mapInArrow(compared, "name string, framework string")


def line_counts(before: str, after: str) -> tuple[int, int]:
    """How many lines a unified diff marks as added and as removed; lines that such a diff would print like a file's head aren't counted."""
    old, new = before.splitlines(keepends=True), after.splitlines(keepends=True)
    added = removed = 0
    for what, i, j, k, n in SequenceMatcher(None, old, new).get_opcodes():
        if what != "equal":
            removed += sum(not x.startswith("--") for x in old[i:j])
            added += sum(not x.startswith("++") for x in new[k:n])
    return added, removed


def line_changes(history: DataFrame) -> DataFrame:
    """slug, ord, version (from 1), added and removed lines of the rows of history (slug, ord, content) that differ from the one before; the first adds all its lines."""
    w = Window.partitionBy("slug").orderBy("ord")
    new = history.withColumn("last", F.lag("content").over(w)).where("last is null or content <> last")
    new = new.select("slug", "ord", F.row_number().over(w).cast("int").alias("version"), F.coalesce("last", F.lit("")).alias("last"), F.coalesce("content", F.lit("")).alias("content"))
    kinds = dict(new.dtypes)

    def counted(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            found = [line_counts(a.as_py(), b.as_py()) for a, b in zip(batch.column(3), batch.column(4), strict=True)]
            counts = [pa.array([x[k] for x in found], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *counts], ["slug", "ord", "version", "added", "removed"])

    return new.mapInArrow(counted, f"slug {kinds['slug']}, ord {kinds['ord']}, version int, added int, removed int")
