"""Shards of near-equal bytes by histogram sort, with DataFrame functions only.

Rows are ordered by a 63-bit key: 40 bits of the text's hash, so that equal texts stand together,
then 23 bits of the hash of the id and of a number that parts rows of one id and text, so that a large group
of equal texts can be cut.  Splitters are
found without sorting: each pass counts the exact bytes in the cells between candidate keys and
narrows the interval of every splitter that is out of tolerance.  Cells end between groups of
equal texts unless a single group is too large for the tolerance.  Then rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import each_copy, fresh, stored

GROUP_BITS = 23
CELLS = 256  # of an interval in each pass; at most CELLS * shards sums reach the driver
BUCKET_ROWS = 2000  # rows that are numbered together


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def group_key(text: Column) -> Column:
    """The part of the sort key that equal texts share."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 24), GROUP_BITS)


def sort_key(group: Column, doc_id: Column, copy: Column) -> Column:
    return group.bitwiseOR(F.xxhash64(doc_id, copy).bitwiseAND((1 << GROUP_BITS) - 1))


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001) -> list[int]:
    """shards - 1 keys of rows (key, size); what lies below the k-th is k / shards of all bytes, off by at most
    tolerance of a shard unless fewer rows than that share a key."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    unit = 1 << GROUP_BITS
    found = {k: 0 for k in range(1, shards)} if not total else {}
    open_ = {k: (0, 1 << 63, 0) for k in range(1, shards) if k not in found}  # interval, bytes below it
    while open_:
        spans = sorted(set(open_.values()))
        widths = []
        for lo, hi, _ in spans:
            width = -(-(hi - lo) // CELLS)
            widths.append(-(-width // unit) * unit if hi - lo > unit else max(1, width))
        cell = F.lit(None).cast("struct<span:int,cell:long>")
        for k, ((lo, hi, _), width) in enumerate(zip(spans, widths, strict=True)):
            inside = (F.col("key") >= lo) & (F.col("key") <= hi - 1)
            at = F.floor((F.col("key") - F.lit(lo)) / F.lit(width)) if width == 1 else F.expr(f"(key - {lo}L) div {width}L")
            cell = F.when(inside, F.struct(F.lit(k).alias("span"), at.cast("long").alias("cell"))).otherwise(cell)
        sums = rows.select(cell.alias("c"), "size").where("c is not null").groupBy("c.span", "c.cell").agg(F.sum("size").alias("size")).collect()
        for k, (lo, hi, below) in list(open_.items()):
            span = spans.index((lo, hi, below))
            width = widths[span]
            own = {r.cell: r.size for r in sums if r.span == span}
            want, at, edge = total * k / shards, below, lo
            for c in range(-(-(hi - lo) // width)):
                if at + own.get(c, 0) > want:
                    break
                at += own.get(c, 0)
                edge = lo + (c + 1) * width
            edge = min(edge, hi)
            size = own.get((edge - lo) // width, 0)
            after = min(edge + width, hi)
            low, high = want - at, at + size - want
            if min(low, high) <= allowed or width == 1:
                found[k] = edge if low <= high else after
                del open_[k]
            else:
                open_[k] = (edge, after, at)
    return [found[k] for k in range(1, shards)]


def shard_of(key: Column, bounds: list[int]) -> Column:
    return sum(((key >= F.lit(min(b, (1 << 63) - 1))).cast("int") for b in bounds), F.lit(0))


def sharded_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """documents with a further column attestry_shard, or with underscores added where they have that one: rows of shards of near-equal UTF-8 bytes.

    Equal rows are parted by their numbers in a stored copy, so which of them goes where is open."""
    name = fresh(documents, "attestry_shard")
    held = stored(documents.select(F.struct("*").alias("all"), F.monotonically_increasing_id().alias("row")), "held")
    text, doc_id = F.col("all.text").cast("string"), F.col("all.doc_id").cast("long")
    key = sort_key(group_key(text), doc_id, F.col("row"))
    bounds = splitters(stored(held.select(key.alias("key"), byte_size(text).alias("size")), "sizes"), shards)
    return held.select("all", shard_of(key, bounds).alias("shard")).select("all.*", F.col("shard").alias(name))


def shard_table(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row.

    size is the UTF-8 bytes of the text and 1; a null text has none.  Shards have near-equal sums of
    sizes, equal texts share a shard unless a splitter has to cut their group, and slots count from
    0 without gaps.  Rows are placed one by one, so repeated rows have places of their own: rows equal in id and text are
    counted, and the count parts them, also where ids are null.  An empty table gives an
    empty result; other columns are ignored.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    rows = documents.select(doc_id.alias("doc_id"), byte_size(text).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"), group_key(text).alias("group"))
    rows = stored(each_copy(rows, "copy").withColumn("key", sort_key(F.col("group"), F.col("doc_id"), F.col("copy"))).drop("group"), "sizes")
    bounds = splitters(rows, shards)
    buckets = max(1, -(-rows.count() // (shards * BUCKET_ROWS)))
    placed = rows.withColumn("shard", shard_of(F.col("key"), bounds)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "key", "copy"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("place", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "doc_id", "size", "copy")))
    return numbered.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))
