"""Helpers shared by the operators of this subpackage.

Words are maximal runs of bytes other than space and 0x09-0x0D of the UTF-8 text.  The
functions below find and hash the words of a whole Arrow batch with numpy, without a Python
step per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
SLICE_BYTES = 1 << 20  # texts are hashed about this many bytes at a time
WORD_SEPARATORS = b" \t\n\x0b\x0c\r"


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection on 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        return mix64(steps + U64(seed) * U64(0xD1B54A32D192ED03)) | U64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=U64)


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(WORD_SEPARATORS)] = True
NOT_ALNUM = np.ones(256, bool)  # between words of letters and digits: ASCII but for these
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BYTE = constants(1, 256)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_PLACES = constants(2, 64)  # a weight for each place in a word: no pattern of letters cancels, as it may with powers of one base


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in these bytes); a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def parts(batch: pa.RecordBatch, text: int, limit: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts of about limit bytes of its column text, so that few texts are held as objects at once."""
    for at, end, _, _ in slices(batch.column(text), limit):
        yield batch.slice(at, end - at)


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each row's words begin (one more entry than rows)."""
    inside = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a row never continues the last row's word
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    global _PLACES
    lengths = ends - starts
    if len(_PLACES) < lengths.max():
        _PLACES = constants(2, int(lengths.max()) * 2)
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(at, lengths)
    values = table[data[np.repeat(starts, lengths) + place]] * _PLACES[place]
    return mix64(np.add.reduceat(values, at) + lengths.astype(U64) * U64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; fold: A-Z count as a-z."""
    table = _FOLDED if fold else _BYTE
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):  # a very long text goes through in blocks of words
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES)))
        out[at:end] = _hash_block(data, starts[at:end], ends[at:end], table)
        at = end
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run on one machine a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="attestry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read again, which ends its lineage."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.attestry_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.attestry_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


COPIES = 4096  # equal rows that one task makes at a time


def each_copy(rows: DataFrame, number: str) -> DataFrame:
    """rows with the column number, which counts equal rows from 0: the same whatever order they came in.

    Equal rows are counted and made anew.  Those of a row that came very often are made in stretches by several tasks."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    few, many = counted.where(F.col("copies") <= COPIES), counted.where(F.col("copies") > COPIES)
    few = few.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias(number))
    many = many.select(*rows.columns, "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("first"))
    last = F.least(F.col("first") + COPIES, "copies") - 1
    many = many.repartition(*rows.columns, "first").select(*rows.columns, F.explode(F.sequence(F.col("first"), last)).alias(number))
    return few.unionByName(many)


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores added a name that df doesn't have."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(df: DataFrame, run: Callable, shape: T.StructType) -> DataFrame:
    """df.mapInArrow(run, shape), whatever characters the columns' names have."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(run, T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(shape)])).toDF(*shape.names)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(U64)
