"""WARC archives of web pages with a two-level capture index, written and read by Spark tasks.

Each task writes one archive of gzip members, a member for each record, to the shared folder and
returns the index lines.  The lines are range-sorted by reversed-host URL keys and cut into
compressed blocks; a sparse directory beside each index shard holds the first key of each
block.  A lookup binary-searches the shards' bounds and the directory and reads one block; the
records that it finds are read by range, those of an archive together and in its order.  Files are named anew by each attempt of a task and lines point only to
files of the attempt that returned them, so a lost executor leaves nothing but unused files.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import new_path, parts, stored

BLOCK_LINES = 3000
SHARD_LINES = 100_000
READ_BYTES = 2 << 20  # of archives that a task reads back, unless one archive has more
NO_ID = -(1 << 63)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@lru_cache(maxsize=8)
def _filesystem(uri: str):
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then ")" and the path with its query: sorts by site."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:  # a broken port or bracket: the text itself is the key
        return url
    if not host:
        return url
    labels = ",".join(reversed(host.split(".")))
    return labels + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A gzip member with a response record, or a revisit of the page refers_to; and the payload's digest."""
    digest = payload_digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page is not None:
        lines.append(f"X-Page: {page}")
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush(), digest


def read_record(member: bytes) -> dict:
    """The headers of a record with its payload_bytes; ValueError where lengths or digests don't hold."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or "sha1:" + payload_digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError("broken record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["WARC-Type"] == "response" and ("sha1:" + payload_digest(payload) != fields["WARC-Payload-Digest"] or len(payload) != size):
        raise ValueError("payload differs from its digest")
    return fields | {"payload_bytes": size}


LINES = "url_key string, page_id long, file string, offset long, length long"


def _write(folder: str):
    def run(batches):
        files, root = _filesystem(folder)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in (part for whole in batches for part in parts(whole, 2)):
            rows = [[] for _ in range(5)]
            for page, url, html, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                member, _ = make_record(page, url, (html or "").encode(), None if first is None or first == page else first)
                out.write(member)
                for column, value in zip(rows, (url_key(url), page, name, at, len(member)), strict=True):
                    column.append(value)
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), *(pa.array(x, pa.int64()) for x in rows[3:])], ["url_key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the index lines.

    Of the records with an equal payload the one with the smallest page_id is the response that the
    others revisit; a null html is an empty payload, a null page_id comes after all others.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"key": F.coalesce("page_id", F.lit(NO_ID)), "digest": F.sha2("html", 256)})
    # Only digests meet by payload; a page's own row meets its verdict by its id, so that many equal payloads fill no task.
    digests = rows.select("key", "page_id", "digest")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = digests.join(first, "digest").where("page_id is null or page_id <> first").select("key", "digest", "first").distinct()
    known = rows.join(revisits, ["key", "digest"], "left").select("page_id", "url", "html", "first")
    return stored(known.mapInArrow(_write(folder), LINES), "lines")


def _index(folder: str):
    """Sorted lines to a shard of compressed blocks and its directory."""

    def run(batches):
        files, root = _filesystem(folder)
        name, at, out, waiting, directory = uuid.uuid4().hex, 0, None, [], []

        def flush():
            nonlocal at, out
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}.blocks", compression=None)
            block = zlib.compress("\n".join(map(json.dumps, waiting)).encode())
            directory.append([*waiting[0][:2], at, len(block)])
            out.write(block)
            at += len(block)
            waiting.clear()

        for batch in batches:
            for line in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                waiting.append([line[0], NO_ID if line[1] is None else line[1], *line[2:]])
                if len(waiting) == BLOCK_LINES:
                    flush()
        if waiting:
            flush()
        if out is not None:
            out.close()
            with files.open_output_stream(f"{root}/{name}.directory", compression=None) as d:
                d.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64())], ["shard", "url_key", "page_id"])

    return run


def build_index(lines: DataFrame, folder: str) -> list[tuple[str, int, str]]:
    """Writes the index; returns (first key, first page, shard) in order: one entry for each partition of the sort."""
    shards = max(1, -(-lines.count() // SHARD_LINES))
    laid = lines.repartitionByRange(shards, "url_key", F.coalesce("page_id", F.lit(NO_ID))).sortWithinPartitions("url_key", F.coalesce("page_id", F.lit(NO_ID)))
    shards = stored(laid.mapInArrow(_index(folder), "shard string, url_key string, page_id long"), "shards")
    return sorted((r.url_key, r.page_id, r.shard) for r in shards.collect())


def _order(key: str, page: int) -> tuple[bytes, int]:
    return key.encode(), page


def _routed(bounds):
    keys = [_order(k, p) for k, p, _ in bounds]

    def run(batches):
        for batch in batches:
            asked = [(url_key(u), NO_ID if p is None else p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            shard = [max(0, bisect.bisect_right(keys, _order(*x)) - 1) for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array([x[0] for x in asked], pa.string()), pa.array([x[1] for x in asked], pa.int64())], ["shard", "url_key", "page_id"])

    return run


class Index:
    """Lookups in one shard; keeps its directory and the block read last."""

    def __init__(self, folder: str, shard: str):
        self.files, self.root = _filesystem(folder)
        with self.files.open_input_file(f"{self.root}/{shard}.directory") as f:
            self.directory = json.loads(zlib.decompress(f.read()))
        self.keys = [_order(k, p) for k, p, _, _ in self.directory]
        self.blocks, self.at, self.block = self.files.open_input_file(f"{self.root}/{shard}.blocks"), None, []

    def find(self, key: str, page: int):
        """(file, offset, length) of each record with this key and page."""
        want = _order(key, page)
        k = max(0, bisect.bisect_left(self.keys, want) - 1)  # equal lines may begin in the block before
        while k < len(self.keys) and (self.keys[k] <= want):
            if self.at != k:
                _, _, offset, length = self.directory[k]
                self.block = [(_order(*x[:2]), x[2:]) for x in map(json.loads, zlib.decompress(self.blocks.read_at(length, offset)).decode().split("\n"))]
                self.at = k
            i = bisect.bisect_left(self.block, want, key=lambda x: x[0])
            while i < len(self.block) and self.block[i][0] == want:
                yield self.block[i][1]
                i += 1
            k += 1


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _located(index: str, names: list[str]):
    def run(batches):
        shard, held = None, None
        for batch in batches:
            rows = [[] for _ in range(4)]
            for number, key, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if number != shard:
                    if held:
                        held.blocks.close()
                    shard, held = number, Index(index, names[number])
                for name, offset, length in held.find(key, page):
                    for column, value in zip(rows, (name, offset, length, None if page == NO_ID else page), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(x, pa.int64()) for x in rows[1:])], ["file", "offset", "length", "page_id"])
        if held:
            held.blocks.close()

    return run


def _records(folder: str):
    """Rows sorted by file and offset to the records there; a file is open once."""

    def run(batches):
        files, root = _filesystem(folder)
        name, archive = None, None
        for batch in batches:
            rows = []
            for file, offset, length, page in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if file != name:
                    if archive:
                        archive.close()
                    name, archive = file, files.open_input_file(f"{root}/{file}")
                fields = read_record(archive.read_at(length, offset))
                back = fields.get("X-Refers-To-Page")
                rows.append((page, fields["payload_bytes"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], None if back is None else int(back)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if archive:
            archive.close()

    return run


def read_archives(asked: DataFrame, folder: str, index: str, bounds: list[tuple[str, int, str]]) -> DataFrame:
    """The records of asked (page_id, url), found through the index; asked rows are distinct pages.

    A task for each shard of the index finds where they are, a task for each archive, or a few of them, reads them."""
    if not bounds:
        return asked.sparkSession.createDataFrame([], FOUND)
    routed = asked.mapInArrow(_routed(bounds), "shard long, url_key string, page_id long").distinct()
    laid = routed.repartition(len(bounds), "shard").sortWithinPartitions("shard", "url_key", "page_id")
    found = stored(laid.mapInArrow(_located(index, [b[2] for b in bounds]), "file string, offset long, length long, page_id long"), "located")
    size = found.agg(F.count_distinct("file"), F.sum("length")).first()
    tasks = max(1, min(size[0], -(-(size[1] or 0) // READ_BYTES)))
    return found.repartition(tasks, "file").sortWithinPartitions("file", "offset").mapInArrow(_records(folder), FOUND)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes pages to archives with an index in the shared folder and reads each page back through it.

    Returns page_id, payload_bytes, payload_digest (base32 SHA-1), record_type and refers_to for each
    record.  A null html is an empty payload, a null url has the empty key.  Rows that repeat a
    page_id with an equal payload are all of the type of the first; other columns are ignored.
    An empty table writes nothing and gives an empty result.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    bounds = build_index(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return read_archives(asked, f"{folder}/archives", f"{folder}/index", bounds)
