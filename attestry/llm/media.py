"""Media columns: texts as unsigned 8-bit samples in Ogg, and a reader of Ogg columns.

The reader verifies the checksum of each page, reassembles packets from the lacing values,
separates the logical streams and derives times from granule positions.  Streams that it knows
are PCM (the OggPCM mapping: header "PCM     ", granule = samples so far) and an index stream that
holds the length of the unpadded bytes and a checksum for every block of samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import parts

# Fixed values of the formats.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
PCM_HEADER = struct.Struct(">8sHHIIBBHI")
PCM_NAME, PCM_U8 = b"PCM     ", 1
PAGE = struct.Struct("<4sBBqIIIB")

INDEX_HEADER = struct.Struct("<8sQI")
INDEX_NAME = b"BLOCKIDX"
INDEX_ENTRY = struct.Struct("<QI")
RATE = 8000
PACKET = 4000  # samples: half a second
BLOCK = 32_000

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 04c11db7, most significant bit first, from 0.  It is zlib's CRC of mirrored bytes, mirrored."""
    x = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_MIRROR), "big")


def pages_of(serial: int, packets: list[tuple[bytes, int]], alone: int = 1, last: bool = True) -> list[bytes]:
    """Pages of a logical stream from packets with the granule at their end; the first packets stand alone on pages."""
    out: list[bytes] = []
    lacing, body, granule, continued = bytearray(), [], NO_GRANULE, False

    def flush(final: bool) -> None:
        nonlocal lacing, body, granule
        flags = CONTINUED * continued | FIRST * (not out) | LAST * final
        head = PAGE.pack(CAPTURE, 0, flags, granule, serial, len(out), 0, len(lacing)) + bytes(lacing)
        page = bytearray(head + b"".join(body))
        page[22:26] = page_checksum(bytes(page)).to_bytes(4, "little")
        out.append(bytes(page))
        lacing, body, granule = bytearray(), [], NO_GRANULE

    for k, (packet, at) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        place = 0
        while values:
            room = 255 - len(lacing)
            part, values = values[:room], values[room:]
            size = sum(part)
            lacing += part
            body.append(packet[place : place + size])
            place += size
            if not values:
                granule = at
            if len(lacing) == 255 and (values or k + 1 < len(packets)):
                flush(False)
                continued = bool(values)
        if k < alone and k + 1 < len(packets):
            flush(False)
            continued = False
    flush(last)
    return out


def encode(payload: bytes, n_bytes: int) -> bytes:
    """payload as a PCM stream and, interleaved with it, its index stream; equal payloads give equal bytes."""
    serial = zlib.crc32(payload)
    pcm = [(PCM_HEADER.pack(PCM_NAME, 2, 2, PCM_U8, RATE, 8, 1, PACKET, 0), 0)]
    pcm += [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    index = [(INDEX_HEADER.pack(INDEX_NAME, n_bytes, BLOCK), 0)]
    index += [(INDEX_ENTRY.pack(k, zlib.crc32(payload[k : k + BLOCK])), min(k + BLOCK, len(payload))) for k in range(0, len(payload), BLOCK)]
    a, b = pages_of(serial, pcm), pages_of(serial ^ 0xFFFFFFFF, index)
    mixed = [a[0], b[0]]  # all first pages come before other pages
    for k in range(1, max(len(a), len(b))):
        mixed += a[k : k + 1] + b[k : k + 1]
    return b"".join(mixed)


@dataclass
class Stream:
    """A logical stream: whole packets, and the time axis that its pages give."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page on which each packet ends, which is that of its last packet
    last: list[bool] = field(default_factory=list)  # whether a packet is the last one that ends on its page
    part: bytes | None = None
    next_page: int = 0
    ended: bool = False


def read_streams(media: bytes) -> dict[int, Stream]:
    """The logical streams by serial number; ValueError where a page is broken, missing or out of place."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < PAGE.size:
            raise ValueError("cut page header")
        name, version, flags, granule, serial, number, checksum, segments = PAGE.unpack_from(media, at)
        if name != CAPTURE or version:
            raise ValueError(f"no page at {at}")
        lacing = media[at + PAGE.size : at + PAGE.size + segments]
        end = at + PAGE.size + segments + sum(lacing)
        if end > len(media) or len(lacing) < segments:
            raise ValueError("cut page")
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != checksum:
            raise ValueError(f"checksum of the page at {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise ValueError("first page out of place")
        stream = streams.setdefault(serial, Stream())
        if number != stream.next_page or stream.ended or bool(flags & CONTINUED) != (stream.part is not None):
            raise ValueError("page out of sequence")
        stream.next_page, stream.ended = number + 1, bool(flags & LAST)
        place, length, ended = at + PAGE.size + segments, 0, len(stream.packets)
        for value in lacing:
            length += value
            if value < 255:
                stream.packets.append((stream.part or b"") + media[place : place + length])
                stream.granules.append(granule)
                stream.last.append(False)
                stream.part = None
                place, length = place + length, 0
        if len(stream.packets) > ended:
            stream.last[-1] = True
        elif granule != NO_GRANULE:
            raise ValueError("granule position of a page on which no packet ends")
        if length or (lacing and lacing[-1] == 255):
            stream.part = (stream.part or b"") + media[place : place + length]
        at = end
    if any(not s.ended or s.part is not None for s in streams.values()):
        raise ValueError("unfinished stream")
    return streams


def packet_times(stream: Stream, sizes: list[int], first: int, rate: int) -> list[tuple[float, float]]:
    """Start and end in seconds of the packets from first on; sizes are their samples.

    A page's granule is the end of the last packet that ends on it; the ends of those before it follow
    backwards from there by their sizes.  ValueError where the granules of two pages disagree with them."""
    ends: list[int] = [0] * len(sizes)
    after = None
    for k in range(len(sizes) - 1, -1, -1):
        after = stream.granules[first + k] if stream.last[first + k] else after - sizes[k + 1]
        ends[k] = after
    starts = [end - size for end, size in zip(ends, sizes, strict=True)]
    if starts != [0, *ends[:-1]][: len(starts)]:
        raise ValueError("granule positions differ from the samples")
    return [(a / rate, b / rate) for a, b in zip(starts, ends, strict=True)]


def decode(media: bytes) -> tuple[bytes, int, str]:
    """(samples, unpadded bytes, features) of an Ogg file that encode could have made."""
    streams = read_streams(media)
    heads = {s.packets[0][:8]: s for s in streams.values()}
    pcm, index = heads[PCM_NAME], heads[INDEX_NAME]
    _, _, _, kind, rate, bits, channels, _, extra = PCM_HEADER.unpack(pcm.packets[0])
    if kind != PCM_U8 or channels != 1:
        raise ValueError("samples of another format")
    payload = b"".join(pcm.packets[1 + extra :])
    _, n_bytes, block = INDEX_HEADER.unpack(index.packets[0])
    for packet in index.packets[1:]:
        first, checksum = INDEX_ENTRY.unpack(packet)
        if zlib.crc32(payload[first : first + block]) != checksum:
            raise ValueError("samples differ from their index")
    samples = np.frombuffer(payload, np.uint8)
    times = packet_times(pcm, [len(p) for p in pcm.packets[1 + extra :]], 1 + extra, rate)
    centred = samples.astype(np.float32) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(centred))))
    features = {
        "codec": "pcm_u8", "rate": rate, "seconds": f"{times[-1][1]:.6f}", "last_packet": f"{times[-1][0]:.6f}", "streams": len(streams),
        "pages": sum(s.next_page for s in streams.values()), "packets": len(pcm.packets) - 1 - extra, "peak": int(np.abs(centred).max()),
        "rms": f"{np.sqrt(np.mean(centred.astype(np.float64) ** 2)):.4f}", "crossings": crossings,
    }
    return payload, n_bytes, ";".join(f"{k}={v}" for k, v in features.items())


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def _encoded(batches):
    for batch in (part for whole in batches for part in parts(whole, 1)):
        raw = [(x.as_py() or "").encode() for x in batch.column(1)]
        media = [encode(padded(x), len(x)) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])


def with_media(documents: DataFrame) -> DataFrame:
    """doc_id and media, the Ogg file of each row's text in UTF-8 with zero bytes up to a positive multiple of 64.

    A null text is an empty one: 64 zero bytes.  Rows are independent: equal texts give equal files,
    repeated rows repeated files, an empty table an empty result; other columns are ignored.
    """
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return docs.mapInArrow(_encoded, "doc_id long, media binary")


FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _facts(batches):
    names = [x.split()[0] for x in FACTS.split(", ")]
    for batch in (part for whole in batches for part in parts(whole, 1)):
        rows = []
        for x in batch.column(1):
            media = x.as_py()
            payload, n, feature = decode(media)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def media_facts(media: DataFrame) -> DataFrame:
    """What the stored files hold: sizes and digests of the samples read back and of the files, and features
    (codec, rate, seconds and the last packet's start by granule positions, streams, pages, packets, peak, rms, sign changes).

    A file that fails a check ends the job with ValueError: stored media are never passed over.
    """
    return media.select("doc_id", "media").mapInArrow(_facts, FACTS)
