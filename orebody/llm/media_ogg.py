"""Media columns: the Ogg container.

A reader that verifies page checksums, reassembles packets from lacing values, separates logical
streams and derives timestamps from granule positions; a writer for 8-bit sample streams; and
DataFrame operators over a column of Ogg files.

Edge cases: a null or empty media value has no pages and no packets; bytes that aren't a page are
skipped up to the next capture pattern and counted; recordings that follow one another in a file (a chain) are
separate logical streams, also with the same serial numbers; a page with a wrong checksum is reported with
crc_ok false and adds nothing to packets, and a packet that has lost a part is reported as broken
rather than joined across the gap; repeated rows give repeated results; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orebody.llm.common import text_chunks, texts_of

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")
RATE = 8000
PACKET = 30_000
UNIT = 64
MAGIC = b"\x7fSMP8"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1


def page_crc(data: bytes) -> int:
    """The page checksum: CRC-32 with polynomial 0x04c11db7, most significant bit first, initial value 0."""
    reflected = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Page:
    serial: int
    number: int
    granule: int
    flags: int
    lacing: bytes
    body: bytes
    offset: int
    crc_ok: bool


@dataclass
class Packet:
    data: bytes
    granule: int  # of the page on which it ends, if it is the last that ends there; else NO_GRANULE
    whole: bool = True
    page: int = -1  # the number of the page on which it ends


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    last_granule: int = 0
    link: int = 0  # the recording of the chain that it belongs to


def _page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def write_stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets are (data, granule at the end of the packet)."""
    segments: list[tuple[int, bytes, int | None, bool]] = []  # size, bytes, granule where a packet ends, packet starts here
    for data, granule in packets:
        full, rest = divmod(len(data), 255)
        for i in range(full):
            segments.append((255, data[i * 255 : i * 255 + 255], None, i == 0))
        segments.append((rest, data[full * 255 :], granule, full == 0))
    first = len(packets[0][0]) // 255 + 1
    groups, i = [segments[:first]], first  # the first packet has a page of its own
    while i < len(segments):
        groups.append(segments[i : i + 255])
        i += 255
    out = []
    for number, group in enumerate(groups):
        ends = [g for _, _, g, _ in group if g is not None]
        flags = (0 if group[0][3] else CONTINUED) | (FIRST if number == 0 else 0) | (LAST if number == len(groups) - 1 else 0)
        out.append(_page(serial, number, ends[-1] if ends else NO_GRANULE, flags, bytes(s for s, _, _, _ in group), b"".join(b for _, b, _, _ in group)))
    return out


def read_pages(data: bytes) -> Iterator[Page]:
    """Every page, in file order. A capture pattern whose page runs past the end is no page."""
    at = data.find(b"OggS")
    while at >= 0:
        if len(data) - at >= 27:
            _, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
            table = at + 27 + n
            lacing = data[at + 27 : table]
            end = table + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(data):
                ok = page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc
                if ok:
                    yield Page(serial, number, granule, flags, lacing, data[table:end], at, True)
                    at = data.find(b"OggS", end)
                    continue
                yield Page(serial, number, granule, flags, lacing, data[table:end], at, False)
        at = data.find(b"OggS", at + 4)


def demultiplex(data: bytes) -> dict[int | tuple[int, int], Stream]:
    """The logical streams, in the order in which they begin, with their packets put together again. By serial number; in a chain, those of
    the second recording on by serial number and the recording's number (from 1). A recording begins where a stream's first page follows others' later pages."""
    streams: dict[int | tuple[int, int], Stream] = {}
    partial: dict[int | tuple[int, int], list[bytes] | None] = {}
    number: dict[int | tuple[int, int], int] = {}
    link, begun = 0, False
    for page in read_pages(data):
        if not page.crc_ok:
            continue
        if page.flags & FIRST:
            link += begun
            begun = False
        else:
            begun = True
        key = (page.serial, link) if link else page.serial
        s = streams.setdefault(key, Stream(page.serial, link=link))
        gap = page.number != number.get(key, -1) + 1
        number[key] = page.number
        s.gaps += gap
        s.pages += 1
        held = partial.get(key)
        if held is not None and (gap or not page.flags & CONTINUED):
            s.packets.append(Packet(b"".join(held), NO_GRANULE, False))
            held = None
        headless = bool(page.flags & CONTINUED) and held is None  # its start is lost
        part, at, ended_at = held or [], 0, -1
        for size in page.lacing:
            part.append(page.body[at : at + size])
            at += size
            if size < 255:
                s.packets.append(Packet(b"".join(part), NO_GRANULE, not headless, page.number))
                headless, part, ended_at = False, [], len(s.packets) - 1
        if ended_at >= 0:
            s.packets[ended_at].granule = page.granule
            s.last_granule = max(s.last_granule, page.granule)
        open_end = bool(page.lacing) and page.lacing[-1] == 255
        partial[key] = part if open_end and not headless else None
        if open_end and headless:
            s.gaps += 1
        s.ended |= bool(page.flags & LAST)
    for key, held in partial.items():
        if held is not None:
            streams[key].packets.append(Packet(b"".join(held), NO_GRANULE, False))
    return streams


def encode_samples(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """Payload bytes as unsigned 8-bit samples in two multiplexed logical streams, packets dealt in turn.

    Each stream opens with a header packet (rate, its place among the streams, their count, packet size). Granule
    positions count the samples of the whole recording up to a packet's end, so either stream can be placed in time.
    """
    seed = zlib.crc32(payload)
    streams: list[list[tuple[bytes, int]]] = [[(MAGIC + struct.pack("<IBBIQ", rate, k, 2, packet, len(payload)), 0)] for k in (0, 1)]
    for i, at in enumerate(range(0, len(payload), packet)):
        piece = payload[at : at + packet]
        streams[i % 2].append((piece, at + len(piece)))
    pages = [write_stream((seed + k) & 0xFFFFFFFF, s) for k, s in enumerate(streams)]
    order = [pages[0][0], pages[1][0]]  # all first pages stand before any other
    for i in range(1, max(map(len, pages))):
        order += [p[i] for p in pages if i < len(p)]
    return b"".join(order)


def decode_samples(media: bytes) -> tuple[bytes, dict[int | tuple[int, int], Stream], int]:
    """The samples of `encode_samples`, the streams, and the sample rate; of a chain all recordings' samples, one after another. Raises ValueError
    if a part is missing."""
    streams = demultiplex(media)
    if not streams:
        raise ValueError("no logical stream")
    out, rate = [], 0
    for link in range(max(s.link for s in streams.values()) + 1):
        parts, total = [], 0
        for s in (s for s in streams.values() if s.link == link):
            head = s.packets[0].data
            if s.gaps or not s.ended or not head.startswith(MAGIC):
                raise ValueError("a logical stream is damaged or of another kind")
            rate, place, count, size, total = struct.unpack_from("<IBBIQ", head, len(MAGIC))
            parts += [((i * count + place), p) for i, p in enumerate(s.packets[1:])]
        out.append(b"".join(p.data for _, p in sorted(parts, key=lambda x: x[0]) if p.whole))
        if len(out[-1]) != total:
            raise ValueError("packets are missing")
    return b"".join(out), streams, rate


def sample_span(stream: Stream) -> Callable[[Packet], int] | None:
    """For streams of `encode_samples`: how far a packet's end lies behind that of the packet before it, which is its own samples and one packet of
    each other stream. None for other streams."""
    head = stream.packets[0].data if stream.packets else b""
    if not head.startswith(MAGIC) or len(head) < len(MAGIC) + 18:
        return None
    _, _, count, size, _ = struct.unpack_from("<IBBIQ", head, len(MAGIC))
    return lambda p: len(p.data) + (count - 1) * size


def packet_times(stream: Stream, rate: int, span: Callable[[Packet], int] | None = None) -> list[float | None]:
    """Seconds at which each packet ends. A page tells the position of the last packet that ends on it; the others are counted back from there by
    `span`, which is what the stream's kind says of a packet (default: `sample_span`). None where neither tells."""
    span = span or sample_span(stream)
    ends: list[int | None] = [None] * len(stream.packets)
    for i in range(len(ends) - 1, -1, -1):
        p = stream.packets[i]
        if p.granule != NO_GRANULE:
            ends[i] = p.granule
        elif span and p.page >= 0 and i + 1 < len(ends) and stream.packets[i + 1].page == p.page and ends[i + 1] is not None:
            ends[i] = max(0, ends[i + 1] - span(stream.packets[i + 1]))
    return [None if e is None or not rate else e / rate for e in ends]


def sample_features(samples: bytes, streams: dict[int, Stream], rate: int) -> str:
    """Duration, level and change of the samples, and what the container held."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    ends = [t for s in streams.values() for t in packet_times(s, rate) if t is not None]
    return "dur={:.6f};streams={};pages={};packets={};mean={:.4f};rms={:.4f};step={:.4f}".format(
        max(ends, default=0.0), len(streams), sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values()),
        x.mean() if len(x) else 0.0, float(np.sqrt((x * x).mean())) if len(x) else 0.0, float(np.abs(np.diff(x)).mean()) if len(x) > 1 else 0.0,
    )


def text_payload(text: bytes) -> bytes:
    """The bytes with zeros up to the next positive multiple of 64."""
    return text + b"\0" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode_text_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add a column with each text stored as an Ogg file of 8-bit samples (null text: as empty). It takes the place of a column of that name."""
    fields = [f for f in df.schema.fields if f.name != out]
    schema = StructType([*fields]).add(out, "binary")
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text):
                media = pa.array([encode_samples(text_payload(t)) for t in texts_of(part, text)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], media], [*names, out])

    return df.mapInArrow(run, schema)


def media_pages(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per page: keys, page_no, offset, serial, sequence, granule, flags, segments, body_bytes, crc_ok."""
    schema = df.select(*keys).schema
    for name, kind in (("page_no", "integer"), ("offset", "long"), ("serial", "long"), ("sequence", "long"), ("granule", "long"), ("flags", "integer"), ("segments", "integer"), ("body_bytes", "integer"), ("crc_ok", "boolean")):
        schema = schema.add(name, kind)
    return _exploded(df, media, keys, schema, lambda data: [(i, p.offset, p.serial, p.number, p.granule, p.flags, len(p.lacing), len(p.body), p.crc_ok) for i, p in enumerate(read_pages(data))])


def media_packets(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",), rate: int = RATE) -> DataFrame:
    """One row per packet: keys, serial, packet_no, granule, end_s, whole, packet."""
    schema = df.select(*keys).schema
    for name, kind in (("serial", "long"), ("packet_no", "integer"), ("granule", "long"), ("end_s", "double"), ("whole", "boolean"), ("packet", "binary")):
        schema = schema.add(name, kind)

    def rows(data: bytes) -> list[tuple]:
        return [(s.serial, i, p.granule, t, p.whole, p.data) for s in demultiplex(data).values() for i, (p, t) in enumerate(zip(s.packets, packet_times(s, rate), strict=True))]

    return _exploded(df, media, keys, schema, rows)


def _exploded(df: DataFrame, media: str, keys: tuple[str, ...], schema, rows) -> DataFrame:  # noqa: ANN001
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = None
            for part in text_chunks(batch, media):
                own = [part.column(k) for k in keys]
                index, found = [], []
                for i, data in enumerate(part.column(media).to_pylist()):
                    for row in rows(data or b""):
                        index.append(i)
                        found.append(row)
                taken = [c.take(pa.array(index, pa.int32())) for c in own]
                columns = list(zip(*found, strict=True)) if found else [()] * (len(names) - len(keys))
                arrow = arrow or [_ARROW[f.dataType.typeName()] for f in schema.fields[len(keys) :]]
                yield pa.RecordBatch.from_arrays([*taken, *[pa.array(c, t) for c, t in zip(columns, arrow, strict=True)]], names)

    return df.select(*keys, media).mapInArrow(run, schema)


_ARROW = {"integer": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def media_digest(df: DataFrame, key: str = "doc_id", media: str = "media", length: str = "n_bytes") -> DataFrame:
    """Read stored media back and describe it: payload and media digests and sample features. Null media has nulls; damaged media has its own
    length and digest, nulls for what can't be read, and the reason in `error`."""
    schema = type(df.schema)([df.schema[key]])
    for field in _DIGEST.replace("n_bytes", length, 1).split(", "):
        schema = schema.add(*field.split(" "))

    def described(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 7
        own = (len(data), hashlib.sha256(data).hexdigest())
        try:
            payload, streams, rate = decode_samples(data)
        except (ValueError, struct.error, IndexError) as e:
            return None, None, None, *own, None, str(e) or type(e).__name__
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *own, sample_features(payload, streams, rate), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for part in text_chunks(batch, media):
                columns = list(zip(*map(described, part.column(media).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(key), part.column(length), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], schema.fieldNames())

    return df.select(key, length, media).mapInArrow(run, schema)


def op1_ogg(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    """Every document's text stored as Ogg and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = encode_text_media(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    return media_digest(stored.drop("text")).drop("error")
