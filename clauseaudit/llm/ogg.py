"""Media columns in Ogg containers: write, verify, reassemble, demultiplex and time.

A payload of 8-bit samples is stored losslessly as two logical streams whose pages interleave.  Reading back
verifies every page's checksum, rebuilds packets from the lacing values (packets may span pages),
separates the streams by serial number and derives time stamps from granule positions.

Null and empty texts give one packet of padding.  A very long text gives more pages, handled one at a time.
Equal texts give equal media, so ties and repeated rows agree; other columns are ignored.  A page
with a wrong checksum, a gap in the sequence or a torn packet raises ``OggError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from clauseaudit.llm.common import chunks

BLOCK = 576
RATE = 48_000
SERIALS = (0x5EED0001, 0x5EED0002)
PACKET = 3 * BLOCK  # samples in a packet; a page holds up to 255 lacing values of at most 255 bytes
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are no sound Ogg stream."""


class Page(NamedTuple):
    serial: int
    sequence: int
    granule: int
    flags: int
    lacing: bytes
    body: bytes


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from 0: the reflected CRC of flipped bytes, flipped."""
    reflected = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_FLIP), "big")


def page_bytes(p: Page) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, p.flags, p.granule, p.serial, p.sequence, 0) + bytes([len(p.lacing)]) + p.lacing
    whole = head + p.body
    return whole[:22] + struct.pack("<I", checksum(whole)) + whole[26:]


def paginate(packets: list[tuple[bytes, int]], serial: int) -> list[Page]:
    """Lay (packet, granule position at its end) onto pages of at most 255 lacing values."""
    values: list[tuple[int, bytes, int]] = []  # lacing value, its bytes, granule if a packet ends here
    for packet, granule in packets:
        for at in range(0, len(packet) + 1, 255):
            part = packet[at : at + 255]
            values.append((len(part), part, granule if len(part) < 255 else -1))
    pages = []
    for n, at in enumerate(range(0, len(values), 255)):
        part = values[at : at + 255]
        granule = next((g for _, _, g in reversed(part) if g >= 0), -1)
        flags = (at > 0 and values[at - 1][0] == 255) | (at == 0) << 1 | (at + 255 >= len(values)) << 2
        pages.append(Page(serial, n, granule, flags, bytes(v for v, _, _ in part), b"".join(b for _, b, _ in part)))
    return pages


def mux(payload: bytes) -> bytes:
    """Blocks of samples, dealt in turn to two streams, whose pages alternate; each begins with a header packet."""
    streams = []
    blocks = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    for k, serial in enumerate(SERIALS):
        position, packets = 0, [(struct.pack("<8sIIQ", b"rawpcmu8", RATE, k, len(payload)), 0)]
        for i, block in enumerate(blocks):
            position += len(block)
            if i % 2 == k:
                packets.append((block, position))
        streams.append(paginate(packets, serial))
    order = sorted((p for s in streams for p in s), key=lambda p: (p.sequence, p.serial))
    return b"".join(map(page_bytes, order))


def pages(media: bytes) -> Iterator[Page]:
    """All pages in order; each checksum is verified."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc = struct.unpack_from("<4sBBqIII", media, at)
        count = media[at + 26]
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if version or len(lacing) < count or end > len(media):
            raise OggError(f"the page at byte {at} is cut short")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        yield Page(serial, sequence, granule, flags, lacing, media[at + 27 + count : end])
        at = end


class Packet(NamedTuple):
    serial: int
    data: bytes
    granule: int  # of the page on which it ends, if it is the last to end there; else -1
    seconds: float


def packets(media: bytes) -> dict[int, list[Packet]]:
    """Logical streams by serial number, each a list of packets with time stamps where granule positions give them."""
    out: dict[int, list[Packet]] = {}
    open_parts: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    for page in pages(media):
        if page.sequence != expected.get(page.serial, 0):
            raise OggError(f"stream {page.serial:#x} lacks page {expected.get(page.serial, 0)}")
        expected[page.serial] = page.sequence + 1
        parts = open_parts.setdefault(page.serial, [])
        if bool(parts) != bool(page.flags & 1):
            raise OggError(f"stream {page.serial:#x}: a packet is torn at page {page.sequence}")
        done, at = out.setdefault(page.serial, []), 0
        last = max((i for i, v in enumerate(page.lacing) if v < 255), default=-1)
        for i, v in enumerate(page.lacing):
            parts.append(page.body[at : at + v])
            at += v
            if v < 255:
                granule = page.granule if i == last else -1
                done.append(Packet(page.serial, b"".join(parts), granule, granule / RATE if granule >= 0 else -1.0))
                parts.clear()
    if any(open_parts.values()):
        raise OggError("a stream ends inside a packet")
    return out


def demux(media: bytes) -> tuple[bytes, list[float]]:
    """The payload, and the time stamp of each page's last packet in each stream."""
    streams = packets(media)
    sizes = []
    for serial, got in streams.items():
        tag, rate, k, total = struct.unpack("<8sIIQ", got[0].data)
        if tag != b"rawpcmu8" or rate != RATE:
            raise OggError(f"stream {serial:#x} is of another kind")
        sizes.append((k, total, got[1:]))
    sizes.sort(key=lambda x: x[0])
    mixed = [b""] * sum(len(x[2]) for x in sizes)
    for k, _, got in sizes:
        mixed[k::2] = [p.data for p in got]
    payload = b"".join(mixed)
    if any(total != len(payload) for _, total, _ in sizes):
        raise OggError("the streams do not add up to the payload")
    return payload, [p.seconds for _, _, got in sizes for p in got if p.granule >= 0]


def payload_of(text: bytes) -> bytes:
    """The bytes, filled with 255 up to a positive multiple of 576."""
    return text + b"\xff" * ((-len(text)) % BLOCK or BLOCK * (not text))


def store(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """One row per document: sizes, digests of the payload read back and of the media, and a feature string
    (pages, packets, streams, duration and mean of the samples).  ``keep_media`` adds the media.
    """
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    if keep_media:
        schema += ", media binary"

    def row(text: bytes) -> tuple:
        media = mux(payload_of(text))
        payload, times = demux(media)
        found = list(pages(media))
        feature = f"pages={len(found)};packets={sum(v < 255 for p in found for v in p.lacing)};streams={len({p.serial for p in found})};seconds={max(times):.6f};mean={sum(payload) / len(payload):.4f}"
        out = len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature
        return (*out, media) if keep_media else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            rows = [row(chunk.text(i)) for i in range(len(chunk))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            cols = {"doc_id": chunk.column("doc_id").cast(pa.int64())}
            cols |= {n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(names[: 7 + keep_media])}
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
