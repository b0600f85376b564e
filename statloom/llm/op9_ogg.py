"""Ogg media columns.

encode() stores a payload of 8-bit samples as an Ogg file of two logical streams,
interleaved page by page: the samples, whose granule positions count samples, and
an index of the payload's length and checksum. decode() verifies every page's
checksum, reassembles packets from the lacing values over page boundaries,
demultiplexes the streams by serial number and derives times from the granule
positions. Both are map-only over rows; the query writes the media as a table in
between and reads it back. A packet is longer than a page can be, so long payloads
have packets that go on over pages.

Edge cases: a null or empty text is stored as 64 bytes 0; equal texts give equal
files (nothing depends on the row); repeated rows are rows of their own; long
texts take more pages; null media give nulls, empty or damaged ones their bytes and
hash, nulls for what can't be read, and the fault as feature; an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Bits of each byte in reverse order: Ogg's checksum reads the highest bit first, zlib's the lowest.
REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))
RATE, PACKET, GRAIN = 8000, 80_000, 64
BOS, EOS, CONTINUED = 2, 4, 1
HEADER = struct.Struct("<4sBBqIIIB")


def page_crc(page: bytes) -> int:
    """Checksum of polynomial 0x04c11db7, from zero, not reflected."""
    low_first = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{low_first:032b}"[::-1], 2)


@dataclass
class Stream:
    """A logical stream that is written: packets are cut into pages of at most 255 segments."""

    serial: int
    pages: int = 0
    lacing: list[int] = field(default_factory=list)
    body: list[bytes] = field(default_factory=list)

    def page(self, lacing: list[int], body: bytes, granule: int, flags: int) -> bytes:
        head = HEADER.pack(b"OggS", 0, flags, granule, self.serial, self.pages, 0, len(lacing)) + bytes(lacing)
        self.pages += 1
        crc = page_crc(head + body)
        return head[:22] + struct.pack("<I", crc) + head[26:] + body

    def packet(self, data: bytes, granule: int, first: bool = False, last: bool = False) -> Iterator[bytes]:
        """The pages of a packet that begins a page; the granule position stands
        on the page where the packet ends."""
        lacing = [255] * (len(data) // 255) + [len(data) % 255]
        for at in range(0, len(lacing), 255):
            part = lacing[at : at + 255]
            ends = at + 255 >= len(lacing)
            flags = (CONTINUED if at else 0) | (BOS if first and not at else 0) | (EOS if last and ends else 0)
            yield self.page(part, data[255 * at : 255 * at + sum(part)], granule if ends else -1, flags)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and they filled up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % GRAIN or (0 if raw else GRAIN))


def mux(n_bytes: int, payload: bytes) -> bytes:
    """An Ogg file of the payload."""
    serial = zlib.crc32(payload)
    sound, index = Stream(serial), Stream((serial + 1) % (1 << 32))
    out = [*sound.packet(struct.pack("<8sIBB", b"\x7fpcm-u8\0", RATE, 1, 8), 0, first=True)]
    out += index.packet(struct.pack("<8s", b"\x7findex\0\0"), 0, first=True)
    for at in range(0, len(payload), PACKET):
        part = payload[at : at + PACKET]
        out += sound.packet(part, at + len(part), last=at + PACKET >= len(payload))
        entry = struct.pack("<QII", n_bytes, len(part), zlib.crc32(part))
        out += index.packet(entry, at + len(part), last=at + PACKET >= len(payload))
    return b"".join(out)


class Damaged(ValueError):
    """The bytes are no whole Ogg file."""


def demux(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """For each serial number, in order of first pages: packets and the granule
    positions of the pages where they end."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    open_: dict[int, list[bytes]] = {}
    due: dict[int, int] = {}
    at = 0
    while at < len(media):
        if len(media) < at + HEADER.size or media[at : at + 4] != b"OggS":
            raise Damaged(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, segments = HEADER.unpack_from(media, at)
        start = at + HEADER.size + segments
        lacing = media[at + HEADER.size : start]
        end = start + sum(lacing)
        if version or len(lacing) < segments or end > len(media):
            raise Damaged(f"a cut or unknown page at byte {at}")
        if page_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise Damaged(f"checksum of the page at byte {at}")
        if bool(flags & BOS) != (serial not in streams) or number != due.get(serial, 0) or bool(flags & CONTINUED) != bool(open_.get(serial)):
            raise Damaged(f"page order at byte {at}")
        packets, parts = streams.setdefault(serial, []), open_.setdefault(serial, [])
        due[serial] = number + 1
        for size in lacing:
            parts.append(media[start : start + size])
            start += size
            if size < 255:
                packets.append((b"".join(parts), granule))
                parts.clear()
        at = end
    if any(open_.values()):
        raise Damaged("a packet doesn't end")
    return streams


def read_back(media: bytes) -> tuple[int, bytes, str]:
    """Bytes of the text, the payload, and features: sampling rate, samples,
    milliseconds, packets, mean and peak sample."""
    streams = demux(media)
    if len(streams) != 2:
        raise Damaged(f"{len(streams)} streams")
    sound, index = streams.values()
    _, rate, channels, bits = struct.unpack("<8sIBB", sound[0][0])
    payload = b"".join(x for x, _ in sound[1:])
    n_bytes = 0
    if len(sound) < 2 or len(sound) != len(index):
        raise Damaged("packets are missing")
    for (part, granule), (entry, index_granule) in zip(sound[1:], index[1:]):
        n_bytes, length, crc = struct.unpack("<QII", entry)
        if length != len(part) or crc != zlib.crc32(part) or granule != index_granule:
            raise Damaged("the index differs")
    samples = np.frombuffer(payload, np.uint8)
    end = sound[-1][1]
    feature = f"rate={rate};channels={channels};bits={bits};samples={end};ms={end * 1000 // rate};packets={len(sound) - 1};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max())}"
    return n_bytes, payload, feature


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, media (the Ogg file of each text)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({id_column: frame["id"], "media": [mux(*payload_of(x)) for x in frame["text"]]})

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInPandas(compute, f"`{id_column}` {kind}, media binary")


def decode(rows: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    kind = rows.schema[id_column].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for media in frame["media"]:
                if media is None:
                    out.append((None,) * len(names))
                    continue
                media = bytes(media)
                stored = len(media), hashlib.sha256(media).hexdigest()
                try:
                    n, payload, feature = read_back(media)
                except (Damaged, struct.error) as fault:
                    out.append((None, None, None, None, *stored, f"damaged: {fault}"))
                    continue
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-GRAIN:]), *stored, feature))
            made = pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names if c not in ("payload_sha256", "media_sha256", "feature")})
            made.insert(0, id_column, frame["id"].to_numpy() if not frame["id"].isna().any() else frame["id"])
            yield made

    schema = f"`{id_column}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.select(F.col(id_column).alias("id"), F.col(media_column).alias("media")).mapInPandas(compute, schema)


def query(spark, sf_dir: str) -> DataFrame:
    media = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return decode(written(media, "media", compression="zstd"))
