"""Media columns: find out what bytes really are, and what is embedded in them.

An Aho-Corasick automaton walks the bytes once and reports every magic number. A validator for the
format then follows its structure (chunk lengths, checksums, end markers); only what holds is kept.
The first valid hit at offset 0 gives the true type, whatever type was declared, and every further
valid hit is an embedded medium that can be carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, table

# Magic bytes of the formats, and where they stand in a file.
MAGIC = [
    ("png", b"\x89PNG\r\n\x1a\n", 0),
    ("jpeg", b"\xff\xd8\xff", 0),
    ("gif", b"GIF87a", 0),
    ("gif", b"GIF89a", 0),
    ("bmp", b"BM", 0),
    ("riff", b"RIFF", 0),
    ("ogg", b"OggS\x00", 0),
    ("flac", b"fLaC", 0),
    ("mp4", b"ftyp", 4),
]
RIFF_KINDS = {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}


def _png(b: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or (p == at + 8 and kind != b"IHDR"):
            return 0
        if zlib.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        p = end
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        marker = b[p + 1]
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2 or not (0xC0 <= marker <= 0xFE):
            return 0
        p += 2 + size
        if marker == 0xDA:  # scan data runs to the end marker
            end = b.find(b"\xff\xd9", p)
            return end + 2 - at if end >= 0 else 0
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, _, offset, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * depth + 31) // 32 * 4
    good = planes == 1 and depth in (1, 4, 8, 16, 24, 32) and header in (40, 56, 64, 108, 124) and offset >= 14 + header
    return size if good and at + size <= len(b) and size >= offset + row * abs(height) else 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in RIFF_KINDS:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p = at + 12
    if end > len(b):
        return 0
    while p < end:
        if p + 8 > end:
            return 0
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + (size & 1)
    return end - at if p == end and end > at + 20 else 0


def _ogg(b: bytes, at: int) -> int:
    p = at
    while b[p : p + 5] == b"OggS\x00" and p + 27 <= len(b):
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > len(b):
            return 0
        p += size
        if b[p - size + 5] & 4:
            return p - at
    return 0


def _flac(b: bytes, at: int) -> int:
    p = at + 4
    while p + 4 <= len(b):
        last, kind, size = b[p] >> 7, b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4])
        if p == at + 4 and (kind, size) != (0, 34):
            return 0
        p += 4 + size
        if last:
            return len(b) - at if p <= len(b) else 0
    return 0


def _mp4(b: bytes, at: int) -> int:
    p, seen = at, 0
    while p + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if size < 8 or p + size > len(b) or not kind.isalnum():
            break
        p, seen = p + size, seen + 1
    return p - at if seen >= 2 else 0


VALID = {"png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "riff": _riff, "ogg": _ogg, "flac": _flac, "mp4": _mp4}


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, magic, shift in MAGIC:
        a.add_word(magic.decode("latin-1"), (kind, len(magic), shift))
    a.make_automaton()
    return a


def sniff(data: bytes | None) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every valid medium in the bytes, by offset; none for null or empty bytes.

    A hit inside a medium that is already accepted is reported too: it is embedded there.
    """
    found = []
    for last, (kind, size, shift) in _automaton().iter((data or b"").decode("latin-1")):
        at = last + 1 - size - shift
        if at >= 0 and (length := VALID[kind](data, at)):
            found.append((RIFF_KINDS[data[at + 8 : at + 12]] if kind == "riff" else kind, at, length))
    return sorted(found, key=lambda x: (x[1], -x[2]))


EMBEDDED = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))


def sniff_media(df: DataFrame, data: str, declared: str, carve: bool = True) -> DataFrame:
    """Add true_type, corrected and embedded (type, offset, length, bytes) to a binary column with declared types.

    true_type is null where no known medium stands at offset 0 (null and empty data too); corrected is
    true where it differs from the declared type. The bytes of what is embedded are carved out, unless that is not asked for (then null).
    Rows keep their other columns; the three names given here replace columns of the same name. Repeated rows
    give repeated results. Bytes are read batch by batch, cut to about 2 MB of them at a time.
    """
    kept = [f for f in df.schema.fields if f.name not in ("true_type", "corrected", "embedded")]
    names = [f.name for f in kept]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, data):
            types, wrong, inner = [], [], []
            for value, told in zip(batch.column(data), batch.column(declared).to_pylist(), strict=True):
                raw = value.as_py() or b""
                found = sniff(raw)
                top = next((f for f in found if f[1] == 0), None)
                types.append(top and top[0])
                wrong.append(top is not None and top[0] != told)
                inner.append([{"type": k, "offset": at, "length": n, "bytes": raw[at : at + n] if carve else None} for k, at, n in found if (k, at, n) != top])
            more = [pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inner, EMBEDDED)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more], [*names, "true_type", "corrected", "embedded"])

    seen = "true_type string, corrected boolean, embedded array<struct<type:string, offset:bigint, length:bigint, bytes:binary>>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.select(*names).mapInArrow(look, f"{fields}, {seen}")


RATE = 16_000
BLOCK = 576


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM, one sample a byte: lossless for any bytes."""
    odd = len(payload) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload + b"\x00" * odd


def wav_samples(media: bytes) -> bytes:
    """The bytes of the data chunk of a valid 8-bit WAV."""
    if not _riff(media, 0):
        raise ValueError("not a whole RIFF file")
    p = 12
    while p + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, p)
        if kind == b"data":
            return media[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    raise ValueError("no samples")


def padded(raw: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of 576."""
    return raw + b"\xff" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def feature_of(samples: bytes, found: list[tuple[str, int, int]]) -> str:
    """Type and what is embedded, then mean, deviation, crossings of the middle and a coarse histogram."""
    x = np.frombuffer(samples, np.uint8)
    hist = np.bincount(x >> 5, minlength=8)
    kinds = ",".join(f"{k}@{at}+{n}" for k, at, n in found)
    crossings = np.count_nonzero((x[1:] ^ x[:-1]) & 128)
    return f"{kinds};mean={x.mean():.6f};std={x.std():.6f};zc={crossings};hist={','.join(map(str, hist))}"


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, true_type string, corrected boolean"


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text as a WAV (declared, wrongly, as image/bmp), sniff it, read it back and digest it.

    One row per document, in a map over the input without a shuffle; a null text counts as empty, an
    empty one as 576 bytes of padding. Equal texts give equal values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                media = to_wav(padded(raw))
                found = sniff(media)
                kind = found[0][0] if found and found[0][1] == 0 else None
                samples = wav_samples(media)
                rows.append((doc_id, len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples, found), kind, kind != "bmp"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    NAMES = [c.split()[0] for c in MEDIA_SCHEMA.split(", ")]
    TYPES = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in MEDIA_SCHEMA.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, MEDIA_SCHEMA)


def op10_media(spark, sf_dir):
    return media_digests(table(spark, sf_dir, "documents"))
