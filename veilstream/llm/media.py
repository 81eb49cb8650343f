"""Media columns: signature sniffing, structure checks, correction of declared types, carving of embedded media.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value.  Each hit is only a
candidate: the format's validator walks the structure from there (chunk lengths, checksums, terminators) and
returns the length it confirms, or nothing.  A confirmed signature at the start gives the value's type, whatever
was declared; confirmed ones further in are embedded media and can be carved out.

``store_text`` keeps any bytes losslessly as the 8-bit samples of a WAV file, padded to whole blocks.

Defined results: a null value has null type and no media inside; an empty or unrecognised value keeps its declared
type, marked unconfirmed; truncated media are not confirmed; a candidate inside the bytes of one already carved
(of the same nesting) is not carved again; a value of any length is read whole, in time in proportion to it unless it is
full of headers that each announce most of it; equal values and repeated rows give equal results, a row each; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import materialise

#: samples of one stored block, and the byte that fills the last one (UTF-8 never holds it)
UNIT = 576
FILL = 255
RATE = 8000


class Value(bytes):
    """A value, with what validators look up in it more than once."""

    def places(self, mark: bytes) -> list[int]:
        """All places of a mark, found in one pass."""
        known = self.__dict__.setdefault("marks", {})
        if mark not in known:
            out, at = [], self.find(mark)
            while at >= 0:
                out.append(at)
                at = self.find(mark, at + 1)
            known[mark] = out
        return known[mark]

    def first(self, mark: bytes, at: int) -> int:
        """The first place of a mark from an offset on, or -1."""
        all_ = self.places(mark)
        i = bisect_left(all_, at)
        return all_[i] if i < len(all_) else -1

    def last(self, mark: bytes, at: int, end: int) -> int:
        """The last place of a mark that stands within a range, or -1."""
        all_ = self.places(mark)
        i = bisect_right(all_, end - len(mark)) - 1
        return all_[i] if i >= 0 and all_[i] >= at else -1

    def archives(self) -> dict[int, int]:
        """Where archives start -> where they end, by the records that end them."""
        if "zips" not in self.__dict__:
            found: dict[int, int] = {}
            for end in self.places(b"PK\x05\x06"):
                if end + 22 > len(self):
                    break
                size, offset, note = struct.unpack_from("<IIH", self, end + 12)
                start = end - offset - size
                if start >= 0 and end + 22 + note <= len(self) and (size == 0 or self[start + offset : start + offset + 4] == b"PK\x01\x02"):
                    found.setdefault(start, end + 22 + note)
            self.__dict__["zips"] = found
        return self.__dict__["zips"]


# ---- validators: length from an offset on, or None ------------------------------------------------
# Values may be long and full of magic bytes: a validator reads what it confirms, or little; what it looks for far away
# it looks up in the value's places.

def _png(d: Value, at: int) -> int | None:
    i = at + 8
    first = True
    while i + 12 <= len(d):
        n = int.from_bytes(d[i : i + 4], "big")
        kind = d[i + 4 : i + 8]
        if i + 12 + n > len(d) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(d[i + 4 : i + 8 + n]) != int.from_bytes(d[i + 8 + n : i + 12 + n], "big"):
            return None
        i += 12 + n
        if kind == b"IEND":
            return i - at
        first = False
    return None


def _jpeg(d: Value, at: int) -> int | None:
    i = at + 2
    while i + 4 <= len(d) and d[i] == 0xFF:
        kind = d[i + 1]
        n = int.from_bytes(d[i + 2 : i + 4], "big")
        if n < 2 or kind in (0xD8, 0xD9, 0x00):
            return None
        i += 2 + n
        if kind == 0xDA and d.first(b"\xff\xd9", i) < 0:
            return None
        if kind == 0xDA:  # entropy-coded data: to the next marker that is no restart and no stuffed byte
            while (i := d.find(b"\xff", i)) >= 0 and i + 1 < len(d) and (d[i + 1] == 0 or 0xD0 <= d[i + 1] <= 0xD7):
                i += 2
            if i < 0 or i + 1 >= len(d):
                return None
            if d[i + 1] == 0xD9:
                return i + 2 - at
    return None


def _gif(d: Value, at: int) -> int | None:
    if at + 13 > len(d):
        return None
    flags = d[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while i < len(d):
        kind = d[i]
        if kind == 0x3B:
            return i + 1 - at
        if kind == 0x2C:
            if i + 10 > len(d):
                return None
            i += 11 + (3 << (d[i + 9] & 7) + 1 if d[i + 9] & 0x80 else 0)
        elif kind == 0x21:
            i += 2
        else:
            return None
        while i < len(d) and d[i]:
            i += 1 + d[i]
        i += 1
    return None


def _riff(d: Value, at: int) -> tuple[str, int] | None:
    if at + 12 > len(d):
        return None
    size = int.from_bytes(d[at + 4 : at + 8], "little")
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(d[at + 8 : at + 12])
    end = at + 8 + size
    if kind is None or size < 12 or end > len(d):
        return None
    i, names = at + 12, []
    while i + 8 <= end:
        n = int.from_bytes(d[i + 4 : i + 8], "little")
        if i + 8 + n > end:
            return None
        names.append(d[i : i + 4])
        i += 8 + n + n % 2
    if kind == "audio/wav" and not {b"fmt ", b"data"} <= set(names):
        return None
    return kind, 8 + size + size % 2 if end + size % 2 <= len(d) else 8 + size


def _bmp(d: Value, at: int) -> int | None:
    if at + 26 > len(d):
        return None
    size, reserved, offset, head = struct.unpack_from("<IIII", d, at + 2)
    return size if reserved == 0 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= offset <= size and at + size <= len(d) else None


def _pdf(d: Value, at: int) -> int | None:
    end = d.last(b"%%EOF", at, len(d))
    if end < 0 or d.last(b"startxref", at, end) < 0:
        return None
    nxt = d.first(b"%PDF-", at + 5)
    if 0 <= nxt < end:  # another document follows: this one ends before it
        end = d.last(b"%%EOF", at, nxt)
        if end < 0:
            return None
    return end + 5 - at


def _zip(d: Value, at: int) -> int | None:
    end = d.archives().get(at)
    return None if end is None else end - at


def _gzip(d: Value, at: int) -> int | None:
    z = zlib.decompressobj(31)
    view = memoryview(d)
    try:
        for i in range(at, len(d), 1 << 14):
            part = view[i : i + (1 << 14)]
            while len(part) and not z.eof:
                z.decompress(part, 1 << 20)
                part = z.unconsumed_tail
            if z.eof:
                return min(len(d), i + (1 << 14)) - len(z.unused_data) - at
    except zlib.error:
        return None
    return None


def _flac(d: Value, at: int) -> int | None:
    i = at + 4
    if i + 4 > len(d) or d[i] & 0x7F != 0 or int.from_bytes(d[i + 1 : i + 4], "big") != 34:
        return None
    while i + 4 <= len(d):
        last, n = d[i] & 0x80, int.from_bytes(d[i + 1 : i + 4], "big")
        i += 4 + n
        if last:
            return len(d) - at if i + 2 <= len(d) and d[i] == 0xFF and d[i + 1] & 0xFC == 0xF8 else None
    return None


def _ogg(d: Value, at: int) -> int | None:
    i = at
    while d[i : i + 4] == b"OggS" and i + 27 <= len(d) and d[i + 4] == 0:
        n = d[i + 26]
        size = 27 + n + sum(d[i + 27 : i + 27 + n])
        if i + size > len(d):
            return None
        i += size
    return i - at if i > at else None


def _mp4(d: Value, at: int) -> int | None:
    start = at - 4
    if start < 0:
        return None
    known = d.__dict__.setdefault("boxes", {})  # of each box: where its row of boxes ends, and whether one of them is a movie
    row, i = [], start
    while i not in known and i + 8 <= len(d):
        n = int.from_bytes(d[i : i + 4], "big")
        kind = d[i + 4 : i + 8]
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"sidx", b"meta", b"uuid", b"wide", b"styp") or n < 8 or i + n > len(d):
            break
        row.append((i, kind in (b"moov", b"moof")))
        i += n
    end, seen = known.get(i, (i, False))
    for place, movie in reversed(row):
        seen |= movie
        known[place] = end, seen
    return end - start if seen else None


def _plain(kind: str, check):
    def run(d: Value, at: int):
        n = check(d, at)
        return (kind, n) if n else None

    run.kind = kind
    return run


#: magic bytes, where the medium starts before them, validator -> (type, length)
FORMATS = [
    (b"\x89PNG\r\n\x1a\n", 0, _plain("image/png", _png)),
    (b"\xff\xd8\xff", 0, _plain("image/jpeg", _jpeg)),
    (b"GIF87a", 0, _plain("image/gif", _gif)),
    (b"GIF89a", 0, _plain("image/gif", _gif)),
    (b"RIFF", 0, _riff),
    (b"BM", 0, _plain("image/bmp", _bmp)),
    (b"%PDF-", 0, _plain("application/pdf", _pdf)),
    (b"PK\x03\x04", 0, _plain("application/zip", _zip)),
    (b"\x1f\x8b\x08", 0, _plain("application/gzip", _gzip)),
    (b"fLaC", 0, _plain("audio/flac", _flac)),
    (b"OggS", 0, _plain("audio/ogg", _ogg)),
    (b"ftyp", 4, _plain("video/mp4", _mp4)),
]


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for n, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), n)
    a.make_automaton()
    return a


def find_media(data: bytes) -> list[tuple[int, int, str]]:
    """All confirmed media of a value: (offset, length, type), outer before inner."""
    found: list[tuple[int, int, str]] = []
    ends: dict[str, int] = {}
    value = Value(data)
    for last, n in _automaton().iter(data.decode("latin-1")):
        magic, back, check = FORMATS[n]
        at = last + 1 - len(magic)
        start = at - back
        if start < ends.get(getattr(check, "kind", ""), 0):  # inside a medium of its own kind, such as a later page of it
            continue
        got = check(value, at)
        if got is None:
            continue
        kind, size = got
        if start < ends.get(kind, 0):
            continue
        ends[kind] = start + size
        found.append((start, size, kind))
    return sorted(found, key=lambda x: (x[0], -x[1]))


def sniff(data: bytes | None, declared: str | None) -> tuple[str | None, bool, int, list[tuple[int, int, str]]]:
    """(type, whether the structure confirms it, length of the medium, embedded media)"""
    if data is None:
        return None, False, 0, []
    media = find_media(data)
    if media and media[0][0] == 0:
        (_, size, kind), *rest = media
        return kind, True, size, rest
    return declared, False, 0, media


SNIFFED = "media_type string, confirmed boolean, declared_ok boolean, media_length long, embedded array<struct<offset:long,length:long,type:string>>"


def sniff_column(df: DataFrame, column: str, declared: str) -> DataFrame:
    """df with what sniffing finds in a binary column; declared names the column of declared types."""
    from pyspark.sql import types as T

    added = T._parse_datatype_string(SNIFFED)
    clash = {f.name for f in added} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType(df.schema.fields + added.fields)
    kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))]

    def run(batches):
        for batch in batches:
            rows = []
            for data, said in zip(batch[column].to_pylist(), batch[declared].to_pylist(), strict=True):
                kind, sure, size, inside = sniff(data, said)
                rows.append((kind, sure, kind == said, size, [{"offset": a, "length": n, "type": k} for a, n, k in inside]))
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(f.name for f in added)])

    return df.mapInArrow(run, schema)


def carve(sniffed: DataFrame, column: str) -> DataFrame:
    """A row for each embedded medium of a sniffed column, with its bytes as column carved."""
    part = sniffed.select("*", F.explode("embedded").alias("part"))
    return part.withColumn("carved", F.substring(F.col(column), (F.col("part.offset") + 1).cast("int"), F.col("part.length").cast("int")))


# ---- bytes as samples -----------------------------------------------------------------------------

def to_samples(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples."""
    size = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + size + size % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return head + b"data" + struct.pack("<I", size) + payload + b"\0" * (size % 2)


def from_samples(wav: bytes) -> bytes:
    """The samples of a WAV file that ``to_samples`` wrote."""
    i = 12
    while i + 8 <= len(wav):
        n = int.from_bytes(wav[i + 4 : i + 8], "little")
        if wav[i : i + 4] == b"data":
            return wav[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    raise ValueError("no samples")


def padded(data: bytes, unit: int = UNIT) -> bytes:
    whole = max(unit, -(-len(data) // unit) * unit)
    return data + bytes([FILL]) * (whole - len(data))


def store_text(docs: DataFrame) -> DataFrame:
    """doc_id, declared, media: each text's padded UTF-8 bytes as a WAV file (declared without a type)."""

    def run(batches):
        for batch in batches:
            media = [to_samples(padded((x or "").encode())) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(["application/octet-stream"] * len(media)), pa.array(media, pa.binary())], ["doc_id", "declared", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, declared string, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest_media(stored: DataFrame) -> DataFrame:
    """What reading the stored media back gives: lengths, hashes, and a feature string of type and samples."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def digest(doc, media: bytes, declared: str):
        kind, sure, size, inside = sniff(media, declared)
        if not sure or kind != "audio/wav" or size != len(media):
            raise ValueError(f"stored media of document {doc} is damaged")
        payload = from_samples(media)
        x = np.frombuffer(payload, np.uint8)
        used = len(payload.rstrip(bytes([FILL])))
        level = np.bincount(x, minlength=256)
        mean = float(level @ np.arange(256)) / len(x)
        power = float(level @ (np.arange(256) - 128.0) ** 2) / len(x)
        share = level[level > 0] / len(x)
        feature = f"{kind};was={declared};inside={len(inside)};mean={mean:.4f};rms={power**0.5:.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f}"
        return doc, used, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        for batch in batches:
            rows = [digest(*r) for r in zip(batch["doc_id"].to_pylist(), batch["media"].to_pylist(), batch["declared"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return stored.select("doc_id", "media", "declared").mapInArrow(run, DIGEST)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Write every text as media to the shared folder, read the files back and digest them."""
    return digest_media(materialise(store_text(docs), "media"))
