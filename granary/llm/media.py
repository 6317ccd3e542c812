"""Media columns: bytes with a declared type, a type that their signature proves, and parts.

An Aho-Corasick automaton finds all magic bytes in one pass; each hit goes to its format's
validator, which follows the structure and returns the length, or nothing. A valid hit at offset 0
corrects the declared type; valid hits further in are listed as embedded media, with offsets and
lengths, and can be carved out.

Validators share what they learn of a buffer: end marks are listed once, places from which a chain
of chunks, blocks, frames or pages was followed are remembered with its end, and checksums of long
chunks come from checksums of prefixes. So false hits cost about as much as the buffer is long,
however many there are. What has no such shortcut is a compressed stream, which is inflated to its
end or its first error, once for each place where one might begin.

Null data counts as empty: no type, no parts. Equal bytes give equal results; repeated rows and an
empty table need no care; a very long value is one task's work. Columns named as those that are
added are replaced, others are kept.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.common import map_batches, schema_with, texts

UNIT = 64
RATE = 8000
_STARTXREF = re.compile(rb"startxref\s+(\d{1,15})\s+%%EOF")
_XREF = re.compile(rb"(?:(?<!start)xref\s|\d+\s+\d+\s+obj)")
#: Bytes between checksums of prefixes; chunks up to this long are checked as they are.
STEP = 4096
Found = tuple[str, int] | None


class Buffer:
    """Bytes, and what has been learned of them."""

    def __init__(self, data: bytes):
        self.data, self.marks, self.last, self.memo = data, {}, {}, {}

    def places(self, mark: bytes) -> list[int]:
        """Where a mark begins, in order."""
        if mark not in self.marks:
            self.marks[mark] = [m.start() for m in re.finditer(b"(?=" + re.escape(mark) + b")", self.data)]
        return self.marks[mark]

    def following(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on, or -1. Hits come in order, so the last answer
        mostly holds."""
        low, found = self.last.get(mark, (1, 0))
        if not low <= at <= found:
            found = self.data.find(mark, at)
            self.last[mark] = at, found if found >= 0 else len(self.data)
        return found if found < len(self.data) else -1

    def once(self, name: str, make):
        """What ``make`` finds for the whole buffer, made when it's first asked for."""
        if name not in self.memo:
            self.memo[name] = make(self)
        return self.memo[name]

    def chain(self, name: str, at: int, step):
        """Follow ``step``, which gives the next place, or a final answer in a tuple; places passed are
        remembered with the answer, so no chain is followed twice."""
        known, passed = self.memo.setdefault(name, {}), []
        while at not in known:
            passed.append(at)
            at = step(self, at)
            if isinstance(at, tuple):
                known[passed[-1]] = at
                at = passed[-1]
        for p in passed:
            known[p] = known[at]
        return known[at][0]

    def crc32(self, start: int, end: int) -> int:
        if end - start <= STEP:
            return zlib.crc32(self.data[start:end])
        return self._prefix(end) ^ _zeros_after(self._prefix(start), end - start)

    def _prefix(self, end: int) -> int:
        sums = self.once("crc32", lambda _: [0])
        while len(sums) <= end // STEP:
            here = (len(sums) - 1) * STEP
            sums.append(zlib.crc32(self.data[here : here + STEP], sums[-1]))
        here = end // STEP * STEP
        return zlib.crc32(self.data[here:end], sums[end // STEP])


@cache
def _zero_operators() -> list[list[int]]:
    """What 1, 2, 4, ... zero bytes after some bytes do to each bit of their CRC-32."""

    one = [0xEDB88320, *[1 << i for i in range(31)]]
    byte = one
    for _ in range(3):
        byte = [_applied(byte, c) for c in byte]
    out = [byte]
    for _ in range(47):
        out.append([_applied(out[-1], c) for c in out[-1]])
    return out


def _applied(columns: list[int], value: int) -> int:
    out = 0
    while value:
        low = value & -value
        out ^= columns[low.bit_length() - 1]
        value ^= low
    return out


def _zeros_after(crc: int, n: int) -> int:
    """CRC-32's change by ``n`` bytes that follow, without what these bytes add."""
    for columns in _zero_operators():
        if not n:
            break
        if n & 1:
            crc = _applied(columns, crc)
        n >>= 1
    return crc


def riff(b: Buffer, at: int) -> Found:
    data = b.data
    if len(data) < at + 12:
        return None
    size, kind = struct.unpack_from("<I4s", data, at + 4)
    end = at + 8 + size
    if end > len(data) or kind not in (b"WAVE", b"WEBP", b"AVI "):
        return None

    def step(b: Buffer, here: int):
        if here + 8 > end:
            return (here,)
        n = struct.unpack_from("<I", data, here + 4)[0]
        return here + 8 + n + n % 2

    last = b.chain(f"riff {end}", at + 12, step)
    if last > end + 1:
        return None
    if kind == b"WAVE":
        here, seen = at + 12, set()
        while here + 8 <= end and seen != {b"fmt ", b"data"}:
            name, n = struct.unpack_from("<4sI", data, here)
            seen |= {name} & {b"fmt ", b"data"}
            here += 8 + n + n % 2
        if len(seen) < 2:
            return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[kind], end - at


def png(b: Buffer, at: int) -> Found:
    def step(b: Buffer, here: int):
        if here + 12 > len(b.data):
            return (None,)
        n, name = struct.unpack_from(">I4s", b.data, here)
        if here + 12 + n > len(b.data) or b.crc32(here + 4, here + 8 + n) != struct.unpack_from(">I", b.data, here + 8 + n)[0]:
            return (None,)
        return (here + 12 + n,) if name == b"IEND" else here + 12 + n

    end = b.chain("png", at + 8, step)
    return ("image/png", end - at) if end else None


def gif(b: Buffer, at: int) -> Found:
    data = b.data

    def blocks(b: Buffer, here: int):
        n = data[here] if here < len(data) else None
        return (None,) if n is None else (here + 1,) if not n else here + 1 + n

    def step(b: Buffer, here: int):
        mark = data[here] if here < len(data) else None
        if mark == 0x3B:
            return (here + 1,)
        if mark == 0x2C and here + 10 < len(data):
            flags = data[here + 9]
            here += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        elif mark == 0x21:
            here += 2
        else:
            return (None,)
        return b.chain("gif blocks", here, blocks) or (None,)

    if len(data) < at + 13:
        return None
    packed = data[at + 10]
    end = b.chain("gif", at + 13 + (3 << (packed & 7) + 1 if packed & 128 else 0), step)
    return ("image/gif", end - at) if end else None


def jpeg(b: Buffer, at: int) -> Found:
    """Segments to the start of the scan, then to the first end mark."""

    def step(b: Buffer, here: int):
        if here + 4 > len(b.data) or b.data[here] != 0xFF:
            return (None,)
        mark = b.data[here + 1]
        if mark == 0xDA:
            end = b.following(b"\xff\xd9", here)
            return (end + 2 if end > 0 else None,)
        if not (0xC0 <= mark <= 0xFE) or mark in (0xD8, 0xD9):
            return (None,)
        return here + 2 + struct.unpack_from(">H", b.data, here + 2)[0]

    end = b.chain("jpeg", at + 2, step)
    return ("image/jpeg", end - at) if end else None


def bmp(b: Buffer, at: int) -> Found:
    data = b.data
    if len(data) < at + 54:
        return None
    size, zero, start, header = struct.unpack_from("<IIII", data, at + 2)
    fits = not zero and 54 <= size <= len(data) - at and 40 <= header <= 124 and 14 + header <= start <= size
    return ("image/bmp", size) if fits else None


def _pdf_ends(b: Buffer) -> dict[int, int]:
    """Of each header, the last end mark whose cross-reference offset counts from it; behind headers of
    other documents the table must lie behind these too. Each end mark is tried with the headers,
    or with the tables since the header before it, whichever are fewer."""
    headers, tables = b.places(b"%PDF-"), [m.start() for m in _XREF.finditer(b.data)]
    known, ends = set(headers), {}
    table_set = set(tables)
    for m in _STARTXREF.finditer(b.data):
        offset, end = int(m[1]), m.end()
        h = bisect_left(headers, m.start()) - 1
        if h < 0:
            continue
        last = headers[h]
        low, high = bisect_right(tables, last), bisect_left(tables, m.start())
        first, stop = bisect_right(headers, last - offset), bisect_left(headers, m.start() - offset)
        if high - low <= stop - first:
            fitting = [t - offset for t in tables[low:high] if t - offset in known]
        else:
            fitting = [at for at in headers[first:stop] if last < at + offset and at + offset in table_set]
        for at in fitting:
            if at <= last:
                ends[at] = max(ends.get(at, 0), end)
    return ends


def pdf(b: Buffer, at: int) -> Found:
    """To the last end mark that belongs to the header; without any, as where offsets are wrong, to the
    last end mark before the next header."""
    data = b.data
    if not data[at + 5 : at + 6].isdigit():
        return None
    if end := b.once("pdf", _pdf_ends).get(at):
        return "application/pdf", end - at
    after, marks = b.following(b"%PDF-", at + 5), b.places(b"%%EOF")
    i = bisect_left(marks, after if after > 0 else len(data)) - 1
    start = b.following(b"startxref", at)
    return ("application/pdf", marks[i] + 5 - at) if i >= 0 and at < start < marks[i] else None


def _zip_ends(b: Buffer) -> dict[int, int]:
    """Of each place from which an end record's directory counts, the first record's end."""
    out: dict[int, int] = {}
    for end in b.places(b"PK\x05\x06"):
        if len(b.data) >= end + 22:
            size, start, note = struct.unpack_from("<IIH", b.data, end + 12)
            if end + 22 + note <= len(b.data):
                out.setdefault(end - start - size, end + 22 + note)
    return out


def archive(b: Buffer, at: int) -> Found:
    """To the first end record whose directory counts from ``at``; those of stored archives don't."""
    end = b.once("zip", _zip_ends).get(at, 0)
    return ("application/zip", end - at) if end >= at + 52 else None


def _inflated(data: bytes, at: int) -> tuple[int, int, int]:
    """End, CRC-32 and size of a deflate stream; the end is 0 if it's broken or cut."""
    z, here, crc, size = zlib.decompressobj(-15), at, 0, 0
    try:
        while here < len(data) and not z.eof:
            piece = z.decompress(data[here : here + 65536], 1 << 20)
            here += 65536
            while piece or z.unconsumed_tail:
                crc, size = zlib.crc32(piece, crc), size + len(piece)
                piece = z.decompress(z.unconsumed_tail, 1 << 20)
    except zlib.error:
        return 0, 0, 0
    return (min(here, len(data)) - len(z.unused_data) if z.eof else 0), crc, size & 0xFFFFFFFF


def gzip(b: Buffer, at: int) -> Found:
    data = b.data
    if len(data) < at + 18 or (flags := data[at + 3]) & 0xE0:
        return None
    here = at + 10 + (2 + struct.unpack_from("<H", data, at + 10)[0] if flags & 4 else 0)
    for text in (8, 16):
        if flags & text:
            here = b.following(b"\0", here) + 1
            if not here:
                return None
    here += 2 if flags & 2 else 0
    known = b.memo.setdefault("gzip", {})
    if here not in known:
        known[here] = _inflated(data, here)
    end, crc, size = known[here]
    return ("application/gzip", end + 8 - at) if end and data[end : end + 8] == struct.pack("<II", crc, size) else None


def mp4(b: Buffer, at: int) -> Found:
    """Boxes from the file type on, as long as they follow each other; the index must be among them."""
    data = b.data

    def step(b: Buffer, here: int):
        size = struct.unpack_from(">I", data, here)[0] if here + 8 <= len(data) else 0
        if size == 1 and here + 16 <= len(data):
            size = struct.unpack_from(">Q", data, here + 8)[0]
        if size < 8 or here + size > len(data) or not all(32 <= c < 127 for c in data[here + 4 : here + 8]):
            return (here,)
        if data[here + 4 : here + 8] == b"moov":
            b.memo.setdefault("moov", []).append(here)
        return here + size

    if at < 0 or b.data[at + 8 : at + 9] < b"!":
        return None
    end = b.chain("mp4", at, step)
    return ("video/mp4", end - at) if any(at < x < end for x in b.memo.get("moov", ())) else None


def ogg(b: Buffer, at: int) -> Found:
    """Pages that follow each other, from one that begins a stream."""

    def step(b: Buffer, here: int):
        data = b.data
        if data[here : here + 5] != b"OggS\0" or here + 27 > len(data) or data[here + 5] > 7:
            return (here,)
        n = data[here + 26]
        end = here + 27 + n + sum(data[here + 27 : here + 27 + n])
        return end if here + 27 + n <= len(data) and end <= len(data) else (here,)

    if b.data[at + 5 : at + 6] != b"\2" or b.data[at + 18 : at + 22] != bytes(4):
        return None
    end = b.chain("ogg", at, step)
    return ("audio/ogg", end - at) if end > at else None


# kbit/s of layer III frames by index, of MPEG 1 and of 2; samples a second of MPEG 1.
_KBITS = ((0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))
_HERTZ = (44100, 48000, 32000)


def mp3(b: Buffer, at: int) -> Found:
    """An ID3 tag and the layer III frames behind it, two at least."""

    def step(b: Buffer, here: int):
        head = int.from_bytes(b.data[here : here + 4], "big")
        version, rate, hertz = head >> 19 & 3, head >> 12 & 15, head >> 10 & 3
        if here + 4 > len(b.data) or head >> 21 != 0x7FF or version == 1 or head >> 17 & 3 != 1 or not 0 < rate < 15 or hertz == 3:
            return (here,)
        first = version == 3
        size = (144 if first else 72) * 1000 * _KBITS[not first][rate] // (_HERTZ[hertz] >> (0 if first else 1 if version == 2 else 2)) + (head >> 9 & 1)
        return here + size if here + size <= len(b.data) else (here,)

    tag = b.data[at : at + 10]
    if len(tag) < 10 or not 2 <= tag[3] <= 4 or any(x & 128 for x in tag[6:]):
        return None
    start = at + 10 + (tag[6] << 21 | tag[7] << 14 | tag[8] << 7 | tag[9])
    one = step(b, start) if start < len(b.data) else (0,)
    end = b.chain("mp3", start, step) if not isinstance(one, tuple) else 0
    return ("audio/mpeg", end - at) if end and end > one else None


# Bytes of a TIFF value by type; tags of places and sizes of strips and tiles.
_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_TIFF_PARTS = ((273, 279), (324, 325))


def tiff(b: Buffer, at: int) -> Found:
    """As far as its directories, their values and its strips or tiles reach."""
    data, order = b.data, "<" if b.data[at : at + 1] == b"I" else ">"
    end, here, seen = at + 8, 0, set()

    def values(kind: int, n: int, place: int) -> list[int]:
        return list(struct.unpack_from(f"{order}{n}{'H' if kind == 3 else 'I'}", data, place)) if kind in (3, 4) else []

    try:
        here = struct.unpack_from(f"{order}I", data, at + 4)[0]
        while here:
            if here < 8 or here in seen or len(seen) > 1000:
                return None
            seen.add(here)
            n = struct.unpack_from(f"{order}H", data, at + here)[0]
            found = {}
            for i in range(n):
                tag, kind, many, _ = struct.unpack_from(f"{order}HHII", data, at + here + 2 + 12 * i)
                size = _TIFF_SIZES.get(kind, 0) * many
                place = at + here + 10 + 12 * i if size <= 4 else at + struct.unpack_from(f"{order}I", data, at + here + 10 + 12 * i)[0]
                end = max(end, place + size if size > 4 else end)
                if end > len(data):
                    return None
                if any(tag in pair for pair in _TIFF_PARTS):
                    found[tag] = values(kind, many, place)
            for starts, sizes in _TIFF_PARTS:
                for x, y in zip(found.get(starts, ()), found.get(sizes, ()), strict=False):
                    end = max(end, at + x + y)
            end = max(end, at + here + 6 + 12 * n)
            here = struct.unpack_from(f"{order}I", data, at + here + 2 + 12 * n)[0]
    except struct.error:
        return None
    return ("image/tiff", end - at) if seen and end <= len(data) else None


def _ebml(data: bytes, at: int) -> tuple[int, int]:
    """Value and end of an EBML number; IndexError past the data."""
    size = 9 - data[at].bit_length()
    if size > 8 or at + size > len(data):
        raise IndexError
    return int.from_bytes(data[at : at + size], "big") & (1 << 7 * size) - 1, at + size


def matroska(b: Buffer, at: int) -> Found:
    """The EBML head and the segment behind it; segments of unknown size aren't taken."""
    data = b.data
    try:
        size, here = _ebml(data, at + 4)
        if size > 1024:
            return None
        head, here = data[here : here + size], here + size
        if data[here : here + 4] != b"\x18\x53\x80\x67" or b"\x42\x82" not in head:
            return None
        size, here = _ebml(data, here + 4)
    except IndexError:
        return None
    return ("video/webm" if b"webm" in head else "video/x-matroska", here + size - at) if here + size <= len(data) else None


def _crc(data: bytes, poly: int, bits: int) -> int:
    crc, top = 0, bits - 8
    for b in data:
        crc = crc << 8 & (1 << bits) - 1 ^ _crc_table(poly, bits)[crc >> top ^ b]
    return crc


@cache
def _crc_table(poly: int, bits: int) -> list[int]:
    table = []
    for b in range(256):
        crc = b << bits - 8
        for _ in range(8):
            crc = crc << 1 ^ (poly if crc >> bits - 1 else 0)
            crc &= (1 << bits) - 1
        table.append(crc)
    return table


def _subframe_end(bits: str, at: int, block: int, width: int) -> int:
    """Where a FLAC subframe ends; ValueError if it can't be read to there."""
    kind, wasted = int(bits[at : at + 7], 2), bits[at + 7] == "1"
    at += 8
    if wasted:
        one = bits.index("1", at)
        width, at = width - (one - at + 1), one + 1
    if kind < 2:
        return at + width * (block if kind else 1)
    if not (8 <= kind <= 12 or 32 <= kind <= 63):
        raise ValueError("reserved subframe")
    order = kind - 8 if kind <= 12 else kind - 31
    at += order * width
    if kind >= 32:
        at += 9 + order * (int(bits[at : at + 4], 2) + 1)
    method, parts = int(bits[at : at + 2], 2), int(bits[at + 2 : at + 6], 2)
    at += 6
    if method > 1 or (block >> parts) < order or block % (1 << parts):
        raise ValueError("reserved residual")
    for part in range(1 << parts):
        n, long = (block >> parts) - (0 if part else order), 4 + method
        rice = int(bits[at : at + long], 2)
        at += long
        if rice == (1 << long) - 1:
            at += 5 + n * int(bits[at : at + 5], 2)
        else:
            for _ in range(n):
                at = bits.index("1", at) + 1 + rice
    return at


def _flac_frame(data: bytes, at: int, width: int, most: int) -> tuple[int, int] | None:
    """End and samples of a FLAC frame, with both its checksums right. A frame has ``most`` bytes at
    most if the head says so, else about what its samples have as they are."""
    try:
        if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
            return None
        code, rate, channels, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
        here = at + 5 + max(0, 7 - (data[at + 4] ^ 255).bit_length())
        more = {6: 1, 7: 2}.get(code, 0)
        block = int.from_bytes(data[here : here + more], "big") + 1 if more else 192 if code == 1 else 576 << code - 2 if 2 <= code <= 5 else 256 << code - 8 if code else 0
        here += more + {12: 1, 13: 2, 14: 2}.get(rate, 0)
        width = (width, 8, 12, 0, 16, 20, 24, 32)[depth]
        if not block or not width or channels > 10 or rate == 15 or _crc(data[at:here], 7, 8) != data[here]:
            return None
    except IndexError:
        return None
    here += 1
    widths = [width] * (channels + 1) if channels < 8 else [width + (channels == 9), width + (channels != 9)]
    raw = data[here : here + (most or 64 + block * sum(widths) // 4)]
    bits, end = f"{int.from_bytes(raw, 'big'):0{8 * len(raw)}b}", 0
    try:
        for w in widths:
            end = _subframe_end(bits, end, block, w)
    except (ValueError, IndexError):
        return None
    close = here + -(-end // 8) + 2
    return (close, block) if close <= len(data) and _crc(data[at:close], 0x8005, 16) == 0 else None


def flac(b: Buffer, at: int) -> Found:
    """Frames are read to as many samples as the head says, or to the last one if it doesn't say."""
    data, here, last = b.data, at + 4, 0
    while not last:
        if here + 4 > len(data):
            return None
        last, kind, n = data[here] & 128, data[here] & 127, int.from_bytes(data[here + 1 : here + 4], "big")
        if here == at + 4 and (kind or n != 34) or here + 4 + n > len(data):
            return None
        here += 4 + n
    most, head = int.from_bytes(data[at + 15 : at + 18], "big"), int.from_bytes(data[at + 18 : at + 26], "big")
    width, total, samples = (head >> 36 & 31) + 1, head & (1 << 36) - 1, 0
    frames = b.memo.setdefault(("flac", width, most), {})
    while not total or samples < total:
        if here not in frames:
            frames[here] = _flac_frame(data, here, width, most)
        frame = frames[here]
        if not frame:
            return None if total else ("audio/flac", here - at)
        here, samples = frame[0], samples + frame[1]
    return "audio/flac", here - at


# Magic bytes, the validator of each, and how far into the format they lie.
MAGIC = {
    b"RIFF": (riff, 0), b"\x89PNG\r\n\x1a\n": (png, 0), b"GIF87a": (gif, 0), b"GIF89a": (gif, 0), b"\xff\xd8\xff": (jpeg, 0), b"BM": (bmp, 0),
    b"%PDF-": (pdf, 0), b"PK\x03\x04": (archive, 0), b"\x1f\x8b\x08": (gzip, 0), b"fLaC": (flac, 0), b"ftyp": (mp4, 4), b"OggS": (ogg, 0),
    b"ID3": (mp3, 0), b"II*\0": (tiff, 0), b"MM\0*": (tiff, 0), b"\x1a\x45\xdf\xa3": (matroska, 0),
}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for m in MAGIC:
        a.add_word(m.decode("latin-1"), m)
    a.make_automaton()
    return a


def signatures(data: bytes) -> list[tuple[str, int, int]]:
    """``(type, offset, length)`` of each valid part in order of offsets; what lies within a part
    that is listed is not listed again, but for the parts of the outermost one at offset 0."""
    found, free, buffer = [], 0, Buffer(data)
    for end, magic in _automaton().iter(data.decode("latin-1")):
        validator, before = MAGIC[magic]
        at = end + 1 - len(magic) - before
        if at < free:
            continue
        hit = validator(buffer, at)
        if hit:
            found.append((hit[0], at, hit[1]))
            free = at + hit[1] if at else 0
    return found


def carve(data: bytes, at: int, length: int) -> bytes:
    return data[at : at + length]


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM samples: each byte is one sample, so any bytes are stored without loss."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def wav_parts(data: bytes) -> tuple[int, int, bytes]:
    """Format, bits of a sample and sample bytes of a WAV file."""
    here, end, form, bits = 12, 8 + struct.unpack_from("<I", data, 4)[0], 0, 0
    while here + 8 <= end:
        name, n = struct.unpack_from("<4sI", data, here)
        if name == b"fmt " and n >= 16:
            form, bits = struct.unpack_from("<H", data, here + 8)[0], struct.unpack_from("<H", data, here + 22)[0]
        if name == b"data":
            return form, bits, data[here + 8 : here + 8 + n]
        here += 8 + n + n % 2
    raise ValueError("no data chunk")


def from_wav(data: bytes) -> bytes:
    return wav_parts(data)[2]


def samples_of(payload: bytes, bits: int = 8) -> np.ndarray:
    """Samples around 0: unsigned bytes, or signed little-endian ones of 16, 24 or 32 bits."""
    if bits == 8:
        return np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    wide = np.frombuffer(payload[: len(payload) // (bits // 8) * (bits // 8)], np.uint8).reshape(-1, bits // 8).astype(np.int64)
    value = (wide << 8 * np.arange(bits // 8)).sum(1)
    return np.where(value >= 1 << bits - 1, value - (1 << bits), value)


def features(payload: bytes, bits: int = 8) -> str:
    """Number, entropy, mean, root mean square, peak and crossings of the middle of PCM samples."""
    samples = samples_of(payload, bits)
    if not len(samples):
        return "n=0"
    counts = np.bincount(samples + 128, minlength=256) if bits == 8 else np.unique(samples, return_counts=True)[1]
    share = counts[counts > 0] / len(samples)
    rms = np.sqrt(float((samples.astype(float) ** 2).sum()) / len(samples))
    crossings = int(np.count_nonzero(np.diff(samples >= 0)))
    peak = int(samples.max()) + (128 if bits == 8 else 0)
    return f"n={len(samples)};entropy={-(share * np.log2(share)).sum():.4f};mean={float(samples.sum()) / len(samples):.4f};rms={rms:.4f};peak={peak};crossings={crossings}"


def store_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts in UTF-8, filled with zero bytes to a positive multiple of 64, as WAV media."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [t.encode() for t in texts(batch, text)]
            media = [to_wav(b + bytes(-len(b) % UNIT if b else UNIT)) for b in raw]
            return pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

        return work

    return map_batches(df.select(doc_id, text), make, "doc_id bigint, n_bytes bigint, media binary")


def sniff(df: DataFrame, data: str = "media", declared: str | None = None) -> DataFrame:
    """Adds ``media_type`` (proved, else as declared), ``corrected``, ``embedded`` (type, offset,
    length of the parts further in), ``payload`` (samples read back from PCM audio, else the
    bytes) and ``feature`` of it, by the width of its samples. Columns of these names are replaced."""
    added = "media_type string, corrected boolean, embedded array<struct<kind:string,offset:bigint,length:bigint>>, payload binary, feature string"
    df = df.drop("media_type", "corrected", "embedded", "payload", "feature")
    schema = schema_with(df, added)

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            said = batch.column(declared).to_pylist() if declared else [None] * batch.num_rows
            out = []
            for bytes_, was in zip(batch.column(data).to_pylist(), said, strict=True):
                raw = bytes_ or b""
                parts = signatures(raw)
                proved = parts[0][0] if parts and parts[0][1] == 0 else was
                payload, bits = raw, 8
                if parts and parts[0][:2] == ("audio/wav", 0):
                    form, width, samples = wav_parts(raw)
                    if form == 1 and width in (8, 16, 24, 32):
                        payload, bits = samples, width
                inner = [dict(zip(("kind", "offset", "length"), p, strict=True)) for p in parts if p[1]]
                out.append((proved, proved != was, inner, payload, features(payload, bits)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.bool_(), kind, pa.binary(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "media_type", "corrected", "embedded", "payload", "feature"])

        return work

    return map_batches(df, make, schema)
