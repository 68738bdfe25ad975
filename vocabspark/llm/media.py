"""Signature sniffing of media columns: magic bytes, validators, declared types and carving.

One Aho-Corasick automaton finds the magic bytes of all formats in one pass over a byte string. At each place a validator of the format
follows its structure, chunk by chunk, and gives the length of the whole object or nothing; only
confirmed objects count. The object that begins at 0 and fills the bytes gives the value's type, whatever was
declared; others are embedded and can be carved out.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, map_rows

UNKNOWN = "application/octet-stream"


def _png(b: bytes, at: int) -> int | None:
    pos = at + 8
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + n
        if end > len(b) or (pos == at + 8) != (kind == b"IHDR") or zlib.crc32(memoryview(b)[pos + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end
        pos = end
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos = at + 2
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        marker = b[pos + 1]
        if marker == 0xFF:
            pos += 1
            continue
        if marker == 0xD9:
            return pos + 2
        n = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if n < 2 or marker in (0x00, 0x01) or 0xD0 <= marker <= 0xD8 or pos + 2 + n > len(b):
            return None
        pos += 2 + n
        if marker == 0xDA:  # entropy-coded data up to the next marker that isn't stuffed or a restart
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
    return pos + 2 if b[pos : pos + 2] == b"\xff\xd9" else None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1
        if b[pos] == 0x2C:
            if pos + 10 > len(b):
                return None
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0)
        elif b[pos] == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, zero, data, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    ok = zero == 0 and header in (40, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= data <= size
    return at + size if ok and at + size <= len(b) else None


def _riff(b: bytes, at: int) -> int | None:
    size, kind = int.from_bytes(b[at + 4 : at + 8], "little"), b[at + 8 : at + 12]
    end, pos, names = at + 8 + size, at + 12, []
    if kind not in (b"WAVE", b"WEBP") or end > len(b):
        return None
    while pos + 8 <= end:
        n = int.from_bytes(b[pos + 4 : pos + 8], "little")
        names.append(b[pos : pos + 4])
        pos += 8 + n + n % 2
    ok = names[:1] == [b"fmt "] and b"data" in names if kind == b"WAVE" else bool(names) and names[0] in (b"VP8 ", b"VP8L", b"VP8X")
    return end if ok and pos in (end, end + 1) else None


_PDF_END = re.compile(rb"startxref\s+([0-9]{1,12})\s+%%EOF")
_PDF_TABLE = re.compile(rb"xref\b|[0-9]+\s+[0-9]+\s+obj\b")
_BLANKS = re.compile(rb"[\0\t\n\f\r ]*")


class Places:
    """Where marks stand in some bytes; each mark is looked for once, however often it is asked for."""

    def __init__(self, b: bytes) -> None:
        self.b, self.of = b, {}
        #: Places from which a deflate stream could not be read.
        self.unread: set[int] = set()

    def after(self, mark: bytes, at: int) -> int:
        """The first place of `mark` at or after `at`, -1 if there is none."""
        if mark not in self.of:
            self.of[mark] = [m.start() for m in re.finditer(re.escape(mark), self.b)]
        found = self.of[mark]
        i = bisect_left(found, at)
        return found[i] if i < len(found) else -1


def _pdf(b: bytes, at: int, places: Places) -> int | None:
    """Up to the last %%EOF whose startxref leads to a table of this file: linearised and updated files have several."""
    end = places.after(b"%%EOF", at)
    if end < 0 or not b[at + 5 : at + 6].isdigit() or not 0 <= places.after(b"startxref", at) <= end - 9:
        return None
    end += 5
    for m in _PDF_END.finditer(b, end):
        table = int(m[1])
        inner = b.rfind(b"%PDF-", end, m.start())
        if at + table < m.start() and _PDF_TABLE.match(b, at + table) and not (inner >= 0 and _PDF_TABLE.match(b, inner + table)):
            end = m.end()
    blanks = _BLANKS.match(b, end).end()
    while blanks < len(b) and blanks > end and b[blanks - 1] not in b"\r\n":  # before other bytes, line ends only
        blanks -= 1
    return blanks


def _zip(b: bytes, at: int, places: Places) -> int | None:
    end = places.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    whole = at + start + size == end and b[at + start : at + start + 4] == b"PK\x01\x02"
    return end + 22 + note if whole and end + 22 + note <= len(b) else None


def _gzip(b: bytes, at: int, places: Places) -> int | None:
    if at + 18 > len(b) or (flags := b[at + 3]) & 0xE0:
        return None
    begin = at + 10 + (2 + int.from_bytes(b[at + 10 : at + 12], "little") if flags & 4 else 0)
    for flag in (8, 16):  # name and comment end with a zero
        if flags & flag:
            begin = places.after(b"\0", begin) + 1
            if not begin:
                return None
    if begin in places.unread:
        return None
    reader, pos, step = zlib.decompressobj(31), at, 1024
    try:
        while not reader.eof:
            part = reader.unconsumed_tail or b[pos : pos + step]
            pos += 0 if reader.unconsumed_tail else len(part)
            step = min(2 * step, 65536)
            if not part:
                break
            reader.decompress(part, 1 << 20)
    except zlib.error:
        pass
    if reader.eof:
        return pos - len(reader.unused_data)
    if not flags & 2:  # else the header's own checksum may be what is wrong
        places.unread.add(begin)
    return None


def _ogg(b: bytes, at: int) -> int | None:
    pos, last = at, False
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0 and not last:
        table = b[pos + 27 : pos + 27 + b[pos + 26]]
        last, pos = bool(b[pos + 5] & 4), pos + 27 + b[pos + 26] + sum(table)
    return pos if pos > at and pos <= len(b) else None


# The formats' magic bytes.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        made.add_word(magic.decode("latin-1"), (i, len(magic)))
    made.make_automaton()
    return made


#: Validators that look for something far ahead.
_SEARCHING = (_pdf, _zip, _gzip)


def objects(data: bytes) -> tuple[list[tuple[int, int, str]], int]:
    """The confirmed objects (start, end, type) in order, none inside another, and how many magic bytes were not confirmed."""
    found, rejected, over, places = [], 0, 0, Places(data)
    # matches end in order; those that start earlier and end later still start first, as no magic holds another
    for last, (i, length) in _automaton().iter(data.decode("latin-1")):
        start = last + 1 - length
        if start < over:
            continue
        _, kind, validate = FORMATS[i]
        end = validate(data, start, places) if validate in _SEARCHING else validate(data, start)
        if end is None:
            rejected += 1
            continue
        if kind == "audio/wav" and data[start + 8 : start + 12] == b"WEBP":
            kind = "image/webp"
        found.append((start, end, kind))
        over = end
    return found, rejected


def sniff(data: bytes, declared: str | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The bytes' type, and the objects embedded in them. Without a confirmed object at 0 that fills them: what was declared, unless
    that is a type with a validator, which the bytes then contradict."""
    found, _ = objects(data)
    if found and found[0][:2] == (0, len(data)):
        return found[0][2], []
    known = {kind for _, kind, _ in FORMATS} | {"image/webp"}
    return (declared if declared and declared not in known else UNKNOWN), found


ROW = 192  # bytes of an image row: 64 pixels of three 8-bit samples


def store(payload: bytes) -> bytes:
    """The payload's bytes, a positive multiple of ROW, as the samples of a PNG image."""
    samples = np.zeros((len(payload) // ROW, ROW + 1), dtype=np.uint8)
    samples[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", ROW // 3, len(samples), 8, 2, 0, 0, 0)
    return FORMATS[0][0] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(samples.tobytes(), 1)) + chunk(b"IEND", b"")


def is_own(stored: bytes) -> bool:
    """Whether the bytes are an image of the width and kind that `store` makes."""
    return stored[12:16] == b"IHDR" and struct.unpack(">I", stored[16:20])[0] == ROW // 3 and stored[24:29] == bytes((8, 2, 0, 0, 0))


def read(stored: bytes) -> bytes:
    """The samples of an image that `store` made."""
    pos, body = 8, []
    while pos + 12 <= len(stored):
        n, kind = struct.unpack_from(">I4s", stored, pos)
        if kind == b"IDAT":
            body.append(stored[pos + 8 : pos + 8 + n])
        pos += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(-1, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Samples' mean, spread and entropy, and the media found among them."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float((counts * np.arange(256)).sum()) / len(payload)
    spread = math.sqrt(max(0.0, float((counts * (np.arange(256) - mean) ** 2).sum()) / len(payload)))
    found, rejected = objects(payload)
    inside = "+".join(f"{kind}@{start}:{end}" for start, end, kind in found) or "none"
    return f"rows={len(payload) // ROW};mean={mean:.6f};spread={spread:.6f};entropy={float(-(share * np.log2(share)).sum()):.6f};unconfirmed={rejected};embedded={inside}"


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes and blanks up to a positive multiple of ROW, and its own length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(1, -(-len(data) // ROW)) * ROW - len(data)), len(data)


def store_texts(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """`keep` columns, media (a PNG image of the padded text), declared (a type that says nothing) and n_bytes of every row.

    A null text counts as empty. Each row is stored by itself: equal texts have equal values, an empty table gives an empty one.
    """

    def one(text):
        payload, n = padded(text)
        return store(payload), UNKNOWN, n

    docs, (text_col, *keep), back = aside(docs, text_col, *keep)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    return back(map_rows(rows, keep, lambda: one, [("media", T.BinaryType()), ("declared", T.StringType()), ("n_bytes", T.LongType())]))


def describe(table: DataFrame, keep: list[str], media_col: str, declared_col: str) -> DataFrame:
    """`keep` columns, type (corrected), was_wrong, carved (embedded objects), and of images that `store` made the payload's figures.

    Null media have nulls throughout. Every value is read whole and by itself.
    """

    def one(media, declared):
        if media is None:
            return (None,) * 8
        kind, embedded = sniff(media, declared)
        listed = [f"{k}@{s}:{e}" for s, e, k in embedded]
        if kind != "image/png" or not is_own(media):
            return kind, kind != declared, listed, None, None, None, hashlib.sha256(media).hexdigest(), None
        payload = read(media)
        return kind, kind != declared, listed, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media).hexdigest(), features(payload)

    text, whole = T.StringType(), T.LongType()
    fields = [("type", text), ("was_wrong", T.BooleanType()), ("carved", T.ArrayType(text)), ("payload_bytes", whole), ("payload_sha256", text), ("tail_crc32", whole), ("media_sha256", text), ("feature", text)]
    table, (media_col, declared_col, *keep), back = aside(table, media_col, declared_col, *keep)
    return back(map_rows(table.select(*keep, F.col(media_col).alias("__media"), F.col(declared_col).alias("__declared")), keep, lambda: one, fields))


def carve(table: DataFrame, keep: list[str], media_col: str) -> DataFrame:
    """One row for each object confirmed in a value: `keep` columns, type, at, data. Values without any, and nulls, give no row."""

    def one(media):
        return ([f"{s}:{e}:{k}" for s, e, k in objects(media)[0]] if media is not None else [],)

    table, (media_col, *keep), back = aside(table, media_col, *keep)
    found = map_rows(table.select(*keep, F.col(media_col).alias("__media"), F.col(media_col).alias("__bytes")), [*keep, "__bytes"], lambda: one, [("__found", T.ArrayType(T.StringType()))])
    each = found.select(*keep, "__bytes", F.explode("__found").alias("__o")).withColumn("__o", F.split("__o", ":", 3))
    at, end = F.element_at("__o", 1).cast("int"), F.element_at("__o", 2).cast("int")
    return back(each.select(*keep, F.element_at("__o", 3).alias("type"), at.cast("long").alias("at"), F.substring("__bytes", at + 1, end - at).alias("data")))
