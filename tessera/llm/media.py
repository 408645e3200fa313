"""Media columns: signature sniffing.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass. For each hit a validator of
the format walks its structure and returns its length, or nothing if the structure is broken. A valid hit
at offset 0 gives the content's type, which corrects the declared one; valid hits further on are carved.

Nulls: a null content has no type and no parts. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import map_rows, read_documents

BLOCK = 64
#: Start and end of a PDF file, and what the offset in its end leads to: a table or a stream's object.
PDF_HEADER = re.compile(rb"%PDF-[12]\.")
PDF_END = re.compile(rb"startxref\s+(\d{1,19})\s+%%EOF")
PDF_TABLE = re.compile(rb"xref\s|(?<!\d)\d{1,10}\s{1,9}\d{1,5}\s{1,9}obj")
#: Boxes of ISO media files that may have no size of their own and reach to the end.
LAST_BOXES = frozenset((b"mdat", b"moov", b"meta", b"moof", b"mfra", b"free", b"skip", b"uuid"))


#: What validators have found out about one content: by kind, the result of a chain of chunks, pages, blocks or boxes from a place on.
_known: list = [None, {}]


def _memo(b: bytes, kind: str) -> dict:
    """The results of a kind of chain in b, for as long as b is the content that is looked at."""
    if _known[0] is not b:
        _known[:] = [b, {}]
    return _known[1].setdefault(kind, {})


def _follow(known: dict, p: int, step):
    """The result of the chain from p. step(p) gives (None, result) at its end, or (the next place, what makes this one's result of that one's, or None).

    A chain is the same from any place that it passes, so each place is looked at once, however many chains lead to it.
    """
    path = []
    while p not in known:
        path.append((p, made := step(p)))
        if made[0] is None:
            result = made[1]
            break
        p = made[0]
    else:
        result = known[p]
    for q, (onward, fold) in reversed(path):
        if onward is not None and fold:
            result = fold(result)
        known[q] = result
    return result


class Crc:
    """CRC-32 of any part of some bytes, in time that doesn't grow with the part, from those of the bytes before marks."""

    STEP, POLY = 4096, 0xEDB88320

    def __init__(self, b: bytes):
        self.b, self.before, self.powers = b, [0], [1 << 23]  # x^8, x^16, x^32, ...
        for at in range(0, len(b), self.STEP):
            self.before.append(zlib.crc32(b[at : at + self.STEP], self.before[-1]))
        while len(self.powers) < 64:
            self.powers.append(self._times(self.powers[-1], self.powers[-1]))

    @classmethod
    def _times(cls, x: int, y: int) -> int:
        """Product of two polynomials, bits in reflected order, modulo that of CRC-32."""
        out = 0
        for bit in range(31, -1, -1):
            if x >> bit & 1:
                out ^= y
            y = y >> 1 ^ (cls.POLY if y & 1 else 0)
        return out

    def _prefix(self, at: int) -> int:
        mark = at // self.STEP
        return zlib.crc32(self.b[mark * self.STEP : at], self.before[mark])

    def of(self, start: int, end: int) -> int:
        if end - start <= 4 * self.STEP:
            return zlib.crc32(self.b[start:end])
        moved, n, k = self._prefix(start), end - start, 0
        while n:
            if n & 1:
                moved = self._times(self.powers[k], moved)
            n, k = n >> 1, k + 1
        return self._prefix(end) ^ moved


@lru_cache(maxsize=1)
def wav_files(b: bytes) -> dict[int, tuple[int, int, int]]:
    """Start of each RIFF WAVE file to (end, start of samples, end of samples).

    Chunks lead to one another whatever file they are in; a file is the part of a chain up to its own end. Files are looked
    at in the order of their ends, and chunks that are wholly before the end join what follows them, so each is passed once.
    """
    heads = [m.start() for m in re.finditer(rb"RIFF(?=.{4}WAVE)", b, re.DOTALL)]
    asked = sorted((end, at) for at in heads if (end := at + 8 + struct.unpack_from("<I", b, at + 4)[0]) <= len(b))
    chunk: dict[int, int] = {}
    for _, at in asked:
        p = at + 12
        while p not in chunk and p + 8 <= len(b):
            chunk[p] = struct.unpack_from("<I", b, p + 4)[0]
            p += 8 + chunk[p] + chunk[p] % 2
    # By chunk that has joined: the one that follows, and the last chunk, data chunk and format chunk on the way there.
    joined: dict[int, tuple] = {}

    def follow(p: int) -> tuple:
        path, last, data, fmt = [], None, None, None
        while p in joined:
            path.append(p)
            p = joined[p][0]
        for q in reversed(path):
            _, own, own_data, own_fmt = joined[q]
            last, data, fmt = (last if last is not None else own), (data if data is not None else own_data), (fmt if fmt is not None else own_fmt)
            joined[q] = (p, last, data, fmt)
        return p, last, data, fmt

    found, order, done = {}, sorted(chunk), 0
    for end, at in asked:
        while done < len(order) and order[done] + 8 <= end:
            p, done = order[done], done + 1
            n, name = chunk[p], b[p : p + 4]
            joined[p] = (p + 8 + n + n % 2, p, p if name == b"data" else None, p if name == b"fmt " and n >= 16 else None)
        _, last, data, fmt = follow(at + 12)
        if last is not None and last + 8 + chunk[last] <= end and data is not None and fmt is not None and struct.unpack_from("<H", b, fmt + 10)[0]:
            found[at] = (end, data + 8, data + 8 + chunk[data])
    return found


def wav(b: bytes, at: int) -> tuple[int, int, int] | None:
    """(end, start of samples, end of samples) of a RIFF WAVE file; None if it isn't one."""
    return wav_files(b).get(at) if b[at + 8 : at + 12] == b"WAVE" else None


def png(b: bytes, at: int) -> tuple[int, int, int] | None:
    known = _memo(b, "png")
    if b[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return None
    if "crc" not in known:
        known["crc"] = Crc(b)
    crc = known["crc"]

    def step(p: int):
        if p + 12 > len(b):
            return None, None
        n = struct.unpack_from(">I", b, p)[0]
        if p + 12 + n > len(b) or crc.of(p + 4, p + 8 + n) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None, None
        return (None, p) if b[p + 4 : p + 8] == b"IEND" else (p + 12 + n, None)

    end = _follow(known, at + 8, step)
    return None if end is None else (end + 12, at + 8, end)


def gif(b: bytes, at: int) -> tuple[int, int, int] | None:
    if b[at + 3 : at + 6] not in (b"87a", b"89a") or at + 13 > len(b):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    parts = _memo(b, "gif parts")

    def part(p: int):
        return (None, p + 1) if p >= len(b) or not b[p] else (p + b[p] + 1, None)

    def step(p: int):
        if p >= len(b):
            return None, None
        if b[p] == 0x3B:
            return None, p
        if b[p] == 0x21:
            return _follow(parts, p + 2, part), None
        if b[p] == 0x2C and p + 10 <= len(b):
            return _follow(parts, p + 11 + table(b[p + 9]), part), None
        return None, None

    start = at + 13 + table(b[at + 10])
    end = _follow(_memo(b, "gif"), start, step)
    return None if end is None else (end + 1, start, end)


@lru_cache(maxsize=1)
def jpeg_marks(b: bytes) -> list[int]:
    """Places in scan data that aren't: markers other than stuffed bytes and restarts."""
    return [m.start() for m in re.finditer(rb"\xff[^\x00\xd0-\xd7]", b, re.DOTALL)]


def jpeg(b: bytes, at: int) -> tuple[int, int, int] | None:
    marks = jpeg_marks(b)

    def step(p: int):
        if p + 4 > len(b) or b[p] != 0xFF:
            return None, None
        kind, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or kind in (0, 0xFF):
            return None, None
        if kind != 0xDA:
            return p + 2 + n, None
        k = bisect_left(marks, p + 2 + n)
        if k == len(marks):
            return None, None
        return (None, marks[k]) if b[marks[k] + 1] == 0xD9 else (marks[k], None)

    end = _follow(_memo(b, "jpeg"), at + 2, step)
    return None if end is None else (end + 2, at + 2, end)


def bmp(b: bytes, at: int) -> tuple[int, int, int] | None:
    if at + 30 > len(b):
        return None
    size, reserved, offset, head = struct.unpack_from("<IIII", b, at + 2)
    ok = not reserved and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= offset <= size and at + size <= len(b)
    return (at + size, at + offset, at + size) if ok else None


@lru_cache(maxsize=1)
def pdf_ends(b: bytes) -> dict[int, int]:
    """Start of each PDF file to the end of its last end mark: updates, and the first part of a linearised file, have one too.

    A mark is that of the nearest header before it from which its startxref leads to a cross-reference; if there
    is none, that of the nearest header. So files that follow each other and files stored in others are told apart.
    A header that has no mark of its own ends with the first end of file after a startxref.
    """
    heads, ends = [m.start() for m in PDF_HEADER.finditer(b)], {}
    table = np.zeros(len(b) + 1 if heads else 0, bool)
    if heads:
        table[[m.start() for m in PDF_TABLE.finditer(b)]] = True
    places = np.array(heads, np.int64)
    for m in PDF_END.finditer(b) if heads else ():
        offset, near = int(m[1]), bisect_left(heads, m.start())
        if near:
            own = heads[near - 1]
            # The headers before the mark from which the offset leads to a place before it, the nearest ones first.
            low, high = 0, min(near, bisect_left(heads, m.start() - offset)) if offset else 0
            while high > low:
                block = places[max(low, high - 4096) : high]
                there = np.flatnonzero(table[block + offset])
                if len(there):
                    own = int(block[there[-1]])
                    break
                high -= len(block)
            if own + offset < m.start():
                ends[own] = m.end()
    marks, eofs = ([m.start() for m in re.finditer(x, b)] for x in (b"startxref", b"%%EOF"))
    for at in heads:
        k = bisect_left(marks, at)
        j = bisect_left(eofs, marks[k]) if k < len(marks) else len(eofs)
        if at not in ends and j < len(eofs):
            ends[at] = eofs[j] + 5
    return ends


def pdf(b: bytes, at: int) -> tuple[int, int, int] | None:
    end = pdf_ends(b).get(at)
    return (end, at, end) if end else None


@lru_cache(maxsize=1)
def archive_ends(b: bytes) -> dict[int, tuple[int, int]]:
    """Start of each ZIP file, as its end record gives it, to (end, start of the directory). A stored ZIP file has an end record too."""
    ends, end = {}, b.find(b"PK\x05\x06")
    while 0 <= end <= len(b) - 22:
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        start = end - size - offset
        if start >= 0 and end + 22 + note <= len(b) and (not size or b[start + offset : start + offset + 4] == b"PK\x01\x02"):
            ends.setdefault(start, (end + 22 + note, start + offset))
        end = b.find(b"PK\x05\x06", end + 4)
    return ends


def archive(b: bytes, at: int) -> tuple[int, int, int] | None:
    """A ZIP file: local entries, then a directory whose end record gives matching offsets."""
    found = archive_ends(b).get(at)
    return (found[0], at, found[1]) if found else None


def ogg(b: bytes, at: int) -> tuple[int, int, int] | None:
    def step(p: int):
        if b[p : p + 4] != b"OggS" or p + 27 > len(b) or b[p + 4]:
            return None, None
        head = p + 27 + b[p + 26]
        end = head + sum(b[p + 27 : head])
        if end > len(b):
            return None, None
        return (None, end) if b[p + 5] & 4 else (end, None)

    end = _follow(_memo(b, "ogg"), at, step)
    return None if end is None else (end, at, end)


def boxes(b: bytes, at: int) -> tuple[int, int, int] | None:
    """An ISO media file; the magic 'ftyp' stands 4 bytes after the start."""

    def step(p: int):
        n, name = struct.unpack_from(">I4s", b, p) if p + 8 <= len(b) else (0, b"")
        least = 8
        if n == 1 and p + 16 <= len(b):  # a size of 64 bits
            n, least = struct.unpack_from(">Q", b, p + 8)[0], 16
        elif n == 0 and name in LAST_BOXES:  # up to the end
            n = len(b) - p
        if n < least or p + n > len(b) or not name.isalnum():
            return None, (p, False)
        return p + n, (lambda rest: (rest[0], True)) if name in (b"moov", b"meta") else None

    end, whole = _follow(_memo(b, "boxes"), at, step)
    return (end, at, end) if whole else None


#: Magic bytes, offset of the magic in the file, media type, validator.
FORMATS = [
    (b"RIFF", 0, "audio/wav", wav),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", png),
    (b"GIF8", 0, "image/gif", gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", jpeg),
    (b"BM", 0, "image/bmp", bmp),
    (b"%PDF-", 0, "application/pdf", pdf),
    (b"PK\x03\x04", 0, "application/zip", archive),
    (b"OggS", 0, "audio/ogg", ogg),
    (b"ftyp", 4, "video/mp4", boxes),
]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (magic, *_) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), i)
    found.make_automaton()
    return found


def sniff(content: bytes, machine) -> list[tuple[int, str, int, int, int]]:
    """Valid files in the content, by offset: (offset, type, end, start of body, end of body).

    Hits inside the body of the file at offset 0 are reported too; of other hits that overlap, the first.
    """
    found, free = [], 1
    for last, i in machine.iter(content.decode("latin-1")):
        magic, shift, kind, check = FORMATS[i]
        at = last + 1 - len(magic) - shift
        if at < 0 or 0 < at < free:
            continue
        ok = check(content, at)
        if ok:
            found.append((at, kind, *ok))
            free = max(free, ok[0]) if at else free
    return found


def carve(df: DataFrame, content_col: str = "media") -> DataFrame:
    """The embedded files of sniff_media's rows as rows of their own: the other columns of df, offset, part_type and part (the bytes).

    Rows without embedded files give none. Columns of these names in df are replaced.
    """
    keep = [c for c in df.columns if c not in ("offset", "part_type", "part", "embedded", content_col)]
    x = df.select(*keep, F.col(content_col).alias("_content"), F.explode("embedded").alias("_part"))
    part = F.substring(F.col("_content"), (F.col("_part.offset") + 1).cast("int"), F.col("_part.length").cast("int"))
    return x.select(*keep, F.col("_part.offset").alias("offset"), F.col("_part.media_type").alias("part_type"), part.alias("part"))


PARTS = "array<struct<offset:long,media_type:string,length:long>>"


def sniff_media(df: DataFrame, content_col: str = "media", declared_col: str | None = None) -> DataFrame:
    """The rows of df with media_type, corrected (declared is another type), valid_bytes, body_start, body_end and embedded parts.

    media_type falls back to the declared type, or null, if nothing valid starts at offset 0. Columns of these names in df are replaced.
    """
    new = ("media_type", "corrected", "valid_bytes", "body_start", "body_end", "embedded")
    keep = [f for f in df.schema.fields if f.name not in new]
    at, names = [f.name for f in keep].index(content_col), [f.name for f in keep]
    declared = names.index(declared_col) if declared_col else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + f", media_type string, corrected boolean, valid_bytes long, body_start long, body_end long, embedded {PARTS}"

    def per_row():
        machine = automaton()

        def run(*row):
            content, said = row[at], row[declared] if declared is not None else None
            found = sniff(bytes(content), machine) if content else []
            top = next((x for x in found if x[0] == 0), None)
            inner = [{"offset": x[0], "media_type": x[1], "length": x[2] - x[0]} for x in found if x[0]]
            if not top:
                return (*row, said, False, None, None, None, inner)
            return (*row, top[1], said is not None and said != top[1], top[2], top[3], top[4], inner)

        return run

    return map_rows(df.select(*names), per_row, schema)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as the 8-bit samples of a mono WAV file; its length is even."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_bytes, media, declared: each text, padded with zero bytes to a positive multiple of 64, as a WAV file.

    The declared type is the generic one that stores give to unnamed bytes, for sniffing to correct.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def per_row():
        def run(key, text):
            data = text.encode("utf-8", "surrogatepass") if text else b""
            return key, len(data), to_wav(data + bytes(-len(data) % BLOCK if data else BLOCK)), "application/octet-stream"

        return run

    return map_rows(docs.select(id_col, text_col), per_row, f"`{id_col}` {kind}, n_bytes long, media binary, declared string")


def op2_media_sniffing(spark, sf_dir: str) -> DataFrame:
    """Store every text as 8-bit audio samples, sniff the stored bytes, and read the payload back from where sniffing found it."""
    media = sniff_media(encode_media(read_documents(spark, sf_dir)), "media", "declared")

    def per_row():
        def run(key, n, media, kind, corrected, valid, start, end, embedded):
            payload = media[start:end]
            feature = f"{kind};corrected={str(corrected).lower()};valid={valid};body={start}-{end};embedded={len(embedded)}"
            return key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature

        return run

    kind = media.schema["doc_id"].dataType.simpleString()
    rows = media.select("doc_id", "n_bytes", "media", "media_type", "corrected", "valid_bytes", "body_start", "body_end", "embedded")
    return map_rows(rows, per_row, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
