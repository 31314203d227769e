"""Image containers: recognise, inspect and strip metadata.

Each format has one walker that yields its units (chunks, segments, boxes, blocks, directories); inspection and stripping are
folds over the units. Parsers are pure Python over ``memoryview`` and ``struct`` and run in Arrow batches; a file that cannot
be parsed is a row with an error, never a failed job. Recognition and the size guard are native expressions, so other files
are not read by Python.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C


def hints_in(data: bytes, needles: list[str] = C.ALL_HINTS) -> list[str]:
    """The needles that occur, in list order, without regard to case."""
    low = bytes(data).lower()
    return [n for n in needles if n.lower().encode("latin-1") in low]


def _strong(hits: list[str], names: list[str]) -> bool:
    return any(h.lower() in names for h in hits)


def some(hits: list[str], n: int = 8) -> str:
    return ", ".join(hits[:n])


class Report:
    """What inspection has found so far."""

    def __init__(self):
        self.findings: list[str] = []
        self.c2pa = self.ai = False

    def say(self, line: str, hits: list[str] | None = None, strong: list[str] | None = None, c2pa: bool = False) -> None:
        self.findings.append(line)
        self.ai |= bool(hits)
        self.c2pa |= c2pa or bool(hits and strong and _strong(hits, strong))

    def scan_rest(self, data: bytes) -> None:
        """The whole file's C2PA markers count only if nothing has said so yet."""
        if not self.c2pa and (hits := hints_in(data, C.C2PA_MARKERS)):
            self.say(f"byte-scan C2PA markers: {some(hits, 6)}", c2pa=True)


def sniff(data: bytes) -> str:
    """Format by signature."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:2] == b"\xff\xd8":
        return "jpeg"
    if len(data) >= 12 and data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if len(data) >= 12 and data[4:8] == b"ftyp":
        size = struct.unpack_from(">I", data)[0]
        brands = data[8 : min(size if size >= 8 else 64, 64)].decode("latin-1")
        if any(b in brands for b in C.AVIF_BRANDS):
            return "avif"
        if any(b in brands for b in C.HEIC_BRANDS):
            return "heic"
    if data[:2] == b"BM":
        return "bmp"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    return "tiff" if tiff_layout(data) else "unknown"


def sniff_column(content: Column) -> Column:
    """``sniff`` as a native expression over a binary column."""
    head = lambda n: F.substring(content, 1, n)
    size = F.conv(F.hex(head(4)), 16, 10).cast("long")
    end = F.when(size >= 8, F.least(size, F.lit(64))).otherwise(64).cast("int")
    brands = F.decode(F.substr(content, F.lit(9), F.greatest(F.lit(0), end - 8)), "ISO-8859-1")
    is_in = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda b: F.contains(brands, b))
    box = (F.octet_length(content) >= 12) & (F.hex(F.substring(content, 5, 4)) == b"ftyp".hex().upper())
    sig = lambda n, *hexes: F.hex(head(n)).isin(list(hexes))
    return (
        F.when(sig(8, "89504E470D0A1A0A"), "png").when(sig(2, "FFD8"), "jpeg").when(sig(4, "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")
        .when(box & is_in(C.AVIF_BRANDS), "avif").when(box & is_in(C.HEIC_BRANDS), "heic").when(sig(2, "424D"), "bmp").when(sig(6, "474946383761", "474946383961"), "gif")
        .when(sig(4, "49492A00", "4D4D002A", "49492B00", "4D4D002B"), "tiff").otherwise("unknown")
    )


# PNG ------------------------------------------------------------------------------------------------


def png_chunks(data: bytes) -> Iterator[tuple[str, bytes | None, int, int]]:
    """(type, payload, start, end); a payload of None: the file breaks off in this chunk."""
    at = 8
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        kind, end = name.decode("latin-1"), at + 12 + size
        if end > len(data):
            yield kind, None, at, len(data)
            return
        yield kind, data[at + 8 : end - 4], at, end
        if kind == "IEND":
            return
        at = end


def inflate(data: bytes) -> bytes | None:
    """Decompressed bytes, zlib header or raw; None if malformed or beyond the cap."""
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        try:
            d = zlib.decompressobj(bits)
            out = d.decompress(data, C.INFLATE_CAP + 1)
            return out if d.eof and len(out) <= C.INFLATE_CAP else None
        except zlib.error:
            continue
    return None


def png_text(kind: str, payload: bytes) -> list[tuple[str, str]]:
    """Key and value of a text chunk; nothing if it cannot be read."""
    key, nul, rest = payload.partition(b"\0")
    if not nul:
        return []
    name = key.decode("latin-1")
    if kind == "tEXt":
        return [(name, rest.decode("latin-1"))]
    if kind == "zTXt":
        raw = inflate(rest[1:]) if len(rest) > 1 else None
        return [] if raw is None else [(name, raw.decode("latin-1"))]
    parts = rest[2:].split(b"\0", 2) if len(rest) >= 4 else []
    if len(parts) < 3:
        return []
    raw = inflate(parts[2]) if rest[0] == 1 else parts[2]
    return [] if raw is None else [(name, raw.decode("utf-8", "replace"))]


def _png_marks(kind: str, payload: bytes) -> tuple[list[str], list[str]]:
    """Hints of a text chunk, raw or decoded, and generator names in the values of generator keys."""
    if kind == "eXIf":
        return hints_in(payload), []
    entries = png_text(kind, payload)
    hits = hints_in(payload + b"\n" + "\n".join(v for _, v in entries).encode("utf-8", "replace"))
    made = [f"{k.strip()}={g}" for k, v in entries if k.strip().lower() in C.GENERATOR_KEYS for g in C.GENERATORS if g.lower() in v.lower()]
    return hits, made


_PNG_TEXT = ("tEXt", "zTXt", "iTXt")


def inspect_png(data: bytes, r: Report) -> None:
    for kind, payload, _, _ in png_chunks(data):
        if payload is None:
            r.say(f"truncated chunk b'{kind}'")
            break
        if kind in ("caBX", "juMB", "jumb") or kind.startswith("c2"):
            r.say(f"PNG chunk {kind} (possible C2PA container)", c2pa=True)
        if kind in (*_PNG_TEXT, "eXIf"):
            hits, made = _png_marks(kind, payload)
            told = [some(hits)] * bool(hits) + [f"AI generator ({some(made)})"] * bool(made)
            if told:
                r.say(f"PNG {kind}: {'; '.join(told)}", hits + made, C.STRONG_CORE)
    r.scan_rest(data)


def strip_png(data: bytes, everything: bool) -> tuple[bytes, list[str]]:
    out, actions = [data[:8]], []
    for kind, payload, start, end in png_chunks(data):
        why = ""
        if payload is None:
            actions.append(f"kept {len(data) - start} bytes of truncated chunk {kind} tail (file truncated)")
        elif kind in ("eXIf", "caBX") or kind.startswith("c2") or kind in _PNG_TEXT and (everything or any(_png_marks(kind, payload))):
            why = f"drop chunk {kind}"
        elif kind not in (*C.PNG_STRUCTURAL, *_PNG_TEXT) and hints_in(kind.encode("utf-8") + payload, C.C2PA_MARKERS):
            why = f"drop chunk {kind} (C2PA marker in payload)"
        actions += [why] * bool(why)
        out += [] if why else [data[start:end]]
    return b"".join(out), actions or ["no PNG metadata chunks removed (already clean or none matched)"]


# JPEG -----------------------------------------------------------------------------------------------


class Segment(NamedTuple):
    marker: int
    at: int  # of the length field
    payload: bytes | None  # None: the length cannot be right


def inspect_jpeg(data: bytes, r: Report) -> None:
    at, n = 2, len(data)
    while at + 4 <= n:
        if data[at] != 0xFF:
            at += 1
            continue
        while at < n and data[at] == 0xFF:
            at += 1
        if at >= n or data[at] == 0xDA:
            break
        marker, at = data[at], at + 1
        if 0xD0 <= marker <= 0xD9:
            continue
        if at + 2 > n:
            break
        s = _segment(data, marker, at)
        if s.payload is None:
            r.say(f"bad segment length at marker 0x{marker:X}")
            break
        at += 2 + len(s.payload)
        if marker == 0xEB:
            r.say("JPEG APP11 segment (JUMBF/C2PA common)", c2pa=True)
        if marker in (0xE1, 0xE2, 0xEB, 0xED, 0xEE) and (hits := hints_in(s.payload)):
            r.say(f"JPEG APP{marker - 0xE0}: {some(hits)}", hits, C.STRONG)
    r.scan_rest(data)


def _segment(data: bytes, marker: int, at: int) -> Segment:
    size = struct.unpack_from(">H", data, at)[0]
    return Segment(marker, at, data[at + 2 : at + size] if size >= 2 and at + size <= len(data) else None)


def strip_jpeg(data: bytes, everything: bool) -> tuple[bytes, list[str]]:
    out, actions, at, n = [b"\xff\xd8"], [], 2, len(data)
    while at < n:
        if data[at] != 0xFF:
            out.append(data[at:])
            actions.append("copied remainder after non-marker byte")
            break
        while at < n and data[at] == 0xFF:
            at += 1
        if at >= n:
            break
        marker, at = data[at], at + 1
        if marker == 0xD8:
            continue
        if 0xD0 <= marker <= 0xD9:
            out.append(bytes((0xFF, marker)))
            if marker == 0xD9:
                break
            continue
        if at + 2 > n:
            break
        if marker == 0xDA:
            out.append(b"\xff\xda" + data[at:])
            actions.append("preserved entropy-coded scan (SOS→EOF)")
            break
        s = _segment(data, marker, at)
        if s.payload is None:
            out.append(data[at - 2 :])
            actions.append("truncated segment; copied remainder")
            break
        app, why = marker - 0xE0, ""
        if marker == 0xEB:
            why = "drop APP11 (C2PA/JUMBF)"
        elif marker == 0xFE:
            why = "drop COM comment"
        elif 0 <= app <= 15 and everything and app:
            why = f"drop APP{app}"
        elif 0 <= app <= 15 and hints_in(s.payload):
            why = f"drop APP{app} (AI/C2PA markers)"
        end = at + 2 + len(s.payload)
        if why:
            actions.append(why)
        else:
            out.append(bytes((0xFF, marker)) + data[at:end])
        at = end
    return b"".join(out), actions or ["no JPEG APP segments removed"]


# WebP -----------------------------------------------------------------------------------------------


def webp_chunks(data: bytes) -> tuple[list[tuple[str, bytes, bytes]], list[str]]:
    """Chunks (name, payload, padding) and notes on what does not add up."""
    declared = struct.unpack_from("<I", data, 4)[0] + 8
    notes = [f"RIFF size mismatch: header={declared} actual={len(data)}"] if declared != len(data) else []
    chunks, at, broken = [], 12, False
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        end = at + 8 + size
        if end + (size & 1) > len(data):
            notes.append(f"truncated WebP chunk {name.decode('latin-1')}")
            broken = True
            break
        chunks.append((name.decode("latin-1"), data[at + 8 : end], data[end : end + (size & 1)]))
        at = end + (size & 1)
    if at != len(data) and not broken:
        notes.append(f"trailing WebP bytes: {len(data) - at}")
    return chunks, notes


def inspect_webp(data: bytes, r: Report) -> None:
    chunks, notes = webp_chunks(data)
    r.findings += notes
    for name, payload, _ in chunks:
        if name.upper() == "C2PA":
            r.say("WebP C2PA chunk", c2pa=True)
        elif name in ("XMP ", "EXIF") and (hits := hints_in(payload)):
            r.say(f"WebP {name}: {some(hits)}", hits, C.STRONG)


def strip_webp(data: bytes, everything: bool) -> tuple[bytes, list[str]]:
    chunks, notes = webp_chunks(data)
    if notes:
        raise ValueError("malformed WebP: " + "; ".join(notes))
    gone = [c for c in chunks if c[0].upper() == "C2PA" or c[0] in C.WEBP_FLAGS and (everything or hints_in(c[1]))]
    flags = sum({C.WEBP_FLAGS.get(name, 0) for name, _, _ in gone})
    body = b"WEBP"
    for c in chunks:
        if any(c is g for g in gone):
            continue
        name, payload, padding = c
        if name == "VP8X" and payload and flags:
            payload = bytes((payload[0] & ~flags & 0xFF,)) + payload[1:]
        body += name.encode("latin-1") + struct.pack("<I", len(payload)) + payload + padding
    actions = [f"drop WebP chunk {name}" for name, _, _ in gone]
    return b"RIFF" + struct.pack("<I", len(body)) + body, actions or ["no WebP metadata chunks removed (already clean or none matched)"]


# ISO base media (AVIF, HEIC) ------------------------------------------------------------------------


class Box(NamedTuple):
    name: str
    payload: bytes
    header: int

    def pack(self, name: str | None = None, payload: bytes | None = None) -> bytes:
        """The box's bytes with the header it had, so that offsets of what follows stay right."""
        payload = self.payload if payload is None else payload
        kind, size = (name or self.name).encode("latin-1"), len(payload) + self.header
        return (struct.pack(">I4sQ", 1, kind, size) if self.header == 16 else struct.pack(">I4s", size, kind)) + payload

    def free(self) -> bytes:
        """A free box of the same size."""
        return self.pack("free", bytes(len(self.payload)))


def boxes(data: bytes, at: int = 0) -> tuple[list[Box], int]:
    """The boxes from ``at`` and where the walk ended: before the first that does not fit."""
    out: list[Box] = []
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        header = 8
        if size == 1:
            if at + 16 > len(data):
                break
            size, header = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = len(data) - at
        if size < header or at + size > len(data):
            break
        out.append(Box(name.decode("latin-1"), data[at + header : at + size], header))
        at += size
    return out, at


def _c2pa_box(b: Box) -> bool:
    return b.name in ("jumb", "c2pa") or b.name.lower().startswith("c2")


def _xmp_box(b: Box) -> bool:
    return b.name == "uuid" and b.payload[:16] == C.XMP_UUID


def inspect_isobmff(data: bytes, r: Report, fmt: str) -> None:
    f = fmt.upper()
    found, _ = boxes(data)
    if not found:
        r.scan_rest(data)
        r.say(f"not a valid {f} (no ISOBMFF boxes found)")
        return

    def look(b: Box, inner: bool) -> None:
        if _c2pa_box(b):
            r.say(f"{f} meta sub-box {b.name} (C2PA/JUMBF container)" if inner else f"{f} top-level box {b.name} (C2PA/JUMBF manifest)", c2pa=True)
        elif _xmp_box(b):
            hits = hints_in(b.payload[16:])
            title = f"{f} meta XMP uuid" if inner else f"{f} XMP uuid box"
            bare = f"{f} meta XMP uuid box" if inner else title
            r.say(f"{title}: {some(hits)}" if hits else bare, hits, C.STRONG_CORE if inner else C.STRONG)
            r.ai = True
        elif b.name == "uuid":
            if hits := hints_in(b.payload):
                r.say(f"{f} {'meta uuid' if inner else 'uuid box'}: {some(hits)}", hits, [] if inner else C.STRONG_CORE)
        elif inner and b.name in ("iinf", "infe", "iref", "iloc", "xml ", "bxml"):
            if hits := hints_in(b.payload):
                r.say(f"{f} meta/{b.name}: {some(hits)}", hits, C.STRONG_CORE)
        elif not inner and b.name == "meta":
            for sub in boxes(b.payload, 4)[0]:
                look(sub, True)

    for b in found:
        look(b, False)
    r.scan_rest(data)


def strip_isobmff(data: bytes, everything: bool, fmt: str) -> tuple[bytes, list[str]]:
    f = fmt.upper()
    found, end = boxes(data)
    if not found:
        raise ValueError(f"not a valid {f} (no ISOBMFF boxes)")
    actions: list[str] = []

    def kept(b: Box, inner: bool) -> bytes:
        where = f"meta sub-box {b.name}" if inner else f"top-level {b.name} box"
        why = ""
        if _c2pa_box(b):
            why = "C2PA/JUMBF"
        elif _xmp_box(b):
            why = "XMP metadata"
        elif (b.name == "uuid" or inner and b.name in ("xml ", "bxml")) and (everything or hints_in(b.payload)):
            why = "UUID metadata" if b.name == "uuid" else "XML metadata"
        if why:
            actions.append(f"drop {where} ({why})")
            return b.free()
        if b.name == "meta" and not inner:
            return b.pack(payload=b.payload[:4].ljust(4, b"\0") + b"".join(kept(s, True) for s in boxes(b.payload, 4)[0]))
        return b.pack()

    out = b"".join(kept(b, False) for b in found) + data[end:]
    if len(data) - end >= 8:
        actions.append(f"kept {len(data) - end} bytes of truncated tail (file truncated)")
    return out, actions or [f"no {f} metadata boxes removed (already clean or none matched)"]


# BMP ------------------------------------------------------------------------------------------------


def bmp_end(data: bytes) -> int | None:
    """Where the pixels end, from the header; None if it does not tell."""
    if len(data) < 38:
        return None
    pixels, dib, width, height, _, bits, packing, size = struct.unpack_from("<IIiiHHII", data, 10)
    if dib < 40 or 14 + dib > len(data) or width <= 0 or not bits or pixels > len(data):
        return None
    if packing == 0:
        size = (width * bits + 31) // 32 * 4 * abs(height)
    return pixels + size if packing == 0 or size else None


def inspect_bmp(data: bytes, r: Report) -> None:
    if len(data) < 14:
        r.say("not a BMP")
        return
    end = bmp_end(data)
    tail = data[end:] if end is not None else b""
    hits = hints_in(tail)
    if hits:
        r.say(f"BMP trailing metadata: {some(hits, 6)}", hits, C.STRONG)
    elif tail:
        r.say(f"BMP has {len(tail)} unrecognized trailing byte(s)")
    else:
        r.say("BMP has no metadata (header-only raster format)")


def strip_bmp(data: bytes, everything: bool) -> tuple[bytes, list[str]]:
    if len(data) < 14:
        raise ValueError("not BMP")
    end = bmp_end(data)
    if end is None:
        return data, ["BMP header not fully parsed; left unchanged"]
    tail = data[end:]
    if not tail:
        return data, ["no BMP trailing metadata to strip"]
    hits = hints_in(tail)
    if not everything and not hits:
        return data, ["BMP trailing bytes kept (keep-non-ai-metadata)"]
    return data[:2] + struct.pack("<I", end) + data[6:end], [f"drop {len(tail)} BMP trailing byte(s)" + (f" ({some(hits, 4)})" if hits else "")]


# GIF ------------------------------------------------------------------------------------------------


class Block(NamedTuple):
    kind: str  # extension, image, end, byte, or bad extension, bad image
    start: int
    end: int
    label: int = 0
    payload: bytes = b""


def _sub_blocks(data: bytes, at: int) -> tuple[int, bytes] | None:
    parts = []
    while at < len(data):
        size = data[at]
        at += 1
        if not size:
            return at, b"".join(parts)
        if at + size > len(data):
            return None
        parts.append(data[at : at + size])
        at += size
    return None


def _table(packed: int) -> int:
    return 3 << ((packed & 7) + 1) if packed & 0x80 else 0


def gif_blocks(data: bytes) -> Iterator[Block]:
    """Blocks after the screen descriptor and its colour table."""
    at, n = 13 + _table(data[10]), len(data)
    while at < n:
        if data[at] == 0x3B:
            yield Block("end", at, n)
            return
        if data[at] == 0x21:
            got = _sub_blocks(data, at + 2) if at + 2 <= n else None
            if got is None:
                yield Block("bad extension", at, n)
                return
            yield Block("extension", at, got[0], data[at + 1], got[1])
            at = got[0]
        elif data[at] == 0x2C:
            first = at + 10 + (_table(data[at + 9]) if at + 10 <= n else 0)
            got = _sub_blocks(data, first + 1) if at + 10 <= n and first < n else None
            if got is None:
                yield Block("bad image", at, n)
                return
            yield Block("image", at, got[0])
            at = got[0]
        else:
            yield Block("byte", at, at + 1)
            at += 1


def inspect_gif(data: bytes, r: Report) -> None:
    if len(data) < 13:
        r.say("truncated GIF header")
        return
    for b in gif_blocks(data):
        if b.kind.startswith("bad"):
            r.say("truncated GIF " + ("extension" if b.kind == "bad extension" else "image block"))
        elif b.label == 0xFE:
            r.say("GIF comment extension present")
            if hits := hints_in(b.payload):
                r.say(f"GIF comment: {some(hits, 6)}", hits)
        elif b.label == 0xFF:
            name = b.payload[:11].decode("latin-1")
            if name == C.GIF_XMP:
                r.say("GIF XMP application extension present")
                if hits := hints_in(b.payload):
                    r.say(f"GIF XMP: {some(hits, 6)}", hits)
            elif any(m in name for m in ("c2pa", "jumb", "C2PA", "JUMB")):
                r.say("GIF application extension (possible C2PA)", c2pa=True)
    r.scan_rest(data)
    if not r.findings:
        r.say("no GIF metadata extensions found")


def strip_gif(data: bytes, everything: bool) -> tuple[bytes, list[str]]:
    if len(data) < 13:
        raise ValueError("truncated GIF header")
    out, actions = [data[: 13 + _table(data[10])]], []
    for b in gif_blocks(data):
        name = ""
        if b.label == 0xFE:
            name = "comment"
        elif b.label == 0xFF:
            ident = b.payload[:11].decode("latin-1")
            name = "XMP application" if ident == C.GIF_XMP else "control application" if ident in C.GIF_CONTROL else "application"
        if name and (everything and name != "control application" or hints_in(b.payload)):
            actions.append(f"drop GIF {name} extension")
        else:
            out.append(data[b.start : b.end])
    return b"".join(out), actions or ["no GIF metadata blocks removed (already clean or none matched)"]


# TIFF -----------------------------------------------------------------------------------------------


def tiff_layout(data: bytes) -> tuple[str, bool] | None:
    """Byte order for ``struct`` and whether offsets have 64 bits."""
    return {b"II*\0": ("<", False), b"MM\0*": (">", False), b"II+\0": ("<", True), b"MM\0+": (">", True)}.get(bytes(data[:4]))


class Entry(NamedTuple):
    tag: int
    kind: int
    count: int
    value: bytes  # the inline field
    size: int
    offset: int | None  # of the data, if it is not inline


class Directory(NamedTuple):
    entries: list[Entry]
    next: int
    size: int  # of count and entries


class Tiff:
    """Reachable directories by offset; loops and absurd counts end the walk."""

    def __init__(self, data: bytes):
        self.data, (self.order, self.big) = data, tiff_layout(data)
        self.off, self.cnt, self.entry = ("Q", "Q", 20) if self.big else ("I", "H", 12)
        self.off_len, self.cnt_len = (8, 8) if self.big else (4, 2)
        self.root = self.read(self.off, 8 if self.big else 4) if len(data) >= (16 if self.big else 8) else 0
        self.dirs: dict[int, Directory] = {}
        todo, n = [self.root] if self.root else [], len(data)
        while todo and len(self.dirs) < C.IFD_CAP:
            at = todo.pop()
            if at in self.dirs or at + self.cnt_len > n:
                continue
            count = self.read(self.cnt, at)
            size = self.cnt_len + count * self.entry
            after = 0
            if at + size + self.off_len <= n:
                after = self.read(self.off, at + size)
            else:
                size = max(0, n - at - self.off_len)
            fits = min(count, max(0, (n - at - self.cnt_len) // self.entry))
            found = [self._entry(at + self.cnt_len + k * self.entry) for k in range(fits)]
            self.dirs[at] = Directory(found, after, size)
            todo += [p for p in [after, *(self.pointer(e) for e in found if e.tag in C.TIFF_SUB_IFDS)] if p]

    def read(self, kind: str, at: int) -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def _entry(self, at: int) -> Entry:
        tag, kind, count = struct.unpack_from(f"{self.order}HH{self.off}", self.data, at)
        value = self.data[at + 4 + self.off_len : at + self.entry]
        size = count * C.TIFF_SIZES.get(kind, 1)
        return Entry(tag, kind, count, value, size, struct.unpack(self.order + self.off, value)[0] if size > len(value) else None)

    def pointer(self, e: Entry) -> int:
        return struct.unpack(self.order + self.off, e.value)[0]

    def payload(self, e: Entry) -> bytes:
        return e.value[: e.size] if e.offset is None else self.data[e.offset : e.offset + e.size]

    def span(self, at: int) -> tuple[int, int]:
        """The bytes of a directory with its link."""
        return at, min(at + self.dirs[at].size + self.off_len, len(self.data))

    def outside(self, e: Entry) -> list[tuple[int, int]]:
        """The bytes of an entry's data, where they lie in the file."""
        return [(e.offset, e.offset + e.size)] if e.offset is not None and e.offset + e.size <= len(self.data) else []

    def pack(self, entries: list[Entry], after: int) -> bytes:
        rows = b"".join(struct.pack(f"{self.order}HH{self.off}", e.tag, e.kind, e.count) + e.value for e in entries)
        return struct.pack(self.order + self.cnt, len(entries)) + rows + struct.pack(self.order + self.off, after)


_LINKED = (34665, 34853)


def inspect_tiff(data: bytes, r: Report) -> None:
    t = Tiff(data)
    if not t.dirs:
        r.say("TIFF with no image file directories")
        return
    for at in sorted(t.dirs):
        for e in t.dirs[at].entries:
            if hits := hints_in(t.payload(e)):
                r.say(f"TIFF tag {e.tag}: {some(hits, 6)}", hits, C.STRONG)
            if e.tag in C.TIFF_NAMES:
                r.say(f"TIFF {'sub-IFD' if e.tag in C.TIFF_SUB_IFDS else 'tag'} {e.tag} ({C.TIFF_NAMES[e.tag]}) present")
    r.scan_rest(data)
    if not r.findings:
        r.say("no TIFF metadata tags found")


def _marked(t: Tiff, e: Entry) -> bool:
    """True if the entry or the directory it links to holds a hint."""
    if hints_in(t.payload(e)):
        return True
    sub = t.pointer(e) if e.tag in _LINKED else None
    return sub in t.dirs and (bool(hints_in(data_of(t, sub))) or any(hints_in(t.payload(x)) for x in t.dirs[sub].entries))


def data_of(t: Tiff, at: int) -> bytes:
    s, e = t.span(at)
    return t.data[s:e]


def strip_tiff(data: bytes, everything: bool) -> tuple[bytes, list[str]]:
    """Entries are taken out in place and their data zeroed, unless what is kept still reaches it; nothing moves."""
    t = Tiff(data)
    if not t.dirs:
        raise ValueError("not a valid TIFF (no image file directories)")
    actions: list[str] = []
    kept: dict[int, list[Entry]] = {}
    gone: list[tuple[int, int]] = []
    gone_dirs: set[int] = set()
    for at in sorted(t.dirs):
        kept[at] = []
        for e in t.dirs[at].entries:
            mark = _marked(t, e)
            if not (e.tag in C.TIFF_NAMES and (everything or mark) or mark and e.tag not in C.TIFF_KEPT and e.tag not in C.TIFF_NAMES):
                kept[at].append(e)
                continue
            actions.append(f"drop TIFF tag {e.tag} ({C.TIFF_NAMES.get(e.tag, 'AI markers')})")
            if e.tag not in _LINKED:
                gone += t.outside(e)
                continue
            todo, seen = [t.pointer(e)], set()
            while todo:
                sub = todo.pop()
                if sub in seen or sub not in t.dirs:
                    continue
                seen.add(sub)
                for x in t.dirs[sub].entries:
                    if x.tag in _LINKED:
                        todo.append(t.pointer(x))
                    else:
                        gone += t.outside(x)
            gone_dirs |= seen
    # what the root still reaches
    reached, todo = set(), [t.root]
    while todo:
        at = todo.pop()
        if at in reached or at not in t.dirs:
            continue
        reached.add(at)
        todo += [t.pointer(e) for e in kept[at] if e.tag in C.TIFF_SUB_IFDS] + [t.dirs[at].next]
    held = [s for at in reached for e in kept[at] for s in t.outside(e)]
    held += [t.span(t.pointer(e)) for at in reached for e in kept[at] if e.tag in C.TIFF_SUB_IFDS and t.pointer(e) in t.dirs]
    out = bytearray(data)
    for at in sorted(t.dirs):
        size = t.dirs[at].size + t.off_len
        if at + size <= len(data):
            out[at : at + size] = t.pack(kept[at], t.dirs[at].next)[:size].ljust(size, b"\0")
    for s, e in gone + [t.span(at) for at in sorted(gone_dirs)]:
        if not any(a <= s and e <= b for a, b in held):
            out[s:e] = bytes(e - s)
    return bytes(out), actions or ["no TIFF metadata tags removed (already clean or none matched)"]


# All formats ----------------------------------------------------------------------------------------

_INSPECT = {"png": inspect_png, "jpeg": inspect_jpeg, "webp": inspect_webp, "bmp": inspect_bmp, "gif": inspect_gif, "tiff": inspect_tiff}
_STRIP = {"png": strip_png, "jpeg": strip_jpeg, "webp": strip_webp, "bmp": strip_bmp, "gif": strip_gif, "tiff": strip_tiff}


_REPORT = T.StructType().add("format", T.StringType()).add("has_c2pa", T.BooleanType()).add("has_ai_metadata", T.BooleanType()).add("findings", T.ArrayType(T.StringType())).add("error", T.StringType())


def inspect_bytes(data: bytes) -> dict:
    fmt, r = sniff(data), Report()
    if fmt in ("avif", "heic"):
        inspect_isobmff(data, r, fmt)
    elif fmt in _INSPECT:
        _INSPECT[fmt](data, r)
    else:
        r.say("unsupported format (PNG/JPEG/WebP/AVIF/HEIC/BMP/GIF/TIFF)")
    return {"format": fmt, "has_c2pa": r.c2pa, "has_ai_metadata": r.ai or r.c2pa, "findings": r.findings}


def clean_bytes(data: bytes, strip_all_metadata: bool = True) -> dict:
    fmt = sniff(data)
    if fmt in ("avif", "heic"):
        out, actions = strip_isobmff(data, strip_all_metadata, fmt)
    elif fmt in _STRIP:
        out, actions = _STRIP[fmt](data, strip_all_metadata)
    else:
        raise ValueError("unsupported image format (expected PNG, JPEG, WebP, AVIF, HEIC, BMP, GIF or TIFF)")
    return {"format": fmt, "data": out, "actions": actions}


@F.pandas_udf(_REPORT)
def inspect_udf(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        try:
            rows.append({**inspect_bytes(bytes(data or b"")), "error": None})
        except Exception as e:  # noqa: BLE001  an error is a row
            rows.append({"format": sniff(bytes(data or b"")), "has_c2pa": False, "has_ai_metadata": False, "findings": [], "error": str(e)})
    return pd.DataFrame(rows, columns=["format", "has_c2pa", "has_ai_metadata", "findings", "error"])


def clean_udf(strip_all_metadata: bool = True):
    @F.pandas_udf("format string, data binary, actions array<string>, error string")
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                rows.append({**clean_bytes(bytes(data or b""), strip_all_metadata), "error": None})
            except Exception as e:  # noqa: BLE001
                rows.append({"format": sniff(bytes(data or b"")), "data": None, "actions": [], "error": str(e)})
        return pd.DataFrame(rows, columns=["format", "data", "actions", "error"])

    return run


def inspect(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Report of each file."""
    return files.select(*keep, inspect_udf(F.col(content)).alias("r")).select(*keep, "r.*")


def clean(files: DataFrame, strip_all_metadata: bool = True, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """Cleaned bytes and actions of each file; an error leaves ``data`` null."""
    return files.select(*keep, clean_udf(strip_all_metadata)(F.col(content)).alias("r")).select(*keep, "r.*")


def contains_any(content: Column, needles: list[str]) -> Column:
    """``hints_in`` as a native expression over a binary or string column."""
    low = F.lower(F.decode(content.cast("binary"), "ISO-8859-1"))
    return F.filter(F.array(*map(F.lit, needles)), lambda n: F.contains(low, F.lower(n)))
