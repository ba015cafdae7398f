"""MOBI: record directory, header, EXTH fields, PalmDOC text and cover."""

from __future__ import annotations

import struct

from .image import cover_score, dimensions, kind
from .text import FormatError, clean, description, lines, number, preview, unique

MOST_HEADER, TEXT_RECORDS, IMAGES = 2 << 20, 8, 128
# Primary language ids of the header's locale.
LOCALES = {7: "de", 9: "en", 10: "es", 12: "fr", 16: "it", 21: "pl", 25: "ru", 34: "uk", 35: "be"}


def records(data: bytes) -> list[tuple[int, int]]:
    """S-25: (start, end) of each record; offsets must rise."""
    if len(data) < 78 or data[60:68] != b"BOOKMOBI":
        raise FormatError("mobi_signature")
    n = struct.unpack(">H", data[76:78])[0]
    if len(data) < 78 + 8 * n or not n:
        raise FormatError("mobi_directory")
    at = [struct.unpack(">I", data[78 + 8 * i : 82 + 8 * i])[0] for i in range(n)] + [len(data)]
    if any(a >= b for a, b in zip(at, at[1:])) or at[0] < 78 + 8 * n:
        raise FormatError("mobi_directory")
    return list(zip(at, at[1:]))


def palmdoc(data: bytes, limit: int = 1 << 16) -> bytes:
    """PalmDOC runs: literals, spaces with a letter, and copies of what came before."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((32, c ^ 0x80))
        elif i < len(data):
            pair = c << 8 | data[i]
            i += 1
            back, n = pair >> 3 & 0x7FF, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise FormatError("mobi_text")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


def _exth(head: bytes, at: int) -> dict[int, list[bytes]]:
    if head[at : at + 4] != b"EXTH":
        return {}
    out: dict[int, list[bytes]] = {}
    n, i = struct.unpack(">I", head[at + 8 : at + 12])[0], at + 12
    for _ in range(n):
        if i + 8 > len(head):
            break
        kind_, size = struct.unpack(">II", head[i : i + 8])
        if size < 8 or i + size > len(head):
            break
        out.setdefault(kind_, []).append(head[i + 8 : i + size])
        i += size
    return out


def parse(data: bytes) -> dict:
    """P-12, A-25, C-07."""
    rec = records(data)
    head = data[rec[0][0] : min(rec[0][1], rec[0][0] + MOST_HEADER)]
    if len(head) < 132 or head[16:20] != b"MOBI":
        raise FormatError("mobi_header")
    compression, _, _, text_records, _, encryption = struct.unpack(">HHIHHH", head[:14])
    length, _, code = struct.unpack(">III", head[20:32])
    encoding = "utf-8" if code == 65001 else "cp1252"
    name_at, name_len, locale = struct.unpack(">III", head[84:96])
    first_image = struct.unpack(">I", head[108:112])[0]
    exth = _exth(head, 16 + length) if struct.unpack(">I", head[128:132])[0] & 0x40 else {}
    text = lambda k: [b.decode(encoding, "replace") for b in exth.get(k, [])]
    title = next((clean(t) for t in text(503) if clean(t)), None) or clean(head[name_at : name_at + name_len].decode(encoding, "replace")) or None
    shown, warning = None, None
    if encryption:
        warning = "drm"
    elif compression in (1, 2):
        raw = b""
        for a, b in rec[1 : 1 + min(text_records, TEXT_RECORDS)]:
            raw += data[a:b] if compression == 1 else palmdoc(data[a:b])
        shown = preview(lines(raw.decode(encoding, "replace"), links=False), 3)
    return {
        "title": title,
        "authors": unique(text(100)),
        "genres": unique(x for g in text(105) for x in g.split(";")),
        "series": None,
        "series_number": number(None),
        "annotation": next((d for d in map(description, text(103)) if d), None),
        "language": next((clean(x) for x in text(524) if clean(x)), None) or LOCALES.get(locale & 0xFF),
        "preview": shown,
        **_cover(data, rec, first_image, exth),
        "warning": warning,
    }


def _cover(data: bytes, rec: list, first: int, exth: dict) -> dict:
    images = rec[first : first + IMAGES] if 0 < first < len(rec) else []
    if exth.get(201) and len(exth[201][0]) == 4:
        i = struct.unpack(">I", exth[201][0])[0]
        if i < len(images) and kind(data[slice(*images[i])]):
            d = data[slice(*images[i])]
            return {"cover": d, "cover_mime_type": kind(d)}
    best, found = 0.0, None
    for a, b in images:
        size = dimensions(data[a:b])
        s = cover_score(*size) if size else 0.0
        if s > best:
            best, found = s, data[a:b]
    return {"cover": found, "cover_mime_type": kind(found) if found else None}
