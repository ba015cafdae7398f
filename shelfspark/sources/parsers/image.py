"""F-22, F-23: kind and size of images by their headers."""

from __future__ import annotations

import struct


def kind(data: bytes) -> str | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "image/png"
    if data[:3] == b"\xff\xd8\xff":
        return "image/jpeg"
    if data[:4] == b"GIF8":
        return "image/gif"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return None


def dimensions(data: bytes) -> tuple[int, int] | None:
    try:
        return {"image/png": _png, "image/gif": _gif, "image/webp": _webp, "image/jpeg": _jpeg}[kind(data) or ""](data)
    except (KeyError, struct.error, IndexError):
        return None


def _png(d):
    return struct.unpack(">II", d[16:24])


def _gif(d):
    return struct.unpack("<HH", d[6:10])


def _webp(d):
    form = d[12:16]
    if form == b"VP8X":
        return int.from_bytes(d[24:27], "little") + 1, int.from_bytes(d[27:30], "little") + 1
    if form == b"VP8L":
        bits = int.from_bytes(d[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    w, h = struct.unpack("<HH", d[26:30])
    return w & 0x3FFF, h & 0x3FFF


def _jpeg(d):
    at = 2
    while at + 9 < len(d):
        if d[at] != 0xFF:
            at += 1
            continue
        mark = d[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", d[at + 5 : at + 9])
            return w, h
        at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 else 2 + struct.unpack(">H", d[at + 2 : at + 4])[0]
    return None


def cover_score(w: int, h: int) -> float:
    """F-21."""
    if w < 120 or h < 160 or h <= w or not 1.15 <= h / w <= 3:
        return 0.0
    return w * h * min(h / w, 2.0)
