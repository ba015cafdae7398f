"""Encodings, cleaning and previews. Lengths are code points."""

from __future__ import annotations

import codecs
import html
import re

from ..pages import OWN_LINE, events

PREVIEW, PREVIEW_MOST = 800, 1200
SPACE = re.compile("[\\s\u00a0\ufeff]+")
WORD = re.compile(r"[^\W_]+")


class FormatError(ValueError):
    """A file is not what it should be; ``code`` says how."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def clean(s: str | None) -> str:
    return SPACE.sub(" ", s or "").strip()


def unique(values) -> list[str]:
    return list(dict.fromkeys(v for v in map(clean, values) if v))


def number(s: str | None) -> float | None:
    t = (s or "").strip()
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t):
        return None
    v = float(t)
    return v if abs(v) < float("inf") else None


def encoding_of(data: bytes) -> str:
    """P-02: byte order mark, byte pattern, XML declaration, else UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return name
    if data[:2] == b"<\0":
        return "utf-16-le"
    if data[:2] == b"\0<":
        return "utf-16-be"
    m = re.match(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", data[:512])
    name = m[1].decode().lower() if m else "utf-8"
    name = {"win-1251": "cp1251", "windows1251": "cp1251", "unicode": "utf-16"}.get(name, name)
    try:
        return codecs.lookup(name).name
    except LookupError as e:
        raise FormatError("unknown_encoding", name) from e


def decode(data: bytes) -> str:
    return data.decode(encoding_of(data), "replace")


HIDDEN, LINKS = {"script", "style", "head"}, {"a", "nav"}


def lines(source: str, links: bool = True) -> list[str]:
    """Text lines of a book's page or description: elements with lines of their own end a line; scripts and styles are left out, and without ``links`` their text is too."""
    off = HIDDEN if links else HIDDEN | LINKS
    inside, parts = 0, []
    for kind, x in events(source):
        if kind == "text":
            parts.append(x if not inside else "")
            continue
        inside = max(0, inside + (x in off) * (1 if kind == "open" else -1))
        parts.append("\n" if x in OWN_LINE else "")
    return [x for x in map(clean, "".join(parts).split("\n")) if x]


def description(source: str | None) -> str:
    """P-13."""
    return "\n".join(lines(source)) if source else ""


def truncate(text: str, limit: int) -> str:
    """F-12."""
    if len(text) <= limit:
        return text
    head = text[:limit]
    at = max(head.rfind(" "), head.rfind("\u00a0"))
    return head[:at] if at > 0 else head


def preview(paragraphs, words: int = 2) -> str | None:
    """Paragraphs of enough words up to the target length, cut at the most."""
    out: list[str] = []
    n = 0
    for p in map(clean, paragraphs):
        if len(WORD.findall(p)) < words:
            continue
        out.append(p)
        n += len(p) + 1
        if n >= PREVIEW:
            break
    return truncate("\n".join(out), PREVIEW_MOST) or None


def label(s: str) -> str:
    """F-13."""
    return clean(html.unescape(s)).strip(" -–—")
