"""EPUB: container, package, Dublin Core, series, cover and preview."""

from __future__ import annotations

import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from . import archive
from .image import kind
from .text import FormatError, clean, decode, description, lines, number, preview, unique

# Budgets of the container, the package, a text and a cover, and how many texts are looked at.
MOST_CONTAINER, MOST_PACKAGE, MOST_TEXT, MOST_COVER, TEXTS = 256 << 10, 2 << 20, 512 << 10, 8 << 20, 5


def resolve(base: str, ref: str) -> str | None:
    """F-24: a path inside the archive; null for schemes, absolute paths, backslashes, NUL and ways out."""
    ref = unquote(ref.split("#")[0])
    if not ref or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", ref) or ref.startswith("/") or "\\" in ref or "\0" in ref:
        return None
    out = base.split("/")[:-1]
    for p in ref.split("/"):
        if p == "..":
            if not out:
                return None
            out.pop()
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [k for k in e.iter() if _name(k) == name]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _xml(z: zipfile.ZipFile, path: str | None, most: int) -> ET.Element:
    try:
        info = z.getinfo(path or "")
    except KeyError as e:
        raise FormatError("epub_missing", str(path)) from e
    if info.file_size > most:
        raise FormatError("epub_too_large", str(path))
    archive.check([info], info, 0)
    try:
        return ET.fromstring(re.sub(r"^\ufeff?\s*<\?xml[^>]*\?>", "", decode(archive.read(z, info))))
    except ET.ParseError as e:
        raise FormatError("xml", str(path)) from e


def _optional(action):
    """P-16: only errors of format are passed over."""
    try:
        return action()
    except FormatError:
        return None


def parse(data: bytes) -> dict:
    """P-11, J-24."""
    z = archive.open_zip(data)
    root = _xml(z, "META-INF/container.xml", MOST_CONTAINER)
    at = next((_attr(r, "full-path") for r in _all(root, "rootfile")), None)
    opf = _xml(z, at, MOST_PACKAGE)
    meta = next(iter(_all(opf, "metadata")), opf)
    refined: dict[tuple[str, str], str] = {}
    for m in _all(meta, "meta"):
        if (_attr(m, "refines") or "").startswith("#"):
            refined[_attr(m, "refines")[1:], _attr(m, "property") or ""] = clean(m.text)
    text = lambda e: clean("".join(e.itertext()))
    role = lambda e: _attr(e, "role") or refined.get((_attr(e, "id") or "", "role")) or "aut"
    series = index = None
    for m in _all(meta, "meta"):
        if _attr(m, "property") == "belongs-to-collection" and series is None:
            series, index = text(m), refined.get((_attr(m, "id") or "", "group-position"))
    names = {(_attr(m, "name") or "").lower(): _attr(m, "content") for m in _all(meta, "meta")}
    series, index = series or clean(names.get("calibre:series")) or None, index or names.get("calibre:series_index")
    items = {_attr(i, "id"): (resolve(at, _attr(i, "href") or ""), _attr(i, "properties") or "", _attr(i, "media-type") or "") for i in _all(opf, "item")}
    cover_id = next((k for k, v in items.items() if "cover-image" in v[1].split()), names.get("cover"))
    texts = [items[i][0] for i in (_attr(r, "idref") for r in _all(opf, "itemref")) if i in items and items[i][0]][:TEXTS]
    cover = _optional(lambda: _cover(z, items.get(cover_id, (None,))[0]))
    notes = [description("".join(e.itertext())) for e in _all(meta, "description")]
    return {
        "title": next((text(e) for e in _all(meta, "title") if text(e)), None),
        "authors": unique(text(e) for e in _all(meta, "creator") if role(e) == "aut"),
        "genres": unique(text(e) for e in _all(meta, "subject")),
        "series": series,
        "series_number": number(index),
        "annotation": next((n for n in notes if n), None),
        "language": next((text(e) for e in _all(meta, "language") if text(e)), None),
        "preview": preview((p for t in texts for p in _optional(lambda t=t: lines(_text(z, t), links=False)) or []), 3),
        "cover": cover,
        "cover_mime_type": kind(cover) if cover else None,
        "warning": None,
    }


def _entry(z: zipfile.ZipFile, path: str | None, most: int) -> bytes:
    try:
        info = z.getinfo(path or "")
    except KeyError as e:
        raise FormatError("epub_missing", str(path)) from e
    if info.file_size > most:
        raise FormatError("epub_too_large", str(path))
    archive.check([info], info, 0)
    return archive.read(z, info)


def _text(z: zipfile.ZipFile, path: str) -> str:
    return decode(_entry(z, path, MOST_TEXT))


def _cover(z: zipfile.ZipFile, path: str | None) -> bytes:
    data = _entry(z, path, MOST_COVER)
    if kind(data) is None:
        raise FormatError("cover_kind")
    return data
