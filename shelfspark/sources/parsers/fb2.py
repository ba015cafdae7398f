"""FB2: description, preview, cover, and what can be saved of damaged files."""

from __future__ import annotations

import base64
import re
from xml.etree import ElementTree as ET

from .image import kind
from .text import FormatError, clean, decode, number, preview, unique

COVERS = ("image/jpeg", "image/png", "image/gif", "image/webp")
#: An attachment's tags, and what may stand inside it besides its content.
OPENED, CLOSED = re.compile(r"<(?:[\w.-]+:)?binary\b[^<>]*(?<!/)>"), re.compile(r"</(?:[\w.-]+:)?binary\s*>")
ASIDE = re.compile(r"<!--.*?-->|<!\[CDATA\[|\]\]>", re.S)
#: Paragraphs inside these are no running text.
APART = {"title", "epigraph", "annotation", "poem", "cite", "subtitle", "table"}


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _kids(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if e is None else [k for k in e if _name(k) == name]


def _one(e: ET.Element | None, *path: str) -> ET.Element | None:
    for p in path:
        e = next(iter(_kids(e, p)), None)
    return e


def _text(e: ET.Element | None) -> str:
    return "" if e is None else clean("".join(e.itertext()))


def _parse(text: str) -> ET.Element:
    text = re.sub(r"^\ufeff?\s*<\?xml[^>]*\?>", "", text)
    try:
        return ET.fromstring(text)
    except ET.ParseError as e:
        line, column = e.position
        raise FormatError("xml", f"line {line}, column {column}") from e


def title_info(root: ET.Element) -> dict:
    """P-04, C-01, C-02."""
    t = _one(root, "description", "title-info")
    if t is None:
        raise FormatError("fb2_no_description")
    authors = []
    for a in _kids(t, "author"):
        full = " ".join(x for x in (_text(_one(a, k)) for k in ("first-name", "middle-name", "last-name")) if x)
        authors.append(full or _text(_one(a, "nickname")))
    s = _one(t, "sequence")
    note = _one(t, "annotation")
    blocks = [_text(p) for p in note] if note is not None and len(note) else [_text(note)]
    image = next((v for i in _kids(_one(t, "coverpage"), "image") for k, v in i.attrib.items() if k.rsplit("}", 1)[-1] == "href"), None)
    return {
        "title": _text(_one(t, "book-title")) or None,
        "authors": unique(authors),
        "genres": unique(_text(g) for g in _kids(t, "genre")),
        "series": clean(s.get("name")) or None if s is not None else None,
        "series_number": number(s.get("number")) if s is not None else None,
        "annotation": "\n".join(b for b in blocks if b) or None,
        "language": _text(_one(t, "lang")) or None,
        "cover_id": image.lstrip("#") if image else None,
    }


def body_preview(root: ET.Element) -> str | None:
    """P-05: of the first body without a name, else the first."""
    bodies = _kids(root, "body")
    main = next((b for b in bodies if not b.get("name")), bodies[0] if bodies else None)

    def walk(e: ET.Element):
        for k in e:
            if _name(k) == "p":
                yield _text(k)
            elif _name(k) not in APART:
                yield from walk(k)

    return preview(walk(main)) if main is not None else None


def _cover(root: ET.Element, cover_id: str | None) -> tuple[bytes | None, str | None]:
    """A cover that can't be read is no cover."""
    b = next((x for x in _kids(root, "binary") if x.get("id") == cover_id), None) if cover_id else None
    if b is None:
        return None, None
    try:
        data = base64.b64decode("".join((b.text or "").split()), validate=True)
    except ValueError:
        return None, None
    k = kind(data)
    return (data, k) if k in COVERS else (None, None)


def damaged(content: str) -> bool:
    """P-07: whether an attachment's content is not what base64 gives."""
    try:
        base64.b64decode("".join(content.split()), validate=True)
    except ValueError:
        return True
    return False


def repair_binaries(text: str) -> tuple[str, int]:
    """P-07: the text with damaged attachments emptied, and their number. Each ends at the next closing tag of its kind; a whole tag before that
    could be the book's own, so then, and without a closing tag, it is an error. Whether the rest is a book is the XML parser's to say."""
    parts, at, n = [], 0, 0
    while opened := OPENED.search(text, at):
        closed = CLOSED.search(text, opened.end())
        content = ASIDE.sub("", text[opened.end() : closed.start()]) if closed else "<>"
        if re.search("<[^<>]*>", content):
            raise FormatError("binary_ambiguous")
        bad = damaged(content)
        parts.append(text[at : opened.end() if bad else closed.start()])
        at, n = closed.start(), n + bad
    return "".join([*parts, text[at:]]), n


def description_only(text: str) -> ET.Element:
    """P-03, P-08: what stands before the end of the description, closed."""
    m = re.search(r"</(\w+:)?description\s*>", text)
    head = re.search(r"<(?:\w+:)?FictionBook\b", text)
    if not m or not head:
        raise FormatError("fb2_no_description")
    root = re.match(r"<((?:\w+:)?FictionBook)", text[head.start() :])[1]
    return _parse(text[head.start() : m.end()] + f"</{root}>")


def parse(data: bytes) -> dict:
    """P-06: whole; else with damaged binaries emptied; else the description alone."""
    text = decode(data)
    warning = None
    try:
        root = _parse(text)
    except FormatError:
        try:
            fixed, bad = repair_binaries(text)
            if not bad:
                raise
            root, warning = _parse(fixed), "binary_corruption_recovered"
        except FormatError:
            root, warning = description_only(text), "metadata_only_recovered"
    out = title_info(root)
    cover, mime = _cover(root, out.pop("cover_id"))
    return out | {"preview": body_preview(root), "cover": cover, "cover_mime_type": mime, "warning": warning}
