"""Book files made from a document, for round trips through the parsers."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape

AUTHORS = (("A.", "Writer"), ("B.", "Other"))


def _plain(text: str) -> str:
    """Without characters that XML can't hold."""
    return escape("".join(c for c in text if c in "\t\n\r" or c >= " " and c not in "￾￿"))


def fb2(id_: str, lang: str, text: str, more: str = "", body_end: str = "</p></body></FictionBook>") -> bytes:
    people = "".join(f"<author><first-name>{a}</first-name><last-name>{b}</last-name></author>" for a, b in AUTHORS)
    head = f"<FictionBook><description><title-info><genre>made</genre>{people}<book-title>Book {id_}</book-title><lang>{lang}</lang></title-info></description>"
    return f"{head}<body><p>{_plain(text)}{body_end.replace('</FictionBook>', more + '</FictionBook>')}".encode()


def damaged_fb2(id_: str, lang: str, text: str) -> bytes:
    """Whole; with a damaged attachment; or with one whose end can't be told, each for a third of the ids."""
    damage = ("", '<binary id="x" content-type="image/png">AA\x01A<A\x02</binary>', '<binary id="x">AAAA&<binary id="y">AAAA</binary>')
    return fb2(id_, lang, text, damage[int(id_) % 3])


def _zip(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def zipped_fb2(id_: str, lang: str, text: str) -> bytes:
    return _zip({"__MACOSX/x.fb2": b"no book", "read me.txt": b"text", f"in/{id_}.fb2": fb2(id_, lang, text)})


def epub(id_: str, lang: str, text: str) -> bytes:
    people = "".join(f"<creator>{a} {b}</creator>" for a, b in AUTHORS)
    package = f'<package><metadata><title>Book {id_}</title>{people}<language>{lang}</language></metadata><manifest><item id="b" href="two.xhtml"/><item id="a" href="one.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    page = f"<html><body><p>{_plain(text)}</p></body></html>".encode()
    return _zip({"META-INF/container.xml": b'<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o/p.opf": package.encode(), "o/one.xhtml": page, "o/two.xhtml": b"<html/>"})


def mobi(id_: str, lang: str, text: str) -> bytes:
    fields = [(100, f"{a} {b}") for a, b in AUTHORS] + [(503, f"Book {id_}"), (524, lang)]
    body = b"".join(struct.pack(">II", k, 8 + len(v.encode())) + v.encode() for k, v in fields)
    exth = b"EXTH" + struct.pack(">II", 12 + len(body), len(fields)) + body
    page = f"<p>{_plain(text)}</p>".encode()
    head = bytearray(248)
    struct.pack_into(">HHIHHH", head, 0, 1, 0, len(page), 1, 4096, 0)
    head[16:20] = b"MOBI"
    struct.pack_into(">III", head, 20, 232, 2, 65001)
    struct.pack_into(">I", head, 128, 0x40)
    records, at, out = [bytes(head) + exth, page], 78 + 16, bytearray(78)
    out[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", out, 76, len(records))
    for r in records:
        out += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(out) + b"".join(records)
