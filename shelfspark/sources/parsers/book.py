"""P-01: from a file's kind and bytes to its metadata."""

from __future__ import annotations

from . import archive, epub, fb2, mobi
from .text import FormatError

FIELDS = "title authors genres series series_number annotation preview language inner_format cover_mime_type cover warning".split()
PARSERS = {"fb2": fb2.parse, "epub": epub.parse, "mobi": mobi.parse}


def from_zip(name: str, data: bytes) -> dict:
    z = archive.open_zip(data)
    e, warning = archive.choose(z, name)
    kind = archive.entry_format(e.filename)
    archive.check(z.infolist(), e, len(data), large=kind == "fb2")
    if kind == "fb2" and e.file_size > archive.MOST_OUT:
        got = fb2.title_info(fb2.description_only(archive.read_until(z, e, b"</description>").decode("utf-8", "replace")))
        got.pop("cover_id")
        got["warning"] = "metadata_only_recovered"
    else:
        got = PARSERS[kind](archive.read(z, e))
    got["warning"] = got.get("warning") or warning
    return got | {"inner_format": kind}


def parse(name: str, kind: str, data: bytes) -> dict:
    if kind == "zip" or kind == "fb2" and data[:2] == b"PK":
        return from_zip(name, data)
    if kind not in PARSERS:
        raise FormatError("unsupported", kind)
    return PARSERS[kind](data)


def extract(id_: str, name: str, kind: str, data: bytes | None) -> tuple:
    """A row of the output; errors of format become columns."""
    got, error, message = {}, None, None
    try:
        if not data:
            raise FormatError("empty")
        got = parse(name or "", kind, bytes(data))
    except FormatError as e:
        error, message = e.code, str(e)[:240]
    return (id_, kind, *(got.get(f, [] if f in ("authors", "genres") else None) for f in FIELDS), error, message)
