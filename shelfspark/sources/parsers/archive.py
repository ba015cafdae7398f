"""ZIP archives within budgets: directory, choice of the book, safe reads."""

from __future__ import annotations

import io
import zipfile
import zlib

from .text import FormatError

# Budgets of a file, an entry, all entries, their number, the ratio, the directory and a description.
MOST_IN, MOST_OUT, MOST_ALL, MOST_ENTRIES, MOST_RATIO, MOST_DIRECTORY, MOST_DESCRIPTION = 64 << 20, 128 << 20, 512 << 20, 4096, 500, 4 << 20, 8 << 20
BOOKS = ("fb2", "epub", "mobi")


def open_zip(data: bytes) -> zipfile.ZipFile:
    """S-24: end of the central directory in the last 65,557 bytes; multi-disk and ZIP64 archives are refused."""
    at = data.rfind(b"PK\5\6", max(0, len(data) - 65_557))
    if at < 0:
        raise FormatError("zip_no_directory")
    disk, start, here, n, size, offset = (int.from_bytes(data[at + a : at + b], "little") for a, b in ((4, 6), (6, 8), (8, 10), (10, 12), (12, 16), (16, 20)))
    if disk or start or here != n:
        raise FormatError("zip_multi_disk")
    if n == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        raise FormatError("zip64")
    if n > MOST_ENTRIES:
        raise FormatError("zip_too_many_entries")
    if size > MOST_DIRECTORY:
        raise FormatError("zip_directory_too_large")
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError) as e:
        raise FormatError("zip_damaged", str(e)) from e


def entry_format(name: str) -> str | None:
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return ext if ext in BOOKS else None


def suitable(entries: list[zipfile.ZipInfo]) -> list[zipfile.ZipInfo]:
    """FI-13."""
    bad = lambda n: "__macosx" in n.lower().split("/") or n.lower().endswith("thumbs.db")
    return [e for e in entries if not e.is_dir() and not bad(e.filename) and entry_format(e.filename)]


def check(entries: list[zipfile.ZipInfo], e: zipfile.ZipInfo, size: int, large: bool = False) -> None:
    """A-15, V-05."""
    if size > MOST_IN and not large:
        raise FormatError("zip_too_large")
    if sum(x.file_size for x in entries) > MOST_ALL:
        raise FormatError("zip_total_too_large")
    if e.file_size > MOST_OUT and not large:
        raise FormatError("zip_entry_too_large")
    if e.file_size > MOST_RATIO * max(1, e.compress_size):
        raise FormatError("zip_ratio")
    if e.flag_bits & 1:
        raise FormatError("zip_encrypted")
    if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise FormatError("zip_method")


def choose(z: zipfile.ZipFile, name: str) -> tuple[zipfile.ZipInfo, str | None]:
    """P-09: the entry to read, and a warning if there were several. ``.fb2.zip`` has only fb2; another double extension is preferred."""
    found = suitable(z.infolist())
    parts = name.lower().split(".")
    inner = parts[-2] if len(parts) > 2 and parts[-1] == "zip" else None
    if inner == "fb2":
        found = [e for e in found if entry_format(e.filename) == "fb2"]
    if not found:
        raise FormatError("zip_no_book")
    preferred = [e for e in found if entry_format(e.filename) == inner]
    return (preferred or found)[0], "several_books" if len(found) > 1 else None


def read(z: zipfile.ZipFile, e: zipfile.ZipInfo) -> bytes:
    try:
        data = z.read(e)
    except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError) as err:
        raise FormatError("zip_damaged", str(err)) from err
    if len(data) != e.file_size:
        raise FormatError("zip_damaged")
    return data


def read_until(z: zipfile.ZipFile, e: zipfile.ZipInfo, end: bytes, most: int = MOST_DESCRIPTION) -> bytes:
    """P-10: the head of an entry up to ``end``, within a budget."""
    out = bytearray()
    with z.open(e) as f:
        while len(out) < most:
            part = f.read(min(1 << 16, most - len(out)))
            if not part:
                break
            seen = max(0, len(out) - len(end))
            out += part
            at = out.find(end, seen)
            if at >= 0:
                return bytes(out[: at + len(end)])
    raise FormatError("description_too_long")
