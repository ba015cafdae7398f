"""F-14, S-23: web pages to text lines."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from ..shipping import ship

# Elements that stand on lines of their own.
OWN_LINE = frozenset(
    "address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: Encodings of pages without a declaration, the likeliest first; the last is read with replacements if none fits.
ENCODINGS = ("utf-8", "cp1251")


def page_text(data: bytes | str) -> str:
    """S-23: the first of ENCODINGS that fits, else the first one with replacements."""
    if isinstance(data, str):
        return data
    for encoding in ENCODINGS:
        with contextlib.suppress(UnicodeDecodeError):
            return data.decode(encoding)
    return data.decode(ENCODINGS[0], "replace")


def events(source: str) -> list[tuple[str, str]]:
    """("open", tag), ("close", tag) and ("text", characters), in order."""
    out: list[tuple[str, str]] = []
    p = HTMLParser(convert_charrefs=True)
    p.handle_starttag = lambda tag, attrs: out.append(("open", tag))
    p.handle_endtag = lambda tag: out.append(("close", tag))
    p.handle_data = lambda text: out.append(("text", text))
    p.feed(source)
    p.close()
    return out


def lines(source: str) -> list[str]:
    """F-14: the text of a page, scripts included; elements of OWN_LINE end a line, blanks inside it are one, empty lines go."""
    text = "".join(x if kind == "text" else "\n" for kind, x in events(source) if kind == "text" or x in OWN_LINE)
    whole = (re.sub("[ \t]+", " ", x).strip() for x in text.replace("\u00a0", " ").splitlines())
    return [x for x in whole if x]


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, html as text or bytes) -> (page_id, pos, line)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, x) for i, h in zip(b["page_id"], b["html"]) if h is not None for n, x in enumerate(lines(page_text(h)))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "line"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos long, line string")
