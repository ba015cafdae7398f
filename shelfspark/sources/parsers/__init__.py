"""Book files to metadata: one row of bytes in, one row of fields out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ...shipping import ship
from .book import extract

SCHEMA = "id string, source_type string, title string, authors array<string>, genres array<string>, series string, series_number double, annotation string, preview string, language string, inner_format string, cover_mime_type string, cover binary, warning string, error string, error_message string"
#: Rows of a batch; a file may be large.
ROWS = 8


def extract_metadata(files: DataFrame) -> DataFrame:
    """P-01: (id, name, source_type, content) -> metadata. A file that can't be parsed gives a row with ``error``; nothing else is swallowed."""
    ship(files.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), ROWS):
                yield pd.DataFrame([extract(r.id, r.name, r.source_type, r.content) for r in b.iloc[i : i + ROWS].itertuples(index=False)], columns=names)

    return files.select("id", "name", "source_type", "content").mapInPandas(run, SCHEMA)
