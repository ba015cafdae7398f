"""K-03, S-12: working data of a run as a base and an append-only journal.

A save is one folder, ``base-<n>`` or ``delta-<n>``, written by one Spark job; it counts once its
``_SUCCESS`` is there, so header and books of a save are seen together or not at all. A delta has its
own rows only. The last save of a book wins when the journal is read. A full save is the new base,
and then removes what came before it; a reader that comes in between passes over it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.hadoop import Folder

#: So many deltas are laid over a base at most; the next save is a full one.
MOST_DELTAS = 64
#: The header's field with ids of books that are gone.
REMOVED = "removed_book_ids"


class Journal:
    def __init__(self, spark: SparkSession, path: str, most_deltas: int = MOST_DELTAS):
        self.spark, self.folder, self.most_deltas = spark, Folder(spark, path), most_deltas

    def _saves(self, whole: bool = True) -> list[tuple[int, str]]:
        names = [n for n in self.folder.names() if n.startswith(("base-", "delta-"))]
        return sorted((int(n.split("-")[1]), n) for n in names if not whole or self.folder.exists(f"{n}/_SUCCESS"))

    def live(self) -> list[str]:
        """The newest base and the deltas after it; nothing without a base."""
        saves = self._saves()
        base = max((n for n, name in saves if name.startswith("base-")), default=None)
        return [] if base is None else [name for n, name in saves if n > base or name.startswith("base-") and n == base]

    def save(self, header: dict, books: DataFrame, changed: DataFrame | None = None) -> str:
        """A full save, or with ``changed`` (id) one of the header and of the books with these ids; ids without a book are passed over."""
        live = self.live()
        if changed is not None and len(live) > self.most_deltas:
            last = self.load()[1]
            books = last.join(changed.select("id").distinct(), "id", "left_anti").unionByName(books.join(changed.select("id").distinct(), "id", "left_semi"))
            changed = None
        n = max((n for n, _ in self._saves(whole=False)), default=0) + 1
        rows = books if changed is None else books.join(changed.select("id").distinct(), "id", "left_semi")
        rows = rows.select(F.lit(n).cast("long").alias("seq"), F.lit(None).cast("string").alias("header"), F.struct(*books.columns).alias("book"))
        head = self.spark.range(1).select(F.lit(n).cast("long").alias("seq"), F.lit(json.dumps(header)).alias("header"), F.lit(None).cast(rows.schema["book"].dataType).alias("book"))
        name = f"{'base' if changed is None else 'delta'}-{n:010d}"
        rows.unionByName(head).write.parquet(f"{self.folder.path}/{name}")
        if changed is None:
            for m, old in self._saves(whole=False):
                if m < n:
                    self.folder.remove(old)
        return name

    def load(self) -> tuple[dict, DataFrame] | None:
        """(header, books), or None where nothing was saved."""
        live = self.live()
        if not live:
            return None
        rows = self.spark.read.parquet(*[f"{self.folder.path}/{name}" for name in live])
        header = json.loads(rows.where("header is not null").agg(F.max_by("header", "seq").alias("h")).first().h)
        books = rows.where("book is not null").groupBy(F.col("book.id").alias("id")).agg(F.max_by("book", "seq").alias("book")).select("book.*")
        if header.get(REMOVED):
            gone = self.spark.createDataFrame([(i,) for i in header[REMOVED]], "id string")
            books = books.join(gone, "id", "left_anti")
        return header, books

    def remove(self) -> None:
        self.folder.remove()
