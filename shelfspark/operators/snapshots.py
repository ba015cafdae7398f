"""K-01, K-04, S-11: snapshots of a catalog that outlive the session.

A store is a folder. ``versions/<name>/`` holds the books and folders of one snapshot, as Parquet;
``pointer/<number>`` is a small manifest that says which of them is current, the highest number
counting. A commit writes a version, reads it back, and only if it is equal publishes the next
pointer, which fails if somebody else has published one since the commit began. So a break at any
place leaves the former snapshot current; what was written by then is of no effect, and ``clean``
removes it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.hadoop import Folder
from .journal import Journal
from .refresh import fingerprint, index_problems, migrate

# Fixed value: the present version of an index.
INDEX_VERSION = 4


class Conflict(RuntimeError):
    """Another commit came first."""


class Mismatch(RuntimeError):
    """What was written reads back unlike what was to be written."""


class BadIndex(ValueError):
    def __init__(self, code: str, why: str):
        super().__init__(f"{code}: {why}")
        self.code = code


@dataclass(frozen=True)
class Manifest:
    number: int
    version: str
    header: dict
    books: tuple
    folders: tuple


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def _numbers(self) -> list[int]:
        return [int(n) for n in self.folder.names("pointer") if n.isdigit()]

    def current(self) -> Manifest | None:
        numbers = self._numbers()
        if not numbers:
            return None
        try:
            m = json.loads(self.folder.read(f"pointer/{max(numbers):010d}"))
            return Manifest(m["number"], m["version"], m["header"], tuple(m["books"]), tuple(m["folders"]))
        except (ValueError, KeyError, TypeError) as e:
            raise BadIndex("index_read_failed", "the pointer can't be read") from e

    def _table(self, version: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/versions/{version}/{name}")

    def write(self, folders: DataFrame, books: DataFrame) -> tuple[str, tuple, tuple]:
        """A version that nothing points to yet: (name, fingerprints of books and folders), read back and found equal."""
        version, digests = uuid.uuid4().hex, {}
        for name, df in (("folders", folders), ("books", books)):
            before = fingerprint(df)
            df.write.parquet(f"{self.folder.path}/versions/{version}/{name}")
            digests[name] = fingerprint(self._table(version, name))
            if digests[name] != before:
                raise Mismatch(f"{name} read back unlike what was written; nothing was published")
        return version, digests["books"], digests["folders"]

    def swap(self, written: tuple[str, tuple, tuple], header: dict, expected: int | None) -> int:
        """Publishes a written version if the current number is still ``expected`` (None: there is none)."""
        at = max(self._numbers(), default=None)
        if at != expected:
            raise Conflict(f"expected snapshot {expected}, found {at}")
        number = (expected or 0) + 1
        m = Manifest(number, written[0], {"version": INDEX_VERSION} | header, written[1], written[2])
        if not self.folder.publish(f"pointer/{number:010d}", json.dumps(asdict(m))):
            raise Conflict(f"snapshot {number} is there already")
        return number

    def commit(self, header: dict, folders: DataFrame, books: DataFrame, expected: int | None, journal: Journal | None = None) -> int:
        """The number of the new snapshot. The journal of the run goes only when the new snapshot is current; any error keeps it."""
        number = self.swap(self.write(folders, books), header, expected)
        if journal is not None:
            journal.remove()
        return number

    def load(self, root: str) -> tuple[Manifest, DataFrame, DataFrame] | None:
        """(manifest, folders, books) of the current snapshot, checked and brought to the present form; None without one.

        ``migrated`` of a book's row says whether the row was changed. A snapshot of another root or of an unknown version, or
        without its tables, is a BadIndex."""
        m = self.current()
        if m is None:
            return None
        have = {n: self.folder.exists(f"versions/{m.version}/{n}/_SUCCESS") for n in ("folders", "books")}
        there = lambda n: F.when(F.lit(have[n]), F.array().cast("array<string>"))
        head = self.spark.range(1).select(F.lit(m.header.get("version")).cast("int").alias("version"), F.lit(m.header.get("root_folder_id")).alias("root_folder_id"), there("folders").alias("folders"), there("books").alias("books"))
        problem = index_problems(head, root).first()
        if problem is not None:
            raise BadIndex("invalid_index", problem.problem)
        books = self._table(m.version, "books")
        for c, kind in (("file_name", "string"), ("extension", "string"), ("source_type", "string"), ("metadata_status", "string"), ("authors", "array<string>"), ("entry_path", "string")):
            if c not in books.columns:
                books = books.withColumn(c, F.lit(None).cast(kind))
        return m, self._table(m.version, "folders"), migrate(books)

    def clean(self, keep: int = 2, idle_ms: int = 3_600_000) -> list[str]:
        """Removes versions that none of the newest ``keep`` pointers names, unless they are younger than ``idle_ms`` (a commit may be under way), and older pointers; returns the versions."""
        numbers = sorted(self._numbers())
        named = {json.loads(self.folder.read(f"pointer/{n:010d}"))["version"] for n in numbers[-keep:]}
        old = [v for v in self.folder.names("versions") if v not in named and self.folder.age_ms(f"versions/{v}") >= idle_ms]
        for n in numbers[:-keep]:
            self.folder.remove(f"pointer/{n:010d}")
        for v in old:
            self.folder.remove(f"versions/{v}")
        return old
