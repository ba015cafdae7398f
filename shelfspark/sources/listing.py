"""S-01: children of folders, listed page by page, as a Spark data source.

A store of pages has one file a page, ``parent=<id>/token=<token>/``, the first one's token being
``first``. A page is a JSON object: ``files`` (a list), ``nextPageToken`` unless it is the last, and
``incompleteSearch`` where the lister gave up. Parents are dealt to partitions; a parent's pages are
followed by their tokens in one task, a page in memory at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..shipping import ship

# Names of a page's fields, and of a file's.
FIELDS = {"id": "id", "name": "name", "mime_type": "mimeType", "size": "size", "modified_time": "modifiedTime", "md5_checksum": "md5Checksum", "resource_key": "resourceKey", "trashed": "trashed"}
SCHEMA = "parent_id string, id string, name string, mime_type string, size long, modified_time string, md5_checksum string, resource_key string, trashed boolean"
PAGE_SIZE = 1000
FIRST = "first"


class ListingError(Exception):
    """A listing that can't be trusted; ``code`` says why."""

    def __init__(self, code: str, parent: str, token: str):
        super().__init__(f"{code}: folder {parent}, page {token}")
        self.code = code


class Parents(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


def _children(files: fs.FileSystem, at: str, kind: fs.FileType) -> list[str]:
    return sorted(f.path for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == kind and not f.base_name.startswith(("_", ".")))


class ListingReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partitions: int):
        self.path, self.schema, self.most = path, schema, partitions
        self.wanted: set[str] | None = None
        self.trashed: bool | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Which parents are read, and whether what is in the bin, is decided here; all other filters are Spark's."""
        for f in filters:
            binned = not f.child.value if isinstance(f, Not) and isinstance(f.child, EqualTo) else f.value if isinstance(f, EqualTo) else None
            on = getattr(f.child if isinstance(f, Not) else f, "attribute", None)
            if isinstance(f, (EqualTo, In)) and on == ("parent_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            elif on == ("trashed",) and binned is not None and self.trashed in (None, binned):
                self.trashed = binned
            elif not (isinstance(f, IsNotNull) and on in (("parent_id",), ("trashed",))):  # neither is ever null
                yield f

    def partitions(self) -> list[Parents]:
        files, at = fs.FileSystem.from_uri(self.path)
        names = [p.rsplit("/parent=", 1)[1] for p in _children(files, at, fs.FileType.Directory) if "/parent=" in p]
        names = [n for n in names if self.wanted is None or unquote(n) in self.wanted]
        return [Parents(names[i :: self.most]) for i in range(min(self.most, len(names)))] or [Parents([])]

    def read(self, partition: Parents) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(self.path)
        arrow = to_arrow_schema(self.schema)
        for name in partition.names:
            for its in self._pages(files, f"{at}/parent={name}", unquote(name)):
                rows = [{"parent_id": unquote(name), **{k: f.get(v) for k, v in FIELDS.items()}} for f in its]
                for r in rows:
                    r["size"], r["trashed"] = None if r["size"] is None else int(r["size"]), bool(r["trashed"])
                rows = [r for r in rows if self.trashed is None or r["trashed"] == self.trashed]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in arrow.names} for r in rows], schema=arrow)

    def _pages(self, files: fs.FileSystem, at: str, parent: str) -> Iterator[list[dict]]:
        token, seen = FIRST, set()
        while token:
            body = b"".join(files.open_input_stream(p).read() for p in _children(files, f"{at}/token={token}", fs.FileType.File))
            try:
                page = json.loads(body)
            except ValueError as e:
                raise ListingError("invalid_folder_response", parent, token) from e
            if isinstance(page, dict) and page.get("incompleteSearch"):
                raise ListingError("incomplete_folder_list", parent, token)
            if not isinstance(page, dict) or not isinstance(page.get("files"), list):
                raise ListingError("invalid_folder_response", parent, token)
            yield page["files"]
            token = page.get("nextPageToken") or ""
            if token and token in seen:
                raise ListingError("repeated_page_token", parent, token)
            seen.add(token)


class Listing(DataSource):
    """``spark.read.format("listing").load(path)``; option ``partitions``: as many tasks at most."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options["path"], schema, int(self.options.get("partitions", 64)))


def listing(spark: SparkSession, path: str, parents: list[str] | None = None, folders_only: bool = False, folder_type: str = "application/vnd.google-apps.folder") -> DataFrame:
    """Children of all folders, or of these, that are not in the bin. Filters go to the reader where ``spark.sql.python.filterPushdown.enabled`` is set, which this does."""
    ship(spark)
    spark.dataSource.register(Listing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.read.format("listing").option("partitions", n).load(path).where(~F.col("trashed"))
    if parents is not None:
        rows = rows.where(F.col("parent_id").isin(parents))
    return rows.where(F.col("mime_type") == folder_type) if folders_only else rows


def write_pages(items: DataFrame, path: str, size: int = PAGE_SIZE) -> None:
    """Items (parent_id and the fields of SCHEMA that there are) as such a store, in the order of their ids. A page holds ``size`` files at most."""
    have = [c for c in _parse_datatype_string(SCHEMA).names if c in items.columns and c != "parent_id"]
    place = F.row_number().over(W.partitionBy("parent_id").orderBy("id"))
    rows = items.withColumn("page", F.floor((place - 1) / size)).withColumn("n", F.count("*").over(W.partitionBy("parent_id")))
    file = F.struct(*[F.col(c).alias(FIELDS[c]) for c in have])
    pages = rows.groupBy("parent_id", "page").agg(F.sort_array(F.collect_list(F.struct("id", file.alias("file")))).alias("files"), F.first("n").alias("n"))
    token = F.concat(F.lit("t"), (F.col("page") + 1).cast("string"))
    body = F.struct(F.col("files.file").alias("files"), F.when((F.col("page") + 1) * size < F.col("n"), token).alias("nextPageToken"), F.lit(False).alias("incompleteSearch"))
    name = F.when(F.col("page") == 0, FIRST).otherwise(F.concat(F.lit("t"), F.col("page").cast("string")))
    pages.select(F.col("parent_id").alias("parent"), name.alias("token"), F.to_json(body).alias("value")).write.partitionBy("parent", "token").text(path)
