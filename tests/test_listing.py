import json

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import _parse_datatype_string

from shelfspark.sources import listing as L


@pytest.fixture
def store(spark, tmp_path):
    rows = [(p, f"{p}{i}", f"name {i}", "application/vnd.google-apps.folder" if i % 4 == 0 else "text/plain", i, i % 3 == 0) for p in ("a", "b b", "c/ü", "d") for i in range(10)]
    at = f"file://{tmp_path}/pages"
    L.write_pages(spark.createDataFrame(rows, "parent_id string, id string, name string, mime_type string, size long, trashed boolean"), at, 3)
    return at, rows


def put(path, parent, token, page):
    d = path / f"parent={parent}" / f"token={token}"
    d.mkdir(parents=True)
    (d / "part-0.txt").write_text(page if isinstance(page, str) else json.dumps(page), encoding="utf-8")


def test_all_pages_of_all_parents(spark, store):
    at, rows = store
    got = sorted((r.parent_id, r.id, r.name, r.size, r.trashed) for r in L.listing(spark, at).collect())
    assert got == sorted((p, i, n, s, t) for p, i, n, _, s, t in rows if not t)
    assert {r.id for r in L.listing(spark, at, ["c/ü"], folders_only=True).collect()} == {"c/ü4", "c/ü8"}
    assert L.listing(spark, at, ["none"]).count() == 0


def test_filters_reach_the_reader(spark, store):
    r = L.ListingReader(store[0], _parse_datatype_string(L.SCHEMA), 8)
    left = list(r.pushFilters([EqualTo(("parent_id",), "a"), In(("parent_id",), ("a", "b b")), EqualTo(("trashed",), False), EqualTo(("name",), "x"), GreaterThan(("size",), 3)]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "GreaterThan"] and left[0].attribute == ("name",)
    assert [p.names for p in r.partitions()] == [["a"]] and r.trashed is False
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 6
    # what the reader has taken is no filter of Spark's any more; names are
    from pyspark.sql import functions as F

    plan = L.listing(spark, store[0], ["a"]).where(F.col("name") == "x")._jdf.queryExecution().executedPlan().toString()
    kept = [x.split("BatchScan")[0] for x in plan.splitlines() if "Filter (" in x]
    assert len(kept) == 1 and "= x" in kept[0] and "trashed" not in kept[0] and "parent_id" not in kept[0]


def test_a_parents_pages_end_with_the_last_token(spark, tmp_path):
    put(tmp_path, "p", "first", {"files": [{"id": "1", "name": "x"}], "nextPageToken": "k"})
    put(tmp_path, "p", "k", {"files": [{"id": "2", "size": "7"}]})
    put(tmp_path, "p", "unused", {"files": [{"id": "3"}]})
    assert sorted((r.id, r.size) for r in L.listing(spark, str(tmp_path)).collect()) == [("1", None), ("2", 7)]


@pytest.mark.parametrize(
    ("pages", "code"),
    [
        ({"first": {"files": [], "incompleteSearch": True}}, "incomplete_folder_list"),
        ({"first": {"files": [], "nextPageToken": "same"}, "same": {"files": [], "nextPageToken": "same"}}, "repeated_page_token"),
        ({"first": {"files": [], "nextPageToken": "x"}, "x": {"files": [], "nextPageToken": "y"}, "y": {"files": [], "nextPageToken": "x"}}, "repeated_page_token"),
        ({"first": {}}, "invalid_folder_response"),
        ({"first": {"files": {}}}, "invalid_folder_response"),
        ({"first": []}, "invalid_folder_response"),
        ({"first": "{oops"}, "invalid_folder_response"),
        ({"first": {"files": [], "nextPageToken": "gone"}}, "invalid_folder_response"),
    ],
)
def test_listings_that_can_not_be_trusted(spark, tmp_path, pages, code):
    for token, page in pages.items():
        put(tmp_path, "p", token, page)
    reader = L.ListingReader(str(tmp_path), _parse_datatype_string(L.SCHEMA), 1)
    with pytest.raises(L.ListingError) as e:
        [b for p in reader.partitions() for b in reader.read(p)]
    assert e.value.code == code
    with pytest.raises(Exception, match=code):
        L.listing(spark, str(tmp_path)).collect()
