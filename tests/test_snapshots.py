import os

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import refresh, snapshots, store, tree
from shelfspark.operators.journal import Journal
from shelfspark.operators.snapshots import BadIndex, Conflict, Mismatch, SnapshotStore

FOLDER = store.FOLDER
HEADER = {"root_folder_id": "root"}


def rows(spark, *ids, size=1):
    return spark.createDataFrame([(i, f"{i}.fb2", size) for i in ids], "id string, file_name string, size int")


@pytest.fixture
def folders(spark):
    return spark.createDataFrame([("root", None)], "id string, parent_id string")


def test_a_snapshot_outlives_the_store_object(spark, folders, tmp_path):
    at = str(tmp_path / "s")
    assert SnapshotStore(spark, at).load("root") is None
    assert SnapshotStore(spark, at).commit(HEADER, folders, rows(spark, "a"), None) == 1
    assert SnapshotStore(spark, at).commit(HEADER, folders, rows(spark, "a", "b"), 1) == 2
    m, f, books = SnapshotStore(spark.newSession(), at).load("root")
    assert m.number == 2 and f.count() == 1 and {(r.id, r.source_type, r.metadata_status, r.migrated) for r in books.collect()} == {("a", "fb2", "pending", True), ("b", "fb2", "pending", True)}


def test_a_break_between_write_and_swap(spark, folders, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "s"))
    s.commit(HEADER, folders, rows(spark, "a"), None)
    s.write(folders, rows(spark, "lost"))  # and here it ends
    again = SnapshotStore(spark, str(tmp_path / "s"))
    assert again.current().number == 1 and [r.id for r in again.load("root")[2].collect()] == ["a"]
    assert again.commit(HEADER, folders, rows(spark, "b"), 1) == 2
    assert again.clean(keep=2) == [] and len(again.clean(keep=2, idle_ms=0)) == 1
    assert len(again.clean(keep=1, idle_ms=0)) == 1 and [r.id for r in again.load("root")[2].collect()] == ["b"]


def test_the_second_of_two_commits_fails(spark, folders, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "s"))
    one, two = s.write(folders, rows(spark, "one")), s.write(folders, rows(spark, "two"))
    assert s.swap(one, HEADER, None) == 1
    with pytest.raises(Conflict):
        s.swap(two, HEADER, None)
    # both have seen that there is room, and one is quicker
    s._numbers = lambda: []
    with pytest.raises(Conflict):
        s.swap(two, HEADER, None)
    assert [n for n in os.listdir(tmp_path / "s" / "pointer") if not n.startswith(".") or "crc" not in n] == ["0000000001"]


def test_a_mismatch_keeps_journal_and_snapshot(spark, folders, tmp_path, monkeypatch):
    s, j = SnapshotStore(spark, str(tmp_path / "s")), Journal(spark, str(tmp_path / "j"))
    s.commit(HEADER, folders, rows(spark, "a"), None)
    j.save({"n": 1}, rows(spark, "a", "b"))
    real = refresh.fingerprint
    monkeypatch.setattr(snapshots, "fingerprint", lambda df: (real(df)[0] + 1, "x") if "versions" in str(df.inputFiles()[:1]) else real(df))
    with pytest.raises(Mismatch):
        s.commit(HEADER, folders, j.load()[1], 1, j)
    monkeypatch.undo()
    assert s.current().number == 1 and j.load()[1].count() == 2
    with pytest.raises(Conflict):
        s.commit(HEADER, folders, j.load()[1], None, j)
    assert j.load()[1].count() == 2
    assert s.commit(HEADER, folders, j.load()[1], 1, j) == 2 and j.load() is None


@pytest.mark.parametrize(("header", "root", "code"), [({"root_folder_id": "other"}, "root", "invalid_index"), ({"root_folder_id": "root", "version": 9}, "root", "invalid_index"), ({}, "root", "invalid_index")])
def test_what_is_read_is_checked(spark, folders, tmp_path, header, root, code):
    s = SnapshotStore(spark, str(tmp_path / "s"))
    s.commit(header, folders, rows(spark, "a"), None)
    with pytest.raises(BadIndex) as e:
        s.load(root)
    assert e.value.code == code
    s.folder.write("pointer/0000000001", "{oops")
    with pytest.raises(BadIndex) as e:
        s.load(root)
    assert e.value.code == "index_read_failed"


def test_a_delta_writes_its_own_rows_and_its_header_with_them(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    assert j.load() is None
    j.save({"n": 0}, rows(spark, *(f"b{i}" for i in range(50))))
    name = j.save({"n": 1}, rows(spark, *(f"b{i}" for i in range(50)), size=2), rows(spark, "b3", "b4", "none"))
    assert spark.read.parquet(str(tmp_path / "j" / name)).count() == 3
    header, books = j.load()
    assert header == {"n": 1} and sorted(r.id for r in books.where("size = 2").collect()) == ["b3", "b4"] and books.count() == 50
    # without its mark a save is not seen, neither header nor books
    os.remove(tmp_path / "j" / name / "_SUCCESS")
    header, books = j.load()
    assert header == {"n": 0} and books.where("size = 2").count() == 0
    assert j.save({"n": 2, "removed_book_ids": ["b5"]}, rows(spark, "b3", size=3), rows(spark, "b3")) == "delta-0000000003"
    header, books = j.load()
    assert header["n"] == 2 and books.where("size = 3").count() == 1 and books.count() == 49
    assert j.save({"n": 3}, books) == "base-0000000004" and j.live() == ["base-0000000004"] and j.load()[1].count() == 49


def test_many_deltas_become_a_base(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"), most_deltas=3)
    j.save({"n": 0}, rows(spark, "a", "b"))
    for n in range(1, 5):
        j.save({"n": n}, rows(spark, "a", size=n), rows(spark, "a"))
    header, books = j.load()
    assert header == {"n": 4} and sorted((r.id, r.size) for r in books.collect()) == [("a", 4), ("b", 1)] and j.live()[0].startswith("base-") and len(j.live()) == 1


ITEMS = "id string, parent_id string, name string, mime_type string, trashed boolean, size int, modified_time string"


def items(spark, extra=(), without=()):
    its = [("root", None, "Library", FOLDER, False, None, None), ("f", "root", "F", FOLDER, False, None, None), ("a", "root", "a.fb2", "", False, 1, "t"), ("b", "f", "b.epub", "", False, 1, "t"), ("c", "f", "c.mobi", "", True, 1, "t")]
    return spark.createDataFrame([*[r for r in its if r[0] not in without], *extra], ITEMS)


def test_a_refresh_that_must_not_be_saved(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "s"))
    told = []
    got = store.refresh_library(items(spark), s, "root", told.append)
    assert sorted(r.id for r in got["books"].collect()) == ["a", "b"] and got["stale_covers"].count() == 0 and got["number"] == 1
    assert told == [{"processed_folders": 1, "discovered_folders": 1, "queued_folders": 1, "books": 1}, {"processed_folders": 2, "discovered_folders": 1, "queued_folders": 0, "books": 2}]
    books = s.load("root")[2].drop("migrated").withColumns({"metadata_status": F.lit("ready"), "title": F.concat(F.lit("T"), "id"), "cover_file_id": F.concat(F.lit("cover"), "id")})
    s.commit(HEADER, s.load("root")[1], books, 1)
    gone = [("root", None, "Library", FOLDER, True, None, None)]
    for bad, why in ((items(spark, without=["root"]), "no root"), (items(spark, gone, ["root"]), "no root"), (items(spark, [("root", None, "r", "text/plain", False, 1, "t")], ["root"]), "no root"), (items(spark, [("a", "f", "a.fb2", "", False, 1, "t")]), "repeated"), (items(spark, without=["f"]), "unknown parent")):
        with pytest.raises(store.RefreshError, match=why):
            store.refresh_library(bad, s, "root")
        assert s.current().number == 2 and s.load("root")[2].count() == 2
    # b has changed, a is in the bin: their covers go; metadata of what is the same stays
    changed = items(spark, [("a", "root", "a.fb2", "", True, 1, "t"), ("b", "f", "b.epub", "", False, 2, "t"), ("d", "root", "d.zip", "", False, 1, "t")], ["a", "b"])
    got = store.refresh_library(changed, s, "root")
    assert sorted((r.id, r.metadata_status, r.title) for r in got["books"].collect()) == [("b", "pending", None), ("d", "pending", None)]
    assert sorted(r.cover_file_id for r in got["stale_covers"].collect()) == ["covera", "coverb"] and s.current().number == 3


def test_a_commit_that_fails_names_no_cover(spark, tmp_path, monkeypatch):
    s = SnapshotStore(spark, str(tmp_path / "s"))
    store.refresh_library(items(spark), s, "root")
    monkeypatch.setattr(s, "swap", lambda *a: (_ for _ in ()).throw(Conflict("late")))
    with pytest.raises(Conflict):
        store.refresh_library(items(spark, without=["a"]), s, "root")
    monkeypatch.undo()
    assert s.current().number == 1 and s.load("root")[2].count() == 2


def test_pointers_jump(spark, monkeypatch):
    """A chain of 5,000, a comb, cycles and what hangs on them: in so many rounds that the depth doubles, and as a loop finds it."""
    parents = {f"n{i}": f"n{i - 1}" if i else None for i in range(5000)} | {f"t{i}": f"n{i * 7 % 5000}" for i in range(300)} | {f"c{i}": f"c{(i + 1) % 37}" for i in range(37)} | {f"d{i}": f"c{i % 37}" if i % 5 == 0 else f"d{i - 1}" for i in range(60)} | {"s": "s", "u": "unknown"}
    rounds = []
    real = tree.stage
    monkeypatch.setattr(tree, "stage", lambda df, name: (rounds.append(name), real(df, name))[1])
    got = {r.node: (r.top, r.steps, r.way, r.cyclic) for r in tree.climb(spark.createDataFrame(list(parents.items()), "node string, parent string"), F.col("node")).collect()}
    assert rounds.count("climb") - 1 <= 14
    want = {}
    for node in parents:
        trail, at = {}, node
        while at not in want and at not in trail:
            trail[at] = None
            at = parents[at] if parents[at] in parents else at
            if at in trail and parents[at] not in parents:
                want[at] = (at, 0, "", False)
        for x in reversed(trail):
            up = want.get(parents[x])
            if x not in want:
                want[x] = (up[0], up[1] + 1, f"{up[2]} / {x}".removeprefix(" / "), False) if up and not up[3] else (None, None, None, True)
    assert got == want and sum(x[3] for x in want.values()) == 37 + 60 + 1
