import pytest
from pyspark.sql import functions as F

from shelfspark.operators import admin, catalog, genres, limits, refresh, social, tree

FOLDERS = [("root", None, "Root"), ("a", "root", "A"), ("b", "a", "B"), ("e", "root", "Empty"), ("x", "y", "X"), ("y", "x", "Y"), ("d", "gone", "D")]


@pytest.fixture(scope="module")
def folders(spark):
    return spark.createDataFrame(FOLDERS, "id string, parent_id string, name string")


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame([("1", "root", "r.fb2", None), ("2", "b", "b.fb2", None), ("3", "x", "x.fb2", "old/x"), ("4", "gone", "g.fb2", None)], "id string, parent_id string, file_name string, path string")


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_tree(folders, books):
    assert ids(tree.folders_with_books(folders, books)) == ["a", "b", "root", "x", "y"]
    assert {r.id: r.path for r in tree.book_paths(folders, books, "root").collect()} == {"1": "r.fb2", "2": "A / B / b.fb2", "3": "old/x", "4": None}
    assert ids(tree.shared_books(folders, books, "root", ["a"])) == ["1"]
    assert ids(tree.shared_books(folders, books, "root", [])) == ["1", "2"]
    assert ids(tree.shareable_folders(folders, books, "root")) == ["a"]
    counts = {r.id: (r.folder_count, r.book_count) for r in tree.child_counts(folders, books, "root").collect()}
    assert counts["root"] == (2, 1) and counts["e"] == (0, 0)


def test_forest_marks_cycles(spark):
    u = spark.createDataFrame([("a", None), ("b", "a"), ("c", "nobody"), ("p", "q"), ("q", "p"), ("r", "q")], "uid string, invited_by string")
    got = {r.uid: (r.root, r.depth, r.cyclic) for r in tree.forest(u).collect()}
    assert got == {"a": ("a", 0, False), "b": ("a", 1, False), "c": ("c", 0, False), "p": (None, None, True), "q": (None, None, True), "r": (None, None, True)}


def test_ancestry(spark):
    rows = [("root", None, False), ("a", "root", False), ("t", "root", True), ("u", "t", False), ("m", "missing", False), ("o", None, False), ("x", "y", False), ("y", "x", False)]
    got = {r.id: r.state for r in tree.ancestry(spark.createDataFrame(rows, "id string, parent_id string, trashed boolean"), "root").collect()}
    assert got == {"root": "inside", "a": "inside", "t": "excluded", "u": "excluded", "m": "undetermined", "o": "excluded", "x": "undetermined", "y": "undetermined"}


def test_search_is_and_of_words_over_fields(spark):
    b = spark.createDataFrame([(1, "War and Peace", None, "about  Moscow", "w.fb2", ["Lev Tolstoy", None], ["prose"], "ru"), (2, None, "Peace", None, "x.fb2", None, None, None)], "pos int, title string, series string, annotation string, file_name string, authors array<string>, genres array<string>, language string")
    find = lambda **k: ids(catalog.search(b, **k), "pos")
    assert find(query=" PEACE tolstoy") == [1] and find(query="peace") == [1, 2] and find(query="prose") == []
    assert find(title="x.fb2") == [] and find(language="rus") == [1] and find() == [1, 2] and find(author="lev") == [1]


def test_pages():
    assert catalog.clamp_page(51, 2) == (2, 2, 50) and catalog.clamp_page(51, "9.7", -1) == (2, 2, 50) and catalog.clamp_page(0, 5, 10) == (1, 0, 10) and catalog.clamp_page(10, "x", 3) == (1, 4, 3)
    c = catalog.encode_cursor("users", "ann", "u1")
    assert catalog.decode_cursor(c, "users", 2) == ("ann", "u1")
    for bad in (("x", "users", 2), (c, "bans", 2), (c, "users", 1)):
        with pytest.raises(ValueError):
            catalog.decode_cursor(*bad)


def test_preserve_and_reset(spark):
    s = "id string, source_type string, modified_time string, size long, metadata_status string, title string"
    prev = spark.createDataFrame([("same", None, "t", 1, "ready", "T"), ("size", "fb2", "t", 1, "ready", "T"), ("proc", "fb2", None, None, "processing", "P"), ("gone", "fb2", "t", 1, "ready", "G")], s)
    cur = spark.createDataFrame([("same", "fb2", "t", 1, "pending", None), ("size", "fb2", "t", 2, "pending", None), ("proc", "fb2", None, None, "pending", None), ("new", "fb2", "t", 1, "pending", None)], s)
    got = {r.id: (r.metadata_status, r.title) for r in refresh.preserve_metadata(cur, prev).collect()}
    assert got == {"same": ("ready", "T"), "size": ("pending", None), "proc": ("pending", "P"), "new": ("pending", None)}


def test_friends_keep_unknown_apart_from_false(spark):
    rows = spark.createDataFrame([("a", None, True), ("b", False, False), ("c", None, None)], "uid string, inbound boolean, outbound boolean")
    seen = spark.createDataFrame([("b", True, None)], "uid string, inbound boolean, outbound boolean")
    got = {r.uid: (r.inbound, r.outbound) for r in social.overlay_verified(rows, seen).collect()}
    assert got == {"a": (None, True), "b": (True, False), "c": (None, None)}


def test_notifications_on_revoke_and_again(spark):
    ev = spark.createDataFrame([("v", "k1", "n", 1, False), ("v", "k2", "n", 1, True)], "viewer string, notification_key string, display_name string, created_at int, unread boolean")
    inbound = spark.createDataFrame([("v", "k2", "N2", 5), ("v", "k3", "N3", 5)], "viewer string, notification_key string, display_name string, created_at int")
    got = {r.notification_key: (r.created_at, r.unread) for r in social.sync_notifications(ev, inbound, ev).collect()}
    assert got == {"k2": (1, True), "k3": (5, True)}


def test_budget_is_all_or_nothing(spark):
    rows = [("u", float(i), i, [f"a{i}"]) for i in range(31)] + [("u", 31.0, 31, ["a5"]), ("u", 700.0, 32, [f"b{i}" for i in range(31)]), ("u", 701.0, 33, ["c"]), ("w", 0.0, 40, None)]
    got = {r.pos: (r.accepted, r.charged) for r in limits.lookup_budget(spark.createDataFrame(rows, "uid string, t double, pos long, addresses array<string>")).collect()}
    assert all(got[i] == (True, 1) for i in range(30)) and got[30] == (False, 0) and got[31] == (True, 0) and got[32] == (False, 0) and got[33] == (True, 1) and got[40] == (True, 0)


def test_reservations(spark):
    rows = [("k", 0.0, 0, "reserve"), ("k", 10.0, 1, "reserve"), ("k", 700.0, 2, "reserve"), ("k", 710.0, 3, "sent"), ("k", 900.0, 4, "reserve"), ("k", 5000.0, 5, "reserve"), ("k", 5001.0, 6, "failed"), ("k", 5002.0, 7, "reserve")]
    got = [r.status for r in limits.send_reservations(spark.createDataFrame(rows, "uid string, t double, pos long, op string")).orderBy("pos").collect()]
    assert got == ["reserved", "sending", "reserved", "sent", "cooldown", "reserved", "failed", "reserved"]


def test_reservations_with_what_else_is_known(spark):
    rows = [("k", 0.0, 0, "reserve", None), ("k", 5.0, 1, "failed", None), ("k", 6.0, 2, "reserve", 0), ("k", 7.0, 3, "reserve", 4), ("d", 100.0, 4, "reserve", None), ("d", 3800.0, 5, "reserve", None), ("d", 3801.0, 6, "failed", None), ("d", 3900.0, 7, "reserve", None)]
    log = spark.createDataFrame(rows, "uid string, t double, pos long, op string, quota int")
    seen = spark.createDataFrame([("d", 90.0), ("d", 150.0), ("other", 1.0)], "uid string, sent_at double")
    got = {r.pos: r.status for r in limits.send_reservations(limits.with_sent_elsewhere(log, seen)).collect()}
    assert got == {0: "reserved", 1: "failed", 2: "quota", 3: "reserved", 4: "cooldown", 5: "reserved", 6: "failed", 7: "reserved"}
    # what the directory knew when the lease was taken is remembered by the lease
    lease = limits.Lease()
    assert [lease.reserve(4000.0, 100.0), lease.finish(4001.0, "failed"), lease.reserve(4002.0, None), lease.sent] == ["reserved", "failed", "reserved", 100.0]


def test_idle_budgets_go(spark):
    from shelfspark.functions import text as X

    rows = spark.createDataFrame([("old", [5, 10]), ("new", [5, 90_000]), ("edge", [13_600]), ("none", [])], "uid string, a array<long>").select("uid", X.delta36(F.col("a")).alias("times"))
    rows = rows.unionByName(spark.createDataFrame([("bad", "?"), ("null", None)], "uid string, times string"))
    assert ids(limits.prune_budgets(rows, 100_000), "uid") == ["bad", "new", "null"]
    assert limits.prune_budgets(rows, 100_000, 90_000) is rows and ids(limits.prune_budgets(rows, 100_000, 70_000), "uid") == ["bad", "new", "null"]


def test_genres_refuse_to_shrink(spark):
    old, new = spark.createDataFrame([("a", "A"), ("b", "B")], "code string, label string"), spark.createDataFrame([("a", "A")], "code string, label string")
    assert genres.check_growth(old, new) is old
    with pytest.raises(ValueError):
        genres.check_growth(new, old)


def test_xsd_and_mapping_files(spark, tmp_path):
    x = spark.createDataFrame([('<s xmlns="http://x"><enumeration value="sf"/><enumeration value="det"/></s>',)], "value string")
    assert ids(genres.xsd_codes(x), "code") == ["det", "sf"]
    (tmp_path / "m.json").write_text('{"sf": " - Sci  Fi ", "bad code": "x", "det": " "}', encoding="utf-8")
    assert sorted((r.code, r.label) for r in genres.read_mapping(spark, str(tmp_path / "m.json"), "seed").collect()) == [("bad code", "x"), ("sf", "Sci Fi")]
    with pytest.raises(Exception, match="invalid genre code"):
        genres.clean_mapping(spark.createDataFrame([("a\tb", "x")], "code string, label string"), "seed").collect()
    with pytest.raises(ValueError, match="no genre codes"):
        genres.xsd_codes(spark.createDataFrame([("<s/>",)], "value string"))


def test_redaction(spark):
    u = spark.createDataFrame([("u", "write to a@example.com", "a@example.com")], "uid string, note string, email string")
    assert tuple(admin.project(u, ["uid", "note", "email"], ["email"], False).first()) == ("u", "write to [email]", None)
    assert tuple(admin.project(u, ["uid", "email"], ["email"], True).first()) == ("u", "a@example.com")


def test_settings_and_batches(spark):
    from shelfspark.operators import publish

    s = spark.createDataFrame([("root", ["c", "a", "a", "gone"], {"a": " x ", "b": " "}), ("r2", None, None)], "root_folder_id string, excluded_folder_ids array<string>, folder_notes map<string,string>")
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, pos int")
    got = {r.root_folder_id: (r.excluded_folder_ids, r.folder_notes) for r in publish.normalize_settings(s, f).collect()}
    assert got == {"root": (["a", "c"], {"a": "x"}), "r2": ([], {})}
    done = set()

    def items():
        return spark.createDataFrame([(f"b{i}", "done" if f"b{i}" in done else "pending") for i in range(7)], "book_id string, state string")

    assert publish.run_batches(items, lambda df: df, 3, lambda df: done.update(r.book_id for r in df.collect())) == 3 and len(done) == 7
    assert publish.run_batches(items, lambda df: df, 3, lambda df: done.clear()) == 0 and len(done) == 7
    c = spark.createDataFrame([("u", "r"), ("u", "r"), ("u", "s")], "owner_uid string, root_folder_id string")
    assert sorted((r.root_folder_id, r.published, r.books) for r in publish.tombstones(c).collect()) == [("r", False, []), ("s", False, [])]


def test_catalog_order_of_russian_names(spark):
    names = ["1 a", "Ежик 2", "ежик 10", "ёлка", "Ель 9", "ель 010", "Ёль 11", "файл 2", "файл 99999999999999999999999", "файл 100000000000000000000000", "яблоко", "abc", "é", "f", "zebra 9", "zebra 10"]
    rows = spark.createDataFrame([(n, 0) for n in sorted(names)], "file_name string, pos int")
    assert [r.file_name for r in catalog.placed(rows, catalog.catalog_order()).orderBy("place").collect()] == names
    folders = spark.createDataFrame([(n, n) for n in ("Том 10", "Том 9", "том 1", "Ёж 3", "еж 12")], "id string, name string")
    assert [r.id for r in folders.orderBy(*catalog.sibling_order()).collect()] == ["Ёж 3", "еж 12", "том 1", "Том 9", "Том 10"]


def test_people_are_ordered_by_accents_and_case(spark):
    rows = spark.createDataFrame([("u9", "Ёлкин"), ("u2", "Ёлкин"), ("u5", "Елкин"), ("u1", "елкин"), ("u3", None)], "uid string, display_name string").withColumns({"unread": F.col("uid") == "u5", "created_at": F.lit(1), "notification_key": F.col("uid"), "admin": F.lit(None).cast("boolean"), "banned": F.col("uid") == "u1", "email": F.lit(None).cast("string")})
    order = lambda o: [r.uid for r in rows.orderBy(*o).collect()]
    assert order(social.friend_order()) == ["u3", "u1", "u5", "u2", "u9"]
    assert order(social.notification_order()) == ["u5", "u3", "u1", "u2", "u9"]
    assert order(admin.user_order("role")) == ["u3", "u5", "u2", "u9", "u1"] and order(admin.user_order("name")) == ["u3", "u1", "u5", "u2", "u9"]


def test_language_keys_of_tags(spark):
    from shelfspark.functions import text as X

    tags = {"ja": "японский", "ja-JP": "японский", "JA_jp": "японский", "pt": "португальский", "pt-BR": "португальский", "zh": "китайский", "zh_CN": "китайский", "cze": "чешский", "iw": "иврит", "tyv": "тувинский", " Ru-ru ": "русский", "sr-Latn": "сербский", "qx": None, "english": None, "русский": None, "i-klingon": None}
    got = {r.tag: r.key for r in spark.createDataFrame([(k,) for k in tags], "tag string").select("tag", X.language_key(F.col("tag")).alias("key")).collect()}
    assert got == {k: f"language:{v}" if v else "code:" + k.strip().lower().replace("_", "-") for k, v in tags.items()}


def test_layouts_of_mapping_pages(spark):
    lines = ["sf_history - Альтернативная история", "det—Детектив", "Психология (sci_psychology) - 11 231", "Проза &amp; быт (prose)", "0.12.9 popular_business;О бизнесе популярно", "Другая (det)", "no code here", "Детективы (DET)", "det - второй", "5 x;y"]
    got = {r.code: r.label for r in genres.page_mapping(spark.createDataFrame(list(enumerate(lines)), "pos long, line string")).collect()}
    assert got == {"sf_history": "Альтернативная история", "det": "Детектив", "sci_psychology": "Психология", "prose": "Проза & быт", "popular_business": "О бизнесе популярно"}
    rows = [(" sci-fi ", "- Фантастика –"), ("проза", "Проза"), ("a b", "C &amp;  D"), ("x" * 128, "long"), (" ", "blank"), ("empty", " - ")]
    got = {r.code: r.label for r in genres.clean_mapping(spark.createDataFrame(rows, "code string, label string"), "seed", 2).collect()}
    assert got == {"sci-fi": "Фантастика", "проза": "Проза", "a b": "C & D", "x" * 128: "long"}


def test_dictionary_files_are_one_sorted_object(spark, tmp_path):
    import json

    new = {f"code {i}": f'"label" \\ {i},' for i in range(57)} | {"é": "ё", "a\"b": "x\ny"}
    rows = spark.createDataFrame(list(new.items()), "code string, label string")
    genres.write_dictionary(rows, str(tmp_path / "d"), rows.limit(5))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "d").glob("part-*")))
    assert list(json.loads(text)) == sorted(new) and json.loads(text) == new
    assert {r.code: r.label for r in genres.read_dictionary(spark, str(tmp_path / "d")).collect()} == new
    with pytest.raises(ValueError, match="lacks codes"):
        genres.write_dictionary(rows.limit(3), str(tmp_path / "e"), rows)
    genres.write_dictionary(rows.limit(0), str(tmp_path / "f"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*")))) == {}


def test_documents_nest(spark):
    import json

    from shelfspark.operators import publish

    deep = "x"
    for i in range(20):
        deep = {"k": deep} if i % 2 else [deep]
    plain = [{"a": [1, -2, 2.5, 1e300, 12345678901234567890123, True, None, "", [], {}], "é \"q\" \\ \n": {"b": [[{"c": "\u0001 ж"}]]}}, [], {}, "text", 3, None, False, deep]
    df = spark.createDataFrame([(i, json.dumps(p, ensure_ascii=False)) for i, p in enumerate(plain)], "i int, plain string")
    typed = df.select("i", publish.typed_document(F.col("plain")).alias("typed")).cache()

    def encode(v):
        if v is None:
            return {"nullValue": None}
        if isinstance(v, bool):
            return {"booleanValue": v}
        if isinstance(v, str):
            return {"stringValue": v}
        if isinstance(v, (int, float)):
            return {"integerValue": str(int(v))} if v == int(v) and abs(v) < 1e38 else {"doubleValue": v}
        return {"arrayValue": {"values": list(map(encode, v))}} if isinstance(v, list) else {"mapValue": {"fields": {k: encode(x) for k, x in v.items()}}}

    assert {r.i: json.loads(r.typed) for r in typed.collect()} == {i: encode(p) for i, p in enumerate(plain)}
    assert {r.i: json.loads(r.plain) for r in typed.select("i", publish.document_value(F.col("typed")).alias("plain")).collect()} == dict(enumerate(plain))
    odd = [('{"timestampValue":"2024-01-01T00:00:00Z"}', '"2024-01-01T00:00:00Z"'), ('{"mapValue":{}}', "{}"), ('{"arrayValue":{}}', "[]"), ('{"bytesValue":"x"}', "null"), ("oops", None), (None, None)]
    got = spark.createDataFrame(odd, "c string, want string").select("want", publish.document_value(F.col("c")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    over = spark.createDataFrame([("[" * 23 + "]" * 23,)], "c string")
    with pytest.raises(Exception, match="nests deeper"):
        over.select(publish.typed_document(F.col("c"))).collect()


def test_access_steps_and_their_way_back(spark):
    folders = spark.createDataFrame([("L", f, f.upper(), i) for i, f in enumerate("abcdef")] + [("M", "m", "M", 1), ("N", "n", "N", 1)], "library string, id string, name string, pos int")
    settings = spark.createDataFrame([("L", ["a", "c", "e", "zz"]), ("M", ["m"]), ("N", ["n"])], "library string, excluded_folder_ids array<string>")
    states = spark.createDataFrame([("a", True, False, True, True), ("b", True, True, None, None), ("c", True, True, None, None), ("d", True, None, None, None), ("e", True, False, True, None), ("f", True, True, None, None), ("m", False, False, None, None), ("n", True, False, False, None)], "id string, is_folder boolean, inherited_off boolean, can_turn_off boolean, can_turn_on boolean")
    steps = social.access_steps(folders, settings, states)
    answers = spark.createDataFrame([("a", True, None), ("b", True, None), ("e", False, "HTTP 403")], "id string, ok boolean, error string")
    out = social.access_outcomes(steps, answers)
    assert {r.id: (r.status, r.error) for r in out.collect()} == {"a": ("applied", None), "b": ("applied", None), "c": ("unchanged", None), "d": ("unchanged", None), "e": ("failed", "HTTP 403"), "f": ("not reached", None), "m": ("failed", "not a folder"), "n": ("failed", "not allowed")}
    back = social.access_compensation(out).orderBy("place").collect()
    assert [(r.place, r.id, r.set_to, r.because) for r in back] == [(1, "b", True, "HTTP 403"), (2, "a", False, "HTTP 403")]


def test_one_of_equal_keys_is_the_same_each_time(spark):
    t = spark.createDataFrame([("k0", 1)], "k string, v int")
    rows = spark.createDataFrame([("k1", 5), ("k1", 3), ("k1", None), ("k0", 9)], "k string, v int").repartition(3)
    assert sorted(map(tuple, social.insert_absent(t, rows, "k").collect())) == [("k0", 1), ("k1", 3)]
