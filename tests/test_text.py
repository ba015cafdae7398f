import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text as X


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize("raw,want", [("1", 1.0), (" 2.5 ", 2.5), ("0x10", 16.0), ("1e2", 100.0), (".5", 0.5), ("1d", None), ("", None), ("Infinity", None), ("NaN", None), (None, None), ("1e999", None)])
def test_number(spark, raw, want):
    assert value(spark, X.number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("  A  b﻿ ", "a b"), (None, ""), ("\t", "")])
def test_normalize(spark, raw, want):
    assert value(spark, X.normalize(F.lit(raw).cast("string"))) == want


def test_languages(spark):
    key = lambda s: value(spark, X.language_key(F.lit(s)))
    assert len({key(s) for s in ("ru", "rus", "ru-RU", "ru_RU", " RU ")}) == 1
    assert key("ger") == key("de-DE") != key("en-US") == key("eng")
    assert key("qx-top") == "code:qx-top" and key(" ") == "" and key("русский язык") == "code:русский язык"
    assert key("ja") == key("ja-JP") == "language:японский" and key("zh_CN") == key("zh") and key("pt-BR") == key("por")


@pytest.mark.parametrize("n,want", [(0, "0 книг"), (1, "1 книга"), (3, "3 книги"), (11, "11 книг"), (21, "21 книга"), (112, "112 книг"), (1004, "1 004 книги"), (1234567, "1 234 567 книг")])
def test_book_count(spark, n, want):
    assert value(spark, X.book_count(F.lit(n))) == want


def test_natural_order(spark):
    names = ["book10", "Book2", "book1a", "BOOK02b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["book1a", "Book2", "BOOK02b", "book10"]


def test_query_texts_are_normalized_like_rows():
    assert X.normalized("\ufeff A\u00a0\t b ") == "a b" and X.normalized("\x1c") == "\x1c"


@pytest.mark.parametrize("t,c,want", [(1, 1, []), (5, 2, [1, 2, 3, 4, 5]), (20, 3, [1, 2, 3, 4, 5, 0, 20]), (20, 18, [1, 0, 16, 17, 18, 19, 20]), (20, 10, [1, 0, 8, 9, 10, 11, 12, 0, 20])])
def test_page_tokens(spark, t, c, want):
    assert value(spark, X.page_tokens(F.lit(t), F.lit(c))) == want


def test_times_round_trip(spark):
    a = [5, 5, 100, 1_700_000_000_000]
    packed = X.delta36(F.array(*[F.lit(v).cast("long") for v in a]))
    assert value(spark, X.undelta36(packed)) == a
    assert value(spark, X.undelta36(F.lit(""))) == []


def test_millis(spark):
    ms = lambda s: value(spark, X.millis(F.lit(s).cast("string")))
    assert ms("1700000000") == 1_700_000_000_000 == ms("1700000000000") and ms("2023-11-14T22:13:20Z") == 1_700_000_000_000
    assert ms("soon") == 0 == ms(None)


def test_small_ones(spark):
    assert value(spark, X.title_fallback(F.lit(" War.FB2"))) == "War" and value(spark, X.title_fallback(F.lit(".zip"))) == ".zip"
    assert value(spark, X.series_label(F.lit(" S "), F.lit("2.0"))) == "S (2)" and value(spark, X.series_label(F.lit(" "), F.lit("2"))) == ""
    assert value(spark, X.redact_emails(F.lit("to a.b@example.com now"))) == "to [email] now"
    assert value(spark, X.duration(F.lit(61_001))) == "1 мин 2 сек" and value(spark, X.duration(F.lit(-5))) == "0 сек"
    assert value(spark, X.badge(F.lit(100))) == "99+" and value(spark, X.badge(F.lit(0))) == ""
    assert value(spark, X.modal_width(F.lit(300.0), F.lit(200.0), F.lit(0.0), F.lit(500.0))) == 0.0
    assert value(spark, X.image_kind(F.lit(b"\x89PNG\r\n\x1a\n0000"))) == "image/png" and value(spark, X.image_kind(F.lit(b"x"))) is None
    assert value(spark, X.sniff(F.lit(b"PK\x03\x04"))) == "zip" and value(spark, X.sniff(F.lit(b" <!DOCTYPE html>"))) == "html" and value(spark, X.sniff(F.lit(b"\x00\x01"))) == "binary"
    assert value(spark, X.modal_authors(F.array(F.lit(" "), F.lit("A"), F.lit("B"), F.lit("C")), F.lit(None).cast("string"))) == "A, B и другие"
