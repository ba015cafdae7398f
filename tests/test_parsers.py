import base64
import io
import struct
import zipfile

import pytest

from shelfspark.sources.parsers import extract_metadata
from shelfspark.sources.parsers.archive import open_zip
from shelfspark.sources.parsers.book import parse
from shelfspark.sources.parsers.epub import resolve
from shelfspark.sources.parsers.image import dimensions
from shelfspark.sources.parsers.mobi import palmdoc
from shelfspark.sources import pages
from shelfspark.sources.parsers.text import FormatError, encoding_of, lines, preview

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 300, 400) + b"\x08\2\0\0\0"


def fb2(extra="", cover=PNG, body="One two three.", enc="utf-8"):
    pic = f'<binary id="c" content-type="image/png">{base64.b64encode(cover).decode()}</binary>' if cover else ""
    text = f"""<?xml version="1.0" encoding="{enc}"?><FictionBook xmlns:l="http://x"><description><title-info><genre>sf</genre><genre>sf</genre><author><first-name>Лев</first-name><last-name>Т</last-name></author><book-title> Война </book-title><annotation><p>Note</p><p>two</p></annotation><lang>ru</lang><sequence name="S" number="2"/><coverpage><image l:href="#c"/></coverpage></title-info></description><body><title><p>Head of it</p></title><p>{body}</p></body>{pic}{extra}</FictionBook>"""
    return text.encode(enc)


def zipped(files, **k):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, **k) as z:
        for n, d in files.items():
            z.writestr(n, d)
    return out.getvalue()


def test_fb2():
    m = parse("a.fb2", "fb2", fb2())
    assert (m["title"], m["authors"], m["genres"], m["series"], m["series_number"], m["language"], m["annotation"], m["preview"], m["cover_mime_type"], m["warning"]) == ("Война", ["Лев Т"], ["sf"], "S", 2.0, "ru", "Note\ntwo", "One two three.", "image/png", None)
    assert parse("a.fb2", "fb2", fb2(enc="windows-1251"))["title"] == "Война" == parse("a.fb2", "fb2", fb2(enc="utf-16"))["title"]


def test_damaged_fb2():
    m = parse("a.fb2", "fb2", fb2('<binary id="z">\x01&</binary>'))
    assert m["warning"] == "binary_corruption_recovered" and m["title"] == "Война"
    cut = fb2()
    assert parse("a.fb2", "fb2", cut[: cut.index(b"<p>One") + 9])["warning"] == "metadata_only_recovered"
    with pytest.raises(FormatError):
        parse("a.fb2", "fb2", b"<FictionBook>")


def test_zip_choice_and_budgets():
    m = parse("x.fb2.zip", "zip", zipped({"__MACOSX/a.fb2": b"", "b.epub": b"no", "in/a.fb2": fb2(), "z.fb2": fb2()}))
    assert m["title"] == "Война" and m["warning"] == "several_books" and m["inner_format"] == "fb2"
    assert parse("x.fb2", "fb2", zipped({"a.fb2": fb2()}))["inner_format"] == "fb2"
    for bad, code in ((b"PK", "zip_no_directory"), (zipped({"a.txt": b"x"}), "zip_no_book"), (zipped({"a.fb2": b" " * 3_000_000}), "zip_ratio")):
        with pytest.raises(FormatError) as e:
            parse("x.zip", "zip", bad)
        assert e.value.code == code
    with pytest.raises(FormatError):
        open_zip(zipped({f"{i}.txt": b"" for i in range(4097)}))


def test_epub():
    opf = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator id="a">A</dc:creator><dc:creator id="b">B</dc:creator><meta refines="#b" property="role">ill</meta><dc:language>en</dc:language><dc:subject>x</dc:subject><dc:description>&lt;p&gt;D&lt;/p&gt;</dc:description><meta property="belongs-to-collection" id="s">Col</meta><meta refines="#s" property="group-position">3</meta></metadata><manifest><item id="c" href="c.png" properties="cover-image" media-type="image/png"/><item id="t" href="t.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="t"/></spine></package>"""
    files = {"META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o/p.opf": opf, "o/c.png": PNG, "o/t.xhtml": "<html><body><a>skip this link here</a><p>some words of text</p></body></html>"}
    m = parse("a.epub", "epub", zipped(files))
    assert (m["title"], m["authors"], m["series"], m["series_number"], m["annotation"], m["preview"], m["cover_mime_type"]) == ("T", ["A"], "Col", 3.0, "D", "some words of text", "image/png")
    del files["o/c.png"]
    assert parse("a.epub", "epub", zipped(files))["cover"] is None
    for ref, want in (("../x", "x"), ("../../x", None), ("http://x", None), ("/x", None), ("a\\b", None), ("a%20b#c", "o/a b")):
        assert resolve("o/p.opf", ref) == want


def mobi(compression=1, encryption=0, text=b"<p>words in the text</p>", images=(PNG,)):
    exth = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in ((100, b"Ann"), (105, b"x; y"), (503, b"Title"), (524, b"en")))
    exth = b"EXTH" + struct.pack(">II", 12 + len(exth), 4) + exth
    head = bytearray(16 + 232)
    struct.pack_into(">HHIHHH", head, 0, compression, 0, len(text), 1, 4096, encryption)
    head[16:20] = b"MOBI"
    struct.pack_into(">III", head, 20, 232, 2, 65001)
    struct.pack_into(">I", head, 108, 2)
    struct.pack_into(">I", head, 128, 0x40)
    recs = [bytes(head) + exth, text, *images]
    at, out = 78 + 8 * len(recs), bytearray(78)
    out[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", out, 76, len(recs))
    for r in recs:
        out += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(out) + b"".join(recs)


def test_mobi():
    m = parse("a.mobi", "mobi", mobi())
    assert (m["title"], m["authors"], m["genres"], m["language"], m["preview"], m["cover_mime_type"], m["warning"]) == ("Title", ["Ann"], ["x", "y"], "en", "words in the text", "image/png", None)
    assert parse("a.mobi", "mobi", mobi(encryption=1))["warning"] == "drm"
    assert palmdoc(b"abc\x80\x18\xe1") == b"abcabc a"
    with pytest.raises(FormatError):
        parse("a.mobi", "mobi", b"x" * 100)


def test_texts():
    assert encoding_of(b"\xef\xbb\xbf<a/>") == "utf-8-sig" and encoding_of(b"<\0a\0") == "utf-16-le"
    assert lines("<style>x</style><p>a &amp; b<br>c</p>") == ["a & b", "c"]
    assert len(preview(["word " * 500])) <= 1200 and preview(["one"]) is None
    assert dimensions(PNG) == (300, 400) and dimensions(b"GIF89a\x05\0\x06\0") == (5, 6) and dimensions(b"?") is None


def test_pages(spark):
    """Block elements, also those of definition lists, figures and tables, end lines; scripts are text like any other."""
    assert pages.lines("<dl><dt>sf</dt><dd>Fantastika</dd></dl><nav>n</nav><hr>x&nbsp; y\t z<script>s</script>") == ["sf", "Fantastika", "n", "x y zs"]
    assert pages.page_text("Привет".encode("cp1251")) == "Привет" == pages.page_text("Привет".encode()) and pages.page_text(b"\x98\xff") == "\ufffd\ufffd"
    df = spark.createDataFrame([(1, "<p>a<p>b &amp; c".encode()), (2, None)], "page_id long, html binary")
    assert [(r.page_id, r.pos, r.line) for r in pages.page_lines(df).collect()] == [(1, 0, "a"), (1, 1, "b & c")]


def test_binary_boundaries():
    wrap = lambda x: f"<FictionBook><body/>{x}</FictionBook>"
    from shelfspark.sources.parsers.fb2 import damaged, repair_binaries

    whole = wrap('<binary id="a">AA<!-- c -->AA</binary><binary/><n:binary xmlns:n="x">AAA=</n:binary>')
    assert repair_binaries(whole) == (whole, 0)
    assert repair_binaries(wrap("<binary>!A<A\x01</binary><binary>AAAA</binary>")) == (wrap("<binary></binary><binary>AAAA</binary>"), 1)
    for lost in ("<binary>AAAA<binary>AAAA</binary>", "<binary>A<p>x</p></binary>", "<binary>A<!ENTITY x></binary>", "<binary>AAAA"):
        with pytest.raises(FormatError):
            repair_binaries(wrap(lost))
    assert [damaged(x) for x in ("AAAA", " AA A\nA", "AA==", "A===", "AAA", "=AAA", "AA\x02A", "A-AA", "")] == [False, False, False, True, True, True, True, True, False]


def test_rows(spark):
    files = spark.createDataFrame([("1", "a.fb2", "fb2", fb2()), ("2", "b.mobi", "mobi", b"junk"), ("3", "c.epub", "epub", None), ("4", "d.pdf", "other", b"x")], "id string, name string, source_type string, content binary")
    got = {r.id: (r.title, r.error) for r in extract_metadata(files).collect()}
    assert got == {"1": ("Война", None), "2": (None, "mobi_signature"), "3": (None, "empty"), "4": (None, "unsupported")}
