"""Column functions for text, numbers, times and hashes. Built-in expressions only; no Python on executors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that the catalog's client counts as such (regex class bodies).
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
NO_AUTHOR, NO_GENRE, NO_ANNOTATION, AND_OTHERS = "Автор не указан", "Жанр не указан", "Аннотация отсутствует", "и другие"
# The most frequent languages, answered without the locale data; all others are looked up there.
LANGUAGES = {"ru": "русский", "en": "английский", "de": "немецкий", "fr": "французский", "es": "испанский", "it": "итальянский", "uk": "украинский", "be": "белорусский", "pl": "польский"}
LANGUAGE_ALIASES = {
    "rus": "ru", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "ukr": "uk", "bel": "be", "pol": "pl",
}
#: A language tag: a subtag of 2, 3 or 5 to 8 letters, then others.
TAG = "^([a-z]{2,3}|[a-z]{5,8})(-[a-z0-9]{1,8})*$"
ICU = "com.ibm.icu.util.ULocale"


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank_to_null(c: Column) -> Column:
    t = trim(c)
    return F.when(t != "", t)


def normalize(c: Column) -> Column:
    """F-01: null is empty; trimmed, lower case, runs of white space are one space."""
    return F.coalesce(F.regexp_replace(F.lower(trim(c)), f"[{SPACE}]+", " "), F.lit(""))


def normalized(s: str) -> str:
    """F-01 for a text of the driver, as a condition of a search."""
    white = re.compile(f"[{SPACE}]+")
    return white.sub(" ", white.sub(" ", s).strip(" ").lower())


def clean(c: Column) -> Column:
    """F-03."""
    return F.coalesce(trim(F.regexp_replace(c, f"[{SPACE}]+", " ")), F.lit(""))


def unique_texts(c: Column) -> Column:
    """F-03: cleaned, blanks dropped, first of equal ones kept in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean), lambda x: x != ""))


def language_tag(c: Column) -> Column:
    return F.replace(normalize(c), F.lit("_"), F.lit("-"))


def language_base(c: Column) -> Column:
    """The canonical code of a tag's language, as the locale data has it; a text that is no tag stays as it is."""
    tag = language_tag(c)
    first = F.substring_index(tag, "-", 1)
    short = F.coalesce(F.try_element_at(literal_map(LANGUAGE_ALIASES), first), first)
    known = F.when(F.map_contains_key(literal_map(LANGUAGES), short), short)
    canonical = F.reflect(F.lit(ICU), F.lit("getLanguage"), F.reflect(F.lit(ICU), F.lit("canonicalize"), tag))
    return F.coalesce(known, F.when(tag.rlike(TAG), canonical), tag)


def language_name(base: Column) -> Column:
    """The Russian name of a canonical code; null if there is none."""
    name = F.reflect(F.lit(ICU), F.lit("getDisplayLanguage"), base, F.lit("ru"))
    looked_up = F.when(base.rlike("^[a-z]{2,8}$"), name)
    return F.coalesce(F.try_element_at(literal_map(LANGUAGES), base), F.when((looked_up != base) & (looked_up != ""), looked_up))


def language_key(c: Column) -> Column:
    """F-02: tags of one language are equal, whatever their region or script; texts without a language are equal to themselves; blank is ''."""
    tag, name = language_tag(c), language_name(language_base(c))
    return F.when(tag == "", "").when(name.isNotNull(), F.concat(F.lit("language:"), normalize(name))).otherwise(F.concat(F.lit("code:"), tag))


def number(c: Column) -> Column:
    """F-04: text to a finite number as a script would read it: decimal, exponent or 0x; else null."""
    t = trim(c.cast("string"))
    decimal = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    hexa = F.when(t.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10).try_cast("double"))
    got = F.coalesce(decimal, hexa)
    return F.when(F.abs(got) < float("inf"), got)


def number_text(c: Column) -> Column:
    """A number as a script prints it: whole ones without '.0'."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))


def series_label(series: Column, num: Column) -> Column:
    """F-05."""
    name, n = F.coalesce(trim(series), F.lit("")), number(num)
    return F.when(name == "", "").when(n.isNull(), name).otherwise(F.concat(name, F.lit(" ("), number_text(n), F.lit(")")))


def email(c: Column) -> Column:
    """F-06."""
    return F.coalesce(F.lower(trim(c)), F.lit(""))


def valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"^[^{SPACE}/@]+@[^{SPACE}/@]+\.[^{SPACE}/@]+$") & (F.length(c) <= 254), F.lit(False))


def share_email_error(value: Column, own: Column) -> Column:
    """V-07: null when the address may be shared with."""
    e = email(value)
    return F.when(~valid_email(e), "invalid").when(e == email(own), "self")


def is_email_name(name: Column, mail: Column) -> Column:
    """F-07: the name is just the local part of the address."""
    return F.coalesce((F.lower(trim(name)) == F.substring_index(email(mail), "@", 1)) & (email(mail) != ""), F.lit(False))


def redact_emails(c: Column, mark: str = "[email]") -> Column:
    """F-09."""
    return F.regexp_replace(c, r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", mark)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """F-11: the Russian form for a count."""
    a = F.abs(n) % 100
    return F.when((a > 10) & (a < 20), many).when(a % 10 == 1, one).when((a % 10 >= 2) & (a % 10 <= 4), few).otherwise(many)


def grouped(n: Column) -> Column:
    """Digits in threes, apart by no-break spaces."""
    return F.regexp_replace(n.cast("string"), r"\B(?=(\d{3})+$)", "\u00a0")


def book_count(n: Column) -> Column:
    """F-10."""
    return F.concat(grouped(n), F.lit(" "), plural(n, "книга", "книги", "книг"))


def truncate_at_word(c: Column, limit: int) -> Column:
    """F-12: at most limit characters, cut at the last space or no-break space if there is one. Lengths are code points."""
    head = F.substring(c, 1, limit)
    cut = F.regexp_extract(head, "(?s)^(.*)[ \\u00A0]", 1)
    return F.when(F.length(c) <= limit, c).otherwise(F.when(cut != "", cut).otherwise(head))


def word_count(c: Column) -> Column:
    """F-12: runs of letters and digits."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+")), F.lit(0))


def label(c: Column) -> Column:
    """F-13 but for the entities: collapsed, no spaces or dashes at the ends."""
    return F.regexp_replace(clean(c), r"^[ \-–—]+|[ \-–—]+$", "")


def millis(c: Column) -> Column:
    """F-15: a number of seconds or milliseconds, or an ISO time, as text; else 0."""
    n = number(c)
    t = F.unix_millis(F.try_to_timestamp(F.when(trim(c).rlike(r"^\d{4}-\d{2}-\d{2}"), trim(c))))
    return F.coalesce(F.when(n < 1e12, (n * 1000).cast("long")).otherwise(n.cast("long")), t, F.lit(0).cast("long"))


def duration(ms: Column) -> Column:
    """F-16: minutes and seconds, seconds rounded up."""
    s = F.ceil(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    return F.when(s >= 60, F.concat((s / 60).cast("long").cast("string"), F.lit(" мин "), (s % 60).cast("string"), F.lit(" сек"))).otherwise(F.concat(s.cast("string"), F.lit(" сек")))


def date_label(ts: Column, seconds: bool = False) -> Column:
    """F-17; with seconds where administrators see it."""
    return F.coalesce(F.date_format(ts, "dd.MM.yyyy, HH:mm:ss" if seconds else "dd.MM.yyyy, HH:mm"), F.lit("—"))


def signature(*cols: Column) -> Column:
    """F-18: SHA-256 of the values as JSON."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def short_hash(uid: Column, mail: Column) -> Column:
    """F-19."""
    return F.substring(F.sha2(F.concat_ws(":", uid, mail), 256), 1, 16)


def fit_scale(w: Column, h: Column) -> Column:
    """F-20: (width, height) within 240 by 320, rounded, at least 1."""
    k = F.least(F.lit(1.0), F.lit(240.0) / w, F.lit(320.0) / h)
    return F.struct(F.greatest(F.lit(1), F.floor(w * k + 0.5)).cast("long").alias("width"), F.greatest(F.lit(1), F.floor(h * k + 0.5)).cast("long").alias("height"))


def modal_width(height: Column, w: Column, h: Column, viewport: Column) -> Column:
    scaled = height * w / F.nullif(h, F.lit(0))
    return F.coalesce(F.when((height == 0) | (w == 0) | (h == 0), F.lit(0.0)).when(viewport > 650, scaled).otherwise(F.least(scaled, viewport * 0.38)), F.lit(0.0))


def cover_score(w: Column, h: Column) -> Column:
    """F-21: 0 for what is no cover."""
    ratio = h / w
    bad = (w < 120) | (h < 160) | (h <= w) | (ratio < 1.15) | (ratio > 3)
    return F.when(bad, F.lit(0.0)).otherwise(w * h * F.least(ratio, F.lit(2.0)))


def image_kind(content: Column) -> Column:
    """F-23: by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")


def sniff(content: Column) -> Column:
    """P-14: zip, gzip, html, rtf, xml or binary."""
    head = F.hex(F.substring(content, 1, 4))
    text = F.lower(trim(F.decode(F.substring(content, 1, 256), "ISO-8859-1")))
    return F.when(head.startswith("504B"), "zip").when(head.startswith("1F8B"), "gzip").when(text.startswith("{\\rtf"), "rtf").when(text.rlike("^(<!doctype html|<html)"), "html").when(text.startswith("<"), "xml").otherwise("binary")


def zip_entry_kind(name: Column) -> Column:
    """F-25."""
    return F.lower(F.nullif(F.regexp_extract(name, r"(?i)\.(fb2|epub|mobi)$", 1), F.lit("")))


def share_id(owner: Column, viewer: Column) -> Column:
    """F-26."""
    return F.concat_ws("__", owner, viewer)


def base_signature(version: Column, metadata: Column, root: Column, updated: Column, n: Column) -> Column:
    """F-27."""
    return F.concat_ws(":", *[c.cast("string") for c in (version, metadata, root, updated, n)])


def query_literal(c: Column) -> Column:
    """F-08: a text inside the quotes of a listing query."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def fill_template(template: Column, inviter: Column, slot: str = "{{name}}") -> Column:
    """F-28."""
    return F.replace(template, F.lit(slot), inviter)


def escape_html(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def delta36(times: Column) -> Column:
    """F-29: ascending times as base-36 differences, joined by dots."""
    shifted = F.concat(F.array(F.lit(0).cast("long")), F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))))
    return F.array_join(F.transform(F.zip_with(times, shifted, lambda a, b: a - b), lambda d: F.lower(F.conv(d.cast("string"), 10, 36))), ".")


def undelta36(c: Column) -> Column:
    steps = F.transform(F.split(c, r"\."), lambda d: F.conv(d, 36, 10).cast("long"))
    return F.when(c == "", F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.aggregate(F.slice(steps, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)))


def identity(name: Column, mail: Column, fallback: str = "Пользователь") -> Column:
    """F-30."""
    return F.coalesce(blank_to_null(name), blank_to_null(mail), F.lit(fallback))


# Texts of a refresh.
SCANNING, RETRYING = "Сканирование библиотеки…", "Google Drive временно не ответил. Повторяем запрос…"
SCAN_STATUS = "%s Обработано папок: %d. В очереди: %d. Найдено книг: %d. Прошло: %d с."
FOLDER_FAILED, SCAN_FAILED, OLD_KEPT = "Не удалось прочитать папку «%s».", "Не удалось завершить обновление библиотеки. Не удалось прочитать одну из папок Google Drive.", " Старая версия библиотеки сохранена."


def scan_status(processed: Column, queued: Column, books: Column, seconds: Column, retrying: Column) -> Column:
    """F-31: what a refresh shows while it runs."""
    return F.format_string(SCAN_STATUS, F.when(retrying, RETRYING).otherwise(SCANNING), processed, queued, books, seconds)


def scan_failure(folder: Column) -> Column:
    """F-31: what a refresh that failed shows; the folder's name may be unknown."""
    return F.concat(F.when(F.coalesce(folder, F.lit("")) == "", SCAN_FAILED).otherwise(F.format_string(FOLDER_FAILED, folder)), F.lit(OLD_KEPT))


def retry_delay(attempt: Column, after_ms: Column | None = None, base: int = 700, most: int = 10_000) -> Column:
    """F-32: milliseconds."""
    back = F.pow(F.lit(2.0), attempt) * base
    return F.least(F.coalesce(after_ms, back) if after_ms is not None else back, F.lit(float(most)))


def title_fallback(file_name: Column) -> Column:
    """F-33."""
    return F.coalesce(blank_to_null(F.regexp_replace(file_name, r"(?i)\.(fb2|zip|epub|mobi)$", "")), file_name)


def natural_key(c: Column) -> Column:
    """O-01: sorts in Russian order without regard to case and accents, and digit runs of any length by value: the number of digits comes before them."""
    parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    digits = lambda x: F.regexp_replace(x, r"^0+(?=[0-9])", "")
    pad = lambda x: F.when(x.rlike(r"^[0-9]"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))).otherwise(x)
    return russian(F.array_join(F.transform(parts, pad), ""))


def russian(c: Column) -> Column:
    """Russian order without regard to case and accents, of books and folders."""
    return F.collate(c, "ru_CI_AI")


def person_key(c: Column) -> Column:
    """O-05, O-07 to O-09: names of people in Russian order: letters, then accents (е before ё), then case (small before capital)."""
    return F.collate(F.coalesce(c, F.lit("")), "ru")


def page_tokens(total: Column, current: Column) -> Column:
    """O-11: page numbers to show, 0 for an ellipsis."""
    t, c = total.cast("int"), current.cast("int")
    arr = lambda *x: F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("int") for v in x])
    return (
        F.when(t <= 1, F.array().cast("array<int>"))
        .when(t <= 7, F.sequence(F.lit(1), F.greatest(t, F.lit(1))))
        .when(c <= 4, arr(1, 2, 3, 4, 5, 0, t))
        .when(c >= t - 3, arr(1, 0, t - 4, t - 3, t - 2, t - 1, t))
        .otherwise(arr(1, 0, c - 2, c - 1, c, c + 1, c + 2, 0, t))
    )


def classify(name: Column, mime: Column) -> Column:
    """PR-01: what a drive item is; the order of tests matters."""
    ext = F.lower(F.regexp_extract(name, r"(?i)\.(fb2|epub|mobi)$", 1))
    return (
        F.when(mime == "application/vnd.google-apps.folder", "folder")
        .when(ext != "", ext)
        .when(name.rlike(r"(?i)\.zip$") | mime.isin("application/zip", "application/x-zip-compressed"), "zip")
        .when(name.rlike(r"(?i)\.(azw3?|pdf|djvu|docx?|txt)$"), "other")
        .when(mime == "application/epub+zip", "epub")
        .when(mime == "application/x-mobipocket-ebook", "mobi")
        .otherwise("other")
    )


def genre_labels(codes: Column, names: dict[str, str]) -> Column:
    """PR-05: known names, else the codes."""
    d = literal_map(names)
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(d, c), c))


def modal_authors(authors: Column, author: Column) -> Column:
    """PR-04."""
    a = F.filter(F.transform(authors, trim), lambda x: x != "")
    return F.coalesce(
        F.when(F.size(a) >= 3, F.concat(F.array_join(F.slice(a, 1, 2), ", "), F.lit(f" {AND_OTHERS}"))).when(F.size(a) > 0, F.array_join(a, ", ")),
        blank_to_null(author),
        F.lit(NO_AUTHOR),
    )


def uid_ok(c: Column) -> Column:
    """FI-24."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]{1,128}$"), F.lit(False))


def mapping_code_ok(c: Column) -> Column:
    """FI-24: any text of 1 to 128 characters without control characters."""
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= 128) & ~c.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def badge(n: Column) -> Column:
    """A-14."""
    return F.when(n > 99, "99+").when(n > 0, n.cast("string")).otherwise("")
