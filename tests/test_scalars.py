"""Names, sizes, times, colours, encodings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.functions import formats as fmt
from quire.functions import paths as P
from quire.functions import text as T

MIB = 1024**2


@pytest.mark.parametrize(
    "n,decimals,text",
    [
        (0, 2, "0 B"), (1, 2, "1 B"), (999, 2, "999 B"), (1023, 2, "1023 B"), (1024, 2, "1.00 KB"),
        (MIB, 2, "1.00 MB"), (1024**3, 2, "1.00 GB"), (1024**4, 2, "1.00 TB"), (1024**6, 2, "1024.00 PB"),
        (1536, 1, "1.5 KB"), (1536, 0, "2 KB"), (int(2.5 * MIB), 3, "2.500 MB"), (2_500_000_000, 2, "2.33 GB"),
        (-1, 2, "—"), (float("nan"), 2, "—"), (float("inf"), 2, "—"), (float("-inf"), 2, "—"), (None, 2, "—"),
    ],
)
def test_format_bytes(one, n, decimals, text):
    value = F.lit(None).cast("bigint") if n is None else F.lit(n)
    assert one(fmt.format_bytes(value, decimals)) == text


@pytest.mark.parametrize(
    "n,decimals,text",
    [
        (951936, 2, "929.62 KB"), (951937, 2, "929.63 KB"), (1024 + 384, 2, "1.38 KB"), (2560, 0, "2 KB"),
        (1024**2 - 1, 2, "1024.00 KB"), (round(4.015 * 1024**5), 2, "4.01 PB"), (round(4.035 * 1024**5), 2, "4.04 PB"),
    ],
)
def test_format_bytes_rounds_the_exact_value_half_to_even(one, n, decimals, text):
    assert one(fmt.format_bytes(F.lit(n), decimals)) == text


@pytest.mark.parametrize(
    "n,tier",
    [(500 * MIB - 1, "normal"), (500 * MIB, "large"), (2048 * MIB - 1, "large"), (2048 * MIB, "veryLarge")],
)
def test_size_tier(one, n, tier):
    assert one(fmt.size_tier(F.lit(n))) == tier


@pytest.mark.parametrize("n,text", [(0, "0"), (999, "999"), (1000, "1,000"), (1234567, "1,234,567")])
def test_format_count(one, n, text):
    assert one(fmt.format_count(F.lit(n))) == text


@pytest.mark.parametrize(
    "ago,text",
    [
        (0, "just now"), (44, "just now"), (45, "1 min ago"), (59, "1 min ago"), (60, "1 min ago"),
        (300, "5 min ago"), (59 * 60, "59 min ago"), (3600, "1 hour ago"), (5 * 3600, "5 hours ago"),
        (23 * 3600, "23 hours ago"), (86400, "1 day ago"), (29 * 86400, "29 days ago"), (-60, "just now"),
        (30 * 86400, "7/14/2026"),
    ],
)
def test_relative_time(one, ago, text):
    now = dt.datetime(2026, 8, 13, 12, tzinfo=dt.timezone.utc)
    then = now - dt.timedelta(seconds=ago)
    assert one(fmt.relative_time(F.lit(then), F.lit(now))) == text


@pytest.mark.parametrize(
    "path,base,folder,stem",
    [
        ("foo/bar/baz.pdf", "baz.pdf", "foo/bar", "baz"),
        ("/foo/bar/baz.pdf", "baz.pdf", "/foo/bar", "baz"),
        ("\\foo\\bar\\baz.pdf", "baz.pdf", "\\foo\\bar", "baz"),
        ("report.final.v2.pdf", "report.final.v2.pdf", "", "report.final.v2"),
        (".env", ".env", "", ".env"),
        ("README", "README", "", "README"),
        ("a/b/", "a/b/", "a/b", "a/b/"),
    ],
)
def test_path_parts(one, path, base, folder, stem):
    assert tuple(one(P.path_parts(F.lit(path)))) == (base, folder, stem)


@pytest.mark.parametrize(
    "folder,name,path",
    [("", "a", "a"), ("/x/", "a", "/x/a"), ("C:\\x\\\\", "a", "C:\\x\\a"), ("C:\\x/y", "a", "C:\\x/y/a")],
)
def test_join_path(one, folder, name, path):
    assert one(P.join_path(F.lit(folder), F.lit(name))) == path


@pytest.mark.parametrize(
    "path,kind",
    [
        ("a.PDF", "pdf"), ("a.HeIc", "image"), ("a.tiff", "image"), ("a.jpg", "image"), ("a.csv", "office"),
        ("a.html", "office"), ("a.pdf.zip", "unsupported"), ("pdf", "unsupported"), ("a.pdf ", "unsupported"),
    ],
)
def test_classify(one, path, kind):
    assert one(P.classify_file(F.lit(path))) == kind


@pytest.mark.parametrize(
    "name,ext,value,error",
    [
        ("a" * 196, "pdf", "a" * 196 + ".pdf", None),
        ("a" * 197, "pdf", None, "TOO_LONG"),
        ("report.PDF", "pdf", "report.PDF", None),
        ("  ", "pdf", None, "EMPTY"),
        ("a<b", "pdf", None, "BAD_CHARACTER"),
        ("a\tb", "pdf", None, "BAD_CHARACTER"),
        ("con", "pdf", None, "RESERVED"),
        ("LPT1.pdf", "pdf", None, "RESERVED"),
        ("console", "pdf", "console.pdf", None),
        ("con", "txt", "con.txt", None),
        ("a\tb", "txt", "a\tb.txt", None),
        ("a" * 200, "txt", "a" * 200 + ".txt", None),
        ("a" * 201, "txt", None, "TOO_LONG"),
    ],
)
def test_check_name(one, name, ext, value, error):
    assert tuple(one(P.check_name(F.lit(name), ext))) == (value, error)


@pytest.mark.parametrize(
    "color,rgb",
    [
        ("#fff", (1, 1, 1)), ("#000000", (0, 0, 0)), (" #FF0000 ", (1, 0, 0)), ("0000ff", (0, 0, 1)),
        ("#12", (0.067, 0.094, 0.153)), (None, (0.067, 0.094, 0.153)), ("#1234567", (0.067, 0.094, 0.153)),
    ],
)
def test_parse_hex(one, color, rgb):
    assert tuple(one(fmt.parse_hex(F.lit(color).cast("string")))) == pytest.approx(rgb)


@pytest.mark.parametrize(
    "raw,text",
    [
        (b"\xfe\xff" + "Başlık".encode("utf-16-be"), "Başlık"),
        (b"\x8b", "‰"), (b"\xa0", "€"), (b"\x80", "•"), (b"caf\xe9", "café"), (b" a ", "a"), (b"", ""),
        (b"\x18\x1f\x9e\x92", "˘˜ž™"), (b"a\x7f\x9f\xadb", "ab"),
    ],
)
def test_decode_meta(one, raw, text):
    assert one(T.decode_meta(F.lit(bytearray(raw)))) == text


def test_a_cut_wide_text_does_not_stop_the_job(one):
    assert one(T.decode_meta(F.lit(bytearray(b"\xfe\xff\x00a\x00")))).startswith("a")


@pytest.mark.parametrize("text", ["Plain Title 42", "Başlık Ğüzel", "emoji 🙂 test"])
def test_codec_round_trip(one, text):
    raw = bytes(one(T.encode_meta(F.lit(text))))
    assert raw == (text.encode() if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be"))
    assert one(T.decode_meta(T.encode_meta(F.lit(text)))) == text


@pytest.mark.parametrize(
    "text,folded",
    [
        ("GİZLİ Şğı ç € –", "GİZLİ Şğı ç € –"), ("Łódź ĲsselĳK", "Lódz IJsselijK"), ("中🙂\n", "???"), ("ČĀ", "CA"),
    ],
)
def test_fold_text(one, text, folded):
    assert one(T.fold_text(F.lit(text))) == folded
