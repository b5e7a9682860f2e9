"""File names and paths: classes, parts, output-name rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import col, let

# Accepted extensions per class.
PDF_EXT = ["pdf"]
IMAGE_EXT = [
    "png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff", "heic", "heif",
]
OFFICE_EXT = [
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf", "csv", "htm", "html",
]

# Windows device names that cannot be file names.
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"
MAX_NAME = 200


def classify_file(path: Column | str) -> Column:
    """pdf, image, office or unsupported, by extension in any case."""
    ext = F.lower(F.regexp_extract(col(path), r"\.([A-Za-z]+)$", 1))
    return (
        F.when(ext.isin(PDF_EXT), "pdf")
        .when(ext.isin(IMAGE_EXT), "image")
        .when(ext.isin(OFFICE_EXT), "office")
        .otherwise("unsupported")
    )


def basename(path: Column | str) -> Column:
    """Part after the last slash or backslash; a path ending in one is returned whole."""
    p = col(path)
    last = F.regexp_extract(p, r"([^\\/]*)$", 1)
    return F.when(last == "", p).otherwise(last)


def dirname(path: Column | str) -> Column:
    """Part before the last slash or backslash, "" without one."""
    return F.regexp_extract(col(path), r"(?s)^(.*)[\\/]", 1)


def strip_ext(name: Column | str) -> Column:
    """Name without its last extension; a leading dot alone is no extension."""
    return F.regexp_replace(col(name), r"(?s)(?<=.)\.[^.]*$", "")


def path_parts(path: Column | str) -> Column:
    """struct(base, dir, stem)."""
    return F.struct(
        basename(path).alias("base"),
        dirname(path).alias("dir"),
        strip_ext(basename(path)).alias("stem"),
    )


def join_path(directory: Column | str, name: Column | str) -> Column:
    """Join with the separator the directory already uses."""
    d, n = col(directory), col(name)
    windows = F.contains(d, F.lit("\\")) & ~F.contains(d, F.lit("/"))
    bare = F.regexp_replace(d, r"[\\/]+$", "")
    joined = F.concat(bare, F.when(windows, "\\").otherwise("/"), n)
    return F.when(F.coalesce(d, F.lit("")) == "", n).otherwise(joined)


def check_name(name: Column | str, ext: str = "pdf") -> Column:
    """struct(value, error) for an output file name.

    The ``txt`` rule is looser: control characters and reserved names pass, and
    the length is checked before the extension is added.
    """

    def build(t: Column) -> Column:
        has_ext = t.rlike(rf"(?i)\.{ext}$")
        full = F.when(has_ext, t).otherwise(F.concat(t, F.lit(f".{ext}")))
        if ext == "txt":
            error = (
                F.when(t == "", "EMPTY")
                .when(t.rlike(r'[<>:"/\\|?*]'), "BAD_CHARACTER")
                .when(F.length(t) > MAX_NAME, "TOO_LONG")
            )
        else:
            error = (
                F.when(t == "", "EMPTY")
                .when(t.rlike(r'[<>:"/\\|?*\x00-\x1f]'), "BAD_CHARACTER")
                .when(t.rlike(RESERVED), "RESERVED")
                .when(F.length(full) > MAX_NAME, "TOO_LONG")
            )
        return F.struct(F.when(error.isNull(), full).alias("value"), error.alias("error"))

    edge = r"^[\s\u00A0\uFEFF\p{Z}]+|[\s\u00A0\uFEFF\p{Z}]+$"
    return let(F.regexp_replace(col(name), edge, ""), build)
