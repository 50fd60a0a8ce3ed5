"""File name, type and validity columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from .stage import once


def sanitize_name(name: Column) -> Column:
    base = F.element_at(F.split(F.regexp_replace(F.when(F.coalesce(name, F.lit("")) == "", "cv").otherwise(name), "/+$", ""), "/"), -1)
    safe = F.left(F.trim(F.regexp_replace(base, V.UNSAFE_NAME_CHARS, "_")), F.lit(V.MAX_NAME_CHARS))
    return F.when(safe == "", "cv").otherwise(safe)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def ext_to_mime(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.EXTENSION_MIME.items() for x in kv])
    return F.try_element_at(table, extension(name))


def sniff_mime(content: Column, name: Column) -> Column:
    """Type by magic bytes; a zip named .docx and an OLE file named .doc are documents."""
    head = F.hex(F.substring(content, 1, 12))
    kind = F.lit(None).cast("string")
    for at, magic, mime in reversed(V.MAGIC):
        kind = F.when(F.substring(head, 2 * at + 1, len(magic)) == magic, mime).otherwise(kind)
    ext = extension(name)
    return (
        F.when((kind == "application/zip") & (ext == ".docx"), V.EXTENSION_MIME[".docx"])
        .when((kind == "application/x-cfb") & (ext == ".doc"), V.EXTENSION_MIME[".doc"]).otherwise(kind)
    )


def _mb(n: Column, digits: int) -> Column:
    return F.format_number(n / 1048576, digits)


def validate_file(files: DataFrame, max_bytes: int) -> DataFrame:
    """Add ``safe_name``, ``mime_type`` (detected) and ``error`` (null when the file is accepted)."""
    df = once(files, safe_name=sanitize_name(F.col("file_name")))
    df = once(df, _want=ext_to_mime(F.col("safe_name")), _got=sniff_mime(F.col("content"), F.col("safe_name")), _n=F.length("content"))
    n, want, got = F.col("safe_name"), F.col("_want"), F.col("_got")
    image_want, image_got = want.startswith("image/"), got.startswith("image/")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    error = (
        F.when(want.isNull(), say("Unsupported file type: ", n, ". Allowed: " + ", ".join(V.EXTENSION_MIME)))
        .when(F.col("_n") == 0, say("File is empty: ", n))
        .when(F.col("_n") > max_bytes, say("File too large: ", n, " (", _mb(F.col("_n"), 1), f" MB > {max_bytes / 1048576:.0f} MB)"))
        .when(got.isNull() | ~got.isin(*V.SUPPORTED_MIMES), say("File content does not match a supported document type: ", n))
        .when((image_want != image_got) | (~image_got & (want != got)), say("File content (", got, ") does not match its extension: ", n))
    )
    return once(df, error=error).withColumn("mime_type", F.when(F.col("error").isNull(), F.col("_got"))).drop("_want", "_got", "_n")
