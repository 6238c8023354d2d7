"""Formats, and their detection from names and first bytes."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FormatSpec:
    """What the engine can do with a format."""

    name: str
    extensions: tuple[str, ...]
    mime: str
    parses: bool
    renders: bool
    binary: bool = False


FORMATS = {
    spec.name: spec
    for spec in (
        FormatSpec("md", (".md", ".markdown"), "text/markdown", True, True),
        FormatSpec("html", (".html", ".htm"), "text/html", True, True),
        FormatSpec("xml", (".xml", ".dbk"), "application/xml", True, False),
        FormatSpec("docx", (".docx",), "application/vnd.openxmlformats-officedocument.wordprocessingml.document", True, True, True),
        FormatSpec("hwpx", (".hwpx",), "application/hwp+zip", True, True, True),
        FormatSpec("hwp", (".hwp",), "application/x-hwp", True, True, True),
        FormatSpec("pdf", (".pdf",), "application/pdf", True, False, True),
    )
}
_BY_EXTENSION = {e: s.name for s in FORMATS.values() for e in s.extensions}


def register(spec: FormatSpec, parser=None, writer=None) -> None:
    """Makes a format known under its name and extensions, with a parser (content to blocks) and a writer (blocks to content).

    Workers get both by import: they must be functions of a module that executors have.
    """
    from ..sinks import render
    from . import parse

    FORMATS[spec.name] = spec
    _BY_EXTENSION.update(dict.fromkeys((e.lower() for e in spec.extensions), spec.name))
    if parser is not None:
        parse.PARSERS[spec.name] = parser
        parse.BINARY = tuple(dict.fromkeys([*parse.BINARY, *([spec.name] if spec.binary else [])]))
    if writer is not None:
        render.WRITERS[spec.name] = writer
        render.BINARY = tuple(dict.fromkeys([*render.BINARY, *([spec.name] if spec.binary else [])]))


def unregister(name: str) -> None:
    """Forgets a format, with its extensions, parser and writer."""
    from ..sinks import render
    from . import parse

    for known in (FORMATS, parse.PARSERS, render.WRITERS):
        known.pop(name, None)
    for e in [e for e, n in _BY_EXTENSION.items() if n == name]:
        del _BY_EXTENSION[e]


# The first bytes of containers, and the member that tells zip formats apart.
MAGIC = {"d0cf11e0": "hwp", "504b0304": "zip", "25504446": "pdf"}
ZIP_MEMBERS = (("META-INF/container.xml", "hwpx"), ("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def format_of(path: Column) -> Column:
    """The format of a file name, null if unknown."""
    known = F.create_map(*[F.lit(x) for pair in sorted(_BY_EXTENSION.items()) for x in pair])
    return F.try_element_at(known, extension(path))


def magic_of(content: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in sorted(MAGIC.items()) for x in pair])
    return F.try_element_at(known, F.lower(F.hex(F.substring(content, 1, 4))))


def zip_format(content: bytes | None) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            names = set(archive.namelist())
    except zipfile.BadZipFile:
        return None
    return next((kind for member, kind in ZIP_MEMBERS if member in names), None)


def detect_files(files: DataFrame) -> DataFrame:
    """path, format, source (extension, magic or none) and warning for files (path, content).

    The extension decides and the first bytes only warn; without a known extension they decide.
    Python looks only into zip files whose name does not tell.
    """

    def look(batches):
        for pdf in batches:
            pdf["zip"] = [zip_format(c) for c in pdf.pop("content")]
            yield pdf

    kinds = files.select("path", format_of(F.col("path")).alias("by_name"), magic_of(F.col("content")).alias("by_magic"), "content")
    known = kinds.where("by_name is not null or coalesce(by_magic, '') <> 'zip'").select("path", "by_name", "by_magic", F.lit(None).cast("string").alias("zip"))
    looked = kinds.where("by_name is null and by_magic = 'zip'").mapInPandas(look, "path string, by_name string, by_magic string, zip string")
    both = known.unionByName(looked)
    expected = F.when(F.col("by_name").isin("docx", "hwpx"), "zip").when(F.col("by_name").isin("hwp", "pdf"), F.col("by_name"))
    found = F.coalesce("by_name", F.when(F.col("by_magic") == "zip", F.col("zip")).otherwise(F.col("by_magic")))
    return both.select(
        "path",
        found.alias("format"),
        F.when(F.col("by_name").isNotNull(), "extension").when(found.isNotNull(), "magic").otherwise("none").alias("source"),
        F.when(F.col("by_name").isNotNull() & expected.isNotNull() & ~expected.eqNullSafe(F.col("by_magic")), "first bytes do not match the extension").alias("warning"),
    )
