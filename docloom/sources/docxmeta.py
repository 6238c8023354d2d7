"""What DOCX packages say besides their blocks: core properties, sections, spacings that styles give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .docx import Package, W
from .xml import local

TWIPS_PER_PT = 20.0
# Names of the core properties and, of section properties, where they stand and what they are called here.
PROPERTIES = {"title": "title", "creator": "author", "created": "created_at", "modified": "modified_at", "language": "language"}
MARGINS = ("top", "bottom", "left", "right", "header", "footer", "gutter")
SIDES = ("top", "bottom", "left", "right")
BREAKS = {"nextPage": "next_page", "continuous": "continuous", "evenPage": "even_page", "oddPage": "odd_page", "nextColumn": "new_column"}
NUMBERS = {"decimal": "decimal", "lowerRoman": "roman_lower", "upperRoman": "roman_upper", "lowerLetter": "alpha_lower", "upperLetter": "alpha_upper"}
YES, NO = ("true", "1", "on"), ("false", "0", "off")

_POINTS = ["page_width", "page_height", *(f"margin_{m}" for m in MARGINS)]
_COLUMNS = T.StructType([T.StructField("count", T.IntegerType()), T.StructField("gap", T.DoubleType()), T.StructField("separator", T.BooleanType()), T.StructField("same_width", T.BooleanType()), T.StructField("widths", T.ArrayType(T.DoubleType()))])
SECTIONS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n", T.IntegerType())]
    + [T.StructField(name, T.DoubleType()) for name in _POINTS]
    + [T.StructField(name, T.StringType()) for name in ("orientation", "break_type", "page_number_format", *(f"border_{s}" for s in SIDES))]
    + [T.StructField("start_page_number", T.IntegerType()), T.StructField("line_numbering", T.BooleanType()), T.StructField("columns", _COLUMNS)]
)


def _number(text: str | None, kind=float):
    try:
        return kind(text) if text else None
    except ValueError:
        return None


def _points(e, name: str) -> float | None:
    value = _number(e.get(W + name)) if e is not None else None
    return None if value is None else value / TWIPS_PER_PT


def section_of(e) -> dict:
    """A ``sectPr`` element as a row of :data:`SECTIONS`; what it does not say is null."""
    size, margins, kind, columns, numbers, borders = (e.find(W + n) for n in ("pgSz", "pgMar", "type", "cols", "pgNumType", "pgBorders"))
    out: dict = {"page_width": _points(size, "w"), "page_height": _points(size, "h")} | {f"margin_{m}": _points(margins, m) for m in MARGINS}
    out["orientation"] = "landscape" if size is not None and size.get(W + "orient") == "landscape" else None
    out["break_type"] = BREAKS.get(kind.get(W + "val")) if kind is not None else None
    out["page_number_format"] = NUMBERS.get(numbers.get(W + "fmt")) if numbers is not None else None
    out["start_page_number"] = _number(numbers.get(W + "start"), int) if numbers is not None else None
    out["line_numbering"] = True if e.find(W + "lnNumType") is not None else None
    for side in SIDES:
        edge = borders.find(W + side) if borders is not None else None
        drawn = edge is not None and edge.get(W + "val") not in (None, "", "none", "nil")
        colour = edge.get(W + "color") if drawn else None
        width = (_number(edge.get(W + "sz")) or 4) / 8 if drawn else None  # eighths of a point
        out[f"border_{side}"] = f"{width:.1f}pt solid #{colour if colour and colour != 'auto' else '000000'}" if drawn else None
    out["columns"] = None
    if columns is not None:
        widths = [w for c in columns.findall(W + "col") if (w := _points(c, "w")) is not None] or None
        uneven = widths is not None or columns.get(W + "equalWidth") in NO
        told = {"count": _number(columns.get(W + "num"), int), "gap": _points(columns, "space"), "separator": True if columns.get(W + "sep") in YES else None}
        told |= {"same_width": False if uneven else None, "widths": widths}
        out["columns"] = told if any(v is not None for v in told.values()) else None
    return out


def sections(package: Package) -> list[dict]:
    """The sections in order: those that a paragraph ends, then the body's own."""
    root = package.tree("word/document.xml")
    body = root.find(W + "body") if len(root) else None
    if body is None:
        return []
    ends = [e if local(e.tag) == "sectPr" else e.find(f"{W}pPr/{W}sectPr") for e in body if local(e.tag) in ("p", "sectPr")]
    return [section_of(e) for e in ends if e is not None]


def properties(package: Package) -> dict[str, str]:
    """Title, author, dates and language, as far as the package tells them."""
    return {PROPERTIES[local(e.tag)]: e.text for e in package.tree("docProps/core.xml") if local(e.tag) in PROPERTIES and e.text}


def _spacing(pr) -> dict[str, str]:
    """Spacings of paragraph properties: points before and after; between lines a percentage or points."""
    e = pr.find(W + "spacing") if pr is not None else None
    if e is None:
        return {}
    line, exact = _number(e.get(W + "line")), e.get(W + "lineRule") in ("exact", "atLeast")
    told = {"space_before": _points(e, "before"), "space_after": _points(e, "after")}
    out = {k: f"{v:g}pt" for k, v in told.items() if v is not None}
    if line is not None:
        out["line_spacing"] = f"{line / TWIPS_PER_PT:g}pt" if exact else f"{line / 2.4:g}%"
    return out


class Spacings:
    """Spacings of paragraphs: their own, where they say none their style's, without a style the default."""

    def __init__(self, package: Package):
        self.styles: dict[str, dict[str, str]] = {}
        self.default: dict[str, str] = {}
        base: dict[str, str] = {}
        for e in package.tree("word/styles.xml"):
            if local(e.tag) == "docDefaults":
                base = _spacing(e.find(f"{W}pPrDefault/{W}pPr"))
            elif local(e.tag) == "style" and e.get(W + "type") == "paragraph":
                self.styles[e.get(W + "styleId")] = _spacing(e.find(W + "pPr"))
                if e.get(W + "default") in YES:
                    self.default = self.styles[e.get(W + "styleId")]
        self.default = self.default or base

    def of(self, p) -> dict[str, str]:
        pr = p.find(W + "pPr")
        style = pr.find(W + "pStyle") if pr is not None else None
        known = self.styles.get(style.get(W + "val")) if style is not None else None
        return (known or self.default) | _spacing(pr)


def _packages(files: DataFrame, content: str, schema, rows_of) -> DataFrame:
    """Rows of each package; null and broken files give none."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("c"), strict=True):
                if data.is_valid:
                    try:
                        package = Package(data.as_py())
                        rows += [{"doc_id": doc_id} | row for row in rows_of(package)]
                    except Exception:  # one broken package must not end the job
                        continue
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(content).alias("c")).mapInArrow(run, schema)


def docx_sections(files: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, n and the properties of every section of DOCX files (doc_id, content); lengths in points."""
    return _packages(files, content, SECTIONS, lambda package: [{"n": n} | s for n, s in enumerate(sections(package))])


def docx_properties(files: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, title, author, created_at, modified_at and language of DOCX files; null where a file does not say."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in PROPERTIES.values())])
    return _packages(files, content, schema, lambda package: [dict.fromkeys(PROPERTIES.values()) | properties(package)])
