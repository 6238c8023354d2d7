"""Plain text and Markdown lines without Python: native sources of nodes and of line kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import INLINE_FIELDS, NODES


def text_inline(text: Column) -> Column:
    """One text inline without style."""
    return F.struct(*[(F.lit("text") if n == "type" else text if n == "text" else F.lit(None)).cast(t).alias(n) for n, t in INLINE_FIELDS])


def flat_nodes(df: DataFrame, doc_id: Column, seq: Column, kind: Column, text: Column, level: Column | None = None, node_id: Column | None = None, attrs: Column | None = None) -> DataFrame:
    """Top-level blocks from columns; paragraphs hold their text as one inline, other types as ``text``."""
    made = {
        "doc_id": doc_id, "seq": seq, "seq_end": seq, "depth": F.lit(0), "kind": F.lit("block"), "slot": F.lit("blocks"), "ord": seq,
        "node_id": node_id if node_id is not None else F.format_string("b_%04d", (seq + 1).cast("int")), "type": kind,
        "level": level if level is not None else F.lit(None), "text": F.when(kind != "paragraph", text),
        "inlines": F.when(kind == "paragraph", F.array(text_inline(text))), "raw": text, "attrs": attrs if attrs is not None else F.lit(None),
    }
    return df.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NODES.fields])


def paragraph_nodes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A paragraph for each line that is not blank."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    rows = docs.select(F.col(doc_id).alias("_id"), F.posexplode(lines).alias("_n", "_line"))
    return flat_nodes(rows, F.col("_id"), F.col("_n"), F.lit("paragraph"), F.col("_line"))


def line_kinds(docs: DataFrame, md: str = "md") -> DataFrame:
    """doc_id, line_no, kind and line of Markdown: what each line outside fences opens."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.col(md), "\n")).alias("line_no", "line"))
    line = F.col("line")
    fence = line.rlike(r"^(`{3,}|~{3,})")
    kind = (
        F.when(line.rlike(r"^\s*<!--\s*b_\d{4,}\s*-->\s*$"), "id")
        .when(line.rlike(r"^\[\^[^\]]+\]:"), "footnote")
        .when(fence, "fence")
        .when(line.rlike(r"^#{1,6}\s+\S"), "heading")
        .when(line.rlike(r"^\s*(-{3,}|\*{3,}|_{3,})\s*$"), "rule")
        .when(~line.rlike(r"\S"), "blank")
        .when(line.rlike(r"(?i)^\s*<table"), "html_table")
        .when(line.rlike(r"^\s*\|"), "pipe")
        .when(line.rlike(r"^\s*[-*+]\s+"), "bullet")
        .when(line.rlike(r"^\s*\d+[.)]\s+"), "number")
        .otherwise("text")
    )
    return rows.select("doc_id", "line_no", kind.alias("kind"), "line")
