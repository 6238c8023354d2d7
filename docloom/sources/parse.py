"""Parsing as a stage of a plan: one pass over the rows, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..builder import parse_json
from ..model import NODES, Node, rows_of
from .docx import parse_docx
from .html import parse_html
from .hwp import parse_hwp
from .hwpx import parse_hwpx
from .pdf import parse_pdf
from .markdown import parse_markdown
from .registry import format_of
from .xml import parse_xml

PARSERS = {"md": parse_markdown, "html": parse_html, "xml": parse_xml, "docx": parse_docx, "hwp": parse_hwp, "hwpx": parse_hwpx, "pdf": parse_pdf, "json": parse_json}
BINARY = ("docx", "hwp", "hwpx", "pdf")
#: Nodes handed to Spark at once.
BATCH = 5_000


def _parse(fmt: str, content, parsers=None, binary=None) -> list[Node]:
    parsers, binary = parsers or PARSERS, binary or BINARY
    if fmt not in parsers:
        return [Node("unknown", "b_0001", attrs={"error": f"no parser for {fmt}"})]
    try:
        if isinstance(content, (bytes, bytearray)) and fmt not in binary:
            content = bytes(content).decode("utf-8", "replace")
        return parsers[fmt](content)
    except Exception as e:  # one bad document must not end the job; it is reported as an unknown block
        return [Node("unknown", "b_0001", attrs={"error": f"{type(e).__name__}: {e}"[:300]})]


def _stage(batches, parsers=None, binary=None):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(NODES)
    held: list[dict] = []
    for batch in batches:
        for doc_id, fmt, content in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "format", "content")], strict=True):
            if content is not None:
                rows = rows_of(doc_id, _parse(fmt, content, parsers, binary))
                for row in rows:
                    row["attrs"] = list(row["attrs"].items())
                held += rows
            if len(held) >= BATCH:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def parse_documents(docs: DataFrame, fmt: str | Column, text: str | Column = "text", doc_id: str = "doc_id") -> DataFrame:
    """The nodes of all documents; ``fmt`` is a format name or a column of them.

    Null texts give no nodes. A document that cannot be parsed gives one unknown block with the error in attrs.
    """
    kind = F.lit(fmt) if isinstance(fmt, str) else fmt
    content = F.col(text) if isinstance(text, str) else text
    parsers, binary = dict(PARSERS), BINARY  # as they are now, formats registered in the driver among them

    def stage(batches):
        return _stage(batches, parsers, binary)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), kind.alias("format"), content.alias("content")).mapInArrow(stage, NODES)


def parse_files(files: DataFrame) -> DataFrame:
    """Nodes of files (path, content) as read by ``spark.read.format("binaryFile")``; doc_id is a hash of the path."""
    return parse_documents(files.withColumn("doc_id", F.xxhash64("path")), format_of(F.col("path")), "content")


NODES_WITHOUT_INLINES = T.StructType([f for f in NODES.fields if f.name != "inlines"])
