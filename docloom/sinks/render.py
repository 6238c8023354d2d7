"""Rendering as a stage of a plan: nodes are gathered by document, and written as rows or files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NODES, tree_of
from .hwp import to_hwp
from .hwpx import to_hwpx
from .writers import to_docx, to_html, to_json, to_markdown

WRITERS = {"md": to_markdown, "html": to_html, "json": to_json, "docx": to_docx, "hwpx": to_hwpx, "hwp": to_hwp}
BINARY = ("docx", "hwpx", "hwp")


def render_documents(nodes: DataFrame, fmt: str, **options) -> DataFrame:
    """doc_id and content (string; binary for packages) of every document.

    Nodes are dealt by doc_id once and streamed through in order, so a task holds one document at a time.
    """
    fmt = fmt.lower().strip().lstrip(".")
    if fmt not in WRITERS:
        raise ValueError(f"cannot render {fmt}")
    binary, writer = fmt in BINARY, WRITERS[fmt]

    def run(batches):
        import pyarrow as pa

        kind = pa.binary() if binary else pa.string()

        def flush(done):
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.int64()), pa.array([c for _, c in done], kind)], names=["doc_id", "content"])

        held, key, done = [], None, []
        for batch in batches:
            for row in batch.to_pylist():
                row["attrs"] = dict(row["attrs"] or [])
                if held and row["doc_id"] != key:
                    done.append((key, writer(tree_of(held), **options)))
                    held = []
                key = row["doc_id"]
                held.append(row)
                if len(done) >= 200:
                    yield flush(done)
                    done = []
        if held:
            done.append((key, writer(tree_of(held), **options)))
        yield flush(done)

    dealt = nodes.select(*NODES.names).repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return dealt.mapInArrow(run, f"doc_id long, content {'binary' if binary else 'string'}")


def save_documents(rendered: DataFrame, path: str, fmt: str) -> None:
    """Writes rendered documents: text formats by Spark's writer, one row each; binary ones as Parquet of (doc_id, content)."""
    if dict(rendered.dtypes)["content"] == "binary":
        rendered.write.mode("overwrite").parquet(path)
    else:
        rendered.select(F.to_json(F.struct("doc_id", "content")).alias("value")).write.mode("overwrite").text(path)
