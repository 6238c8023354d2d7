"""Whole steps on files, as a command line or a server of tools asks for them: each takes paths or globs and runs one plan.

Nothing here loops over documents in the driver; results that are texts of one document are read by
its path.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import NODES
from .operators import compare, edit, query, text
from .sinks import render_documents
from .sources import FORMATS, parse_documents, parse_files
from .sources.registry import format_of

_HEADER = re.compile(r"^<!-- docloom-source:([^\n]*?)-->\n")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and doc_id (a hash of the path) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.xxhash64("path").alias("doc_id"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of files."""
    return parse_files(files(spark, path).select("path", "content"))


def convert(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """path and content of files in another format."""
    made = render_documents(read(spark, path), fmt, **options)
    return files(spark, path).select("path", "doc_id").join(made, "doc_id").select("path", "content")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """path, format, type and the number of blocks of each type."""
    counts = query.type_counts(read(spark, path), "doc_id")
    return files(spark, path).select("path", "doc_id", format_of(F.col("path")).alias("format")).join(counts, "doc_id", "left").drop("doc_id")


def diff(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Differences between two files, by block id."""
    as_one = lambda p: read(spark, p).withColumn("doc_id", F.lit(1).cast("long"))
    return compare.diff_documents(as_one(a), as_one(b)).drop("doc_id")


def validate(spark: SparkSession, path: str) -> DataFrame:
    """path, rule_id, severity and message of the rules that files break, by their formats."""
    from .validation import rules
    from .validation.hwp import validate_hwp_files

    found = files(spark, path).withColumn("format", format_of(F.col("path")))
    said = found.withColumn("content", F.decode("content", "UTF-8"))
    of = lambda df, fmt: df.where(F.col("format") == fmt).select("doc_id", "content")
    parts = [validate_hwp_files(of(found, "hwp")), rules.validate_hwpx(of(found, "hwpx")), rules.validate_docx(of(found, "docx")), rules.validate_markdown(of(said, "md"), "content"), rules.validate_html(of(said, "html"), "content")]
    columns = ["doc_id", "rule_id", "severity", "message"]
    broken = parts[0].select(*columns)
    for part in parts[1:]:
        broken = broken.unionByName(part.withColumns({c: F.lit("error") for c in columns if c not in part.columns}).select(*columns))
    return found.select("path", "doc_id").join(broken, "doc_id").drop("doc_id")


def info(fmt: str | None = None) -> list[dict]:
    """What is known of all formats, or of one."""
    if fmt is not None and fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known are {', '.join(sorted(FORMATS))}")
    return [vars(FORMATS[name]) for name in sorted(FORMATS) if fmt in (None, name)]


def source_header(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id and the comment that names a document's path, format, fingerprint and number of blocks."""
    blocks = nodes.where("depth = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"))
    marks = query.fingerprint(nodes).join(blocks, "doc_id").join(paths.select("doc_id", "path"), "doc_id")
    said = F.concat(F.lit("<!-- docloom-source: path="), "path", F.lit(" format="), F.coalesce(format_of(F.col("path")), F.lit("unknown")), F.lit(" fingerprint="), "fingerprint", F.lit(" blocks="), F.col("blocks").cast("string"), F.lit(" -->\n"))
    return marks.select("doc_id", said.alias("header"))


def parse_source_header(md: str) -> dict[str, str] | None:
    """What an exported text says of its source; null if it says nothing."""
    found = _HEADER.match(md)
    return dict(re.findall(r"(\w+)=(\S+)", found[1])) if found else None


def strip_source_header(md: str) -> str:
    return _HEADER.sub("", md, count=1)


def export_md(spark: SparkSession, path: str) -> DataFrame:
    """path and Markdown with ids, for editing; the first line names the source."""
    found, nodes = files(spark, path), read(spark, path)
    made = render_documents(nodes, "md", embed_ids=True).join(source_header(nodes, found), "doc_id")
    return found.select("path", "doc_id").join(made, "doc_id").select("path", F.concat("header", "content").alias("content"))


def import_md(spark: SparkSession, path: str, edited: str) -> DataFrame:
    """The nodes of a document with what an edited export of it changed: blocks, cells and list items, by id."""
    docs = spark.createDataFrame([(1, strip_source_header(edited))], "doc_id long, text string")
    return compare.merge_documents(_one(spark, path), parse_documents(docs, "md"))


def _one(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path).withColumn("doc_id", F.lit(1).cast("long"))


def apply_edits(spark: SparkSession, path: str, edits: list[dict]) -> DataFrame:
    """The nodes of a document after edits: dicts with block_id, inline_idx, text and fmt."""
    rows = [(1, e["block_id"], int(e.get("inline_idx") or 0), e.get("text"), {k: str(v) for k, v in (e.get("fmt") or {}).items()} or None) for e in edits]
    return edit.apply_edits(_one(spark, path), spark.createDataFrame(rows, "doc_id long, node_id string, inline_idx int, text string, fmt map<string,string>"))


def insert_blocks(spark: SparkSession, path: str, specs: list[dict], after: str | None = None) -> DataFrame:
    """The nodes of a document with blocks (descriptions as in JSON sources; leaves) after a block, or at the end."""
    from .builder import blocks_from_json
    from .model import rows_of

    rows = [r for r in rows_of(1, blocks_from_json(specs)) if r["depth"] == 0]
    schema = "doc_id long, type string, text string, level int, attrs map<string,string>, inlines " + NODES["inlines"].dataType.simpleString() + ", after string, at int"
    made = [(1, r["type"], r["text"], r["level"], r["attrs"], [tuple(i.values()) for i in r["inlines"]] if r["inlines"] else None, after, k) for k, r in enumerate(rows)]
    return edit.add_blocks(_one(spark, path), spark.createDataFrame(made, schema))


def remove_blocks(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    return edit.remove_blocks(_one(spark, path), spark.createDataFrame([(1, i) for i in ids], "doc_id long, node_id string"))


def list_placeholders(spark: SparkSession, path: str) -> DataFrame:
    return text.list_placeholders(_one(spark, path)).drop("doc_id")


def fill_template(spark: SparkSession, path: str, values: dict[str, str]) -> DataFrame:
    return text.fill_template(_one(spark, path), values)


def set_placeholders(spark: SparkSession, path: str, wanted: list[dict]) -> tuple[DataFrame, DataFrame]:
    rows = [(1, w["block_id"], w.get("inline_idx"), w["key"]) for w in wanted]
    return text.set_placeholders(_one(spark, path), spark.createDataFrame(rows, "doc_id long, node_id string, inline_idx int, key string"))


def render(nodes: DataFrame, fmt: str, **options) -> DataFrame:
    return render_documents(nodes, fmt, **options)


#: What a server offers, by name.
TOOLS: dict[str, Callable] = {
    f.__name__: f for f in (read, convert, inspect, diff, validate, info, export_md, import_md, apply_edits, insert_blocks, remove_blocks, list_placeholders, fill_template, set_placeholders, render)
}


def describe(topic: str = "overview") -> str:
    """What there is: ``overview``, ``blocks``, or a tool's name."""
    from .model import BLOCK_TYPES

    if topic == "overview":
        return "A document is a run of nodes in pre-order. Tools: " + ", ".join(sorted(TOOLS)) + "."
    if topic == "blocks":
        return "Block types: " + ", ".join(BLOCK_TYPES) + "."
    if topic in TOOLS:
        return (TOOLS[topic].__doc__ or topic).strip()
    return f"Unknown topic {topic!r}. Known: blocks, overview, {', '.join(sorted(TOOLS))}"


def create_server(spark: SparkSession, name: str = "docloom"):
    """A server of all tools over the Model Context Protocol; needs the package ``mcp``."""
    try:
        from mcp.server.fastmcp import FastMCP
    except ImportError as e:
        raise RuntimeError("a server needs the package mcp") from e
    import functools
    import json

    server = FastMCP(name)

    def offered(f: Callable) -> Callable:
        def call(arguments: str) -> str:
            made = f(**json.loads(arguments)) if f is info else f(spark, **json.loads(arguments))
            return json.dumps([row.asDict(True) for row in made.toLocalIterator()] if isinstance(made, DataFrame) else made, default=str, ensure_ascii=False)

        return functools.update_wrapper(call, f, assigned=("__name__", "__doc__"), updated=())

    for f in TOOLS.values():
        if f is not render and f is not set_placeholders:
            server.tool()(offered(f))
    server.tool()(describe)
    return server
