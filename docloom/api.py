"""A corpus: nodes with the operators as methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import compare, edit, query, structure, tables, text
from .sinks import render_documents
from .sources import parse_documents, parse_files


class Corpus:
    """Wraps a table of nodes; every method returns a DataFrame or another corpus, and nothing runs before an action."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    @classmethod
    def of_texts(cls, docs: DataFrame, fmt: str, text: str = "text") -> Corpus:
        return cls(parse_documents(docs, fmt, text))

    @classmethod
    def of_files(cls, spark: SparkSession, path: str) -> Corpus:
        return cls(parse_files(spark.read.format("binaryFile").load(path).select("path", "content")))

    def find_blocks(self, block_type: str | None = None, **equal) -> DataFrame:
        return query.find_blocks(self.nodes, block_type, **equal)

    def find_text(self, pattern: str) -> DataFrame:
        return text.find_text(self.nodes, pattern)

    def replace_text(self, old: str, new: str) -> Corpus:
        return Corpus(text.replace_text(self.nodes, old, new).drop("replaced").select(*self.nodes.columns))

    def fill_template(self, values: dict[str, str | None]) -> Corpus:
        return Corpus(text.fill_template(self.nodes, values))

    def list_placeholders(self) -> DataFrame:
        return text.list_placeholders(self.nodes)

    def apply_edits(self, edits: DataFrame) -> Corpus:
        return Corpus(edit.apply_edits(self.nodes, edits))

    def remove_blocks(self, targets: DataFrame) -> Corpus:
        return Corpus(edit.remove_blocks(self.nodes, targets))

    def add_blocks(self, blocks: DataFrame) -> Corpus:
        return Corpus(edit.add_blocks(self.nodes, blocks))

    def diff(self, other: Corpus) -> DataFrame:
        return compare.diff_documents(self.nodes, other.nodes)

    def merge(self, edited: Corpus) -> Corpus:
        return Corpus(compare.merge_documents(self.nodes, edited.nodes))

    def sections(self) -> DataFrame:
        return structure.sections(self.nodes)

    def grid(self) -> DataFrame:
        return tables.grid_coordinates(self.nodes)

    def render(self, fmt: str, **options) -> DataFrame:
        return render_documents(self.nodes, fmt, **options)
