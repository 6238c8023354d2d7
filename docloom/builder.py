"""Documents built in code or from JSON descriptions."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .model import NODES, Ids, Node, inline, rows_of

# Paper sizes in points, and the default margins (top, bottom, left, right) in millimetres.
PAPERS = {"A3": (841.89, 1190.55), "A4": (595.28, 841.89), "A5": (419.53, 595.28), "B5": (498.90, 708.66), "Letter": (612.0, 792.0), "Legal": (612.0, 1008.0)}
MARGINS_MM, PT_PER_MM = (20.0, 20.0, 30.0, 30.0), 2.8346


class DocumentBuilder:
    """Appends blocks one after the other; every method returns the builder."""

    def __init__(self, start: int = 1):
        self._ids, self.blocks = Ids(start), []
        self._notes = 0

    def block(self, node: Node) -> DocumentBuilder:
        node.node_id = node.node_id or self._ids()
        self.blocks.append(node)
        return self

    def _paragraph(self, text: str, **style: Any) -> Node:
        return Node("paragraph", self._ids(), inlines=[inline(text=text, **style)], raw=text)

    def heading(self, level: int, text: str, **style: Any) -> DocumentBuilder:
        return self.block(Node("heading", level=max(1, min(6, level)), text=text, inlines=[inline(text=text, **style)]))

    def paragraph(self, text: str = "", **style: Any) -> DocumentBuilder:
        return self.block(self._paragraph(text, **style))

    def link(self, text: str, url: str) -> DocumentBuilder:
        return self.block(Node("paragraph", inlines=[inline("link", text, url=url)]))

    def table(self, data: list[list[str | dict | None]], header: bool = True) -> DocumentBuilder:
        """Rows of texts, or of objects with text, row_span and col_span; None leaves a place to a span."""
        table = Node("table", self._ids())
        for n, values in enumerate(data):
            row = Node("table_row", None, kind="table_row", is_header=header and n == 0)
            for value in values:
                if value is None:
                    continue
                known = value if isinstance(value, dict) else {"text": value}
                cell = Node("table_cell", self._ids(), kind="table_cell", row_span=known.get("row_span", 1), col_span=known.get("col_span", 1), is_header=header and n == 0)
                cell.add(self._paragraph(str(known.get("text") or "")), "content")
                row.add(cell, "cells")
            table.add(row, "rows")
        return self.block(table)

    def image(self, src: str, alt: str = "", width: float | None = None, height: float | None = None) -> DocumentBuilder:
        return self.block(Node("image", text=alt or None, attrs={"src": src, "alt": alt or None, "width": width, "height": height}))

    def list(self, items: list[str], ordered: bool = False) -> DocumentBuilder:
        node = Node("list", self._ids(), ordered=ordered, start=1 if ordered else None)
        for item in items:
            node.add(Node("list_item", self._ids(), kind="list_item", inlines=[inline(text=item)]), "items")
        return self.block(node)

    def code(self, code: str, language: str | None = None) -> DocumentBuilder:
        return self.block(Node("code", text=code, attrs={"language": language}))

    def _holder(self, kind: str, text: str, **attrs: Any) -> DocumentBuilder:
        node = Node(kind, self._ids(), attrs=attrs)
        node.add(self._paragraph(text), "content")
        return self.block(node)

    def quote(self, text: str) -> DocumentBuilder:
        return self._holder("quote", text)

    def text_box(self, *blocks: Node, width: float | None = None, height: float | None = None) -> DocumentBuilder:
        node = Node("text_box", self._ids(), attrs={"width": width, "height": height})
        for block in blocks:
            block.node_id = block.node_id or self._ids()
            node.add(block, "content")
        return self.block(node)

    def footnote(self, text: str) -> DocumentBuilder:
        """A note, referred to from the block before it where that has inlines."""
        self._notes += 1
        if self.blocks and self.blocks[-1].inlines is not None:
            self.blocks[-1].inlines.append(inline("footnote_ref", ref=str(self._notes)))
        return self._holder("footnote", text, ref=str(self._notes))

    def equation(self, latex: str) -> DocumentBuilder:
        return self.block(Node("equation", text=latex))

    def horizontal_rule(self) -> DocumentBuilder:
        return self.block(Node("horizontal_rule"))

    def page_break(self) -> DocumentBuilder:
        return self.block(Node("page_break"))

    def bookmark(self, name: str) -> DocumentBuilder:
        return self.block(Node("bookmark", attrs={"name": name}))

    def field(self, field_type: str, value: str | None = None, **options: Any) -> DocumentBuilder:
        return self.block(Node("field", text=value, attrs={"field_type": field_type, **options}))

    def rows(self, doc_id: int) -> list[dict]:
        return rows_of(doc_id, self.blocks)


def blocks_from_json(specs: list[dict[str, Any]]) -> list[Node]:
    """Blocks of a list of descriptions; an unknown type becomes a paragraph of its text. Nothing is fetched."""
    b = DocumentBuilder()
    for spec in specs:
        kind, text = spec.get("type"), str(spec.get("text") or "")
        style = {k: spec[k] for k in ("bold", "italic", "underline", "strike", "color", "font", "size") if spec.get(k) is not None}
        if kind == "heading":
            b.heading(int(spec.get("level") or 1), text, **style)
        elif kind == "table":
            b.table(spec.get("rows") or [], bool(spec.get("header_rows", 1)))
        elif kind == "list":
            b.list([str(i) for i in spec.get("items") or []], bool(spec.get("ordered")))
        elif kind == "image":
            b.image(str(spec.get("src") or ""), str(spec.get("alt") or ""), spec.get("width"), spec.get("height"))
        elif kind == "code":
            b.code(str(spec.get("code") or text), spec.get("language"))
        elif kind == "quote":
            b.quote(text)
        elif kind == "equation":
            b.equation(str(spec.get("latex") or text))
        elif kind == "page_break":
            b.page_break()
        elif kind == "horizontal_rule":
            b.horizontal_rule()
        elif kind == "footnote":
            b.footnote(text)
        else:
            b.paragraph(text, **style)
    return b.blocks


def parse_json(text: str) -> list[Node]:
    """Blocks of a JSON array of descriptions, or of an object whose ``blocks`` is one."""
    found = json.loads(text)
    return blocks_from_json(found["blocks"] if isinstance(found, dict) else found)


def page_settings(paper: str = "A4", orientation: str = "portrait", margins_mm: tuple[float | None, ...] = (None, None, None, None)) -> dict[str, float]:
    """Page size and margins in points; margins that are not given keep their defaults, landscape swaps the sides."""
    width, height = PAPERS[paper]
    if orientation == "landscape":
        width, height = height, width
    given = [(d if m is None else m) * PT_PER_MM for m, d in zip(margins_mm, MARGINS_MM, strict=True)]
    return {"width": width, "height": height, **dict(zip(("top", "bottom", "left", "right"), given, strict=True))}


def to_nodes(spark: SparkSession, documents: dict[int, DocumentBuilder]) -> DataFrame:
    """Nodes of documents built in the driver."""
    rows = [tuple(row[n] for n in NODES.names) for doc_id, b in documents.items() for row in b.rows(doc_id)]
    return spark.createDataFrame(rows, NODES)
