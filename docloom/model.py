"""The table of nodes that every source makes and every operator reads.

A document is a tree of blocks; here it is a run of rows in pre-order. ``seq`` numbers a
document's nodes, and ``seq .. seq_end`` encloses a node's subtree, so "below X" is a range
condition and document order is ``ORDER BY doc_id, seq``. ``kind`` is block, list_item, table_row
or table_cell; ``slot`` names the parent's list that holds the node and ``ord`` its place there.
Fields that few types have are in ``attrs``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

INLINE_FIELDS = [
    ("type", T.StringType()),
    ("text", T.StringType()),
    ("bold", T.BooleanType()),
    ("italic", T.BooleanType()),
    ("underline", T.BooleanType()),
    ("strike", T.BooleanType()),
    ("superscript", T.BooleanType()),
    ("subscript", T.BooleanType()),
    ("color", T.StringType()),
    ("font", T.StringType()),
    ("size", T.DoubleType()),
    ("url", T.StringType()),
    ("ref", T.StringType()),
    ("latex", T.StringType()),
]
INLINE_NAMES = [name for name, _ in INLINE_FIELDS]
INLINE = T.StructType([T.StructField(n, t) for n, t in INLINE_FIELDS])

NODES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("seq_end", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("slot", T.StringType()),
        T.StructField("parent_seq", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("node_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("inlines", T.ArrayType(INLINE)),
        T.StructField("raw", T.StringType()),
        T.StructField("ordered", T.BooleanType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("checked", T.BooleanType()),
        T.StructField("row_span", T.IntegerType()),
        T.StructField("col_span", T.IntegerType()),
        T.StructField("is_header", T.BooleanType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

BLOCK_TYPES = (
    "heading paragraph list table image equation code quote text_box drawing footnote endnote header footer "
    "field page_break horizontal_rule bookmark comment chart text_art unknown"
).split()
#: Blocks whose content is other blocks.
CONTAINERS = ("quote", "text_box", "footnote", "endnote", "header", "footer", "comment")


def inline(kind: str = "text", text: str | None = None, **style: Any) -> dict:
    """An inline as a row of :data:`INLINE`; flags that are not set are null."""
    return {name: None for name in INLINE_NAMES} | {"type": kind, "text": text} | style


@dataclass
class Node:
    """A node while a document is parsed or built."""

    type: str
    node_id: str | None = None
    kind: str = "block"
    slot: str = "blocks"
    text: str | None = None
    inlines: list[dict] | None = None
    level: int | None = None
    raw: str | None = None
    ordered: bool | None = None
    start: int | None = None
    checked: bool | None = None
    row_span: int | None = None
    col_span: int | None = None
    is_header: bool | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def walk(self):
        """The node and all below it, in pre-order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children)

    def add(self, child: Node, slot: str) -> Node:
        child.slot = slot
        self.children.append(child)
        return child


class Ids:
    """Block ids b_0001, b_0002, ... from one counter for a whole document."""

    def __init__(self, start: int = 1):
        self.next = start

    def __call__(self) -> str:
        made = f"b_{self.next:04d}"
        self.next += 1
        return made


def rows_of(doc_id: int | None, blocks: list[Node]) -> list[dict]:
    """The rows of a tree, without recursion, in pre-order."""
    rows: list[dict] = []
    stack: list[tuple[Node, int | None, int, int]] = [(b, None, 0, i) for i, b in reversed(list(enumerate(blocks)))]
    while stack:
        node, parent, depth, place = stack.pop()
        seq = len(rows)
        rows.append(
            {
                "doc_id": doc_id, "seq": seq, "seq_end": seq, "depth": depth, "kind": node.kind, "slot": node.slot, "parent_seq": parent, "ord": place,
                "node_id": node.node_id, "type": node.type, "level": node.level, "text": node.text, "inlines": node.inlines, "raw": node.raw,
                "ordered": node.ordered, "start": node.start, "checked": node.checked, "row_span": node.row_span, "col_span": node.col_span,
                "is_header": node.is_header, "attrs": {k: str(v) for k, v in node.attrs.items() if v is not None},
            }
        )
        counts: dict[str, int] = {}
        placed = []
        for child in node.children:
            placed.append((child, seq, depth + 1, counts.get(child.slot, 0)))
            counts[child.slot] = counts.get(child.slot, 0) + 1
        stack += reversed(placed)
    for row in reversed(rows):  # a subtree ends where its last child's does
        if row["parent_seq"] is not None:
            parent = rows[row["parent_seq"]]
            parent["seq_end"] = max(parent["seq_end"], row["seq_end"])
    return rows


def tree_of(rows: list[dict]) -> list[Node]:
    """The inverse of :func:`rows_of` for the rows of one document, in order of ``seq``."""
    made: dict[int, Node] = {}
    top = []
    for row in sorted(rows, key=lambda r: r["seq"]):
        known = {k: row[k] for k in ("node_id", "kind", "slot", "text", "level", "raw", "ordered", "start", "checked", "row_span", "col_span", "is_header")}
        inlines = None if row["inlines"] is None else [dict(i) for i in row["inlines"]]
        node = Node(row["type"], inlines=inlines, attrs=dict(row["attrs"] or {}), **known)
        made[row["seq"]] = node
        (made[row["parent_seq"]].children if row["parent_seq"] is not None else top).append(node)
    return top
