"""HWP 5 files: their records as rows that SQL can query, the rules on them, and their blocks."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: record tags and the control characters of paragraph texts.
TAG_BEGIN = 0x10
PARA_HEADER, PARA_TEXT, PARA_CHAR_SHAPE, PARA_LINE_SEG, CTRL_HEADER, LIST_HEADER = 0x42, 0x43, 0x44, 0x45, 0x47, 0x48
SIGNS = {0: "", 9: "\t", 10: "\n", 13: "", 24: "-", 30: " ", 31: " "}
LONG_CONTROLS = frozenset([*range(1, 9), 11, 12, *range(14, 24)])
RECORDS = "doc_id long, seq int, tag int, level int, size long, payload binary"


@dataclass
class Record:
    """A record and the deeper ones that follow it."""

    tag: int
    payload: bytes
    level: int = 0
    children: list[Record] = field(default_factory=list)

    def first(self, tag: int) -> bytes | None:
        """The payload of the first child of that tag."""
        return next((c.payload for c in self.children if c.tag == tag), None)

    def walk(self) -> Iterator[Record]:
        todo = [self]
        while todo:
            record = todo.pop()
            yield record
            todo += reversed(record.children)

    def to_bytes(self) -> bytes:
        return b"".join(make_record(r.tag, r.level, r.payload) for r in self.walk())


#: A record's head: 10 bits of tag, 10 of level, 12 of size; a size of all ones stands in a word of its own.
_SIZE_FOLLOWS = (1 << 12) - 1


def iter_records(stream: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(tag, level, payload) of each whole record of a stream; a record that is cut off ends it."""
    file = io.BytesIO(stream)
    while len(head := file.read(4)) == 4:
        word = int.from_bytes(head, "little")
        tag, level, size = word & 1023, (word >> 10) & 1023, word >> 20
        if size == _SIZE_FOLLOWS:
            size = int.from_bytes(file.read(4), "little")
        payload = file.read(size)
        if len(payload) == size and file.tell() <= len(stream):
            yield tag, level, payload


def record_trees(stream: bytes) -> list[Record]:
    """The records of a stream as trees, by level."""
    top, open_ = [], []
    for tag, level, payload in iter_records(stream):
        record = Record(tag, payload, level)
        while open_ and open_[-1].level >= level:
            open_.pop()
        (open_[-1].children if open_ else top).append(record)
        open_.append(record)
    return top


def make_record(tag: int, level: int, payload: bytes) -> bytes:
    if len(payload) >= 0xFFF:
        return struct.pack("<II", tag | level << 10 | 0xFFF << 20, len(payload)) + payload
    return struct.pack("<I", tag | level << 10 | len(payload) << 20) + payload


def plain_text(payload: bytes) -> str:
    """The text of a PARA_TEXT payload; long controls take eight characters, a tab among them shows."""
    codes = struct.unpack(f"<{len(payload) // 2}H", payload[: len(payload) // 2 * 2])
    out, i = bytearray(), 0
    while i < len(codes):
        code = codes[i]
        if code == 13:
            break
        if code == 9 or code in LONG_CONTROLS:
            out += "\t".encode("utf-16-le") if code == 9 else b""
            i += 8
            continue
        out += SIGNS[code].encode("utf-16-le") if code in SIGNS else struct.pack("<H", code)
        i += 1
    return out.decode("utf-16-le", "replace")


def control_id(payload: bytes) -> str:
    """The four letters of a control, which are stored backwards."""
    return payload[:4][::-1].decode("ascii", "replace")


def inflated(stream: bytes, compressed: bool) -> bytes:
    return zlib.decompress(stream, -15) if compressed else stream


def records_of(streams: DataFrame, stream: str = "stream") -> DataFrame:
    """One row per record of streams (doc_id, stream)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(d, n, tag, level, len(payload), payload) for d, s in zip(pdf["doc_id"], pdf["s"], strict=True) for n, (tag, level, payload) in enumerate(iter_records(bytes(s)))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "tag", "level", "size", "payload"])

    return streams.where(F.col(stream).isNotNull()).select("doc_id", F.col(stream).alias("s")).mapInPandas(run, RECORDS)


def _u32(payload, at):
    """A little-endian number at a byte of a payload; ``at`` is a number or a column."""
    part = F.reverse(F.hex(F.substring(payload, (at if not isinstance(at, int) else F.lit(at)) + 1, F.lit(4))))
    # hex pairs reversed as text are reversed nibbles; turn each pair back
    pairs = F.regexp_replace(part, "(.)(.)", "$2$1")
    return F.conv(pairs, 16, 10).cast("long")


def paragraphs_of(records: DataFrame) -> DataFrame:
    """One row per paragraph: declared and actual counts of signs, character shapes and line segments.

    A paragraph's parts are the records after its header up to the next header.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = records.withColumn("para", F.sum((F.col("tag") == PARA_HEADER).cast("int")).over(order)).where("para > 0")
    of = lambda tag, value: F.max(F.when(F.col("tag") == tag, value))
    head = F.col("payload")
    return numbered.groupBy("doc_id", "para").agg(
        of(PARA_HEADER, _u32(head, 0).bitwiseAND(F.lit(0x7FFFFFFF))).alias("declared_signs"),
        of(PARA_HEADER, _u32(head, 12).bitwiseAND(F.lit(0xFFFF))).alias("declared_shapes"),
        of(PARA_HEADER, _u32(head, 16).bitwiseAND(F.lit(0xFFFF))).alias("declared_lines"),
        F.floor(of(PARA_TEXT, F.col("size")) / 2).alias("signs"),
        F.floor(of(PARA_CHAR_SHAPE, F.col("size")) / 8).alias("shapes"),
        F.floor(of(PARA_LINE_SEG, F.col("size")) / 36).alias("lines"),
    )


def validate_records(records: DataFrame) -> DataFrame:
    """Rules R1 (signs), R2 (shapes and line segments) and R3 (a text needs a line segment), by paragraph."""
    paras = paragraphs_of(records)
    rules = F.array_compact(
        F.array(
            F.when(F.col("signs").isNotNull() & (F.col("signs") != F.col("declared_signs")), "R1"),
            F.when((F.coalesce("shapes", F.lit(0)) != F.col("declared_shapes")) | (F.coalesce("lines", F.lit(0)) != F.col("declared_lines")), "R2"),
            F.when(F.col("signs").isNotNull() & (F.coalesce("lines", F.lit(0)) == 0), "R3"),
        )
    )
    return paras.select("doc_id", "para", F.explode(rules).alias("rule_id"))


# Tags of the document information and of controls' parts.
FACE_NAME, CHAR_SHAPE, STYLE, TABLE, EQUATION = 0x13, 0x15, 0x1A, 0x4D, 0x58
_NOTES = {"fn  ": "footnote", "en  ": "endnote", "head": "header", "foot": "footer"}


class DocInfo:
    """Fonts, character shapes and style names, by their order in the stream."""

    def __init__(self, stream: bytes):
        self.fonts: list[str] = []
        self.shapes: list[dict] = []
        self.styles: list[str] = []
        for tag, _, payload in iter_records(stream):
            if tag == FACE_NAME and len(payload) >= 3:
                (n,) = struct.unpack_from("<H", payload, 1)
                self.fonts.append(payload[3 : 3 + 2 * n].decode("utf-16-le", "replace"))
            elif tag == CHAR_SHAPE and len(payload) >= 56:
                size, bits = struct.unpack_from("<iI", payload, 42)
                red, green, blue = payload[52:55]
                color = f"#{red:02x}{green:02x}{blue:02x}"
                flag = lambda at, mask=1, b=bits: True if b >> at & mask else None
                self.shapes.append(
                    {
                        "italic": flag(0), "bold": flag(1), "underline": flag(2, 3), "superscript": flag(15), "subscript": flag(16), "strike": flag(18, 7),
                        "size": size / 100.0, "color": None if color == "#000000" else color, "face": struct.unpack_from("<H", payload)[0],
                    }
                )
            elif tag == STYLE and len(payload) >= 2:
                (n,) = struct.unpack_from("<H", payload)
                self.styles.append(payload[2 : 2 + 2 * n].decode("utf-16-le", "replace"))

    def style_of(self, number: int) -> dict:
        if number >= len(self.shapes):
            return {}
        known = dict(self.shapes[number])
        face = known.pop("face")
        return known | {"font": self.fonts[face] if face < len(self.fonts) else None}

    def level(self, style: int) -> int | None:
        import re

        named = re.match(r"(?:개요|Heading|Outline)\s*(\d+)", self.styles[style]) if style < len(self.styles) else None
        return max(1, min(6, int(named[1]))) if named else None


def _runs(text: bytes, shapes: bytes, info: DocInfo) -> list[dict]:
    """Inlines of a paragraph: each stretch of text has the shape of the last position at or before it."""
    from ..model import inline

    marks = [struct.unpack_from("<II", shapes, i) for i in range(0, len(shapes) - 7, 8)] or [(0, 1 << 31)]
    out = []
    for k, (start, shape) in enumerate(marks):
        end = marks[k + 1][0] if k + 1 < len(marks) else len(text) // 2
        said = plain_text(text[2 * start : 2 * end])
        if said:
            out.append(inline(text=said, **info.style_of(shape)))
    return out


def _blocks(records: list[tuple[int, int, bytes]], start: int, end: int, info: DocInfo, ids) -> list:
    """Blocks of the paragraphs among ``records[start:end]``; deeper records belong to the paragraph before them.

    A paragraph or heading notes the place of its record in ``attrs`` (record), for patches.
    """
    from ..model import Node

    out, i = [], start
    while i < end:
        tag, level, payload = records[i]
        stop = i + 1
        while stop < end and records[stop][1] > level:
            stop += 1
        if tag == PARA_HEADER:
            text = next((p for t, v, p in records[i + 1 : stop] if t == PARA_TEXT and v == level + 1), b"")
            shapes = next((p for t, v, p in records[i + 1 : stop] if t == PARA_CHAR_SHAPE and v == level + 1), b"")
            inlines = _runs(text, shapes, info)
            heading = info.level(payload[10]) if len(payload) > 10 else None
            extra = []
            for k in range(i + 1, stop):
                if records[k][0] == CTRL_HEADER and records[k][1] == level + 1:
                    last = k + 1
                    while last < stop and records[last][1] > level + 1:
                        last += 1
                    extra += _control(records, k, last, info, ids)
            if heading and inlines:
                out.append(Node("heading", ids(), level=heading, text="".join(x["text"] for x in inlines), inlines=inlines, attrs={"record": str(i)}))
            elif inlines or not (extra or any(t == CTRL_HEADER and control_id(p) == "secd" for t, _, p in records[i + 1 : stop])):
                out.append(Node("paragraph", ids(), inlines=inlines, attrs={"record": str(i)}))
            out += extra
        i = stop
    return out


def _control(records, at: int, end: int, info: DocInfo, ids) -> list:
    from ..functions.script import script_to_latex
    from ..model import Node

    kind, level = control_id(records[at][2]), records[at][1]
    lists = [k for k in range(at + 1, end) if records[k][0] == LIST_HEADER and records[k][1] == level + 1]
    bounds = list(zip(lists, [*lists, end][1:], strict=True)) if lists else []
    if kind == "tbl ":
        table, rows = Node("table", ids()), {}
        for first, last in bounds:
            payload = records[first][2]
            if len(payload) < 16:
                continue
            column, row, columns, height = struct.unpack_from("<HHHH", payload, 8)
            cell = Node("table_cell", ids(), kind="table_cell", row_span=max(1, height), col_span=max(1, columns))
            for block in _blocks(records, first + 1, last, info, ids) or [Node("paragraph", ids(), inlines=[])]:
                cell.add(block, "content")
            rows.setdefault(row, []).append((column, cell))
        for row in sorted(rows):
            made = Node("table_row", None, kind="table_row")
            for _, cell in sorted(rows[row], key=lambda x: x[0]):
                made.add(cell, "cells")
            table.add(made, "rows")
        return [table]
    if kind == "eqed":
        payload = next((p for t, _, p in records[at + 1 : end] if t == EQUATION), b"")
        if len(payload) >= 6:
            (n,) = struct.unpack_from("<H", payload, 4)
            script = payload[6 : 6 + 2 * n].decode("utf-16-le", "replace")
            return [Node("equation", ids(), text=script_to_latex(script), attrs={"hwp_script": script})]
        return []
    if kind in _NOTES or (kind == "gso " and bounds):
        node = Node(_NOTES.get(kind, "text_box"), ids())
        for first, last in bounds:
            for block in _blocks(records, first + 1, last, info, ids):
                node.add(block, "content")
        return [node]
    return [Node("drawing", ids())] if kind == "gso " else []


def parse_hwp(content: bytes, ids=None) -> list:
    """Blocks of an HWP 5 file: paragraphs, headings by style, tables, notes, heads and feet, equations, text boxes."""
    from ..model import Ids
    from .ole import CompoundFile

    file, ids = CompoundFile(content), ids or Ids()
    head = file.read("FileHeader")
    flags = struct.unpack_from("<I", head, 36)[0] if len(head) >= 40 else 0
    if flags & 2:
        raise ValueError("the document is encrypted")
    info = DocInfo(inflated(file.read("DocInfo"), bool(flags & 1)))
    names = sorted((n for n in file.streams if n.startswith("BodyText/Section")), key=lambda n: int(n.removeprefix("BodyText/Section") or 0))
    out = []
    for name in names:
        records = list(iter_records(inflated(file.read(name), bool(flags & 1))))
        made = _blocks(records, 0, len(records), info, ids)
        for node in (n for block in made for n in block.walk()):
            if "record" in node.attrs:
                node.attrs["record"] = f"{name}:{node.attrs['record']}"
        out += made
    return out


def id_mapping_counts(records: DataFrame) -> DataFrame:
    """Rule I1 on document information: resources declared by ID_MAPPINGS against records of their tags.

    Returns doc_id, tag, declared, actual for the kinds that differ. Fixed values: the order of the counts.
    """
    kinds = [(0, 0x12), (8, 0x14), (9, 0x15), (10, 0x16), (11, 0x17), (12, 0x18), (13, 0x19), (14, 0x1A)]
    declared = records.where("tag = 17").select("doc_id", F.explode(F.array(*[F.struct(F.lit(tag).alias("tag"), _u32(F.col("payload"), 4 * at).alias("declared")) for at, tag in kinds])).alias("k"))
    declared = declared.select("doc_id", "k.tag", "k.declared").where("declared is not null")
    actual = records.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("actual"))
    both = declared.join(actual, ["doc_id", "tag"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.where("declared <> actual")


def record_order(records: DataFrame) -> DataFrame:
    """Rule I11: records of document information whose tag is smaller than the one before, at the top level."""
    from pyspark.sql.window import Window

    top = records.where("level = 0 and tag between 16 and 26")
    before = F.lag("tag").over(Window.partitionBy("doc_id").orderBy("seq"))
    return top.withColumn("before", before).where("tag < before").select("doc_id", "seq", "tag", "before")


def character_shape_bounds(records: DataFrame) -> DataFrame:
    """Rule R4: character shapes that begin behind the end of their paragraph's text."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = records.withColumn("para", F.sum((F.col("tag") == PARA_HEADER).cast("int")).over(order))
    text = numbered.where(F.col("tag") == PARA_TEXT).groupBy("doc_id", "para").agg(F.max(F.floor(F.col("size") / 2)).alias("signs"))
    pairs = F.sequence(F.lit(0), F.floor(F.col("size") / 8).cast("int") - 1)
    shapes = numbered.where((F.col("tag") == PARA_CHAR_SHAPE) & (F.col("size") >= 8)).select("doc_id", "para", "payload", F.explode(pairs).alias("k"))
    at = shapes.select("doc_id", "para", _u32(F.col("payload"), F.col("k") * 8).alias("position"))
    return at.join(text, ["doc_id", "para"]).where("position >= signs").select("doc_id", "para", "position", "signs")
