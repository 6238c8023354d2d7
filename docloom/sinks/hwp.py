"""HWP 5 files from blocks, and new texts for the paragraphs of a file that is there."""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

from ..model import Node
from ..sources.hwp import CHAR_SHAPE, CTRL_HEADER, EQUATION, FACE_NAME, LIST_HEADER, PARA_CHAR_SHAPE, PARA_HEADER, PARA_LINE_SEG, PARA_TEXT, STYLE, TABLE, Record, inflated, iter_records, make_record, record_trees
from ..sources.ole import CompoundFile, write_compound

# Fixed values of the format: tags, control signs, record layouts and the version 5.0.3.0.
DOCUMENT_PROPERTIES, ID_MAPPINGS, BORDER_FILL, TAB_DEF, PARA_SHAPE, PAGE_DEF = 0x10, 0x11, 0x14, 0x16, 0x19, 0x49
SIGNATURE, VERSION, COMPRESSED = b"HWP Document File", 0x05000300, 1
SECTION_SIGN, OBJECT_SIGN, HEAD_SIGN, NOTE_SIGN = 2, 11, 16, 17
_CONTROLS = {"footnote": ("fn  ", NOTE_SIGN), "endnote": ("en  ", NOTE_SIGN), "header": ("head", HEAD_SIGN), "footer": ("foot", HEAD_SIGN), "text_box": ("gso ", OBJECT_SIGN)}
#: Width, height and margins of a page in hundredths of a point: A4.
PAGE = (59528, 84188, 8504, 8504, 5668, 4252, 4252, 4252, 0, 0)
LAST = 1 << 31


def _word(text: str) -> bytes:
    said = text.encode("utf-16-le", "replace")
    return struct.pack("<H", len(said) // 2) + said


def _control_sign(sign: int, name: str) -> bytes:
    return struct.pack("<H", sign) + name[::-1].encode() + bytes(8) + struct.pack("<H", sign)


class _Styles:
    """Fonts and character shapes, numbered as they are met."""

    def __init__(self) -> None:
        self.fonts: dict[str, int] = {"Batang": 0}
        self.shapes: dict[tuple, int] = {}
        self.of({})

    def of(self, i: dict) -> int:
        bits = bool(i.get("italic")) | bool(i.get("bold")) << 1 | bool(i.get("underline")) << 2 | bool(i.get("superscript")) << 15 | bool(i.get("subscript")) << 16 | bool(i.get("strike")) << 18
        face = self.fonts.setdefault(i.get("font") or "Batang", len(self.fonts))
        color = str(i.get("color") or "").removeprefix("#")
        rgb = bytes.fromhex(color[:6]) if len(color) >= 6 and all(c in "0123456789abcdefABCDEF" for c in color[:6]) else bytes(3)
        return self.shapes.setdefault((face, round((i.get("size") or 10.0) * 100), bits, rgb), len(self.shapes))

    def info(self) -> bytes:
        """The stream of document information."""
        names = [("바탕글", "Normal"), *[(f"개요 {k}", f"Outline {k}") for k in range(1, 7)]]
        counts = [0, *[len(self.fonts)] * 7, 1, len(self.shapes), 1, 0, 0, 1, len(names), 0, 0, 0]
        out = [make_record(DOCUMENT_PROPERTIES, 0, struct.pack("<7H3I", 1, 1, 1, 1, 1, 1, 1, 0, 0, 0)), make_record(ID_MAPPINGS, 0, struct.pack("<18I", *counts))]
        out += [make_record(FACE_NAME, 1, b"\0" + _word(name)) for _ in range(7) for name in self.fonts]
        out.append(make_record(BORDER_FILL, 1, bytes(40)))
        for face, size, bits, rgb in self.shapes:
            body = struct.pack("<7H", *[face] * 7) + bytes([100] * 7 + [0] * 7 + [100] * 7 + [0] * 7)
            body += struct.pack("<iI", size, bits) + bytes(2) + rgb + b"\0" + bytes(4) + b"\xff\xff\xff\xff" + bytes(4) + struct.pack("<HI", 0, 0)
            out.append(make_record(CHAR_SHAPE, 1, body))
        out.append(make_record(TAB_DEF, 1, bytes(8)))
        out.append(make_record(PARA_SHAPE, 1, bytes(28) + bytes(6) + bytes(8) + struct.pack("<III", 0, 0, 160)))
        out += [make_record(STYLE, 1, _word(name) + _word(english) + struct.pack("<BBhHHH", 0, k, 1042, 0, 0, 0)) for k, (name, english) in enumerate(names)]
        return b"".join(out)


class _Body:
    """Paragraphs with what hangs on them."""

    def __init__(self, styles: _Styles):
        self._styles, self._made = styles, 0

    def paragraph(self, inlines: list[dict] | None, level: int, style: int = 0, controls: list[tuple[int, str, list[Record]]] | None = None, last: bool = False) -> Record:
        """A paragraph: its controls (sign, name, records) come first, then its text."""
        text, marks, mask = b"", [], 0
        for sign, name, _ in controls or []:
            text += _control_sign(sign, name)
            mask |= 1 << sign
        for i in inlines or []:
            said = i["latex"] if i["type"] == "equation" else f"[{i['ref']}]" if i["type"].endswith("_ref") else i["text"]
            plain = "".join(c for c in (said or "").replace("\t", " ").replace("\r", "") if c == "\n" or c >= " ")
            if plain:
                shape = self._styles.of(i)
                if not marks or marks[-1][1] != shape:
                    marks.append((len(text) // 2 if marks else 0, shape))
                text += plain.encode("utf-16-le", "replace")
        marks = marks or [(0, 0)]
        text += struct.pack("<H", 13)
        self._made += 1
        head = struct.pack("<IIHBBHHHIH", len(text) // 2 | (LAST if last else 0), mask, 0, style, 0, len(marks), 0, 1, self._made, 0)
        parts = [Record(PARA_TEXT, text, level + 1), Record(PARA_CHAR_SHAPE, b"".join(struct.pack("<II", *m) for m in marks), level + 1)]
        parts.append(Record(PARA_LINE_SEG, struct.pack("<9i", 0, 0, 1000, 1000, 850, 600, 0, PAGE[0] - PAGE[2] - PAGE[3], 0x60000), level + 1))
        return Record(PARA_HEADER, head, level, parts + [r for _, _, records in controls or [] for r in records])

    def listed(self, blocks: list[Node], level: int) -> list[Record]:
        """The paragraphs of a list of blocks; the last one is marked."""
        out = [p for b in blocks for p in self.block(b, level)] or [self.paragraph(None, level)]
        (count,) = struct.unpack_from("<I", out[-1].payload)
        out[-1].payload = struct.pack("<I", count | LAST) + out[-1].payload[4:]
        return out

    def block(self, b: Node, level: int) -> list[Record]:
        kind = b.type
        text = lambda said: [{"type": "text", "text": said}]
        if kind == "heading":
            return [self.paragraph(b.inlines or text(b.text), level, min(6, max(1, b.level or 1)))]
        if kind == "paragraph":
            return [self.paragraph(b.inlines, level)]
        if kind == "list":
            number = b.start if b.start is not None else 1
            marked = [(f"{number + k}. " if b.ordered else "• ", item) for k, item in enumerate(b.children)]
            marked = [m for mark, item in marked for m in [(mark, item), *[("  • ", c) for c in item.children]]]
            return [self.paragraph([*text(mark), *(item.inlines or [])], level) for mark, item in marked]
        if kind == "table":
            return [self.paragraph(None, level, controls=[(OBJECT_SIGN, "tbl ", [self._table(b, level + 1)])])] if b.children else []
        if kind == "equation":
            script = b.attrs.get("hwp_script") or b.text or ""
            control = Record(CTRL_HEADER, _object("eqed"), level + 1, [Record(EQUATION, struct.pack("<I", 0) + _word(script) + struct.pack("<II", 1000, 0), level + 2)])
            return [self.paragraph(None, level, controls=[(OBJECT_SIGN, "eqed", [control])])]
        if kind in _CONTROLS:
            name, sign = _CONTROLS[kind]
            inner = self.listed(b.children, level + 2)
            held = Record(LIST_HEADER, struct.pack("<II", len(inner), 0) + bytes(8), level + 2)
            return [self.paragraph(None, level, controls=[(sign, name, [Record(CTRL_HEADER, _object(name), level + 1, [held, *inner])])])]
        if kind in ("quote", "drawing", "comment"):
            return [p for c in b.children for p in self.block(c, level)]
        if kind == "code":
            return [self.paragraph([{"type": "text", "text": line, "font": "Courier New"}], level) for line in (b.text or "").split("\n")]
        if kind == "image":
            return [self.paragraph(text(f"[{b.attrs.get('alt') or b.attrs.get('src') or 'image'}]"), level)]
        return [self.paragraph(text(b.text), level)] if b.text else []

    def _table(self, b: Node, level: int) -> Record:
        taken: set[tuple[int, int]] = set()
        cells, columns = [], 0
        for y, row in enumerate(b.children):
            x = 0
            for cell in row.children:
                while (y, x) in taken:
                    x += 1
                high, wide = max(1, cell.row_span or 1), max(1, cell.col_span or 1)
                taken |= {(y + i, x + j) for i in range(high) for j in range(wide)}
                cells.append((y, x, high, wide, cell))
                x += wide
                columns = max(columns, x)
        rows, width = len(b.children), PAGE[0] - PAGE[2] - PAGE[3]
        counts = [sum(1 for c in cells if c[0] == y) for y in range(rows)]
        table = struct.pack("<IHHH4H", 0, rows, columns, 0, 510, 510, 141, 141) + struct.pack(f"<{rows}H", *counts) + struct.pack("<HH", 1, 0)
        made = [Record(TABLE, table, level + 1)]
        for y, x, high, wide, cell in cells:
            inner = self.listed(cell.children, level + 1)
            place = struct.pack("<IIHHHHII4HH", len(inner), 0x20, x, y, wide, high, width * wide // max(1, columns), 1000 * high, 510, 510, 141, 141, 1)
            made += [Record(LIST_HEADER, place + bytes(13), level + 1), *inner]
        return Record(CTRL_HEADER, _object("tbl "), level, made)


def _object(name: str) -> bytes:
    return name[::-1].encode() + struct.pack("<IiiiiiHHHHIiH", 0x082A2311, 0, 0, 1000, 1000, 0, 0, 0, 0, 0, 0, 0, 0)


def to_hwp(blocks: list[Node]) -> bytes:
    """A whole HWP 5 file: a section with its page, then a paragraph for each block, nested ones in their controls.

    Pictures leave their description, checked items and nested lists their marks; a file without
    blocks has its first paragraph only.
    """
    styles = _Styles()
    body = _Body(styles)
    page = Record(PAGE_DEF, struct.pack("<10I", *PAGE), 2)
    section = Record(CTRL_HEADER, b"dces" + struct.pack("<IHHHIHHHHHH", 0, 1134, 0, 0, 8000, 0, 0, 0, 0, 0, 0), 1, [page])
    columns = Record(CTRL_HEADER, b"dloc" + struct.pack("<HHHBBI", 0x1004, 0, 0, 0, 0, 0), 1)
    first = body.paragraph(None, 0, controls=[(SECTION_SIGN, "secd", [section]), (SECTION_SIGN, "cold", [columns])])
    records = [first, *[p for b in blocks for p in body.block(b, 0)]]
    (count,) = struct.unpack_from("<I", records[-1].payload)
    records[-1].payload = struct.pack("<I", count | LAST) + records[-1].payload[4:]
    said = "\n".join("".join(i["text"] or "" for i in n.inlines or []) or n.text or "" for b in blocks for n in b.walk())[:1000]
    return write_compound(
        {
            "FileHeader": SIGNATURE.ljust(32, b"\0") + struct.pack("<II", VERSION, COMPRESSED) + bytes(216),
            "DocInfo": deflated(styles.info()),
            "BodyText/Section0": deflated(b"".join(r.to_bytes() for r in records)),
            "PrvText": said.encode("utf-16-le", "replace"),
        }
    )


def deflated(stream: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(stream) + packer.flush()


def with_text(paragraph: Record, text: str) -> Record:
    """A paragraph record with another text in the shape of its first sign; its controls stay, before the text."""
    old = paragraph.first(PARA_TEXT) or b""
    kept = b""
    for at in range(0, len(old) - 15, 2):
        (sign,) = struct.unpack_from("<H", old, at)
        if sign in (1, 2, 3, 11, 12, 14, 15, 16, 17, 18, 21, 22, 23) and old[at + 14 : at + 16] == old[at : at + 2]:
            kept += old[at : at + 16]
    new = kept + "".join(c for c in text if c in "\n" or c >= " ").encode("utf-16-le", "replace") + struct.pack("<H", 13)
    shape = (paragraph.first(PARA_CHAR_SHAPE) or bytes(8))[4:8].ljust(4, b"\0")
    line = (paragraph.first(PARA_LINE_SEG) or bytes(36))[:36].ljust(36, b"\0")
    (count,) = struct.unpack_from("<I", paragraph.payload)
    head = bytearray(struct.pack("<I", len(new) // 2 | count & LAST) + paragraph.payload[4:])
    struct.pack_into("<HHH", head, 12, 1, 0, 1)
    parts = [Record(PARA_TEXT, new, paragraph.level + 1), Record(PARA_CHAR_SHAPE, bytes(4) + shape, paragraph.level + 1), Record(PARA_LINE_SEG, bytes(4) + line[4:], paragraph.level + 1)]
    rest = [c for c in paragraph.children if c.tag not in (PARA_TEXT, PARA_CHAR_SHAPE, PARA_LINE_SEG)]
    return Record(PARA_HEADER, bytes(head), paragraph.level, parts + rest)


def patch_hwp(content: bytes, texts: dict[str, str]) -> bytes:
    """The file with new texts for its paragraphs; ``texts`` is by the ``record`` that parsing notes in attrs.

    All other streams and records stay as they are.
    """
    file = CompoundFile(content)
    streams = {name: file.read(name) for name in file.streams}
    compressed = bool(struct.unpack_from("<I", streams["FileHeader"], 36)[0] & COMPRESSED)
    wanted: dict[str, dict[int, str]] = defaultdict(dict)
    for place, text in texts.items():
        name, number = place.rsplit(":", 1)
        wanted[name][int(number)] = text
    for name, new in wanted.items():
        trees = record_trees(inflated(streams[name], compressed))
        number = 0

        def rebuilt(record: Record) -> Record:
            nonlocal number
            here, number = number, number + 1
            record.children = [rebuilt(c) for c in record.children]
            return with_text(record, new[here]) if here in new and record.tag == PARA_HEADER else record

        made = b"".join(rebuilt(t).to_bytes() for t in trees)
        streams[name] = deflated(made) if compressed else made
    return write_compound(streams)


def patch_hwp_blocks(content: bytes, edited: list[Node]) -> bytes:
    """The file with the texts of edited paragraphs and headings, found by block id in what parsing gives."""
    from ..sources.hwp import parse_hwp

    known = {n.node_id: n for b in parse_hwp(content) for n in b.walk() if "record" in n.attrs}
    said = lambda n: n.text if n.type == "heading" and not n.inlines else "".join(i["text"] or "" for i in n.inlines or [])
    new = {n.node_id: said(n) for b in edited for n in b.walk() if n.type in ("paragraph", "heading")}
    return patch_hwp(content, {known[k].attrs["record"]: text or "" for k, text in new.items() if k in known and (text or "").strip() != (said(known[k]) or "").strip()})


def section_records(content: bytes, name: str = "BodyText/Section0") -> list[tuple[int, int, bytes]]:
    """The records of a stream of a file."""
    file = CompoundFile(content)
    flags = struct.unpack_from("<I", file.read("FileHeader"), 36)[0]
    return list(iter_records(inflated(file.read(name), bool(flags & COMPRESSED))))
