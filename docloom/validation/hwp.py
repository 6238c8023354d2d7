"""Rules on whole HWP 5 files (R1-R7, I1-I12), and repairs of their sections."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..sources.hwp import CHAR_SHAPE, CTRL_HEADER, LIST_HEADER, LONG_CONTROLS, PARA_CHAR_SHAPE, PARA_HEADER, PARA_LINE_SEG, PARA_TEXT, TABLE, Record, control_id, inflated, record_trees
from ..sources.ole import CompoundFile

# Fixed values of the format.
SIGNATURE, ZLIB_HEADS = b"HWP Document File", (b"\x78\x01", b"\x78\x9c", b"\x78\xda")
PROPERTIES, MAPPINGS, BIN_DATA, BORDER_FILL, PARA_SHAPE, SHAPE = 0x10, 0x11, 0x12, 0x14, 0x19, 0x4C
COUNTED = ((0, 0x12), (8, 0x14), (9, 0x15), (10, 0x16), (11, 0x17), (12, 0x18), (13, 0x19), (14, 0x1A))
INFO_ORDER = (0x10, 0x11, 0x12, 0x13, 0x14, 0x15, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x1B, 0x1E, 0x1F)

Found = Iterator[tuple[str, str, str]]


def _u16(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2], "little")


def _u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def _all(trees: list[Record], tag: int | None = None) -> Iterator[Record]:
    return (r for t in trees for r in t.walk() if tag is None or r.tag == tag)


def _signs(text: bytes) -> set[int]:
    """The control signs of a paragraph's text that stand for something."""
    found, at = set(), 0
    while at + 2 <= len(text):
        sign = _u16(text, at)
        long = sign in LONG_CONTROLS or sign == 9
        found |= {sign} if sign in LONG_CONTROLS else set()
        at += 16 if long else 2
    return found


def paragraph_rules(trees: list[Record]) -> Found:
    """R1 signs, R2 shapes and lines, R3 a line for a text, R4 and I12 places within the text."""
    for n, para in enumerate(_all(trees, PARA_HEADER)):
        head, text = para.payload, para.first(PARA_TEXT)
        shapes, lines = para.first(PARA_CHAR_SHAPE) or b"", para.first(PARA_LINE_SEG) or b""
        count = _u32(head, 0) & 0x3FFFFFFF
        if text and count != len(text) // 2:
            yield "R1", "error", f"paragraph {n} declares {count} signs and has {len(text) // 2}"
        if len(head) >= 18 and (_u16(head, 12), _u16(head, 16)) != (len(shapes) // 8, len(lines) // 36):
            yield "R2", "error", f"paragraph {n} declares {_u16(head, 12)} shapes and {_u16(head, 16)} lines and has {len(shapes) // 8} and {len(lines) // 36}"
        if text and len(lines) < 36:
            yield "R3", "error", f"paragraph {n} has a text without a line"
        late = [p for p in (_u32(shapes, at) for at in range(0, len(shapes) - 7, 8)) if text and p >= len(text) // 2]
        if late:
            yield "R4", "error", f"paragraph {n} has a shape at {late[0]}, behind its text"
        late = [p for p in (_u32(lines, at) for at in range(0, len(lines) - 35, 36)) if count and p > count]
        if late:
            yield "I12", "error", f"paragraph {n} has a line at {late[0]}, behind its text"


def information_rules(info: list[Record]) -> Found:
    """I1 counts of resources, I2 fonts of shapes, I11 order of records."""
    records = list(_all(info))
    mapping = next((r.payload for r in records if r.tag == MAPPINGS), b"")
    for place, tag in COUNTED:
        actual = sum(r.tag == tag for r in records)
        if len(mapping) >= 4 * place + 4 and _u32(mapping, 4 * place) != actual:
            yield "I1", "error", f"{_u32(mapping, 4 * place)} records of tag {tag} are declared and {actual} are there"
    if len(mapping) >= 32:
        fonts = struct.unpack_from("<7I", mapping, 4)
        for n, record in enumerate(r for r in records if r.tag == CHAR_SHAPE and len(r.payload) >= 14):
            if any(face >= known for face, known in zip(struct.unpack_from("<7H", record.payload), fonts, strict=True)):
                yield "I2", "error", f"shape {n} asks for a font that is not there"
    places = [INFO_ORDER.index(r.tag) for r in info if r.tag in INFO_ORDER]
    if places != sorted(places):
        yield "I11", "error", "records of the document information are out of order"


def reference_rules(info: list[Record], body: list[Record]) -> Found:
    """I3 references of paragraphs and lists, I8 borders of cells, I9 cells of tables."""
    count = {tag: sum(1 for _ in _all(info, tag)) for tag in (CHAR_SHAPE, PARA_SHAPE, BORDER_FILL)}
    for n, para in enumerate(_all(body, PARA_HEADER)):
        if len(para.payload) >= 22 and _u16(para.payload, 8) >= count[PARA_SHAPE]:
            yield "I3", "error", f"paragraph {n} asks for a paragraph shape that is not there"
        shapes = para.first(PARA_CHAR_SHAPE) or b""
        if any(_u32(shapes, at + 4) >= count[CHAR_SHAPE] for at in range(0, len(shapes) - 7, 8)):
            yield "I3", "error", f"paragraph {n} asks for a character shape that is not there"
    for control in _all(body, CTRL_HEADER):
        if control_id(control.payload) != "tbl ":
            continue
        cells = [c for c in control.children if c.tag == LIST_HEADER]
        for cell in cells:
            if len(cell.payload) >= 34 and _u16(cell.payload, 32) > count[BORDER_FILL]:
                yield "I8", "error", f"a cell asks for border {_u16(cell.payload, 32)} of {count[BORDER_FILL]}"
        table = control.first(TABLE)
        if table is not None and len(table) >= 8:
            most = _u16(table, 4) * _u16(table, 6)
            if (most and not cells) or len(cells) > most:
                yield "I9", "error", f"a table of {_u16(table, 4)} by {_u16(table, 6)} has {len(cells)} cells"


def container_rules(body: list[Record]) -> Found:
    """I4 members of grouped shapes, I6 the control mask of the first paragraph."""
    for shape in _all(body, SHAPE):
        if control_id(shape.payload) != "$con":
            continue
        at = 46 if shape.level > 2 else 50
        at += 2 + 48 * (1 + 2 * _u16(shape.payload, at))
        if at + 2 <= len(shape.payload):
            members = sum(c.tag == SHAPE for c in shape.children)
            if _u16(shape.payload, at) != members:
                yield "I4", "error", f"a group declares {_u16(shape.payload, at)} members and has {members}"
    first = next((r for r in body if r.tag == PARA_HEADER), None)
    if first is not None and any(control_id(c.payload) == "secd" for c in first.children if c.tag == CTRL_HEADER):
        signs, mask = _signs(first.first(PARA_TEXT) or b""), _u32(first.payload, 4)
        if any(not mask >> s & 1 for s in signs):
            yield "I6", "error", f"the mask {mask:#x} of the first paragraph lacks some of its controls"


def file_rules(content: bytes) -> Found:
    """All rules on a file: R5 head, R6 streams, R7 compression, I5 root, I7 sections, I10 embedded files, then those on records."""
    try:
        file = CompoundFile(content)
    except (ValueError, struct.error, IndexError):
        yield "R5", "error", "not a compound file"
        return
    names = set(file.streams)
    if "FileHeader" not in names:
        yield "R5", "error", "there is no FileHeader"
        return
    head = file.read("FileHeader")
    if len(head) < 256:
        yield "R5", "error", f"FileHeader has {len(head)} bytes of 256"
    if not head.startswith(SIGNATURE):
        yield "R5", "error", "the signature differs"
    if len(head) >= 36 and head[35] < 5:
        yield "R5", "warning", f"version {head[35]} is not supported"
    missing = [n for n in ("DocInfo", "BodyText/Section0") if n not in names]
    for name in missing:
        yield "R6", "error", f"{name} is missing"
    if missing:
        return
    compressed = bool(_u32(head, 36) & 1)
    if compressed and file.read("DocInfo")[:2] in ZLIB_HEADS:
        yield "R7", "error", "streams have zlib heads, raw deflate is needed"
        return
    if file.root_size % file.sector_size:
        yield "I5", "warning", f"the root entry has {file.root_size} bytes, no multiple of a sector"
    try:
        info = record_trees(inflated(file.read("DocInfo"), compressed))
        sections = [n for n in sorted(names) if n.startswith("BodyText/Section")]
        bodies = [record_trees(inflated(file.read(n), compressed)) for n in sections]
    except zlib.error:
        yield "R7", "error", "a stream cannot be inflated"
        return
    properties = next((r.payload for r in _all(info, PROPERTIES)), None)
    if properties is None or _u16(properties, 0) != len(sections):
        yield "I7", "error", f"{len(sections)} sections are there, not as many as declared"
    for n, record in enumerate(_all(info, BIN_DATA), 1):
        if _u16(record.payload, 0) & 15 in (0, 2) and not any(s.upper().startswith(f"BINDATA/BIN{n:04X}") for s in names):
            yield "I10", "warning", f"embedded file {n} is missing"
    yield from information_rules(info)
    for body in bodies:
        yield from paragraph_rules(body)
        yield from reference_rules(info, body)
        yield from container_rules(body)


def validate_hwp_files(files: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, rule_id, severity and message of all violations of files (doc_id, content); null contents break R5."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(d, *found) for d, c in zip(pdf["doc_id"], pdf["content"], strict=True) for found in file_rules(bytes(c) if c is not None else b"")]
            yield pd.DataFrame(rows, columns=["doc_id", "rule_id", "severity", "message"])

    return files.select("doc_id", files[content].alias("content")).mapInPandas(run, "doc_id long, rule_id string, severity string, message string")


def repaired_section(stream: bytes) -> bytes:
    """A section whose paragraphs keep R1-R4, I6 and I12: counts, masks and places follow from what is there."""
    trees = record_trees(stream)
    for para in _all(trees, PARA_HEADER):
        text = para.first(PARA_TEXT) or b""
        signs = len(text) // 2
        for child in para.children:
            if child.tag == PARA_CHAR_SHAPE and text:
                pairs = [struct.unpack_from("<II", child.payload, at) for at in range(0, len(child.payload) - 7, 8)]
                kept = [p for p in pairs if p[0] < signs] or [(0, pairs[0][1] if pairs else 0)]
                child.payload = b"".join(struct.pack("<II", *p) for p in kept)
            if child.tag == PARA_LINE_SEG:
                lines = [child.payload[at : at + 36] for at in range(0, len(child.payload) - 35, 36)]
                child.payload = b"".join(x for x in lines if _u32(x, 0) <= signs) or (bytes(4) + lines[0][4:] if lines else b"")
        if text and len(para.first(PARA_LINE_SEG) or b"") < 36:
            para.children = [c for c in para.children if c.tag != PARA_LINE_SEG]
            after = max((k for k, c in enumerate(para.children) if c.tag in (PARA_TEXT, PARA_CHAR_SHAPE)), default=-1)
            para.children.insert(after + 1, Record(PARA_LINE_SEG, struct.pack("<9i", 0, 0, 1000, 1000, 850, 600, 0, 42520, 0x60000), para.level + 1))
        head = bytearray(para.payload)
        if len(head) >= 18:
            mask = sum(1 << s for s in _signs(text))
            struct.pack_into("<II", head, 0, (signs or 1) | _u32(head, 0) & (3 << 30), mask | _u32(head, 4) if text else _u32(head, 4))
            struct.pack_into("<HHH", head, 12, len(para.first(PARA_CHAR_SHAPE) or b"") // 8, _u16(head, 14), len(para.first(PARA_LINE_SEG) or b"") // 36)
        para.payload = bytes(head)
    return b"".join(t.to_bytes() for t in trees)


def validate_and_fix(content: bytes, rounds: int = 5) -> tuple[bytes, list[tuple[str, str, str]]]:
    """The file after repairs of its sections, and what rules it still breaks."""
    from ..sinks.hwp import deflated
    from ..sources.ole import write_compound

    found = list(file_rules(content))
    while rounds and any(rule in ("R1", "R2", "R3", "R4", "I6", "I12") for rule, _, _ in found):
        file = CompoundFile(content)
        streams = {name: file.read(name) for name in file.streams}
        compressed = bool(_u32(streams["FileHeader"], 36) & 1)
        for name in streams:
            if name.startswith("BodyText/Section"):
                fixed = repaired_section(inflated(streams[name], compressed))
                streams[name] = deflated(fixed) if compressed else fixed
        content, rounds = write_compound(streams), rounds - 1
        found = list(file_rules(content))
    return content, found
