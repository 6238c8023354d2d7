"""What a PDF page shows besides text: ruled grids, pictures, drawings, notes under a rule, links.

Paths are followed by the painting operators of the page's content. Two points make a line,
``re`` a rectangle, anything else a curve; paths that are not painted do not count.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field

# Fixed values, in points or as shares of the page: lines this near are one; gaps between the lines of one table are at
# most this many median gaps, or this many points; least curves and area of a drawing, least side of a picture;
# where footnotes stand, how far above that their rule may be, its least width and most height; share of a page frame.
NEAR = 3.0
GAP_FACTOR, LEAST_GAP = 4, 40.0
LEAST_CURVES, LEAST_AREA = 8, 2500.0
LEAST_SIDE = 5.0
NOTE_SHARE, RULE_ABOVE, RULE_WIDTH, RULE_HEIGHT = 0.15, 0.05, 0.2, 3.0
FRAME_SHARE, FRAME_LINES = 0.9, 4
NOTE = re.compile(r"\s*(\d+)\s*[.)\s]\s*")

Box = tuple[float, float, float, float]


@dataclass
class Marks:
    lines: list[Box] = field(default_factory=list)
    rects: list[Box] = field(default_factory=list)
    curves: list[Box] = field(default_factory=list)
    images: list[tuple[Box, int]] = field(default_factory=list)


@dataclass
class Grid:
    """A ruled table: its columns' edges from the left, its rows' edges from the bottom."""

    xs: list[float]
    ys: list[float]

    @property
    def box(self) -> Box:
        return self.xs[0], self.ys[0], self.xs[-1], self.ys[-1]

    def cell(self, x: float, y: float) -> tuple[int, int] | None:
        """Row from the top and column of a point; None outside."""
        column, row = bisect_right(self.xs, x) - 1, bisect_right(self.ys, y) - 1
        if 0 <= column < len(self.xs) - 1 and 0 <= row < len(self.ys) - 1:
            return len(self.ys) - 2 - row, column
        return None


def overlap(a: Box, b: Box) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def media_box(pdf, page: bytes) -> Box:
    """The page's box, its tree's if it has none, US letter if neither has."""
    for body in (page, *(b for b in pdf.objects.values() if re.search(rb"/Type\s*/Pages\b", b))):
        found = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", body)
        if found:
            x0, y0, x1, y1 = map(float, found.groups())
            return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)
    return 0.0, 0.0, 612.0, 792.0


def page_marks(pdf, page: bytes) -> Marks:
    from .pdf import _TOKEN, _times

    marks, pictures = Marks(), _pictures(pdf, page)
    identity = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    ctm, saved, args = identity, [], []
    paths: list[tuple[str, list[tuple[float, float]]]] = []

    def at(x: float, y: float) -> tuple[float, float]:
        return x * ctm[0] + y * ctm[2] + ctm[4], x * ctm[1] + y * ctm[3] + ctm[5]

    def box(points) -> Box:
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        return min(xs), min(ys), max(xs), max(ys)

    for token in _TOKEN.findall(pdf.content(page)):
        if not (token[:1].isalpha() or token in (b"'", b'"')):
            args.append(token)
            continue
        try:
            if token == b"q":
                saved.append(ctm)
            elif token == b"Q" and saved:
                ctm = saved.pop()
            elif token == b"cm":
                ctm = _times([float(a) for a in args[-6:]], ctm)
            elif token == b"m":
                paths.append(("line", [at(float(args[-2]), float(args[-1]))]))
            elif token == b"l" and paths:
                paths[-1][1].append(at(float(args[-2]), float(args[-1])))
            elif token in (b"c", b"v", b"y") and paths:
                numbers = [float(a) for a in args[-(6 if token == b"c" else 4) :]]
                paths[-1] = ("curve", paths[-1][1] + [at(x, y) for x, y in zip(numbers[::2], numbers[1::2], strict=True)])
            elif token == b"re":
                x, y, w, h = (float(a) for a in args[-4:])
                paths.append(("rect", [at(x, y), at(x + w, y), at(x, y + h), at(x + w, y + h)]))
            elif token in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
                for kind, points in paths:
                    held = marks.rects if kind == "rect" else marks.lines if kind == "line" and len(points) == 2 else marks.curves
                    if len(points) > 1:
                        held.append(box(points))
                paths = []
            elif token == b"n":
                paths = []
            elif token == b"Do" and args and args[-1] in pictures:
                place = box([at(0, 0), at(1, 0), at(0, 1), at(1, 1)])
                if min(place[2] - place[0], place[3] - place[1]) >= LEAST_SIDE and all(n != pictures[args[-1]] for _, n in marks.images):
                    marks.images.append((place, pictures[args[-1]]))
        except (ValueError, IndexError):
            pass  # a broken operator is skipped
        args = []
    return marks


def _snapped(values) -> list[float]:
    """Positions in order, those within :data:`NEAR` of the last kept one left out."""
    out: list[float] = []
    for value in sorted(values):
        if not out or value - out[-1] >= NEAR:
            out.append(value)
    return out


def _parts(ys: list[float]) -> list[list[float]]:
    """Heights of horizontal lines, parted where a gap is too wide for one table."""
    gaps = [b - a for a, b in zip(ys, ys[1:], strict=False)]
    if not gaps:
        return []
    widest = max(sorted(gaps)[len(gaps) // 2] * GAP_FACTOR, LEAST_GAP)
    cuts = [0, *(i + 1 for i, gap in enumerate(gaps) if gap > widest), len(ys)]
    return [ys[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]


def grids(marks: Marks, page: Box) -> list[Grid]:
    """The ruled tables of a page; a frame round the whole page is none."""
    flat = [y for _, y0, _, y1 in marks.lines if y1 - y0 < NEAR for y in (y0,)] + [y for r in marks.rects for y in (r[1], r[3])]
    upright = [(x0, y0, y1) for x0, y0, x1, y1 in marks.lines if x1 - x0 < NEAR <= y1 - y0] + [(x, r[1], r[3]) for r in marks.rects for x in (r[0], r[2])]
    out = []
    for ys in _parts(_snapped(flat)):
        xs = _snapped(x for x, low, high in upright if high >= ys[0] - NEAR and low <= ys[-1] + NEAR)
        if len(xs) < 2:
            continue
        wide = xs[-1] - xs[0] > FRAME_SHARE * (page[2] - page[0]) and ys[-1] - ys[0] > FRAME_SHARE * (page[3] - page[1])
        if not (wide and len(xs) < FRAME_LINES and len(ys) < FRAME_LINES):
            out.append(Grid(xs, ys))
    return out


def drawing(marks: Marks, tables: list[Grid]) -> Box | None:
    """The box of a page's curves, if they are many, cover some area and stand apart from its tables."""
    if len(marks.curves) < LEAST_CURVES:
        return None
    found = min(c[0] for c in marks.curves), min(c[1] for c in marks.curves), max(c[2] for c in marks.curves), max(c[3] for c in marks.curves)
    large = (found[2] - found[0]) * (found[3] - found[1]) >= LEAST_AREA
    return found if large and not any(overlap(found, t.box) for t in tables) else None


def notes_below(marks: Marks, page: Box) -> float | None:
    """The height under which numbered lines are footnotes; None without a rule that parts them from the text."""
    width, height = page[2] - page[0], page[3] - page[1]
    limit = page[1] + NOTE_SHARE * height
    for x0, y0, x1, y1 in marks.lines + marks.rects:
        if y1 - y0 < RULE_HEIGHT and x1 - x0 > RULE_WIDTH * width and page[1] < y0 < limit + RULE_ABOVE * height:
            return limit
    return None


def links(pdf, page: bytes) -> list[tuple[Box, str]]:
    """Boxes and addresses of a page's links, in their order."""
    from .pdf import _string

    listed = re.search(rb"/Annots\s*\[(.*?)\]", page, re.S)
    body = listed[1] if listed else pdf.objects.get(pdf.ref(page, "Annots") or -1, b"")
    out = []
    for number in re.findall(rb"(\d+)\s+\d+\s+R", body):
        note = pdf.objects.get(int(number), b"")
        if not re.search(rb"/Subtype\s*/Link\b", note):
            continue
        action = pdf.objects.get(pdf.ref(note, "A") or -1, note)
        uri = re.search(rb"/URI\s*(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)", action, re.S)
        rect = re.search(rb"/Rect\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", note)
        if uri and rect:
            x0, y0, x1, y1 = map(float, rect.groups())
            out.append(((min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)), _string(uri[1]).decode("latin-1")))
    return out


def _pictures(pdf, page: bytes) -> dict[bytes, int]:
    """Objects of the pictures that a page may paint, by name."""
    resources = pdf.objects.get(pdf.ref(page, "Resources") or -1, page)
    table = re.search(rb"/XObject\s*<<(.*?)>>", resources, re.S)
    body = table[1] if table else pdf.objects.get(pdf.ref(resources, "XObject") or -1, b"")
    found = {name: int(number) for name, number in re.findall(rb"(/[^\s/]+)\s+(\d+)\s+\d+\s+R", body)}
    return {name: n for name, n in found.items() if re.search(rb"/Subtype\s*/Image\b", pdf.objects.get(n, b""))}


def picture(pdf, number: int) -> str | None:
    """A picture as a data address: JPEG files as they are, plain grey and RGB samples as PNG; others give None."""
    head, data = pdf.objects[number], pdf.streams.get(number, b"")
    for name, mime in ((b"DCTDecode", "image/jpeg"), (b"JPXDecode", "image/jp2")):
        if name in head:
            return f"data:{mime};base64,{base64.b64encode(data).decode()}"

    def number_of(key: bytes) -> int:
        found = re.search(rb"/" + key + rb"\s+(\d+)", head)
        return int(found[1]) if found else 0

    width, height, colours = number_of(b"Width"), number_of(b"Height"), {b"DeviceGray": (1, 0), b"DeviceRGB": (3, 2)}
    space = re.search(rb"/ColorSpace\s*/(DeviceGray|DeviceRGB)", head)
    if not space or number_of(b"BitsPerComponent") != 8 or b"/Predictor" in head:
        return None
    samples, kind = colours[space[1]]
    row = width * samples
    if not row or len(data) < row * height:
        return None

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    lines = b"".join(b"\0" + data[i * row : (i + 1) * row] for i in range(height))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    return f"data:image/png;base64,{base64.b64encode(png).decode()}"


def dropped_features(pdf, blocks) -> list[str]:
    """What reading a PDF file loses, as far as this file has it."""
    kinds = {b.type for b in blocks}
    catalog = next((b for b in pdf.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    told = [
        ("heading" in kinds, "heading_levels_heuristic"),
        ("table" in kinds, "table_structure_heuristic"),
        ("list" in kinds, "list_structure_heuristic"),
        (True, "paragraph_formatting"),
        (True, "font_embedding"),
        (b"/AcroForm" in catalog, "form_fields"),
        (b"/Outlines" in catalog, "document_outline"),
    ]
    return [name for held, name in told if held]


def metadata(data: bytes, pdf) -> dict[str, str | float | None]:
    """Title, author and dates of the file's information, its first page's size."""
    from .pdf import _string

    named = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", data)
    info = pdf.objects.get(int(named[1]), b"") if named else b""

    def text(key: str) -> str | None:
        found = re.search(rb"/" + key.encode() + rb"\s*(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)", info, re.S)
        raw = _string(found[1]) if found else b""
        said = raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")
        return said or None

    pages = pdf.pages()
    box = media_box(pdf, pages[0]) if pages else None
    size = {"page_width": box[2] - box[0], "page_height": box[3] - box[1]} if box else {"page_width": None, "page_height": None}
    return {"title": text("Title"), "author": text("Author"), "created_at": text("CreationDate"), "modified_at": text("ModDate"), **size}
