"""Positioned text of PDF files, for the layout operators.

Objects are found by scanning, so a damaged cross-reference table does no harm; streams may be
plain or deflated, and object streams are opened. Text is read from the text operators of page
contents; fonts without a ToUnicode map are read as Latin-1. Encrypted files give no spans.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPANS = "doc_id long, page int, n int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean"
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(
    rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9]?", re.S
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}
#: Width of a sign in ems where a font gives none.
EM = 0.5


class Pdf:
    def __init__(self, data: bytes):
        self.objects: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        for number, _, body in _OBJECT.findall(data):
            self._add(int(number), body)
        for number in list(self.streams):
            head = self.objects[number]
            if re.search(rb"/Type\s*/ObjStm", head):
                self._open(head, self.streams[number])

    def _add(self, number: int, body: bytes) -> None:
        head, mark, rest = body.partition(b"stream")
        self.objects[number] = head
        if not mark:
            return
        rest = rest[2:] if rest.startswith(b"\r\n") else rest[1:]
        length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
        raw = rest[: int(length[1])] if length else rest.rpartition(b"endstream")[0]
        if b"FlateDecode" in head:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                raw = b""
        self.streams[number] = raw

    def _open(self, head: bytes, content: bytes) -> None:
        first = re.search(rb"/First\s+(\d+)", head)
        if not first:
            return
        start = int(first[1])
        numbers = [int(n) for n in content[:start].split()]
        places = list(zip(numbers[::2], numbers[1::2], strict=False))
        for k, (number, at) in enumerate(places):
            end = places[k + 1][1] if k + 1 < len(places) else len(content) - start
            self.objects.setdefault(number, content[start + at : start + end])

    def ref(self, body: bytes, name: str) -> int | None:
        found = re.search(rb"/" + name.encode() + rb"\s+(\d+)\s+\d+\s+R", body)
        return int(found[1]) if found else None

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree, else of their numbers."""
        root = next((n for n, b in self.objects.items() if re.search(rb"/Type\s*/Catalog", b)), None)
        out: list[bytes] = []
        todo, seen = [self.ref(self.objects[root], "Pages")] if root is not None else [], set()
        while todo:
            number = todo.pop()
            if number is None or number in seen or number not in self.objects:
                continue
            seen.add(number)
            body = self.objects[number]
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                todo += [int(n) for n in reversed(re.findall(rb"(\d+)\s+\d+\s+R", kids[1]))]
            else:
                out.append(body)
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]

    def content(self, page: bytes) -> bytes:
        many = re.search(rb"/Contents\s*\[(.*?)\]", page, re.S)
        numbers = [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", many[1])] if many else [self.ref(page, "Contents")]
        return b"\n".join(self.streams.get(n, b"") for n in numbers if n is not None)

    def fonts(self, page: bytes) -> dict[bytes, tuple[bool, dict[bytes, str]]]:
        """Of each font name, whether it is bold and its map to Unicode."""
        resources = page
        if self.ref(page, "Resources") is not None:
            resources = self.objects.get(self.ref(page, "Resources"), b"")
        table = re.search(rb"/Font\s*<<(.*?)>>", resources, re.S)
        body = table[1] if table else self.objects.get(self.ref(resources, "Font") or -1, b"")
        out = {}
        for name, number in re.findall(rb"(/[^\s/]+)\s+(\d+)\s+\d+\s+R", body):
            font = self.objects.get(int(number), b"")
            base = re.search(rb"/BaseFont\s*/([^\s/<>]+)", font)
            out[name] = (bool(base and re.search(rb"bold|black|heavy", base[1], re.I)), _unicode_map(self.streams.get(self.ref(font, "ToUnicode") or -1, b"")))
        return out


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    def text(digits: bytes) -> str:
        return bytes.fromhex(digits.decode()).decode("utf-16-be", "replace")

    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(code.decode())] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, size = int(low, 16), len(low) // 2
            base = text(to)
            for k in range(min(int(high, 16) - first, 65_535) + 1):
                out[(first + k).to_bytes(size, "big")] = base[:-1] + chr(ord(base[-1]) + k)
    return out


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def escape(m: re.Match) -> bytes:
        if m[1].isdigit():
            return bytes([int(m[1], 8) & 255])
        return b"" if m[1] in (b"\n", b"\r") else _ESCAPES.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|.)", escape, token[1:-1], flags=re.S)


def _decoded(raw: bytes, table: dict[bytes, str]) -> str:
    if not table:
        return raw.decode("latin-1")
    size = max(map(len, table))
    return "".join(table.get(raw[i : i + size], "") for i in range(0, len(raw), size))


def _times(m: list[float], n: list[float]) -> list[float]:
    return [m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5]]


def page_spans(pdf: Pdf, page: bytes) -> list[tuple]:
    """(x0, y0, x1, y1, text, size, bold) in the order of the content."""
    fonts, out, args = pdf.fonts(page), [], []
    identity = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    ctm, saved, line, matrix = identity, [], identity, identity
    font, size, leading = (False, {}), 1.0, 0.0

    def show(raw: bytes) -> None:
        nonlocal matrix
        text = _decoded(raw, font[1])
        at = _times(matrix, ctm)
        height = size * (abs(at[3]) or abs(at[1]) or 1.0)
        width = EM * size * len(text)
        if text.strip():
            out.append((at[4], at[5], at[4] + width * (abs(at[0]) or 1.0), at[5] + height, text, round(height, 2), font[0]))
        matrix = _times([1, 0, 0, 1, width, 0], matrix)

    def move(x: float, y: float) -> None:
        nonlocal line, matrix
        line = matrix = _times([1, 0, 0, 1, x, y], line)

    numbers = lambda n: [float(a) for a in args[-n:]]
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
                ctm = _times(numbers(6), ctm)
            elif token == b"BT":
                line = matrix = identity
            elif token == b"Tf":
                font, size = fonts.get(args[-2], (False, {})), float(args[-1])
            elif token == b"TL":
                leading = float(args[-1])
            elif token in (b"Td", b"TD"):
                x, y = numbers(2)
                leading = -y if token == b"TD" else leading
                move(x, y)
            elif token == b"Tm":
                line = matrix = numbers(6)
            elif token in (b"T*", b"'", b'"'):
                move(0, -leading)
            if token in (b"Tj", b"'", b'"'):
                show(_string(args[-1]))
            elif token == b"TJ":
                start = len(args) - 1 - args[::-1].index(b"[")
                parts = [_string(a) if a[:1] in b"(<" else (b" " if float(a) < -250 else b"") for a in args[start + 1 :] if a != b"]"]
                show(b"".join(parts))
        except (ValueError, IndexError):
            pass  # a broken operator is skipped
        args = []
    return out


def pdf_spans(files: DataFrame, content: str = "content") -> DataFrame:
    """Spans of PDF files (doc_id, content), for :mod:`docloom.operators.layout`; null and unreadable files give none."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for doc_id, data in zip(pdf["doc_id"], pdf["c"], strict=True):
                if data is None or b"/Encrypt" in data:
                    continue
                document = Pdf(bytes(data))
                for number, page in enumerate(document.pages(), 1):
                    rows += [(doc_id, number, n, *span) for n, span in enumerate(page_spans(document, page))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")])

    return files.select("doc_id", F.col(content).alias("c")).mapInPandas(run, SPANS)


def parse_pdf(content: bytes, ids=None) -> list:
    """Blocks of one file by the rules of :mod:`docloom.operators.layout`: running heads and feet go, headings by size.

    Of each page come, from top to bottom, its lines, ruled tables, pictures and drawings, then the
    footnotes under a rule. A text belongs to the cell in which it starts, as widths are estimates.
    A paragraph that a link overlaps becomes a link. For many pages use :func:`pdf_spans` and the
    operators, which do the same for lines over whole corpora.
    """
    from collections import Counter

    from ..model import Ids, Node, inline
    from ..operators.layout import BOLD_LEVEL, BOLD_SHARE, HEADING_RATIOS, LEAST_RATIO
    from . import pdfmarks

    if b"/Encrypt" in content:
        raise ValueError("the document is encrypted")
    pdf, ids, found, held = Pdf(content), ids or Ids(), [], []
    pages = pdf.pages()
    weights: Counter = Counter()
    for number, page in enumerate(pages):
        box, marks = pdfmarks.media_box(pdf, page), pdfmarks.page_marks(pdf, page)
        tables = pdfmarks.grids(marks, box)
        cells: list[dict] = [{} for _ in tables]
        spans = sorted(page_spans(pdf, page), key=lambda s: (-s[1], s[0]))
        before = None
        for x0, y0, x1, y1, text, size, bold in spans:
            n = len(re.sub(r"\s", "", text))
            weights[size] += n
            home = next(((k, at) for k, t in enumerate(tables) if (at := t.cell(x0, (y0 + y1) / 2))), None)
            if home:
                cells[home[0]].setdefault(home[1], []).append(text)
                continue
            if before is not None and abs(before - y0) <= 2:
                line = found[-1]
                line["text"] += " " + text
                line["size"], line["bold"], line["n"], line["x1"] = max(line["size"], size), line["bold"] + bold * n, line["n"] + n, max(line["x1"], x1)
            else:
                found.append({"page": number, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": text, "size": size, "bold": bold * n, "n": n})
            before = y0
        held.append((marks, tables, cells, pdfmarks.drawing(marks, tables), pdfmarks.notes_below(marks, box), pdfmarks.links(pdf, page)))
    body = min(weights, key=lambda s: (-weights[s], s)) if weights else 1.0
    top = max((line["y1"] for line in found), default=0.0)
    on_pages: dict[tuple, set] = {}
    for line in found:
        if line["y0"] < top * 0.08 or line["y1"] > top * 0.92:
            on_pages.setdefault((line["text"], round(line["y0"] / 5)), set()).add(line["page"])
    repeated = {k for k, on in on_pages.items() if len(on) >= 2 and len(on) >= 0.5 * len(pages)}
    out: list = []

    def paragraph(text: str):
        return Node("paragraph", ids(), inlines=[inline(text=text)])

    def add_line(line: dict, linked: list) -> None:
        ratio, text = line["size"] / body, line["text"]
        level = next((n for least, n in HEADING_RATIOS if ratio >= least), 4 if ratio > LEAST_RATIO else BOLD_LEVEL if line["bold"] >= BOLD_SHARE * line["n"] and line["n"] else None)
        item = re.match(r"\s*([-*•▪◦]|\d+[.)])\s+(.*)", text, re.S)
        if level:
            out.append(Node("heading", ids(), level=level, text=text, inlines=[inline(text=text)]))
        elif item:
            ordered = item[1][0].isdigit()
            if not (out and out[-1].type == "list" and out[-1].ordered == ordered):
                out.append(Node("list", ids(), ordered=ordered, start=int(item[1][:-1]) if ordered else None))
            out[-1].add(Node("list_item", ids(), kind="list_item", inlines=[inline(text=item[2])]), "items")
        else:
            url = next((url for place, url in linked if pdfmarks.overlap((line["x0"], line["y0"], line["x1"], line["y1"]), place)), None)
            out.append(Node("paragraph", ids(), inlines=[inline("link" if url else "text", text, url=url)]))

    def add_table(grid, texts: dict) -> None:
        table = Node("table", ids())
        for r in range(len(grid.ys) - 1):
            row = table.add(Node("table_row", None, kind="table_row", is_header=False), "rows")
            for c in range(len(grid.xs) - 1):
                cell = row.add(Node("table_cell", ids(), kind="table_cell", row_span=1, col_span=1), "cells")
                if (r, c) in texts:
                    cell.add(paragraph(" ".join(texts[r, c])), "content")
        out.append(table)

    by_page: list[list[dict]] = [[] for _ in pages]
    for line in found:
        by_page[line["page"]].append(line)
    for lines, (marks, tables, cells, drawn, notes, linked) in zip(by_page, held, strict=True):
        placed: list[tuple] = [(-t.ys[-1], 1, lambda t=t, texts=texts: add_table(t, texts)) for t, texts in zip(tables, cells, strict=True)]
        for (x0, y0, x1, y1), number in marks.images:
            attrs = {"src": pdfmarks.picture(pdf, number), "width": round(x1 - x0, 2), "height": round(y1 - y0, 2)}
            placed.append((-y1, 1, lambda attrs=attrs: out.append(Node("image", ids(), attrs=attrs))))
        if drawn:
            placed.append((-drawn[3], 1, lambda box=drawn: out.append(Node("drawing", ids(), attrs={"kind": "chart", "box": " ".join(f"{v:g}" for v in box)}))))
        below = []
        for line in lines:
            if (line["text"], round(line["y0"] / 5)) in repeated:
                continue
            note = pdfmarks.NOTE.match(line["text"]) if notes is not None and (line["y0"] + line["y1"]) / 2 <= notes else None
            if note:
                below.append((note[1], line["text"][note.end() :].strip()))
            else:
                placed.append((-line["y0"], 0, lambda line=line: add_line(line, linked)))
        for _, _, add in sorted(placed, key=lambda p: p[:2]):
            add()
        for ref, text in below:
            note = Node("footnote", ids(), attrs={"ref": ref})
            if text:
                note.add(paragraph(text), "content")
            out.append(note)
    return out
