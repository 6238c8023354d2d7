"""HWPX packages: sections of paragraphs, tables, notes, pictures and equations, with a header of styles."""

from __future__ import annotations

import io
import re
import zipfile

from ..model import Ids, Node, inline
from .xml import local, safe_tree

#: Units of the format in a point.
PER_PT = 100.0


class Header:
    """Character and paragraph properties and styles, by id."""

    def __init__(self, xml: bytes | None):
        self.chars: dict[str, dict] = {}
        self.levels: dict[str, int] = {}
        self.styles: dict[str, str] = {}
        self.fonts: dict[str, str] = {}
        if not xml:
            return
        for e in safe_tree(xml).iter():
            tag = local(e.tag)
            if tag == "fontface" and e.get("lang") in ("HANGUL", None):
                self.fonts = {f.get("id"): f.get("face") for f in e if local(f.tag) == "font"}
            elif tag == "charPr":
                self.chars[e.get("id")] = self._char(e)
            elif tag == "paraPr":
                head = next((x for x in e if local(x.tag) == "heading"), None)
                if head is not None and head.get("type") == "OUTLINE":
                    self.levels[e.get("id")] = int(head.get("level", 0)) + 1
            elif tag == "style":
                self.styles[e.get("id")] = e.get("name") or ""

    def _char(self, e) -> dict:
        parts = {local(x.tag): x for x in e}
        on = lambda name: True if name in parts else None
        line = parts.get("underline")
        strike = parts.get("strikeout")
        color = (e.get("textColor") or "").lower()
        font = parts.get("fontRef")
        return {
            "bold": on("bold"), "italic": on("italic"), "superscript": on("supscript"), "subscript": on("subscript"),
            "underline": True if line is not None and line.get("type") not in (None, "NONE") else None,
            "strike": True if strike is not None and strike.get("shape") not in (None, "NONE") else None,
            "color": color if re.fullmatch(r"#[0-9a-f]{6}", color) and color != "#000000" else None,
            "size": float(e.get("height")) / PER_PT if e.get("height") else None, "font": self.fonts.get(font.get("hangul")) if font is not None else None,
        }

    def level(self, p) -> int | None:
        """By the style's name, else by the paragraph's outline level; 1 to 6."""
        named = re.match(r"(?:개요|Heading)\s*(\d+)", self.styles.get(p.get("styleIDRef"), ""))
        level = int(named[1]) if named else self.levels.get(p.get("paraPrIDRef"))
        return None if level is None else max(1, min(6, level))


def parse_hwpx(content: bytes, ids: Ids | None = None) -> list[Node]:
    archive, ids = zipfile.ZipFile(io.BytesIO(content)), ids or Ids()
    names = archive.namelist()
    header = Header(archive.read("Contents/header.xml") if "Contents/header.xml" in names else None)
    sections = sorted((n for n in names if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out: list[Node] = []
    for name in sections:
        for p in safe_tree(archive.read(name)):
            if local(p.tag) == "p":
                out += _paragraph(p, header, ids)
    return out


def _sublist(e, header: Header, ids: Ids) -> list[Node]:
    out: list[Node] = []
    for holder in (x for x in e.iter() if local(x.tag) == "subList"):
        for p in (x for x in holder if local(x.tag) == "p"):
            out += _paragraph(p, header, ids)
        break
    return out


def _paragraph(p, header: Header, ids: Ids) -> list[Node]:
    inlines: list[dict] = []
    extra: list[Node] = []
    url = None
    for run in (x for x in p if local(x.tag) == "run"):
        style = header.chars.get(run.get("charPrIDRef"), {})
        todo = list(reversed(list(run)))
        while todo:
            e = todo.pop()
            tag = local(e.tag)
            if tag == "t":
                parts = [e.text or ""]
                for child in e:
                    parts += [{"tab": "\t", "lineBreak": "\n", "nbSpace": " ", "fwSpace": " ", "hyphen": "-"}.get(local(child.tag), ""), child.tail or ""]
                text = "".join(parts)
                if text:
                    inlines.append(inline("link" if url else "text", text, url=url, **style))
            elif tag == "ctrl":
                todo += reversed(list(e))
            elif tag == "fieldBegin" and e.get("type") == "HYPERLINK":
                command = next((x.text for x in e.iter() if local(x.tag) == "stringParam" and x.get("name") == "Command"), None)
                url = (command or "").split(";")[0].replace("\\", "") or None
            elif tag == "fieldEnd":
                url = None
            elif tag == "tbl":
                extra.append(_table(e, header, ids))
            elif tag == "pic":
                source = next((x for x in e.iter() if local(x.tag) == "img"), None)
                if source is not None:
                    extra.append(Node("image", ids(), attrs={"src": f"bindata:{source.get('binaryItemIDRef')}", **_size(e)}))
            elif tag == "equation":
                script = next((x.text for x in e if local(x.tag) == "script"), None) or ""
                extra.append(Node("equation", ids(), text=script, attrs={"hwp_script": script}))
            elif tag in ("footNote", "endNote"):
                kind = tag.lower().replace("note", "note")
                number = e.get("number") or str(len(extra) + 1)
                inlines.append(inline(kind + "_ref", ref=number))
                node = Node(kind, ids(), attrs={"ref": number})
                for block in _sublist(e, header, ids):
                    node.add(block, "content")
                extra.append(node)
            elif tag in ("header", "footer"):
                node = Node(tag, ids(), attrs={"apply_to": {"BOTH": "all"}.get(e.get("applyPageType"), (e.get("applyPageType") or "all").lower())})
                for block in _sublist(e, header, ids):
                    node.add(block, "content")
                extra.append(node)
            elif tag in ("rect", "ellipse", "polygon", "container", "line", "arc", "curve"):
                inner = _sublist(e, header, ids)
                node = Node("text_box" if inner else "drawing", ids(), attrs={"shape": tag, **_size(e)})
                for block in inner:
                    node.add(block, "content")
                extra.append(node)
    level = header.level(p)
    out: list[Node] = []
    if p.get("pageBreak") == "1":
        out.append(Node("page_break", ids()))
    if level is not None and inlines:
        out.append(Node("heading", ids(), level=level, text="".join(i["text"] or "" for i in inlines), inlines=inlines))
    elif inlines or not extra:
        out.append(Node("paragraph", ids(), inlines=inlines))
    return out + extra


def _size(e) -> dict:
    size = next((x for x in e if local(x.tag) in ("sz", "curSz", "orgSz")), None)
    return {} if size is None else {k: float(size.get(k)) / PER_PT for k in ("width", "height") if size.get(k)}


def _table(e, header: Header, ids: Ids) -> Node:
    table = Node("table", ids())
    for tr in (x for x in e if local(x.tag) == "tr"):
        row = Node("table_row", None, kind="table_row")
        for tc in (x for x in tr if local(x.tag) == "tc"):
            span = next((x for x in tc if local(x.tag) == "cellSpan"), None)
            cell = Node("table_cell", ids(), kind="table_cell", row_span=int(span.get("rowSpan", 1)) if span is not None else 1, col_span=int(span.get("colSpan", 1)) if span is not None else 1, is_header=tc.get("header") == "1")
            for block in _sublist(tc, header, ids) or [Node("paragraph", ids(), inlines=[])]:
                cell.add(block, "content")
            row.add(cell, "cells")
        table.add(row, "rows")
    return table
