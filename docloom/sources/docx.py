"""DOCX packages, read with zipfile and ElementTree."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile

from ..functions.equations import omml_to_latex
from ..model import Ids, Node, inline
from .xml import local, safe_tree

# Namespaces of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
EMU_PER_PT = 12700
MAX_TABLE_DEPTH = 8


class Package:
    """The parts of a package that the parser looks things up in."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        self.targets = {e.get("Id"): e.get("Target") for e in self.tree("word/_rels/document.xml.rels")}
        self.spacings = None
        self.levels: dict[str, int] = {}
        for style in self.tree("word/styles.xml"):
            if local(style.tag) == "style" and style.get(W + "type") == "paragraph":
                outline = style.find(f"{W}pPr/{W}outlineLvl")
                name = style.find(W + "name")
                named = re.fullmatch(r"heading (\d)", (name.get(W + "val") if name is not None else "").lower())
                if named or outline is not None:
                    self.levels[style.get(W + "styleId")] = int(named[1]) if named else int(outline.get(W + "val")) + 1
        kinds = {}
        self.bullets: set[str] = set()
        for e in self.tree("word/numbering.xml"):
            if local(e.tag) == "abstractNum":
                first = e.find(f"{W}lvl/{W}numFmt")
                kinds[e.get(W + "abstractNumId")] = first.get(W + "val") if first is not None else "decimal"
            elif local(e.tag) == "num":
                base = e.find(W + "abstractNumId")
                if base is not None and kinds.get(base.get(W + "val")) == "bullet":
                    self.bullets.add(e.get(W + "numId"))

    def tree(self, name: str):
        return safe_tree(self.zip.read(name)) if name in self.names else []


def _on(pr, name: str) -> bool | None:
    e = pr.find(W + name) if pr is not None else None
    if e is None:
        return None
    return True if e.get(W + "val") not in ("0", "false", "none") else None


def _style(run) -> dict:
    pr = run.find(W + "rPr")
    if pr is None:
        return {}
    color, size, font, align = (pr.find(W + n) for n in ("color", "sz", "rFonts", "vertAlign"))
    value = color.get(W + "val") if color is not None else None
    raised = align.get(W + "val") if align is not None else None
    return {
        "bold": _on(pr, "b"), "italic": _on(pr, "i"), "underline": _on(pr, "u"), "strike": _on(pr, "strike"),
        "superscript": True if raised == "superscript" else None, "subscript": True if raised == "subscript" else None,
        "color": f"#{value.lower()}" if value and value != "auto" else None, "size": float(size.get(W + "val")) / 2 if size is not None else None,
        "font": font.get(W + "ascii") if font is not None else None,
    }


def _run(run, package: Package, url: str | None, out: list[dict], extra: list[Node], ids: Ids) -> bool:
    """Appends a run's inlines; True if it holds a page break."""
    style, broke = _style(run), False
    for e in run:
        tag = local(e.tag)
        if tag == "t":
            out.append(inline("link" if url else "text", e.text or "", url=url, **style))
        elif tag in ("tab", "cr") or (tag == "br" and e.get(W + "type") != "page"):
            out.append(inline(text="\t" if tag == "tab" else "\n", **style))
        elif tag == "br":
            broke = True
        elif tag in ("footnoteReference", "endnoteReference"):
            out.append(inline(tag.removesuffix("Reference") + "_ref", ref=e.get(W + "id")))
        elif tag in ("drawing", "pict"):
            blip = next((x for x in e.iter() if x.tag == A + "blip"), None)
            extent = next((x for x in e.iter() if local(x.tag) == "extent"), None)
            known = next((x for x in e.iter() if local(x.tag) == "docPr"), None)
            if blip is not None:
                size = {k: float(extent.get(v)) / EMU_PER_PT for k, v in (("width", "cx"), ("height", "cy"))} if extent is not None else {}
                alt = known.get("descr") if known is not None else None
                extra.append(Node("image", ids(), text=alt, attrs={"src": package.targets.get(blip.get(R + "embed")), "alt": alt, **size}))
            box = next((x for x in e.iter() if local(x.tag) == "txbxContent"), None)
            if box is not None:
                node = Node("text_box", ids())
                for block in _body(box, package, ids):
                    node.add(block, "content")
                extra.append(node)
    return broke


def _paragraph(p, package: Package, ids: Ids) -> list[Node]:
    inlines: list[dict] = []
    extra: list[Node] = []
    broke, field_state = False, 0
    todo = [(c, None) for c in reversed(list(p))]
    while todo:
        e, url = todo.pop()
        tag = local(e.tag)
        if tag == "r":
            mark = e.find(W + "fldChar")
            if mark is not None:  # of a field, only what it shows is text
                field_state = {"begin": 1, "separate": 0, "end": 0}.get(mark.get(W + "fldCharType"), field_state)
            elif not field_state:
                broke |= _run(e, package, url, inlines, extra, ids)
        elif tag == "hyperlink":
            todo += [(c, package.targets.get(e.get(R + "id")) or "#" + (e.get(W + "anchor") or "")) for c in reversed(list(e))]
        elif tag in ("ins", "smartTag", "fldSimple", "sdt", "sdtContent"):
            todo += [(c, url) for c in reversed(list(e))]
        elif e.tag == M + "oMath":
            inlines.append(inline("equation", latex=omml_to_latex(e)))
        elif e.tag == M + "oMathPara":
            extra.append(Node("equation", ids(), text="".join(omml_to_latex(x) for x in e if x.tag == M + "oMath"), attrs={"display": "true"}))
        elif tag == "AlternateContent":
            todo += [(c, url) for branch in list(e)[:1] for c in reversed(list(branch))]
    pr = p.find(W + "pPr")
    style = pr.find(W + "pStyle") if pr is not None else None
    level = package.levels.get(style.get(W + "val")) if style is not None else None
    out: list[Node] = []
    if level is not None:
        out.append(Node("heading", ids(), level=min(level, 6), text="".join(i["text"] or "" for i in inlines), inlines=inlines))
    elif inlines or not extra:
        formats = package.spacings.of(p) if package.spacings else {}
        out.append(Node("paragraph", ids(), inlines=inlines, attrs={f"format.{k}": v for k, v in formats.items()}))
    out += extra
    if broke:
        out.append(Node("page_break", ids()))
    return out


def _list_place(p) -> tuple[str, int] | None:
    num = p.find(f"{W}pPr/{W}numPr/{W}numId")
    if num is None or num.get(W + "val") in (None, "0"):
        return None
    level = p.find(f"{W}pPr/{W}numPr/{W}ilvl")
    return num.get(W + "val"), int(level.get(W + "val")) if level is not None else 0


def _body(body, package: Package, ids: Ids, depth: int = 0) -> list[Node]:
    out: list[Node] = []
    open_list: Node | None = None
    open_id = None
    todo = list(reversed(list(body)))
    while todo:
        e = todo.pop()
        tag = local(e.tag)
        if tag in ("sdt", "sdtContent", "ins"):
            todo += reversed(list(e))
            continue
        place = _list_place(e) if tag == "p" else None
        blocks = _paragraph(e, package, ids) if tag == "p" else []
        if place and blocks and blocks[0].type == "paragraph":
            if open_list is None or open_id != place[0]:
                ordered = place[0] not in package.bullets
                open_list, open_id = Node("list", ids(), ordered=ordered, start=1 if ordered else None), place[0]
                out.append(open_list)
            item = Node("list_item", ids(), kind="list_item", inlines=blocks[0].inlines)
            if place[1] and open_list.children:
                open_list.children[-1].add(item, "children")
            else:
                open_list.add(item, "items")
            continue
        if tag in ("p", "tbl"):
            open_list = None
        out += blocks
        if tag == "tbl" and depth < MAX_TABLE_DEPTH:
            out.append(_table(e, package, ids, depth))
    return out


def _table(tbl, package: Package, ids: Ids, depth: int) -> Node:
    table = Node("table", ids())
    above: dict[int, Node] = {}
    for tr in tbl.iter(W + "tr") if depth == 0 else tbl.findall(W + "tr"):
        if tr not in list(tbl):
            continue
        row, column = Node("table_row", None, kind="table_row", is_header=tr.find(f"{W}trPr/{W}tblHeader") is not None), 0
        for tc in tr.findall(W + "tc"):
            pr = tc.find(W + "tcPr")
            span = pr.find(W + "gridSpan") if pr is not None else None
            merge = pr.find(W + "vMerge") if pr is not None else None
            width = int(span.get(W + "val")) if span is not None else 1
            if merge is not None and merge.get(W + "val") != "restart" and column in above:
                above[column].row_span += 1
            else:
                cell = Node("table_cell", ids(), kind="table_cell", row_span=1, col_span=width)
                for block in _body(tc, package, ids, depth + 1) or [Node("paragraph", ids(), inlines=[])]:
                    cell.add(block, "content")
                row.add(cell, "cells")
                above.pop(column, None)
                if merge is not None:
                    above[column] = cell
            column += width
        table.add(row, "rows")
    return table


def parse_docx(content: bytes, ids: Ids | None = None) -> list[Node]:
    from .docxmeta import Spacings

    package, ids = Package(content), ids or Ids()
    package.spacings = Spacings(package)
    body = package.tree("word/document.xml").find(W + "body")
    blocks = _body(body, package, ids)
    for part, kind in (("footnotes", "footnote"), ("endnotes", "endnote")):
        for note in package.tree(f"word/{part}.xml"):
            if note.get(W + "type") not in ("separator", "continuationSeparator"):
                node = Node(kind, ids(), attrs={"ref": note.get(W + "id")})
                for block in _body(note, package, ids):
                    node.add(block, "content")
                blocks.append(node)
    section = body.find(W + "sectPr")
    for ref in section if section is not None else ():
        kind = local(ref.tag).removesuffix("Reference")
        if kind in ("header", "footer"):
            part = posixpath.normpath(posixpath.join("word", package.targets.get(ref.get(R + "id")) or ""))
            node = Node(kind, ids(), attrs={"apply_to": {"default": "all"}.get(ref.get(W + "type"), ref.get(W + "type"))})
            for block in _body(package.tree(part), package, ids):
                node.add(block, "content")
            blocks.append(node)
    return blocks
