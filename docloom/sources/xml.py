"""XML: DocBook 5 by its elements, other XML by the names of its tags. Entities are never expanded."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.parsers import expat

from ..model import Ids, Node, inline

DOCBOOK = "http://docbook.org/ns/docbook"


def local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def safe_tree(xml: str | bytes) -> ET.Element:
    """Parses without entities of any kind, so neither files nor expansions get in.

    A reference to a declared entity is dropped; a document that is not well-formed raises ET.ParseError.
    """
    builder = ET.TreeBuilder()
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True

    def name(n: str) -> str:
        return "{" + n if "}" in n else n

    parser.StartElementHandler = lambda tag, attrs: builder.start(name(tag), {name(k): v for k, v in attrs.items()})
    parser.EndElementHandler = lambda tag: builder.end(name(tag))
    parser.CharacterDataHandler = builder.data
    parser.DefaultHandler = lambda data: None  # with it, declared entities are not expanded
    parser.ExternalEntityRefHandler = lambda *a: 1
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        raise ET.ParseError(str(e)) from e
    return builder.close()


def parse_xml(xml: str, ids: Ids | None = None) -> list[Node]:
    root, ids = safe_tree(xml), ids or Ids()
    if root.tag.startswith("{" + DOCBOOK):
        return _docbook(root, ids, 1)
    return _generic(root, ids)


def _squeezed(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "")


def full_text(e: ET.Element) -> str:
    return _squeezed("".join(e.itertext())).strip()


_CODE, _STRONG, _SLANTED, _LINKS = {"code", "tt", "literal"}, {"strong", "b", "bold"}, {"em", "i", "emphasis", "italic"}, {"a", "link", "ulink"}


def _inlines(e: ET.Element) -> list[dict]:
    out: list[dict] = []

    def put(text: str | None, **style):
        text = _squeezed(text)
        if text:
            out.append(inline("link" if style.get("url") else "text", text, **style))

    put(e.text)
    for child in e:
        tag = local(child.tag)
        text = "".join(child.itertext())
        if tag in _LINKS:
            href = next((v for k, v in child.attrib.items() if local(k) in ("href", "url")), None)
            put(text, url=href)
        elif tag in _STRONG or (tag == "emphasis" and child.get("role") in ("bold", "strong")):
            put(text, bold=True)
        elif tag in _SLANTED:
            put(text, italic=True)
        elif tag in _CODE:
            put(text, font="monospace")
        elif tag == "superscript":
            put(text, superscript=True)
        elif tag == "subscript":
            put(text, subscript=True)
        elif tag == "footnote":
            out.append(inline("footnote_ref", ref=_id(child)))
        else:
            put(text)
        put(child.tail)
    if out and out[0]["text"]:
        out[0]["text"] = out[0]["text"].lstrip()
    if out and out[-1]["text"]:
        out[-1]["text"] = out[-1]["text"].rstrip()
    return [i for i in out if i["type"] != "text" or i["text"]]


def _id(e: ET.Element) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == "id"), None)


_HEADS, _PARAS, _LISTS, _TABLES, _IMAGES = {"title", "heading", "h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "para", "paragraph"}, {"ul", "ol", "list"}, {"table"}, {"img", "image", "graphic"}
_PRE = {"pre", "codeblock", "programlisting"}


def _paragraph(e: ET.Element, ids: Ids) -> Node:
    return Node("paragraph", ids(), inlines=_inlines(e))


def _generic(root: ET.Element, ids: Ids) -> list[Node]:
    out: list[Node] = []
    known = _HEADS | _PARAS | _LISTS | _TABLES | _IMAGES | _PRE
    for e in root:
        tag = local(e.tag).lower()
        if tag in _HEADS:
            out.append(Node("heading", ids(), level=int(tag[1]) if tag[1:].isdigit() else 1, text=full_text(e), inlines=_inlines(e)))
        elif tag in _PARAS:
            out.append(_paragraph(e, ids))
        elif tag in _PRE:
            out.append(Node("code", ids(), text="".join(e.itertext()), attrs={"language": e.get("language") or e.get("lang")}))
        elif tag in _LISTS:
            node = Node("list", ids(), ordered=tag == "ol" or e.get("type") == "ordered", start=1 if tag == "ol" else None)
            for item in e:
                if local(item.tag).lower() in ("li", "item", "listitem"):
                    node.add(Node("list_item", ids(), kind="list_item", inlines=_inlines(item)), "items")
            out.append(node)
        elif tag in _TABLES:
            node = Node("table", ids())
            for tr in (x for x in e.iter() if local(x.tag).lower() in ("tr", "row")):
                _row(node, [(c, local(c.tag).lower() == "th", {}) for c in tr if local(c.tag).lower() in ("td", "th", "cell", "entry")], ids)
            out.append(node)
        elif tag in _IMAGES:
            src = e.get("src") or e.get("href") or e.get("fileref")
            if src:
                out.append(Node("image", ids(), text=e.get("alt"), attrs={"src": src, "alt": e.get("alt"), "width": e.get("width"), "height": e.get("height")}))
        elif any(local(x.tag).lower() in known for x in e.iter() if x is not e):
            out += _generic(e, ids)
        elif full_text(e):
            out.append(_paragraph(e, ids))
        else:
            out.append(Node("unknown", ids(), attrs={"raw": ET.tostring(e, encoding="unicode")}))
    return out


def _row(table: Node, cells: list[tuple], ids: Ids, header: bool = False) -> None:
    row = Node("table_row", None, kind="table_row", is_header=header)
    for e, head, spans in cells:
        cell = Node("table_cell", ids(), kind="table_cell", is_header=head, **({"row_span": 1, "col_span": 1} | spans))
        paras = [c for c in e if local(c.tag) in ("para", "p", "simpara")]
        for para in paras or [e]:
            cell.add(_paragraph(para, ids), "content")
        row.add(cell, "cells")
    table.add(row, "rows")


_SECTIONS = {"article", "book", "chapter", "section", "sect1", "sect2", "sect3", "sect4", "sect5", "appendix", "preface", "part"}


def _docbook(parent: ET.Element, ids: Ids, depth: int) -> list[Node]:
    out: list[Node] = []
    for e in parent:
        tag = local(e.tag)
        if tag == "info":
            continue
        if tag == "title":
            out.append(Node("heading", ids(), level=min(6, max(1, depth)), text=full_text(e), inlines=_inlines(e)))
        elif tag in _SECTIONS:
            out += _docbook(e, ids, depth + 1)
        elif tag in ("para", "simpara"):
            out.append(_paragraph(e, ids))
            for note in (x for x in e.iter() if local(x.tag) == "footnote"):
                out += _wrapped("footnote", note, ids, depth)
        elif tag in ("programlisting", "screen", "literallayout"):
            out.append(Node("code", ids(), text="".join(e.itertext()).strip("\n"), attrs={"language": e.get("language")}))
        elif tag in ("itemizedlist", "orderedlist", "simplelist"):
            node = Node("list", ids(), ordered=tag == "orderedlist", start=1 if tag == "orderedlist" else None)
            for item in (x for x in e if local(x.tag) in ("listitem", "member")):
                holder = next((x for x in item if local(x.tag) in ("para", "simpara")), item)
                made = Node("list_item", ids(), kind="list_item", inlines=_inlines(holder))
                node.add(made, "items")
                for inner in (x for x in item if local(x.tag) in ("itemizedlist", "orderedlist")):
                    for child in _docbook(_wrap(inner), ids, depth)[0].children:
                        made.add(child, "children")
            out.append(node)
        elif tag == "variablelist":
            node = Node("list", ids(), ordered=False)
            for entry in (x for x in e if local(x.tag) == "varlistentry"):
                terms = " / ".join(full_text(x) for x in entry if local(x.tag) == "term")
                body = " ".join(full_text(x) for x in entry if local(x.tag) == "listitem")
                node.add(Node("list_item", ids(), kind="list_item", inlines=[inline(text=terms, bold=True), inline(text=": " + body)]), "items")
            out.append(node)
        elif tag in ("table", "informaltable"):
            out.append(_docbook_table(e, ids))
        elif tag in ("figure", "informalfigure", "mediaobject"):
            data = next((x for x in e.iter() if local(x.tag) == "imagedata"), None)
            if data is not None and data.get("fileref"):
                title = next((full_text(x) for x in e if local(x.tag) == "title"), None)
                alt = next((full_text(x) for x in e.iter() if local(x.tag) == "phrase"), None)
                out.append(Node("image", ids(), text=alt, attrs={"src": data.get("fileref"), "alt": alt, "caption": title, "width": data.get("width"), "height": data.get("depth")}))
        elif tag in ("equation", "informalequation"):
            out.append(Node("equation", ids(), text=full_text(e)))
        elif tag == "blockquote":
            out += _wrapped("quote", e, ids, depth)
        elif tag == "footnote":
            out += _wrapped("footnote", e, ids, depth)
        elif tag in ("note", "tip", "warning", "caution", "important", "sidebar"):
            out += _wrapped("text_box", e, ids, depth)
        elif full_text(e):
            out.append(_paragraph(e, ids))
    return out


def _wrap(e: ET.Element) -> ET.Element:
    holder = ET.Element("holder")
    holder.append(e)
    return holder


def _wrapped(kind: str, e: ET.Element, ids: Ids, depth: int) -> list[Node]:
    node = Node(kind, ids(), attrs={"ref": _id(e) or ""} if kind == "footnote" else {})
    for block in _docbook(e, ids, depth):
        node.add(block, "content")
    return [node]


def _docbook_table(e: ET.Element, ids: Ids) -> Node:
    table = Node("table", ids())
    group = next((x for x in e if local(x.tag) == "tgroup"), None)
    names = [x.get("colname") for x in (group if group is not None else ()) if local(x.tag) == "colspec"]
    for part in group if group is not None else [e]:
        if group is not None and local(part.tag) not in ("thead", "tbody", "tfoot"):
            continue
        for tr in (x for x in part.iter() if local(x.tag) in ("row", "tr")):
            cells = []
            for entry in (x for x in tr if local(x.tag) in ("entry", "td", "th")):
                spans = {"row_span": int(entry.get("morerows", 0)) + 1, "col_span": 1}
                if entry.get("namest") in names and entry.get("nameend") in names:
                    spans["col_span"] = names.index(entry.get("nameend")) - names.index(entry.get("namest")) + 1
                cells.append((entry, local(part.tag) == "thead" or local(entry.tag) == "th", spans))
            _row(table, cells, ids, local(part.tag) == "thead")
    return table
