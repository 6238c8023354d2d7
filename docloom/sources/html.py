"""HTML by the standard library's tokenizer, with implied end tags.

Content is what lies in page sections, else in the body's articles, else in the body; navigation
and the like around an article are left out. An open paragraph ends where a block begins, and an
end tag closes all that is open inside its element, so unbalanced markup does not swallow the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from ..model import Ids, Node, inline

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_ENDS = {"li": ("li", ("ul", "ol")), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",))}
_DROPPED = frozenset("script style head template noscript".split())


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in _DROPPED:
                stack += reversed(node.children)
        return "".join(out)

    def all(self, *tags: str) -> list[Element]:
        found, stack = [], [c for c in reversed(self.children) if not isinstance(c, str)]
        while stack:
            node = stack.pop()
            if node.tag in tags:
                found.append(node)
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]
        return found


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#document")
        self.open = [self.root]

    def _close(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._close(("p",), ("td", "th", "li", "table", "blockquote", "div", "section", "article", "figure", "aside"))
        if tag in _ENDS:
            names, stop = _ENDS[tag]
            self._close(tuple(names.split()), stop)
        element = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def build_dom(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def style_of(element: Element) -> dict[str, str]:
    pairs = (p.split(":", 1) for p in element.attrs.get("style", "").split(";") if ":" in p)
    return {k.strip().lower(): v.strip() for k, v in pairs}


_FLAGS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "s": "strike", "del": "strike", "sup": "superscript", "sub": "subscript"}
_MATH = re.compile(r"\\\((.+?)\\\)", re.S)


def extract_inlines(element: Element) -> list[dict]:
    out: list[dict] = []
    todo: list[tuple] = [(c, {}) for c in reversed(element.children)]
    while todo:
        node, style = todo.pop()
        if isinstance(node, str):
            text, at = re.sub(r"\s+", " ", node), 0
            for match in [*_MATH.finditer(text), None]:
                plain = text[at : match.start() if match else len(text)]
                if plain:
                    out.append(inline("link" if style.get("url") else "text", plain, **style))
                if match:
                    out.append(inline("equation", latex=match[1]))
                    at = match.end()
            continue
        if node.tag in _DROPPED:
            continue
        if node.tag == "br":
            out.append(inline(text="\n", **style))
        elif node.tag == "img":
            out.append(inline("image", node.attrs.get("alt") or None, url=node.attrs.get("src")))
        elif node.tag == "code":
            out.append(inline("code", node.text()))
        elif node.tag == "sup" and node.attrs.get("class", "").startswith(("footnote", "endnote")):
            out.append(inline(node.attrs["class"].split("-")[0] + "_ref", ref=node.text().strip()))
        else:
            more, css = dict(style), style_of(node)
            if node.tag in _FLAGS:
                more[_FLAGS[node.tag]] = True
            if node.tag == "a" and node.attrs.get("href"):
                more["url"] = node.attrs["href"]
            if css.get("color"):
                more["color"] = css["color"].lower()
            if css.get("font-family"):
                more["font"] = css["font-family"].split(",")[0].strip("'\" ")
            size = re.match(r"([\d.]+)pt$", css.get("font-size", ""))
            if size:
                more["size"] = float(size[1])
            todo += [(c, more) for c in reversed(node.children)]
    return _trimmed(out)


def _trimmed(inlines: list[dict]) -> list[dict]:
    """Without white space at both ends."""
    while inlines and inlines[0]["type"] == "text" and not (inlines[0]["text"] or "").lstrip(" "):
        inlines.pop(0)
    while inlines and inlines[-1]["type"] == "text" and not (inlines[-1]["text"] or "").rstrip(" "):
        inlines.pop()
    if inlines and inlines[0]["type"] == "text":
        inlines[0]["text"] = inlines[0]["text"].lstrip(" ")
    if inlines and inlines[-1]["type"] == "text":
        inlines[-1]["text"] = inlines[-1]["text"].rstrip(" ")
    return inlines


def parse_html(html: str, ids: Ids | None = None) -> list[Node]:
    ids = ids or Ids()
    root = build_dom(html)
    body = (root.all("body") or [root])[0]
    pages = [e for e in body.all("div", "section") if "page" in e.attrs.get("class", "").split()]
    articles = [c for c in body.children if not isinstance(c, str) and c.tag == "article"]
    blocks: list[Node] = []
    for part in pages or articles or [body]:
        blocks += blocks_of(part, ids)
    return _join_split_tables(blocks)


def blocks_of(parent: Element, ids: Ids) -> list[Node]:
    """Blocks among the children; loose text between them becomes paragraphs."""
    out: list[Node] = []
    loose: list = []

    def flush():
        inlines = extract_inlines(Element("p", children=list(loose)))
        loose.clear()
        if inlines:
            out.append(Node("paragraph", ids(), inlines=inlines))

    for child in parent.children:
        if isinstance(child, str) or child.tag not in _BLOCKS | {"img", "figure", "table"}:
            if not isinstance(child, str) and child.tag in _DROPPED:
                continue
            loose.append(child)
            continue
        flush()
        out += _block(child, ids)
    flush()
    return out


def _block(e: Element, ids: Ids) -> list[Node]:
    given = e.attrs.get("data-bid")
    kind = e.attrs.get("class", "").split()
    if re.fullmatch(r"h[1-6]", e.tag):
        inlines = extract_inlines(e)
        return [Node("heading", given or ids(), level=int(e.tag[1]), text="".join(i["text"] or "" for i in inlines), inlines=inlines)]
    if e.tag == "p":
        text = e.text().strip()
        if re.fullmatch(r"\$\$.+\$\$", text, re.S):
            return [Node("equation", given or ids(), text=text[2:-2].strip(), attrs={"display": "true"})]
        return [Node("paragraph", given or ids(), inlines=extract_inlines(e))]
    if e.tag in ("ul", "ol"):
        return [_list(e, given or ids(), ids)]
    if e.tag == "table":
        return [_table(e, given or ids(), ids)]
    if e.tag == "hr":
        return [Node("page_break" if "page-break" in kind else "horizontal_rule", given or ids())]
    if e.tag == "img":
        return [_image(e, given or ids())] if e.attrs.get("src") else []
    if e.tag == "figure":
        if "chart" in kind:
            return [Node("chart", given or ids(), text=e.text().strip())]
        images, captions = e.all("img"), e.all("figcaption")
        if not images or not images[0].attrs.get("src"):
            return []
        node = _image(images[0], given or ids())
        node.attrs["caption"] = captions[0].text().strip() if captions else None
        return [node]
    if e.tag == "pre":
        code = (e.all("code") or [e])[0]
        language = next((c.removeprefix("language-") for c in code.attrs.get("class", "").split() if c.startswith("language-")), None)
        return [Node("code", given or ids(), text=code.text(), attrs={"language": language})]
    wrap = {"blockquote": "quote"}.get(e.tag)
    if e.tag == "aside":
        wrap = next((k for k in ("footnote", "endnote", "comment") if k in kind), "text_box")
    if e.tag == "header" and e.attrs.get("role") == "banner":
        wrap = "header"
    if e.tag == "footer" and e.attrs.get("role") == "contentinfo":
        wrap = "footer"
    if wrap:
        node = Node(wrap, given or ids(), attrs={"ref": e.attrs.get("id", "").removeprefix("fn-") or None} if wrap in ("footnote", "endnote") else {})
        for block in blocks_of(e, ids):
            node.add(block, "content")
        return [node]
    return blocks_of(e, ids)


def _image(e: Element, node_id: str) -> Node:
    a = e.attrs
    return Node("image", node_id, text=a.get("alt") or None, attrs={"src": a.get("src"), "alt": a.get("alt"), "width": a.get("width"), "height": a.get("height")})


def _list(e: Element, node_id: str, ids: Ids) -> Node:
    start = int(e.attrs["start"]) if re.fullmatch(r"-?\d+", e.attrs.get("start", "")) else 1
    node = Node("list", node_id, ordered=e.tag == "ol", start=start if e.tag == "ol" else None)
    for li in (c for c in e.children if not isinstance(c, str) and c.tag == "li"):
        boxes = [c for c in li.children if not isinstance(c, str) and c.tag == "input" and c.attrs.get("type") == "checkbox"]
        nested = [c for c in li.children if not isinstance(c, str) and c.tag in ("ul", "ol")]
        own = Element("li", children=[c for c in li.children if c not in nested and c not in boxes])
        item = Node("list_item", ids(), kind="list_item", inlines=extract_inlines(own), checked=("checked" in boxes[0].attrs) if boxes else None)
        node.add(item, "items")
        for inner in nested:
            for child in _list(inner, "", ids).children:
                item.add(child, "children")
    return node


def _span(value: str | None) -> int:
    return max(1, int(value)) if value and value.isdigit() else 1


def _table(e: Element, node_id: str, ids: Ids) -> Node:
    table = Node("table", node_id, attrs={"split_id": e.attrs.get("data-split-id")})
    caption = next((c for c in e.children if not isinstance(c, str) and c.tag == "caption"), None)
    if caption is not None:
        table.attrs["caption"] = caption.text().strip()
    groups = [c for c in e.children if not isinstance(c, str)]
    rows = [(r, g.tag) for g in groups for r in ([g] if g.tag == "tr" else [c for c in g.children if not isinstance(c, str) and c.tag == "tr"] if g.tag in ("thead", "tbody", "tfoot") else [])]
    for tr, group in rows:
        row = Node("table_row", None, kind="table_row", is_header=group == "thead")
        for td in (c for c in tr.children if not isinstance(c, str) and c.tag in ("td", "th")):
            cell = Node("table_cell", td.attrs.get("data-bid") or ids(), kind="table_cell", row_span=_span(td.attrs.get("rowspan")), col_span=_span(td.attrs.get("colspan")), is_header=td.tag == "th")
            for block in blocks_of(td, ids) or [Node("paragraph", ids(), inlines=[])]:
                cell.add(block, "content")
            row.add(cell, "cells")
        table.add(row, "rows")
    return table


def _join_split_tables(blocks: list[Node]) -> list[Node]:
    """Tables in a row with the same split id are one table."""
    out: list[Node] = []
    for block in blocks:
        before = out[-1] if out else None
        if block.type == "table" and before is not None and before.type == "table" and block.attrs.get("split_id") and block.attrs["split_id"] == before.attrs.get("split_id"):
            before.children += block.children
        else:
            out.append(block)
    return out
