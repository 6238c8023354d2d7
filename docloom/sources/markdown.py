"""Markdown, line by line.

Blocks are found by the first test that a line passes: id comment, blank line, footnote
definition, fence, ATX heading, thematic break, HTML table, pipe rows, list items, paragraph. A
paragraph ends at a blank line, at a line that opens another block, or after a line with two
trailing spaces. Lists are flat. ``<!-- id: X -->`` before a block and ``<!-- item: X -->`` before a
list item name what follows; cells are named by ``data-bid``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..model import Ids, Node, inline

# Fixed by Markdown and by the id comments of exported documents.
_ID = re.compile(r"^\s*<!--\s*(?:id:\s*(?P<named>\S+)|(?P<plain>b_\d{4,}))\s*-->\s*$")
_ITEM = re.compile(r"^\s*<!--\s*item:\s*(\S+)\s*-->\s*$")
_FOOTNOTE = re.compile(r"^\[\^([^\]]+)\]:\s*(.*)$")
_FENCE = re.compile(r"^(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*$")
_RULE = re.compile(r"^\s*(-{3,}|\*{3,}|_{3,})\s*$")
_BULLET = re.compile(r"^\s*[-*+]\s+(.*)$")
_NUMBER = re.compile(r"^\s*(\d+)[.)]\s+(.*)$")
_SEPARATOR = re.compile(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")
_ESCAPED = re.compile(r"\\([\\`*_{}\[\]()#+\-.!|~<>])")

_SPECIAL = re.compile(r"(?P<code>`+)(?P<body>.+?)(?P=code)|\$(?P<math>[^$\n]+)\$|\[\^(?P<note>[^\]]+)\]|\[(?P<label>[^\]]*)\]\((?P<url>[^)\s]*)\)")
_MARKS = (("***", ("bold", "italic")), ("**", ("bold",)), ("*", ("italic",)), ("~~", ("strike",)), ("<u>", ("underline",)))


#: Escaped signs stand in this plane of private characters while inlines are told apart.
_HELD = 0x10F000
_SIGNS_HELD = {_HELD + ord(c): c for c in "\\`*_{}[]()#+-.!|~<>"}
_ESCAPES_HELD = {k: "\\" + c for k, c in _SIGNS_HELD.items()}


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text).translate(_SIGNS_HELD)


def parse_inlines(text: str) -> list[dict]:
    """Code spans, formulas, note references and links first, then emphasis in what is left; escaped signs mark nothing."""
    out: list[dict] = []
    at = 0
    text = _ESCAPED.sub(lambda m: chr(_HELD + ord(m[1])), text)
    for match in _SPECIAL.finditer(text):
        _emphasis(text[at : match.start()], {}, out)
        if match["code"]:
            out.append(inline(text=match["body"].translate(_ESCAPES_HELD), font="Courier New"))
        elif match["math"] is not None:
            out.append(inline("equation", latex=match["math"].translate(_ESCAPES_HELD)))
        elif match["note"] is not None:
            out.append(inline("footnote_ref", ref=match["note"].translate(_SIGNS_HELD)))
        else:
            out.append(inline("link", unescape(match["label"]), url=match["url"].translate(_SIGNS_HELD)))
        at = match.end()
    _emphasis(text[at:], {}, out)
    return out


def _emphasis(text: str, style: dict, out: list[dict]) -> None:
    """Emphasis with an explicit stack of what is still to do, so nesting has no limit."""
    todo = [(text, style)]
    while todo:
        part, flags = todo.pop()
        best = None
        for mark, names in _MARKS:
            closing = "</u>" if mark == "<u>" else mark
            start = part.find(mark)
            if start < 0:
                continue
            stop = part.find(closing, start + len(mark))
            if stop > start + len(mark) and (best is None or start < best[0]):
                best = (start, stop, mark, closing, names)
        if best is None:
            if part:
                out.append(inline(text=unescape(part), **flags))
            continue
        start, stop, mark, closing, names = best
        if start:
            out.append(inline(text=unescape(part[:start]), **flags))
        todo.append((part[stop + len(closing) :], flags))
        todo.append((part[start + len(mark) : stop], flags | dict.fromkeys(names, True)))


def paragraph(text: str, node_id: str, slot: str = "blocks") -> Node:
    return Node("paragraph", node_id, slot=slot, inlines=parse_inlines(text), raw=text)


def line_kind(line: str) -> str:
    """The block that a line opens outside fences."""
    for kind, pattern in (("id", _ID), ("item", _ITEM), ("footnote", _FOOTNOTE), ("fence", _FENCE), ("heading", _HEADING), ("rule", _RULE)):
        if pattern.match(line):
            return kind
    if not line.strip():
        return "blank"
    if line.lstrip().lower().startswith("<table"):
        return "html_table"
    if line.lstrip().startswith("|"):
        return "pipe"
    if _BULLET.match(line):
        return "bullet"
    if _NUMBER.match(line):
        return "number"
    return "text"


def parse_markdown(text: str, ids: Ids | None = None) -> list[Node]:
    ids = ids or Ids()
    lines = text.splitlines()
    kinds = [line_kind(line) for line in lines]
    blocks: list[Node] = []
    pending: str | None = None
    i = 0

    def take_id() -> str:
        nonlocal pending
        taken, pending = pending, None
        return taken or ids()

    while i < len(lines):
        line, kind = lines[i], kinds[i]
        if kind == "id":
            if pending:
                blocks.append(Node("paragraph", pending, inlines=[], raw=""))
            found = _ID.match(line)
            pending = found["named"] or found["plain"]
            i += 1
        elif kind == "blank":
            i += 1
        elif kind == "footnote":
            ref, body = _FOOTNOTE.match(line).groups()
            note = Node("footnote", take_id(), attrs={"ref": ref})
            note.add(paragraph(body, ids()), "content")
            blocks.append(note)
            i += 1
        elif kind == "fence":
            fence, info = _FENCE.match(line).groups()
            end = i + 1
            while end < len(lines) and not re.match(rf"^{re.escape(fence[0])}{{{len(fence)},}}\s*$", lines[end]):
                end += 1
            blocks.append(Node("code", take_id(), text="\n".join(lines[i + 1 : end]), attrs={"language": info.strip() or None}))
            i = end + 1
        elif kind == "heading":
            marks, title = _HEADING.match(line).groups()
            blocks.append(Node("heading", take_id(), text=unescape(title), level=len(marks), raw=title))
            i += 1
        elif kind == "rule":
            blocks.append(Node("horizontal_rule", take_id()))
            i += 1
        elif kind == "html_table":
            end = i
            while end < len(lines) and "</table>" not in lines[end].lower():
                end += 1
            blocks.append(_html_table("\n".join(lines[i : end + 1]), take_id(), ids))
            i = end + 1
        elif kind == "pipe":
            end = i
            while end < len(lines) and kinds[end] == "pipe":
                end += 1
            blocks.append(_pipe_table(lines[i:end], take_id(), ids))
            i = end
        elif kind == "item" and (i + 1 == len(lines) or kinds[i + 1] not in ("bullet", "number")):
            i += 1  # names nothing
        elif kind in ("item", "bullet", "number"):
            first = i + (kind == "item")
            line, kind, end = lines[first], kinds[first], i
            while end < len(lines) and (kinds[end] == kind or (kinds[end] == "item" and kinds[end + 1 : end + 2] == [kind])):
                end += 1
            pattern = _BULLET if kind == "bullet" else _NUMBER
            node = Node("list", take_id(), ordered=kind == "number", start=int(_NUMBER.match(line)[1]) if kind == "number" else None)
            named = None
            for item, item_kind in zip(lines[i:end], kinds[i:end], strict=True):
                if item_kind == "item":
                    named = _ITEM.match(item)[1]
                    continue
                text_of = pattern.match(item).groups()[-1]
                node.add(Node("list_item", named or ids(), kind="list_item", inlines=parse_inlines(text_of), raw=text_of), "items")
                named = None
            blocks.append(node)
            i = end
        else:
            held: list[str] = []
            while i < len(lines) and kinds[i] == "text":
                held.append(lines[i].rstrip())
                i += 1
                if lines[i - 1].endswith("  "):
                    break
            blocks.append(paragraph(" ".join(held), take_id()))
    if pending:
        blocks.append(Node("paragraph", pending, inlines=[], raw=""))
    return blocks


def _row(cells: list[tuple[list[Node], dict]], ids: Ids, header: bool) -> Node:
    row = Node("table_row", None, kind="table_row", is_header=header)
    for content, known in cells:
        cell = Node("table_cell", known.pop("node_id", None) or ids(), kind="table_cell", **({"row_span": 1, "col_span": 1} | known))
        for block in content:
            cell.add(block, "content")
        row.add(cell, "cells")
    return row


def _pipe_table(lines: list[str], node_id: str, ids: Ids) -> Node:
    table = Node("table", node_id)
    ruled = any(_SEPARATOR.match(line) for line in lines)
    for line in lines:
        if _SEPARATOR.match(line):
            continue
        cells = re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))
        made = []
        for cell in cells:
            cell_id = ids()
            made.append(([paragraph(cell.strip(), ids())], {"node_id": cell_id}))
        table.add(_row(made, ids, ruled and not table.children), "rows")
    return table


_TR, _TD = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.S | re.I), re.compile(r"<(td|th)\b([^>]*)>(.*?)</\1>", re.S | re.I)
_ATTR = re.compile(r"([\w-]+)\s*=\s*\"([^\"]*)\"")


def _html_table(html: str, node_id: str, ids: Ids) -> Node:
    opening = dict(_ATTR.findall(html[: html.find(">")]))
    table = Node("table", opening.get("data-bid") or node_id)
    for body in _TR.findall(html):
        made = []
        for tag, attrs, content in _TD.findall(body):
            known = dict(_ATTR.findall(attrs))
            cell_id = known.get("data-bid") or ids()
            parts = [p for p in re.split(r"<br\s*/?>", content, flags=re.I)] or [""]
            made.append(
                (
                    [Node("paragraph", ids(), inlines=html_inlines(p.strip()), raw=p.strip()) for p in parts],
                    {"node_id": cell_id, "row_span": int(known.get("rowspan", 1)), "col_span": int(known.get("colspan", 1)), "is_header": tag.lower() == "th", "attrs": {"width": known["width"]} if known.get("width") else {}},
                )
            )
        table.add(_row(made, ids, bool(made) and all(c[1].get("is_header") for c in made)), "rows")
    return table


_TAGGED = re.compile(r"<(/?)(strong|b|em|i|del|u)\b[^>]*>|<[^>]+>", re.I)
_FLAG = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "del": "strike", "u": "underline"}


def html_inlines(html: str) -> list[dict]:
    out, flags, at = [], {}, 0
    for match in [*_TAGGED.finditer(html), None]:
        text = html[at : match.start() if match else len(html)]
        if text:
            plain = text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
            out.append(inline(text=plain, **{k: True for k, n in flags.items() if n > 0}))
        if match:
            at = match.end()
            if match[2]:
                name = _FLAG[match[2].lower()]
                flags[name] = max(0, flags.get(name, 0) + (-1 if match[1] else 1))
    return out


def lines_of(blocks: list[Node]) -> Iterator[str]:
    """The raw text of top-level blocks, for tests."""
    for block in blocks:
        yield block.raw or block.text or ""
