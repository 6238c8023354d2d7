"""Writers of one document's tree."""

from __future__ import annotations

import html as _html
import io
import json
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from ..model import Node

_SPECIAL = re.compile(r"([\\`*_~|\[\]])")


def _plain(text: str | None) -> str:
    return _SPECIAL.sub(r"\\\1", text or "")


def _line_start(text: str) -> str:
    text = re.sub(r"^(\d+)([.)])(\s)", r"\1\\\2\3", text)
    text = re.sub(r"^(#{1,6})(\s|$)", r"\\\1\2", text)
    return re.sub(r"^(>|!\[)", r"\\\1", re.sub(r"^([-+])(\s)", r"\\\1\2", text))


def _marked(text: str, marks: list[tuple[str, str]]) -> str:
    core = text.strip()
    if not core or not marks:
        return text
    head, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    for left, right in marks:
        core = left + core + right
    return head + core + tail


def _merged(inlines: list[dict] | None) -> list[dict]:
    out: list[dict] = []
    for i in inlines or []:
        if out and i["type"] == out[-1]["type"] == "text" and all(i[k] == out[-1][k] for k in i if k != "text"):
            out[-1] = out[-1] | {"text": (out[-1]["text"] or "") + (i["text"] or "")}
        else:
            out.append(dict(i))
    return out


def inlines_md(inlines: list[dict] | None) -> str:
    out = ""
    for i in _merged(inlines):
        kind = i["type"]
        if kind == "link":
            out += f"[{_plain(i['text'])}]({i['url'] or ''})"
        elif kind == "equation":
            out += f"${i['latex'] or ''}$"
        elif kind in ("footnote_ref", "endnote_ref"):
            out += f"[^{i['ref']}]"
        elif kind == "code" or i["font"] == "Courier New":
            out += f"`{i['text'] or ''}`"
        elif kind == "image":
            out += f"![{_plain(i['text'])}]({i['url'] or ''})"
        else:
            marks = []
            for flag, left, right in (("bold", "**", "**"), ("italic", "*", "*"), ("strike", "~~", "~~"), ("underline", "<u>", "</u>"), ("superscript", "<sup>", "</sup>"), ("subscript", "<sub>", "</sub>")):
                if i[flag]:
                    marks.append((left, right))
            out += _marked(_plain(i["text"]), marks)
    return out


def to_markdown(blocks: list[Node], embed_ids: bool = False) -> str:
    parts = [p for p in (block_md(b, embed_ids) for b in blocks) if p is not None]
    return "\n\n".join(parts) + ("\n" if parts else "")


def block_md(b: Node, ids: bool = False) -> str | None:
    body = _body_md(b, ids)
    if ids and b.node_id and (body is not None or b.type == "paragraph"):
        return f"<!-- id: {b.node_id} -->" + (f"\n{body}" if body else "")
    return body


def _body_md(b: Node, ids: bool) -> str | None:
    kind, a = b.type, b.attrs
    if kind == "heading":
        return "#" * min(6, max(1, b.level or 1)) + " " + _plain(b.text)
    if kind == "paragraph":
        return _line_start(inlines_md(b.inlines)) or None
    if kind == "list":
        lines, number = [], b.start if b.start is not None else 1
        for item in b.children:
            lines += [f"<!-- item: {item.node_id} -->"] * bool(ids and item.node_id)
            lines.append((f"{number}. " if b.ordered else "- ") + inlines_md(item.inlines))
            for child in item.children:
                lines += [f"  <!-- item: {child.node_id} -->"] * bool(ids and child.node_id)
                lines.append("  - " + inlines_md(child.inlines))
            number += 1
        return "\n".join(lines)
    if kind == "table":
        return table_html(b, ids, lambda inl: _html_inline_text(inl))
    if kind == "code":
        fence = "`" * max(3, 1 + max((len(m) for m in re.findall(r"`+", b.text or "")), default=0))
        return f"{fence}{a.get('language') or ''}\n{b.text or ''}\n{fence}"
    if kind == "image":
        return f"![{_plain(a.get('alt'))}]({a.get('src') or ''})"
    if kind == "equation":
        return f"$${b.text or ''}$$"
    if kind == "quote":
        return "\n>\n".join("\n".join("> " + line for line in (block_md(c) or "").split("\n")) for c in b.children)
    if kind in ("footnote", "endnote"):
        return f"[^{a.get('ref') or ''}]: " + " ".join(filter(None, (block_md(c) for c in b.children)))
    if kind in ("text_box", "header", "footer", "drawing"):
        return "\n\n".join(filter(None, (block_md(c) for c in b.children))) or None
    if kind in ("horizontal_rule", "page_break"):
        return "---"
    if kind in ("field", "chart", "text_art"):
        return _plain(b.text) or None
    return None


def _html_inline_text(inlines: list[dict] | None) -> str:
    return "".join(inline_html(i) for i in _merged(inlines))


def inline_html(i: dict) -> str:
    kind, text = i["type"], _html.escape(i["text"] or "").replace("\n", "<br>")
    if kind == "equation":
        return f"\\({_html.escape(i['latex'] or '', quote=False)}\\)"
    if kind in ("footnote_ref", "endnote_ref"):
        word = kind.removesuffix("_ref")
        return f'<sup class="{word}-ref">{_html.escape(i["ref"] or "")}</sup>'
    if kind == "code":
        return f"<code>{text}</code>"
    if kind == "image":
        return f'<img src="{_html.escape(i["url"] or "")}" alt="{text}">'
    css = "".join(f"{name}:{value};" for name, value in (("color", i["color"]), ("font-family", f"'{i['font']}'" if i["font"] else None), ("font-size", f"{i['size']:g}pt" if i["size"] else None)) if value)
    if css:
        text = f'<span style="{_html.escape(css)}">{text}</span>'
    for flag, tag in (("subscript", "sub"), ("superscript", "sup"), ("strike", "del"), ("underline", "u"), ("italic", "em"), ("bold", "strong")):
        if i[flag]:
            text = f"<{tag}>{text}</{tag}>"
    return f'<a href="{_html.escape(i["url"] or "")}">{text}</a>' if kind == "link" or i["url"] else text


def table_html(b: Node, ids: bool, inlines) -> str:
    rows = []
    for row in b.children:
        cells = []
        for cell in row.children:
            tag = "th" if cell.is_header or row.is_header else "td"
            extra = "".join(f' {name}="{n}"' for name, n in (("rowspan", cell.row_span), ("colspan", cell.col_span)) if n and n > 1)
            extra += f' data-bid="{cell.node_id}"' if ids and cell.node_id else ""
            parts = [inlines(c.inlines) if c.type == "paragraph" else block_html(c, ids) for c in cell.children]
            cells.append(f"<{tag}{extra}>{'<br>'.join(parts)}</{tag}>")
        rows.append(f"<tr>{''.join(cells)}</tr>")
    bid = f' data-bid="{b.node_id}"' if ids and b.node_id else ""
    return f"<table{bid}>\n" + "\n".join(rows) + "\n</table>"


def to_html(blocks: list[Node], title: str = "", lang: str = "en", embed_ids: bool = False) -> str:
    notes = [b for b in blocks if b.type == "endnote"]
    heads, feet = ([b for b in blocks if b.type == kind] for kind in ("header", "footer"))
    flow = [b for b in blocks if b.type not in ("endnote", "header", "footer")]
    body = "\n".join(filter(None, (block_html(b, embed_ids) for b in [*heads, *flow, *notes, *feet])))
    return f'<!DOCTYPE html>\n<html lang="{lang}">\n<head>\n<meta charset="utf-8">\n<title>{_html.escape(title)}</title>\n</head>\n<body>\n{body}\n</body>\n</html>\n'


def block_html(b: Node, ids: bool = False) -> str:
    bid = f' data-bid="{b.node_id}"' if ids and b.node_id else ""
    kind, a = b.type, b.attrs
    inner = lambda: "\n".join(block_html(c, ids) for c in b.children)
    if kind == "heading":
        level = min(6, max(1, b.level or 1))
        return f"<h{level}{bid}>{_html_inline_text(b.inlines) if b.inlines else _html.escape(b.text or '')}</h{level}>"
    if kind == "paragraph":
        return f"<p{bid}>{_html_inline_text(b.inlines) or '&nbsp;'}</p>"
    if kind == "list":
        tag = "ol" if b.ordered else "ul"
        start = f' start="{b.start}"' if b.ordered and b.start not in (None, 1) else ""
        return f"<{tag}{start}{bid}>\n" + "\n".join(_item_html(i) for i in b.children) + f"\n</{tag}>"
    if kind == "table":
        return table_html(b, ids, _html_inline_text)
    if kind == "image":
        image = f'<img src="{_html.escape(a.get("src") or "")}" alt="{_html.escape(a.get("alt") or "")}">'
        caption = f"<figcaption>{_html.escape(a['caption'])}</figcaption>" if a.get("caption") else ""
        return f"<figure{bid}>{image}{caption}</figure>"
    if kind == "code":
        language = f' class="language-{_html.escape(a["language"])}"' if a.get("language") else ""
        return f"<pre{bid}><code{language}>{_html.escape(b.text or '')}</code></pre>"
    if kind == "quote":
        return f"<blockquote{bid}>\n{inner()}\n</blockquote>"
    if kind == "equation":
        return f"<p{bid}>$${_html.escape(b.text or '', quote=False)}$$</p>"
    if kind in ("footnote", "endnote"):
        return f'<aside class="{kind}" id="fn-{_html.escape(a.get("ref") or "")}"{bid}>\n{inner()}\n</aside>'
    if kind == "header":
        return f'<header role="banner"{bid}>\n{inner()}\n</header>'
    if kind == "footer":
        return f'<footer role="contentinfo"{bid}>\n{inner()}\n</footer>'
    if kind == "horizontal_rule":
        return f"<hr{bid}>"
    if kind == "page_break":
        return f'<hr class="page-break"{bid}>'
    if kind in ("text_box", "drawing", "comment"):
        return f'<aside class="{kind.replace("_", "-")}"{" hidden" if kind == "comment" else ""}{bid}>\n{inner()}\n</aside>'
    if kind in ("field", "chart", "text_art"):
        return f'<div class="{kind.replace("_", "-")}"{bid}>{_html.escape(b.text or "")}</div>'
    if kind == "bookmark":
        return f'<a class="bookmark" id="{_html.escape(a.get("name") or "")}"></a>'
    return f'<div class="{kind}"{bid}></div>'


def _item_html(item: Node) -> str:
    box = "" if item.checked is None else f'<input type="checkbox"{" checked" if item.checked else ""}>'
    nested = "<ul>" + "".join(_item_html(c) for c in item.children) + "</ul>" if item.children else ""
    return f"<li>{box}{_html_inline_text(item.inlines)}{nested}</li>"


def simplified(b: Node) -> dict | None:
    """A compact form for readers of JSON: nothing that is null, no unknown blocks."""
    if b.type == "unknown":
        return None
    out: dict = {"id": b.node_id, "type": b.type, "level": b.level, "ordered": b.ordered, "start": b.start, "checked": b.checked}
    if b.inlines is not None:
        out["inlines"] = [{"idx": n} | {k: v for k, v in i.items() if v is not None} for n, i in enumerate(b.inlines)]
    if b.text is not None:
        out["text"] = b.text
    if b.kind == "table_cell":
        out |= {"row_span": b.row_span, "col_span": b.col_span}
    out |= b.attrs
    for child in b.children:
        made = simplified(child)
        if made is not None:
            out.setdefault(child.slot, []).append(made)
    return {k: v for k, v in out.items() if v is not None}


def to_json(blocks: list[Node], source_format: str = "docloom") -> str:
    made = [s for s in map(simplified, blocks) if s is not None]
    return json.dumps({"source_format": source_format, "blocks": made}, ensure_ascii=False, separators=(",", ":"))


# Names of the parts and namespaces of the format.
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_M = "http://schemas.openxmlformats.org/officeDocument/2006/math"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml."


class _Docx:
    def __init__(self):
        self.links: list[str] = []
        self.notes: list[tuple[str, str]] = []
        self.lists: list[bool] = []

    def run(self, i: dict) -> str:
        if i["type"] == "equation":
            import xml.etree.ElementTree as ET

            from ..functions.equations import latex_to_omml

            ET.register_namespace("m", _M)
            return ET.tostring(latex_to_omml(i["latex"] or ""), encoding="unicode")
        if i["type"] in ("footnote_ref", "endnote_ref"):
            word = i["type"].removesuffix("_ref")
            known = [r for k, r in self.notes if k == word]
            if i["ref"] not in known:
                return ""
            return f'<w:r><w:{word}Reference w:id="{known.index(i["ref"]) + 1}"/></w:r>'
        pr = "".join(f"<w:{tag}/>" for tag, flag in (("b", "bold"), ("i", "italic"), ("strike", "strike")) if i[flag])
        if i["font"]:
            pr = f"<w:rFonts w:ascii={quoteattr(i['font'])} w:hAnsi={quoteattr(i['font'])}/>" + pr
        if re.fullmatch(r"#[0-9a-f]{6}", i["color"] or ""):
            pr += f'<w:color w:val="{i["color"][1:].upper()}"/>'
        if i["size"]:
            pr += f'<w:sz w:val="{round(i["size"] * 2)}"/>'
        if i["underline"]:
            pr += '<w:u w:val="single"/>'
        if i["superscript"] or i["subscript"]:
            pr += f'<w:vertAlign w:val="{"superscript" if i["superscript"] else "subscript"}"/>'
        pieces = re.split(r"([\n\t])", _xml_safe(i["text"]))
        body = "".join("<w:br/>" if p == "\n" else "<w:tab/>" if p == "\t" else f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in pieces if p)
        run = f"<w:r>{f'<w:rPr>{pr}</w:rPr>' if pr else ''}{body}</w:r>"
        if i["type"] == "link" and i["url"]:
            self.links.append(i["url"])
            return f'<w:hyperlink r:id="rLink{len(self.links)}">{run}</w:hyperlink>'
        return run

    def paragraph(self, inlines: list[dict] | None, pr: str = "") -> str:
        return f"<w:p>{f'<w:pPr>{pr}</w:pPr>' if pr else ''}{''.join(self.run(i) for i in inlines or [])}</w:p>"

    def text(self, text: str | None, pr: str = "", font: str | None = None) -> str:
        from ..model import inline

        return self.paragraph([inline(text=text or "", font=font)], pr)

    def blocks(self, blocks: list[Node]) -> str:
        return "".join(map(self.block, blocks))

    def block(self, b: Node) -> str:
        if b.type == "heading":
            style = f'<w:pStyle w:val="Heading{min(6, max(1, b.level or 1))}"/>'
            return self.paragraph(b.inlines, style) if b.inlines else self.text(b.text, style)
        if b.type == "paragraph":
            return self.paragraph(b.inlines)
        if b.type == "list":
            self.lists.append(bool(b.ordered))
            number, out = len(self.lists), ""
            for item in b.children:
                for level, x in [(0, item), *[(1, c) for c in item.children]]:
                    out += self.paragraph(x.inlines, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')
            return out
        if b.type == "table":
            return self.table(b)
        if b.type == "code":
            return self.text(b.text, font="Courier New")
        if b.type in ("quote", "text_box", "header", "footer", "comment", "drawing"):
            return self.blocks(b.children)
        if b.type == "equation":
            from ..model import inline

            return self.paragraph([inline("equation", latex=b.text)])
        if b.type == "page_break":
            return '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
        if b.type in ("footnote", "endnote", "bookmark", "unknown", "horizontal_rule"):
            return ""
        return self.text(b.attrs.get("alt") or b.text) if (b.attrs.get("alt") or b.text) else ""

    def table(self, b: Node) -> str:
        rows, below = "", {}
        for row in b.children:
            cells, column, cells_left = "", 0, list(row.children)
            while cells_left or any(c >= column and n for c, (n, _) in below.items()):
                if below.get(column, (0, 1))[0]:
                    left, width = below[column]
                    below[column] = (left - 1, width)
                    cells += f'<w:tc><w:tcPr><w:gridSpan w:val="{width}"/><w:vMerge/></w:tcPr><w:p/></w:tc>'
                    column += width
                    continue
                if not cells_left:
                    column += 1
                    continue
                cell = cells_left.pop(0)
                width, height = cell.col_span or 1, cell.row_span or 1
                pr = f'<w:gridSpan w:val="{width}"/>' if width > 1 else ""
                if height > 1:
                    pr += '<w:vMerge w:val="restart"/>'
                    below[column] = (height - 1, width)
                content = self.blocks(cell.children)
                cells += f"<w:tc><w:tcPr>{pr}</w:tcPr>{content if content.endswith('</w:p>') else content + '<w:p/>'}</w:tc>"
                column += width
            rows += f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if row.is_header else ''}{cells}</w:tr>"
        return f'<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/></w:tblPr><w:tblGrid/>{rows}</w:tbl>'


def _xml_safe(text: str | None) -> str:
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]", "", text or "")


def to_docx(blocks: list[Node]) -> bytes:
    """A package that Word opens: styles, numbering, notes and links of the document."""
    d = _Docx()
    d.notes = [(b.type, b.attrs.get("ref")) for b in blocks if b.type in ("footnote", "endnote")]
    body = d.blocks(blocks)
    space = f'xmlns:w="{_W}" xmlns:r="{_R}" xmlns:m="{_M}"'
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    parts = {"word/document.xml": f"<w:document {space}><w:body>{body}<w:sectPr/></w:body></w:document>"}
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:pPr><w:outlineLvl w:val="{n - 1}"/></w:pPr></w:style>' for n in range(1, 7))
    parts["word/styles.xml"] = f"<w:styles {space}>{styles}</w:styles>"
    kinds = "".join(f'<w:abstractNum w:abstractNumId="{i}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{"decimal" if o else "bullet"}"/></w:lvl></w:abstractNum>' for i, o in enumerate(d.lists, 1))
    nums = "".join(f'<w:num w:numId="{i}"><w:abstractNumId w:val="{i}"/></w:num>' for i in range(1, len(d.lists) + 1))
    parts["word/numbering.xml"] = f"<w:numbering {space}>{kinds}{nums}</w:numbering>"
    for word in ("footnote", "endnote"):
        found = [b for b in blocks if b.type == word]
        if found:
            inner = "".join(f'<w:{word} w:id="{n}">{d.blocks(b.children)}</w:{word}>' for n, b in enumerate(found, 1))
            parts[f"word/{word}s.xml"] = f"<w:{word}s {space}>{inner}</w:{word}s>"
    kinds_of = {"word/document.xml": "document.main", "word/styles.xml": "styles", "word/numbering.xml": "numbering", "word/footnotes.xml": "footnotes", "word/endnotes.xml": "endnotes"}
    overrides = "".join(f'<Override PartName="/{name}" ContentType="{_MAIN}{kinds_of[name]}+xml"/>' for name in parts)
    rels = "".join(f'<Relationship Id="rPart{n}" Type="{_R}/{name[5:-4]}" Target="{name[5:]}"/>' for n, name in enumerate(parts) if name != "word/document.xml")
    rels += "".join(f'<Relationship Id="rLink{n}" Type="{_R}/hyperlink" Target={quoteattr(_xml_safe(u))} TargetMode="External"/>' for n, u in enumerate(d.links, 1))
    files = {
        "[Content_Types].xml": f'<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_R}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{_RELS}">{rels}</Relationships>',
    } | parts
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, xml in files.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(info, head + xml)
    return out.getvalue()
