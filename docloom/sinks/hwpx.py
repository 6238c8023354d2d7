"""HWPX packages from a tree of blocks."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from ..model import Node, inline
from .writers import _xml_safe

# Fixed values of the format: its type, namespaces and the seven languages of fonts.
MIME = "application/hwp+zip"
HP, HS, HH, HC = (f"http://www.hancom.co.kr/hwpml/2011/{n}" for n in ("paragraph", "section", "head", "core"))
LANGUAGES = "HANGUL LATIN HANJA JAPANESE OTHER SYMBOL USER".split()
_SPACE = f'xmlns:hp="{HP}" xmlns:hs="{HS}" xmlns:hh="{HH}" xmlns:hc="{HC}"'
_OPF = 'xmlns:opf="http://www.idpf.org/2007/opf/"'


class _Writer:
    """Collects the character styles that the text uses; each distinct one gets an id in order of its first use."""

    def __init__(self):
        self.styles: dict[tuple, int] = {self._key(inline()): 0}
        self.fonts: dict[str, int] = {"바탕": 0}
        self.notes: dict[tuple[str, str], Node] = {}

    @staticmethod
    def _key(i: dict) -> tuple:
        return tuple(i[k] for k in ("bold", "italic", "underline", "strike", "superscript", "subscript", "color", "font", "size"))

    def run(self, i: dict) -> str:
        number = self.styles.setdefault(self._key(i), len(self.styles))
        if i["font"]:
            self.fonts.setdefault(i["font"], len(self.fonts))
        if i["type"] == "equation":
            return f'<hp:run charPrIDRef="{number}"><hp:equation><hp:script>{escape(_xml_safe(i["latex"]))}</hp:script></hp:equation></hp:run>'
        if i["type"] in ("footnote_ref", "endnote_ref"):
            kind = i["type"].removesuffix("_ref")
            note = self.notes.pop((kind, i["ref"] or ""), None)
            if note is None:
                return ""
            tag = kind.replace("note", "Note")
            return f'<hp:run charPrIDRef="{number}"><hp:ctrl><hp:{tag} number={quoteattr(i["ref"] or "")}>{self.sublist(note.children)}</hp:{tag}></hp:ctrl></hp:run>'
        text = escape(_xml_safe(i["text"])).replace("\t", "<hp:tab/>").replace("\n", "<hp:lineBreak/>")
        run = f'<hp:run charPrIDRef="{number}"><hp:t>{text}</hp:t></hp:run>'
        if i["url"]:
            begin = f'<hp:run charPrIDRef="{number}"><hp:ctrl><hp:fieldBegin type="HYPERLINK"><hp:parameters><hp:stringParam name="Command">{escape(_xml_safe(i["url"]))}</hp:stringParam></hp:parameters></hp:fieldBegin></hp:ctrl></hp:run>'
            return begin + run + f'<hp:run charPrIDRef="{number}"><hp:ctrl><hp:fieldEnd/></hp:ctrl></hp:run>'
        return run

    def paragraph(self, inlines: list[dict] | None, style: int = 0, inner: str = "", extra: str = "") -> str:
        runs = "".join(self.run(i) for i in inlines or []) + (f'<hp:run charPrIDRef="0">{inner}</hp:run>' if inner else "")
        return f'<hp:p paraPrIDRef="0" styleIDRef="{style}"{extra}>{runs}</hp:p>'

    def sublist(self, blocks: list[Node]) -> str:
        return f"<hp:subList>{self.blocks(blocks) or self.paragraph([])}</hp:subList>"

    def blocks(self, blocks: list[Node]) -> str:
        self.notes |= {(b.type, b.attrs.get("ref") or ""): b for b in blocks if b.type in ("footnote", "endnote")}
        return "".join(map(self.block, blocks))

    def block(self, b: Node) -> str:
        if b.type == "heading":
            return self.paragraph(b.inlines or [inline(text=b.text)], min(6, max(1, b.level or 1)))
        if b.type == "paragraph":
            return self.paragraph(b.inlines)
        if b.type == "list":
            out, number = "", b.start if b.start is not None else 1
            for item in b.children:
                out += self.paragraph([inline(text=f"{number}. " if b.ordered else "- "), *(item.inlines or [])])
                out += "".join(self.paragraph([inline(text="  - "), *(c.inlines or [])]) for c in item.children)
                number += 1
            return out
        if b.type == "table":
            rows = ""
            for r, row in enumerate(b.children):
                cells = ""
                for c, cell in enumerate(row.children):
                    cells += f'<hp:tc header="{int(bool(cell.is_header or row.is_header))}">{self.sublist(cell.children)}<hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="{cell.col_span or 1}" rowSpan="{cell.row_span or 1}"/></hp:tc>'
                rows += f"<hp:tr>{cells}</hp:tr>"
            return self.paragraph([], inner=f'<hp:tbl rowCnt="{len(b.children)}">{rows}</hp:tbl>')
        if b.type == "equation":
            return self.paragraph([], inner=f"<hp:equation><hp:script>{escape(_xml_safe(b.text))}</hp:script></hp:equation>")
        if b.type in ("header", "footer"):
            return self.paragraph([], inner=f'<hp:ctrl><hp:{b.type} applyPageType="BOTH">{self.sublist(b.children)}</hp:{b.type}></hp:ctrl>')
        if b.type == "text_box":
            return self.paragraph([], inner=f"<hp:rect>{self.sublist(b.children)}</hp:rect>")
        if b.type in ("quote", "comment"):
            return self.blocks(b.children)
        if b.type == "page_break":
            return self.paragraph([], extra=' pageBreak="1"')
        if b.type == "code":
            return self.paragraph([inline(text=b.text, font="Courier New")])
        said = b.attrs.get("alt") or b.text
        return self.paragraph([inline(text=said)]) if said else ""


def to_hwpx(blocks: list[Node]) -> bytes:
    """A package with one section; pictures are named by their alternative text, drawings are left out."""
    w = _Writer()
    w.notes = {(b.type, b.attrs.get("ref") or ""): b for b in blocks if b.type in ("footnote", "endnote")}
    body = "".join(w.block(b) for b in blocks if b.type not in ("footnote", "endnote"))
    chars = ""
    for key, number in w.styles.items():
        bold, italic, underline, strike, sup, sub, color, font, size = key
        marks = "".join(f"<hh:{tag}/>" for tag, on in (("italic", italic), ("bold", bold), ("supscript", sup), ("subscript", sub)) if on)
        marks += '<hh:underline type="BOTTOM"/>' if underline else ""
        marks += '<hh:strikeout shape="SOLID"/>' if strike else ""
        ref = " ".join(f'{name.lower()}="{w.fonts.get(font, 0)}"' for name in LANGUAGES)
        chars += f'<hh:charPr id="{number}" height="{round((size or 10.0) * 100)}" textColor="{color or "#000000"}"><hh:fontRef {ref}/>{marks}</hh:charPr>'
    faces = "".join(f'<hh:fontface lang="{name}">' + "".join(f"<hh:font id=\"{n}\" face={quoteattr(face)}/>" for face, n in w.fonts.items()) + "</hh:fontface>" for name in LANGUAGES)
    styles = '<hh:style id="0" name="Normal"/>' + "".join(f'<hh:style id="{n}" name="개요 {n}"/>' for n in range(1, 7))
    head = f'<hh:head {_SPACE}><hh:refList><hh:fontfaces>{faces}</hh:fontfaces><hh:charProperties>{chars}</hh:charProperties><hh:paraProperties><hh:paraPr id="0"/></hh:paraProperties><hh:styles>{styles}</hh:styles></hh:refList></hh:head>'
    items = "".join(f'<opf:item id="{i}" href="{h}" media-type="application/xml"/>' for i, h in (("header", "Contents/header.xml"), ("section0", "Contents/section0.xml")))
    parts = {
        "version.xml": '<hv:HCFVersion xmlns:hv="http://www.hancom.co.kr/hwpml/2011/version" major="5" minor="1"/>',
        "META-INF/container.xml": '<ocf:container xmlns:ocf="urn:oasis:names:tc:opendocument:xmlns:container"><ocf:rootfiles><ocf:rootfile full-path="Contents/content.hpf" media-type="application/hwpml-package+xml"/></ocf:rootfiles></ocf:container>',
        "Contents/content.hpf": f'<opf:package {_OPF}><opf:manifest>{items}</opf:manifest><opf:spine><opf:itemref idref="section0"/></opf:spine></opf:package>',
        "Contents/header.xml": head,
        "Contents/section0.xml": f"<hs:sec {_SPACE}>{body or w.paragraph([])}</hs:sec>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), MIME, zipfile.ZIP_STORED)
        for name, xml in parts.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + xml, zipfile.ZIP_DEFLATED)
    return out.getvalue()
