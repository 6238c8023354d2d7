import pytest

from docloom.functions.equations import latex_to_omml, omml_to_latex
from docloom.model import Node, rows_of, tree_of
from docloom.sinks.writers import to_docx, to_html, to_json, to_markdown
from docloom.sources import detect_files, parse_documents
from docloom.sources.docx import parse_docx
from docloom.sources.html import parse_html
from docloom.sources.markdown import parse_inlines, parse_markdown
from docloom.sources.xml import parse_xml
from docloom.validation.rules import docx_violations

MD = """# Title

Some *slanted* and **bold** text
over two lines.

- one
- two

3. three
4. four

```py
x = 1
```

| a | b |
| --- | --- |
| 1 | 2 |

---
[^n]: a note
last
"""


def test_markdown_blocks():
    blocks = parse_markdown(MD)
    assert [b.type for b in blocks] == ["heading", "paragraph", "list", "list", "code", "table", "horizontal_rule", "footnote", "paragraph"]
    assert blocks[1].raw == "Some *slanted* and **bold** text over two lines."
    assert (blocks[3].start, blocks[3].ordered, len(blocks[3].children)) == (3, True, 2)
    assert blocks[4].text == "x = 1" and blocks[4].attrs["language"] == "py"
    ids = [r["node_id"] for r in rows_of(1, blocks) if r["node_id"]]
    assert len(ids) == len(set(ids))


def test_markdown_edges():
    assert parse_markdown("") == []
    assert [b.text for b in parse_markdown("```\nopen\n\nend")] == ["open\n\nend"]
    two = parse_markdown("<!-- b_0007 -->\n<!-- b_0009 -->\ntext")
    assert [(b.node_id, b.raw) for b in two] == [("b_0007", ""), ("b_0009", "text")]
    assert [b.raw for b in parse_markdown("a  \nb")] == ["a", "b"]


def test_inlines():
    found = parse_inlines("a **b *c* d** `d*` [e](u) $x$ [^1] \\*")
    assert [(i["type"], i["text"], i["bold"], i["italic"]) for i in found][:3] == [("text", "a ", None, None), ("text", "b ", True, None), ("text", "c", True, True)]
    assert {i["type"] for i in found} == {"text", "link", "equation", "footnote_ref"}
    assert found[-1]["text"].endswith("*")


def test_html_unclosed_and_nested():
    blocks = parse_html("<body><nav><p>x</p></nav><article><h1>T &amp; t</h1><p>one<p><b>two</b><ul><li><input type=checkbox>a<ul><li>b</ul><li><input type=checkbox checked>c</ul></article></body>")
    assert [b.type for b in blocks] == ["heading", "paragraph", "paragraph", "list"]
    assert blocks[0].text == "T & t"
    items = blocks[3].children
    assert [i.checked for i in items] == [False, True] and len(items[0].children) == 1


def test_html_tables_and_splits():
    html = '<table data-split-id="s"><tr><td rowspan=2>a</td><td>b</td></tr></table><table data-split-id="s"><tr><th>c</th></tr></table>'
    (table,) = parse_html(html)
    assert len(table.children) == 2 and table.children[0].children[0].row_span == 2


def test_docbook_and_generic():
    doc = '<article xmlns="http://docbook.org/ns/docbook"><title>T</title><section><title>S</title><para>x <emphasis role="bold">y</emphasis><footnote><para>n</para></footnote></para><itemizedlist><listitem><para>i</para></listitem></itemizedlist><table><title>t</title><tgroup cols="2"><colspec colname="a"/><colspec colname="b"/><tbody><row><entry namest="a" nameend="b" morerows="1">z</entry></row></tbody></tgroup></table></section></article>'
    blocks = parse_xml(doc)
    assert [b.type for b in blocks] == ["heading", "heading", "paragraph", "footnote", "list", "table"]
    cell = blocks[5].children[0].children[0]
    assert (cell.col_span, cell.row_span) == (2, 2)
    assert [b.type for b in parse_xml("<r><title>a</title><p>b</p><pre>c</pre><ul><li>d</li></ul><img src='e'/><zz/></r>")] == ["heading", "paragraph", "code", "list", "image", "unknown"]


def test_entities_are_not_expanded():
    attack = '<!DOCTYPE r [<!ENTITY x SYSTEM "file:///etc/passwd"><!ENTITY y "boom">]><r><p>a&x;b&y;</p></r>'
    text = "".join(i["text"] or "" for b in parse_xml(attack) for i in b.inlines or [])
    assert "root" not in text and "boom" not in text


def test_trees_survive_rows_and_json():
    blocks = parse_markdown(MD)
    again = tree_of(rows_of(5, blocks))
    assert rows_of(5, again) == rows_of(5, blocks)
    assert '"type":"table"' in to_json(blocks)


def test_markdown_round_trip():
    text = to_markdown(parse_markdown("# a\n\nb **c** \\* d\n\n- x\n- y\n\n```\nq\n```\n"))
    assert to_markdown(parse_markdown(text)) == text


def test_docx_round_trip_is_valid():
    html = "<h2>H</h2><p>a <b>b</b> <a href='http://x'>l</a></p><ul><li>i<ul><li>j</li></ul></li></ul><table><tr><td rowspan=2>p</td><td>q</td></tr><tr><td>r</td></tr></table>"
    package = to_docx([*parse_html(html), *parse_markdown("x[^1] $\\frac{a}{b}$\n\n[^1]: note")])
    assert docx_violations(package) == []
    blocks = parse_docx(package)
    assert [b.type for b in blocks] == ["heading", "paragraph", "list", "table", "paragraph", "footnote"]
    assert blocks[3].children[0].children[0].row_span == 2
    assert [i["url"] for i in blocks[1].inlines if i["type"] == "link"] == ["http://x"]
    assert [i["latex"] for i in blocks[4].inlines if i["type"] == "equation"] == ["\\frac{a}{b}"]
    assert docx_violations(b"junk") == [("D1", "not a zip archive")]


@pytest.mark.parametrize("latex", ["x^2", "a_{12}", "\\sqrt[3]{x}", "\\frac{1}{2}", "\\sum_{i=1}^{n}{i}", "\\begin{matrix}a & b \\\\ c & d\\end{matrix}", "\\hat{x}", "\\left(a\\right)"])
def test_equations(latex):
    assert omml_to_latex(latex_to_omml(latex)) == latex


def test_bad_documents_become_unknown_blocks(spark):
    docs = spark.createDataFrame([(1, "<a><b></a>"), (2, None), (3, "<a><p>x</p></a>")], "doc_id long, text string")
    rows = parse_documents(docs, "xml").collect()
    assert {(r["doc_id"], r["type"]) for r in rows} == {(1, "unknown"), (3, "paragraph")}
    assert parse_documents(docs.limit(0), "md").count() == 0


def test_detection(spark):
    package = to_docx([Node("paragraph", "b_0001", inlines=[])])
    files = spark.createDataFrame([("a/x.md", b"# x"), ("y", package), ("z.pdf", b"nope"), ("q", b"%PDF-1"), ("u", b"..")], "path string, content binary")
    found = {r["path"]: (r["format"], r["source"], r["warning"] is not None) for r in detect_files(files).collect()}
    assert found == {"a/x.md": ("md", "extension", False), "y": ("docx", "magic", False), "z.pdf": ("pdf", "extension", True), "q": ("pdf", "magic", False), "u": (None, "none", False)}


def test_html_output_escapes():
    assert "&lt;x&gt;" in to_html(parse_markdown("a <x> b"))


def test_hwpx_round_trip_is_valid():
    from docloom.sinks.hwpx import to_hwpx
    from docloom.sources.hwpx import parse_hwpx
    from docloom.validation.rules import hwpx_violations

    html = "<h2>H</h2><p>a <b>b</b> <a href='http://x'>l</a></p><table><tr><td rowspan=2>p</td><td>q</td></tr><tr><td>r</td></tr></table>"
    package = to_hwpx([*parse_html(html), *parse_markdown("x[^1]\n\n[^1]: note")])
    assert hwpx_violations(package) == []
    blocks = parse_hwpx(package)
    assert [b.type for b in blocks] == ["heading", "paragraph", "table", "paragraph", "footnote"]
    assert blocks[0].level == 2 and blocks[2].children[0].children[0].row_span == 2
    assert [i["url"] for i in blocks[1].inlines if i["type"] == "link"] == ["http://x"]
    assert [i["text"] for i in blocks[1].inlines if i["bold"]] == ["b"]
    assert {r for r, _ in hwpx_violations(b"junk")} == {"HX2"}


def test_hwp_records():
    from docloom.sources import hwp

    stream = hwp.make_record(hwp.PARA_HEADER, 0, bytes(24)) + hwp.make_record(hwp.PARA_TEXT, 1, b"x" * 5000) + b"\x01"
    assert [(t, v, len(p)) for t, v, p in hwp.iter_records(stream)] == [(hwp.PARA_HEADER, 0, 24), (hwp.PARA_TEXT, 1, 5000)]
    tab = "a".encode("utf-16-le") + b"\x09\x00" + bytes(14) + "b😀\r z".encode("utf-16-le")
    assert hwp.plain_text(tab) == "a\tb😀" and hwp.control_id(b" lbt") == "tbl "


def compound_file(streams):
    """A compound file with all streams in regular sectors."""
    import struct

    names, entries, sectors, fat = ["Root Entry", "BodyText"], [], [], []

    def chain(data):
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, max(1, len(data)), 512)]
        sectors.extend(parts)
        fat.extend([first + k + 1 for k in range(len(parts) - 1)] + [0xFFFFFFFE])
        return first

    def entry(name, kind, left=0xFFFFFFFF, right=0xFFFFFFFF, child=0xFFFFFFFF, start=0xFFFFFFFE, size=0):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    del names
    top = [n for n in streams if "/" not in n]
    body = [n for n in streams if "/" in n]
    order = top + body
    place = {n: 2 + k for k, n in enumerate(order)}
    starts = {n: chain(streams[n]) for n in order}
    siblings = {n: place[g[k + 1]] if k + 1 < len(g) else 0xFFFFFFFF for g in (top, body) for k, n in enumerate(g)}
    entries.append(entry("Root Entry", 5, child=1))
    entries.append(entry("BodyText", 1, right=place[top[0]], child=place[body[0]]))
    entries += [entry(n.rpartition("/")[2], 2, right=siblings[n], start=starts[n], size=len(streams[n])) for n in order]
    directory = chain(b"".join(entries))
    where = len(sectors)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIIII", 1, directory, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, where)
    return head.ljust(512, b"\xff") + b"".join(sectors) + table


def test_hwp_file():
    import struct
    import zlib

    from docloom.sources import hwp

    def deflated(data):
        c = zlib.compressobj(9, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()

    def word(text):
        return struct.pack("<H", len(text)) + text.encode("utf-16-le")

    def paragraph(level, text, style=0, shapes=((0, 0),)):
        body = text.encode("utf-16-le") + b"\r\0"
        head = struct.pack("<IIHBBHHHI", len(body) // 2, 0, 0, style, 0, len(shapes), 0, 0, 0)
        return hwp.make_record(hwp.PARA_HEADER, level, head) + hwp.make_record(hwp.PARA_TEXT, level + 1, body) + hwp.make_record(hwp.PARA_CHAR_SHAPE, level + 1, b"".join(struct.pack("<II", *s) for s in shapes))

    shape = lambda bits, color: bytes(42) + struct.pack("<iI", 1200, bits) + bytes(2) + color + bytes(18)
    info = hwp.make_record(hwp.FACE_NAME, 0, b"\0" + word("Batang")) + hwp.make_record(hwp.CHAR_SHAPE, 0, shape(0, bytes(4))) + hwp.make_record(hwp.CHAR_SHAPE, 0, shape(2, b"\xff\0\0\0"))
    info += hwp.make_record(hwp.STYLE, 0, word("Normal")) + hwp.make_record(hwp.STYLE, 0, word("개요 2"))
    cell = lambda c, r, text: hwp.make_record(hwp.LIST_HEADER, 2, struct.pack("<IIHHHH", 1, 0, c, r, 1, 1) + bytes(20)) + paragraph(2, text)
    holder = hwp.make_record(hwp.PARA_HEADER, 0, bytes(24)) + hwp.make_record(hwp.CTRL_HEADER, 1, b" lbt") + hwp.make_record(hwp.TABLE, 2, bytes(8)) + cell(0, 0, "a") + cell(1, 0, "b") + cell(0, 1, "c")
    holder += hwp.make_record(hwp.CTRL_HEADER, 1, b"deqe") + hwp.make_record(hwp.EQUATION, 2, bytes(4) + word("a over b"))
    section = paragraph(0, "Title", 1) + paragraph(0, "plain red", 0, ((0, 0), (6, 1))) + holder
    content = compound_file({"FileHeader": b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", 1), "DocInfo": deflated(info), "BodyText/Section0": deflated(section)})
    blocks = hwp.parse_hwp(content)
    assert [b.type for b in blocks] == ["heading", "paragraph", "table", "equation"]
    assert (blocks[0].level, blocks[0].text) == (2, "Title")
    assert [(i["text"], i["bold"], i["color"], i["font"]) for i in blocks[1].inlines] == [("plain ", None, None, "Batang"), ("red", True, "#ff0000", "Batang")]
    assert [[c.children[0].inlines[0]["text"] for c in r.children] for r in blocks[2].children] == [["a", "b"], ["c"]]
    assert blocks[3].text == "\\frac{a}{b}"


def pdf_file(pages):
    import zlib

    kids = b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + kids + b"] >>", b"<< /Type /Font /BaseFont /Helvetica >>", b"<< /Type /Font /BaseFont /Helvetica-Bold >>"]
    for page in pages:
        data = zlib.compress(page)
        objects.append(b"<< /Type /Page /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (len(objects) + 2))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))


def test_pdf(spark):
    from docloom.operators import layout
    from docloom.sources.pdf import parse_pdf, pdf_spans

    text = b"BT /F1 9 Tf 72 780 Td (running head) Tj ET BT /F1 24 Tf 72 700 Td (Title \\(%d\\)) Tj ET BT /F1 12 Tf 72 660 Td (the first line of text) Tj 0 -20 Td [(sec) -300 (ond)] TJ T* 14 TL /F2 12 Tf T* <626f6c64> Tj /F1 12 Tf T* (1. item) Tj T* (2. next) Tj ET"
    content = pdf_file([text % 1, text % 2])
    kinds = [(b.type, b.level, b.text) for b in parse_pdf(content)]
    assert kinds == [("heading", 1, "Title (1)"), ("paragraph", None, None), ("paragraph", None, None), ("heading", 4, "bold"), ("list", None, None), ("heading", 1, "Title (2)"), ("paragraph", None, None), ("paragraph", None, None), ("heading", 4, "bold"), ("list", None, None)]
    spans = pdf_spans(spark.createDataFrame([(1, content), (2, None), (3, b"%PDF junk")], "doc_id long, content binary"))
    rows = layout.blocks(spans, 792.0).orderBy("page", "line").collect()
    assert [r["type"] for r in rows] == ["heading", "paragraph", "paragraph", "heading", "list", "list"] * 2
    assert rows[2]["text"] == "sec ond" and rows[4]["text"] == "item"


def test_hwp_writer():
    import os

    from docloom.sinks.hwp import patch_hwp_blocks, section_records, to_hwp
    from docloom.sources.hwp import PARA_HEADER, parse_hwp
    from docloom.sources.ole import CompoundFile, write_compound
    from docloom.validation.hwp import file_rules

    md = "# Title\n\npara **bold** and *it* é😀\n\n- a\n- b\n\n3. one\n\n| a | b |\n|---|---|\n| c | d |\n\n```py\nx=1\n```\n\ntext[^1]\n\n[^1]: note text\n"
    blocks = [*parse_markdown(md), *parse_html("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>")]
    content = to_hwp(blocks)
    back = parse_hwp(content)
    assert [b.type for b in back] == ["heading", "paragraph", "paragraph", "paragraph", "paragraph", "table", "paragraph", "paragraph", "footnote", "table"]
    assert [(i["text"], i["bold"], i["italic"]) for i in back[1].inlines] == [("para ", None, None), ("bold", True, None), (" and ", None, None), ("it", None, True), (" é😀", None, None)]
    assert [n.row_span for n in back[-1].walk() if n.type == "table_cell"] == [2, 1, 1]
    assert list(file_rules(content)) == [] == list(file_rules(to_hwp([])))
    assert sum(t == PARA_HEADER for t, _, _ in section_records(content)) == 19
    back[1].inlines = [back[1].inlines[0] | {"text": "changed"}]
    patched = patch_hwp_blocks(content, [back[1]])
    again = parse_hwp(patched)
    assert [i["text"] for i in again[1].inlines] == ["changed"] and again[0].text == "Title" and len(again) == len(back) and list(file_rules(patched)) == []
    streams = {"A": b"x", "B/C": os.urandom(5000), "B/D": b"", "B/E/F": os.urandom(9 << 20)}
    file = CompoundFile(write_compound(streams))
    assert {n: file.read(n) for n in file.streams} == streams


def test_hwp_repairs():
    import struct

    from docloom.sinks.hwp import deflated, to_hwp
    from docloom.sources import hwp
    from docloom.sources.ole import CompoundFile, write_compound
    from docloom.validation.hwp import file_rules, validate_and_fix

    file = CompoundFile(to_hwp(parse_markdown("one\n\ntwo\n\n| a |\n|---|\n| b |\n")))
    streams = {n: file.read(n) for n in file.streams}
    trees = hwp.record_trees(hwp.inflated(streams["BodyText/Section0"], True))
    trees[0].payload = trees[0].payload[:4] + bytes(4) + trees[0].payload[8:]
    trees[1].payload = struct.pack("<I", 77) + trees[1].payload[4:]
    for c in trees[1].children:
        if c.tag == hwp.PARA_CHAR_SHAPE:
            c.payload += struct.pack("<II", 500, 0)
    trees[2].children = [c for c in trees[2].children if c.tag != hwp.PARA_LINE_SEG]
    broken = write_compound(streams | {"BodyText/Section0": deflated(b"".join(t.to_bytes() for t in trees))})
    assert {r for r, _, _ in file_rules(broken)} == {"R1", "R2", "R3", "R4", "I6"}
    fixed, left = validate_and_fix(broken)
    assert left == [] and [b.type for b in hwp.parse_hwp(fixed)] == ["paragraph", "paragraph", "table"]
    assert {r for r, _, _ in file_rules(b"junk")} == {"R5"}
    assert {r for r, _, _ in file_rules(write_compound({"FileHeader": streams["FileHeader"]}))} == {"R6"}
    info = hwp.inflated(streams["DocInfo"], True)
    damaged = {"DocInfo": deflated(info + hwp.make_record(0x12, 0, b"\x02\x00") + hwp.make_record(hwp.CHAR_SHAPE, 0, b"\x63\x00" * 37))}
    assert {r for r, _, _ in file_rules(write_compound(streams | damaged))} == {"I1", "I2", "I10"}
    two = write_compound(streams | {"BodyText/Section1": streams["BodyText/Section0"]})
    assert {r for r, _, _ in file_rules(two)} == {"I7"}


def test_html_faults():
    from docloom.validation.rules import html_faults

    assert html_faults("<!DOCTYPE html><html><body><p>a<br><p>b<ul><li>x<li>y</ul></body></html>") == []
    assert html_faults("<div><b>x</div></i><a href=1 href=2>") == ["div ends before b", "end of i without its start", "attribute href twice in a", "a never ends"]
    assert html_faults(None) == [] and html_faults("<span/>") == ["span cannot close itself", "span never ends"]


def test_ids_in_markdown():
    from docloom.sinks.writers import to_markdown

    md = '<!-- id: first-1 -->\n# H\n\n<!-- id: b_0042 -->\ntext\n\n<!-- item: i1 -->\n- a\n<!-- item: i2 -->\n- b\n\n<!-- b_0050 -->\nold\n\n<!-- item: lost -->\n\n<table data-bid="t1">\n<tr><td data-bid="c1" width="30">x</td></tr>\n</table>\n'
    blocks = parse_markdown(md)
    assert [b.node_id for b in blocks][:2] == ["first-1", "b_0042"] and blocks[3].node_id == "b_0050" and blocks[4].node_id == "t1"
    assert [i.node_id for i in blocks[2].children] == ["i1", "i2"]
    cell = blocks[4].children[0].children[0]
    assert cell.node_id == "c1" and cell.attrs == {"width": "30"}
    again = parse_markdown(to_markdown(blocks, embed_ids=True))
    assert [n.node_id for b in again for n in b.walk() if n.type != "paragraph"] == [n.node_id for b in blocks for n in b.walk() if n.type != "paragraph"]


def test_escaped_signs_mark_nothing():
    said = "a*b* **c** `d` [e](f) ~~g~~ \\ ***h*** <u>x</u>"
    from docloom.sinks.writers import inlines_md

    found = parse_inlines(inlines_md(parse_inlines(r"a\*b\* \*\*c\*\* \`d\` \[e\](f) \~\~g\~\~ \\ \*\*\*h\*\*\* x")))
    assert "".join(i["text"] for i in found) == said.replace("<u>x</u>", "x") and not any(i["bold"] or i["italic"] or i["strike"] for i in found)
    assert [i["text"] for i in parse_inlines(r"`a\*b`")] == [r"a\*b"]


def marked_pdf():
    ruled = b"1 w 72 600 m 272 600 l S 72 580 m 272 580 l S 72 560 m 272 560 l S 72 560 m 72 600 l S 172 560 m 172 600 l S 272 560 m 272 600 l S "
    texts = b"BT /F1 20 Tf 72 700 Td (Report) Tj ET BT /F1 10 Tf 72 650 Td (read the site here for more of it) Tj 6 -65 Td (a) Tj 100 0 Td (b) Tj -100 -20 Td (c) Tj 120 0 Td (d) Tj ET "
    more = b"0 0 5 5 re n q 50 0 0 40 72 500 cm /Im1 Do /Im1 Do Q q 2 0 0 2 72 400 cm /Im1 Do Q 72 110 m 300 110 l S BT /F1 10 Tf 72 80 Td (1. a note) Tj 0 300 Td (last words of the page) Tj ET "
    curves = b" ".join(b"%d 300 m %d 310 %d 340 %d 360 c S" % (100 + 9 * i, 105 + 9 * i, 110 + 9 * i, 120 + 9 * i) for i in range(8))
    page = ruled + texts + more + curves
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R /AcroForm 9 0 R >>", b"<< /Type /Pages /Kids [4 0 R] /MediaBox [0 0 612 792] >>", b"<< /Type /Font /BaseFont /Helvetica >>",
        b"<< /Type /Page /Resources << /Font << /F1 3 0 R >> /XObject << /Im1 6 0 R >> >> /Contents 5 0 R /Annots [7 0 R] >>",
        b"<< /Length %d >>\nstream\n" % len(page) + page + b"\nendstream",
        b"<< /Subtype /Image /Width 2 /Height 1 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Length 6 >>\nstream\n\xff\0\0\0\0\xff\nendstream",
        b"<< /Subtype /Link /Rect [70 645 200 665] /A << /S /URI /URI (https://example.org/\\(x\\)) >> >>", b"<< /Title (A \\(title\\)) /Author <FEFF00E9> >>",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Info 8 0 R >>"


def test_pdf_marks():
    from docloom.sources import pdfmarks
    from docloom.sources.pdf import Pdf, parse_pdf

    content = marked_pdf()
    blocks = parse_pdf(content)
    assert [b.type for b in blocks] == ["heading", "paragraph", "table", "image", "paragraph", "drawing", "footnote"]
    assert (blocks[1].inlines[0]["type"], blocks[1].inlines[0]["url"]) == ("link", "https://example.org/(x)") and blocks[4].inlines[0]["type"] == "text"
    assert [[c.children[0].inlines[0]["text"] for c in r.children] for r in blocks[2].children] == [["a", "b"], ["c", "d"]]
    assert blocks[3].attrs["src"].startswith("data:image/png;base64,iVBORw0KGgo") and (blocks[3].attrs["width"], blocks[3].attrs["height"]) == (50, 40)
    assert blocks[6].attrs == {"ref": "1"} and blocks[6].children[0].inlines[0]["text"] == "a note"
    pdf = Pdf(content)
    assert pdfmarks.metadata(content, pdf) == {"title": "A (title)", "author": "é", "created_at": None, "modified_at": None, "page_width": 612.0, "page_height": 792.0}
    assert {"form_fields", "table_structure_heuristic"} <= set(pdfmarks.dropped_features(pdf, blocks)) and "document_outline" not in pdfmarks.dropped_features(pdf, blocks)
    frame = pdfmarks.Marks(rects=[(5.0, 5.0, 607.0, 787.0)])
    assert pdfmarks.grids(frame, (0, 0, 612, 792)) == [] and pdfmarks.grids(pdfmarks.Marks(rects=[(50.0, 50.0, 90.0, 90.0)]), (0, 0, 612, 792))[0].box == (50, 50, 90, 90)
    apart = pdfmarks.Marks(rects=[(50.0, y, 90.0, y + 10.0) for y in (50.0, 60.0, 300.0, 310.0)])
    assert [g.ys for g in pdfmarks.grids(apart, (0, 0, 612, 792))] == [[50, 60, 70], [300, 310, 320]]
    assert parse_pdf(b"%PDF-1.4") == []


def test_docx_sections_properties_and_spacings(spark):
    import io
    import zipfile

    from docloom.sources.docxmeta import docx_properties, docx_sections

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    first = '<w:sectPr><w:type w:val="continuous"/><w:pgSz w:w="12240" w:h="15840" w:orient="landscape"/><w:pgMar w:top="1440" w:gutter="x"/><w:cols w:num="2" w:space="720" w:sep="1"><w:col w:w="2000"/></w:cols><w:pgNumType w:start="3" w:fmt="upperRoman"/><w:pgBorders><w:top w:val="single" w:sz="12" w:color="auto"/><w:left w:val="none"/></w:pgBorders><w:lnNumType/></w:sectPr>'
    body = f'<w:p><w:pPr><w:spacing w:before="100"/>{first}</w:pPr><w:r><w:t>a</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="S"/></w:pPr><w:r><w:t>b</w:t></w:r></w:p><w:sectPr/>'
    styles = '<w:docDefaults/><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:pPr><w:spacing w:after="200" w:line="276" w:lineRule="auto"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="S"><w:pPr><w:spacing w:line="300" w:lineRule="exact"/></w:pPr></w:style>'
    core = '<c:coreProperties xmlns:c="x" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><dc:creator>me</dc:creator><dc:language/></c:coreProperties>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, xml in {"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {w}>{styles}</w:styles>", "docProps/core.xml": core}.items():
            archive.writestr(name, xml)
    package = out.getvalue()
    assert [b.attrs for b in parse_docx(package)] == [{"format.space_before": "5pt", "format.space_after": "10pt", "format.line_spacing": "115%"}, {"format.line_spacing": "15pt"}]
    files = spark.createDataFrame([(1, package), (2, None), (3, b"junk")], "doc_id long, content binary")
    one, two = docx_sections(files).orderBy("n").collect()
    assert (one["page_width"], one["page_height"], one["margin_top"], one["margin_gutter"], one["orientation"], one["break_type"]) == (612.0, 792.0, 72.0, None, "landscape", "continuous")
    assert (one["start_page_number"], one["page_number_format"], one["border_top"], one["border_left"], one["line_numbering"]) == (3, "roman_upper", "1.5pt solid #000000", None, True)
    assert one["columns"].asDict() == {"count": 2, "gap": 36.0, "separator": True, "same_width": False, "widths": [100.0]}
    assert two["page_width"] is None and two["columns"] is None
    assert [r.asDict() for r in docx_properties(files).collect()] == [{"doc_id": 1, "title": "T", "author": "me", "created_at": None, "modified_at": None, "language": None}]
