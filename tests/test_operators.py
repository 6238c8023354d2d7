from pyspark.sql import functions as F

from docloom.api import Corpus
from docloom.functions import scalars
from docloom.operators import edit, query, structure, tables, text
from docloom.sources import parse_documents
from docloom.sources.plain import paragraph_nodes
from docloom.streaming.ingest import parse_stream, read_files


def nodes_of(spark, md):
    return parse_documents(spark.createDataFrame([(1, md)], "doc_id long, text string"), "md")


def test_merge_and_split_cells(spark):
    nodes = nodes_of(spark, "| a | b |\n| c | d |")
    table = nodes.where("type = 'table'").first()["node_id"]
    merged = tables.merge_cells(nodes, table, 0, 0, 1, 1)
    said = sorted((r["row_idx"], r["cell_idx"], r["text"]) for r in tables.cell_texts(merged).collect())
    assert said == [(0, 0, "a"), (0, 1, ""), (1, 0, ""), (1, 1, "")]
    assert [r["row_span"] for r in tables.cells(merged).where("row_idx = 0 and cell_idx = 0").collect()] == [2]
    assert tables.cells(tables.split_cell(merged, table, 0, 0)).where("row_span > 1").count() == 0
    assert tables.cells(tables.remove_rows(nodes, table, 0)).count() == 2
    assert sorted(r["text"] for r in tables.cell_texts(tables.remove_column(nodes, table, 1)).collect()) == ["a", "c"]


def test_grid_with_row_spans(spark):
    html = '<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table>'
    nodes = parse_documents(spark.createDataFrame([(1, html)], "doc_id long, text string"), "html")
    grid = {(r["row_idx"], r["cell_idx"]): r["grid_col"] for r in tables.grid_coordinates(nodes).collect()}
    assert grid == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 2}


def test_renumbering_keeps_subtrees(spark):
    nodes = nodes_of(spark, "a\n\n- x\n- y\n\nb")
    left = edit.remove_blocks(nodes, nodes.where("seq = 0").select("doc_id", "node_id"))
    rows = [(r["seq"], r["seq_end"], r["parent_seq"], r["ord"], r["type"]) for r in left.orderBy("seq").collect()]
    assert rows == [(0, 2, None, 0, "list"), (1, 1, 0, 0, "list_item"), (2, 2, 0, 1, "list_item"), (3, 3, None, 1, "paragraph")]
    assert query.subtree(left, left.where("type = 'list'")).count() == 3


def test_templates(spark):
    nodes = nodes_of(spark, "# {{a}}\n\nx {{b}} {{a}}")
    assert sorted(r["key"] for r in text.list_placeholders(nodes).collect()) == ["a", "a", "b"]
    done = text.fill_template(nodes, {"a": "{{b}}", "b": None})
    assert [r["t"] for r in done.orderBy("seq").select(query.own_text().alias("t")).collect()] == ["", "x  "]
    wanted = spark.createDataFrame([(1, "b_0002", 0, "k"), (1, "b_0002", 9, "k"), (1, "zz", 0, "k"), (1, "b_0001", None, "bad key")], "doc_id long, node_id string, inline_idx int, key string")
    put, refused = text.set_placeholders(nodes, wanted)
    assert put.where("seq = 1").select(query.own_text().alias("t")).first()["t"] == "{{k}}"
    assert sorted(r["reason"] for r in refused.collect()) == ["bad key", "no such block", "no such inline"]


def test_edits_of_headings(spark):
    nodes = nodes_of(spark, "# old\n\ntext")
    edits = spark.createDataFrame([(1, "b_0001", 0, "new", {"bold": "true"}), (1, "b_0002", 0, None, {"color": "#ff0000", "size": "12"})], "doc_id long, node_id string, inline_idx int, text string, fmt map<string,string>")
    rows = Corpus(nodes).apply_edits(edits).nodes.orderBy("seq").collect()
    assert rows[0]["text"] == "new" and rows[1]["inlines"][0]["color"] == "#ff0000" and rows[1]["inlines"][0]["size"] == 12.0
    assert rows[1]["inlines"][0]["text"] == "text"


def test_pagination_and_outline(spark):
    df = spark.createDataFrame([(1, i, 40.0, "page_break" if i == 3 else "paragraph") for i in range(6)], "doc_id long, seq int, h double, type string")
    assert [r["page"] for r in structure.paginate(df, "h", 100.0).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2]
    nodes = nodes_of(spark, "# a\n\n## b\n\n### c\n\n## d")
    assert [r["under"] for r in structure.outline(nodes).orderBy("seq").collect()] == [None, 0, 1, 0]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.parse_hex_color(F.lit("#FF000080")).alias("c"), scalars.parse_hex_color(F.lit("#12")).alias("bad"), scalars.to_hex_color(F.lit(1), F.lit(2), F.lit(255), F.lit(1.0)).alias("h"),
        scalars.from_pt(F.lit(0.125), "twip").alias("t"), scalars.is_block_id(F.lit("b_123")).alias("v"), scalars.line_spacing(F.lit("160%"), F.lit("percent")).alias("ls"),
    ).first()
    assert (row["c"]["r"], row["c"]["a"]) == (255, 128 / 255.0) and row["bad"] is None
    assert (row["h"], row["t"], row["v"], row["ls"]["kind"]) == ("#0102ff", 2, False, "ratio")
    scalars.register(spark)
    got = spark.sql("SELECT doc_escape_html('<\"&>') AS h, doc_escape_markdown('a*b') AS m").first()
    assert tuple(got) == ("&lt;&quot;&amp;&gt;", "a\\*b")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    nodes = paragraph_nodes(none)
    assert query.with_text_content(nodes).count() == 0 and text.find_text(nodes, "x").count() == 0
    assert edit.remove_blocks(nodes, nodes.select("doc_id", "node_id")).count() == 0
    assert Corpus(nodes).render("md").count() == 0


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# a\n\nb")
    (tmp_path / "in" / "b.html").write_text("<p>c</p>")
    stream = parse_stream(read_files(spark, str(tmp_path / "in"))).select("doc_id", "type")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["type"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["heading", "paragraph", "paragraph"]


def test_builder(spark):
    from docloom.builder import DocumentBuilder, page_settings, parse_json, to_nodes

    b = DocumentBuilder().heading(9, "t").paragraph("p", bold=True).footnote("n").table([["a", {"text": "b", "col_span": 2}], [None, "c"]]).list(["x"], ordered=True).code("c", "py").quote("q").link("l", "u").page_break()
    nodes = to_nodes(spark, {7: b})
    said = {r["type"]: r["text_content"] for r in query.with_text_content(nodes).where("depth = 0").collect()}
    assert said["table"] == "a b c" and said["footnote"] == "n" and said["quote"] == "q"
    assert nodes.where("type = 'heading'").first()["level"] == 6 and b.blocks[1].inlines[-1]["ref"] == "1"
    assert [n.type for n in parse_json('{"blocks": [{"type": "zzz", "text": "a"}, {"type": "equation", "latex": "x"}]}')] == ["paragraph", "equation"]
    assert page_settings("A4", "landscape", (10.0, None, None, None))["width"] == 841.89


def test_equation_scripts():
    from docloom.functions.script import script_to_latex

    cases = {"a over b": "\\frac{a}{b}", "ALPHA^2": "\\Alpha^{2}", "root 3 of x": "\\sqrt[3]{x}", "pmatrix{a & b # c & d}": "\\begin{pmatrix}a & b \\\\ c & d\\end{pmatrix}", "": "", 'x <= "if" y': "x \\leq \\text{if} y", "left ( a right )": "\\left( a \\right)"}
    for script, latex in cases.items():
        assert script_to_latex(script) == latex


def test_migration_round_trip(spark):
    from docloom.migration import v1_to_v2, v2_to_v1

    old = spark.createDataFrame([("chart", "12.0pt", "160%", "percent", "#AABBCC"), ("paragraph", "10mm", "20pt", "fixed", "red"), ("paragraph", "wide", None, None, None)], "type string, width string, line_spacing string, line_spacing_type string, color string")
    new = v1_to_v2(old).collect()
    assert [r["width"] for r in new][0] == 12.0 and abs(new[1]["width"] - 10 / 0.352778) < 1e-9 and new[2]["width"] is None
    assert (new[0]["line_spacing"]["kind"], new[1]["line_spacing"]["value"], new[0]["color"], new[1]["color"]) == ("ratio", 20.0, "#aabbcc", None)
    again = v2_to_v1(v1_to_v2(old)).collect()
    assert [(r["type"], r["width"], r["line_spacing"]) for r in again] == [("unknown", "12.0pt", "160%"), ("paragraph", "28.3pt", "20.0pt"), ("paragraph", None, None)]


def test_migration_of_nested_fields(spark):
    import pytest

    from docloom import migration as m

    schema = "type string, inlines array<struct<type:string,text:string,size:string,color:string>>, attrs map<string,string>"
    rows = [("chart", [("text", "a", "10.5pt", "#FF0000"), ("text", None, None, "red"), ("text", "c", "10mm", None)], {"width": "20mm", "format.space_before": "6pt", "background_color": "#ABCDEF", "color": "red", "z": "10pt", "numbering": "3"}), ("paragraph", None, None), ("image", [], {})]
    old = spark.createDataFrame(rows, schema)
    new = m.v1_to_v2(old).collect()
    assert [(i["text"], i["size"] and round(i["size"], 3), i["color"]) for i in new[0]["inlines"]] == [("a", 10.5, "#ff0000"), (None, None, None), ("c", 28.346, None)]
    assert {k: v[:6] for k, v in new[0]["attrs"].items()} == {"width": "56.692", "format.space_before": "6.0", "background_color": "#abcde"[:6], "z": "10pt", "numbering": "3"}
    assert (new[1]["inlines"], new[1]["attrs"], new[2]["attrs"]) == (None, None, {})
    again = m.v2_to_v1(m.v1_to_v2(old)).collect()
    assert [i["size"] for i in again[0]["inlines"]] == ["10.5pt", None, "28.3pt"] and again[0]["type"] == "unknown"
    assert again[0]["attrs"] == {"width": "56.7pt", "format.space_before": "6.0pt", "background_color": "#abcdef", "z": "10pt", "numbering": "3", "was": "chart"} and again[1]["attrs"] is None
    moved = m.collect_extensions(old, "hwp", ["numbering", "z"])
    assert [(r["extensions"], set(r["attrs"] or ())) for r in moved.collect()][0] == ({"hwp.z": "10pt", "hwp.numbering": "3"}, {"width", "format.space_before", "background_color", "color"})
    assert [r["extensions"] for r in moved.collect()][1:] == [{}, {}]
    back = m.look_up_extensions(moved, "hwp").collect()
    assert back[0]["attrs"] == rows[0][2] and back[0]["extensions"] == {}
    assert m.look_up_extensions(moved, "docx").collect()[0]["extensions"] == {"hwp.z": "10pt", "hwp.numbering": "3"}
    assert m.create_extension("pdf", a=1, b=None) == {"pdf.a": "1"}
    with pytest.raises(ValueError):
        m.create_extension("odt")
    meta = spark.createDataFrame([(1, "title", "t"), (1, "paper_width", "210mm"), (1, "gutter", "wide")], "doc_id long, name string, value string")
    assert [(r["name"], r["value"] and r["value"][:7]) for r in m.metadata_to_v2(meta).collect()] == [("title", "t"), ("page_width", "595.275"), ("gutter", None)]
    assert [(r["name"], r["value"]) for r in m.metadata_to_v1(m.metadata_to_v2(meta)).collect()] == [("title", "t"), ("paper_width", "210.0mm"), ("gutter", None)]


def test_hwp_rules(spark):
    import struct

    from docloom.sources import hwp

    info = hwp.make_record(17, 0, struct.pack("<15I", 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1)) + hwp.make_record(0x15, 0, bytes(56)) + hwp.make_record(0x1A, 0, b"\0\0") + hwp.make_record(0x15, 0, bytes(56)) + hwp.make_record(0x12, 0, b"")
    body = hwp.make_record(hwp.PARA_HEADER, 0, bytes(24)) + hwp.make_record(hwp.PARA_TEXT, 1, bytes(8)) + hwp.make_record(hwp.PARA_CHAR_SHAPE, 1, struct.pack("<IIII", 0, 0, 4, 1))
    records = hwp.records_of(spark.createDataFrame([(1, info), (2, body), (3, None)], "doc_id long, stream binary"))
    assert [(r["tag"], r["declared"], r["actual"]) for r in hwp.id_mapping_counts(records).collect()] == [(0x12, 0, 1)]
    assert [(r["tag"], r["before"]) for r in hwp.record_order(records).orderBy("seq").collect()] == [(0x15, 0x1A), (0x12, 0x15)]
    assert [(r["doc_id"], r["position"], r["signs"]) for r in hwp.character_shape_bounds(records).collect()] == [(2, 4, 4)]


def test_tools_and_command_line(spark, tmp_path):
    import io

    from docloom import tools
    from docloom.__main__ import main
    from docloom.sinks.hwp import to_hwp
    from docloom.sources.hwp import parse_hwp
    from docloom.sources.markdown import parse_markdown

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# T {{who}}\n\none\n\n- x\n- y\n")
    (folder / "b.md").write_text("# T {{who}}\n\ntwo\n\n- x\n- y\n")
    (folder / "c.hwp").write_bytes(to_hwp(parse_markdown("first\n\nsecond")))
    path = str(folder / "a.md")

    def run(*arguments):
        out = io.StringIO()
        return main(list(arguments), out), out.getvalue()

    assert run("inspect", str(folder))[1].count("\n") == 7
    assert run("convert", path, "-f", "html")[1].count("<li>") == 2
    assert run("validate", str(folder))[0] == 0
    code, said = run("diff", path, str(folder / "b.md"))
    assert code == 1 and "text changed" in said
    assert "hwp" in run("info", "hwp")[1] and run("info", "nothing")[0] == 2
    exported = run("export", path)[1]
    assert tools.parse_source_header(exported)["blocks"] == "3" and tools.parse_source_header("x") is None
    merged = tools.import_md(spark, path, exported.replace("one", "1").replace("- y", "- z")).collect()
    assert [r["inlines"][0]["text"] for r in sorted(merged, key=lambda r: r["seq"]) if r["inlines"]] == ["1", "x", "z"]
    (tmp_path / "c.md").write_text("<!-- id: b_0002 -->\nchanged\n")
    assert run("patch", str(folder / "c.hwp"), "--md", str(tmp_path / "c.md"), "-o", str(tmp_path / "d.hwp"))[0] == 0
    assert [b.inlines[0]["text"] for b in parse_hwp((tmp_path / "d.hwp").read_bytes())] == ["first", "changed"]
    assert [r["key"] for r in tools.list_placeholders(spark, path).collect()] == ["who"]
    assert tools.fill_template(spark, path, {"who": "me"}).where("type = 'heading'").first()["text"] == "T me"
    assert tools.apply_edits(spark, path, [{"block_id": "b_0002", "text": "new"}]).where("node_id = 'b_0002'").first()["inlines"][0]["text"] == "new"
    assert tools.insert_blocks(spark, path, [{"type": "paragraph", "text": "more"}], "b_0001").where("seq = 1").first()["inlines"][0]["text"] == "more"
    assert tools.remove_blocks(spark, path, ["b_0001"]).count() == 4
    assert "Tools" in tools.describe() and "paragraph" in tools.describe("blocks") and "Unknown" in tools.describe("x")


def test_registered_format(spark):
    from docloom.sinks import render_documents
    from docloom.sinks.writers import to_markdown
    from docloom.sources import registry
    from docloom.sources.markdown import parse_markdown

    registry.register(registry.FormatSpec("note", (".note",), "text/x-note", True, True), parse_markdown, to_markdown)
    docs = spark.createDataFrame([(1, "a\n\nb")], "doc_id long, text string")
    nodes = parse_documents(docs, "note")
    assert nodes.count() == 2 and render_documents(nodes, "note").first()["content"] == "a\n\nb\n"
    assert spark.range(1).select(registry.format_of(F.lit("x.NOTE"))).first()[0] == "note"
    registry.unregister("note")
    assert spark.range(1).select(registry.format_of(F.lit("x.NOTE"))).first()[0] is None


def test_nested_roots_and_null_ids(spark):
    from docloom.operators import edit, query

    nodes = parse_documents(spark.createDataFrame([(None, "> a\n\n- x\n- y\n\nlast"), (1, "- x\n- y")], "doc_id long, text string"), "md")
    lists = nodes.where("type = 'list'")
    both = lists.unionByName(nodes.where("kind = 'list_item'"))
    assert query.subtree(nodes, both).count() == 6
    assert query.marked_inside(nodes, lists, strict=True).where("_inside").count() == 4
    formats = spark.createDataFrame([(1, "b_0001", {"a": "1", "b": "2"})], "doc_id long, node_id string, fmt map<string,string>")
    once = edit.set_block_format(nodes, formats)
    twice = edit.set_block_format(once, spark.createDataFrame([(1, "b_0001", {"a": "3", "b": None})], "doc_id long, node_id string, fmt map<string,string>"))
    assert [(r["name"], r["value"]) for r in edit.get_block_format(twice, "b_0001").where("doc_id = 1").collect()] == [("a", "3")]
    meta = spark.createDataFrame([(1, "title", "x"), (1, "author", "y")], "doc_id long, name string, value string")
    changed = edit.set_metadata(meta, spark.createDataFrame([(1, "title", "z"), (1, "author", None)], "doc_id long, name string, value string"))
    assert [(r["name"], r["value"]) for r in changed.collect()] == [("title", "z")]


def boxes_of(spark, rows):
    return spark.createDataFrame(rows, "id long, page int, x0 double, y0 double, x1 double, y1 double")


def test_overlapping_boxes_are_all_pairs(spark):
    import random

    rng = random.Random(7)
    rows = []
    for k in range(400):
        x, y = rng.randrange(-60, 120, 7), rng.randrange(-60, 120, 7)
        rows.append((rng.choice([k, k, k, 3, None]), rng.choice([1, 1, 2, None]), float(x), float(y), float(x + rng.choice([-1, 0, 9, 30])), float(y + rng.choice([0, 8, 90]))))
    rows += [(1000 + k, 1, 5.0, 5.0, 15.0, 13.0) for k in range(300)]  # more than one piece of equal boxes
    for least in (0.0, 70.0):
        want = []
        for a in rows:
            for b in rows:
                if None not in (a[0], b[0], a[1]) and a[0] < b[0] and a[1] == b[1]:
                    width, height = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
                    if width > 0 and height > 0 and width * height > least:
                        want.append((a[1], a[0], b[0], width * height))
        found = structure.overlapping(boxes_of(spark, rows), "page", least)
        assert found.columns == ["page", "id", "other", "area"] and [t for _, t in found.dtypes] == ["int", "bigint", "bigint", "double"]
        assert len(want) > 40_000 and sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_equal_boxes_meet_once(spark):
    found = structure.overlapping(boxes_of(spark, [(k, 1, 5.0, 5.0, 15.0, 13.0) for k in range(600)]), "page")
    assert len(found.collect()) == 600 * 599 // 2
    node = found._jdf.queryExecution().executedPlan().executedPlan()
    while "Join" not in node.nodeName():
        node = node.plan() if "QueryStage" in node.nodeName() else node.children().head()
    assert node.metrics().apply("numOutputRows").value() < 600


def test_a_full_square_falls_to_many_tasks(spark):
    found = structure.overlapping(boxes_of(spark, [(k, 1, k / 40, 0.0, 40.0, 8.0) for k in range(1000)]), "page")
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 1000 * 999 // 2 and len(tasks) > 8
