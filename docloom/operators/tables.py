"""Tables: places on the grid, rows, columns and merged cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .edit import renumber
from .query import marked_inside, own_text


def cells(nodes: DataFrame) -> DataFrame:
    """One row per cell: its table's and row's seq, its place in the row and its spans."""
    rows = nodes.where("kind = 'table_row'").select("doc_id", F.col("seq").alias("row_seq"), F.col("parent_seq").alias("table_seq"), F.col("ord").alias("row_idx"))
    found = nodes.where("kind = 'table_cell'").select("doc_id", "seq", "node_id", F.col("parent_seq").alias("row_seq"), F.col("ord").alias("cell_idx"), F.coalesce("row_span", F.lit(1)).alias("row_span"), F.coalesce("col_span", F.lit(1)).alias("col_span"))
    return found.join(rows, ["doc_id", "row_seq"])


def grid_coordinates(nodes: DataFrame) -> DataFrame:
    """Cells with ``grid_row`` and ``grid_col``: each takes the first free column that earlier row spans leave.

    Tables without row spans take a running sum; only those with spans are swept by a fold over
    their cells, one table at a time.
    """
    found = cells(nodes)
    key = ["doc_id", "table_seq"]
    spanned = found.groupBy(*key).agg(F.max("row_span").alias("_most"))
    marked = found.join(spanned, key)
    before = Window.partitionBy(*key, "row_seq").orderBy("cell_idx").rowsBetween(Window.unboundedPreceding, -1)
    plain = marked.where("_most = 1").withColumn("grid_col", F.coalesce(F.sum("col_span").over(before), F.lit(0)).cast("int")).withColumn("grid_row", F.col("row_idx"))

    def sweep(pdf):
        taken: set[tuple[int, int]] = set()
        columns = []
        pdf = pdf.sort_values(["row_idx", "cell_idx"], kind="stable")
        at_row, at = None, 0
        for row, rs, cs in zip(pdf["row_idx"], pdf["row_span"], pdf["col_span"], strict=True):
            if row != at_row:
                at_row, at = row, 0
            while (row, at) in taken:
                at += 1
            columns.append(at)
            taken |= {(row + i, at + j) for i in range(rs) for j in range(cs)}
            at += cs
        return pdf.assign(grid_col=columns, grid_row=pdf["row_idx"])

    schema = T.StructType([*marked.schema.fields, T.StructField("grid_col", T.IntegerType()), T.StructField("grid_row", T.IntegerType())])
    swept = marked.where("_most > 1").groupBy(*key).applyInPandas(sweep, schema)
    return plain.unionByName(swept).select("doc_id", "table_seq", "seq", "node_id", "row_idx", "cell_idx", "row_span", "col_span", "grid_row", "grid_col")


def merge_cells(nodes: DataFrame, table_id: str, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """Spreads the cell at (r1, c1) over the rectangle and empties the others; none is removed."""
    table = nodes.where((F.col("type") == "table") & (F.col("node_id") == table_id)).select("doc_id", F.col("seq").alias("table_seq"))
    inside = cells(nodes).join(table, ["doc_id", "table_seq"]).where(F.col("row_idx").between(r1, r2) & F.col("cell_idx").between(c1, c2))
    first = (F.col("row_idx") == r1) & (F.col("cell_idx") == c1)
    marked = inside.select("doc_id", F.col("seq").alias("_cell"), first.alias("_first"))
    spread = nodes.join(marked, (nodes["doc_id"] == marked["doc_id"]) & (nodes["seq"] == F.col("_cell")), "left").select(nodes["*"], "_first")
    spread = spread.withColumns({"row_span": F.when(F.col("_first"), r2 - r1 + 1).otherwise(F.col("row_span")), "col_span": F.when(F.col("_first"), c2 - c1 + 1).otherwise(F.col("col_span"))}).drop("_first")
    emptied = marked.where(~F.col("_first")).select("doc_id", F.col("_cell").alias("seq"))
    return renumber(marked_inside(spread, emptied, strict=True).where("not _inside"), [F.col("seq")])


def split_cell(nodes: DataFrame, table_id: str, row: int, col: int) -> DataFrame:
    """Sets the spans of one cell back to 1."""
    table = nodes.where((F.col("type") == "table") & (F.col("node_id") == table_id)).select("doc_id", F.col("seq").alias("table_seq"))
    cell = cells(nodes).join(table, ["doc_id", "table_seq"]).where((F.col("row_idx") == row) & (F.col("cell_idx") == col)).select("doc_id", "seq", F.lit(True).alias("_hit"))
    one = lambda c: F.when(F.col("_hit"), 1).otherwise(F.col(c))
    return nodes.join(cell, ["doc_id", "seq"], "left").withColumns({"row_span": one("row_span"), "col_span": one("col_span")}).select(*nodes.columns)


def remove_rows(nodes: DataFrame, table_id: str, row: int) -> DataFrame:
    """Nodes without one row of a table."""
    gone = _rows_of(nodes, table_id).where(F.col("ord") == row)
    return renumber(marked_inside(nodes, gone).where("not _inside"), [F.col("seq")])


def _rows_of(nodes: DataFrame, table_id: str) -> DataFrame:
    table = nodes.where((F.col("type") == "table") & (F.col("node_id") == table_id)).select("doc_id", F.col("seq").alias("parent_seq"))
    return nodes.where("kind = 'table_row'").join(table, ["doc_id", "parent_seq"], "left_semi")


def _inserted(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` and the nodes ``new``, whose ``_at`` is what they stand after and whose ``seq`` is -1, -2, ... in their document."""
    both = nodes.withColumns({"_at": F.col("seq"), "_k": F.lit(0)}).unionByName(new.withColumn("_k", -F.col("seq")), allowMissingColumns=True)
    return renumber(both, [F.col("_at"), F.col("_k")])


def add_row(nodes: DataFrame, table_id: str, at: int | None = None, is_header: bool = False) -> DataFrame:
    """Adds a row of empty cells, as many as the table's first row has, at place ``at`` (default: the end).

    Cells are called ``<table>_r<place>c<number>``. Tables without rows stay as they are.
    """
    rows = _rows_of(nodes, table_id).select("doc_id", "seq", "seq_end", "parent_seq", "ord", "depth")
    count = nodes.where("kind = 'table_cell'").groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    first = rows.where("ord = 0").join(count, ["doc_id", "seq"], "left").select("doc_id", "parent_seq", F.coalesce("n", F.lit(0)).alias("n"))
    ahead = rows if at is None else rows.where(F.col("ord") < at)
    place = ahead.groupBy("doc_id", "parent_seq").agg(F.max("seq_end").alias("_end"), F.count(F.lit(1)).alias("_place"))
    depths = rows.groupBy("doc_id", "parent_seq").agg(F.min("depth").alias("_depth"))
    made = first.join(depths, ["doc_id", "parent_seq"]).join(place, ["doc_id", "parent_seq"], "left")
    made = made.withColumns({"_at": F.coalesce("_end", "parent_seq"), "_place": F.coalesce("_place", F.lit(0))})
    row = made.select(
        "doc_id", F.lit(-1).alias("seq"), F.col("_depth").alias("depth"), F.lit("table_row").alias("kind"), F.lit("rows").alias("slot"), "parent_seq", F.lit("table_row").alias("type"), F.lit(is_header).alias("is_header"), "_at"
    )
    named = F.concat(F.lit(f"{table_id}_r"), F.col("_place").cast("string"), F.lit("c"), F.col("c").cast("string"))
    cells_ = made.where("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("c")).select(
        "doc_id", (-2 - F.col("c")).cast("int").alias("seq"), (F.col("_depth") + 1).alias("depth"), F.lit("table_cell").alias("kind"), F.lit("cells").alias("slot"), F.lit(-1).alias("parent_seq"),
        named.alias("node_id"), F.lit("table_cell").alias("type"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), "_at",
    )
    return _inserted(nodes, row.unionByName(cells_, allowMissingColumns=True))


def add_column(nodes: DataFrame, table_id: str, at: int | None = None) -> DataFrame:
    """Adds an empty cell to each row of a table at place ``at`` (default: the end); rows with fewer cells get it at theirs.

    Cells are called ``<table>_c<place>r<row>``.
    """
    rows = _rows_of(nodes, table_id).select("doc_id", F.col("seq").alias("_row"), F.col("ord").alias("_r"), "depth")
    held = nodes.where("kind = 'table_cell'").select("doc_id", F.col("parent_seq").alias("_row"), "seq_end", "ord")
    ahead = held if at is None else held.where(F.col("ord") < at)
    place = ahead.groupBy("doc_id", "_row").agg(F.max("seq_end").alias("_end"), F.count(F.lit(1)).alias("_place"))
    made = rows.join(place, ["doc_id", "_row"], "left")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_row"))
    named = F.concat(F.lit(f"{table_id}_c"), F.coalesce("_place", F.lit(0)).cast("string"), F.lit("r"), F.col("_r").cast("string"))
    new = made.select(
        "doc_id", (-number).cast("int").alias("seq"), (F.col("depth") + 1).alias("depth"), F.lit("table_cell").alias("kind"), F.lit("cells").alias("slot"), F.col("_row").alias("parent_seq"),
        named.alias("node_id"), F.lit("table_cell").alias("type"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.coalesce("_end", "_row").alias("_at"),
    )
    return _inserted(nodes, new)


def freeze(nodes: DataFrame, table_id: str, rows: list[int] | None = None, columns: list[int] | None = None, width: bool = True, height: bool = True) -> DataFrame:
    """Marks cells of a table as of fixed width and height (attrs fixed_width and fixed_height), all rows and columns by default.

    Columns: ``freeze(nodes, t, height=False)``; rows: ``freeze(nodes, t, rows, width=False)``; one cell:
    ``freeze(nodes, t, [row], [column])``; labels of a form: ``freeze(nodes, t, columns=[0])``.
    """
    table = nodes.where((F.col("type") == "table") & (F.col("node_id") == table_id)).select("doc_id", F.col("seq").alias("table_seq"))
    hit = cells(nodes).join(table, ["doc_id", "table_seq"], "left_semi")
    hit = hit if rows is None else hit.where(F.col("row_idx").isin(*rows))
    hit = hit if columns is None else hit.where(F.col("cell_idx").isin(*columns))
    names = ["fixed_width"] * width + ["fixed_height"] * height
    fixed = F.create_map(*[x for n in names for x in (F.lit(n), F.lit("true"))])
    attrs = F.map_concat(F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*names)), fixed)
    joined = nodes.join(hit.select("doc_id", "seq", F.lit(True).alias("_hit")), ["doc_id", "seq"], "left")
    return joined.withColumn("attrs", F.when(F.col("_hit"), attrs).otherwise(F.col("attrs"))).select(*nodes.columns)


def remove_column(nodes: DataFrame, table_id: str, col: int) -> DataFrame:
    """Nodes without the cell at place ``col`` of each row of a table."""
    table = nodes.where((F.col("type") == "table") & (F.col("node_id") == table_id)).select("doc_id", F.col("seq").alias("table_seq"))
    gone = cells(nodes).join(table, ["doc_id", "table_seq"]).where(F.col("cell_idx") == col)
    return renumber(marked_inside(nodes, gone).where("not _inside"), [F.col("seq")])


def cell_texts(nodes: DataFrame) -> DataFrame:
    """doc_id, table_seq, row_idx, cell_idx and the cell's text."""
    said = nodes.where(F.col("type").isin("paragraph", "heading")).select("doc_id", F.col("parent_seq").alias("seq"), F.col("seq").alias("_p"), own_text().alias("_t"))
    parts = said.groupBy("doc_id", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]), "\n").alias("text"))
    return cells(nodes).join(parts, ["doc_id", "seq"], "left").select("doc_id", "table_seq", "row_idx", "cell_idx", "node_id", F.coalesce("text", F.lit("")).alias("text"))
