"""Differences, merges and losses: joins on (doc_id, node_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import NODES
from .edit import renumber
from .query import inline_text, with_text_content, with_top

# What each format cannot show, and what Markdown cannot bring back.
UNSUPPORTED = {"docx": ("drawing",), "hwpx": ("drawing", "footnote", "endnote"), "md": ("drawing", "text_art", "chart"), "html": ("drawing", "text_art", "chart")}
NOT_IN_MARKDOWN = ("image", "text_box", "drawing", "header", "footer", "field", "bookmark", "comment", "chart", "text_art", "unknown", "endnote")
#: Style fields whose change is a formatting change.
STYLE = ("bold", "italic", "underline", "strike", "superscript", "subscript", "color", "font", "size", "url", "type")


def _projection(nodes: DataFrame) -> DataFrame:
    """What a comparison needs of the top-level blocks."""
    shape = F.col("type") == "table"
    rows = nodes.where("kind = 'table_row'").groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(F.count(F.lit(1)).alias("n_rows"))
    style = F.to_json(F.transform("inlines", lambda i: F.struct(*[i[n].alias(n) for n in STYLE])))
    top = with_text_content(nodes).where("depth = 0").join(rows, ["doc_id", "seq"], "left")
    get = lambda k: F.try_element_at(F.col("attrs"), F.lit(k))
    return top.select(
        "doc_id", "node_id", "seq", "type", "level", F.col("text_content").alias("said"), F.when(F.col("type") == "paragraph", style).alias("style"),
        F.when(shape, F.col("n_rows")).alias("n_rows"), get("src").alias("src"), get("alt").alias("alt"), get("language").alias("language"),
    ).where("node_id is not null")


def diff_documents(original: DataFrame, result: DataFrame) -> DataFrame:
    """doc_id, node_id, loss_type and description of every difference between top-level blocks of the same id.

    Missing, added and retyped blocks, tables of another shape, other formatting, image sources and
    code languages are unintended; other texts and heading levels are edits.
    """
    a, b = _projection(original), _projection(result)
    both = a.alias("a").join(b.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.node_id") == F.col("b.node_id")), "full_outer")

    def entry(when: Column, kind: str, text: Column | str) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("loss_type"), (F.lit(text) if isinstance(text, str) else text).alias("description")))

    missing, added = F.col("b.node_id").isNull(), F.col("a.node_id").isNull()
    retyped = ~missing & ~added & (F.col("a.type") != F.col("b.type"))
    same = ~missing & ~added & ~retyped

    def changed(name: str) -> Column:
        return same & ~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))

    found = F.array_compact(
        F.array(
            entry(missing, "unintended", "block is missing"),
            entry(added, "unintended", "block was added"),
            entry(retyped, "unintended", F.concat(F.lit("type changed from "), "a.type", F.lit(" to "), "b.type")),
            entry(changed("said") & (F.col("a.type") != "image"), "user_edited", "text changed"),
            entry(changed("level"), "user_edited", "heading level changed"),
            entry(changed("style") & ~changed("said"), "unintended", "formatting changed"),
            entry(changed("n_rows"), "unintended", "table shape changed"),
            entry(changed("src") | (changed("alt") & (F.col("a.type") == "image")), "unintended", "image changed"),
            entry(changed("language"), "unintended", "code language changed"),
        )
    )
    return both.select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), F.coalesce("a.node_id", "b.node_id").alias("node_id"), F.explode(found).alias("l")).select("doc_id", "node_id", "l.loss_type", "l.description")


def loss_report(nodes: DataFrame, losses: DataFrame) -> DataFrame:
    """Per document: total_blocks, lossless_blocks (blocks without a loss), losses, edits and whether a round trip is safe."""
    total = nodes.where("depth = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_blocks"))
    lost = losses.groupBy("doc_id").agg(
        F.count_distinct("node_id").alias("lossy"),
        F.count(F.lit(1)).alias("losses"),
        F.count(F.when(F.col("loss_type") == "user_edited", 1)).alias("edits"),
        F.count(F.when(F.col("loss_type") == "unintended", 1)).alias("unintended"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return total.join(lost, "doc_id", "left").select("doc_id", "total_blocks", (F.col("total_blocks") - zero("lossy")).alias("lossless_blocks"), zero("losses").alias("losses"), zero("edits").alias("edits"), (zero("unintended") == 0).alias("roundtrip_safe"))


def render_losses(nodes: DataFrame, fmt: str, from_scratch: bool = False) -> DataFrame:
    """What a format cannot show of the top-level blocks; when written anew, also blocks whose original bytes are lost."""
    cannot = F.col("type").isin(*UNSUPPORTED.get(fmt, ()))
    loses = F.lit(from_scratch) & F.try_element_at("attrs", F.lit("verbatim_ref")).isNull()
    kind = F.when(cannot, F.concat(F.col("type"), F.lit(f" is not supported by {fmt}"))).when(loses, "verbatim_lost")
    return nodes.where("depth = 0").withColumn("description", kind).where("description is not null").select("doc_id", "node_id", F.lit("format_limit").alias("loss_type"), "description")


def merge_diff(original: DataFrame, edited: DataFrame) -> DataFrame:
    """What merging an edited Markdown copy does to each top-level block.

    Columns doc_id, node_id, change_type (text_edit, added, removed, preserved or kept), description
    (added: its first 40 characters) and new_text. Blocks that Markdown cannot hold are preserved when missing;
    only texts of paragraphs and headings are taken over.
    """
    a, b = _projection(original), _projection(edited)
    both = a.alias("a").join(b.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.node_id") == F.col("b.node_id")), "full_outer")
    editable = F.col("a.type").isin("paragraph", "heading") & (F.col("a.type") == F.col("b.type"))
    change = (
        F.when(F.col("a.node_id").isNull(), "added")
        .when(F.col("b.node_id").isNull() & F.col("a.type").isin(*NOT_IN_MARKDOWN), "preserved")
        .when(F.col("b.node_id").isNull(), "removed")
        .when(editable & (F.trim("a.said") != F.trim("b.said")), "text_edit")
        .otherwise("kept")
    )
    return both.select(
        F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"),
        F.coalesce("a.node_id", "b.node_id").alias("node_id"),
        change.alias("change_type"),
        F.when(change == "added", F.substring("b.said", 1, 40)).alias("description"),
        F.when(change.isin("added", "text_edit"), F.col("b.said")).otherwise(F.col("a.said")).alias("new_text"),
        F.col("a.seq").alias("old_seq"),
        F.col("b.seq").alias("new_seq"),
    )


def merged_order(merged: DataFrame) -> DataFrame:
    """The top-level order after a merge: that of the edited copy, with preserved blocks after what preceded them.

    A preserved block is anchored to the last block before it in the original that is still there;
    blocks without such an anchor come first.
    """
    left = merged.where("change_type <> 'removed'")
    before = Window.partitionBy("doc_id").orderBy(F.col("old_seq").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    anchored = left.withColumn("anchor", F.when(F.col("new_seq").isNotNull(), F.col("new_seq")).otherwise(F.coalesce(F.last("new_seq", ignorenulls=True).over(before), F.lit(-1))))
    order = Window.partitionBy("doc_id").orderBy("anchor", F.col("new_seq").isNull().cast("int"), "old_seq")
    return anchored.select("doc_id", "node_id", "change_type", "new_text", F.row_number().over(order).cast("long").alias("position"))


def merge_documents(original: DataFrame, edited: DataFrame) -> DataFrame:
    """The original's nodes after the merge: texts taken over, removed subtrees gone, added blocks at their place.

    Paragraphs of table cells and list items, found by the ids of cell and item, take over changed
    texts as well; paragraphs that a cell has more than before are not added.
    """
    plan = merge_diff(original, edited)
    order = merged_order(plan)
    gone = plan.where("change_type = 'removed'").select("doc_id", "node_id")
    top = original.where("depth = 0").join(gone, ["doc_id", "node_id"], "left_anti")
    top = top.join(order.where("change_type <> 'added'").select("doc_id", "node_id", "position"), ["doc_id", "node_id"])
    kept = with_top(original, top, ["position"])
    incoming = edited.join(plan.where("change_type = 'text_edit'").select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").select(F.col("doc_id").alias("_e"), F.col("node_id").alias("_n"), F.col("inlines").alias("_inlines"), F.col("text").alias("_new"))
    kept = kept.join(incoming, (F.col("doc_id") == F.col("_e")) & (F.col("node_id") == F.col("_n")), "left")
    edit = F.col("_n").isNotNull()
    kept = kept.withColumns({"text": F.when(edit, F.col("_new")).otherwise(F.col("text")), "inlines": F.when(edit, F.col("_inlines")).otherwise(F.col("inlines"))}).select(*NODES.names, "position")
    nested = nested_edits(original, edited).select(F.col("doc_id").alias("_e"), F.col("seq").alias("_s"), F.col("inlines").alias("_inlines"))
    kept = kept.join(nested, F.col("doc_id").eqNullSafe(F.col("_e")) & (F.col("seq") == F.col("_s")), "left")
    kept = kept.withColumn("inlines", F.when(F.col("_s").isNotNull(), F.col("_inlines")).otherwise(F.col("inlines"))).select(*NODES.names, "position")
    added = edited.where("depth = 0").join(order.where("change_type = 'added'").select("doc_id", "node_id", "position"), ["doc_id", "node_id"])
    new = with_top(edited, added, ["position"]).select(*NODES.names, "position")
    # Places of the added nodes are negative until all are numbered anew, which keeps the two copies apart.
    new = new.withColumns({"_order": F.col("seq"), "seq": -1 - F.col("seq"), "parent_seq": -1 - F.col("parent_seq")})
    return renumber(kept.withColumn("_order", F.col("seq")).unionByName(new), [F.col("position"), F.col("_order")])


def nested_edits(original: DataFrame, edited: DataFrame) -> DataFrame:
    """doc_id, node_id (of the cell or item), seq (of the original's paragraph or item), inlines and new_text where the text changed.

    A cell's paragraphs are matched by their place in it. Where an id repeats, the first node has it.
    """

    def texts(nodes: DataFrame) -> DataFrame:
        first = Window.partitionBy("doc_id", "kind", "node_id").orderBy("seq")
        held = nodes.where("kind in ('table_cell', 'list_item') and node_id is not null").withColumn("_first", F.row_number().over(first)).where("_first = 1")
        items = held.where("kind = 'list_item'").select("doc_id", "kind", "node_id", F.lit(0).alias("place"), "seq", "inlines")
        cells = held.where("kind = 'table_cell'").select("doc_id", "kind", "node_id", F.col("seq").alias("_cell"))
        inner = nodes.where("type = 'paragraph' and slot = 'content'").select("doc_id", F.col("parent_seq").alias("_cell"), "seq", "inlines")
        place = F.row_number().over(Window.partitionBy("doc_id", "_cell").orderBy("seq"))
        inner = inner.withColumn("place", place).join(cells, ["doc_id", "_cell"])
        both = items.unionByName(inner.select("doc_id", "kind", "node_id", "place", "seq", "inlines"))
        return both.withColumn("said", F.trim(inline_text(F.col("inlines"))))

    a, b = texts(original), texts(edited).select("doc_id", "kind", "node_id", "place", F.col("inlines").alias("_inlines"), F.col("said").alias("new_text"))
    both = a.join(b, ["doc_id", "kind", "node_id", "place"]).where("said <> new_text")
    return both.select("doc_id", "node_id", "seq", F.col("_inlines").alias("inlines"), "new_text")


def merge_changes(original: DataFrame, edited: DataFrame) -> DataFrame:
    """doc_id, node_id, change_type and description of all that a merge does: blocks, then texts of cells and items."""
    blocks = merge_diff(original, edited).where("change_type <> 'kept'").select("doc_id", "node_id", "change_type", "description")
    nested = nested_edits(original, edited).select("doc_id", "node_id", F.lit("text_edit").alias("change_type"), F.substring("new_text", 1, 40).alias("description"))
    return blocks.unionByName(nested)
