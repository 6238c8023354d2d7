"""Structural edits: filters, unions and renumbering by windows within each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import INLINE_NAMES, NODES
from .query import get_blocks, marked_inside


#: Levels of nesting that an edited document may have.
DEPTHS = 32


def renumber(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Gives nodes new ``seq``, ``seq_end``, ``parent_seq`` and ``ord`` after an edit.

    ``order`` sorts each document; parents are found again by the old ``parent_seq``. Rows must be
    distinct by (doc_id, seq); new rows carry fractional places in a column ``seq`` cast to double.
    """
    document = Window.partitionBy("doc_id")
    placed = nodes.withColumn("_new", (F.row_number().over(document.orderBy(*order)) - 1).cast("int"))
    parents = placed.select(F.col("doc_id").alias("_d"), F.col("seq").alias("_old"), F.col("_new").alias("_parent"))
    linked = placed.join(parents, placed["doc_id"].eqNullSafe(F.col("_d")) & (placed["parent_seq"] == F.col("_old")), "left").drop("_d", "_old")
    # A subtree ends before the next node that is not deeper: running minima from the end, one for each depth.
    from_end = document.orderBy(F.desc("_new")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.when(F.col("depth") >= DEPTHS, F.raise_error(F.lit(f"a document is nested deeper than {DEPTHS} levels")).cast("int"))
    for depth in range(DEPTHS):
        after = after.when(F.col("depth") == depth, F.min(F.when(F.col("depth") <= depth, F.col("_new"))).over(from_end))
    ended = linked.withColumn("_end", F.coalesce(after - 1, F.max("_new").over(document)).cast("int"))
    place = F.row_number().over(Window.partitionBy("doc_id", "_parent", "slot").orderBy("_new")) - 1
    ended = ended.withColumn("_ord", place.cast("int"))
    renamed = {"seq": "_new", "seq_end": "_end", "parent_seq": "_parent", "ord": "_ord"}
    return ended.select(*[F.col(renamed[c]).alias(c) if c in renamed else F.col(c) for c in NODES.names])


def remove_blocks(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes without the subtrees of ``targets`` (doc_id, node_id)."""
    roots = nodes.join(targets.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi")
    return renumber(marked_inside(nodes, roots).where("not _inside"), [F.col("seq")])


def get_block_format(nodes: DataFrame, node_id: str) -> DataFrame:
    """doc_id, name and value of the format of the first block of that id in each document."""
    found = get_blocks(nodes, node_id).select("doc_id", F.explode(F.map_entries("attrs")).alias("e"))
    return found.where(F.col("e.key").startswith("format.")).select("doc_id", F.substring("e.key", len("format.") + 1, 1000).alias("name"), F.col("e.value").alias("value"))


def set_block_format(nodes: DataFrame, formats: DataFrame) -> DataFrame:
    """Updates blocks' formats: ``formats`` has doc_id, node_id and fmt (map<string,string>; a null value takes a name away).

    Names that are not given keep their values; of several rows for a block the last of each name counts.
    """
    each = formats.select("doc_id", "node_id", F.explode("fmt").alias("name", "value")).groupBy("doc_id", "node_id", "name").agg(F.last("value").alias("value"))
    given = each.groupBy("doc_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("format."), "name").alias("k"), F.col("value").alias("v")))).alias("_fmt"))
    joined = nodes.join(given, ["doc_id", "node_id"], "left")
    attrs = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(attrs, lambda k, v: ~F.map_contains_key(F.col("_fmt"), k))
    new = F.map_concat(kept, F.map_filter("_fmt", lambda k, v: v.isNotNull()))
    return joined.withColumn("attrs", F.when(F.col("_fmt").isNull(), F.col("attrs")).otherwise(new)).select(*nodes.columns)


def set_metadata(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id, name and value: ``metadata`` with the rows of ``changes`` (same columns) in place of equal names; a null value takes one away."""
    new = changes.groupBy("doc_id", "name").agg(F.last("value").alias("value"))
    return metadata.join(new, ["doc_id", "name"], "left_anti").select("doc_id", "name", "value").unionByName(new.where("value is not null"))


def add_blocks(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds leaf blocks: ``blocks`` has the columns of nodes that matter, ``after`` (a node_id or null) and ``at`` (their order).

    A block follows the subtree of ``after`` as its sibling; without such a node it is appended at
    top level.
    """
    anchors = nodes.select(
        F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("seq_end").alias("_e"), F.col("depth").alias("_depth"), F.col("parent_seq").alias("_p"), F.col("slot").alias("_slot")
    )
    last = nodes.groupBy(F.col("doc_id").alias("_d2")).agg(F.max("seq").alias("_last"))
    placed = blocks.join(anchors, (blocks["doc_id"] == F.col("_d")) & (blocks["after"] == F.col("_n")), "left").join(last, blocks["doc_id"] == F.col("_d2"), "left")
    known = {"depth": F.coalesce("_depth", F.lit(0)), "parent_seq": F.col("_p"), "slot": F.coalesce("_slot", F.lit("blocks")), "kind": F.lit("block")}
    columns = []
    for f in NODES.fields:
        if f.name in known:
            columns.append(known[f.name].cast(f.dataType).alias(f.name))
        elif f.name in ("seq", "seq_end", "ord"):
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            columns.append((F.col(f.name) if f.name in blocks.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    new = placed.select(*columns, F.coalesce("_e", "_last", F.lit(-1)).alias("_at"), F.coalesce(F.col("at"), F.lit(0)).cast("int").alias("_k"))
    both = nodes.withColumns({"_at": F.col("seq"), "_k": F.lit(-1)}).unionByName(new)
    return renumber(both, [F.col("_at"), F.col("_k")])


def move_blocks(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves top-level subtrees: ``moves`` has doc_id, node_id and after (null or unknown: to the end); one move a document."""
    top = nodes.where("depth = 0")
    moved = top.join(moves, ["doc_id", "node_id"]).select("doc_id", F.col("seq").alias("_a"), F.col("seq_end").alias("_b"), "after")
    anchor = top.select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), F.col("seq_end").alias("_e"))
    moved = moved.join(anchor, (moved["doc_id"] == F.col("_d")) & (moved["after"] == F.col("_n")), "left").select(moved["doc_id"].alias("_doc"), "_a", "_b", "_e")
    joined = nodes.join(moved, nodes["doc_id"] == F.col("_doc"), "left")
    taken = F.col("seq").between(F.col("_a"), F.col("_b"))
    key = F.when(F.coalesce(taken, F.lit(False)), F.coalesce(F.col("_e").cast("double"), F.lit(float("inf"))) + 0.5).otherwise(F.col("seq").cast("double"))
    return renumber(joined.withColumn("_key", key).drop("_doc", "_a", "_b", "_e"), [F.col("_key"), F.col("seq")])


def _with(inline: Column, **changes: Column) -> Column:
    return F.struct(*[changes.get(n, inline[n]).alias(n) for n in INLINE_NAMES])


def apply_edits(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of inlines: ``edits`` has doc_id, node_id, inline_idx, text (null: keep) and fmt (map<string,string> or null).

    Known keys of ``fmt`` are bold, italic, underline, strike, superscript, subscript, color, font
    and size; others are ignored. A heading's text follows its inlines. The last edit of an inline counts.
    """
    value = F.struct(F.col("text").alias("t"), F.col("fmt").alias("f"))
    grouped = edits.groupBy("doc_id", "node_id", "inline_idx").agg(F.last(value).alias("v")).groupBy("doc_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("inline_idx", "v"))).alias("_edits"))

    def edited(x: Column, i: Column) -> Column:
        e = F.try_element_at(F.col("_edits"), i)
        changes = {"text": F.coalesce(e["t"], x["text"])}
        for n in ("bold", "italic", "underline", "strike", "superscript", "subscript"):
            changes[n] = F.coalesce(F.try_element_at(e["f"], F.lit(n)).cast("boolean"), x[n])
        for n in ("color", "font"):
            changes[n] = F.coalesce(F.try_element_at(e["f"], F.lit(n)), x[n])
        changes["size"] = F.coalesce(F.try_element_at(e["f"], F.lit("size")).cast("double"), x["size"])
        return _with(x, **changes)

    joined = nodes.join(grouped, ["doc_id", "node_id"], "left")
    inlines = F.when(F.col("_edits").isNull(), F.col("inlines")).otherwise(F.transform("inlines", edited))
    said = F.array_join(F.transform(inlines, lambda x: F.coalesce(x["text"], F.lit(""))), "")
    heading = F.col("_edits").isNotNull() & (F.col("type") == "heading")
    alone = F.when(F.col("inlines").isNull(), F.coalesce(F.try_element_at("_edits", F.lit(0))["t"], F.col("text"))).otherwise(said)
    return joined.withColumns({"text": F.when(heading, alone).otherwise(F.col("text")), "inlines": inlines}).select(*nodes.columns)


def add_inline(inlines: Column, inline: Column, at: int | None = None) -> Column:
    return F.array_append(inlines, inline) if at is None else F.array_insert(inlines, at + 1, inline)


def remove_inline(inlines: Column, index: int) -> Column:
    return F.filter(inlines, lambda x, i: i != index)


def split_inline(inlines: Column, index: int, offset: int) -> Column:
    """Cuts an inline in two of the same style; nothing happens unless the cut lies inside its text."""
    at = F.get(inlines, F.lit(index))
    inside = (F.lit(offset) > 0) & (F.lit(offset) < F.length(at["text"]))
    halves = F.array(_with(at, text=F.substring(at["text"], 1, offset)), _with(at, text=F.substring(at["text"], F.lit(offset + 1), F.length(at["text"]))))
    cut = F.concat(F.slice(inlines, F.lit(1), F.lit(index)), halves, F.slice(inlines, F.lit(index + 2), F.greatest(F.size(inlines) - index - 1, F.lit(0))))
    return F.when(F.coalesce(inside, F.lit(False)), cut).otherwise(inlines)
