"""Finding blocks and what they say. Filters on stored columns reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import block_number
from ..model import CONTAINERS

_SPOKEN = ("text", "link")


def inline_text(inlines: Column) -> Column:
    """The text of text and link inlines; code, formulas and references say nothing here."""
    spoken = F.filter(inlines, lambda i: i["type"].isin(*_SPOKEN) & i["text"].isNotNull())
    return F.coalesce(F.array_join(F.transform(spoken, lambda i: i["text"]), ""), F.lit(""))


def own_text(prefix: str = "") -> Column:
    """What a node says without its children."""
    kind, text, inlines = F.col(prefix + "type"), F.col(prefix + "text"), F.col(prefix + "inlines")
    return (
        F.when(kind.isin("paragraph", "list_item"), inline_text(inlines))
        .when(kind.isin("heading", "image", "equation", "code", "field", "chart", "text_art"), F.coalesce(text, F.lit("")))
        .otherwise("")
    )


def with_text_content(nodes: DataFrame) -> DataFrame:
    """Adds ``text_content``: own text, or for containers that of what they hold, in document order.

    Parts are joined by a blank in tables and by a newline elsewhere; of lists only the top items
    count, and drawings say nothing. Containers meet their contents by document and interval.
    """
    own = nodes.withColumn("_own", own_text())
    holders = nodes.where(F.col("type").isin("table", "list", *CONTAINERS)).select("doc_id", "seq", "seq_end", "type")
    leaves = own.where(F.col("type").isin("paragraph", "list_item", "heading", "image", "equation", "code", "field", "chart", "text_art"))
    leaves = leaves.select("doc_id", F.col("seq").alias("_seq"), F.col("type").alias("_type"), F.col("parent_seq").alias("_parent"), F.col("slot").alias("_slot"), "_own")
    inside = (F.col("h.doc_id").eqNullSafe(F.col("l.doc_id"))) & (F.col("_seq") > F.col("h.seq")) & (F.col("_seq") <= F.col("h.seq_end"))
    wanted = (F.col("h.type") != "list") | ((F.col("_type") == "list_item") & (F.col("_parent") == F.col("h.seq")))
    met = holders.alias("h").join(leaves.alias("l"), inside).where(wanted)
    said = met.groupBy("h.doc_id", "h.seq", "h.type").agg(F.array_sort(F.collect_list(F.struct("_seq", "_own"))).alias("parts"))
    texts = F.transform("parts", lambda p: p["_own"])
    joined = F.when(F.col("type") == "table", F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n"))
    said = said.select(F.col("doc_id").alias("_d"), F.col("seq").alias("_s"), joined.alias("_all"))
    return own.join(said, own["doc_id"].eqNullSafe(said["_d"]) & (own["seq"] == said["_s"]), "left").select(
        *[own[c] for c in nodes.columns], F.coalesce("_all", "_own").alias("text_content")
    )


def find_blocks(nodes: DataFrame, block_type: str | None = None, **equal) -> DataFrame:
    """Blocks at any depth of a type whose columns or attrs equal the given values; None matches what is missing."""
    found = nodes.where("kind = 'block'")
    if block_type is not None:
        found = found.where(F.col("type") == block_type)
    for name, value in equal.items():
        column = F.col(name) if name in nodes.columns else F.try_element_at(F.col("attrs"), F.lit(name))
        found = found.where(column.eqNullSafe(F.lit(value)))
    return found


def get_blocks(nodes: DataFrame, node_id: str | Column) -> DataFrame:
    """The first node of that id in each document."""
    wanted = nodes.where(F.col("node_id") == (F.lit(node_id) if isinstance(node_id, str) else node_id))
    return wanted.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in nodes.columns if c != "doc_id"]), "seq").alias("n")).select("doc_id", "n.*")


def marked_inside(nodes: DataFrame, roots: DataFrame, strict: bool = False) -> DataFrame:
    """``nodes`` with a boolean ``_inside``: at or (``strict``: only) below one of ``roots`` (doc_id, seq).

    A running maximum of the roots' ends, in document order: linear in the nodes, whatever the nesting.
    """
    marks = roots.select(F.col("doc_id").alias("_d"), F.col("seq").alias("_root")).distinct()
    met = nodes.join(marks, nodes["doc_id"].eqNullSafe(F.col("_d")) & (nodes["seq"] == F.col("_root")), "left")
    so_far = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    reach = F.max(F.when(F.col("_root").isNotNull(), F.col("seq_end"))).over(so_far)
    return met.withColumn("_inside", F.coalesce(reach >= F.col("seq"), F.lit(False))).select(*nodes.columns, "_inside")


def with_top(nodes: DataFrame, tops: DataFrame, names: list[str]) -> DataFrame:
    """Nodes of the top-level blocks ``tops`` (doc_id, seq) with the columns ``names`` of their block."""
    known = tops.select(F.col("doc_id").alias("_d"), F.col("seq").alias("_top"), F.struct(*names).alias("_of"))
    met = nodes.join(known, nodes["doc_id"].eqNullSafe(F.col("_d")) & (nodes["seq"] == F.col("_top")), "left")
    so_far = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("depth") == 0, F.struct(F.col("_of").alias("of"))), ignorenulls=True).over(so_far)
    return met.withColumn("_last", last).where("_last.of is not null").select(*nodes.columns, *[F.col(f"_last.of.{n}").alias(n) for n in names])


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes at and below ``roots`` (doc_id, seq)."""
    return marked_inside(nodes, roots).where("_inside").drop("_inside")


def headings(nodes: DataFrame) -> DataFrame:
    return find_blocks(nodes, "heading")


def tables(nodes: DataFrame) -> DataFrame:
    return find_blocks(nodes, "table")


def images(nodes: DataFrame) -> DataFrame:
    return find_blocks(nodes, "image")


def paragraphs(nodes: DataFrame) -> DataFrame:
    return find_blocks(nodes, "paragraph")


def type_counts(nodes: DataFrame, *by: str) -> DataFrame:
    """How many blocks of each type there are; one shuffle of partial counts."""
    return nodes.where("kind = 'block'").groupBy(*by, "type").agg(F.count(F.lit(1)).alias("blocks"))


def max_block_index(nodes: DataFrame) -> DataFrame:
    """The largest number of a block id in each document, 0 if there is none."""
    return nodes.groupBy("doc_id").agg(F.max(block_number(F.col("node_id"))).alias("max_index"))


def fingerprint(nodes: DataFrame) -> DataFrame:
    """The first 12 digits of the sha256 of ``id:text`` lines of the top-level blocks, in order."""
    top = with_text_content(nodes).where("depth = 0")
    lines = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.coalesce("node_id", F.lit("")), F.lit(":"), "text_content", F.lit("\n")).alias("line"))))
    return top.groupBy("doc_id").agg(F.substring(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ""), 256), 1, 12).alias("fingerprint"))


def resolve_images(nodes: DataFrame, resources: DataFrame) -> DataFrame:
    """doc_id, seq, src and bytes of images: data URIs decoded, other sources looked up by name, then by stem."""
    found = images(nodes).select("doc_id", "seq", F.try_element_at("attrs", F.lit("src")).alias("src"))
    stem = F.regexp_replace(F.regexp_replace("src", r"^bindata:", ""), r"\.[^.]*$", "")
    data = F.try_to_binary(F.regexp_extract("src", r"^data:[^,]*;base64,(.*)$", 1), F.lit("base64"))
    named = resources.select("doc_id", "name", "bytes")
    exact = found.join(named.withColumnRenamed("bytes", "_exact"), (found["doc_id"] == named["doc_id"]) & (F.regexp_replace("src", "^bindata:", "") == F.col("name")), "left").drop(named["doc_id"]).drop("name")
    stems = named.groupBy("doc_id", F.regexp_replace("name", r"\.[^.]*$", "").alias("_stem")).agg(F.min_by("bytes", "name").alias("_by_stem")).withColumnRenamed("doc_id", "_d")
    both = exact.join(stems, (F.col("doc_id") == F.col("_d")) & (stem == F.col("_stem")), "left")
    return both.select("doc_id", "seq", "src", F.when(F.col("src").startswith("data:"), data).otherwise(F.coalesce("_exact", "_by_stem")).alias("bytes"))
