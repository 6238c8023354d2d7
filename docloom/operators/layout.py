"""Blocks from positioned text, as page descriptions hold it: spans with boxes, fonts and pages.

``spans`` has doc_id, page, x0, y0, x1, y1 (y grows upwards), text, size and bold. Everything is
relational: weighted modes, clusters by gaps, shares of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How much larger than the body a heading's font is, by level.
HEADING_RATIOS = ((2.0, 1), (1.6, 2), (1.3, 3))
LEAST_RATIO, BOLD_SHARE, BOLD_LEVEL = 1.15, 0.8, 4


def body_sizes(spans: DataFrame) -> DataFrame:
    """The font size of most signs other than blanks in each document; of equals, the smaller."""
    weights = spans.groupBy("doc_id", "size").agg(F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("_w"))
    return weights.groupBy("doc_id").agg(F.max_by("size", F.struct("_w", -F.col("size"))).alias("body_size"))


def heading_level(size: Column, body: Column, bold_share: Column) -> Column:
    """1 to 4 by the ratio of sizes; mostly bold lines of body size are level 4; null for text."""
    ratio = size / body
    level = F.when(ratio >= HEADING_RATIOS[0][0], 1)
    for least, number in HEADING_RATIOS[1:]:
        level = level.when(ratio >= least, number)
    return level.when(ratio > LEAST_RATIO, 4).when(bold_share >= BOLD_SHARE, BOLD_LEVEL)


def lines(spans: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Spans joined to lines: a line ends where the baseline moves by more than ``tolerance``."""
    page = Window.partitionBy("doc_id", "page").orderBy(F.desc("y0"), "x0")
    moved = F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(page)) > tolerance, F.lit(True))
    numbered = spans.withColumn("line", F.sum(moved.cast("int")).over(page.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = F.length(F.regexp_replace("text", r"\s", ""))
    found = numbered.groupBy("doc_id", "page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"),
        (F.sum(F.when(F.coalesce("bold", F.lit(False)), n).otherwise(0)) / F.greatest(F.sum(n), F.lit(1))).alias("bold_share"),
    )
    return found


def repeated_lines(found: DataFrame, page_height: float, margin: float = 0.08, share: float = 0.5, snap: float = 5.0) -> DataFrame:
    """Texts in the top or bottom margin at the same snapped height on at least ``share`` of two or more pages."""
    edge = found.where((F.col("y0") < page_height * margin) | (F.col("y1") > page_height * (1 - margin)))
    pages = found.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    held = edge.groupBy("doc_id", "text", (F.round(F.col("y0") / snap) * snap).alias("snap_y")).agg(F.count_distinct("page").alias("on_pages"))
    return held.join(pages, "doc_id").where((F.col("pages") >= 2) & (F.col("on_pages") >= 2) & (F.col("on_pages") >= share * F.col("pages"))).drop("pages")


def column_split(found: DataFrame, least_gap: float = 20.0) -> DataFrame:
    """doc_id, page and the x at which a page falls into two columns: the widest gap between boxes with two on each side.

    A gap counts only if no box spans it.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("x0", "x1")
    reach = F.max("x1").over(page.rowsBetween(Window.unboundedPreceding, -1))
    before = F.count(F.lit(1)).over(page.rowsBetween(Window.unboundedPreceding, -1))
    after = F.count(F.lit(1)).over(page.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    gaps = found.select("doc_id", "page", (F.col("x0") - reach).alias("gap"), ((F.col("x0") + reach) / 2).alias("at"), before.alias("before"), after.alias("after"))
    gaps = gaps.where((F.col("gap") >= least_gap) & (F.col("before") >= 2) & (F.col("after") >= 2))
    return gaps.groupBy("doc_id", "page").agg(F.max_by("at", "gap").alias("split_x"))


def clusters(values: DataFrame, key: str, value: str, factor: float = 4.0, least: float = 40.0) -> DataFrame:
    """Numbers the clusters of a key's values: a cluster ends at a gap above max(factor x median gap, least)."""
    by = Window.partitionBy(key).orderBy(value)
    gaps = values.withColumn("_gap", F.col(value) - F.lag(value).over(by))
    # The upper median, as of a sorted list at half its length.
    ranked = gaps.where("_gap is not null").groupBy(key).agg(F.array_sort(F.collect_list("_gap")).alias("_g"))
    median = ranked.select(key, F.element_at("_g", (F.floor(F.size("_g") / 2) + 1).cast("int")).alias("_m"))
    limit = F.greatest(F.coalesce("_m", F.lit(0.0)) * factor, F.lit(least))
    joined = gaps.join(median, key, "left").withColumn("_new", (F.coalesce(F.col("_gap"), F.lit(0.0)) > limit).cast("int"))
    return joined.withColumn("cluster", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_gap", "_m", "_new")


def blocks(spans: DataFrame, page_height: float) -> DataFrame:
    """doc_id, page, line, type, level and text: headings, list items and paragraphs, without running heads and feet."""
    found = lines(spans)
    repeated = repeated_lines(found, page_height).select("doc_id", "text", "snap_y")
    snapped = found.withColumn("snap_y", F.round(F.col("y0") / 5.0) * 5.0)
    kept = snapped.join(repeated, ["doc_id", "text", "snap_y"], "left_anti").join(body_sizes(spans), "doc_id")
    level = heading_level(F.col("size"), F.col("body_size"), F.col("bold_share"))
    item = F.col("text").rlike(r"^\s*([-*•▪◦]|\d+[.)])\s+")
    kind = F.when(level.isNotNull(), "heading").when(item, "list").otherwise("paragraph")
    said = F.when(kind == "list", F.regexp_replace("text", r"^\s*([-*•▪◦]|\d+[.)])\s+", "")).otherwise(F.col("text"))
    return kept.select("doc_id", "page", "line", kind.alias("type"), level.alias("level"), said.alias("text"))


def links_of_blocks(boxes: DataFrame, links: DataFrame) -> DataFrame:
    """For each box (doc_id, page, id, x0, y0, x1, y1) the first link (n, url, ...) of its page that overlaps it."""
    a, b = boxes.alias("a"), links.alias("b")
    met = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    return a.join(b, met).groupBy("a.doc_id", "a.page", "a.id").agg(F.min_by("b.url", "b.n").alias("url"))
