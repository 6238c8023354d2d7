"""Sections, numbering, islands and other order-dependent facts, as windows within each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _document(*order: str) -> Window:
    return Window.partitionBy("doc_id").orderBy(*(order or ("seq",)))


def sections(nodes: DataFrame) -> DataFrame:
    """Top-level blocks with the seq, level and text of the heading they stand under (a heading stands under itself)."""
    top = nodes.where("depth = 0")
    so_far = _document().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_heading = F.col("type") == "heading"
    take = lambda c: F.last(F.when(is_heading, F.col(c)), ignorenulls=True).over(so_far)
    return top.select("doc_id", "seq", "type", "level", "text", take("seq").alias("section_seq"), take("level").alias("section_level"), take("text").alias("section"))


def outline(nodes: DataFrame, levels: int = 9) -> DataFrame:
    """Headings with the seq of the heading they are under: the last one before of a smaller level.

    A running last heading for each level up to ``levels``; a deeper heading is an error.
    """
    found = nodes.where("type = 'heading'").select("doc_id", "seq", "level", "text")
    earlier = _document().rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(earlier) for k in range(1, levels)]
    deep = F.when(F.col("level") > levels, F.raise_error(F.lit(f"a heading is deeper than {levels} levels")).cast("int"))
    under = deep.when(F.col("level") > 1, F.array_max(F.array(*[F.when(F.col("level") > k, last) for k, last in enumerate(lasts, 1)])))
    return found.withColumn("under", under)


def heading_numbers(nodes: DataFrame, levels: int = 3) -> DataFrame:
    """Headings numbered 1., 1.1., ...: the counter of a level starts anew under each heading above it."""
    found = nodes.where("type = 'heading'").select("doc_id", "seq", "level", "text")
    counts: list[Column] = []
    for level in range(1, levels + 1):
        # The island of a counter begins at each heading of a smaller level.
        found = found.withColumn(f"_i{level}", F.count(F.when(F.col("level") < level, 1)).over(_document().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        island = Window.partitionBy("doc_id", f"_i{level}").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = found.withColumn(f"_n{level}", F.count(F.when(F.col("level") == level, 1)).over(island))
        counts.append(F.when(F.col("level") >= level, F.greatest(F.col(f"_n{level}"), F.lit(0)).cast("string")))
    number = F.concat(F.array_join(F.array_compact(F.array(*counts)), "."), F.lit("."))
    return found.where(F.col("level") <= levels).select("doc_id", "seq", "level", "text", number.alias("number"))


def islands(df: DataFrame, key: str, flag: Column, order: str = "seq") -> DataFrame:
    """Runs of rows for which ``flag`` holds: key, first, last and length of each."""
    by = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("_new", F.when(F.col("_f") & ~F.coalesce(F.lag("_f").over(by), F.lit(False)), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_f")
    return numbered.groupBy(key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("_island")


def merge_adjacent_inlines(nodes: DataFrame) -> DataFrame:
    """Neighbouring text inlines of equal style become one."""
    from ..model import INLINE_NAMES

    def at(i: Column) -> Column:
        return F.get(F.col("inlines"), i)

    def opens(i: Column) -> Column:
        """Whether a run begins at place ``i``."""
        same = at(i)["type"] == "text"
        for n in INLINE_NAMES:
            if n != "text":
                same = same & at(i)[n].eqNullSafe(at(i - 1)[n])
        return (i == 0) | ~F.coalesce(same, F.lit(False))

    count = F.size("inlines")
    runs = nodes.withColumn("_runs", F.when(count > 1, F.filter(F.sequence(F.lit(0), count - 1), opens)))
    stops = F.concat(F.slice(F.col("_runs"), F.lit(2), F.size("_runs")), F.array(count))
    spans = F.zip_with("_runs", stops, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def joined(span: Column) -> Column:
        first = at(span["a"])
        said = F.array_join(F.transform(F.slice("inlines", span["a"] + 1, span["b"] - span["a"]), lambda x: F.coalesce(x["text"], F.lit(""))), "")
        alone = span["b"] - span["a"] == 1
        return F.struct(*[(F.when(alone, first["text"]).otherwise(said) if n == "text" else first[n]).alias(n) for n in INLINE_NAMES])

    return runs.withColumn("inlines", F.when(count > 1, F.transform(spans, joined)).otherwise(F.col("inlines"))).drop("_runs")


def repeated_content(lines: DataFrame, unit: str, place: str, share: float = 0.5) -> DataFrame:
    """Texts that stand at the same place in at least ``share`` of the units (pages): running heads and feet."""
    total = lines.agg(F.count_distinct(unit).alias("units"))  # one row, whatever the input
    found = lines.groupBy(place, "text").agg(F.count_distinct(unit).alias("in_units"))
    return found.join(F.broadcast(total)).where(F.col("in_units") >= share * F.col("units")).select(place, "text", "in_units")


def dominant(df: DataFrame, key: str, value: str, weight: str, first: str) -> DataFrame:
    """The value of the largest total weight for each key; of equals, the one met first."""
    totals = df.groupBy(key, value).agg(F.sum(weight).alias("_w"), F.min(first).alias("_f"))
    return totals.groupBy(key).agg(F.max_by(F.struct(value, "_w"), F.struct(F.col("_w"), -F.col("_f"))).alias("m")).select(key, F.col(f"m.{value}").alias(value), F.col("m._w").alias("weight"))


def dense_ids(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values of each key with ids from 0, in the order in which they appear."""
    firsts = df.groupBy(key, value).agg(F.min(order).alias("first"))
    return firsts.select(key, value, (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("long").alias("id"))


#: Ids in one piece of equal boxes; pieces of a square in one part of it; tasks that meet the parts, at least.
#: A task holds the pairs of one piece with one part at a time, PIECE * PIECE * PART rows at most.
PIECE, PART, TASKS = 32, 128, 64


def overlapping(boxes: DataFrame, page: str, least: float = 0.0, cell: float = 50.0) -> DataFrame:
    """Pairs of boxes (id, x0, y0, x1, y1) of a page that overlap by more than ``least``; ids ascending.

    Only boxes that share a square of side ``cell`` on the page meet; the square of the overlap's
    first corner reports a pair, so none comes twice. Equal boxes meet others once, as pieces of a
    list of their ids; ids are paired only where pieces overlap. A square's pieces are met in parts,
    each with each, so neither a full page nor a full square falls to one task. Ids that are null pair
    with nothing.
    """

    def squares(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))

    corners = ["x0", "y0", "x1", "y1"]
    equal = boxes.where("x1 >= x0 and y1 >= y0 and id is not null").groupBy(page, *corners).agg(F.sort_array(F.collect_list("id")).alias("_all"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(PIECE)), lambda i: F.slice("_all", i, PIECE))
    placed = equal.select(page, *corners, F.posexplode(pieces).alias("_piece", "_ids")).withColumn("_cx", F.explode(squares("x0", "x1"))).withColumn("_cy", F.explode(squares("y0", "y1")))
    square = Window.partitionBy(page, "_cx", "_cy")
    placed = placed.withColumn("_n", F.row_number().over(square.orderBy(*corners, "_piece")) - 1).withColumn("_parts", F.ceil(F.count(F.lit(1)).over(square) / PART))
    part = F.floor(F.col("_n") / PART)
    keys = [page, "_cx", "_cy", "_i", "_j"]
    # By number, as the pairs are many times what is dealt out and sizes say nothing of them.
    tasks = max(TASKS, int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = placed.withColumn("_i", part).withColumn("_j", F.explode(F.sequence(part, F.col("_parts") - 1))).repartition(tasks, *keys).alias("a")
    b = placed.withColumn("_j", part).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), part))).repartition(tasks, *keys).alias("b")
    met = F.col("a._n") <= F.col("b._n")
    for key in keys:
        met = met & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    corner = (F.col("a._cx") == F.floor(F.greatest("a.x0", "b.x0") / cell)) & (F.col("a._cy") == F.floor(F.greatest("a.y0", "b.y0") / cell))
    width = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    height = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    lists = a.join(b.hint("merge"), met & corner & (width > 0) & (height > 0) & (width * height > least))
    lists = lists.select(F.col(f"a.{page}").alias(page), (F.col("a._n") == F.col("b._n")).alias("_same"), F.col("a._ids").alias("_a"), F.col("b._ids").alias("_b"), (width * height).alias("area"))
    pairs = lists.withColumn("_a", F.explode("_a")).withColumn("_b", F.explode("_b")).where((F.col("_a") < F.col("_b")) | ((F.col("_a") > F.col("_b")) & ~F.col("_same")))
    return pairs.select(page, F.least("_a", "_b").alias("id"), F.greatest("_a", "_b").alias("other"), "area")


def paginate(blocks: DataFrame, height: str, page_height: float) -> DataFrame:
    """Adds ``page``: blocks fill a page until one no longer fits; a page break block ends it.

    Goes once through each document's blocks, in document order; a block taller than a page has one of its own.
    """

    def fill(pdf):
        page, used, pages = 0, 0.0, []
        pdf = pdf.sort_values("seq", kind="stable")
        for h, ends in zip(pdf["h"], pdf["brk"], strict=True):
            if used > 0 and used + h > page_height:
                page, used = page + 1, 0.0
            used += h
            pages.append(page)
            if ends:
                page, used = page + 1, 0.0
        return pdf.assign(page=pages)[["doc_id", "seq", "page"]]

    placed = blocks.select("doc_id", F.col("seq").cast("int").alias("seq"), F.coalesce(F.col(height).cast("double"), F.lit(0.0)).alias("h"), F.coalesce(F.col("type") == "page_break", F.lit(False)).alias("brk"))
    return placed.groupBy("doc_id").applyInPandas(fill, T.StructType([placed.schema["doc_id"], T.StructField("seq", T.IntegerType()), T.StructField("page", T.IntegerType())]))


def on_pages(nodes: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The page of each top-level block, from boundaries (doc_id, page, start node_id): the last boundary at or before it."""
    starts = boundaries.select("doc_id", F.col("start").alias("node_id"), "page")
    marked = nodes.where("depth = 0").join(starts, ["doc_id", "node_id"], "left")
    return marked.select("doc_id", "seq", "node_id", F.last("page", ignorenulls=True).over(_document().rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("page"))
