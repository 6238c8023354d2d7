"""Search, replacement and templates in the text of inlines and headings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import INLINE_NAMES

#: Nodes whose text is searched and edited.
SEARCHED = ("paragraph", "heading", "list_item")
DELIMITER = ("{{", "}}")


def _replaced(inline: Column, text: Column) -> Column:
    """The inline with another text."""
    return F.struct(*[(text if n == "text" else inline[n]).alias(n) for n in INLINE_NAMES])


def with_matches(df: DataFrame, key: list[str], text: str, pattern: str) -> DataFrame:
    """A row for each match of ``pattern`` in ``text``, with match, start and end in code points; ``key`` tells rows apart.

    Offsets are running sums over the gaps and hits of a text. Patterns must not match the empty text.
    """
    if re.search(pattern, ""):
        raise ValueError("the pattern must not match the empty text")
    hits = df.where(F.col(text).rlike(pattern)).withColumn("_hits", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).withColumn("_gaps", F.split(F.col(text), pattern, -1))
    pairs = F.zip_with("_hits", F.slice("_gaps", F.lit(1), F.size("_hits")), lambda h, g: F.struct(h.alias("hit"), F.length(g).cast("long").alias("gap")))
    each = hits.select(*key, F.posexplode(pairs).alias("_i", "_m"))
    so_far = Window.partitionBy(*key).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("_m.gap") + F.length("_m.hit")).over(so_far)
    return each.withColumn("end", end).select(*key, F.col("_m.hit").alias("match"), (F.col("end") - F.length("_m.hit")).alias("start"), "end")


def _texts(nodes: DataFrame) -> DataFrame:
    """One row per searched text: a heading's own, or each inline's."""
    kept = nodes.where(F.col("type").isin(*SEARCHED))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.col("text").alias("t")))
    each = F.transform("inlines", lambda x, i: F.struct(i.alias("i"), x["text"].alias("t")))
    listed = F.when((F.col("type") == "heading") & F.col("text").isNotNull(), whole).otherwise(each)
    return kept.select("doc_id", "seq", "node_id", "type", F.explode(listed).alias("x")).select("doc_id", "seq", "node_id", "type", F.col("x.i").alias("inline_idx"), F.col("x.t").alias("text")).where("text is not null")


def find_text(nodes: DataFrame, pattern: str) -> DataFrame:
    """One row per match of a regular expression, with offsets in its inline; matches never span inlines."""
    return with_matches(_texts(nodes), ["doc_id", "seq", "node_id", "inline_idx"], "text", pattern)


def occurrences(text: Column, old: str) -> Column:
    """Occurrences of a literal that do not overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("long")


def replace_text(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """Nodes with a literal replaced, in headings' texts as in their inlines; adds ``replaced``, the count per node."""
    if not old:
        raise ValueError("the text to replace must not be empty")
    edited = F.col("type").isin(*SEARCHED)
    in_text = F.when(edited & (F.col("type") == "heading"), occurrences(F.coalesce("text", F.lit("")), old)).otherwise(0)
    in_inlines = F.coalesce(F.aggregate("inlines", F.lit(0).cast("long"), lambda n, i: n + F.coalesce(occurrences(i["text"], old), F.lit(0))), F.lit(0))
    changed = F.transform("inlines", lambda i: _replaced(i, F.replace(i["text"], F.lit(old), F.lit(new))))
    return nodes.select(
        *[c for c in nodes.columns if c not in ("text", "inlines")],
        F.when(edited & (F.col("type") == "heading"), F.replace("text", F.lit(old), F.lit(new))).otherwise(F.col("text")).alias("text"),
        F.when(edited, changed).otherwise(F.col("inlines")).alias("inlines"),
        F.when(~edited, 0).when((F.col("type") == "heading") & F.col("text").isNotNull(), in_text).otherwise(in_inlines).cast("long").alias("replaced"),
    )


def fill_template(nodes: DataFrame, values: dict[str, str | None], delimiter: tuple[str, str] = DELIMITER) -> DataFrame:
    """Nodes with ``{{key}}`` filled, key after key: a value that holds a later key is filled in turn. None fills nothing in."""

    def filled(text: Column) -> Column:
        for key, value in values.items():
            text = F.replace(text, F.lit(delimiter[0] + key + delimiter[1]), F.lit(value or ""))
        return text

    edited = F.col("type").isin(*SEARCHED)
    return nodes.withColumns(
        {
            "text": F.when(edited & (F.col("type") == "heading"), filled(F.col("text"))).otherwise(F.col("text")),
            "inlines": F.when(edited, F.transform("inlines", lambda i: _replaced(i, filled(i["text"])))).otherwise(F.col("inlines")),
        }
    )


def list_placeholders(nodes: DataFrame, delimiter: tuple[str, str] = DELIMITER) -> DataFrame:
    """One row per placeholder: where it stands and its key."""
    left, right = (re.escape(d) for d in delimiter)
    keys = F.regexp_extract_all("text", F.lit(f"{left}(.+?){right}"), F.lit(1))
    return _texts(nodes).select("doc_id", "seq", "node_id", "inline_idx", F.explode(keys).alias("key"))


def unfilled(nodes: DataFrame, delimiter: tuple[str, str] = DELIMITER) -> DataFrame:
    """Documents that a strict fill would refuse, with their number of placeholders."""
    return list_placeholders(nodes, delimiter).groupBy("doc_id").agg(F.count(F.lit(1)).alias("left"))


def set_placeholders(nodes: DataFrame, wanted: DataFrame, delimiter: tuple[str, str] = DELIMITER) -> tuple[DataFrame, DataFrame]:
    """Puts ``{{key}}`` into inlines: ``wanted`` has doc_id, node_id, inline_idx (null: append) and key.

    Returns the nodes and the rows of ``wanted`` that were refused, with the reason. A node takes one
    placeholder for each inline; keys are letters, digits and underscores.
    """
    target = nodes.where("node_id is not null").select("doc_id", "node_id", F.col("type").alias("_type"), F.size(F.coalesce("inlines", F.array())).alias("_n"))
    checked = wanted.join(target, ["doc_id", "node_id"], "left")
    reason = (
        F.when(F.col("_type").isNull(), "no such block")
        .when(~F.col("_type").isin("paragraph", "heading"), "not a paragraph or heading")
        .when(~F.col("key").rlike(r"^[A-Za-z0-9_가-힣]+$"), "bad key")
        .when(F.col("inline_idx") >= F.col("_n"), "no such inline")
    )
    checked = checked.withColumn("reason", reason)
    good = checked.where("reason is null").groupBy("doc_id", "node_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("inline_idx", F.lit(-1)).alias("i"), F.concat(F.lit(delimiter[0]), "key", F.lit(delimiter[1])).alias("t")))).alias("_put")
    )
    blank = F.struct(*[F.lit("text").alias(n) if n == "type" else F.lit(None).cast(t).alias(n) for n, t in _INLINE_TYPES])
    put = F.transform(F.coalesce("inlines", F.array().cast(_INLINE_ARRAY)), lambda x, i: _replaced(x, F.coalesce(F.try_element_at("_put", i), x["text"])))
    extended = F.when(F.map_contains_key("_put", -1), F.concat(put, F.array(_replaced(blank, F.try_element_at("_put", F.lit(-1)))))).otherwise(put)
    joined = nodes.join(good, ["doc_id", "node_id"], "left")
    inlines = F.when(F.col("_put").isNull(), F.col("inlines")).otherwise(extended)
    said = F.array_join(F.transform(inlines, lambda x: F.coalesce(x["text"], F.lit(""))), "")
    changed = joined.withColumns({"text": F.when(F.col("_put").isNotNull() & (F.col("type") == "heading"), said).otherwise(F.col("text")), "inlines": inlines})
    return changed.select(*nodes.columns), checked.where("reason is not null").select(*wanted.columns, "reason")


from ..model import INLINE_FIELDS  # noqa: E402

_INLINE_TYPES = [(n, t.simpleString()) for n, t in INLINE_FIELDS]
_INLINE_ARRAY = "array<struct<" + ",".join(f"{n}:{t}" for n, t in _INLINE_TYPES) + ">>"
