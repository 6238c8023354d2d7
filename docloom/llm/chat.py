"""Chat formatting: each participant's view of a dialogue, with training masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns are summed in blocks of so many turn numbers, so that a long dialogue spreads over tasks.
BLOCK = 64


def _plain(text: Column) -> Column:
    """Text whose own frame markers are broken by a space, so that no turn can forge a frame."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def rotate_perspectives(turns: DataFrame, system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """Renders every dialogue once for each of its participants, as one row per turn.

    In the view of a participant, its own turns are the assistant's and are trained on; the
    others' are named user turns; ``system_roles`` stay system turns and take no part. Joined
    in the order of ``start_char`` the rows ``rendered`` make up the dialogue; the mask covers
    a trained turn's text and end marker (``mask_start`` up to ``mask_end``; null elsewhere).
    Rows rather than one string per dialogue keep a dialogue of any length bounded in memory.

    Null conversation ids make up one dialogue; a null role is the speaker ``unknown``; a null
    text is empty; null turns come first; ties are ordered by role, then text; repeated rows are
    kept. A dialogue of system turns only has no participant and gives no rows.
    """
    clean = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        _plain(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),  # no id is equal to null
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK).cast("long").alias("block"),
    )
    is_system = F.col("speaker").isin(*system_roles)
    own = F.col("speaker") == F.col("perspective")
    header = (
        F.when(is_system, F.lit(f"{OPEN}system\n"))
        .when(own, F.lit(f"{OPEN}assistant\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), _plain(F.regexp_replace("speaker", r"\s+", "_")), F.lit("\n")))
    )
    # Lengths of blocks, from counts by speaker; texts themselves are shuffled once, by block.
    said = clean.groupBy("key", "block", "speaker").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("signs"))
    views = said.where(~is_system).select("key", F.col("speaker").alias("perspective")).distinct()
    frame = F.length(header) + len(f"{CLOSE}\n")
    blocks = said.join(views, "key").groupBy("key", "perspective", "block").agg(F.sum(F.col("signs") + F.col("turns") * frame).alias("n"))
    earlier = Window.partitionBy("key", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("key", "perspective", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    seen = (
        clean.join(bases, ["key", "block"])
        .withColumn("header", header)
        .withColumn("trained", ~is_system & own)
        .withColumn("role", F.when(is_system, "system").when(own, "assistant").otherwise("user"))
        .withColumn("rendered", F.concat("header", "text", F.lit(f"{CLOSE}\n")))
        .withColumn("n", F.length("rendered").cast("long"))
    )
    before = Window.partitionBy("key", "block", "perspective").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))
    placed = seen.withColumn("start_char", start.cast("long"))
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "role",
        "rendered",
        "start_char",
        (F.col("start_char") + F.col("n")).alias("end_char"),
        "trained",
        F.when(F.col("trained"), F.col("start_char") + F.length("header")).alias("mask_start"),
        F.when(F.col("trained"), F.col("start_char") + F.col("n") - 1).alias("mask_end"),
    )


def dialogues(views: DataFrame) -> DataFrame:
    """conv_id, perspective, text and masks (the trained stretches, from and up to) of whole dialogues, one row each.

    For dialogues that fit in a task's memory; :func:`rotate_perspectives` itself has no such bound.
    """
    turns = F.array_sort(F.collect_list(F.struct("start_char", "rendered", "mask_start", "mask_end")))
    whole = views.groupBy("conv_id", "perspective").agg(turns.alias("turns"))
    masks = F.transform(F.filter("turns", lambda t: t["mask_start"].isNotNull()), lambda t: F.struct(t["mask_start"].alias("start"), t["mask_end"].alias("end")))
    return whole.select("conv_id", "perspective", F.array_join(F.col("turns.rendered"), "").alias("text"), masks.alias("masks"))
