"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are copies when they are equal without the white space around them, and near copies
when both have at least ``MIN_WORDS`` words and at most one word inserted, deleted or replaced
turns one's words into the other's. A line goes when an equal or near line stands earlier, by
(doc_id, line number); that earlier line need not itself be kept.

The neighbourhood of a line holds what is left after each single deletion, as hashed keys that
keep the order of the words. A replaced word leaves two lines with the same rest at the same place;
an inserted word leaves a line equal to the other's rest. Every bucket of equal keys is reduced to
its earliest line before it is joined back, so no bucket is expanded into pairs. Only lines that
share a half with another line can have a neighbour (one edit leaves one half untouched), so only
those emit variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import flagged, key_filter, maybe_in, partitions, release, stored, sweep

#: Default of ``min_words``: shorter lines are compared for equality only, as one word of eight is the largest edit.
MIN_WORDS = 8
_BLANK = " \t\r"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\r", "  "), " "), "")


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with its place ``at``, its text and the text's 128-bit hash."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    trimmed = F.trim(F.col("line"), F.lit(_BLANK))
    return (
        rows.where(trimmed != "")
        .select(F.struct("doc_id", "row", "line_no").alias("at"), trimmed.alias("said"))
        .withColumns({"h1": F.xxhash64("said"), "h2": F.xxhash64(F.lit(1), "said")})
    )


def _half_keys(min_words: int) -> Column:
    """Hashes of the first and the last half, for partners of the same and of one word less."""

    def side(half: Column) -> list[Column]:
        return [F.xxhash64(F.lit("a"), F.slice("words", F.lit(1), half)), F.xxhash64(F.lit("z"), F.slice("words", F.col("n") - half + 1, half))]

    same, less = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
    return F.when(F.col("n") < min_words, F.array().cast("array<bigint>")).when(same == less, F.array(*side(same))).otherwise(F.array(*side(same), *side(less)))


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines that go: doc_id, row, line_no, the earlier line kept_doc_id, kept_line_no, and near (0 for a copy, else 1).

    Lines of fewer than ``min_words`` words go for an equal line only; with 1 every line's near
    copies count. ``row`` is the hash of the row's text: rows that repeat both id and text count as
    one document. A null text has no lines, blank lines always stay, a null doc_id comes first, and
    an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    base = _lines(docs).withColumn("words", _words(F.col("said"))).withColumn("n", F.size("words"))
    base = stored(base.withColumn("halves", _half_keys(min_words)).drop("words", "said"), "lines")
    distinct = stored(
        base.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("halves").alias("halves")),
        "distinct-lines",
    )
    sweep(spark)
    halves = distinct.where(F.col("n") >= min_words).select("h1", F.explode("halves").alias("half"))
    shared = stored(halves.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("half"), "shared-halves")
    suspects = maybe_in(halves, F.col("half"), key_filter(shared, "half")).join(shared, "half", "left_semi").select("h1").distinct()
    suspects = stored(distinct.join(suspects, "h1", "left_semi").select("h1", "h2", "n", "first"), "suspect-lines")
    sweep(spark)

    # Their words, from the place where each stands first; the filter spares the others a shuffle.
    again = maybe_in(_lines(docs).select("at", "said", "h1"), F.col("h1"), key_filter(suspects, "h1")).drop("h1")
    texts = again.dropDuplicates(["at"]).join(suspects, again["at"] == suspects["first"])
    texts = stored(texts.select("h1", "h2", "n", "first", _words(F.col("said")).alias("words")), "suspect-words")
    release(shared, suspects)
    sweep(spark)

    near = stored(_replaced(texts).unionByName(_inserted(texts, min_words)), "near-lines")
    earlier = near.groupBy("h1", "h2").agg(F.min("earlier").alias("earlier"))
    known = stored(
        distinct.select("h1", "h2", "copies", "first").join(earlier, ["h1", "h2"], "left").where("copies > 1 or earlier is not null"),
        "known-lines",
    )
    release(distinct, texts, near)
    sweep(spark)
    gone = base.select("at", "h1", "h2").join(known, ["h1", "h2"]).where((F.col("at") != F.col("first")) | F.col("earlier").isNotNull())
    kept = F.when(F.col("at") != F.col("first"), F.col("first")).otherwise(F.col("earlier"))
    result = gone.select("at.*", kept.alias("kept"), (F.col("at") == F.col("first")).cast("int").alias("near"))
    return result.select("doc_id", "row", F.col("line_no").cast("long").alias("line_no"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").cast("long").alias("kept_line_no"), "near")


def _placed(shift: int) -> Column:
    """Hashes of the words with their places, moved by ``shift``; their XOR stands for the words in order."""
    return F.transform("words", lambda w, i: F.xxhash64(w, i + F.lit(shift)))


def _all(hashes: str) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _replaced(texts: DataFrame) -> DataFrame:
    """Lines of equal length that differ in one place: equal rests after the same deletion."""
    whole = texts.withColumn("hs", _placed(0)).withColumn("all", _all("hs"))
    rests = whole.select("h1", "h2", "n", "first", F.posexplode("hs").alias("i", "h"), "all")
    rests = rests.select("h1", "h2", F.xxhash64("n", "i", F.col("all").bitwiseXOR(F.col("h"))).alias("rest"), "first")
    earliest = rests.groupBy("rest").agg(F.count(F.lit(1)).alias("lines"), F.min(F.struct("first", "h1", "h2")).alias("e")).where("lines > 1")
    earliest = stored(earliest.select("rest", "e"), "rests")
    found = maybe_in(rests, F.col("rest"), key_filter(earliest, "rest")).join(earliest, "rest").where(F.col("e.first") < F.col("first"))
    found = found.groupBy("h1", "h2").agg(F.min("e").alias("e")).select("h1", "h2", "e")
    words = texts.select("h1", "h2", "words")
    other = words.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("words").alias("others"))
    both = found.join(words, ["h1", "h2"]).join(other, (F.col("e.h1") == F.col("o1")) & (F.col("e.h2") == F.col("o2")))
    edits = F.size(F.filter(F.zip_with("words", "others", lambda a, b: a != b), lambda x: x))
    return both.where((F.size("words") == F.size("others")) & (edits <= 1)).select("h1", "h2", F.col("e.first").alias("earlier"))


def _inserted(texts: DataFrame, min_words: int) -> DataFrame:
    """Lines of which one has one word more: a rest of the longer equals the whole shorter.

    Words after the deleted one move up by a place: their hashes with the place before, those of
    the words ahead with their own place. A running XOR turns the ones into the others.
    """
    whole = texts.withColumn("hs", _placed(0)).select("h1", "h2", F.xxhash64("n", _all("hs")).alias("rest"), F.xxhash64("words").alias("w1"), F.xxhash64(F.lit(1), "words").alias("w2"), "first")
    whole = stored(whole, "whole-lines")
    longer = texts.where(F.col("n") > min_words).repartition(partitions(texts.sparkSession), "h1", "h2")
    moved = longer.withColumn("hs", F.arrays_zip(_placed(0).alias("own"), _placed(-1).alias("moved"))).withColumn("all", F.aggregate("hs", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["moved"])))
    each = moved.select("h1", "h2", "n", "first", "all", F.posexplode("hs").alias("i", "h"))
    ahead = F.bit_xor(F.col("h.own").bitwiseXOR(F.col("h.moved"))).over(Window.partitionBy("h1", "h2").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    rest = F.col("all").bitwiseXOR(F.col("h.moved")).bitwiseXOR(F.coalesce("ahead", F.lit(0).cast("long")))
    rests = each.withColumn("ahead", ahead).select("h1", "h2", "i", F.xxhash64(F.col("n") - 1, rest).alias("rest"), "first")
    rests = stored(maybe_in(rests, F.col("rest"), key_filter(whole, "rest")), "longer-rests")
    short = whole.select("rest", "w1", "w2", F.col("first").alias("short"), F.col("h1").alias("s1"), F.col("h2").alias("s2"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = F.concat(F.slice("words", F.lit(1), F.col("i")), F.slice("words", F.col("i") + 2, F.size("words")))
        said = pairs.join(texts.select("h1", "h2", "words"), ["h1", "h2"])
        return said.where((F.xxhash64(left) == F.col("w1")) & (F.xxhash64(F.lit(1), left) == F.col("w2")))

    goes = rests.join(short, "rest").where(F.col("short") < F.col("first"))  # equal rests have one whole line
    goes = goes.groupBy("h1", "h2").agg(F.min(F.struct("short", "i", "w1", "w2")).alias("e")).select("h1", "h2", "e.*")
    earliest = rests.groupBy("rest").agg(F.min(F.struct("first", "h1", "h2", "i")).alias("e")).select("rest", "e.*")
    stays = earliest.join(short, "rest").where(F.col("first") < F.col("short"))
    return verified(goes).select("h1", "h2", F.col("short").alias("earlier")).unionByName(verified(stays).select(F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.col("first").alias("earlier")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with duplicate lines taken out of ``text``; same columns, ``n_chars`` counted anew if there.

    A document that loses all its lines goes; one that loses none comes back unchanged, so null
    and empty texts stay. Rows that repeat id and text lose the same lines. Columns of any name
    pass; see :func:`duplicate_lines` for the rest.
    """
    gone = duplicate_lines(docs, min_words).groupBy(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).agg(F.collect_set("line_no").alias("gone"))
    gone = stored(gone, "gone-lines")
    sweep(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("doc"), F.xxhash64("text").alias("row"), F.col("doc_id").alias("id"))
    rows = flagged(rows, F.col("row"), key_filter(gone, "gone_row"), "hit")
    hit = rows.where("hit").join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")
    lines = F.split(F.col("doc.text"), "\n")
    # The lines that stay, by number: linear in the lines, which one struct holds so that they are split once.
    numbered = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines) - F.lit(1).cast("long")), "gone").alias("stay")))
    kept = F.transform(numbered, lambda d: F.transform(d["stay"], lambda i: F.get(d["lines"], i.cast("int"))))[0]
    hit = hit.withColumn("kept", F.when(F.col("gone").isNotNull(), kept)).where(F.col("gone").isNull() | F.exists("kept", lambda x: F.trim(x, F.lit(_BLANK)) != ""))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join("kept", "\n"))
    columns = {c: F.col("doc")[c].alias(c) for c in docs.columns} | {"text": text.alias("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("gone").isNull(), F.col("doc.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return hit.select(*columns.values()).unionByName(rows.where(~F.col("hit")).select("doc.*"))
