"""Context-triggered piecewise hashing of texts."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, powers, segment_hash, segment_sums, small_batches, trimmed
from .words import rows_of

WINDOW, LEAST_BLOCK, LENGTH, COMMON = 7, 1, 64, 4
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def fingerprint(text: str | None) -> str:
    """``block:signature:signature at twice the block``; equal texts have equal fingerprints.

    A chunk of the UTF-8 bytes ends where the hash of the last seven bytes ends in as many one
    bits as the block size (a power of two) has; each chunk gives one of 64 letters. The block
    size is the smallest that gives about 64 chunks, halved while it gives under 32. What follows
    the 64th chunk (the 32nd of the second signature) is folded into the last letter. A null
    text counts as empty.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    sums = segment_sums(data)
    block = LEAST_BLOCK
    while block * LENGTH < n:
        block *= 2
    if n >= WINDOW:
        _, backward = powers(n)
        rolled = mix64((sums[WINDOW:] - sums[:-WINDOW]) * backward[: n - WINDOW + 1])
        ends = np.flatnonzero((rolled & np.uint64(LEAST_BLOCK - 1)) == LEAST_BLOCK - 1)
        tails = rolled[ends]
        ends = ends + WINDOW
    else:
        ends, tails = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def cuts(size: int) -> np.ndarray:
        return ends[(tails & np.uint64(size - 1)) == size - 1]

    while block > LEAST_BLOCK and len(cuts(block)) < LENGTH // 2:
        block //= 2

    def signature(size: int, length: int) -> str:
        at = cuts(size)[: length - 1]
        starts = np.concatenate(([0], at))
        stops = np.append(at, n)
        whole = starts < stops
        return _LETTERS[(segment_hash(sums, starts[whole], stops[whole]) >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    return f"{block}:{signature(block, LENGTH)}:{signature(2 * block, LENGTH // 2)}"


def _likeness(a: str, b: str) -> float:
    """1 - edit distance (insertions and deletions) / total length, 0 without a common run of four letters."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < COMMON or not any(a[i : i + COMMON] in b for i in range(len(a) - COMMON + 1)):
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:  # the longest common subsequence, all of a's places at once
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints from 0 to 1; 0 where their block sizes are not compatible."""
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    p, q = int(x), int(y)
    if p == q:
        return max(_likeness(x1, y1), _likeness(x2, y2))
    if p == 2 * q:
        return _likeness(x1, y2)
    return _likeness(x2, y1) if q == 2 * p else 0.0


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of the next document."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see :func:`edited_text`.

    The next document is the one of the next smaller doc_id (ties by a hash of the text; null ids last), after the last the
    first. Rows are dealt by ranges of doc_id, whose borders are quantiles that the driver reads
    (four for each shuffle partition); each range also gets the row that follows it, so a text is
    moved once. Null texts are empty. A single document follows itself; an empty table gives no
    rows; repeated rows follow each other. Other columns of ``docs`` are not read.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    small_batches(spark)
    count = partitions(spark)
    order = F.xxhash64("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    ranges = 4 * count  # several to a task, so that tasks are even
    borders = sorted(set(ids.where("id is not null").stat.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    splits = [float("-inf"), *borders, float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    bucketed = Bucketizer(splits=splits, inputCol="id", outputCol="range").transform(docs.withColumn("id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-1.7e308")))))
    placed = bucketed.select("doc_id", "text", F.col("range").cast("int").alias("range"), order.alias("tie"))
    first = F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("tie").alias("tie")))
    firsts = sorted((r["range"], r["f"]["doc_id"], r["f"]["tie"]) for r in placed.groupBy("range").agg(first.alias("f")).collect())
    if not firsts:
        return spark.createDataFrame([], _FOUND)
    # The first row of each range follows the last row of the range above; that of the highest, the very last row.
    guests = [(i, t, firsts[(k + 1) % len(firsts)][0]) for k, (_, i, t) in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(guests, "g_id long, g_tie long, g_range int"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    joined = placed.join(guests, (key == F.col("g_id")) & (F.col("tie") == F.col("g_tie")), "left")
    targets = F.filter(F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(F.col("g_range").alias("range"), F.lit(True).alias("guest"))), lambda t: t["range"].isNotNull())
    dealt = joined.select("doc_id", "text", "tie", F.explode(targets).alias("to")).select("doc_id", "text", "tie", "to.range", "to.guest")
    dealt = dealt.repartition(count, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.desc("tie"))

    def run(batches):
        import pyarrow as pa

        def row_of(doc_id, text, mark, following, next_mark):
            edited = edited_text(text, following)
            edited_mark = fingerprint(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, len(text), digest, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark)

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in _FOUND.split(", ")]
        waiting = None
        for batch in batches:
            rows = []
            for doc_id, text, where, guest in rows_of(batch, "doc_id", "text", "range", "guest"):
                mark = fingerprint(text)
                if waiting and waiting[3] == where:
                    rows.append(row_of(*waiting[:3], text, mark))
                waiting = None if guest else (doc_id, text, mark, where)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return dealt.select("doc_id", "text", "range", "guest").mapInArrow(trimmed(run), _FOUND)
