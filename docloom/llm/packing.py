"""Best-fit packing of token sequences after Martello and Toth's dominance reduction."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import partitions, small_batches, stored, trimmed
from .words import TextEncoder, word_pieces

#: Pieces that a process holds: fewer than elsewhere, as packing ends a pipeline whose workers are still there.
HELD_PIECES = 450_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_RUNS = "length long, first long, last long, sequence long, per int, offset int"


class _Pool:
    """Counts by length, with lookups of the largest length under a bound."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def largest(self, bound: int) -> int:
        i = bisect.bisect_right(self.sizes, bound)
        return self.sizes[i - 1] if i else 0

    def smallest(self, n: int) -> list[int]:
        found: list[int] = []
        for size in self.sizes:
            found += [size] * min(self.counts[size], n - len(found))
            if len(found) == n:
                break
        return found

    def best_pair(self, bound: int) -> int:
        """The largest sum of two items that is at most ``bound``, 0 if none."""
        best, lo, hi = 0, 0, len(self.sizes) - 1
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > bound or (lo == hi and self.counts[a] < 2):
                hi -= 1
            else:
                best = max(best, a + b)
                lo += 1
        return best


def solve(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Packs ``counts`` (items by length) into bins of ``capacity``: patterns of (length, times) and their counts.

    Dominance reduction first. For an item j with free room r beside it, the set {j, best single
    partner} dominates every other set that holds j when the partner fills r, when no two others
    fit into r, or when no three fit and the partner is at least as long as any two that fit; then
    it is fixed for good (a swap argument shows that some best packing holds it). All copies of a
    pair are fixed at once, as the premises stay true while both lengths last. Rounds repeat while
    they fix anything, as smaller instances give new reductions. The rest goes best-fit by
    decreasing length, a whole length at a time. The work depends on the capacity, not on the
    number of items.
    """
    pool, fixed = _Pool({k: n for k, n in counts.items() if 0 < k <= capacity}), []
    changed = True
    while changed and pool.counts:
        changed = False
        for size in reversed(pool.sizes.copy()):
            while pool.counts.get(size):
                n, room = pool.counts[size], capacity - size
                pool.take(size, 1)
                partner, few = pool.largest(room), pool.smallest(3)
                dominates = (
                    partner == room
                    or len(few) < 2
                    or few[0] + few[1] > room
                    or ((len(few) < 3 or sum(few) > room) and partner >= pool.best_pair(room))
                )
                pool.counts[size] = pool.counts.get(size, 0) + 1
                if n == 1:
                    bisect.insort(pool.sizes, size)
                if not dominates:
                    break
                changed = True
                if not partner:
                    fixed.append(([(size, 1)], n))
                    pool.take(size, n)
                elif partner == size:
                    fixed.append(([(size, 2)], n // 2))
                    pool.take(size, n // 2 * 2)
                else:
                    times = min(n, pool.counts[partner])
                    fixed.append(([(size, 1), (partner, 1)], times))
                    pool.take(size, times)
                    pool.take(partner, times)
    return [(p, n) for p, n in fixed + _best_fit(pool.counts, capacity) if n]


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over counts; bins of equal content are handled as one group."""
    groups: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if n and not groups[room]:
            bisect.insort(rooms, room)
        if n:
            groups[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                per = capacity // size
                put(capacity - per * size, ((size, per),), left // per)
                if left % per:
                    put(capacity - left % per * size, ((size, left % per),), 1)
                break
            room = rooms[i]
            pattern, n = groups[room].pop()
            if not groups[room]:
                rooms.pop(i)
            per = room // size
            whole = min(n, left // per)
            put(room - per * size, (*pattern, (size, per)), whole)
            left -= whole * per
            if whole < n and left < per:
                if left:
                    put(room - left * size, (*pattern, (size, left)), 1)
                    whole += 1
                left = 0
            put(room, pattern, n - whole)
    return [(list(pattern), n) for same in groups.values() for pattern, n in same]


def _runs(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length, which ranks go to which sequences and where: one row per pattern and length.

    Rank r of a run goes to sequence ``sequence + (r - first) // per`` at
    ``offset + (r - first) % per * length``.
    """
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, per in pattern:
            rows.append((length, ranks[length], ranks[length] + n * per, sequence, per, offset))
            ranks[length] += n * per
            offset += length * per
        sequence += n
    return rows


def pack(items: DataFrame, capacity: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Adds sequence_id and offset (long): every item in one sequence of at most ``capacity``, gapless from 0.

    Only the counts by length (at most ``capacity`` rows) reach the driver, and the runs that come
    back are bounded by the capacity as well: best fit makes at most three groups for each length,
    with at most ~sqrt(2 * capacity) distinct lengths each. Items rank within their length, in as
    many segments as there are shuffle partitions, so a length that a third of the items share is
    ranked by many tasks. ``items`` is read three times; pass a stored table. Items longer than
    ``capacity`` or null are an error; an empty table gives no rows.
    """
    spark, segments = items.sparkSession, partitions(items.sparkSession)
    items = items.withColumn("_segment", F.pmod(F.xxhash64(*order), F.lit(segments)).cast("int"))
    counts = stored(items.groupBy(length, "_segment").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    totals = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum("n")).collect()}
    if any(k is None or not 0 < k <= capacity for k in totals):
        raise ValueError("every length must be from 1 to the capacity")
    runs = spark.createDataFrame(_runs(solve(totals, capacity)), _RUNS)
    before = Window.partitionBy(length).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(length, "_segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(length, "_segment").orderBy(*order))
    ranked = items.withColumn("_within", within).join(bases, [length, "_segment"]).withColumn("_rank", F.col("_base") + F.col("_within") - 1)
    runs = F.broadcast(runs.withColumnsRenamed({"length": "_length", "offset": "_offset"}))
    placed = ranked.join(runs, (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last")))
    at = F.col("_rank") - F.col("first")
    return placed.select(
        *[c for c in items.columns if c != "_segment"],
        (F.col("sequence") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("per") * F.col(length)).cast("long").alias("offset"),
    )


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` token ids; only longer documents are cut.

    Columns doc_id, piece, start, length, ids_crc32 and, on request, ids (array<long>). A null or
    empty text is the end id alone; null ids and repeated rows are kept as they are.
    """

    def run(batches):
        encoder = TextEncoder.of_tokenizer(tokenizer_path, word_pieces, HELD_PIECES)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids = found.tobytes() + end
                for piece, at in enumerate(range(0, len(ids), capacity * 4)):
                    cut = ids[at : at + capacity * 4]
                    row = (doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut))
                    rows.append((*row, np.frombuffer(cut, "<u4").astype(np.int64)) if with_ids else row)
                if with_ids and len(rows) >= 512:
                    yield _batch(rows, with_ids)
                    rows = []
            yield _batch(rows, with_ids)

    def _batch(rows, with_ids):
        import pyarrow as pa

        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), _PIECES + ", ids array<long>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs whole documents; see :func:`token_pieces` and :func:`pack`."""
    return pack(stored(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces"), capacity)
