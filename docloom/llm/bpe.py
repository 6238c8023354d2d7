"""Byte-level BPE by merge ranks, with a queue of ranks kept in a hierarchy of bitmaps."""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed
from .words import TextEncoder, byte_pieces

_SHARED: dict[tuple[str, str], tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Positions by rank; the lowest rank is found by three find-first-set steps.

    Each level has one bit for each non-empty word (or bucket) of the level below, 64 to a word.
    Positions of one rank leave in ascending order.
    """

    def __init__(self, ranks: int):
        words = (ranks + 63) // 64
        self._buckets: dict[int, list[int]] = {}
        self._low, self._mid, self._top = [0] * words, [0] * ((words + 63) // 64), 0

    def push(self, rank: int, position: int) -> None:
        bucket = self._buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self._buckets[rank] = [position]
        word = rank >> 6
        if not self._low[word]:
            if not self._mid[word >> 6]:
                self._top |= 1 << (word >> 6)
            self._mid[word >> 6] |= 1 << (word & 63)
        self._low[word] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, int] | None:
        if not self._top:
            return None
        high = (self._top & -self._top).bit_length() - 1
        mid = self._mid[high]
        word = high << 6 | (mid & -mid).bit_length() - 1
        low = self._low[word]
        rank = word << 6 | (low & -low).bit_length() - 1
        bucket = self._buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self._buckets[rank]
            self._low[word] ^= 1 << (rank & 63)
            if not self._low[word]:
                self._mid[high] ^= 1 << (word & 63)
                if not self._mid[high]:
                    self._top ^= 1 << high
        return rank, position


class BytePairEncoder:
    """Merges the adjacent pair of lowest rank, leftmost first, until no pair has a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._queue = RankQueue(max(ranks.values(), default=0) + 1)

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token; about n log n steps, whatever its length."""
        ranks, queue = self.ranks, self._queue
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # the rank of the pair that starts here, as last pushed
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue  # stale: one of the two has been merged since
            gone = following[i]
            pair[gone] = -1
            after = following[gone]
            following[i] = after
            if after < n:
                previous[after] = i
            for start, end in ((i, following[after] if after < n else -1), (previous[i], after)):
                if start < 0:
                    continue
                new = ranks.get(piece[start:end]) if 0 < end - start <= self.longest else None
                pair[start] = -1 if new is None else new
                if new is not None:
                    queue.push(new, start)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : following[i]]])
            i = following[i]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def pretokens(text: str, pattern: str) -> list[str]:
    import regex

    return regex.findall(pattern, text)


def shared_encoder(ranks_path: str, pattern: str):
    """The encoder of whole columns and the decoder of a rank file, one of each for a process."""
    key = (ranks_path, pattern)
    if key not in _SHARED:
        own = BytePairEncoder(read_ranks(ranks_path))

        def encode(pieces: list[bytes]) -> list[np.ndarray]:
            """A piece is a whole pre-token or several; each is merged by itself."""
            return [np.array([i for t in pretokens(p.decode("utf-8", "surrogatepass"), pattern) for i in own.encode(t.encode("utf-8", "surrogatepass"))], np.uint32) for p in pieces]

        _SHARED[key] = (TextEncoder(encode, byte_pieces), own.decode)
    return _SHARED[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; on request also ids and decoded.

    Null and empty texts have no ids. Every pre-token is encoded by :class:`BytePairEncoder` once for
    as long as it stays in a bounded table. Null ids and repeated rows are kept; other columns are
    not read. Texts are first cut at white space and, where they are ASCII, between kinds of signs,
    which must be borders of ``pattern`` too, as they are of the rank files' pattern.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * with_ids

    def run(batches):
        import pyarrow as pa

        encoder, decode = shared_encoder(ranks_path, pattern)
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()][: len(names)]
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids = found.tolist()
                decoded = decode(ids)
                row = (doc_id, len(ids), hashlib.sha256(found.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                rows.append((*row, ids, decoded) if with_ids else row)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)
