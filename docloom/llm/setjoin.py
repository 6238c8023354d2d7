"""Exact n-gram Jaccard join with a token-group matrix.

1. Every text becomes the set of its word shingles (64-bit hashes); equal sets are one set.
2. A set is cut by hash range into more parts than two linked sets can differ in, so that linked
   sets agree in some of them; the parts' hashes are signatures. As each differing token spoils one
   part at most, a set knows how many signatures it shares with any partner at least, and leaves
   out all but one of that many, the most common ones: linked sets still share one. Documents that
   only share a passage agree in fewer parts and drop out here.
3. A set takes the most common signature of those it shares; sets also learn the most common one
   among the sets that share a signature with them, so near copies of one text, of whatever length,
   form a cluster. Clusters of many tokens or sets are parted into groups, by the sets' own
   signatures as long as those are few. Members of a group are compared with each other, and the
   group's row of the token-group matrix is stored: the union of its tokens.
4. A set is a query for the other groups of its cluster, and for those in which one of its
   signatures occurs. The overlap with the group's union bounds the overlap with each member; only
   groups whose bound reaches the threshold are opened: their members' tokens are read again and
   compared exactly.
5. Links become components. Each opened group sends a spanning forest of its links, not all.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import key_filter, maybe_in, mix64, partitions, release, segment_hash, segment_sums, small_batches, stored, sweep, trimmed, utf8_buffer
from .components import connected_components

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW48 = _U((1 << 48) - 1)
#: Low bits of a signature that hold its level.
_LEVEL = _U(127)
#: Bytes of text hashed at once, signatures held before they are sent, tokens of a group, tokens of its queries in one task.
CHUNK_BYTES, HELD, GROUP_TOKENS, QUERY_TOKENS = 1 << 18, 1_000_000, 1 << 16, 1 << 20
#: A set counts as so many tokens at least, which bounds the sets of a group; queries compared with a group at once.
LEAST_LOAD, QUERY_ROWS = 64, 1024


def _odd(seed: int) -> np.uint64:
    return mix64(np.array([seed], _U) * _U(0x9E3779B97F4A7C15))[0] | _U(1)


def shingle_sets(column, n: int):
    """For each text of an Arrow column, the sorted distinct hashes of its word n-grams.

    Words are runs of bytes other than white space (0x20, 0x09-0x0D), with A-Z in lower case. A
    text of fewer words has its whole sequence as its one shingle, a text without words nothing.
    """
    data, offsets = utf8_buffer(column)
    factors = [_odd(k) for k in range(n)]
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, rows)
        base = offsets[first]
        part, cuts = _LOWER[data[base : offsets[last]]], offsets[first : last + 1] - base
        inside = ~_SPACE[part]
        border = np.zeros(len(part) + 1, bool)
        border[cuts] = True
        before, after = np.ones(len(part), bool), np.ones(len(part), bool)
        before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
        starts = np.flatnonzero(inside & (before | border[:-1]))
        ends = np.flatnonzero(inside & (after | border[1:])) + 1
        hashes = segment_hash(segment_sums(part), starts, ends)
        words = np.searchsorted(starts, cuts)
        grams = np.zeros(max(0, len(hashes) - n + 1), _U)
        for k in range(n):
            grams += hashes[k : k + len(grams)] * factors[k]
        grams = mix64(grams)
        for d in range(last - first):
            a, b = words[d], words[d + 1]
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                few = np.zeros(1, _U)
                for k in range(b - a):
                    few += hashes[a + k : a + k + 1] * factors[k]
                yield mix64(few + _odd(100 + int(b - a)))
            else:
                yield np.zeros(0, _U)
        first = last


def _print_of(tokens: np.ndarray) -> tuple[int, int]:
    one, two = mix64(tokens ^ _U(0x243F6A8885A308D3)), mix64(tokens ^ _U(0x13198A2E03707344))
    return tuple(int(x) for x in np.array([one.sum(dtype=_U), two.sum(dtype=_U)]).view(np.int64))


class Parts:
    """Signatures of sets such that sets with ``of * intersection >= least * union`` share one.

    The pair's smaller size picks the level; on a level whose largest size is m, linked sets
    differ in at most ``m * (of - least) // least`` tokens. There are ``slack`` parts more, so that
    parts which are empty in both sets need no signature. Sets with more empty parts than that also
    sign their tokens of smallest hash, as many as linked sets cannot all differ in; of a linked
    pair that shares more empty parts, both do. The low bits of a signature hold its level.
    """

    def __init__(self, least: int, of: int):
        self.least, self.of = least, of
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * 1.4)))
        self._levels: dict[int, tuple] = {}

    def _level(self, level: int) -> tuple:
        if level not in self._levels:
            low, high = self.starts[level], self.starts[level + 1] - 1
            apart = high * (self.of - self.least) // self.least
            empty = (apart + 1) * math.exp(-low / (apart + 1))
            slack = int(empty + 2.5 * math.sqrt(empty) + 0.5) if apart else 0
            count = apart + 1 + slack
            bounds = np.array([(k << 64) // count for k in range(1, count)], _U)
            salts = mix64(np.arange(count, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(level + 1))
            self._levels[level] = (bounds, salts, slack)
        return self._levels[level]

    def signatures(self, tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The signatures, and for each level how many of them a linked set shares at least."""
        size, needs = len(tokens), []
        lows = np.searchsorted(self.starts, [-(-size * self.least // self.of), size], "right") - 1
        sums = np.zeros(size + 1, _U)
        np.cumsum(mix64(tokens + _U(0xA4093822299F31D0)), dtype=_U, out=sums[1:])
        found = []
        for level in range(lows[0], lows[1] + 1):
            bounds, salts, slack = self._level(level)
            at = np.concatenate(([0], np.searchsorted(tokens, bounds), [size]))
            full = at[1:] > at[:-1]
            signed = mix64((sums[at[1:]] - sums[at[:-1]]) ^ salts)[full]
            high = self.starts[level + 1] - 1  # the smaller set's size is no larger
            partner = size * self.of // self.least if size <= high else high
            differ = min(high * (self.of - self.least) // self.least, (size + partner) * (self.of - self.least) // (self.of + self.least))
            needs.append((level, max(1, int(full.sum()) - differ)))
            if len(full) - full.sum() > slack:
                signed = np.append(signed, mix64(tokens[: size + (-size * self.least // self.of) + 1] + _U((level + 1) * 0x452821E638D01377 % (1 << 64))))
            found.append(signed & ~_LEVEL | _U(level))
        return np.concatenate(found), needs


_SCANNED = "kind int, bucket int, a long, b long, c long, d long, payload binary"


def _pack48(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _unpack48(x: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x), 8), np.uint8)
    wide[:, :6] = x
    return wide.reshape(-1).view("<u8")


def _table(columns: dict):
    import pyarrow as pa

    size = max(len(v) for v in columns.values())
    kinds = {"kind": pa.int32(), "bucket": pa.int32(), "payload": pa.binary()}
    names = ["kind", "bucket", "a", "b", "c", "d", "payload"]
    arrays = [pa.array(columns[k], kinds.get(k, pa.int64())) if k in columns else pa.nulls(size, kinds.get(k, pa.int64())) for k in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _scan(n: int, least: int, of: int, buckets: int):
    """Documents' sizes and set prints (kind 0), packed signatures by bucket (1) and those shared within a batch (2), what sets share at least (3)."""

    def send(signs: list, owners: list, needs: list):
        sign, owner = np.concatenate(signs), np.concatenate(owners)
        order = np.lexsort((owner, sign))
        sign, owner = sign[order], owner[order]
        head = np.ones(len(sign), bool)
        head[1:] = sign[1:] != sign[:-1]
        alone = head & np.append(head[1:], True)
        shared = np.flatnonzero(~alone)
        yield from rows(2, _named(sign[shared], buckets), owner[shared], (owner[shared] % _U(buckets)).astype(np.int64))
        sign, owner = sign[head], owner[head]
        yield from rows(1, sign, owner, ((sign >> _U(48)) % _U(buckets)).astype(np.int64))
        columns = list(zip(*needs, strict=True))
        yield _table({"kind": [3] * len(needs), "bucket": [f % buckets for f in columns[0]], **dict(zip("abc", columns, strict=True))})

    def rows(kind: int, sign, owner, bucket):
        order = np.argsort(bucket, kind="stable")
        wide = np.ascontiguousarray(sign[order], "<u8").view(np.uint8).reshape(-1, 8) if kind == 2 else _pack48(sign[order])
        entries = np.concatenate([wide, _pack48(owner[order])], axis=1)
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = np.append(cuts[1:], len(order))
        ids = bucket[order][cuts]
        for i in range(0, len(cuts), 1000):
            part = range(i, min(i + 1000, len(cuts)))
            yield _table({"kind": [kind] * len(part), "bucket": ids[part.start : part.stop].astype(np.int32), "payload": [entries[cuts[k] : ends[k]].tobytes() for k in part]})

    def run(batches):
        parts, signs, owners, needs, held, seen, dealt = Parts(least, of), [], [], [], 0, set(), None
        for batch in batches:
            made = defaultdict(list)
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), n), strict=True):
                f1, f2 = _print_of(tokens)
                for name, value in zip("abcd", (doc_id, len(tokens), f1, f2), strict=True):
                    made[name].append(value)
                if len(tokens) and doc_id is not None and (f1, f2) not in seen:
                    seen.add((f1, f2))
                    sign, need = parts.signatures(tokens)
                    signs.append(sign)
                    owners.append(np.full(len(sign), _U(f1 & int(_LOW48))))
                    needs += [(f1 & int(_LOW48), level, k) for level, k in need]
                    held += len(sign)
                if held >= HELD:
                    yield from send(signs, owners, needs)
                    signs, owners, needs, held, seen = [], [], [], 0, set()
            if made:  # row by row, as copies have equal prints
                dealt = made["c"][0] % buckets if dealt is None else dealt
                yield _table({"kind": [0] * len(made["a"]), "bucket": [(dealt + i) % buckets for i in range(len(made["a"]))], **made})
                dealt += len(made["a"])
        if signs:
            yield from send(signs, owners, needs)

    return run


def _named(sign: np.ndarray, buckets: int) -> np.ndarray:
    """Signatures as they are known after the shuffle: the low 48 bits, and the bucket above."""
    return sign & _LOW48 | ((sign >> _U(48)) % _U(buckets) << _U(48))


def _shared(batches):
    """Passes documents and needs on and keeps the (signature, set) pairs of signatures that several sets have."""
    by_bucket = defaultdict(list)
    for batch in batches:
        kinds = np.array(batch.column("kind"))
        for kind in (0, 2, 3):
            part = batch.filter(_mask(kinds == kind))
            if not part.num_rows:
                continue
            if kind == 2:
                entries = np.frombuffer(b"".join(part.column("payload").to_pylist()), np.uint8).reshape(-1, 14)
                yield from _pairs(np.ascontiguousarray(entries[:, :8]).reshape(-1).view("<u8"), _unpack48(entries[:, 8:]))
            else:
                yield part
        part = batch.filter(_mask(kinds == 1))
        for bucket, payload in zip(part.column("bucket").to_pylist(), part.column("payload").to_pylist(), strict=True):
            by_bucket[bucket].append(payload)
    while by_bucket:
        bucket, payloads = by_bucket.popitem()
        entries = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 12)
        sign, owner = _unpack48(entries[:, :6]), _unpack48(entries[:, 6:])
        order = np.lexsort((owner, sign))
        sign, owner = sign[order], owner[order]
        fresh = np.ones(len(sign), bool)
        fresh[1:] = (sign[1:] != sign[:-1]) | (owner[1:] != owner[:-1])
        sign, owner = sign[fresh], owner[fresh]
        same = np.zeros(len(sign) + 1, bool)
        same[1:-1] = sign[1:] == sign[:-1]
        keep = same[:-1] | same[1:]
        yield from _pairs(sign[keep] | _U(bucket << 48), owner[keep])


def _mask(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values)


def _pairs(sign: np.ndarray, owner: np.ndarray):
    for i in range(0, len(sign), 100_000):
        a, b = sign[i : i + 100_000].view(np.int64), owner[i : i + 100_000].view(np.int64)
        yield _table({"kind": np.full(len(a), 2, np.int32), "a": a, "b": b})


_SETS = "rep long, f1 long, gid long, copies long, tokens binary"


def _sets_of(n: int):
    """Recomputes the token sets of candidates; a row whose print differs from the candidate's is another text."""

    def run(batches):
        import pyarrow as pa

        sent = set()  # of a set that rows repeat, a task sends one
        for batch in batches:
            rows = []
            names = ("rep", "f1", "f2", "gid", "copies")
            for rep, f1, f2, gid, copies, tokens in zip(*[batch.column(c).to_pylist() for c in names], shingle_sets(batch.column("text"), n), strict=True):
                if (rep, f1, f2) not in sent and _print_of(tokens) == (f1, f2):
                    sent.add((rep, f1, f2))
                    rows.append((rep, f1, gid, copies, tokens.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["rep", "f1", "gid", "copies", "tokens"])

    return run


class _Side:
    """Token sets as one array of tokens and one of their rows."""

    def __init__(self, rows: list[tuple]):
        rows = list({r[:2]: r for r in rows}.values())  # tasks may have sent a set that rows repeat
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.prints = np.array([r[1] for r in rows], np.int64)
        self.copies = np.array([r[2] for r in rows], np.int64)
        sets = [np.frombuffer(r[3], "<u8") for r in rows]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.tokens = np.concatenate(sets) if sets else np.zeros(0, _U)
        self.rows = np.repeat(np.arange(len(rows)), self.sizes)

    def only(self, keep: np.ndarray) -> _Side:
        out = _Side([])
        out.ids, out.prints, out.copies, out.sizes = self.ids[keep], self.prints[keep], self.copies[keep], self.sizes[keep]
        taken = keep[self.rows]
        out.tokens, out.rows = self.tokens[taken], (np.cumsum(keep) - 1)[self.rows[taken]]
        return out


def _overlaps(a: _Side, b: _Side, shared: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``; ``shared`` are the tokens that can count."""
    out = np.zeros((len(a.ids), len(b.ids)), np.float32)

    def columns(side: _Side):
        at = np.searchsorted(shared, side.tokens)
        at[at == len(shared)] = 0
        hit = shared[at] == side.tokens if len(shared) else np.zeros(len(at), bool)
        order = np.argsort(at[hit], kind="stable")
        return side.rows[hit][order], at[hit][order]

    (ra, ca), (rb, cb) = columns(a), columns(b)
    for start in range(0, len(shared), 2048):
        x, y = np.zeros((len(a.ids), 2048), np.float32), np.zeros((len(b.ids), 2048), np.float32)
        for m, r, c in ((x, ra, ca), (y, rb, cb)):
            i, j = np.searchsorted(c, [start, start + 2048])
            m[r[i:j], c[i:j] - start] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's component under a symmetric matrix of links."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            reached = np.zeros(len(linked), bool)
            front = np.zeros(len(linked), bool)
            front[i] = True
            while front.any():
                reached |= front
                front = linked[front].any(axis=0) & ~reached
            root[reached] = i
    return root


def _linked(a: _Side, b: _Side, shared: np.ndarray, least: int, of: int) -> np.ndarray:
    overlap = _overlaps(a, b, shared)
    return of * overlap >= least * (a.sizes[:, None] + b.sizes[None, :] - overlap)


def _inside(members: _Side, least: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of a group's tokens, and the links among its members."""
    union, times = np.unique(members.tokens, return_counts=True)
    inner = _linked(members, members, union[times > 1], least, of)
    np.fill_diagonal(inner, False)
    return union, inner


def _counts(side: _Side, counts: np.ndarray) -> list[tuple[int, int, int]]:
    return [(int(i), int(i), int(n)) for i, n in zip(side.ids, counts, strict=True) if n]


def _across(members: _Side, queries: _Side, least: int, of: int) -> list[tuple[int, int, int]]:
    """Links between a group's members and sets of other groups, as rows (a, b, links of a); queries in blocks."""
    union, inner = _inside(members, least, of)
    root, out, held = _roots(inner), [], np.zeros(len(members.ids), np.int64)
    for start in range(0, len(queries.ids), QUERY_ROWS):
        block = np.zeros(len(queries.ids), bool)
        block[start : start + QUERY_ROWS] = True
        asked = queries.only(block)
        linked = _linked(asked, members, np.intersect1d(union, asked.tokens), least, of)
        for i in np.flatnonzero(linked.any(axis=1)):
            out += [(int(asked.ids[i]), int(members.ids[r]), 0) for r in np.unique(root[linked[i]])]
        out += _counts(asked, linked @ members.copies)
        held += linked.T @ asked.copies
    return out + _counts(members, held)


def _groups(batches, names: list[str], keys: int):
    """Runs of rows that agree in the first ``keys`` columns, as (key, rows of the other columns)."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _batches(rows, columns: dict, most: int = 1 << 22):
    """Arrow batches of the rows that come in lists, of about ``most`` bytes; a last column of bytes counts whole."""
    import pyarrow as pa

    def batch_of(made):
        parts = list(zip(*made, strict=True)) or [[]] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, columns.values(), strict=True)], names=list(columns))

    made, size = [], 0
    for found in rows:
        made += found
        size += sum(64 + (len(r[-1]) if isinstance(r[-1], bytes) else 0) for r in found)
        if size >= most:
            yield batch_of(made)
            made, size = [], 0
    yield batch_of(made)


_MATRIX = "gid long, a long, b long, links long, tokens binary"


def _matrix(least: int, of: int):
    """The links inside each group, and the union of its tokens if others ask for it."""

    def run(batches):
        import pyarrow as pa

        def rows():
            for (gid, asked), found in _groups(batches, ["gid", "asked", "rep", "f1", "copies", "tokens"], 2):
                members = _Side(found)
                union, inner = _inside(members, least, of)
                made = [(gid, int(members.ids[i]), int(members.ids[r]), 0, None) for i, r in enumerate(_roots(inner)) if i != r]
                made += [(gid, *row, None) for row in _counts(members, inner @ members.copies)]
                yield made + [(gid, None, None, None, union.tobytes())] * asked

        yield from _batches(rows(), dict.fromkeys(("gid", "a", "b", "links"), pa.int64()) | {"tokens": pa.binary()})

    return run


def _bound(least: int, of: int):
    """The queries whose overlap with the group's union reaches what a link needs; the union comes first in its group."""

    def run(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                made = []
                for gid, chunk, role, rep, f1, copies, tokens in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
                    own = np.frombuffer(tokens, "<u8")
                    if role == 0:
                        held["key"], held["union"] = (gid, chunk), own
                    elif held["key"] == (gid, chunk):
                        union = held["union"]
                        at = np.searchsorted(union, own)
                        at[at == len(union)] = 0
                        if of * int((union[at] == own).sum()) >= least * len(own):
                            made.append((gid, chunk, rep, f1, copies, tokens))
                yield made

        held = {"key": None, "union": None}
        yield from _batches(rows(), dict.fromkeys(("gid", "chunk", "rep", "f1", "copies"), pa.int64()) | {"tokens": pa.binary()})

    return run


def _opened(least: int, of: int):
    """The links between members and queries of each opened group."""

    def run(batches):
        import pyarrow as pa

        def rows():
            for _, found in _groups(batches, ["gid", "chunk", "role", "rep", "f1", "copies", "tokens"], 2):
                yield _across(_Side([r[1:] for r in found if r[0] == 0]), _Side([r[1:] for r in found if r[0] == 1]), least, of)

        yield from _batches(rows(), dict.fromkeys(("a", "b", "links"), pa.int64()))

    return run


def _chunks(n: str = "chunks"):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("chunk")


def _candidate_signatures(table: DataFrame) -> DataFrame:
    """sign, f48 and held_by: of each set's signatures those that a partner must have one of."""
    shared = stored(table.where("kind = 2").select(F.col("a").alias("sign"), F.col("b").alias("f48")).distinct(), "shared-signatures")
    needs = table.where("kind = 3").groupBy(F.col("a").alias("f48"), F.col("b").alias("level")).agg(F.min("c").alias("need"))
    counted = shared.join(shared.groupBy("sign").agg(F.count(F.lit(1)).alias("held_by")), "sign")
    counted = counted.withColumn("level", F.col("sign").bitwiseAND(F.lit(int(_LEVEL))))
    common = F.row_number().over(Window.partitionBy("f48", "level").orderBy(F.desc("held_by"), F.desc("sign")))
    left = stored(counted.join(needs, ["f48", "level"]).withColumn("common", common).where("common >= need").select("sign", "f48", "held_by"), "rare-signatures")
    several = left.groupBy("sign").agg(F.count(F.lit(1)).alias("left")).where("left > 1").select("sign")
    found = stored(left.join(several, "sign", "left_semi"), "candidate-signatures")
    release(shared, left)
    return found


def _grouped_sets(sets: DataFrame, signs: DataFrame) -> DataFrame:
    """Groups (gid) of similar sets within clusters, parted where they hold many tokens or sets."""
    own = stored(signs.groupBy("f48").agg(F.max(F.struct("held_by", "sign")).alias("own")), "own-signatures")
    near = signs.join(own, "f48").groupBy("sign").agg(F.max("own").alias("best"))
    cluster = signs.join(near, "sign").groupBy("f48").agg(F.max("best").alias("cluster"))
    keyed = sets.join(own, "f48").join(cluster, "f48").withColumn("load", F.greatest("n", F.lit(LEAST_LOAD)))
    keyed = stored(keyed.withColumn("cluster", F.xxhash64("cluster")), "clustered-sets")
    sizes = keyed.groupBy("cluster").agg(F.ceil(F.sum("load") / GROUP_TOKENS).alias("parts"))
    parted = keyed.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("own"), F.col("parts")))
    loads = parted.groupBy("cluster", "part").agg(F.ceil(F.sum("load") / (2 * GROUP_TOKENS)).alias("splits"))
    split = F.pmod(F.xxhash64("f1", "f2"), F.col("splits"))
    grouped = parted.join(loads, ["cluster", "part"]).withColumn("gid", F.xxhash64("cluster", "part", split))
    grouped = stored(grouped.select("f48", "f1", "f2", "rep", "copies", "n", "load", "cluster", "gid"), "grouped-sets")
    release(own, keyed)
    return grouped


def _group_queries(grouped: DataFrame, signs: DataFrame, least: int, of: int) -> DataFrame:
    """rep, f1, load and the gid of each other group to ask; a pair of groups is looked at from the smaller gid.

    Sets of one cluster ask its other groups without a look at their signatures, which they
    mostly share many of. Groups whose sets are all too short or too long are not asked.
    """
    groups = stored(grouped.groupBy("cluster", "gid").agg(F.min("n").alias("shortest"), F.max("n").alias("longest")), "groups")
    fits = (F.col("n") * of >= F.col("shortest") * least) & (F.col("longest") * of >= F.col("n") * least)
    other = groups.withColumnRenamed("gid", "other")
    same = grouped.join(other, "cluster").where((F.col("other") > F.col("gid")) & fits).select("rep", "f1", "load", F.col("other").alias("gid"))
    held = stored(signs.select("sign", "f48").join(grouped.select("f48", "rep", "f1", "n", "load", "cluster", "gid"), "f48").drop("f48"), "held-signatures")
    others = held.select("sign", F.col("cluster").alias("c2"), F.col("gid").alias("other")).distinct()
    apart = held.join(others, (held["sign"] == others["sign"]) & (F.col("other") > F.col("gid")) & (F.col("c2") != F.col("cluster")))
    apart = apart.select("rep", "f1", "n", "load", "other").distinct().join(groups.withColumnRenamed("gid", "other"), "other").where(fits)
    found = stored(same.unionByName(apart.select("rep", "f1", "load", F.col("other").alias("gid"))), "group-queries")
    release(groups, held)
    return found


def jaccard_components(docs: DataFrame, n: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for every row of ``docs`` (doc_id, text).

    Documents link when ``of * |A & B| >= least * |A | B|`` over their sets of word n-grams;
    ``component_id`` is the smallest doc_id reachable, ``n_links`` the number of other documents
    with a direct link. A document without words links with nothing and is its own component; a
    null doc_id keeps its n_shingles, takes no part and has a null component. Rows that share a
    doc_id are one document for reachability. An empty table gives no rows; other columns of
    ``docs`` are not read. The result is exact, up to collisions of 64-bit shingle hashes; chance
    equality of the shorter signatures only adds candidates.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tasks = partitions(spark)
    scanned = docs.mapInArrow(trimmed(_scan(n, least, of, 2 * tasks)), _SCANNED)
    table = stored(scanned.repartition(tasks, "bucket").mapInArrow(trimmed(_shared), _SCANNED).drop("bucket", "payload"), "signatures")
    sweep(spark)
    docs_of = table.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("f1"), F.col("d").alias("f2"))
    real = docs_of.where("n_shingles > 0 and doc_id is not null")
    sets = real.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"))
    sets = stored(sets.withColumn("f48", F.col("f1").bitwiseAND(F.lit(int(_LOW48)))), "sets")
    signs = _candidate_signatures(table)
    grouped = _grouped_sets(sets, signs)
    pairs = _group_queries(grouped, signs, least, of)
    release(signs)
    loads = pairs.groupBy("gid").agg(F.ceil(F.sum("load") / QUERY_TOKENS).alias("chunks"))
    plan = grouped.groupBy("gid").agg(F.count(F.lit(1)).alias("members")).join(loads, "gid", "left").where("members > 1 or chunks > 0")
    plan = stored(plan.select("gid", "chunks", F.col("chunks").isNotNull().cast("int").alias("asked")), "group-loads")

    # Token sets of the candidates only; the fixed-size filter spares other texts a shuffle.
    wanted = maybe_in(docs.where("doc_id is not null"), F.col("doc_id"), key_filter(grouped, "rep"))
    wanted = wanted.join(grouped.select("rep", "f1", "f2", "gid", "copies"), wanted["doc_id"] == grouped["rep"]).select("rep", "f1", "f2", "gid", "copies", "text")
    tokens = stored(wanted.mapInArrow(trimmed(_sets_of(n)), _SETS), "candidate-tokens")
    sweep(spark)
    members = tokens.join(plan, "gid").select("gid", "asked", "rep", "f1", "copies", "tokens")
    matrix = stored(members.repartition(tasks, "gid").sortWithinPartitions("gid").mapInArrow(trimmed(_matrix(least, of)), _MATRIX), "token-group-matrix")

    # Unions bind the queries; only groups that one of them reaches are opened.
    asked = maybe_in(tokens.select("rep", "f1", "copies", "tokens"), F.col("f1"), key_filter(pairs, "f1"))
    asked = asked.join(pairs.select("rep", "f1", "gid"), ["rep", "f1"]).join(plan, "gid").withColumn("chunk", F.pmod(F.xxhash64("rep", "f1"), F.col("chunks")))
    columns = ["gid", "chunk", "role", "rep", "f1", "copies", "tokens"]
    none = F.lit(0).cast("long")
    unions = matrix.where("tokens is not null").join(plan, "gid").select("gid", _chunks(), F.lit(0).alias("role"), none.alias("rep"), none.alias("f1"), none.alias("copies"), "tokens")
    together = unions.unionByName(asked.withColumn("role", F.lit(1)).select(*columns)).repartition(tasks, "gid", "chunk").sortWithinPartitions("gid", "chunk", "role")
    reached = stored(together.mapInArrow(trimmed(_bound(least, of)), "gid long, chunk long, rep long, f1 long, copies long, tokens binary"), "group-bounds")
    sweep(spark)
    open_ = reached.select("gid", "chunk").distinct()
    members = tokens.join(open_, "gid").withColumn("role", F.lit(0)).select(*columns)
    together = members.unionByName(reached.withColumn("role", F.lit(1)).select(*columns)).repartition(tasks, "gid", "chunk").sortWithinPartitions("gid", "chunk")
    opened = together.mapInArrow(trimmed(_opened(least, of)), "a long, b long, links long")
    links = stored(matrix.where("a is not null").select("a", "b", "links").unionByName(opened), "links")
    release(grouped, pairs, plan, tokens, matrix, reached)
    sweep(spark)

    found = connected_components(links.where("a != b").select("a", "b"))
    linked = links.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    done = sets.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(linked, "rep", "left")
    done = stored(
        done.select("f1", "f2", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "set-components",
    )
    release(sets, links, found)
    whole = docs_of.join(done, ["f1", "f2"], "left")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return whole.select(
        "doc_id",
        "n_shingles",
        F.when(linkable, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linkable, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
    )
