"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Tokens are runs of letters and digits and runs of other signs. Each hashes to one of ``SLOTS``
slots; a slot has a sparse random index vector. A slot's context vector is the sum of the index
vectors of its neighbours over all documents. A document pools, over its tokens, the index
vectors and the unit context vectors, and adds its shape (counts on a log scale). A network of
two layers learns labels from a bounded sample; a temperature is fitted on a part it has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, segment_hash, segment_sums, small_batches, stored, trimmed, utf8_buffer

SLOTS, WIDTH, NONZERO = 1 << 14, 32, 4
#: Labelled rows that the network is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
CHUNK_BYTES = 1 << 18
#: Context sums travel in blocks of so many slots; vectors are gathered for so many tokens at once.
BLOCK_SLOTS, GATHERED = 256, 1 << 14

_KIND = np.zeros(256, np.uint8)  # 0 white space, 1 letters and digits, 2 other signs
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[[i for i in range(128) if _KIND[i] == 0 and i not in (0x20, *range(0x09, 0x0E))]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero parts of each slot's index vector."""
    h = mix64(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(0x51ED27))
    return (h % np.uint64(WIDTH)).astype(np.int64).reshape(SLOTS, NONZERO), np.where(h >> np.uint64(63), 1.0, -1.0).reshape(SLOTS, NONZERO)


def index_matrix() -> np.ndarray:
    places, signs = _index_vectors()
    out = np.zeros((SLOTS, WIDTH), np.float32)
    np.add.at(out, (np.repeat(np.arange(SLOTS), NONZERO), places.ravel()), signs.ravel())
    return out


def token_slots(column):
    """Chunks of whole texts: (slots of all tokens, borders of texts, bytes, line counts, capitals, sign bytes of each text)."""
    data, offsets = utf8_buffer(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, rows)
        raw, cuts = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        kind = _KIND[raw]
        change = np.ones(len(raw), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[cuts[:-1][cuts[:-1] < len(raw)]] = True
        edges = np.flatnonzero(change)
        stops = np.append(edges[1:], len(raw))
        token = kind[edges] > 0
        starts, ends = edges[token], stops[token]
        slots = (segment_hash(segment_sums(_LOWER[raw]), starts, ends) % np.uint64(SLOTS)).astype(np.int64)

        def count(marks):
            total = np.concatenate(([0], np.cumsum(marks)))
            return total[cuts[1:]] - total[cuts[:-1]]

        yield slots, np.searchsorted(starts, cuts), np.diff(cuts), count(raw == 10), count((raw >= 65) & (raw <= 90)), count(kind == 2)
        first = last


def context_sums(batches):
    """For each block of slots, the sums of the neighbours' index vectors over a task."""
    import pyarrow as pa

    places, signs = _index_vectors()
    sums = np.zeros(SLOTS * WIDTH)
    for batch in batches:
        for slots, borders, *_ in token_slots(batch.column("text")):
            inside = np.ones(max(0, len(slots) - 1), bool)
            ends = borders[1:-1]
            inside[ends[(ends > 0) & (ends < len(slots))] - 1] = False
            left, right = slots[:-1][inside], slots[1:][inside]
            for at, other in ((left, right), (right, left)):
                sums += np.bincount((at[:, None] * WIDTH + places[other]).ravel(), signs[other].ravel(), SLOTS * WIDTH)
    yield _blocks_of(sums.astype(np.float32).reshape(-1, BLOCK_SLOTS * WIDTH), range(SLOTS // BLOCK_SLOTS))


def _blocks_of(rows, numbers):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "sums"])


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(sums, "<f4").astype(float)
    yield _blocks_of((total[k].astype(np.float32) for k in sorted(total)), sorted(total))


def corpus_contexts(docs: DataFrame) -> np.ndarray:
    """The context vectors of all slots over all documents (a fixed SLOTS x WIDTH matrix), of unit length."""
    small_batches(docs.sparkSession)
    blocks = SLOTS // BLOCK_SLOTS
    schema = "block int, sums binary"
    sums = docs.select("text").mapInArrow(trimmed(context_sums), schema).repartition(blocks, "block").mapInArrow(trimmed(_added), schema)
    out = np.zeros((SLOTS, WIDTH))
    for row in sums.collect():  # a block each, 2 MB in all
        out[row["block"] * BLOCK_SLOTS : (row["block"] + 1) * BLOCK_SLOTS] += np.frombuffer(row["sums"], "<f4").reshape(-1, WIDTH)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """Features of each text of an Arrow column; ``vectors`` has a row for each slot."""
    out = []
    for slots, borders, size, lines, capitals, signs in token_slots(column):
        n = np.diff(borders)
        sums = np.zeros((len(n), vectors.shape[1]))
        owner = np.repeat(np.arange(len(n)), n)
        for i in range(0, len(slots), GATHERED):
            own = owner[i : i + GATHERED]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[heads]] += np.add.reduceat(vectors[slots[i : i + GATHERED]], heads, axis=0)
        mean = sums / np.maximum(n, 1)[:, None]
        length = np.maximum(size, 1)
        shape = np.stack([np.log1p(n), np.log1p(size), np.log1p(lines), n / length, lines / length, capitals / length, signs / length], axis=1)
        out.append(np.concatenate([mean, shape], axis=1))
    return np.concatenate(out) if out else np.zeros((0, vectors.shape[1] + 7))


@dataclass
class Network:
    """Two layers over standardised features, and a temperature for their logit."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.first + self.first_bias) @ self.second + self.second_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40) -> Network:
    """Fits by Adam from a fixed seed on nine tenths of the rows, the temperature on the rest.

    Labels of one class, or none, give a network whose score is that class's share (0.5 without any).
    """
    rng = np.random.default_rng(13)
    width = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    net = Network(np.zeros(width), np.ones(width), rng.standard_normal((width, hidden)) / np.sqrt(width), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(y) < 2 or y.min() == y.max():
        return net
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 10], order[len(y) // 10 :]
    net.mean, net.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    z = np.clip((x - net.mean) / net.scale, -8, 8)
    params = [net.first, net.first_bias, net.second, np.array([net.second_bias])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        rng.shuffle(used)
        for i in range(0, len(used), 256):
            at = used[i : i + 256]
            h = np.tanh(z[at] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (p - y[at]) / len(at)
            dh = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[at].T @ dh + 1e-4 * params[0], dh.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            rate = 3e-3 * (1 - epoch / epochs)
            for p_, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.second_bias = float(params[3][0])
    if len(held):
        logits = net.logits(x[held])
        choices = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        losses = [np.mean(np.logaddexp(0, logits / t) - y[held] * logits / t) for t in choices]
        net.temperature = float(choices[int(np.argmin(losses))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def held_out() -> F.Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5) == 0


def fit_quality(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, sample: int = SAMPLE) -> QualityModel:
    """Fits on the labelled documents that are not held out; contexts come from all of ``corpus`` (default ``docs``).

    At most ``sample`` labelled rows are used, those whose ids have the smallest hashes. Labels
    with a null id or quality are left out, and of repeated ones the largest quality counts; of
    documents that share a labelled id the text that sorts first counts, so the sample is bounded.
    """
    vectors = np.concatenate([index_matrix(), corpus_contexts(corpus if corpus is not None else docs)], axis=1)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # The sample is bounded, so it may be broadcast.
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "label-sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            x = pooled(batch.column("text"), vectors).astype(np.float32)
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), packed], names=["doc_id", "quality", "x"])

    found = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(trimmed(features), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x binary")
    found = found.toPandas().sort_values("doc_id", kind="stable")  # the bounded sample, one row for each labelled document
    width = vectors.shape[1] + 7
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, width).astype(float)
    return QualityModel(vectors, fit_network(x, found["quality"].to_numpy(float)))


def score_quality(
    docs: DataFrame, model: QualityModel, threshold: float = 0.3, keep_columns: bool = False, score_name: str = "score", predicted_name: str = "predicted"
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; with ``keep_columns`` the rows' own columns, score and predicted.

    The two new columns take other names on request; a column that has such a name already is an error.

    Only the text is an input of the score. Null and empty texts are scored as texts without
    tokens; null ids and repeated rows are kept; an empty table gives no rows.
    """
    if keep_columns and {score_name, predicted_name} & set(docs.columns):
        raise ValueError("name the score and the prediction otherwise than the columns that are there")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: SLOTS x 2 WIDTH numbers

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            score = model.network.score(pooled(batch.column("text"), model.vectors))
            taken = [batch.column(i) for i in range(batch.num_columns)] if keep_columns else [batch.column("doc_id")]
            names = batch.schema.names if keep_columns else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*names, score_name, predicted_name])

    from pyspark.sql import types as T

    base = docs if keep_columns else docs.select("doc_id", "text")
    kept = base.schema.fields if keep_columns else [base.schema["doc_id"]]
    scored = base.mapInArrow(trimmed(run), T.StructType([*kept, T.StructField(score_name, T.DoubleType()), T.StructField(predicted_name, T.IntegerType())]))
    return scored if keep_columns else scored.select("doc_id", held_out().alias("held_out"), score_name, predicted_name)
