"""Nearest neighbours by cosine: inverted lists scanned block of columns by block of columns.

Vectors are normalised, rotated by a random orthogonal matrix and assigned to the nearest of a
number of centroids. A query is compared with the lists of its nearest centroids. Within a list a
candidate's squared distance is summed over one block of rotated columns after the other; as the
rotation spreads the energy evenly, ``partial * d / seen`` estimates the whole, and a candidate is
abandoned as soon as a test rejects the hypothesis that it is as near as the best k so far.
Survivors are scored on their original vectors in double precision. The best k in a bounded sample
bound each query before any list is read, so the test abandons candidates from the first block on.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored, trimmed

#: Centroids are fitted on so many vectors at most, those with the smallest hashes, and on so many numbers.
SAMPLE, SAMPLE_NUMBERS = 16_384, 1 << 22
#: Lists, at most: so many sampled vectors to a list.
PER_LIST = 4
#: Vectors whose nearest centroids are sought at once.
STEP = 1024
#: Vectors of a list and queries of a list that meet in one step.
MEMBERS, QUERIES = 4096, 1024
#: Looseness of the test; larger values abandon fewer candidates.
EPSILON = 2.1
#: Rows compared at once with all queries on the first block of columns.
ROWS = 512
#: While more than this share of the pairs is left, a block of columns is one matrix product; then pair by pair.
DENSE = 0.05


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part: an id, and a vector without null or non-finite parts that is not zero."""
    x = F.col(vec_col)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each unit vector."""
    return np.concatenate([np.argmax(x[i : i + STEP] @ centroids.T, axis=1) for i in range(0, len(x), STEP)])


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from a fixed seed."""
    x, rng = _unit(sample), np.random.default_rng(7)
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        nearest = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def calibrate_probes(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """How many lists hold ``recall`` of the k nearest neighbours within the sample.

    Neighbours in a sample are farther than those in the whole, so this errs towards more lists.
    """
    x = _unit(sample)
    asked = np.random.default_rng(5).choice(len(x), min(queries, len(x)), replace=False)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    found = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    home = _nearest(x, centroids)
    place = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(place[np.arange(len(asked))[:, None], home[found]].ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def _cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The measure itself, row by row, on original vectors."""
    out = np.empty(len(u))
    for i in range(0, len(u), 65_536):
        a, b = u[i : i + 65_536], v[i : i + 65_536]
        out[i : i + 65_536] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    return out


def seed_bounds(x: np.ndarray, x_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the squared distance of its k-th nearest sampled row (infinite if it has fewer), and those rows as (query row, sample row, cosine).

    Sampled ids differ, so no k-th neighbour of the whole is farther than this.
    """
    bounds, rows, columns = np.full(len(x), np.inf), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    unit, n = _unit(sample), min(k, len(sample))
    for i in range(0, len(x), STEP):
        near = _unit(x[i : i + STEP]) @ unit.T
        near[x_ids[i : i + STEP, None] == sample_ids[None, :]] = -np.inf
        best = np.argpartition(-near, n - 1, axis=1)[:, :n]
        values = np.take_along_axis(near, best, axis=1)
        if n == k:
            least = values.min(1)
            bounds[i : i + STEP] = np.where(np.isfinite(least), 2 - 2 * least, np.inf)
        row, column = np.nonzero(np.isfinite(values))
        rows.append(row + i)
        columns.append(best[row, column])
    row, column = np.concatenate(rows), np.concatenate(columns)
    return bounds, row, column, _cosines(x[row], sample[column])


def _column_blocks(d: int) -> list[tuple[int, int]]:
    cuts = [0, *[c for c in (8, 16, 32, 64, 128, 256, 512) if c < d], d]
    return list(zip(cuts, cuts[1:], strict=False))


def scan_list(members: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, rotation: np.ndarray, k: int, bounds: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(query, member, cosine) of the k nearest members found for each query, ties to smaller ids; a repeated id counts once, by its nearest row.

    Members beyond a query's squared distance in ``bounds`` are left out.
    """
    order = np.argsort(ids, kind="stable")
    members, ids = members[order], ids[order]
    repeated = bool((ids[1:] == ids[:-1]).any())
    x, q = _unit(members) @ rotation, _unit(queries) @ rotation
    d = x.shape[1]
    blocks = _column_blocks(d)
    bound = np.full(len(q), np.inf) if bounds is None else bounds.copy()
    held_q, held_x, held_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(x), ROWS):
        part = x[start : start + ROWS]
        alive = query_ids[:, None] != ids[None, start : start + ROWS]
        partial, pairs = np.zeros(alive.shape), None
        for a, b in blocks:
            limit = bound * (b / d) * ((1 + EPSILON / np.sqrt(b)) ** 2 if b < d else 1) + 1e-9
            if pairs is None:
                partial += (q[:, a:b] ** 2).sum(1)[:, None] + (part[:, a:b] ** 2).sum(1)[None, :] - 2 * q[:, a:b] @ part[:, a:b].T
                alive &= partial <= limit[:, None]
                if b == d or alive.mean() <= DENSE:
                    pairs = np.nonzero(alive)
                    dist = partial[pairs]
                continue
            qi, xi = pairs
            step = np.empty(len(qi))
            for i in range(0, len(qi), 65_536):
                s = slice(i, i + 65_536)
                step[s] = ((q[qi[s], a:b] - part[xi[s], a:b]) ** 2).sum(1)
            dist = dist + step
            keep = dist <= limit[qi]
            pairs, dist = (qi[keep], xi[keep]), dist[keep]
        qi, xi = pairs
        held_q, held_x, held_d = np.concatenate([held_q, qi]), np.concatenate([held_x, xi + start]), np.concatenate([held_d, dist])
        if repeated:
            order = np.lexsort((held_d, ids[held_x], held_q))
            held_q, held_x, held_d = held_q[order], held_x[order], held_d[order]
            fresh = np.ones(len(held_q), bool)
            fresh[1:] = (held_q[1:] != held_q[:-1]) | (ids[held_x[1:]] != ids[held_x[:-1]])
            held_q, held_x, held_d = held_q[fresh], held_x[fresh], held_d[fresh]
        order = np.lexsort((held_x, held_d, held_q))
        held_q, held_x, held_d = held_q[order], held_x[order], held_d[order]
        rank = np.arange(len(held_q)) - np.searchsorted(held_q, held_q)
        last = rank == k - 1
        bound[held_q[last]] = held_d[last]
        keep = held_d <= bound[held_q] + 1e-9
        held_q, held_x, held_d = held_q[keep], held_x[keep], held_d[keep]
    score = _cosines(queries[held_q], members[held_x])
    order = np.lexsort((ids[held_x], -score, held_q))
    held_q, held_x, score = held_q[order], held_x[order], score[order]
    top = np.arange(len(held_q)) - np.searchsorted(held_q, held_q) < k
    return [(int(query_ids[i]), int(ids[j]), float(s)) for i, j, s in zip(held_q[top], held_x[top], score[top], strict=True)]


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, recall: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row that ``is_query`` (a Column on vec_id) holds for.

    All valid rows but the query's own are candidates. Rows with a null id or a vector that is
    null, zero, or holds null or non-finite parts take no part. Vectors of different lengths have
    no cosine, so each length is searched on its own, with lists of its own. A repeated id gives
    one result, by its nearest row, and asks with each of its vectors. The number of lists is the
    square root of the number of vectors, a quarter of the sample at most; each query reads as many
    lists as :func:`calibrate_probes` finds for ``recall``, more where they hold fewer than
    ``k + 1`` ids. The k nearest sampled rows of a query count as found, so what is farther than
    the k-th of them is not sought. Lists of many vectors, and of many queries, are split.
    """
    clean = valid_vectors(vectors, id_col, vec_col)
    lengths = clean.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # a row for each length
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hits = [_search(clean.where(F.size("v") == row["d"]), is_query, k, recall, row["d"], row["count"]) for row in lengths]
    hits = functools.reduce(DataFrame.unionByName, hits).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(clean: DataFrame, is_query, k: int, recall: float, d: int, count: int) -> DataFrame:
    """query_id, vec_id and score of the nearest found in each list, for ``count`` vectors of length ``d``."""
    spark = clean.sparkSession
    size = max(256, min(SAMPLE, SAMPLE_NUMBERS // d))
    sample = clean.orderBy(F.xxhash64("vec_id", "v")).limit(size).toPandas().drop_duplicates("vec_id")
    fitted, fitted_ids = np.array(list(sample["v"]), float), sample["vec_id"].to_numpy()
    lists = max(1, min(int(np.sqrt(count)), -(-size // PER_LIST), len(fitted)))
    centroids = fit_centroids(fitted, lists)
    probes = calibrate_probes(fitted, centroids, k, recall)
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((d, d)))[0]

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("v").flatten()).reshape(-1, d)
                nearest = _nearest(_unit(x), centroids)
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), batch.column("vec_id"), packed], names=["list", "vec_id", "x"])

    index = stored(clean.mapInArrow(trimmed(assign), "list int, vec_id long, x binary"), "vector-lists")
    sizes = {r[0]: r[1] for r in index.groupBy("list").count().collect()}  # a row for each list
    fresh = {r[0]: r[1] for r in index.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect()}
    filled, new_ids = (np.array([n.get(i, 0) for i in range(lists)]) for n in (sizes, fresh))  # an id of several lists is new in one

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<f8").reshape(-1, d)
                order = np.argsort(-(_unit(x) @ centroids.T), axis=1, kind="stable")
                before = np.cumsum(new_ids[order], axis=1) - new_ids[order]
                wanted = (np.arange(lists)[None, :] < probes) | (before < k + 1)
                row, column = np.nonzero(wanted & (filled[order] > 0))
                bounds, seeded, near, score = seed_bounds(x, batch.column("vec_id").to_numpy(), fitted, fitted_ids, k)
                ids = batch.column("vec_id").take(pa.array(np.concatenate([row, seeded])))
                places = pa.array(np.concatenate([order[row, column], np.full(len(seeded), -1)]), pa.int32())
                vectors = pa.concat_arrays([batch.column("x").take(pa.array(row)), pa.nulls(len(seeded), pa.binary())])
                others = pa.concat_arrays([pa.nulls(len(row), pa.int64()), pa.array(fitted_ids[near], pa.int64())])
                yield pa.RecordBatch.from_arrays([places, ids, vectors, others, pa.array(np.concatenate([bounds[row], score]))], names=["list", "vec_id", "x", "near", "value"])

    # list -1 holds what a query found in the sample and its cosine; the other rows a list to read and the bound
    asked = index.where(is_query).dropDuplicates(["vec_id", "x"]).mapInArrow(trimmed(probe), "list int, vec_id long, x binary, near long, value double")
    asked = stored(asked, "vector-queries")
    sampled = asked.where("list < 0").select(F.col("vec_id").alias("query_id"), F.col("near").alias("vec_id"), F.col("value").alias("score"))
    asked = asked.where("list >= 0")
    splits = spark.createDataFrame([(i, -(-n // MEMBERS)) for i, n in sizes.items()], "list int, splits long")
    loads = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("loads"))
    plan = F.broadcast(loads.join(splits, "list"))  # a row for each list

    def spread(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = index.join(plan, "list").withColumn("split", F.pmod(F.xxhash64("vec_id"), F.col("splits"))).withColumn("load", spread("loads"))
    right = asked.join(plan, "list").withColumn("load", F.pmod(F.xxhash64("vec_id"), F.col("loads"))).withColumn("split", spread("splits"))
    columns = ["list", "split", "load", "role", "vec_id", "x", "value"]
    together = left.withColumns({"role": F.lit(0), "value": F.lit(None).cast("double")}).select(*columns).unionByName(right.withColumn("role", F.lit(1)).select(*columns))
    together = together.repartition(partitions(spark), "list", "split", "load").sortWithinPartitions("list", "split", "load", "role")

    def search(batches):
        import pyarrow as pa

        def found(sides):
            if not sides[0] or not sides[1]:
                return []
            (m, mi), (q, qi) = ((np.frombuffer(b"".join(x for _, x, _ in side), "<f8").reshape(-1, d), np.array([i for i, _, _ in side])) for side in sides)
            return scan_list(m, mi, q, qi, rotation, k, np.array([bound for _, _, bound in sides[1]]))

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

        key, sides = None, ([], [])
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in columns], strict=True)
            for lst, split, load, role, vec_id, x, bound in rows:
                if (lst, split, load) != key:
                    yield batch_of(found(sides))
                    key, sides = (lst, split, load), ([], [])
                sides[role].append((vec_id, x, bound))
        yield batch_of(found(sides))

    return together.mapInArrow(trimmed(search), "query_id long, vec_id long, score double").unionByName(sampled)
