"""Approximate nearest neighbours by inner product, with an adaptive dimension scan inside the probed lists.

Inner product becomes Euclidean distance by one more dimension (the square root of the largest squared norm minus the
vector's own). Vectors are rotated by a fixed random orthogonal matrix and assigned to the nearest of the centroids of a
bounded sample. A query reads the lists whose centroid or nearest sample member is nearest. In a list, vectors lie in column blocks; after each block a hypothesis
test compares the scaled partial distance with the distance of the best so far, and abandons a candidate as soon as it
can't be among them. Survivors are ranked by the exact inner product of the original vectors in double precision.

Every result comes out of a probed list. The sample gives centroids, the number of lists to read and a first bound on
the distance of the k-th neighbour, but no neighbours.

Lists of many vectors are split into parts of at most `part_rows`, and so are the queries that probe them, so that a
list that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise, slices

_STEP = 16
_EPS = 2.1


def usable(vector: str = "embedding") -> Column:
    """Not null, not empty, without null or non-finite components, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _assign(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        full = n > 0
        c[full] = sums[full] / n[full, None]
        if (~full).any():
            c[~full] = x[rng.integers(0, len(x), (~full).sum())]
    return c


def _assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c**2).sum(1) - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _lifted(x: np.ndarray, top: float, rotate: np.ndarray) -> np.ndarray:
    rest = np.sqrt(np.maximum(top - (x.astype(np.float64) ** 2).sum(1), 0))
    return (np.concatenate([x, rest[:, None]], 1).astype(np.float32)) @ rotate


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows of q and x in double precision, added in the order of the dimensions."""
    s = np.zeros(len(x))
    for j in range(x.shape[1]):
        s += q[:, j].astype(np.float64) * x[:, j]
    return s


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best distinct ids of each query number, larger scores first, ties to smaller ids."""
    each = np.lexsort((-score, ids, query))
    if len(each):
        a, b = query[each], ids[each]
        each = each[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])]
    order = each[np.lexsort((ids[each], -score[each], query[each]))]
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def list_order(to_fit: np.ndarray, to_centroids: np.ndarray, of_fit: np.ndarray) -> np.ndarray:
    """List numbers of each query, nearest first: by the nearest of the list's centroid and its sample members.

    A list is as near as its nearest known point, so that queries whose neighbours lie far from every centroid (as those
    of large inner products do) find their list too.
    """
    near = to_centroids.copy()
    o = np.argsort(of_fit, kind="stable")
    lists, starts = np.unique(of_fit[o], return_index=True)
    if len(lists):
        near[:, lists] = np.minimum(near[:, lists], np.minimum.reduceat(to_fit[:, o], starts, axis=1))
    return near.argsort(1, kind="stable")


def probes_for(lifted: np.ndarray, flat: np.ndarray, rotate: np.ndarray, centroids: np.ndarray, k: int, target: float, seed: int = 9) -> int:
    """Lists to read for a mean share `target` of the k nearest, measured with queries out of the sample.

    One half of the sample orders the lists, the neighbours are those in the other half: both are further than in the
    whole table, so rather too many lists are read.
    """
    lists = len(centroids)
    half = np.random.default_rng(seed).random(len(flat)) < 0.5
    asks = np.arange(0, len(flat), max(1, len(flat) // 256))
    q = np.concatenate([flat[asks], np.zeros((len(asks), 1), np.float32)], 1) @ rotate
    far = (lifted**2).sum(1) - 2 * q @ lifted.T
    far[np.arange(len(asks)), asks] = np.inf
    m = min(k, int((~half).sum()) - 1)
    if m < 1 or not half.any() or lists == 1:
        return lists
    near = np.flatnonzero(~half)[np.argpartition(far[:, ~half], m - 1, axis=1)[:, :m]]
    of_fit = _assign(lifted, centroids)
    order = list_order(far[:, half], (centroids**2).sum(1) - 2 * q @ centroids.T, of_fit[half])
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(lists)[None, :].repeat(len(asks), 0), axis=1)
    need = np.sort(np.take_along_axis(rank, of_fit[near], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))))]) + 1


def scan(q: np.ndarray, columns: np.ndarray, bound: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, vector) of a list that may be among the k nearest, all queries at once; a place may come twice.

    q has a rotated query in each row; columns the list's rotated vectors, dimensions first; bound a squared distance
    for each query that its k nearest can't exceed, tightened by the first candidates of distinct ids other than the
    query's own; for queries marked sure, the best k of these (all, if fewer) are returned whatever the bound. Blocks of
    dimensions are added for all pairs while many are alive, and pair by pair once few are.
    """
    dim, n = columns.shape
    first = np.unique(ids, return_index=True)[1][: 4 * k]
    near = (q**2).sum(1)[:, None] + (columns[:, first] ** 2).sum(0) - 2 * q @ columns[:, first]
    near[own[:, None] == ids[first][None, :]] = np.inf
    best = np.argpartition(near, k - 1, axis=1)[:, :k] if len(first) > k else np.tile(np.arange(len(first)), (len(q), 1))
    if len(first) > k:
        bound = np.minimum(bound, np.take_along_axis(near, best, axis=1).max(1) * 1.00001 + 1e-6)
    given = np.nonzero(np.isfinite(np.take_along_axis(near, best, axis=1)) & sure[:, None])
    given = given[0], first[best[given]]
    part = np.zeros((len(q), n), np.float32)
    pairs = None
    for d in range(0, dim, _STEP):
        e = min(d + _STEP, dim)
        slack = (e / dim) * (1 + _EPS / np.sqrt(e)) ** 2 if e < dim else 1.00001
        if pairs is None:
            a, b = q[:, d:e], columns[d:e]
            part += (a**2).sum(1)[:, None] + (b**2).sum(0) - 2 * a @ b
            alive = part <= (bound * slack + 1e-6)[:, None]
            if alive.sum() < 0.15 * alive.size or e == dim:
                pairs = np.nonzero(alive)
                rest = part[pairs]
        else:
            i, j = pairs
            rest = rest + ((columns[d:e, j] - q[i, d:e].T) ** 2).sum(0)
            ok = rest <= bound[i] * slack + 1e-6
            pairs, rest = (i[ok], j[ok]), rest[ok]
    return np.concatenate([pairs[0], given[0]]), np.concatenate([pairs[1], given[1]])


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = 1024, max_lists: int = 1024, target: float = 0.97, sample: int = 16_384, part_rows: int = 8192, part_queries: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that `queries` holds for, its k nearest others found.

    Every usable row of the most common dimension is indexed (see usable; of equally common dimensions, the smallest).
    A sample of at most `sample` rows, by hash of the id, fits the centroids, the number of lists to read for the recall
    `target`, and a bound on each query's k-th distance; it is no part of the answer. A query reads on until its lists
    hold more than k ids, so k are always returned where there are as many. Ties in score go to the smaller id. Rows
    that repeat an id count once, with their best score; queries that repeat an id search with their largest vector.
    Null ids take no part. An empty table gives no rows; columns other than the two named are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dims = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(square).alias("top")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim, n, top = dims.d, dims.n, dims.top
    # repeats would take the places of other ids in the sample, the bounds and the parts
    v = materialise(v.filter(F.size("v") == dim).groupBy("id", "v").agg(F.max("asks").alias("asks")))
    rows = v.groupBy("id").agg(F.max("v").alias("v")).orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").collect()
    fit_ids, fit = np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.float32)
    rotate = rotation(dim + 1)
    lifted_fit = _lifted(fit, top, rotate)
    lists = int(np.clip(n // list_rows, 1, min(max_lists, max(1, len(fit) // 16))))
    centroids = _kmeans(lifted_fit, lists)
    probes = probes_for(lifted_fit, fit, rotate, centroids, k, target)
    model = spark.sparkContext.broadcast((rotate, centroids, top))

    def vectors_of(column) -> np.ndarray:
        return np.array(column.flatten(), np.float32).reshape(-1, dim)

    def assign(batches):
        rotate, centroids, top = model.value
        for b in slices(batches, 4096):
            near = _assign(_lifted(vectors_of(b.column(1)), top, rotate), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), b.column(1), b.column(2)], ["id", "list", "v", "asks"])

    placed = materialise(v.mapInArrow(assign, "id long, list int, v array<float>, asks boolean"))
    # ids of each list, every id counted in one list only
    held = np.zeros(lists, np.int64)
    for r in placed.groupBy("id").agg(F.min("list").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect():
        held[r.list] = r.n
    fitted = spark.sparkContext.broadcast((fit_ids, fit, held))

    def probe(batches):  # the lists to read, and the bound that the sample's k nearest give
        rotate, centroids, top = model.value
        fit_ids, fit, held = fitted.value
        lifted_fit = _lifted(fit, top, rotate)
        own_norm, of_fit = (lifted_fit**2).sum(1), _assign(lifted_fit, centroids)
        for b in slices(batches, 512):
            ids, x = b.column(0).to_numpy(), vectors_of(b.column(1))
            q = np.concatenate([x, np.zeros((len(x), 1), np.float32)], 1) @ rotate
            d = own_norm - 2 * q @ lifted_fit.T + (q**2).sum(1)[:, None]
            d[ids[:, None] == fit_ids[None, :]] = np.inf
            order = list_order(d, (centroids**2).sum(1) - 2 * q @ centroids.T + (q**2).sum(1)[:, None], of_fit)
            needed = np.minimum((np.cumsum(held[order], axis=1) <= k).sum(1) + 1, len(centroids))
            i, at = np.nonzero(np.arange(len(centroids))[None, :] < np.maximum(needed, probes)[:, None])
            worst = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(x), np.inf)
            bound = np.where(np.isfinite(worst), worst * 1.00001 + 1e-6, np.inf).astype(np.float32)
            to = pa.array(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(to), pa.array(order[i, at].astype(np.int32)), b.column(1).take(to), pa.array(bound[i]), pa.array(at < needed[i])], ["id", "list", "v", "bound", "sure"])

    asked = placed.filter("asks").groupBy("id").agg(F.max("v").alias("v"))
    probed = materialise(asked.mapInArrow(probe, "id long, list int, v array<float>, bound float, sure boolean"))
    # counts of at most max_lists lists: how many parts each list's vectors and queries are cut into
    rows_of = {r.list: r.n for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    asks_of = {r.list: r.n for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame([(i, -(-m // part_rows), -(-asks_of.get(i, 1) // part_queries)) for i, m in sorted(rows_of.items())], "list int, nv int, nq int")
    left = placed.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("id"), "nv").cast("int").alias("pv"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("pq"), "id", "v")
    right = probed.join(F.broadcast(parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("pv"), F.pmod(F.xxhash64("id"), "nq").cast("int").alias("pq"), "id", "v", "bound", "sure")

    def match(vs: pa.Table, qs: pa.Table) -> pa.Table:
        rotate, _, top = model.value
        out: list[list] = [[], [], []]
        if vs.num_rows and qs.num_rows:
            ids, x = vs["id"].to_numpy(), vectors_of(vs["v"].combine_chunks())
            columns = np.ascontiguousarray(_lifted(x, top, rotate).T)
            own, asks, bound, sure = qs["id"].to_numpy(), vectors_of(qs["v"].combine_chunks()), qs["bound"].to_numpy(), qs["sure"].to_numpy()
            for at in range(0, len(own), 128):
                o, y = own[at : at + 128], asks[at : at + 128]
                i, j = scan(np.concatenate([y, np.zeros((len(y), 1), np.float32)], 1) @ rotate, columns, bound[at : at + 128], k, o, ids, sure[at : at + 128])
                other = o[i] != ids[j]
                i, j = i[other], j[other]
                score = _exact(y[i], x[j])
                best = _best(i, ids[j], score, k)
                for c, a in zip(out, (o[i][best], ids[j][best], score[best])):
                    c.append(a)
        a, b, c = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(c.astype(np.float64))})

    key = ["list", "pv", "pq"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(match, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", order.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
