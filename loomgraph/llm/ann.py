"""Approximate nearest neighbours by inner product: an adaptive dimension scan within probed lists.

Vectors get one more component, the root of (largest squared norm - own squared norm), and queries a zero, so that the largest inner product is
the smallest distance: |query|^2 + largest squared norm - 2 * inner product. A random rotation then spreads every vector's length evenly over its components, so the distance over the first
columns, scaled up, estimates the whole. K-means on a bounded sample gives the lists; every vector is in the list of its nearest centroid.

A query first scans its nearest lists whole, which bounds the distance of its k-th neighbour. In the other lists it probes,
vectors are scanned by blocks of columns, and after each block a candidate is abandoned when its scaled partial distance exceeds the
bound by the margin of a hypothesis test. Lists are cut into pieces of bounded size by a hash of the row, so a list that holds a third of all
vectors is many tasks; a piece returns its k best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batches, small

BLOCK = 16


def rotation(n: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def extended(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]])


def as_query(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.zeros((len(x), 1))])


def centroids_of(x: np.ndarray, n: int, seed: int, steps: int = 8) -> np.ndarray:
    """K-means on the sample."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:n]]
    for _ in range(steps):
        near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        held = np.bincount(near, minlength=len(c))
        c = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], c)
    return c


def probes_for(queries: np.ndarray, sample: np.ndarray, centre: np.ndarray, k: int, recall: float) -> int:
    """queries: the first rows of the sample, as queries. The fewest lists that hold `recall` of the k nearest of sample rows within the sample.

    With all rows, neighbours are nearer than within a sample, and so rather in nearer lists.
    """
    far = (sample * sample).sum(axis=1)[None] - 2 * queries @ sample.T
    far[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    own = ((centre * centre).sum(axis=1) - 2 * sample @ centre.T).argmin(axis=1)
    order = np.argsort((centre * centre).sum(axis=1) - 2 * queries @ centre.T, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centre))[None], axis=1)
    at = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def scan(queries: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, margin: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no block of columns abandoned and that may be among a query's k nearest.

    While many pairs are left a block is one matrix product, for the vectors that some query still wants; then the pairs are followed one by one.
    """
    d = vectors.shape[1]
    limit = lambda s: s / d * (1 + margin / np.sqrt(s)) ** 2 if s < d else 1 + 1e-5
    held = np.arange(len(vectors))
    part, seen = np.zeros((len(queries), len(vectors)), np.float32), 0
    qy, vy = queries.astype(np.float32), vectors.astype(np.float32)
    while True:
        cols = slice(seen, min(d, seen + BLOCK))
        a, b = qy[:, cols], vy[:, cols]
        part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
        seen = cols.stop
        alive = part <= (bounds * limit(seen)).astype(np.float32)[:, None]
        if seen == d:
            break
        if not alive.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        wanted = alive.any(axis=0)
        if alive.mean() < 0.02:  # few pairs: follow each
            q, v = np.nonzero(alive)
            left = part[q, v]
            while seen < d and len(q):
                cols = slice(seen, min(d, seen + BLOCK))
                left = left + ((qy[q, cols] - vy[v, cols]) ** 2).sum(axis=1)
                seen = cols.stop
                stay = left <= bounds[q] * limit(seen)
                q, v, left = q[stay], v[stay], left[stay]
            return q, held[v]
        part = np.where(alive, part, np.float32(np.inf))
        if wanted.mean() < 0.7:
            part, vy, held = part[:, wanted], vy[wanted], held[wanted]
    if part.shape[1] > k:  # of what is left, what single precision can't tell from the k nearest
        part = np.where(alive, part, np.float32(np.inf))
        kth = np.partition(part, k - 1, axis=1)[:, k - 1]
        alive &= part <= (kth + 1e-5 * (np.abs(kth) + 1))[:, None]
    q, v = np.nonzero(alive)
    return q, held[v]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.95, whole_lists: int = 2, sample: int = 16_384, piece: int = 8_192, query_block: int = 512, queries_per_task: int = 4_096, margin: float = 2.8, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`, its own row left out.

    score is the inner product of the original vectors in double precision; ties go to the smaller id. Null or zero vectors, those with null
    or non-finite components, of another length than most, or without id take no part. Rows that repeat a query's id with
    the same vector are one query; where vectors of one query id differ, what they find is ranked together. Candidates that repeat an id are candidates each, but none
    with the query's id. Fewer candidates give fewer rows; an empty table none.
    Fitted on `sample` rows: centroids, and the number of lists to probe, the fewest that reach `recall` within the sample. whole_lists of them are scanned without a test.
    """
    spark = vectors.sparkSession
    batches(spark, 2048)
    scratch = Scratch(spark, "ann")
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    sound = ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("x", lambda e: e != 0)
    v = v.where(sound).withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))
    lengths = v.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows"), F.max("norm2").alias("most")).orderBy(F.desc("rows"), "n").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], out)
    dim, rows, most = lengths[0]
    v = v.where(F.size("x") == dim)
    fit = np.array([r[0] for r in v.orderBy(F.xxhash64("id"), "id").limit(sample).select("x").collect()])
    lists = max(1, min(int(rows**0.5), len(fit) // 8, 4096))
    turn = rotation(dim + 1, seed)
    asked, fit = as_query(fit[:512]) @ turn, extended(fit, most) @ turn
    centre = centroids_of(fit, lists, seed)
    probes = probes_for(asked, fit, centre, k, recall)
    whole = min(whole_lists, probes)

    def placed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in it:
            x, is_query = np.stack(g["x"].to_numpy()), g["id"].to_numpy() % every == 0
            far = lambda y: (centre * centre).sum(axis=1) - 2 * (y @ turn) @ centre.T
            own, order = far(extended(x, most)).argmin(axis=1), np.argsort(far(as_query(x[is_query])), axis=1, kind="stable")[:, :probes]
            asked = iter(order.tolist())
            yield pd.DataFrame({"id": g["id"], "x": g["x"], "list": own, "probes": [next(asked) if q else None for q in is_query]})

    all_rows = scratch.written(v.select("id", "x").mapInPandas(placed, "id long, x array<double>, list int, probes array<int>"), "placed")
    queries = all_rows.where("probes IS NOT NULL").dropDuplicates(["id", "x"]).select("id", "x", "probes")
    asks = queries.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("asks"))
    # a list of many rows is cut into pieces, and one that many queries probe is dealt by shares of them too
    sizes = all_rows.groupBy("list").agg(F.count("*").alias("n")).join(asks, "list")
    sizes = sizes.select("list", F.ceil(F.col("n") / piece).cast("int").alias("pieces"), F.ceil(F.col("asks") / queries_per_task).cast("int").alias("shares"))
    sizes = F.broadcast(scratch.written(sizes, "sizes"))  # a row per list, at most 4096
    owned = all_rows.join(sizes, "list").select("list", F.pmod(F.xxhash64("id", "x"), F.col("pieces")).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "id", "x")

    def best(asked: DataFrame, tested: bool) -> DataFrame:
        """asked: id, x, list, bound. The k best of each query in each piece, with exact scores."""

        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
            if not len(left) or not len(right):
                return none
            qx, vx = np.stack(left["qx"].to_numpy()), np.stack(right["x"].to_numpy())
            qid, vid, bound = left["q"].to_numpy(), right["id"].to_numpy(), left["bound"].to_numpy(dtype=float)
            qy, vy = as_query(qx) @ turn, extended(vx, most) @ turn
            found = []
            for at in range(0, len(qx), query_block):
                s = slice(at, at + query_block)
                # rows with the query's own id may take places among the nearest, so as many more are asked for
                more = k + int(np.unique(vid, return_counts=True)[1].max())
                q, c = scan(qy[s], bound[s] if tested else np.full(len(qx[s]), np.inf), vy, margin, more)
                q, c = (q + at)[(keep := qid[q + at] != vid[c])], c[keep]
                score = np.concatenate([np.einsum("ij,ij->i", qx[q[i : i + 65536]], vx[c[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.empty(0)])
                order = np.lexsort((vid[c], -score, q))
                q, c, score = q[order], c[order], score[order]
                start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, int)
                place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
                top = place < k
                found.append(pd.DataFrame({"query_id": qid[q[top]], "vec_id": vid[c[top]], "score": score[top]}))
            return pd.concat(found) if found else none

        dealt = asked.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), F.col("id").alias("q"), F.col("x").alias("qx"), "bound")
        keys = ["list", "piece", "share"]
        return dealt.groupBy(*keys).cogroup(owned.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = queries.select("id", "x", F.explode(F.slice("probes", 1, whole)).alias("list"), F.lit(0.0).alias("bound"))
    first = scratch.written(best(near, False), "first")
    # the k-th score so far; with the query's squared norm it gives a distance
    kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    rest = queries.select("id", "x", F.explode(F.slice("probes", whole + 1, probes)).alias("list")) if probes > whole else None
    found = first
    if rest is not None:
        own = F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e)
        bounded = rest.join(small(kth, rows // every, 32), "id", "left").select("id", "x", "list", F.coalesce(own + F.lit(most) - 2 * F.col("kth"), F.lit(float("inf"))).alias("bound"))
        found = found.unionByName(best(bounded, True))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
