"""Approximate nearest neighbours over learned partitions.

Fit, on a bounded sample: the graph of each vector's nearest neighbours is cut into balanced parts (halved again and again
where the second eigenvector of its random walk has its median), and a small network learns to tell a vector's part. How many
parts a query must look into is measured on sample vectors kept out of that: the least number that finds ``recall`` of their
true neighbours. Index: every vector goes to its most probable part. Search: a query goes to its most probable parts and is
compared with all their vectors, exactly.

A part is dealt in blocks of bounded size on both sides, so neither a part that holds a third of all vectors nor many
queries in one part meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import cut, ship

#: Vectors and queries that meet in one group.
BLOCK, QUERIES_AT_ONCE = 8192, 1024
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Router:
    """Network vector -> part, and the number of parts a query looks into."""

    mean: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(np.column_stack([x - self.mean, np.ones(len(x))]) @ self.hidden, 0)
        return np.column_stack([h, np.ones(len(h))]) @ self.out

    @property
    def parts(self) -> int:
        return self.out.shape[1]


def neighbours(queries: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k nearest vectors of each query, nearest first."""
    norms = (vectors**2).sum(1)
    out = np.empty((len(queries), min(k, len(vectors))), np.int64)
    for i in range(0, len(queries), 512):
        d = norms - 2 * queries[i : i + 512] @ vectors.T
        near = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[i : i + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
    return out


def balanced_parts(graph: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Part of each node of a neighbour graph (rows: each node's neighbours), 2**depth parts of equal size."""
    n, k = graph.shape
    part = np.zeros(n, np.int64)
    source, target = np.repeat(np.arange(n), k), graph.ravel()
    source, target = np.concatenate([source, target]), np.concatenate([target, source])
    for _ in range(depth):
        inside = part[source] == part[target]
        a, b = source[inside], target[inside]
        degree = np.bincount(a, minlength=n) + 1.0
        sizes = np.bincount(part, degree)
        x = rng.standard_normal(n)
        for _ in range(60):
            x -= (np.bincount(part, degree * x) / sizes)[part]
            x = 0.5 * x + 0.5 * (x + np.bincount(a, x[b], n)) / degree
            x /= np.sqrt(np.bincount(part, x * x) + 1e-30)[part]
        order = np.lexsort((x, part))
        starts = np.searchsorted(part[order], np.arange(part.max() + 1))
        rank = np.arange(n) - starts[part[order]]
        half = np.bincount(part)[part[order]] // 2
        new = part.copy()
        new[order] = 2 * part[order] + (rank >= half)
        part = new
    return part


def train_router(x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, width: int = 128, rounds: int = 40) -> Router:
    """A network with one hidden layer, by Adam on cross entropy."""
    mean = x.mean(axis=0)
    hidden = rng.standard_normal((x.shape[1] + 1, width)) * np.sqrt(2 / x.shape[1])
    out = rng.standard_normal((width + 1, parts)) * np.sqrt(1 / width)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (hidden, out)]
    ones, step = np.ones(256), 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            at = order[i : i + 256]
            xs = np.column_stack([x[at] - mean, ones[: len(at)]])
            pre = xs @ hidden
            h = np.column_stack([np.maximum(pre, 0), ones[: len(at)]])
            z = h @ out
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), part[at]] -= 1
            p /= len(at)
            gradients = [xs.T @ ((p @ out[:-1].T) * (pre > 0)), h.T @ p]
            step += 1
            for w, g, (m, v) in zip((hidden, out), gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 2e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(mean, hidden, out, parts)


def fit_router(sample: np.ndarray, part_size: int = 128, k: int = 10, recall: float = 0.97, seed: int = 1) -> Router:
    """Router for vectors like those of the sample; parts of about ``part_size`` of its vectors."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    sample = sample[rng.permutation(len(sample))]
    kept_out, own = sample[: len(sample) // 8], sample[len(sample) // 8 :]
    depth = max(0, int(np.log2(max(1, len(own) / part_size))))
    if depth == 0 or len(own) <= k or not len(kept_out):
        return Router(sample.mean(axis=0), np.zeros((sample.shape[1] + 1, 1)), np.zeros((2, 1)), 1)
    part = balanced_parts(neighbours(own, own, k + 1)[:, 1:], depth, rng)
    router = train_router(own, part, 1 << depth, rng)
    assigned = router.logits(own).argmax(axis=1)
    truth = assigned[neighbours(kept_out, own, k)]
    place = np.argsort(np.argsort(-router.logits(kept_out), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, truth, 1).ravel())
    router.probes = int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(
        "vec_id IS NOT NULL AND size(vector) > 0 AND exists(vector, x -> x <> 0) "
        "AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")


def _routed(rows: DataFrame, router: Router, probes: int, sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """Rows with ``part``: the most probable ones, as many as ``probes`` and as hold ``least`` vectors."""

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            logits = router.logits(_matrix(batch.column("vector")))
            if probes == 1 and sizes is None:
                at, part = np.arange(len(logits)), logits.argmax(axis=1)
            else:
                order = np.argsort(-logits, axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                wanted = (np.arange(router.parts) < probes) | (held - sizes[order] < least)
                at, nth = np.nonzero(wanted)
                part = order[at, nth]
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part.astype(np.int32))], [*batch.schema.names, "part"])

    return rows.mapInArrow(route, "vec_id long, vector array<double>, part int")


def nearest_rows(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query ids, vector ids, distances): the k nearest vectors of each query, ties to smaller ids, the query's own left out."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    norms = (vectors**2).sum(1)
    out = []
    for i in range(0, len(queries), 64):
        rough = norms - 2 * queries[i : i + 64] @ vectors.T
        rough[query_ids[i : i + 64, None] == ids] = np.inf
        top = min(k, rough.shape[1]) - 1
        limit = np.partition(rough, top, axis=1)[:, top]
        for q, row, bound in zip(range(i, len(queries)), rough, limit, strict=False):
            at = np.flatnonzero(row <= bound + 1e-9 * (1 + abs(bound) if np.isfinite(bound) else 1)) if np.isfinite(bound) \
                else np.flatnonzero(np.isfinite(row))
            distance = np.sqrt(((vectors[at] - queries[q]) ** 2).sum(axis=1))
            first = np.lexsort((ids[at], distance))[:k]
            out.append((np.full(len(first), query_ids[q]), ids[at[first]], distance[first]))
    return (np.concatenate(x) for x in zip(*out, strict=True))


def search(vectors: DataFrame, every: int = 100, k: int = 10, sample: int = 6000, recall: float = 0.97, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``, by Euclidean distance.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. All others are
    indexed; they must have one length. Candidates are all rows of other ids; of rows with one id and one vector each is a
    candidate, and one is a query. Equal distances go to the smaller id. A query with fewer than k candidates in its parts
    looks into more of them. The router is fitted on about ``sample`` vectors, chosen by a hash of the id. An empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = valid_vectors(vectors, id_col, vector_col)
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    chosen = rows if n <= sample else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
    router = fit_router(_matrix(chosen.select("vector").toArrow().column(0).combine_chunks()), k=k, recall=recall)
    index = cut(_routed(rows, router, 1))
    counted = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each part
    sizes = np.array([counted.get(p, 0) for p in range(router.parts)], np.int64)
    queries = cut(_routed(rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct(), router, router.probes, sizes, k + 1))
    asked = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count("*").alias("n")).collect()}
    shape = spark.createDataFrame([(p, -(-int(sizes[p]) // BLOCK), -(-asked[p] // QUERIES_AT_ONCE)) for p in asked if sizes[p]],
                                  "part int, blocks int, turns int")
    key = F.xxhash64("vec_id")
    left = queries.join(F.broadcast(shape), "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(key, F.col("turns")).alias("turn"), "vec_id", "vector")
    right = index.join(F.broadcast(shape), "part").select(
        "part", F.pmod(key, F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns").cast("long") - 1)).alias("turn"), "vec_id", "vector")

    def compare(asking: pa.Table, there: pa.Table) -> pa.Table:
        if not asking.num_rows or not there.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v, d = nearest_rows(asking.column("vec_id").to_numpy(), _matrix(asking.column("vector").combine_chunks()),
                               there.column("vec_id").to_numpy(), _matrix(there.column("vector").combine_chunks()), k)
        return pa.table({"query_id": q, "vec_id": v, "score": d})

    by = ["part", "block", "turn"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, FOUND)
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
