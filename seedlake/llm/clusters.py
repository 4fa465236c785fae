"""Centroid clustering of whole-number vectors by Lloyd's rounds, with Exponion search for the nearest centroid.

Each vector carries an upper bound of the distance to its centroid and a lower bound of the distance to any other. A vector whose bounds
don't settle it looks only at the centroids inside a ball around its own: those of the sorted list of distances from that
centroid up to 2 * upper + the distance to the nearest other centroid, that radius itself included, so that ties are seen. Distances
are exact integers; bounds are floats, kept a little too wide on purpose.

A round is one pass without a shuffle: tasks read vectors with their bounds and write them again, and beside them a row of
counts and sums for each cluster, from which the next centroids come. Only k centroids (a documented parameter) reach the driver.
Rounds are tables in the shared folder; a round's table goes once the next one is written.

Results in special cases: vectors of another size, null ones, or with null, NaN or infinite components are left out; components that
don't fit the exact arithmetic (over 2^27 after scaling) are an error, as are sums of distances over 2^63; equal distances go to the smaller number; repeated rows
are vectors of their own; a null key is an empty text in the hash; with fewer vectors than k there are as many centroids; an empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable_at, forget

#: Largest component after scaling: squared distances of up to 2^7 of them fit a signed 64-bit number.
LARGEST = 1 << 27
#: How much bounds are widened, relatively; far more than floats lose, far less than what pruning needs.
SLACK = 1e-9
STATE = "key {kind}, v array<int>, cluster int, upper double, lower double, distance long, scanned long, n long, sums array<long>"


def whole_vectors(rows: DataFrame, key: str, column: str, dims: int, scale: int) -> DataFrame:
    """key, v: floor(scale * x) of the vectors with exactly `dims` components, none null or non-finite."""
    if dims > 128:
        raise ValueError("exact distances take at most 128 components")
    x = F.col(column)
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))
    scaled = lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))
    wide = F.exists(x, lambda e: F.abs(scaled(e)) > LARGEST)
    v = F.when(wide, F.raise_error(F.lit(f"a component is over {LARGEST} after scaling"))).otherwise(F.transform(x, lambda e: scaled(e).cast("int")))
    return rows.where(F.coalesce((F.size(x) == dims) & F.forall(x, finite), F.lit(False))).select(F.col(key).alias("key"), v.alias("v"))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of v and those of c (int64): by a product of matrices in floats where every sum fits 53 bits."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * v.shape[1] * most * most < 1 << 53:
        a, b = v.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(v), len(c)), np.int64)
    for j, row in enumerate(c):
        out[:, j] = ((v - row) ** 2).sum(1)
    return out


class Centroids:
    """Centroids with the sorted lists of distances between them, and how far each has moved."""

    def __init__(self, places: np.ndarray, before: np.ndarray | None = None):
        self.places = places
        k = len(places)
        apart = np.sqrt(squared(places, places).astype(float))
        order = np.argsort(apart + np.where(np.eye(k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")[:, 1:]
        self.near, self.apart = order, np.take_along_axis(apart, order, 1)
        self.gap = self.apart[:, 0] if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(((places - before) ** 2).sum(1).astype(float)) * (1 + SLACK)

    def first(self, v: np.ndarray):
        """cluster, upper, lower, number of centroids looked at, where nothing is known yet."""
        d = squared(v, self.places)
        best = d.argmin(1)  # of equal ones the first
        upper = np.sqrt(d[np.arange(len(v)), best]) * (1 + SLACK)
        lower = np.sqrt(np.partition(d, 1, 1)[:, 1]) * (1 - SLACK) if d.shape[1] > 1 else np.full(len(v), np.inf)
        return best, upper, lower, np.full(len(v), d.shape[1])

    def own(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((v - self.places[cluster]) ** 2).sum(1)

    def again(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """The same from the bounds of the round before."""
        cluster, upper, lower, seen = cluster.copy(), upper + self.moved[cluster], lower - self.moved.max(initial=0), np.zeros(len(v), np.int64)
        safe = np.maximum(lower, self.gap[cluster] * ((1 - SLACK) / 2))
        open_ = np.flatnonzero(~(upper < safe))
        upper[open_] = np.sqrt(self.own(v[open_], cluster[open_])) * (1 + SLACK)
        seen[open_] += 1
        open_ = open_[~(upper[open_] < safe[open_])]
        if not len(open_) or len(self.places) == 1:
            return cluster, upper, lower, seen
        reach = (2 * upper[open_] + self.gap[cluster[open_]]) * (1 + SLACK)
        inside = np.empty(len(open_), np.int64)
        for a in np.unique(cluster[open_]):
            mine = cluster[open_] == a
            inside[mine] = np.searchsorted(self.apart[a], reach[mine], "right")
        groups = cluster[open_] * (len(self.places) + 1) + inside
        for g in np.unique(groups):
            rows = open_[groups == g]
            a, m = divmod(int(g), len(self.places) + 1)
            ball = np.sort(np.append(self.near[a, :m], a))
            d = squared(v[rows], self.places[ball])
            best = d.argmin(1)
            cluster[rows] = ball[best]
            upper[rows] = np.sqrt(d[np.arange(len(rows)), best]) * (1 + SLACK)
            lower[rows] = np.sqrt(np.partition(d, 1, 1)[:, 1]) * (1 - SLACK)
            seen[rows] += m
        return cluster, upper, lower, seen


def assigned(rows: DataFrame, centroids: Centroids, kind: str) -> DataFrame:
    """Vectors (key, v, and after the first round cluster, upper, lower, scanned) with their next cluster and bounds; and a row of n and
    sums for each task and cluster, whose v is null."""
    known = "cluster" in rows.columns
    k, dims = centroids.places.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, schema = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), None
        for b in batches:
            v = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            if known:
                at, upper, lower = (b[c].to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
                at, upper, lower, seen = centroids.again(v, at.astype(np.int64), upper, lower)
                seen = seen + b["scanned"].to_numpy(zero_copy_only=False)
            else:
                at, upper, lower, seen = centroids.first(v)
            counts += np.bincount(at, minlength=k)
            for a in np.unique(at):
                sums[a] += v[at == a].sum(0)
            none = [pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.list_(pa.int64()))]
            cols = [b["key"], b["v"], pa.array(at, pa.int32()), pa.array(upper), pa.array(lower), pa.array(centroids.own(v, at)), pa.array(seen, pa.int64()), *none]
            schema = schema or pa.schema([(n, c.type) for n, c in zip(("key", "v", "cluster", "upper", "lower", "distance", "scanned", "n", "sums"), cols)])
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
        if schema:
            m = [a for a in range(k) if counts[a]]
            flat = {"cluster": pa.array(m, pa.int32()), "n": pa.array(counts[m]), "sums": pa.array(sums[m].tolist(), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([flat.get(f.name, pa.nulls(len(m), f.type)) for f in schema], schema=schema)

    return rows.mapInArrow(step, STATE.format(kind=kind))


def moved(state: DataFrame, places: np.ndarray) -> np.ndarray:
    """The next centroids: floor(sum / count) of each component, exactly; empty clusters stay."""
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    tasks = state.where("n is not null")
    counts = tasks.groupBy("cluster").agg(total("n"))
    sums = tasks.select("cluster", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(total("x"))
    out = places.copy()
    for r in sums.join(counts, "cluster").collect():  # k times dims numbers
        out[r["cluster"], r["i"]] = int(r["x"]) // int(r["n"])
    return out


def clusters(rows: DataFrame, key: str, column: str, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, scanned: Lloyd's rounds from the k vectors with the
    smallest sha256 of salt and key (then by components). scanned: how many distances to centroids were worked out for the vector."""
    if key in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned"):
        raise ValueError(f"the result has a column {key} of its own")
    spark, kind = rows.sparkSession, rows.select(key).schema[0].dataType.simpleString()
    state, path = durable_at(whole_vectors(rows, key, column, dims, scale))
    rank = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    start = state.orderBy(rank, "v").limit(k).select("v").collect()
    if not start:
        kept = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned long"
        return spark.createDataFrame([], f"`{key}` {kind}, {kept}")
    centroids = Centroids(np.array([r["v"] for r in start], np.int64))
    for r in range(rounds + 1):
        known = ("cluster", "upper", "lower", "scanned") if r else ()
        old = path
        state, path = durable_at(assigned(state.where("v is not null").select("key", "v", *known), centroids, kind))
        forget(spark, old)
        if r < rounds:
            centroids = Centroids(moved(state, centroids.places), centroids.places)
    own = state.where("v is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()  # k rows
    sums = {r["cluster"]: int(r["x"]) for r in own}
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids.places]
    report = [(c, x, sum(sums.values()), sha[c]) for c, x in sums.items()]
    table = spark.createDataFrame(report, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.where("v is not null").join(F.broadcast(table), "cluster")  # k rows
    return out.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
