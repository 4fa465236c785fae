"""Centroid clustering against plain Lloyd's rounds in whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from seedlake.llm import clusters

NAMES = ["vec_id", "embedding", "label", "cluster", "n"]
SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, n int"


def lloyd(rows, k, rounds, dims, scale):
    kept = [(key, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for key, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    places = [v for _, v in start]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(places)), key=lambda c: (dist(v, places[c]), c))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        for c in range(len(places)):
            own = [v for (_, v), a in zip(kept, at) if a == c]
            if own:
                places[c] = tuple(sum(x) // len(own) for x in zip(*own))
    at = [near(v) for _, v in kept]
    each = [dist(v, places[a]) for (_, v), a in zip(kept, at)]
    inertia = lambda c: sum(d for d, a in zip(each, at) if a == c)
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in places]
    return sorted(((key is None, key or 0), a, d, inertia(a), sum(each), sha[a]) for (key, _), a, d in zip(kept, at, each))


def result(found):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect())


def table(spark, rows):
    return spark.createDataFrame([(key, v, 0, "x", 1) for key, v in rows], SCHEMA)


@pytest.mark.parametrize("kind", ["blobs", "grid"])
def test_against_lloyd(spark, kind):
    """Blobs, where the bounds prune, and points of a small grid, where nearly all distances are tied; odd rows among them."""
    rnd = random.Random(4)
    middle = [[rnd.uniform(-3, 3) for _ in range(4)] for _ in range(9)]
    blob = lambda i: [m + rnd.gauss(0, 0.15) for m in middle[i % 9]]
    rows = [(i, blob(i) if kind == "blobs" else [float(rnd.randrange(3)) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(None, rows[3][1])]
    odd = [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 2.0, 3.0]), (904, [1.0, float("nan"), 2.0, 3.0]), (905, [float("inf"), 0.0, 2.0, 3.0])]
    found = clusters.clusters(table(spark, rows + odd).repartition(5), "vec_id", "embedding", k=6, rounds=7, dims=4, scale=64 if kind == "blobs" else 1)
    assert result(found) == lloyd(rows, 6, 7, 4, 64 if kind == "blobs" else 1)
    if kind == "blobs":  # a whole search would be 48 distances a vector
        assert found.agg({"scanned": "avg"}).first()[0] < 30


def test_few_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])]
    find = lambda rows, **more: clusters.clusters(table(spark, rows), "vec_id", "embedding", dims=2, **more)
    assert result(find(rows)) == lloyd(rows, 8, 10, 2, 1024)
    assert result(find(rows, k=1)) == lloyd(rows, 1, 10, 2, 1024)
    empty = find([])
    assert empty.count() == 0 and empty.columns == find(rows).columns
    with pytest.raises(Exception, match="over 134217728"):
        find([*rows, (4, [3.0e38, 0.0])])
    with pytest.raises(ValueError, match="of its own"):
        clusters.clusters(table(spark, rows).withColumnRenamed("cluster", "x").withColumnRenamed("vec_id", "cluster"), "cluster", "embedding")


def test_large_components_are_exact(spark):
    """Beyond 53 bits distances are worked out in whole numbers."""
    rnd = random.Random(8)
    rows = [(i, [float(rnd.randrange(-(1 << 17), 1 << 17)) for _ in range(64)]) for i in range(60)]
    assert result(clusters.clusters(table(spark, rows), "vec_id", "embedding", rounds=3, scale=64)) == lloyd(rows, 8, 3, 64, 64)
