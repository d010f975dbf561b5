"""Centroid clustering of distinct vectors against Lloyd's algorithm over all rows, in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from folioscope.llm import kmeans, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=40, rounds=5, dimensions=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    centroids = [list(v) for *_, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for n, vs in members.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept]
    own = {}
    for _, d, c in found:
        own[c] = own.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((-1 if i is None else i, c, d, own[c], sum(own.values()), digest[c]) for i, d, c in found)


def got(frame):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect())


def test_query_against_plain(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.op11_centroid_clustering(spark, sf_dir)) == plain(rows)


@pytest.mark.parametrize("hot_share", [1000, 1, 1 << 40])
def test_copies_ties_and_broken_rows(spark, monkeypatch, hot_share):
    """Copies by the hundred, equally near centroids, repeated ids, and rows that are left out."""
    monkeypatch.setattr(kmeans, "HOT_SHARE", hot_share)
    rng = random.Random(3)
    grid = [[rng.choice((-0.5, 0.0, 0.25)) for _ in range(4)] for _ in range(12)]
    rows = [(i, grid[0] if i % 3 == 0 else rng.choice(grid), 0) for i in range(300)]
    rows += [(7, [0.1, 0.2, -0.3, 9.0], None), (7, [0.1, 0.2, -0.3, 9.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1), (5, None, 0), (6, [], 0)]
    rows += [(8, [1.0, 2.0, 3.0], 0), (9, [1.0, None, 3.0, 4.0], 0), (10, [1.0, float("nan"), 3.0, 4.0], 0), (11, [1.0, float("-inf"), 3.0, 4.0], 0), (12, [1.0] * 5, 0)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found, _ = kmeans.cluster_vectors(frame, k=6, rounds=4, dimensions=4)
    assert got(found) == plain([(i, v) for i, v, _ in rows], 6, 4, 4)


def test_few_and_no_rows(spark):
    three = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(3)], SCHEMA)
    assert {(r.vec_id, r.distance, r.inertia) for r in kmeans.cluster_vectors(three, dimensions=2)[0].collect()} == {(0, 0, 0), (1, 0, 0), (2, 0, 0)}
    for rows in ([], [(None, [1.0, 2.0], 0)], [(1, None, None)]):
        found, _ = kmeans.cluster_vectors(spark.createDataFrame(rows, SCHEMA), dimensions=2)
        assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clashing_names_and_types(spark):
    wide = spark.createDataFrame([(1, [1.0, -1.0], "a", "b"), (2, [3.0, -0.001], "a", "b")], "vec_id int, embedding array<double>, q string, n string")
    assert {(r.vec_id, r.distance) for r in kmeans.cluster_vectors(wide, dimensions=2)[0].collect()} == {(1, 0), (2, 0)}


def test_exact_beyond_doubles():
    """Distances whose parts pass 2**53 stay exact; larger components are refused."""
    rng = np.random.default_rng(1)
    v, c = rng.integers(-(1 << 26), 1 << 26, (50, 64)), rng.integers(-(1 << 26), 1 << 26, (7, 64))
    best, away = kmeans.nearest(v, c)
    for k in range(50):
        want = [sum((int(a) - int(b)) ** 2 for a, b in zip(v[k], x)) for x in c]
        assert int(away[k]) == min(want) and want.index(min(want)) == best[k]


def test_too_large_components(spark):
    with pytest.raises(Exception, match="too large"):
        kmeans.quantised(spark.createDataFrame([(1, [1e9, 0.0], 0)], SCHEMA), dimensions=2).collect()
