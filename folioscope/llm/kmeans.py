"""Lloyd's algorithm over distinct quantised vectors with multiplicities, in exact integers.

Every component x becomes floor(scale * x); equal quantised vectors become one row with
their number.  All rounds run on these distinct rows: each is assigned to its nearest
centroid, and a centroid becomes the componentwise floor of the weighted integer mean of its
vectors.  At the end the assignments are joined back to the rows.

Scale: copies are counted before anything is shuffled (partial aggregation), so a vector that
a third of all rows share is one row in every round.  A round moves no vector: tasks read
the distinct rows where they are written and give k sums for each component, which Spark adds
up; the driver sees k x dimensions numbers.  Joining back, the few vectors that more than one
in ``HOT_SHARE`` rows share are broadcast (there are fewer than that), and all others meet by
an equi-join, so no key of the shuffle is hot.

Arithmetic: vectors are 64-bit integers; products go over doubles only while every partial
result stays below 2**53, so they are exact.  Components so large that a squared distance
need not fit into 64 bits (of 64 components: above 2**27, of x: above 2**19) raise.

Defined cases: a vector that is null, has another number of components, or one that is null,
infinite or not a number is left out; fewer kept rows than k give so many centroids; a row
without a vec_id is kept but never seeds (if no row has one, the result is empty); rows that repeat an id, or the whole row, count each (as
seeds too: by hash, then id, then vector); other columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import cut

K, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: A vector that one in so many rows has is hot.
HOT_SHARE = 1000
#: The centroids go to every task.
MAX_CENTROID_CELLS = 1 << 22


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and q (little-endian 32-bit components) of each row that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            fits = np.asarray(rows.value_lengths().fill_null(-1)) == dimensions
            batch = batch.filter(pa.array(fits))
            # null components turn into NaN here
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            good = np.isfinite(x).all(axis=1)
            q = np.floor(scale * x[good])
            if q.size and 4 * dimensions * float(np.abs(q).max()) ** 2 >= 2.0**62:
                raise ValueError("components are too large for squared distances of 64 bits")
            packed = pa.Array.from_buffers(pa.binary(4 * dimensions), len(q), [None, pa.py_buffer(q.astype("<i4"))]).cast(pa.binary())
            yield pa.record_batch([batch.column(0).filter(pa.array(good)), packed], names=["vec_id", "q"])

    narrow = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return narrow.mapInArrow(run, "vec_id long, q binary")


def unpack(column: pa.Array, dimensions: int) -> np.ndarray:
    """The components of each value, a row each."""
    if not len(column):
        return np.zeros((0, dimensions), np.int64)
    _, where, what = column.buffers()
    begin = int(np.frombuffer(where, np.int32)[column.offset])
    return np.frombuffer(what, "<i4", len(column) * dimensions, begin).reshape(-1, dimensions).astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (of equally near ones the first) and the squared distance."""
    most = int(max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)))
    exact = np.float64 if 4 * vectors.shape[1] * most * most < 1 << 53 else np.int64
    v, c = vectors.astype(exact), centroids.astype(exact)
    away = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    best = away.argmin(axis=1)
    return best, away[np.arange(len(best)), best].astype(np.int64)


def seeds(rows: DataFrame, k: int, seed: int) -> list[bytes]:
    """The vectors of the k smallest SHA-256 values of the ids, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [bytes(r.q) for r in rows.filter("vec_id IS NOT NULL").select(h.alias("h"), "vec_id", "q").orderBy("h", "vec_id", "q").limit(k).collect()]


def weighted_sums(distinct: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """Of each cluster that has vectors the sums of their components, and at the end their number."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dimensions + 1), np.int64)
        held = 0

        def told() -> pa.RecordBatch:
            some = np.flatnonzero(total[:, -1])
            cell = np.arange(dimensions + 1, dtype=np.int32)
            return pa.record_batch([pa.array(np.repeat(some, dimensions + 1).astype(np.int32)), pa.array(np.tile(cell, len(some))), pa.array(total[some].ravel())], names=["cluster", "cell", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            q, n = unpack(batch.column("q"), dimensions), batch.column("n").to_numpy()
            if held and held + int(n.sum()) >= 1 << 36:  # sums stay in 64 bits
                yield told()
                total[:], held = 0, 0
            held += int(n.sum())
            best, _ = nearest(q, centroids)
            by = np.argsort(best, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(best[by]) != 0])
            total[best[by][first]] += np.add.reduceat(np.c_[q, np.ones(len(q), np.int64)][by] * n[by][:, None], first)
        if held:
            yield told()

    parts = distinct.select("q", "n").mapInArrow(run, "cluster int, cell int, part long")
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "cell").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect():
        out.setdefault(r.cluster, [0] * (dimensions + 1))[r.cell] = int(r.s)
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The distinct rows with cluster and distance."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, away = nearest(unpack(batch.column("q"), dimensions), centroids)
            yield pa.record_batch([*batch.columns, pa.array(best.astype(np.int32)), pa.array(away)], names=["q", "n", "cluster", "distance"])

    return distinct.select("q", "n").mapInArrow(run, "q binary, n long, cluster int, distance long")


def joined_back(rows: DataFrame, found: DataFrame, n_rows: int) -> DataFrame:
    """vec_id, cluster and distance of every row, from those of its vector."""
    hot = F.col("n") * HOT_SHARE > n_rows
    few = found.filter(hot).select("q", "cluster", "distance")
    marked = rows.join(F.broadcast(few), "q", "left")
    rest = marked.filter("cluster IS NULL").select("vec_id", "q").join(found.filter(~hot).select("q", "cluster", "distance"), "q")
    columns = ["vec_id", "cluster", "distance"]
    return marked.filter("cluster IS NOT NULL").select(*columns).union(rest.select(*columns))


def cluster_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """Per kept row vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256; and the centroids."""
    if k < 1 or k * dimensions > MAX_CENTROID_CELLS:
        raise ValueError(f"{k} centroids of {dimensions} components; at least one, and at most {MAX_CENTROID_CELLS} components in all")
    rows = cut(quantised(vectors, id_col=id_col, vector_col=vector_col, dimensions=dimensions, scale=scale))
    distinct = cut(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")))
    centroids = np.frombuffer(b"".join(seeds(rows, k, seed)), "<i4").reshape(-1, dimensions).astype(np.int64)
    if not len(centroids):
        # no id, so no seed: nothing can be assigned
        rows = rows.limit(0)
        centroids = np.zeros((1, dimensions), np.int64)
    for _ in range(rounds):
        for cluster, sums in weighted_sums(distinct, centroids).items():
            centroids[cluster] = [s // sums[-1] for s in sums[:-1]]
    found = cut(assigned(distinct, centroids))
    told = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("d"), F.sum("n").alias("n")).collect()
    whole = sum((r.d for r in told), Decimal(0))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    clusters = vectors.sparkSession.createDataFrame([(r.cluster, int(r.d), int(whole), digest[r.cluster]) for r in told], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = joined_back(rows, found, sum(r.n for r in told)).join(F.broadcast(clusters), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
