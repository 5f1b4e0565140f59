"""Clustering of integer vectors around centroids, with most centroids screened out by segment norms.

A vector's squared distance to a centroid is at least the sum, over segments of the components, of the squared difference
of their norms there (Cauchy-Schwarz). Norms are computed once for each vector and kept beside it, so a round needs exact
integer distances only to the centroids whose bound is not beyond the best exact distance so far.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import map_arrow
from ._store import materialize

SIZE, CENTROIDS, ROUNDS, SCALE, SEGMENTS = 64, 16, 3, 64, 8
#: Components below this have distances that fit a 64-bit integer; others are Python integers.
_NARROW = 1 << 27
#: Sums leave a task as high * 2**96 + low, so that they add up in decimals.
_LOW = 96
_MOST = (1 << 63) - 1


def kept_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", size: int = SIZE) -> DataFrame:
    """Rows whose vector has ``size`` components, all of them finite and in a float's range: vec_id, vector."""
    v = F.col(vector_column).cast("array<double>")
    fits = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**128)))
    return vectors.select(F.col(id_column).alias("vec_id"), v.alias("vector")).where(F.coalesce(fits, F.lit(False)))


def _integers(batch: pa.RecordBatch, size: int, scale: int) -> np.ndarray:
    """floor(scale * x) of all components, as 64-bit or Python integers."""
    x = np.floor(scale * batch.column("vector").flatten().to_numpy()).reshape(-1, size)
    return x.astype(np.int64) if np.abs(x).max(initial=0) < _NARROW else np.vectorize(int, otypes=[object])(x)


def _norms(x: np.ndarray, segments: int) -> np.ndarray:
    """Norms of the segments; by floats, with an error far below the screen's margin."""
    own = np.square(x.astype(np.float64))
    return np.sqrt(np.add.reduceat(own, np.linspace(0, x.shape[1], segments, endpoint=False).astype(int), axis=1))


def with_norms(kept: DataFrame, size: int = SIZE, scale: int = SCALE, segments: int = SEGMENTS) -> DataFrame:
    """The vectors with their segment norms (norms)."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                norms = _norms(_integers(b, size, scale), segments)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(norms) + 1, dtype=np.int32) * segments), pa.array(norms.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), flat], names=["vec_id", "vector", "norms"])

    return map_arrow(kept, run, "vec_id long, vector array<double>, norms array<double>")


def nearest(x: np.ndarray, norms: np.ndarray, centroids: list[list[int]], segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (the first at ties), the squared distance, and how many exact distances it took."""
    narrow = x.dtype == np.int64 and all(abs(c) < _NARROW for row in centroids for c in row)
    x = x if narrow else x.astype(object)
    middle = np.array(centroids, dtype=np.int64 if narrow else object)
    own = _norms(middle, segments)
    bound = np.square(norms[:, None, :] - own[None]).sum(axis=2)
    bound -= 1e-9 * (np.square(norms).sum(axis=1)[:, None] + np.square(own).sum(axis=1)[None]) + 1e-9
    cluster = bound.argmin(axis=1)
    exact = lambda rows, k: np.square(x[rows] - middle[k]).sum(axis=1)
    distance = exact(slice(None), cluster)
    done = len(x)
    first = cluster.copy()
    for k in range(len(centroids)):
        rows = np.flatnonzero((bound[:, k] <= distance.astype(np.float64) * (1 + 1e-12)) & (first != k))
        if len(rows):
            done += len(rows)
            d = exact(rows, k)
            nearer = (d < distance[rows]) | ((d == distance[rows]) & (k < cluster[rows]))
            rows = rows[nearer.astype(bool)]
            cluster[rows], distance[rows] = k, d[nearer.astype(bool)]
    return cluster, distance, done


def _assigned(batch: pa.RecordBatch, centroids: list[list[int]], size: int, scale: int, segments: int):
    x = _integers(batch, size, scale)
    cluster, distance, _ = nearest(x, batch.column("norms").flatten().to_numpy().reshape(-1, segments), centroids, segments)
    return x, cluster, distance


def _moved(vectors: DataFrame, centroids: list[list[int]], size: int, scale: int, segments: int) -> list[list[int]]:
    """The centroids after one round: sums within tasks, then one row for each cluster and component."""

    def run(batches):
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, cluster, _ = _assigned(b, centroids, size, scale, segments)
            for k in np.unique(cluster).tolist():
                rows = x[cluster == k]
                count[k] = count.get(k, 0) + len(rows)
                total[k] = total.get(k, 0) + rows.sum(axis=0).astype(object)
        rows = [(k, i, count[k], s >> _LOW, s & ((1 << _LOW) - 1)) for k, own in total.items() for i, s in enumerate(map(int, own))]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["cluster", "i", "n", "high", "low"])

    parts = map_arrow(vectors, run, "cluster int, i int, n long, high decimal(38,0), low decimal(38,0)")
    # A row for each centroid and component: bounded whatever the vectors.
    sums = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    moved = [list(c) for c in centroids]
    for r in sums:
        moved[r.cluster][r.i] = ((int(r.high) << _LOW) + int(r.low)) // r.n
    return moved


def centroid_clusters(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", size: int = SIZE, n_centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, segments: int = SEGMENTS
) -> DataFrame:
    """Cluster the vectors of ``size`` finite components, each taken as the integer floor(scale * x).

    Centroids start as the vectors whose ids' hashes are smallest (a null id hashes as ``1:`` alone, equal ids go by their
    components); with fewer vectors there are fewer. Rows that share an id are clustered apart. Components beyond a
    float's range count as not finite. Sums and distances are exact at any size; a distance or inertia that a long does
    not hold is null. No kept vectors: no rows. Further columns are not carried.

    Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.
    """
    kept = kept_vectors(vectors, id_column, vector_column, size)
    held = materialize(with_norms(kept, size, scale, segments), "vectors")
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = held.select("vector", key.alias("h")).orderBy("h", "vector").limit(n_centroids).collect()
    centroids = [[int(np.floor(scale * x)) for x in r.vector] for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = _moved(held, centroids, size, scale, segments)

    def run(batches):
        for b in batches:
            if b.num_rows:
                _, cluster, distance = _assigned(b, centroids, size, scale, segments)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array([d if d <= _MOST else None for d in map(int, distance)], pa.int64())], names=["vec_id", "cluster", "distance"])

    found = materialize(map_arrow(held, run, "vec_id long, cluster int, distance long"), "clusters")
    wide = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    # At most n_centroids rows.
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(wide.alias("inertia")).collect()}
    every = None if None in inertia.values() else sum(inertia.values())
    held_long = lambda n: None if n is None or n > _MOST else int(n)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(k, held_long(n), digest(centroids[k])) for k, n in sorted(inertia.items())]
    each = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(each), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(held_long(every)).cast("long").alias("inertia"), "centroid_sha256")
