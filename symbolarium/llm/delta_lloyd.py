"""Delta Lloyd: exact integer k-means that repeats only the comparisons a round can change.

Vectors become integers, so sums, distances and means are exact and independent of how
rows are dealt. A state table in the shared folder holds each vector with its cluster and
distance. A round compares every vector with the centroids that changed and, where its own
one moved away from it, with all; only vectors that change cluster send signed integer
transfers to the sums, which are ``k * (dims + 1)`` numbers on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm.workspace import stored

#: Components beyond this could overflow the long that holds a squared distance.
LARGEST = 1 << 27
#: Rows of one step: keeps the step's distance matrix small whatever Arrow batches hold.
STEP = 16_384

_STATE = "vec_id long, v array<long>, cluster int, distance long, was int"


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, dims = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * dims, dims, dtype=np.int32), matrix.reshape(-1))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """``vectors(vec_id, embedding)`` to ``(vec_id, v)``: rows with exactly ``dims`` components,
    none null or non-finite, each turned into ``floor(scale * x)``.

    Null arrays and others go; null ids, repeated rows and an empty table stay as they are.
    Components of ``LARGEST`` or more after scaling are an error, as distances would overflow.
    """

    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            sized = pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), dims), False)
            batch = batch.filter(sized)
            flat = batch.column("embedding").flatten()
            x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
            good = np.isfinite(x).all(axis=1)
            x = np.floor(scale * x[good])
            if x.size and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a scaled component is beyond {LARGEST}")
            yield pa.record_batch([batch.column("vec_id").filter(pa.array(good)).cast(pa.int64()), _lists(x.astype(np.int64))], ["vec_id", "v"])

    return vectors.select("vec_id", "embedding").mapInArrow(convert, "vec_id long, v array<long>")


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    top = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    # Below 2**53 every partial sum of the float product is exact, and much faster.
    kind = np.float64 if 4 * v.shape[1] * top * top < 1 << 53 else np.int64
    a, b = v.astype(kind), centroids.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def reassigned(v: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroids (ties: the smaller number), their distances, and how many distances
    were computed. ``cluster`` and ``distance`` are right for the centroids before those marked
    ``changed`` moved; a cluster of -1 has none yet. A vector whose own centroid came no farther
    still beats every unchanged one, so only the others need all centroids again."""
    cluster, distance = cluster.copy(), distance.copy()
    owned = np.flatnonzero((cluster >= 0) & changed[cluster])
    own = v[owned] - centroids[cluster[owned]]
    own = (own * own).sum(axis=1)
    fresh = np.zeros(len(v), bool)
    fresh[owned] = own > distance[owned]
    fresh |= cluster < 0
    distance[owned] = own
    computed = len(owned)
    numbers = np.flatnonzero(changed)
    rest = np.flatnonzero(~fresh)
    if len(numbers) and len(rest):
        d = squared_distances(v[rest], centroids[numbers])
        j = d.argmin(axis=1)
        best, number = d[np.arange(len(rest)), j], numbers[j]
        better = (best < distance[rest]) | ((best == distance[rest]) & (number < cluster[rest]))
        cluster[rest[better]], distance[rest[better]] = number[better], best[better]
        computed += d.size
    fresh = np.flatnonzero(fresh)
    if len(fresh):
        d = squared_distances(v[fresh], centroids)
        cluster[fresh] = d.argmin(axis=1)
        distance[fresh] = d[np.arange(len(fresh)), cluster[fresh]]
        computed += d.size
    return cluster, distance, computed


def _assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            was = batch.column("cluster").to_numpy(zero_copy_only=False)
            distance = batch.column("distance").to_numpy(zero_copy_only=False)
            cluster, distance, _ = reassigned(_matrix(batch.column("v"), centroids.shape[1]), was, distance, centroids, changed)
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(was, pa.int32())]
            yield pa.record_batch(columns, ["vec_id", "v", "cluster", "distance", "was"])

    return state.select("vec_id", "v", "cluster", "distance").mapInArrow(assign, _STATE)


def _transfers(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """What the vectors that changed cluster add to each cluster's count and component sums.
    A task folds its rows into at most ``k`` signed rows; the driver gets ``k * (dims + 1)`` numbers."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, dims + 1), np.int64)  # the last row takes what leaves no cluster
        for batch in _steps(batches):
            v = np.c_[np.ones(batch.num_rows, np.int64), _matrix(batch.column("v"), dims)]
            np.add.at(sums, batch.column("cluster").to_numpy(zero_copy_only=False), v)
            np.subtract.at(sums, batch.column("was").to_numpy(zero_copy_only=False), v)
        some = np.flatnonzero(sums[:k].any(axis=1))
        yield pa.record_batch([pa.array(some, pa.int32()), _lists(sums[some])], ["cluster", "delta"])

    moved = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(fold, "cluster int, delta array<long>")
    cells = moved.select("cluster", F.posexplode("delta").alias("at", "d")).groupBy("cluster", "at").agg(F.sum("d").alias("d"))
    out = np.zeros((k, dims + 1), np.int64)
    for r in cells.collect():
        out[r["cluster"], r["at"]] = r["d"]
    return out


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors (all, if fewer) with the smallest SHA-256 of ``salt:vec_id``, in that order.
    A null id counts as empty text; one id's several vectors go by their components."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2") -> DataFrame:
    """``vectors(vec_id, embedding)`` clustered by ``rounds`` rounds of Lloyd and one more assignment.

    Returns for each kept vector (see ``integer_vectors``) ``vec_id, cluster, distance,
    cluster_inertia, inertia, centroid_sha256``; repeated rows and null ids one row each. With
    fewer than ``k`` kept vectors each starts a centroid; equal starts leave the later ones
    empty, and an empty centroid stays where it is. No kept vector, no row. Other columns are
    ignored. Stops early when no centroid moves, which changes nothing.
    """
    kept = integer_vectors(vectors, dims, scale)
    centroids = first_centroids(kept, k, salt)
    k = len(centroids)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    state = kept.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    sums = np.zeros((k, dims + 1), np.int64)
    changed = np.ones(k, bool)
    for left in range(rounds, -1, -1):
        state = stored(_assigned(state, centroids, changed), "clusters")
        if not left:
            break
        sums = sums + _transfers(state, k, dims)
        some = sums[:, 0] > 0
        moved = centroids.copy()
        moved[some] = sums[some, 1:] // sums[some, :1]
        changed = (moved != centroids).any(axis=1)
        if not changed.any():
            break
        centroids = moved
    inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, d, sum(inertia.values()), digests[c]) for c, d in inertia.items()]
    each = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(each), "cluster").select(*(f.split()[0] for f in schema.split(", ")))
