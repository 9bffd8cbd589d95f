"""Delta Lloyd: exact integer centroid clustering that only looks at what has changed.

Vectors are integers, so all sums and distances are exact and do not depend on partitioning. The state, vectors
with owner and distance, is a table in the shared folder, written anew each round and then only read. A round compares

* vectors whose centroid has moved with every centroid,
* all others with the moved centroids only: their own distance still holds.

Vectors that change owners are then subtracted from one cluster's sum and added to the other's. Each task adds up its
transfers to a row a cluster before the shuffle, so a cluster of a third of all vectors costs no more than others.
Sums are a table too; the driver and the tasks hold ``k`` centroids, a bound that does not grow with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, forget

SCALE = 256
#: Integers beyond this end the run with an error: squared distances would leave 64 bits.
LARGEST = 1 << 27
#: Up to here products and their sums are exact in floating point.
_EXACT = 1 << 22


def quantized(vectors: DataFrame, dims: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(``vec_id``, ``v``): vectors with exactly ``dims`` components, none null or non-finite, as integers floor(256 x)."""
    x = F.col(embedding).cast("array<double>")
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = vectors.where(F.coalesce((F.size(x) == dims) & ~odd, F.lit(False)))
    huge = F.raise_error(F.lit(f"a component times {SCALE} is not between -{LARGEST} and {LARGEST}")).cast("int")
    ints = F.transform(x, lambda e: F.when(F.abs(e) * SCALE < LARGEST, F.floor(e * SCALE).cast("int")).otherwise(huge))
    return whole.select(F.col(vec_id).cast("long").alias("vec_id"), ints.alias("v"))


def distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (int64) of integer vectors to centres, exact."""
    most = max((int(np.abs(x).max()) for x in (v, centres) if x.size), default=0)
    kind = np.float64 if most <= _EXACT else np.int64
    a, b = v.astype(kind), centres.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def reassigned(v: np.ndarray, owner: np.ndarray, own: np.ndarray, centres: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centres and distances, from the owners and distances before centres ``moved`` (bool) took their places.

    Owner -1: none yet. Of equally near centres the smaller number wins.
    """
    owner, own = owner.copy(), own.copy()
    lost = (owner < 0) | moved[owner]
    if lost.any():
        d = distances(v[lost], centres)
        owner[lost] = d.argmin(axis=1)
        own[lost] = d.min(axis=1)
    some = np.flatnonzero(moved)
    if len(some) and not lost.all():
        rest = np.flatnonzero(~lost)
        d = distances(v[rest], centres[some])
        best, near = some[d.argmin(axis=1)], d.min(axis=1)
        take = (near < own[rest]) | ((near == own[rest]) & (best < owner[rest]))
        owner[rest[take]], own[rest[take]] = best[take], near[take]
    return owner, own


_STATE = "vec_id long, v array<int>, was int, owner int, distance long"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _round(centres: np.ndarray, moved: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            was = batch.column("owner").to_numpy()
            owner, own = reassigned(_matrix(batch.column("v")), was, batch.column("distance").to_numpy(), centres, moved)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(was, pa.int32()), pa.array(owner, pa.int32()), pa.array(own, pa.int64())],
                ["vec_id", "v", "was", "owner", "distance"],
            )

    return run


def _transfers(k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _matrix(batch.column("v")).astype(np.int64)
            for sign, name in ((1, "owner"), (-1, "was")):
                at = batch.column(name).to_numpy()
                some = at >= 0  # a first owner takes from nobody
                np.add.at(total, at[some], sign * v[some])
                np.add.at(count, at[some], sign)
        used = np.flatnonzero(total.any(axis=1) | (count != 0))
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * dims, pa.int32()), pa.array(total[used].reshape(-1), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), sums], ["cluster", "size", "sums"])

    return run


def start(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``salt`` and id, by hash, then by components; fewer if there are fewer.

    A null id counts as empty text. ``k`` rows come to the driver.
    """
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def centroid_text(centre: np.ndarray) -> str:
    return ",".join(str(int(x)) for x in centre)


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, salt: str = "", vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(``vec_id``, ``cluster``, ``distance``) for each vector of ``quantized``, and the final centroids.

    Vectors that it leaves out (null, of other lengths, with null or non-finite components) have no row. Repeated
    rows are vectors of their own. Fewer vectors than ``k`` make as many clusters. No vectors give no rows and no centroids.
    """
    state = cut(quantized(vectors, dims, vec_id, embedding).withColumns({"was": F.lit(-1), "owner": F.lit(-1), "distance": F.lit(0).cast("long")}), "vectors")
    centres = start(state, k, salt)
    if not len(centres):
        return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), centres.reshape(0, dims)
    moved, sums = np.ones(len(centres), bool), None
    for number in range(rounds + 1):
        if not moved.any():
            break
        before, state = state, cut(state.mapInArrow(_round(centres, moved), _STATE), "vectors")
        forget(before)
        if number == rounds:
            break
        changed = state.where("owner <> was").select("v", "was", "owner").mapInArrow(_transfers(len(centres), dims), "cluster int, size long, sums array<long>")
        both = changed if sums is None else changed.unionByName(sums)
        added = both.groupBy("cluster").agg(F.sum("size").alias("size"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"))
        sums = cut(added, "sums")
        new = centres.copy()
        for r in sums.where("size > 0").collect():  # k rows at most
            new[r.cluster] = [s // r.size for s in r.sums]
        moved, centres = (new != centres).any(axis=1), new
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), centres


def summary(clustered: DataFrame, centres: np.ndarray) -> DataFrame:
    """``clustered`` with ``cluster_inertia``, ``inertia`` (sums of distances) and ``centroid_sha256``."""
    spark = clustered.sparkSession
    own = clustered.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    inertia = sum(r.cluster_inertia for r in own)
    rows = [(r.cluster, r.cluster_inertia, inertia, hashlib.sha256(centroid_text(centres[r.cluster]).encode()).hexdigest()) for r in own]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(facts), "cluster")
