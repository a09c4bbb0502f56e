"""Centroid clustering by delta Lloyd: rounds that do only what the last one changed.

Each vector keeps its cluster and its squared distance, and the driver the sums and counts of the k clusters (a table of k
rows, whatever the corpus). A round compares a vector with the centroids that moved; only a vector whose own centroid moved
is compared with all. Vectors that change their cluster are sent as signed integers: their components are taken from the old
cluster's sums and added to the new one's. All arithmetic is in integers, so that no order of rows changes a result.

The state of a round is a table in the shared folder that holds vectors, clusters and distances, written in place of the last
one: no vector is shuffled, and what is shuffled is one partial sum for each task and cluster that a transfer touches.

Kept are vectors of exactly `dims` components, none null or non-finite; others are in no row of the result. A component x
becomes floor(64 x); beyond 2**27 in size it takes that bound, so that distances fit 64 bits. Ties go to the smaller cluster
number. Rows that repeat a vec_id are vectors of their own; equal hashes of ids are ordered by components, and a null vec_id
hashes as an empty number. With fewer vectors than centroids there are as many centroids as vectors; with none, no rows. A
cluster without vectors keeps its centroid. Only the two columns named are read, so that no other can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

DIMS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
BOUND = 2**27
#: Components up to which products and their sums are exact as doubles.
EXACT = 2**22
STATE = "vec_id long, v array<int>, cluster int, distance long, was int"


def integers(vector: Column) -> Column:
    """The components as bounded integers; the bound comes before the floor, which then always fits."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("int"))


def usable(vector: Column, dims: int = DIMS) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes: each task keeps k, and k rows come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids, exact."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def reassign(centroids: list[list[int]], changed: list[int]) -> Callable:
    """For mapInArrow over the state: each vector's cluster and distance after the centroids in `changed` (ascending) moved; `was` is the cluster before, null at first."""
    every, moved = np.array(centroids, np.int64), np.array(changed, np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(2)
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            cluster = held.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            distance = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False).copy()
            own = (cluster < 0) | np.isin(cluster, moved)
            new = cluster.copy()
            if own.any():
                found = squared(v[own], every)
                new[own] = found.argmin(1)
                distance[own] = found.min(1)
            rest = ~own
            if rest.any() and len(moved):
                found = squared(v[rest], every[moved])
                at, near = moved[found.argmin(1)], found.min(1)
                closer = (near < distance[rest]) | (near == distance[rest]) & (at < cluster[rest])
                new[rest] = np.where(closer, at, cluster[rest])
                distance[rest] = np.where(closer, near, distance[rest])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new.astype(np.int32)), pa.array(distance), held], names=["vec_id", "v", "cluster", "distance", "was"])

    return each


def transfers(state: DataFrame, dims: int = DIMS) -> list:
    """(cluster, n, sums): what each cluster gains or loses by the vectors that moved, in one row a cluster."""
    sides = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))
    moved = state.where(~F.col("cluster").eqNullSafe(F.col("was"))).select("v", F.inline(sides)).where("c is not null")
    sums = F.array(*[F.sum(F.col("sign") * F.get("v", F.lit(i)).cast("long")) for i in range(dims)])
    return moved.groupBy("c").agg(F.sum("sign").alias("n"), sums.alias("sums")).collect()


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (the cluster's final components) of each kept vector."""
    vector = F.col(vector_col)
    state = vectors.where(usable(vector, dims)).select(F.col(id_col).cast("long").alias("vec_id"), integers(vector).alias("v"), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("was", "int"))])
    state = stored(state, "vectors")
    centroids = first_centroids(state, k, seed)
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    changed = list(range(len(centroids)))
    for number in range(rounds + 1):
        if not changed:
            break
        before, state = state, stored(state.mapInArrow(reassign(centroids, changed), STATE), "vectors")
        drop_stored(before)
        if number == rounds:
            break
        for row in transfers(state, dims):
            c = row["c"]
            counts[c] += row["n"]
            sums[c] = [a + b for a, b in zip(sums[c], row["sums"], strict=True)]
        moved = [[x // n for x in own] if n else old for own, n, old in zip(sums, counts, centroids, strict=True)]
        changed = [c for c, (a, b) in enumerate(zip(moved, centroids, strict=True)) if a != b]
        centroids = moved
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = F.create_map(*[x for c in sorted(inertia) for x in (F.lit(c), F.struct(F.lit(inertia[c]).cast("long").alias("inertia"), F.array(*[F.lit(x).cast("long") for x in centroids[c]]).alias("centroid")))]) if inertia else None
    own = facts[F.col("cluster")] if facts is not None else F.lit(None).cast("struct<inertia:bigint,centroid:array<bigint>>")
    return state.select("vec_id", "cluster", "distance", own["inertia"].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), own["centroid"].alias("centroid"))


def digest(centroid: Column) -> Column:
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)

