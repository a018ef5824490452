"""Centroid clustering of integer vectors, exact, with Hamerly's bounds: one upper and one lower bound a vector."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propago.session import discard, stored

SCALE = 1024
#: Components below this in size keep every squared distance of up to 500 components in 64 bits.
LIMIT = 1 << 26
#: By which bounds are loosened, so that rounding of doubles never makes one too tight.
SLACK = 1e-9


@dataclass(frozen=True)
class Clusters:
    """Rows (id, cluster, distance), the final centroids, and how many vectors each pass scanned in full."""

    rows: DataFrame
    centroids: list[list[int]]
    scans: list[int]


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, x array<int>): floor(SCALE * component) of usable vectors. Fails on components of LIMIT and more, whose
    squared distances 64 bits can't hold."""
    v = F.col(f"`{vector_col}`")
    scaled = lambda x: F.floor(x.cast("double") * SCALE)
    whole = lambda x: F.when(F.abs(x.cast("double") * SCALE) < LIMIT, scaled(x).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {SCALE} is not under {LIMIT}")).cast("int"))
    return vectors.filter(usable(v, dims)).select(F.col(f"`{id_col}`").alias("id"), F.transform(v, whole).alias("x"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors of smallest sha256 of ``salt``:id, in that order, fewer if there are fewer; equal hashes by components."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r.x) for r in rows.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid, exact in 64-bit integers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def reassign(x: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, scanned) of vectors, from (cluster, upper, lower) against the centroids before they drifted.

    A vector keeps its cluster if its upper bound is below both its lower bound and half the way to the next centroid;
    then no other centroid is as near. Else the upper bound is made exact, and if that does not settle it, all
    distances are taken as integers and ties go to the smaller number.
    """
    k, n = len(centroids), len(x)
    if state is None:
        cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
    else:
        cluster, upper, lower = state[0].copy(), (state[1] + drift[state[0]]) * (1 + SLACK), state[2]
        others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(k)])
        lower = np.where(np.isinf(lower), lower, lower - others[cluster] * (1 + SLACK) - SLACK)
    gaps = np.array([np.sqrt(np.delete(squared(centroids, c), j).min()) if k > 1 else np.inf for j, c in enumerate(centroids)])
    bound = np.maximum(gaps[cluster] / 2 * (1 - SLACK), lower)
    loose = np.flatnonzero(~(upper < bound))
    for j in range(k):
        own = loose[cluster[loose] == j]
        upper[own] = np.sqrt(squared(x[own], centroids[j])) * (1 + SLACK)
    open_ = loose[~(upper[loose] < bound[loose])]
    if len(open_):
        every = np.stack([squared(x[open_], c) for c in centroids], axis=1)
        cluster[open_] = every.argmin(axis=1)
        two = np.partition(every, 1, axis=1)[:, :2] if k > 1 else every
        upper[open_] = np.sqrt(two[:, 0]) * (1 + SLACK)
        lower[open_] = np.sqrt(two[:, 1]) * (1 - SLACK) if k > 1 else np.inf
    scanned = np.zeros(n, bool)
    scanned[open_] = True
    return cluster, upper, lower, scanned


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)


def _passed(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray, last: bool) -> DataFrame:
    """Rows with their cluster and bounds after one pass; the last pass gives each vector's distance instead of itself."""
    fresh = "cluster" not in rows.columns
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "x")
            state = None if fresh else tuple(batch.column(c).to_numpy() for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, scanned = reassign(x, state, centroids, drift)
            made = {"id": batch.column("id"), "cluster": pa.array(cluster, pa.int32()), "scanned": pa.array(scanned)}
            if last:
                distance = np.zeros(len(x), np.int64)
                for j, c in enumerate(centroids):
                    distance[cluster == j] = squared(x[cluster == j], c)
                made["distance"] = pa.array(distance)
            else:
                made |= {"x": batch.column("x"), "upper": pa.array(upper), "lower": pa.array(lower)}
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return rows.mapInArrow(run, f"id {kind}, cluster int, scanned boolean, " + ("distance long" if last else "x array<int>, upper double, lower double"))


def _sums(rows: DataFrame, k: int) -> dict[int, tuple[list[int], int]]:
    """Each cluster's componentwise sums and size, exact; tasks send sums of the centroids' size, Spark adds them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = {}, np.zeros(k, np.int64)
        for batch in batches:
            x, cluster = _matrix(batch, "x"), batch.column("cluster").to_numpy()
            for j in np.unique(cluster):
                total[j] = total.get(j, 0) + x[cluster == j].sum(axis=0)
                count[j] += (cluster == j).sum()
        for j, sums in total.items():
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([j] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(sums, pa.int64()), pa.array([count[j]] * n, pa.int64())], names=["cluster", "at", "total", "n"])

    parts = rows.select("cluster", "x").filter(F.size("x") > 0).mapInArrow(run, "cluster int, at int, total long, n long")
    exact = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    found: dict[int, tuple[list[int], int]] = {}
    for r in sorted(exact.collect(), key=lambda r: (r.cluster, r.at)):
        found.setdefault(r.cluster, ([], r.n))[0].append(int(r.total))
    return found


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", salt: str = "3") -> Clusters:
    """Exact rounds of nearest-centroid assignment and floor means on integer vectors, then one more assignment.

    Each round is one pass that writes every vector's cluster and bounds in the shared folder, and one that adds up
    clusters; the table of the round before is then removed. The driver holds k centroids. Empty clusters keep their
    centroid. Rows of equal id are vectors of their own; unusable vectors (see ``usable``) take no part; no usable
    vector gives no rows and no centroids. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows, path = stored(quantised(vectors, id_col, vector_col, dims))
    current = first_centroids(rows, k, salt)
    if not current:
        return Clusters(spark.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long"), [], [])
    centroids, scans = np.array(current, np.int64), []
    drift = np.zeros(len(centroids))
    for _ in range(rounds):
        before, old = path, centroids
        rows, path = stored(_passed(rows, centroids, drift, last=False))
        discard(spark, before)
        scans.append(rows.filter("scanned").count())
        centroids = old.copy()
        for j, (total, n) in _sums(rows, len(old)).items():
            centroids[j] = [t // n for t in total]
        drift = np.sqrt([float(squared(a[None], b)[0]) for a, b in zip(centroids, old)]) * (1 + SLACK)
    final, _ = stored(_passed(rows, centroids, drift, last=True))
    discard(spark, path)
    scans.append(final.filter("scanned").count())
    return Clusters(final.drop("scanned"), centroids.tolist(), scans)


def digest(centroid: list[int]) -> str:
    """sha256 of a centroid's components, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def report(found: Clusters) -> DataFrame:
    """Rows with the summed distance of their cluster and of all, and their centroid's digest."""
    spark = found.rows.sparkSession
    sums = {r.cluster: int(r.total) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    table = [(j, sums.get(j, 0), sum(sums.values()), digest(c)) for j, c in enumerate(found.centroids)]
    facts = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(facts), "cluster")  # one row a centroid
