"""Centroid clustering over integer vectors, with centroids screened by norms of blocks of components.

Kept are vectors of exactly `dims` components, none null or non-finite; a component x becomes floor(scale * x), x as double.
Centroids start as the k vectors with the smallest sha256 of `<seed>:<vec_id>` in lowercase hex. A round gives every vector to
the nearest centroid (squared Euclidean distance, ties to the smaller number) and moves each centroid that has vectors to their
componentwise floor(sum / count).

Screening: a vector is stored in compressed form too, a byte for each component in steps of its own, with the norm of what the
bytes leave out in each of its segments. The inner product with a centroid is that of the bytes plus that of the remainders, which
by Cauchy-Schwarz is no more than the sum over segments of the products of norms. So |v|^2 + |c|^2 - 2 * (both) is a lower bound of
the distance, made safe against rounding. The centroid with the smallest bound gets an exact distance first; then only centroids
whose bound doesn't exceed the best exact distance get theirs, in integers.

Work: kept vectors are written once, in compressed form too. A round reads them, and each task returns a count and sums for
each of the k centroids (k is a parameter, so what meets on the driver is k rows and centroids travel with the task: both are
bounded). A lost task is repeated from the written table. Sums are exact: 64-bit inside a task, decimals over tasks.

Edge cases: fewer than k vectors give fewer centroids; vectors with equal ids are ordered by their components; a null id counts as
the empty string in the hash and stays null; equal vectors and repeated rows are vectors of their own; a centroid without vectors
stays as it is; no kept vector gives an empty result; other columns are ignored. A component beyond 2^27 in size fails with a
message, as distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, prepare, stored

DIMS, SCALE, LARGEST = 64, 256, 1 << 27
#: Components in a segment, vectors handled at once, and the share of the norms that rounding may take from a bound.
SEGMENT, ROWS, SLACK = 8, 4096, 1e-9


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, q array<bigint>) of the vectors that are kept."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).where(finite)

    def whole(c: Column) -> Column:
        at = F.floor(c * scale)
        fits = F.abs(c * scale) <= LARGEST
        return F.when(fits, at).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")).cast("bigint"))

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("q"))


def norms(x: np.ndarray) -> np.ndarray:
    """The norm of each segment of each row."""
    return np.sqrt((x * x).reshape(len(x), -1, SEGMENT).sum(2))


def coded(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of integers: bytes, and (step, square of the norm, norms of the segments' remainders)."""
    x = q.astype(np.float64)
    step = np.maximum(np.abs(x).max(1, initial=1.0), 1.0) / 127
    codes = np.rint(x / step[:, None])
    return codes.astype(np.int8), np.column_stack([step, (x * x).sum(1), norms(x - codes * step[:, None])])


def padded(q: np.ndarray) -> np.ndarray:
    """Zero components up to whole segments: they change no distance."""
    return np.pad(q, ((0, 0), (0, -q.shape[1] % SEGMENT)))


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if n:
            q = padded(batch.column(1).flatten().to_numpy().reshape(n, -1))
            codes, form = coded(q)
            columns = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (q.astype("<i4"), codes, form.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["vec_id", "q", "codes", "form"])


def rows_of(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Screen:
    """Nearest centroids of batches of vectors."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = padded(centroids)
        self.plain = self.centroids.astype(np.float64)
        self.norms, self.squares = norms(self.plain), (self.plain * self.plain).sum(1)
        self.pairs = self.exact = 0

    def distances(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = q - self.centroids[c]
        return (d * d).sum(1)

    def bounds(self, codes: np.ndarray, form: np.ndarray) -> np.ndarray:
        """No more than the distances of vectors to centroids."""
        inner = (codes @ self.plain.T) * form[:, :1] + form[:, 2:] @ self.norms.T
        return (form[:, 1:2] + self.squares) * (1 - SLACK) - 2 * inner

    def nearest(self, q: np.ndarray, codes: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nearest centroids and the exact distances. q: int64."""
        bound = self.bounds(codes, form)
        best = bound.argmin(1)
        least = self.distances(q, best)
        bound[np.arange(len(q)), best] = np.inf
        row, other = np.nonzero(bound <= least[:, None])
        self.pairs, self.exact = self.pairs + bound.size, self.exact + len(row) + len(q)
        far = np.full(bound.shape, np.iinfo(np.int64).max)
        far[np.arange(len(q)), best] = least
        for at in range(0, len(row), ROWS):
            r, c = row[at : at + ROWS], other[at : at + ROWS]
            far[r, c] = self.distances(q[r], c)
        cluster = far.argmin(1)  # the first of equal ones
        return cluster, far[np.arange(len(q)), cluster]


def moved(centroids: np.ndarray):
    """Each task's count, sum of distances and sums of components for each centroid that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, k, dims = Screen(centroids), *centroids.shape
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                q = rows_of(batch.column(0), "<i4").astype(np.int64)
                cluster, _ = screen.nearest(q, rows_of(batch.column(1), "<i1").astype(np.float64), rows_of(batch.column(2), "<f8"))
                count += np.bincount(cluster, minlength=k)
                order = np.argsort(cluster, kind="stable")
                held, first = np.unique(cluster[order], return_index=True)
                sums[held] += np.add.reduceat(q[order], first)[:, :dims]
        own = np.nonzero(count)[0]
        if len(own):
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * dims), pa.array(sums[own].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), values], ["cluster", "n", "sums"])

    return run


def assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            if batch.num_rows:
                cluster, distance = screen.nearest(rows_of(batch.column(1), "<i4").astype(np.int64), rows_of(batch.column(2), "<i1").astype(np.float64), rows_of(batch.column(3), "<f8"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def fit(vectors: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after `rounds` rounds over stored vectors (vec_id, q, codes, form)."""
    centroids, dims = first, first.shape[1]
    for _ in range(rounds):
        parts = vectors.select("q", "codes", "form").mapInArrow(moved(centroids), "cluster int, n long, sums array<bigint>")
        sums = [F.sum(F.element_at("sums", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
        centroids = centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # k rows at most
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return centroids


def cluster(spark: SparkSession, vectors: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = DIMS, scale: int = SCALE, seed: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector of vectors(vec_id, embedding)."""
    prepare(spark)
    kept = stored(spark, quantised(vectors, dims, scale).mapInArrow(compressed, "vec_id long, q binary, codes binary, form binary"), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    # k rows. Bytes of q order equal ids: any fixed order of components will do.
    first = kept.select("q", digest.alias("digest")).orderBy("digest", F.hex("q")).limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = fit(kept, np.array([np.frombuffer(bytes(r["q"]), "<i4")[:dims] for r in first], np.int64), rounds)
    held = stored(spark, kept.mapInArrow(assigned(centroids), "vec_id long, cluster int, distance long"), "clusters")
    discard(spark, kept)
    inertia = {r["cluster"]: r["d"] for r in held.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, d, sum(inertia.values()), digests[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return held.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
