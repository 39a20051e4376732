"""Approximate search by inverted cells: k-means centroids, points in their nearest cells, exact distances within the cells
that a query probes. How many it probes is calibrated for a recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Task, best_of_blocks, cosine, vectors_of
from .search import top

#: Vectors that a fit reads at most; of them, those that calibrate the probes; points of a cell that cells are made for.
SAMPLE, TRIALS, PER_CELL = 20_000, 200, 64
#: Cells of an index: at least, at most.
LEAST_CELLS, MOST_CELLS = 16, 4096
#: Products of vectors and centroids that are held at a time (8 MB).
PRODUCTS = 1 << 20


@dataclass(frozen=True)
class Cells:
    """Centroids (unit vectors), and the probes that gave the wanted recall on the sample. Bounded: MOST_CELLS rows."""

    centers: np.ndarray
    probes: int

    def own(self, x: np.ndarray) -> list[int]:
        """The cell of each vector."""
        return own(x, self.centers).tolist()

    def probed(self, x: np.ndarray, n: int) -> list[bytes]:
        """The n nearest cells of each vector, as a bit for each cell."""
        found: list[bytes] = []
        for near in products(x, self.centers):
            bits = np.zeros(near.shape, bool)
            np.put_along_axis(bits, np.argsort(-near, axis=1, kind="stable")[:, :n], True, 1)
            found += map(bytes, np.packbits(bits, axis=1))
        return found

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, self.probes, c.tolist()) for i, c in enumerate(self.centers)]
        spark.createDataFrame(rows, "cell int, probes int, center array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Cells:
        rows = spark.read.parquet(path).orderBy("cell").collect()
        return Cells(np.array([r["center"] for r in rows], np.float64).reshape(len(rows), -1), rows[0]["probes"] if rows else 1)


def fit(points: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 12, seed: int = 1, recall: float = 0.95, k: int = 10) -> Cells:
    """Centroids of unit vectors by Lloyd's rounds over a random sample of bounded size; every row is indexed later.

    cells: by default one for each PER_CELL points, within LEAST_CELLS and MOST_CELLS. The probes are the fewest that
    find the share recall of the k nearest of TRIALS sampled vectors within the sample. Null and empty vectors, and those
    of another dimension than most, aren't fitted; without points there are no cells."""
    whole = points.where("size(vector) > 0")
    sizes = whole.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "dim").first()
    if sizes is None:
        return Cells(np.zeros((0, 0)), 1)
    dim, n = sizes
    drawn = whole.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * sample / n))))
    x = np.array([r["vector"] for r in drawn.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).collect()], np.float64)
    x = unit(x[np.isfinite(x).all(axis=1)])
    count = min(len(x), cells or min(MOST_CELLS, max(LEAST_CELLS, n // PER_CELL)))
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), count, replace=False)]
    for _ in range(rounds):
        sums = np.zeros_like(centers)
        np.add.at(sums, own(x, centers), x)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(lengths > 0, sums / np.maximum(lengths, 1e-12), centers)
    return Cells(centers, calibrated(x, centers, x[rng.choice(len(x), min(TRIALS, len(x)), replace=False)], k, recall))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def products(x: np.ndarray, centers: np.ndarray) -> Iterator[np.ndarray]:
    """x times centers, PRODUCTS of them at a time."""
    rows = max(1, PRODUCTS // max(1, len(centers)))
    for at in range(0, len(x), rows):
        yield x[at : at + rows] @ centers.T


def own(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, the first of those that tie."""
    return np.concatenate([np.zeros(0, np.int64), *(near.argmax(axis=1) for near in products(x, centers))])


def calibrated(x: np.ndarray, centers: np.ndarray, trials: np.ndarray, k: int, recall: float) -> int:
    """The fewest probes by which trials find that share of their k nearest in x."""
    cell = own(x, centers)
    k = min(k, len(x))
    near = np.argpartition(cosine(trials, x), k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(trials @ centers.T), axis=1, kind="stable"), axis=1)  # when a trial reaches each cell
    reached = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))) - 1)]) + 1


def _with_cells(vectors: DataFrame, column: str, cells: Cells, name: str, kind: str, of: Callable[[Cells, np.ndarray], list]) -> DataFrame:
    """A column of what the cells say of vectors; null for those that are null, have a null, or are of another dimension."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    shared, dim, arrow = vectors.sparkSession.sparkContext.broadcast(cells), cells.centers.shape[1], to_arrow_type(DataType.fromDDL(kind))

    def add(batch: pa.Array) -> pa.Array:
        at = np.flatnonzero(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dim) if dim else np.zeros(0, int)
        flat = batch.take(pa.array(at)).flatten()
        ok = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), -1).any(axis=1) if len(at) else np.zeros(0, bool)
        out: list = [None] * len(batch)
        for i, found in zip(at[ok], of(shared.value, vectors_of(batch.take(pa.array(at[ok]))).reshape(-1, dim)) if ok.any() else ()):
            out[i] = found
        return pa.array(out, arrow)

    return vectors.withColumn(name, F.arrow_udf(add, kind)(F.col(column)))


def index(points: DataFrame, cells: Cells) -> DataFrame:
    """Points with the cell of their nearest centroid; save() sorts it by cell. A point without a
    vector, or of another dimension, has a null cell and is found by no query."""
    return _with_cells(points, "vector", cells, "cell", "int", Cells.own)


def save(indexed: DataFrame, cells: Cells, path: str) -> None:
    """Writes centroids and points, these sorted by cell, so that a later session searches without a fit."""
    cells.save(indexed.sparkSession, f"{path}/centers")
    indexed.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/points")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Cells]:
    return spark.read.parquet(f"{path}/points"), Cells.load(spark, f"{path}/centers")


def search(indexed: DataFrame, queries: DataFrame, cells: Cells, k: int = 10, probes: int | None = None, ef: int = 0) -> DataFrame:
    """qid, rank, id, score (cosine distance) from the nearest cells; all cells: exact.

    probes: by default those that the fit calibrated, and as many as hold ef points on average. Points don't move: each
    task multiplies its points with the queries that probe their cells, which a query carries as a bit for each cell."""
    n = len(cells.centers)
    if probes is None:
        probes = cells.probes
        if ef > k and n:
            per_cell = max(1, indexed.count() // n)
            probes = max(probes, -(-ef // per_cell))
    q = _with_cells(queries.select("qid", "qvector"), "qvector", cells, "cells", "binary", lambda c, x: c.probed(x, max(1, min(probes, n)))).where("cells IS NOT NULL")
    placed = indexed.where("cell IS NOT NULL").sortWithinPartitions("cell")
    return top(best_of_blocks(placed, q, Task(k, "cosine", cells=True)), k).select("qid", "rank", "id", "score")
