"""The block product behind batched search: queries times points as matrices, and k rows kept for each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vector as V

#: Queries of one block, and points that a task gathers for it; scores of them that are held at a time (8 MB).
BLOCK_QUERIES, CHUNK_POINTS, PAIRS = 2048, 2048, 1 << 20
#: Bytes of queries that are broadcast; more are dealt out in blocks instead. Bytes of points beside one such block.
BROADCAST_BYTES, GROUP_BYTES = 64 << 20, 128 << 20

#: (queries, points) -> scores, lower is nearer; both as float64 matrices.
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    scale = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
    return np.where(scale == 0, V.ZERO_COSINE, 1 - (q @ x.T) / np.where(scale == 0, 1, scale))


def euclidean(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.stack([((x - y) ** 2).sum(axis=1) for y in q])  # without cancellation


def dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return -(q @ x.T)


def codes(x: np.ndarray) -> np.ndarray:
    """Unit vectors as whole numbers of -127 to 127; a zero vector as it is."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.rint(np.clip(x / np.where(n == 0, 1, n), -1, 1) * 127)


def quantized(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 - (codes(q) @ codes(x).T) / 16129.0


SCORES: dict[str, Score] = {"cosine": cosine, "euclidean": euclidean, "dot": dot, "quantized": quantized}


class Best:
    """The k points of the lowest (score, id) for each query, never more, whatever ties."""

    def __init__(self, queries: int, k: int):
        self.k, self.ids = k, []
        self.score, self.more = np.full((queries, k), np.inf), np.full((queries, k), np.inf)
        self.which = np.full((queries, k), -1, np.int64)  # places in ids

    def add(self, rows: np.ndarray | slice, ids: list, score: np.ndarray, more: np.ndarray | None = None) -> None:
        """Scores of the queries rows with points ids."""
        base = len(self.ids)
        self.ids += ids
        score = np.hstack([self.score[rows], np.where(np.isnan(score), np.inf, score)])
        which = np.hstack([self.which[rows], np.broadcast_to(np.arange(base, len(self.ids)), (len(score), len(ids)))])
        at = np.argpartition(score, self.k - 1, axis=1)[:, : self.k]
        edge = np.take_along_axis(score, at, 1).max(axis=1, keepdims=True)
        tied = np.flatnonzero(((score <= edge).sum(axis=1) > self.k) & np.isfinite(edge[:, 0]))
        if len(tied):  # more tie with the k-th: the lowest ids
            order = np.empty(len(self.ids), np.int64)
            order[sorted(range(len(self.ids)), key=self.ids.__getitem__)] = np.arange(len(self.ids))
            for row in tied:
                near = np.flatnonzero(score[row] <= edge[row])
                at[row] = near[np.lexsort((order[which[row, near]], score[row, near]))[: self.k]]
        self.score[rows], self.which[rows] = np.take_along_axis(score, at, 1), np.take_along_axis(which, at, 1)
        if more is not None:
            self.more[rows] = np.take_along_axis(np.hstack([self.more[rows], more]), at, 1)
        if len(self.ids) > 2 * self.which.size + CHUNK_POINTS:
            self.forget()

    def forget(self) -> None:
        """Drops ids that no query holds."""
        self.which[~np.isfinite(self.score)] = -1
        used, back = np.unique(self.which, return_inverse=True)
        skip = int(len(used) > 0 and used[0] == -1)
        self.ids, self.which = [self.ids[i] for i in used[skip:]], back.reshape(self.which.shape) - skip


@dataclass(frozen=True)
class Task:
    """What a search keeps: k rows a query by metric; exact: a second score of those rows."""

    k: int
    metric: str
    exact: str | None = None
    exclude_self: bool = False
    cells: bool = False


class Block:
    """Queries of a block, by dimension, and the best points found for them so far."""

    def __init__(self, task: Task, qids: list, vectors: list, cells: list | None):
        self.task, self.qids = task, qids
        dims = np.array([len(v) for v in vectors])
        self.at = {int(d): np.flatnonzero(dims == d) for d in set(dims.tolist())}
        self.q = {d: np.array([vectors[i] for i in at], np.float64) for d, at in self.at.items()}
        self.best = {d: Best(len(at), task.k) for d, at in self.at.items()}
        self.probed = {d: np.frombuffer(b"".join(cells[i] for i in at), np.uint8).reshape(len(at), -1) for d, at in self.at.items()} if task.cells else {}

    def add(self, ids: list, x: np.ndarray, cell: np.ndarray | None) -> None:
        if x.shape[1] not in self.at:
            return
        step = max(16, PAIRS // len(self.q[x.shape[1]]) // 16 * 16)
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            self._add(ids[part], x[part], None if cell is None else cell[part])

    def _add(self, ids: list, x: np.ndarray, cell: np.ndarray | None) -> None:
        d, task = x.shape[1], self.task
        q, best, score = self.q[d], self.best[d], SCORES[task.metric]
        if not task.cells:
            found = score(q, x)
            if task.exclude_self:
                at = {i: n for n, i in enumerate(ids)}
                for n, i in enumerate(self.at[d]):
                    if self.qids[i] in at:
                        found[n, at[self.qids[i]]] = np.inf
            best.add(slice(None), ids, found, SCORES[task.exact](q, x) if task.exact else None)
            return
        bits = self.probed[d]
        known = cell < 8 * bits.shape[1]
        ids, x, cell = [i for i, ok in zip(ids, known) if ok], x[known], cell[known]
        cells, own, sizes = np.unique(cell, return_inverse=True, return_counts=True)
        asked = (bits[:, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)  # whether a query probes a cell
        if 4 * (asked.sum(axis=0) @ sizes) > len(q) * len(x):  # most pairs have a common cell
            found = score(q, x)
            found[~asked[:, own]] = np.inf
            best.add(slice(None), ids, found)
            return
        for n in range(len(cells)):
            rows, cols = np.flatnonzero(asked[:, n]), np.flatnonzero(own == n)
            if len(rows):
                best.add(rows, [ids[i] for i in cols], score(q[rows], x[cols]))

    def rows(self) -> Iterator[dict[str, list]]:
        for d, b in self.best.items():
            n, m = np.nonzero(np.isfinite(b.score))
            if len(n):
                yield {"qid": [self.qids[self.at[d][i]] for i in n], "id": [b.ids[i] for i in b.which[n, m]], "score": b.score[n, m], "exact": b.more[n, m] if self.task.exact else b.score[n, m]}


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def chunks(batches: Iterator[pa.RecordBatch], cells: bool = False) -> Iterator[tuple[list, np.ndarray, np.ndarray | None]]:
    """Ids and vectors of one dimension, CHUNK_POINTS together or a few more, however the batches are cut."""
    held: dict[int, list] = {}

    def full(dim: int):
        ids, parts, own = zip(*held.pop(dim))
        return [i for x in ids for i in x], np.concatenate(parts), np.concatenate(own) if cells else None

    for b in batches:
        for at in range(0, b.num_rows, CHUNK_POINTS):
            part = b.slice(at, CHUNK_POINTS)
            sizes = np.asarray(part.column(1).value_lengths())
            for dim in set(sizes.tolist()):
                some = part if (sizes == dim).all() else part.filter(pa.array(sizes == dim))
                own = some.column(2).to_numpy() if cells else None
                held.setdefault(dim, []).append((some.column(0).to_pylist(), vectors_of(some.column(1)).reshape(-1, dim), own))
                if sum(len(x[0]) for x in held[dim]) >= CHUNK_POINTS:
                    yield full(dim)
    for dim in list(held):
        yield full(dim)


def best_of_blocks(points: DataFrame, queries: DataFrame, task: Task) -> DataFrame:
    """qid, id, score, exact: for each query and task the k points of the lowest (score, id).

    points: id, vector (and cell); queries: qid, qvector (and cells, a bit for each, the first the highest of its byte). Rows with a null or empty vector, and
    pairs of different dimensions, aren't compared; points with a null component come last and go. Queries are counted
    and measured first. Up to BROADCAST_BYTES they are broadcast in blocks and points stay where they are. Beyond that,
    blocks of queries and groups of points, both of bounded size, meet in a grid of tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, cells = points.sparkSession, task.cells
    queries = queries.where("size(qvector) > 0").select("qid", F.col("qvector").cast("array<double>").alias("qvector"), *(["cells"] if cells else []))
    points = points.where("size(vector) > 0").select("id", F.col("vector").cast("array<float>").alias("vector"), *(["cell"] if cells else []))
    kinds = {"qid": queries.schema["qid"].dataType.simpleString(), "id": points.schema["id"].dataType.simpleString(), "score": "double", "exact": "double"}
    schema = StructType.fromDDL(", ".join(f"{n} {t}" for n, t in kinds.items()))
    fields = to_arrow_schema(schema)
    n, size = queries.agg(F.count(F.lit(1)), F.sum(8 * F.size("qvector") + (F.octet_length("cells") if cells else 0))).first()
    if not n:
        return spark.createDataFrame([], schema)

    def answers(got: tuple[list, list, list | None], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = [slice(at, at + BLOCK_QUERIES) for at in range(0, len(got[0]), BLOCK_QUERIES)]
        blocks = [Block(task, *(None if x is None else x[c] for x in got)) for c in cut]
        for chunk in chunks(parts, cells):
            for block in blocks:
                block.add(*chunk)
        for block in blocks:
            for rows in block.rows():
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in fields], schema=fields)

    if size <= BROADCAST_BYTES:
        sent = spark.sparkContext.broadcast(lists(queries.toArrow(), cells))
        return points.mapInArrow(lambda batches: answers(sent.value, batches), schema)

    total = points.agg(F.sum(4 * F.size("vector"))).first()[0] or 0
    rows, cols = max(1, -(-total // GROUP_BYTES)), -(-size // BROADCAST_BYTES)
    p = points.withColumn("__p", F.pmod(F.xxhash64("id", "vector"), F.lit(rows))).withColumn("__q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
    q = queries.withColumn("__q", F.pmod(F.xxhash64("qid", "qvector"), F.lit(cols))).withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(answers(lists(right, cells), iter(left.combine_chunks().to_batches())), fields)

    return p.groupBy("__p", "__q").cogroup(q.groupBy("__p", "__q")).applyInArrow(meet, schema)


def lists(queries: pa.Table, cells: bool) -> tuple[list, list, list | None]:
    return queries.column("qid").to_pylist(), [np.array(v) for v in queries.column("qvector").to_pylist()], queries.column("cells").to_pylist() if cells else None
