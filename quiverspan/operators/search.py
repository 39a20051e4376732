"""Nearest-neighbour search: exact, batched, quantised in two stages, tiered, progressive."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from .blocks import Task, best_of_blocks

DEFAULT_K = 10


def top(hits: DataFrame, k: int | Column, by: str | None = "qid") -> DataFrame:
    """The k lowest scores of each query, ties by id, with rank from 1. Spark limits groups before the shuffle."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("score", "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (F.lit(k) if isinstance(k, int) else k))


def search(points: DataFrame, query: list[float], k: int = DEFAULT_K, metric: str = "cosine", compat: bool = False, shards: list[int] | None = None, carry: list[str] = []) -> DataFrame:
    """One query: rank, id, score; k of 0 or less is 10. A distributed top-k (TakeOrderedAndProject). shards: only those
    (a filter on the partition column); by default all. carry: columns of points that go along."""
    if not query:
        raise ValueError("a query needs a vector")
    vector = F.array(*(F.lit(float(x)) for x in query))
    points = points if shards is None else points.where(F.col("shard").isin(shards))
    hits = points.select("id", V.distance(metric, F.col("vector"), vector, compat).alias("score"), *carry).orderBy("score", "id").limit(k if k > 0 else DEFAULT_K)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", "id")))  # k rows


def search_batch(points: DataFrame, queries: DataFrame, k: int = DEFAULT_K, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    """The kNN join of queries (qid, qvector) with points (id, vector): qid, rank, id, score, ties by id.

    Each task multiplies its points with blocks of queries as matrices and keeps k rows a query, so what is shuffled is k
    rows for each query and task (see blocks.best_of_blocks). A query with a null or empty vector, or of a dimension that
    no point has, gets no row; so do points without a vector."""
    k = k if k > 0 else DEFAULT_K
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {V.METRICS}")
    return top(best_of_blocks(points, queries, Task(k, metric, exclude_self=exclude_self)), k).select("qid", "rank", "id", "score")


def search_two_stage(points: DataFrame, queries: DataFrame, k: int = DEFAULT_K, factor: int = 4) -> DataFrame:
    """Cosine in two stages: the best k * factor by int8 distance of unit vectors, then exact distance, top k. A task
    scores a block of queries by codes and keeps k * factor rows a query, with their exact distances beside."""
    coarse = top(best_of_blocks(points, queries, Task(k * factor, "quantized", "cosine")), k * factor)
    return top(coarse.select("qid", "id", F.col("exact").alias("score")), k).select("qid", "rank", "id", "score")


def search_quantized(points: DataFrame, query: list[float], k: int = DEFAULT_K) -> DataFrame:
    unit = math.sqrt(sum(float(x) ** 2 for x in query)) or 1.0
    vector = F.array(*(F.lit(float(x) / unit) for x in query))
    hits = points.select("id", V.quantized_distance(V.quantize(V.normalize(F.col("vector"))), V.quantize(vector)).alias("score")).orderBy("score", "id").limit(k)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", "id")))


def merge_hits(*hits: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Hits (qid, id, score) of several tiers or shards: the least score of an id counts; empty ids go; top k."""
    every = reduce(DataFrame.unionByName, [h.select("qid", "id", "score") for h in hits])
    return top(every.where(F.col("id").isNotNull() & (F.col("id").cast("string") != "")).groupBy("qid", "id").agg(F.min("score").alias("score")), k).select("qid", "rank", "id", "score")


def attach(hits: DataFrame, points: DataFrame, include_vectors: bool = False, include_metadata: bool = True) -> DataFrame:
    """Payload and vector of hits, joined after the top-k and only if asked for."""
    wanted = [*(["vector"] if include_vectors else []), *(["payload"] if include_metadata else [])]
    return hits.join(points.select("id", *wanted), "id", "left") if wanted else hits


def label_vote(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """The commonest label among each query's hits; ties by the smaller label."""
    votes = hits.join(labels, "id").groupBy("qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("qid").agg(F.max(F.struct("votes", (-F.col("label")).alias("minus"))).alias("best"))
    return best.select("qid", (-F.col("best.minus")).alias("label"), F.col("best.votes").alias("votes"))


def hot_set(changes: DataFrame, size: int = 30_000) -> DataFrame:
    """The ids first added last, size of them: id, added. Adding an id again doesn't move it."""
    return changes.groupBy("id").agg(F.min("ts").alias("added")).orderBy(F.desc("added"), "id").limit(size)


def progressive_search(shards: list[DataFrame], query: list[float], k: int = DEFAULT_K, metric: str = "cosine", stable_rounds: int = 3) -> Iterator[list[tuple]]:
    """Snapshots of the merged top k after each shard; ends early once k hits stayed the same for stable_rounds shards."""
    now: list[tuple] = []
    same = 0
    for seen, shard in enumerate(shards, 1):
        best: dict = {i: s for s, i in now}
        for r in search(shard, query, k, metric).collect():  # k rows
            best[r["id"]] = min(r["score"], best.get(r["id"], math.inf))
        then = sorted((s, i) for i, s in best.items())[:k]
        same, now = (same + 1 if then == now else 0), then
        yield [(i, s) for s, i in now]
        if same >= stable_rounds and seen >= 2 and len(now) == k:
            return


def effective_ef(k: int, dim: int, base: int = 100, multiplier: int = 2, least: int = 0, most: int = 0) -> int:
    """Candidates to examine: 2k up to base, raised to k * multiplier within (least, most), scaled down for wide vectors,
    k at least."""
    ef = min(base, 2 * k)
    wanted = max(k * multiplier, least or k)
    ef = max(ef, min(wanted, most or base))
    scale = next((s for d, s in ((1024, 0.5), (768, 0.65), (512, 0.8)) if dim >= d), 1.0)
    return max(k, int(ef * scale))


def effective_ef_of(k: Column, dim: Column, base: int = 100, multiplier: int = 2, least: int = 0, most: int = 0) -> Column:
    """effective_ef as a column."""
    floor = F.lit(least) if least else k
    wanted = F.greatest(F.least(F.lit(base), 2 * k), F.least(F.greatest(k * multiplier, floor), F.lit(most or base)))
    scale = F.when(dim >= 1024, 0.5).when(dim >= 768, 0.65).when(dim >= 512, 0.8).otherwise(1.0)
    return F.greatest(k, (wanted * scale).cast("int"))


def candidate_limit_of(k: Column, query: Column) -> Column:
    """candidate_limit with reranking, as a column."""
    n, letters = F.least(2 * k, F.greatest(F.lit(100), k)), F.char_length(query)
    return F.when(letters.between(1, 2), F.least(n, k + F.floor(k / 2).cast("int"))).otherwise(n)


def candidate_limit(k: int, query: str = "", rerank: bool = True) -> int:
    """How many hits to fetch before reranking: min(2k, max(100, k)), fewer for one or two letters, k without reranking."""
    if not rerank:
        return k
    n = min(2 * k, max(100, k))
    return min(n, k + k // 2) if 1 <= len(query) <= 2 else n
