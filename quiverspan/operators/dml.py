"""Upserts, deletes, change logs, segments and compaction: last write wins by (ts, seq)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from .search import DEFAULT_K, search

# When a segment is sealed, how many are compacted, when deletions call for a rebuild, when a search ends early.
SEAL_VECTORS, SEAL_BYTES, SEAL_SECONDS = 100_000, 512 << 20, 600
COMPACT_FAN_IN = 4
REBUILD_DELETED, REBUILD_RATIO = 5000, 0.30
SEARCH_FANOUT, EARLY_STOP_FACTOR = 8, 2


def validate_points(points: DataFrame, dimension: int) -> DataFrame:
    """The points, or an error at run time for an empty id, an empty vector or a wrong dimension."""
    size = F.coalesce(F.size("vector"), F.lit(0))
    fault = F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.lit("empty id")).when(size <= 0, F.concat(F.lit("empty vector of "), F.col("id")))
    fault = fault.when(size != dimension, F.concat(F.lit(f"dimension is not {dimension} in "), F.col("id")))
    return points.withColumn("id", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("id")))


def keep_last(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last row of each key. max_by over a struct combines before the shuffle, so a hot key sends a row a task."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*(F.col(key) if c == key else F.col("last")[c].alias(c) for c in log.columns))


def replay(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "seq"), is_delete: str = "is_delete") -> DataFrame:
    """The state after a change log: the last change of each key, unless it deletes."""
    return keep_last(log, key, order).where(~F.coalesce(F.col(is_delete), F.lit(False)))


def changes_since(log: DataFrame, ts: int) -> DataFrame:
    return log.where(F.col("ts") >= ts).orderBy("ts", "seq")


def upsert(points: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """points with changes laid over them: a changed id is replaced whole. Repeated ids in changes: the last by (ts, seq)."""
    new = keep_last(changes, key).select(*points.columns)
    return points.join(new.select(key), key, "left_anti").unionByName(new)


def delete(points: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """points without ids; ids that aren't there don't matter."""
    return points.join(ids.select(key), key, "left_anti")


def latest_tombstones(tombstones: DataFrame) -> DataFrame:
    return tombstones.groupBy("id").agg(F.max("ts").alias("ts"))


def live_points(segments: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Each id as the newest segment has it, unless a tombstone is at least as new. segments: id, segment, ts, ..."""
    newest = keep_last(segments, "id", ("segment", "ts"))
    dead = latest_tombstones(tombstones).select(F.col("id").alias("dead_id"), F.col("ts").alias("dead_ts"))
    return newest.join(dead, (F.col("id") == F.col("dead_id")) & (F.col("ts") <= F.col("dead_ts")), "left_anti")


def segments_to_search(segments: DataFrame, query: list[float], k: int, metric: str = "cosine", fanout: int = SEARCH_FANOUT, factor: int = EARLY_STOP_FACTOR, per_segment: int = 100) -> DataFrame:
    """segment: those that a search looks into, newest first, until fanout segments and k * factor different ids were
    among the best per_segment of each. segments: id, vector, segment, ..."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    scored = segments.select("segment", "id", V.distance(metric, F.col("vector"), vector).alias("score"))
    best = scored.withColumn("rn", F.row_number().over(Window.partitionBy("segment").orderBy("score", "id"))).where(F.col("rn") <= per_segment)
    first = best.groupBy("id").agg(F.max("segment").alias("segment")).groupBy("segment").agg(F.count(F.lit(1)).alias("new"))
    manifest = segments.select("segment").distinct().join(first, "segment", "left")  # a row for each segment
    back = Window.partitionBy(F.lit(0)).orderBy(F.desc("segment"))
    placed = manifest.select("segment", F.row_number().over(back).alias("place"), F.sum(F.coalesce("new", F.lit(0))).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("found"))
    enough = F.min(F.when((F.col("place") >= fanout) & (F.col("found") >= k * factor), F.col("place"))).over(Window.partitionBy(F.lit(0)))
    return placed.withColumn("last", enough).where("last IS NULL OR place <= last").select("segment")


def search_segments(segments: DataFrame, tombstones: DataFrame, query: list[float], k: int = DEFAULT_K, metric: str = "cosine", **stop) -> DataFrame:
    """The k nearest live points of the segments that segments_to_search gives: each id as the newest of them has it, unless
    a tombstone is at least as new. rank, id, score."""
    chosen = segments.join(segments_to_search(segments, query, k, metric, **stop), "segment", "left_semi")
    return search(live_points(chosen, tombstones), query, k, metric)


def is_deleted(vector: Column) -> Column:
    return F.coalesce(F.size(vector), F.lit(0)) <= 0


def should_seal(vectors: Column, size: Column, created: Column, as_of: datetime) -> Column:
    age = F.lit(as_of).cast("timestamp").cast("double") - created.cast("double")
    return (vectors >= SEAL_VECTORS) | (size >= SEAL_BYTES) | (age >= SEAL_SECONDS)


def should_rebuild(deleted: Column, total: Column) -> Column:
    """Compaction after deletions: 5,000 and 30 % of all at least."""
    return (deleted >= REBUILD_DELETED) & (deleted / F.when(total > 0, total) >= REBUILD_RATIO)


def compaction_inputs(segments: DataFrame, fan_in: int = COMPACT_FAN_IN) -> list[int]:
    """The first fan_in sealed segments in manifest order, or none if there are fewer. segments is a manifest: small."""
    rows = segments.where(F.col("state") == "sealed").orderBy("position").limit(fan_in).collect()
    return [r["segment"] for r in rows] if len(rows) == fan_in else []


def compact(segments: DataFrame, tombstones: DataFrame, inputs: list[int] | None = None) -> DataFrame:
    """One segment out of several (all, if inputs is None): newest rows without the deleted; the others as they are."""
    chosen = segments if inputs is None else segments.where(F.col("segment").isin(inputs))
    return live_points(chosen, tombstones)


def payload_size(id_col: Column, dim: Column, payload: Column) -> Column:
    """A client's estimate of a point's bytes on the wire."""
    text = F.coalesce(F.aggregate(F.map_entries(payload), F.lit(0), lambda s, e: s + F.octet_length(e["key"]) + F.octet_length(e["value"])), F.lit(0))
    return F.octet_length(id_col) + 4 * dim + text + 16


def batches(points: DataFrame, rows: int = 256, size: int = 4 << 20) -> DataFrame:
    """points with batch: numbers of groups of at most rows points and size bytes (payload_size), filled in order within
    each partition alone; a point that is larger by itself has a batch of its own. points: id, vector, payload, ..."""
    from pyspark.sql.pandas.types import to_arrow_schema

    counted = points.withColumn("__size", payload_size(F.col("id"), F.size("vector"), F.col("payload"))).withColumn("batch", F.monotonically_increasing_id())
    fields = to_arrow_schema(counted.drop("__size").schema)

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, filled = None, 0, 0
        for b in parts:
            sizes, first = b.column("__size").to_pylist(), b.column("batch").to_pylist()
            out = []
            for s, i in zip(sizes, first):
                s = s or 0
                if now is None or held == rows or filled + s > size:
                    now, held, filled = i, 0, 0
                held, filled = held + 1, filled + s
                out.append(now)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()) if f.name == "batch" else b.column(f.name) for f in fields], schema=fields)

    return counted.mapInArrow(number, counted.drop("__size").schema)
