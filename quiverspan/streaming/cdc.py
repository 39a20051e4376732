"""Change-data capture with Structured Streaming: snapshot, tail, merge; windows over event time; rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import EWMA_NEW, EWMA_OLD
from ..operators.dml import keep_last, replay
from ..sources.scratch import delete


def read_changes(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Buckets of a merge target: a micro-batch rewrites those that it touches.
BUCKETS = 64


def merge_into(changes: DataFrame, target: str, checkpoint: str, key: str, order: tuple[str, ...] = ("ts", "seq"), buckets: int = BUCKETS):
    """Starts a query that keeps the last change of each key in a table under target, then stops when caught up.

    The table lies in buckets by hash of the key. A batch writes version <batch id> of the buckets that it touches, from
    the version before it, and then drops all but these two. A batch that is run again overwrites its own version, so the
    merge is idempotent. current() reads the newest version of each bucket."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = keep_last(batch, key, order).withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))
        last = last.persist()
        touched = [r["bucket"] for r in last.select("bucket").distinct().collect()]  # buckets at most
        before = {b: v for b, v in newest(spark, target, below=number).items() if b in set(touched)}
        new = last
        if before:
            new = keep_last(_read(spark, target, before, batch.schema, key, buckets).unionByName(last), key, order)
        if touched:
            new.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number}")
            for b, v in ((b, v) for b, versions in _versions(spark, target).items() if b in touched for v in versions if v < before.get(b, -1)):
                delete(spark, f"{target}/version={v}/bucket={b}")
        last.unpersist()

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """For each bucket its versions; only those that were written whole."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for v in fs.listStatus(path) if fs.exists(path) else []:
        if fs.exists(jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")):
            for b in fs.listStatus(v.getPath()):
                if b.getPath().getName().startswith("bucket="):
                    found.setdefault(int(b.getPath().getName()[7:]), []).append(int(v.getPath().getName()[8:]))
    return found


def newest(spark: SparkSession, target: str, below: int | None = None) -> dict[int, int]:
    """The newest version of each bucket, below a number if one is given."""
    fit = {b: [v for v in versions if below is None or v < below] for b, versions in _versions(spark, target).items()}
    return {b: max(versions) for b, versions in fit.items() if versions}


def _read(spark: SparkSession, target: str, at: dict[int, int], schema, key: str, buckets: int) -> DataFrame:
    rows = spark.read.schema(schema).parquet(*(f"{target}/version={v}/bucket={b}" for b, v in sorted(at.items())))
    return rows.withColumn("bucket", F.pmod(F.hash(key), F.lit(buckets)))


def current(spark: SparkSession, target: str, schema, delete_flag: str = "is_delete") -> DataFrame:
    """The live rows."""
    at = newest(spark, target)
    if not at:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*(f"{target}/version={v}/bucket={b}" for b, v in sorted(at.items())))
    return rows.where(~F.coalesce(F.col(delete_flag), F.lit(False)))


def snapshot_and_tail(log: DataFrame, at: int, key: str = "id", order: tuple[str, ...] = ("ts", "seq")) -> tuple[DataFrame, DataFrame]:
    """The state before a time, deletions marked, and the changes from it on. apply_tail() puts the one over the other."""
    return keep_last(log.where(F.col("ts") < at), key, order), log.where(F.col("ts") >= at)


def apply_tail(snapshot: DataFrame, tail: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "seq"), is_delete: str = "is_delete") -> DataFrame:
    """A replica's live rows. A change that the snapshot has already counts once."""
    return replay(snapshot.unionByName(tail), key, order, is_delete)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", key: str = "event_type") -> DataFrame:
    """Counts and sums of tumbling event-time windows, for streams and tables alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "events", "total")


def ewma_stream(samples: DataFrame, key: str, value: str, order: str = "ts") -> DataFrame:
    """key, ewma, samples of a stream: after each micro-batch, the moving averages of the keys that it has, each batch's
    samples in order. A key's state is two numbers."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = samples.schema[key].dataType.simpleString()
    out = f"{key} {kind}, ewma double, samples long"

    def update(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else (0.0, 0)
        for x in pd.concat(list(parts)).sort_values("order", kind="stable")["value"]:
            now, n = (x if n == 0 else EWMA_OLD * now + EWMA_NEW * x), n + 1
        state.update((float(now), int(n)))
        yield pd.DataFrame({key: [k[0]], "ewma": [now], "samples": [n]})

    own = samples.select(key, F.col(order).alias("order"), F.col(value).cast("double").alias("value")).where(F.col(key).isNotNull() & F.col("value").isNotNull())
    return own.groupBy(key).applyInPandasWithState(update, out, "now double, n long", "update", GroupStateTimeout.NoTimeout)


def rate_limit(requests: DataFrame, user: str | list[str], limit: int, count_rejected: bool = True) -> DataFrame:
    """user (and endpoint, for two columns), us, seq, allowed: at most limit calls in a second that starts with the first call
    after the last such second. count_rejected: whether rejected calls use up the second, too; as none is allowed once it
    is used up, this doesn't change what is allowed.

    Each user's calls are walked window by window, with a binary search for the end of each, in batches; a user's state is
    two numbers."""
    names = [user] if isinstance(user, str) else user

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, start, used = None, 0, 0
        for b in batches:
            us, codes = b["us"].to_numpy(), b.groupby(list(b.columns[: len(names)]), sort=False, dropna=False).ngroup().to_numpy()
            allowed = np.zeros(len(b), bool)
            edges = np.flatnonzero(np.diff(codes, prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(b)]):
                this = tuple(b.iloc[lo, : len(names)])
                if this != who:
                    who, start, used = this, us[lo], 0
                at = lo
                while at < hi:
                    end = at + int(np.searchsorted(us[at:hi], start + 1_000_000))
                    allowed[at : min(end, at + max(0, limit - used))] = True
                    used += end - at
                    at = end
                    if at < hi:
                        start, used = us[at], 0
            yield b.assign(allowed=allowed)

    keys = [F.col(c).alias(n) for c, n in zip(names, ("user", "endpoint"))]
    own = requests.select(*keys, "us", F.col("seq").cast("long").alias("seq")).where("user IS NOT NULL")
    by = own.columns[: len(names)]
    dealt = own.repartition(*by).sortWithinPartitions(*by, "us", "seq")
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in by)
    return dealt.mapInPandas(rows, f"{kinds}, us long, seq long, allowed boolean")
