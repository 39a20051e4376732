"""Collections: metadata, and points in segments of changes, each written once and partitioned by shard."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .. import schema
from ..functions.hashing import fnv1a, fnv1a_64, shard_bounds, shard_of
from ..functions.vector import METRICS
from ..operators import dml, ivf
from ..operators import rerank as R
from ..operators import search as S
from .scratch import delete

SHARDS = 16
_PLACED = StructType([*schema.CHANGE.fields, StructField("shard", IntegerType())])
_STORED = StructType([*_PLACED.fields, StructField("segment", LongType())])


class AlreadyExists(ValueError):
    pass


class NotFound(KeyError):
    pass


class Store:
    """Collections under one folder of any Spark-readable store: for each a file of metadata, segments, and manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def create(self, name: str, dimension: int, distance: str = "euclidean", shards: int = SHARDS) -> Collection:
        if not name or dimension <= 0:
            raise ValueError("a collection needs a name and a positive dimension")
        if distance not in METRICS:
            raise ValueError(f"unknown metric {distance!r}; one of {METRICS}")
        fs, path = self._path(name)
        if fs.exists(path):
            raise AlreadyExists(name)
        meta = {"name": name, "dimension": dimension, "distance": distance, "shards": shards}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{self.root}/{name}/meta")
        return Collection(self, **meta)

    def names(self, path: str) -> list[str]:
        fs, at = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def list(self) -> list[str]:
        return self.names("")

    def open(self, name: str) -> Collection:
        try:
            return Collection(self, **json.loads(self.spark.read.text(f"{self.root}/{name}/meta").first()["value"]))
        except AnalysisException as e:
            raise NotFound(name) from e

    def drop(self, name: str) -> None:
        fs, path = self._path(name)
        if not fs.exists(path):
            raise NotFound(name)
        fs.delete(path, True)


class Collection:
    """Points of a collection. Each write makes a sealed segment, and a manifest that lists all live ones; a reader takes the
    newest manifest, so it sees whole writes only. One writer at a time."""

    def __init__(self, store: Store, name: str, dimension: int, distance: str, shards: int):
        self.store, self.name, self.dimension, self.distance, self.shards = store, name, dimension, distance, shards
        self.path = f"{store.root}/{name}"

    # Segments ------------------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        fs, _ = self.store._path(self.name)
        whole = lambda v: fs.exists(self.store._path(f"{self.name}/manifest/{v}/_SUCCESS")[1])
        return sorted(int(v) for v in self.store.names(f"{self.name}/manifest") if whole(v))

    def _live(self) -> list[dict]:
        """The segments of the newest manifest, oldest first; a manifest is as long as there are segments."""
        if not (versions := self._versions()):
            return []
        rows = self.store.spark.read.schema(schema.SEGMENT).json(f"{self.path}/manifest/{versions[-1]}").orderBy("segment").collect()
        return [r.asDict() for r in rows]

    def _commit(self, segments: list[dict]) -> None:
        at = max(self._versions(), default=0) + 1
        self.store.spark.createDataFrame([tuple(s[f.name] for f in schema.SEGMENT) for s in segments], schema.SEGMENT).coalesce(1).write.json(f"{self.path}/manifest/{at}")

    def segments(self) -> DataFrame:
        """The manifest: segment, state, vectors, bytes, created_at, position."""
        return self.store.spark.createDataFrame([tuple(s[f.name] for f in schema.SEGMENT) for s in self._live()], schema.SEGMENT)

    def _read(self, segments: list[dict]) -> DataFrame:
        paths = [f"{self.path}/segments/segment={s['segment']}" for s in segments if s["vectors"]]
        spark = self.store.spark
        if not paths:
            return spark.createDataFrame([], _PLACED)
        return spark.read.option("basePath", f"{self.path}/segments").schema(_STORED).parquet(*paths).select(*_PLACED.names)

    def _write(self, changes: DataFrame) -> dict:
        """Writes one segment. Rows are dealt by shard; the rebalance hint splits large shards and joins small ones."""
        number = 1 + max((int(n.removeprefix("segment=")) for n in self.store.names(f"{self.name}/segments")), default=0)
        own = f"segments/segment={number}"
        placed = changes.withColumn("shard", shard_of(fnv1a_64(F.col("id")), self.shards)).select(*_PLACED.names)
        placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{self.path}/{own}")
        fs, path = self.store._path(f"{self.name}/{own}")
        made = {"segment": number, "state": "sealed", "vectors": 1, "bytes": fs.getContentSummary(path).getLength(), "created_at": datetime.now(), "position": number}
        some = any(n.startswith("shard=") for n in self.store.names(f"{self.name}/{own}"))
        return made | {"vectors": self._read([made]).count() if some else 0}  # counts come from the files' footers

    def _append(self, changes: DataFrame) -> int:
        made = self._write(changes)
        self._commit([*self._live(), made])
        return made["vectors"]

    def compact(self, fan_in: int | None = dml.COMPACT_FAN_IN) -> int:
        """Merges the first fan_in segments (None: all) into one with the newest change of each id; returns how many were
        merged, 0 if there are fewer. Deletions go only when all segments are merged. Merged segments stay on disk until
        vacuum()."""
        live = self._live()
        if fan_in is not None and len(live) < fan_in or len(live) < 2:
            return 0
        chosen = live if fan_in is None else live[:fan_in]
        state = (dml.replay if len(chosen) == len(live) else dml.keep_last)(self._read(chosen).drop("shard"))
        made = self._write(state.select(*schema.CHANGE.names)) | {"position": chosen[-1]["position"]}
        self._commit([made, *live[len(chosen) :]])
        return len(chosen)

    def vacuum(self) -> int:
        """Deletes segments and manifests that the newest manifest doesn't need; returns how many segments went."""
        keep, versions = {f"segment={s['segment']}" for s in self._live()}, self._versions()
        gone = [n for n in self.store.names(f"{self.name}/segments") if n not in keep]
        for path in [*(f"segments/{n}" for n in gone), *(f"manifest/{v}" for v in versions[:-1])]:
            delete(self.store.spark, f"{self.path}/{path}")
        return len(gone)

    # Points --------------------------------------------------------------------------------------

    def upsert(self, points: DataFrame, ts: int) -> int:
        """Writes points (id, vector, payload) as changes at ts; returns their number, repeated ids counted. Rows with a
        null id are left out. points is read once."""
        rows = points.where("id IS NOT NULL").select("id", F.col("vector").cast("array<float>").alias("vector"), "payload", F.lit(False).alias("is_delete"), F.lit(ts).cast("long").alias("ts"), F.monotonically_increasing_id().alias("seq"))
        return self._append(dml.validate_points(rows, self.dimension))

    def upsert_stream(self, points: DataFrame, checkpoint: str):
        """Upserts a stream of points (id, vector, payload, ts), a segment for each micro-batch. A batch that runs again
        after a failure writes the same changes again, which replay the same."""

        def store(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                own = batch.where("id IS NOT NULL").select("id", F.col("vector").cast("array<float>").alias("vector"), "payload", F.lit(False).alias("is_delete"), F.col("ts").cast("long").alias("ts"), F.monotonically_increasing_id().alias("seq"))
                self._append(dml.validate_points(own, self.dimension))

        return points.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def delete(self, ids: list[str], ts: int) -> None:
        """Ids that aren't there don't matter."""
        self._append(self.store.spark.createDataFrame([(i, None, None, True, ts, n) for n, i in enumerate(ids)], schema.CHANGE))

    def changes(self, since: int | None = None) -> DataFrame:
        """All changes, or those from a time on, the tail behind a snapshot."""
        log = self._read(self._live()).drop("shard")
        return log if since is None else log.where(F.col("ts") >= since)

    def points(self) -> DataFrame:
        return dml.replay(self._read(self._live())).select("id", "vector", "payload")

    def get(self, id_: str) -> dict | None:
        """One point: the shard filter prunes directories, the id filter reaches the Parquet scan."""
        shard = min(self.shards - 1, fnv1a(id_) // ((1 << 64) // self.shards))
        row = dml.replay(self._read(self._live()).where((F.col("shard") == shard) & (F.col("id") == id_))).first()
        return {k: row[k] for k in schema.POINT.names} if row else None

    def search(self, query: list[float], k: int = S.DEFAULT_K, include_vectors: bool = False, include_metadata: bool = True) -> DataFrame:
        """The k nearest: rank, id, score, and what is included. The segments are replayed once: payload and vector go
        along with the k best rows that each task keeps."""
        self._fits(query)
        wanted = [*(["vector"] if include_vectors else []), *(["payload"] if include_metadata else [])]
        return S.search(self.points(), query, k, self.distance, carry=wanted)

    def search_batch(self, queries: DataFrame, k: int = S.DEFAULT_K) -> DataFrame:
        return S.search_batch(self.points(), queries, k, self.distance)

    def search_rerank(self, query: list[float], text: str = "", k: int = S.DEFAULT_K, strategy: str = "rule", **options) -> DataFrame:
        """A search whose hits are reranked by a text query (operators.rerank.search_rerank)."""
        self._fits(query)
        return R.search_rerank(self.points(), query, text, k, self.distance, strategy, **options)

    def _fits(self, query: list[float]) -> None:
        if len(query) != self.dimension:
            raise ValueError(f"dimension {len(query)}; the collection has {self.dimension}")

    def build_index(self, **options) -> None:
        """Fits, writes and keeps an approximate index of the points as they are; a later one replaces it."""
        points = self.points().select("id", "vector")
        cells = ivf.fit(points, **options)
        ivf.save(ivf.index(points, cells), cells, f"{self.path}/index")
        self.store.spark.createDataFrame([(json.dumps([s["segment"] for s in self._live()]),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/index/of")

    def search_index(self, queries: DataFrame, k: int = S.DEFAULT_K, ef: int | None = None) -> DataFrame:
        """Approximate: from the index, and exactly from what was written since; changed and deleted ids count as they
        are now. ef: candidates that each query examines at least (default: search.effective_ef)."""
        spark = self.store.spark
        indexed, cells = ivf.load(spark, f"{self.path}/index")
        known = set(json.loads(spark.read.text(f"{self.path}/index/of").first()["value"]))
        ef = S.effective_ef(k, self.dimension) if ef is None else max(ef, k)
        newer = self._read([s for s in self._live() if s["segment"] not in known])
        hits = ivf.search(indexed.join(newer.select("id").distinct(), "id", "left_anti"), queries, cells, k, ef=ef)
        fresh = S.search_batch(dml.replay(newer).select("id", "vector"), queries, k, "cosine")
        return S.merge_hits(hits, fresh, k=k)

    def needs_index(self, deleted: int) -> bool:
        """Whether so many deletions since the index call for a new one."""
        total = self.points().count() + deleted
        return deleted >= dml.REBUILD_DELETED and deleted >= dml.REBUILD_RATIO * total

    def status(self) -> DataFrame:
        counts = self.points().groupBy(shard_of(fnv1a_64(F.col("id")), self.shards).alias("shard")).agg(F.count(F.lit(1)).alias("points"))
        ranges = self.store.spark.createDataFrame([(i, str(a), str(b)) for i, a, b in shard_bounds(self.shards)], "shard int, range_start string, range_end string")
        return ranges.join(counts, "shard", "left").select("shard", "range_start", "range_end", F.coalesce("points", F.lit(0)).alias("points"))

    def backup(self, path: str) -> None:
        self.points().write.mode("overwrite").parquet(path)

    def restore(self, path: str, ts: int) -> None:
        """Replaces all by a backup, in one step: a manifest that lists its segment alone."""
        kept = self.store.spark.read.schema(schema.POINT).parquet(path)
        rows = kept.select("*", F.lit(False).alias("is_delete"), F.lit(ts).cast("long").alias("ts"), F.monotonically_increasing_id().alias("seq"))
        self._commit([self._write(dml.validate_points(rows, self.dimension))])


# --- key-value tables and codecs ------------------------------------------------------------------


def get(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def exists_batch(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """keys with found: whether the table has each."""
    return keys.join(table.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def prefix_scan(table: DataFrame, key: str, prefix: str, limit: int = 0) -> DataFrame:
    """Rows whose key starts with prefix, in order of key; a limit of 0 or less means all."""
    found = table.where(F.col(key).startswith(prefix)).orderBy(key)
    return found.limit(limit) if limit > 0 else found


def entry_count(table: DataFrame, key: str, prefix: str) -> DataFrame:
    return table.where(F.col(key).startswith(prefix)).agg(F.count(F.lit(1)).alias("entries"))


def iterate(table: DataFrame, key: str, prefix: str, visit: Callable[..., bool]) -> int:
    """Calls visit with each row whose key starts with prefix, in order of key, until it returns False; how many it saw.
    Rows come a partition at a time."""
    seen = 0
    for row in prefix_scan(table, key, prefix).toLocalIterator():
        seen += 1
        if visit(row) is False:
            break
    return seen


def rows_until(table: DataFrame, key: str, stop: Column) -> DataFrame:
    """The rows before the first, in order of key, for which stop holds: an iteration that stops early, as a filter."""
    first = table.agg(F.min(F.when(stop, F.col(key))).alias("__stop"))
    return table.crossJoin(F.broadcast(first)).where(F.col("__stop").isNull() | (F.col(key) < F.col("__stop"))).drop("__stop")  # one row


def apply_batch(table: DataFrame, operations: DataFrame) -> DataFrame:
    """A key-value table (key, value) after puts and deletes (key, value, is_delete, seq): the last of each key counts."""
    last = dml.keep_last(operations, "key", ("seq",))
    kept = table.select("key", "value").join(last.select("key"), "key", "left_anti")
    return kept.unionByName(last.where("NOT is_delete").select("key", "value"))


def put(table: DataFrame, key, value) -> DataFrame:
    return apply_batch(table, _operation(table, key, value, False))


def remove(table: DataFrame, key) -> DataFrame:
    return apply_batch(table, _operation(table, key, None, True))


def _operation(table: DataFrame, key, value, is_delete: bool) -> DataFrame:
    kinds = {n: table.schema[n].dataType.simpleString() for n in ("key", "value")}
    return table.sparkSession.createDataFrame([(key, value, is_delete, 0)], f"key {kinds['key']}, value {kinds['value']}, is_delete boolean, seq int")


def encode_payload(payload: Column) -> Column:
    """JSON of a map; null for an empty one."""
    return F.when(F.size(payload) > 0, F.to_json(payload))


def decode_payload(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


# Fixed value: the highest bit of a vector's length marks 8-bit codes.
COMPRESSED = 1 << 31


def encode_vector(v: Column, metadata: Column | None = None, compress: bool = False) -> Column:
    """Length (32 bits), float32 components, then the bytes of metadata, if any; little-endian. compress: a length with
    COMPRESSED, the largest magnitude as float32, and components over it times 127 as signed bytes. Null: null."""
    import numpy as np
    import pyarrow as pa

    def raw(x: list, more: bytes | None) -> bytes:
        floats = np.array(x, "<f4")
        head = np.array([len(x) | (COMPRESSED if compress else 0)], "<u4").tobytes()
        if not compress:
            return head + floats.tobytes() + (more or b"")
        scale = np.abs(floats).max(initial=0) or np.float32(1)
        scaled = floats.astype(np.float64) * (127.0 / np.float64(scale))
        codes = np.clip(np.trunc(scaled + np.copysign(0.5, scaled)), -127, 127).astype(np.int8)
        return head + np.array([scale], "<f4").tobytes() + codes.tobytes() + (more or b"")

    pack = lambda vs, ms: pa.array([None if x is None else raw(x, m) for x, m in zip(vs.to_pylist(), ms.to_pylist())], pa.binary())
    return F.arrow_udf(pack, "binary")(v, F.lit(None).cast("binary") if metadata is None else metadata)


def decode_vector(b: Column) -> Column:
    """struct(vector, metadata) of encode_vector's bytes. Empty bytes, which mark a deleted point, and null: null."""
    import numpy as np
    import pyarrow as pa

    kind = pa.struct([("vector", pa.list_(pa.float32())), ("metadata", pa.binary())])

    def parts(x: bytes | None):
        if not x:
            return None
        if len(x) < 4:
            raise ValueError("too short for a length")
        length = int(np.frombuffer(x, "<u4", 1)[0])
        n, packed = length & ~COMPRESSED, bool(length & COMPRESSED)
        end = 8 + n if packed else 4 + 4 * n
        if len(x) < end:
            raise ValueError("too short for its length")
        v = np.frombuffer(x, np.int8, n, 8).astype(np.float32) * (np.frombuffer(x, "<f4", 1, 4)[0] / np.float32(127)) if packed else np.frombuffer(x, "<f4", n, 4)
        return {"vector": v.tolist(), "metadata": x[end:] or None}

    return F.arrow_udf(lambda batch: pa.array([parts(x) for x in batch.to_pylist()], kind), "struct<vector:array<float>,metadata:binary>")(b)
