"""What the operators of this subpackage share: tables, scratch space, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch that are Python objects at a time; Spark bounds the bytes of a batch.
BATCH_ROWS = 256
#: Arrow batches between the JVM and Python while a table of our own is written.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; all-ASCII texts take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(column: str = "doc_id") -> Column:
    """True for the fifth of the rows from which nothing may be learnt (a null id: False)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    conf = spark.conf
    before = {k: conf.get(k) for k in SMALL_BATCHES}
    try:
        for k, v in SMALL_BATCHES.items():
            conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            conf.set(k, v)


# --- scratch tables in the folder that driver and executors share ---------------------------------


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own, but only with a local master: on a
    cluster the executors couldn't read it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        sc.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Parquet tables of one operator call. Written once, so lineage is cut and a lost executor costs a reread.

    drop() frees a table that no later plan reads; the rest goes when the driver's process ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
        self.paths: set[str] = set()
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str, compression: str = "zstd", by: list[str] = []) -> DataFrame:
        """by: columns, of few values, whose filters then prune files. Arrow batches are small while it is written."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with small_batches(self.spark):
            df.write.partitionBy(*by).option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        for path in {t._scratch_path for t in tables} & self.paths:
            self.paths.remove(path)
            self._delete(path)

    def keep(self, *tables: DataFrame) -> None:
        """Drops all other tables."""
        for path in self.paths - {t._scratch_path for t in tables}:
            self.paths.remove(path)
            self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session is gone; the folder's owner clears it
            pass


# --- Arrow maps -----------------------------------------------------------------------------------


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as Spark cuts them (by rows and bytes) in slices of BATCH_ROWS, so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def arrow_map(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists (or Arrow arrays, or NumPy) on either side."""
    fields = T.StructType.fromDDL(schema)
    types = _arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ({name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)} for b in pieces(batches))
        for out in rows(lists):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip((out[f.name] for f in types), types.types)], schema=types)

    return df.mapInArrow(run, fields)


def arrow_column(column: Column, value: Callable[[], Callable], kind: str, arrow: pa.DataType) -> Column:
    """A column from another, value by value; value() is made once for each task."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = value()
        for b in batches:
            parts = [pa.array([f(x) for x in b.slice(at, BATCH_ROWS).to_pylist()], arrow) for at in range(0, len(b), BATCH_ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(column)


def _arrow_schema(fields: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)
