"""Document fingerprints by content-defined chunking: digests of chunks between gear-hash boundaries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, text_or_empty

#: Bytes of a chunk: least, where the mask loosens, most. Bits of the mask before and after.
LEAST, NORMAL, MOST = 8, 32, 128
STRICT_BITS, LOOSE_BITS = 6, 4

_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)

Fingerprint = dict[int, int]  # digest: length in bytes


def boundaries(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chunks by the loose mask, and whether each meets the strict one too.

    The gear hash of a byte sums the table's values of the last 32 bytes, each shifted by its distance; five doublings
    make it for all bytes at once."""
    h = _GEAR[np.frombuffer(raw, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    at = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
    return at + 1, h[at] < np.uint32(1 << (32 - STRICT_BITS))


def chunk_ends(raw: bytes) -> list[int]:
    """Normalised chunking: up to NORMAL bytes only a strict boundary ends a chunk, then a loose one, at MOST any byte."""
    out, start = [], 0
    for end, strict in zip(*(x.tolist() for x in boundaries(raw))):
        while end - start > MOST:
            start += MOST
            out.append(start)
        size = end - start
        if size >= NORMAL or size >= LEAST and strict:
            out.append(end)
            start = end
    while len(raw) - start > MOST:
        start += MOST
        out.append(start)
    if start < len(raw):
        out.append(len(raw))
    return out


def fingerprint(text: str) -> Fingerprint:
    raw = text.encode("utf-8", "surrogatepass")
    digest, start, out = xxhash.xxh3_64_intdigest, 0, {}
    for end in chunk_ends(raw):
        out[digest(raw[start:end]) & 0xFFFFFFFFFFFF] = end - start
        start = end
    return out


def written(f: Fingerprint) -> str:
    """digest:length by digest, joined by commas; digests of 12 hexadecimal digits."""
    return ",".join([f"{d:012x}:{n}" for d, n in sorted(f.items())])


def read(s: str) -> Fingerprint:
    return {int(d, 16): int(n) for d, n in (x.split(":") for x in s.split(",") if x)}


def containment(a: Fingerprint, b: Fingerprint) -> float:
    """Length of the common chunks over the length of the lighter set: 1 where one text's chunks all lie in the other.
    Of empty texts: 1 with each other, 0 with any other."""
    if not a or not b:
        return float(not a and not b)
    both = sum(a[d] for d in a.keys() & b.keys())
    return both / min(sum(a.values()), sum(b.values()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; null text is empty, and an empty text has the empty fingerprint."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["id"], "fingerprint": [written(fingerprint(t)) for t in b["text"]]}

    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return arrow_map(own, rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str, partitions: int) -> DataFrame:
    """id, text, ahead: each partition holds a range of rows in ascending order of id, then (ahead) the row that comes next.

    Ranges come from a first pass over ids and hashes of texts, by which rows of one id are ordered, so that many rows of
    one id (nulls are the smallest) spread over many ranges. The first row of each range is also sent to the range before,
    that of the first range to the last. So no partition waits for another, and no window runs over the whole table.
    Where a range starts is looked up in a table of one row, first among every so many starts, then among those between."""
    key = F.struct(F.col("id"), F.xxhash64("text").alias("tie"))
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("key", key)
    ranged = own.select("key").repartitionByRange(partitions, "key.id", "key.tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    starts = [tuple(r["key"]) for r in ranged.orderBy("key").collect()]  # one for each partition
    if not starts:
        return own.select("id", "text", F.lit(False).alias("ahead"))
    step = max(1, math.isqrt(len(starts)))
    fine = [starts[i : i + step] for i in range(0, len(starts), step)]
    kind = own.schema["key"].dataType.simpleString()
    table_ = docs.sparkSession.createDataFrame([([x[0] for x in fine], fine)], f"coarse array<{kind}>, fine array<array<{kind}>>")
    placed = own.crossJoin(F.broadcast(table_))  # one row
    block = F.size(F.filter("coarse", lambda e: e <= F.col("key"))) - 1
    placed = placed.withColumn("block", block).withColumn("own", F.element_at("fine", F.col("block") + 1)).drop("coarse", "fine")
    bucket = F.col("block") * step + F.size(F.filter("own", lambda e: e <= F.col("key"))) - 1
    placed = placed.withColumn("first", F.array_contains("own", F.col("key"))).withColumn("bucket", bucket).drop("own", "block")
    here = F.struct(F.col("bucket"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(starts))).alias("bucket"), F.lit(True).alias("ahead"))
    placed = placed.withColumn("place", F.explode(F.when(F.col("first"), F.array(here, before)).otherwise(F.array(here))))
    dealt = placed.select("id", "text", "key", "place.bucket", "place.ahead").repartitionById(len(starts), F.col("bucket"))
    return dealt.sortWithinPartitions("ahead", "key").select("id", "text", "ahead")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """For every row, by ascending id: its fingerprint, that of the text with its last quarter replaced by the start of
    the next row's text (the last row's next is the first), and their likeness.

    Ids may be of any type that has an order; null ids come first. Rows that share an id are ordered by a hash of their
    text, and each is reported. Null text is empty. A table of one row: it is its own next. Empty table: no rows. One
    shuffle of the texts, by ranges of ids; a task holds two texts at a time."""
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def report(b: dict[str, list], key, text: str, own: Fingerprint, after: str, other: Fingerprint) -> None:
        n = len(text)
        k = n // 4
        edited = text[: n - k] + after[:k]
        changed = own if edited == text else fingerprint(edited)
        for name, x in (("doc_id", key), ("n_chars", n), ("edited_sha256", hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()), ("fingerprint", written(own)), ("edited_fingerprint", written(changed)), ("near_edited", containment(own, changed)), ("near_next", containment(own, other))):
            b.setdefault(name, []).append(x)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        last, done = None, False
        for b in batches:
            out: dict[str, list] = {}
            for key, text, ahead in zip(b["id"], b["text"], b["ahead"]):
                if done:
                    break
                f = fingerprint(text)
                if last:
                    report(out, *last, text, f)
                last, done = (key, text, f), ahead  # of several rows ahead, the first counts
            if out:
                yield out

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(in_order_with_next(docs, id_col, text_col, parts).select("id", "text", "ahead"), rows, schema)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """edit_report over documents."""
    return edit_report(table(spark, sf_dir, "documents"))


QUERIES = {"op7_fingerprints": op7_fingerprints}
