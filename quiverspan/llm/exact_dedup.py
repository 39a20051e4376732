"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, table, text_or_empty

#: Characters under the prefix hash.
PREFIX_CHARS = 128
#: A filter's bits for each key, and at most (64 MB, which are broadcast); bits of one of its rows (fixed in Spark).
BITS_PER_KEY, MAX_BITS, ROW_BITS = 16, 1 << 29, 1 << 15


class Filter:
    """A one-hash Bloom filter as rows of bitmaps: built by an aggregate, broadcast, tested within the scan.

    It has no false negatives. Beyond MAX_BITS / BITS_PER_KEY keys it gets dense and passes more rows than it need, so
    what follows must not rely on it: its size is bounded, and results don't change."""

    def __init__(self, keys: DataFrame, hashed: Column, scratch: Scratch):
        self.bits = min(MAX_BITS, max(ROW_BITS, 1 << (BITS_PER_KEY * max(1, keys.count()) - 1).bit_length()))
        bits = keys.select(*self._place(hashed)).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__bitmap"))
        self.rows = scratch.write(bits, "filter")

    def _place(self, hashed: Column) -> tuple[Column, Column]:
        at = F.pmod(hashed, F.lit(self.bits).cast("long"))
        return F.shiftright(at, 15).alias("__row"), at.bitwiseAND(F.lit(ROW_BITS - 1).cast("long")).alias("__bit")

    def test(self, df: DataFrame, hashed: Column, name: str = "__maybe") -> DataFrame:
        """df with a flag: False only where no key has that hash."""
        row, bit = self._place(hashed)
        joined = df.withColumns({"__r": row, "__b": bit}).join(F.broadcast(self.rows), F.col("__r") == F.col("__row"), "left")
        byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (F.shiftright("__b", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return joined.withColumn(name, F.coalesce(F.getbit(byte, (F.col("__b") % 8).cast("int")) == 1, F.lit(False))).drop("__r", "__b", "__row", "__bit", "__bitmap")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Groups of equal texts (A-Z lower-cased; null is empty) of two rows or more: id, n (bytes of the text), text_sha256,
    keep_id, group_size, times.

    One row per distinct (id, text) of such a group, which occurs times; a text that no other row has isn't listed. The
    largest id of a group is keep_id (null only if all are null); group_size counts rows, repeated ones too. Empty
    table: no rows. Other columns of docs are ignored.

    The first scan emits lengths and prefix hashes, a few bytes a row. Those that occur twice, by length, then by length
    and prefix hash, go into a filter of bounded size, which is broadcast. The second scan hashes the full content of the
    rows that pass it, and only digests are exchanged; a row that passes for nothing is alone in its group and goes.
    Aggregates combine before they shuffle, and the joins are plain equi-joins, which AQE broadcasts below its checked
    threshold and splits where a key is hot.
    """
    scratch = Scratch(docs.sparkSession)
    text = text_or_empty(text_col)
    n, head = F.octet_length(text), F.xxhash64(ascii_lower(F.substring(text, 1, prefix_chars)))
    narrow = scratch.write(docs.select(n.alias("n"), head.alias("head")), "narrow")
    lengths = scratch.write(narrow.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("n"), "lengths")
    heads = narrow.join(lengths, "n", "left_semi").groupBy("n", "head").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    heads = scratch.write(heads.select("n", "head"), "heads")
    alive = Filter(heads, F.xxhash64("n", "head"), scratch).test(docs.select(F.col(id_col).alias("id"), text.alias("text")), F.xxhash64(F.octet_length("text"), F.xxhash64(ascii_lower(F.substring("text", 1, prefix_chars)))))
    full = scratch.write(alive.where("__maybe").select("id", F.octet_length("text").alias("n"), F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256")), "full")
    groups = full.groupBy("n", "text_sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = scratch.write(groups, "groups")
    scratch.keep(full, groups)
    return full.groupBy("id", "n", "text_sha256").agg(F.count(F.lit(1)).alias("times")).join(groups, ["n", "text_sha256"]).select("id", "n", "text_sha256", "keep_id", "group_size", "times")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Every row's decision: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text in UTF-8).

    Rows that repeat both id and text are one document written twice: they share one decision. A null id is a value
    like any other, smaller than all. Empty table: no rows. What is exchanged are ids and digests, no texts."""
    found = exact_groups(docs, id_col, text_col, prefix_chars).select(F.col("id").alias("found_id"), F.col("text_sha256").alias("found_sha"), "keep_id", "group_size")
    all_rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(ascii_lower(text_or_empty(text_col)), 256).alias("text_sha256"))
    joined = all_rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_sha256") == F.col("found_sha")), "left")
    keep = F.when(F.col("found_sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns as they were; of repeated (id, text) rows one stays.
    Null text is empty, a null id a value smaller than all; empty table: no rows.

    Rows that no dropped or repeated row can equal, by a broadcast filter of bounded size, stay where they are. The
    others, few but those to drop, are hashed and joined."""
    scratch = Scratch(docs.sparkSession)
    found = exact_groups(docs, id_col, text_col)
    goes = ~F.col("id").eqNullSafe(F.col("keep_id"))
    touched = scratch.write(found.where(goes | (F.col("times") > 1)).select(F.col("id").alias("__id"), F.col("n").alias("__n"), F.col("text_sha256").alias("__found"), goes.alias("__goes")), "touched")
    names, text = docs.columns, text_or_empty(text_col)
    tested = Filter(touched, F.xxhash64("__id", "__n"), scratch).test(docs, F.xxhash64(F.col(id_col), F.octet_length(text)))
    some = tested.where("__maybe").withColumn("__sha", F.sha2(ascii_lower(text), 256))
    joined = some.join(touched, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__found")), "left")
    out = tested.where("NOT __maybe").select(*names).unionAll(joined.where("__goes IS NULL").select(*names))
    if touched.where("NOT __goes").isEmpty():
        return out
    return out.unionAll(joined.where("NOT __goes").dropDuplicates([id_col, "__sha"]).select(*names))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """exact_dedup over documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
