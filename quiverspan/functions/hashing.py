"""FNV-1a-64 of ids and equal key ranges over it, as DECIMAL(20,0) expressions (there is no unsigned long)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of FNV-1a-64.
OFFSET, PRIME, SPACE = 14695981039346656037, 1099511628211, 1 << 64


def fnv1a(s: str) -> int:
    h = OFFSET
    for b in s.encode():
        h = (h ^ b) * PRIME % SPACE
    return h


def fnv1a_64(c: Column) -> Column:
    """By bytes of UTF-8; DECIMAL(20,0). The xor only touches the last byte, so it is done on that alone."""
    wide = "decimal(38,0)"
    digits = F.hex(F.encode(c, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))

    def step(h: Column, b: Column) -> Column:
        low = (h % 256).cast("int")
        mixed = (h - low.cast(wide) + low.bitwiseXOR(b).cast(wide)).cast("decimal(20,0)")
        return ((mixed * F.lit(Decimal(PRIME)).cast("decimal(14,0)")).cast(wide) % F.lit(Decimal(SPACE)).cast(wide)).cast(wide)

    start = F.lit(Decimal(OFFSET)).cast(wide)
    return F.when(F.octet_length(c) == 0, start).otherwise(F.aggregate(octets, start, step)).cast("decimal(20,0)")


def shard_bounds(shards: int) -> list[tuple[int, int, int]]:
    """(shard, start, end) of equal ranges; the last ends at 2^64 - 1."""
    if shards < 1:
        raise ValueError("at least one shard")
    width = SPACE // shards
    return [(i, i * width, SPACE - 1 if i == shards - 1 else (i + 1) * width - 1) for i in range(shards)]


def shard_of(h: Column, shards: int) -> Column:
    """The range a hash falls in, by division: an equi-key instead of a range join."""
    width = F.lit(Decimal(SPACE // shards)).cast("decimal(20,0)")
    return F.least(F.floor(h / width).cast("int"), F.lit(shards - 1))


def shard_ranges(spark: SparkSession, shards: int) -> DataFrame:
    rows = [(i, Decimal(a), Decimal(b)) for i, a, b in shard_bounds(shards)]
    return spark.createDataFrame(rows, "shard int, range_start decimal(20,0), range_end decimal(20,0)")
