
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiverspan.functions import hashing, text
from quiverspan.functions import vector as V


def one(spark, *columns, **values):
    row = spark.range(1).select(*(F.array(*map(F.lit, v)).alias(k) if v else F.array().cast("array<double>").alias(k) for k, v in values.items()))
    return row.select(*columns).first()


def test_distances(spark):
    r = one(spark, V.l2_squared(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("b")), V.dot(F.col("a"), F.col("b")), a=[3.0, 4.0], b=[4.0, 3.0])
    assert r[0] == 2.0 and r[1] == pytest.approx(1 - 24 / 25) and r[2] == 24.0


def test_zero_vectors(spark):
    a = F.col("a")
    r = one(spark, V.cosine_distance(a, F.col("b")), V.normalized_cosine_distance(a, F.col("b")), V.normalize(a), V.norm(a), V.compress(a), a=[0.0, 0.0], b=[1.0, 0.0])
    assert r[0] == 2.0 and r[1] == 1.0 and r[2] == [0.0, 0.0] and r[3] == 0.0 and r[4]["scale"] == 1.0 and r[4]["q"] == [0, 0]


def test_quantize_clamps_and_rounds_half_to_even(spark):
    r = one(spark, V.quantize(F.col("a")), V.quantize(F.col("a"), "trunc"), a=[1.5, -3.0, 0.5 / 127, 1.5 / 127, -1.5 / 127])
    assert r[0] == [127, -127, 0, 2, -2] and r[1] == [127, -127, 0, 1, -1]


def test_compression_round_trip(spark):
    a = [0.5, -2.0, 1.25]
    r = one(spark, V.decompress(V.compress(F.col("a"))), a=a)
    assert all(abs(x - y) <= 2.0 / 127 for x, y in zip(r[0], a))


def test_unknown_metric():
    with pytest.raises(ValueError):
        V.distance("hamming", None, None)


def test_fnv(spark):
    ids = ["", "a", "vec-1-2", "é", "漢字", "x" * 50]
    got = spark.createDataFrame([(i,) for i in ids], "id string").select("id", hashing.fnv1a_64(F.col("id")).cast("string").alias("h")).collect()
    assert {r["id"]: int(r["h"]) for r in got} == {i: hashing.fnv1a(i) for i in ids}
    assert hashing.fnv1a("a") == 0xAF63DC4C8601EC8C


@settings(max_examples=20, deadline=None)
@given(shards=st.integers(1, 64), h=st.integers(0, 2**64 - 1))
def test_ranges_cover_the_space(shards, h):
    bounds = hashing.shard_bounds(shards)
    assert bounds[0][1] == 0 and bounds[-1][2] == 2**64 - 1
    assert all(a[2] + 1 == b[1] for a, b in zip(bounds, bounds[1:]))
    assert sum(a <= h <= b for _, a, b in bounds) == 1


def test_tokenize(spark):
    df = spark.createDataFrame([("The quick brown fox",), ("Python, JavaScript & Go!",), ("",), (None,), ("a an été x2 the",)], "t string")
    got = [r[0] for r in df.select(text.tokenize(F.col("t"))).collect()]
    assert got == [["quick", "brown", "fox"], ["python", "javascript", "go"], [], [], ["x2"]]


def test_timestamps(spark):
    df = spark.createDataFrame([(s,) for s in ("1700000000", "1700000000000", "2023-11-14T22:13:20Z", " 1700000000 ", "x", "", None)], "s string")
    got = [r[0] for r in df.select(text.parse_timestamp(F.col("s")).cast("double")).collect()]
    assert got == [1.7e9, 1.7e9, 1.7e9, 1.7e9, None, None, None]


@pytest.mark.parametrize("pattern,value,hit", [("*", "x", True), ("a*", "abc", True), ("*c", "abc", True), ("a*c", "ac", True), ("ab*bc", "abc", False), ("abc", "abc", True), ("abc", "abcd", False)])
def test_star(spark, pattern, value, hit):
    assert spark.range(1).select(text.matches_star(F.lit(value), pattern)).first()[0] is hit


def test_validators(spark):
    df = spark.createDataFrame([("a@b.co", "Abcdef12", "key 1"), ("a@b", "abcdefgh", " "), ("", "A1!a", "x!"), (None, None, None)], "e string, p string, k string")
    got = [tuple(r) for r in df.select(text.valid_email(F.col("e")), text.valid_password(F.col("p")), text.valid_key_name(F.col("k"))).collect()]
    assert got == [(True, True, True), (False, False, False), (False, False, False), (False, False, False)]
