import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quiverspan.operators import cluster as C
from quiverspan.operators import dml, feedback
from quiverspan.operators import rerank as R
from quiverspan.sources import collection as K
from quiverspan.sources.collection import AlreadyExists, NotFound, Store
from quiverspan.streaming import cdc

LOG = "id string, value int, ts long, seq long, is_delete boolean"


def test_last_write_wins_under_any_order(spark):
    rows = [("a", 1, 1, 0, False), ("a", 2, 2, 0, False), ("a", 3, 2, 1, False), ("b", 1, 1, 0, False), ("b", None, 3, 0, True), ("c", None, 1, 0, True), ("c", 9, 2, 0, False)]
    for order in (rows, rows[::-1]):
        got = dml.replay(spark.createDataFrame(order, LOG)).collect()
        assert {(r["id"], r["value"]) for r in got} == {("a", 3), ("c", 9)}


def test_upsert_is_idempotent(spark):
    p = spark.createDataFrame([("a", 1), ("b", 2)], "id string, value int")
    c = spark.createDataFrame([("b", 5, 1, 0), ("b", 6, 1, 1), ("d", 7, 1, 0)], "id string, value int, ts long, seq long")
    once = dml.upsert(p, c)
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in dml.upsert(once, c).collect()} == {("a", 1), ("b", 6), ("d", 7)}


@pytest.mark.parametrize("row", [("", [1.0, 2.0]), ("a", []), ("a", [1.0]), (None, [1.0, 2.0])])
def test_bad_points(spark, row):
    with pytest.raises(Exception, match="empty|dimension"):
        dml.validate_points(spark.createDataFrame([row], "id string, vector array<float>"), 2).collect()


def test_policies(spark):
    df = spark.createDataFrame([(100_000, 0, 0), (0, 512 << 20, 0), (0, 0, 600), (1, 1, 1)], "v long, b long, age long")
    now = datetime(2024, 1, 1)
    created = F.timestamp_seconds(F.lit(int(1704067200)) - F.col("age"))
    assert [r[0] for r in df.select(dml.should_seal(F.col("v"), F.col("b"), created, now)).collect()] == [True, True, True, False]
    s = spark.createDataFrame([(n, "sealed" if n else "mutable", n) for n in range(5)], "segment int, state string, position int")
    assert dml.compaction_inputs(s) == [1, 2, 3, 4] and dml.compaction_inputs(s.where("segment < 4")) == []


def test_feedback_golden(spark):
    s = spark.createDataFrame([("s1", "test_collection", "machine learning tutorial", datetime(2024, 1, 1))], "id string, collection string, query string, created_at timestamp")
    i = spark.createDataFrame([("s1", "doc1", 5, True, 0), ("s1", "doc2", 3, False, 1)], "session_id string, result_id string, relevance_score int, clicked boolean, position int")
    r = feedback.stats(s, i).first()
    assert (r["avg_relevance"], r["ctr"], r["total_feedback"], r["total_sessions"]) == (4.0, 0.5, 2, 1)
    assert [x["result_id"] for x in feedback.by_collection(s, i, "test_collection").first()["items"]] == ["doc1", "doc2"]
    with pytest.raises(Exception, match="1 to 5"):
        feedback.validate_items(i.withColumn("relevance_score", F.lit(6))).collect()


def candidates(spark, query, rows):
    return spark.createDataFrame([(1, query, i, s, m) for i, s, m in rows], "qid int, query string, id string, score double, payload map<string,string>")


def test_rerank_exact_match_and_metadata(spark):
    c = candidates(spark, "python programming", [("doc1", 0.5, {"title": "Python programming guide"}), ("doc2", 0.6, {"title": "Cooking"})])
    got = R.rerank(c, 2).orderBy("rank").collect()
    assert got[0]["id"] == "doc1" and got[0]["explanation"] == "exact match, title match, +2 tokens" and got[1]["explanation"] == "keyword relevance"
    c = candidates(spark, "topic", [("doc1", 0.5, {"verified": "true", "title": "topic"}), ("doc2", 0.6, {"title": "topic"})])
    assert R.rerank(c, 1, config=R.RuleConfig(boosts={"verified": 0.3})).first()["id"] == "doc1"
    c = candidates(spark, "topic", [("doc1", 0.9, {"deprecated": "1"})])
    assert R.rerank(c, 1, config=R.RuleConfig(penalties={"deprecated": 0.5})).first()["rerank_score"] < 0.9


def test_rerank_empty_query_and_validation(spark):
    c = candidates(spark, "the of", [("a", 0.1, {}), ("b", 0.9, {}), ("c", 0.9, {})])
    assert [(r["id"], r["explanation"]) for r in R.rerank(c, 3).orderBy("rank").collect()][0] == ("b", "sorted by original score")
    with pytest.raises(ValueError):
        R.rerank(c, 0)
    with pytest.raises(Exception, match="blank id"):
        R.rerank(candidates(spark, "x", [(" ", 0.5, {})]), 1).collect()
    assert R.parse_pairs("a:1, b:0.5") == {"a": 1.0, "b": 0.5}


def test_recency(spark):
    now = datetime(2024, 1, 31)
    df = spark.createDataFrame([("1706659200",), ("1706054400",), ("1700000000",), ("x",), (None,)], "s string")
    got = [round(r[0], 4) for r in df.select(R.recency(F.col("s"), now)).collect()]
    assert got == [1.0, 0.5001, 0.0, 0.0, 0.0]


def test_ewma_keeps_order(spark):
    df = spark.createDataFrame([("w", 1, 10.0), ("w", 3, 0.0), ("w", 2, 20.0), ("v", 1, 5.0)], "k string, t int, x double")
    assert {r["k"]: r["ewma"] for r in C.ewma(df, "k", "x", ["t"]).collect()} == {"w": pytest.approx((10 * 0.7 + 20 * 0.3) * 0.7), "v": 5.0}


def test_ewma_of_a_hot_key_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [("hot", t, rng.random()) for t in range(3000)] + [("cold", t, rng.random()) for t in range(5)] + [(None, 1, 1.0), ("hot", 9999, None)]
    got = {r["k"]: (r["ewma"], r["samples"]) for r in C.ewma(spark.createDataFrame(rows, "k string, t int, x double").repartition(7), "k", "x", ["t"]).collect()}
    for k, n in (("hot", 3000), ("cold", 5)):
        xs = [x for key, _, x in rows if key == k and x is not None]
        e = xs[0]
        for x in xs[1:]:
            e = 0.7 * e + 0.3 * x
        assert got[k] == (pytest.approx(e), n)
    assert len(got) == 2


def test_streamed_ewma_ends_like_the_table(spark, tmp_path):
    rows = [(k, t, float((t * 7 + len(k)) % 11)) for t in range(40) for k in ("a", "bb") if (t + len(k)) % 3]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    for n in range(4):
        df.where(F.col("t").between(10 * n, 10 * n + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read by age
    stream = cdc.ewma_stream(cdc.read_changes(spark, str(tmp_path / "in"), df.schema, 1), "k", "x", "t")
    q = stream.writeStream.format("memory").queryName("averages").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r["k"]: (r["e"], r["samples"]) for r in spark.table("averages").groupBy("k").agg(F.max_by("ewma", "samples").alias("e"), F.max("samples").alias("samples")).collect()}
    assert last == {r["k"]: (pytest.approx(r["ewma"]), r["samples"]) for r in C.ewma(df, "k", "x", ["t"]).collect()}


def test_percentiles_of_a_hot_key(spark):
    rng = random.Random(4)
    values = [round(rng.expovariate(1), 3) for _ in range(5000)] + [7.0] * 2000 + [1e12]
    df = spark.createDataFrame([("hot", v) for v in values] + [("one", 3.0)], "k string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    for accuracy in (100, 10_000):
        got = {r["k"]: r for r in C.latency_percentiles(df, "k", "v", shares, accuracy).collect()}
        ordered = sorted(values)
        assert [got["hot"][n] for n in shares] == [ordered[min(len(ordered) - 1, int(len(ordered) * p))] for p in shares.values()]
        assert [got["one"][n] for n in shares] == [3.0] * 5


NOW = datetime(2024, 1, 1)


def cluster_workers(spark, rows):
    """(worker, state, capacity, seconds since its heartbeat)"""
    return spark.createDataFrame([(w, s, c, "data", NOW - timedelta(seconds=age)) for w, s, c, age in rows], "worker string, state string, capacity long, role string, heartbeat timestamp")


def cluster_shards(spark, rows):
    """(shard, replicas, qps)"""
    return spark.createDataFrame([(i, r, r[0], q, 1.0, 1) for i, r, q in rows], "shard int, replicas array<string>, leader string, qps double, latency_ms double, epoch long")


def test_rebalance_drains_first_and_only_to_healthy_workers(spark):
    shards = cluster_shards(spark, [(i, ["w1", "w2"], 1.0) for i in range(4)])
    workers = cluster_workers(spark, [("w1", "draining", 100, 1), ("w2", "ready", 100, 1), ("w3", "ready", 100, 1), ("w4", "joining", 100, 1), ("w5", "ready", 100, 60)])
    assert C.rebalance_plan(shards, workers, NOW) == [(i, "w1", "w3", "drain") for i in range(4)]
    assert C.rebalance_plan(shards, workers.where("worker < 'w3'"), NOW) == []  # one healthy worker is too few


def test_rebalance_evens_out_and_moves_hot_shards(spark):
    shards = cluster_shards(spark, [(i, ["a", "b"], 5000.0 if i == 9 else 1.0) for i in range(10)] + [(10, ["a", "c"], 1.0)])
    workers = cluster_workers(spark, [(w, "ready", 200 if w == "d" else 100, 1) for w in "abcd"])
    moves = C.rebalance_plan(shards, workers, NOW, rf=2)
    held = {w: {i for i, r in [*((i, "ab") for i in range(10)), (10, "ac")] if w in r} for w in "abcd"}
    assert len({m[0] for m in moves}) == len(moves) and [m[3] for m in moves][-1] == "hot_shard_high_qps"
    for shard, source, target, reason in moves:
        assert shard in held[source] and shard not in held[target]
        held[source].remove(shard)
        held[target].add(shard)
    assert max(map(len, held.values())) <= 8 and sum(map(len, held.values())) == 22


def test_edits_are_guarded(spark):
    shards = cluster_shards(spark, [(1, ["a", "b", "c"], 1.0), (2, ["a", "b", "c", "d", "e"], 1.0)])
    workers = cluster_workers(spark, [(w, "ready", 100, 1) for w in "abcdef"] + [("old", "ready", 100, 90), ("new", "joining", 100, 1)])
    edit = lambda shard, **how: {r["shard"]: (r["replicas"], r["epoch"]) for r in C.edit_replicas(shards, shard, workers, NOW, **how).collect()}[shard]
    assert edit(1, add="f") == (["a", "b", "c", "f"], 2)
    same = ["a", "b", "c"]
    for how in ({"add": "old"}, {"add": "new"}, {"add": "none"}, {"add": "a"}, {"remove": "a"}, {"remove": "x"}, {"add": "none", "remove": "a"}, {"add": "b", "remove": "a"}, {}):
        assert edit(1, **how) == (same, 1)
    assert edit(2, add="f") == (["a", "b", "c", "d", "e"], 1) and edit(2, remove="b") == (["a", "c", "d", "e"], 2)
    assert edit(1, add="f", remove="b") == (["a", "f", "c"], 2) and edit(1, add="old", remove="b") == (["a", "old", "c"], 2)


def test_rate_limit(spark):
    df = spark.createDataFrame([("u", t, n) for n, t in enumerate((0, 100, 999_999, 1_000_000, 1_000_001))] + [("v", 5, 9)], "user string, us long, seq long")
    got = {(r["user"], r["seq"]): r["allowed"] for r in cdc.rate_limit(df, "user", 2).collect()}
    assert got == {("u", 0): True, ("u", 1): True, ("u", 2): False, ("u", 3): True, ("u", 4): True, ("v", 9): True}


def test_rate_limit_equals_a_plain_walk(spark):
    """In batches of a few rows, by user and endpoint, with nulls."""
    rng = random.Random(5)
    rows = [(rng.choice(["u", "v", None]), rng.choice(["x", "y", None]), rng.randrange(8_000_000), n) for n in range(600)]
    df = spark.createDataFrame(rows, "user string, endpoint string, us long, seq long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["seq"]: r["allowed"] for r in cdc.rate_limit(df, ["user", "endpoint"], 3).collect()}
        alone = {r["seq"]: r["allowed"] for r in cdc.rate_limit(df, "user", 2, count_rejected=False).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for result, key, limit in ((got, lambda r: r[:2], 3), (alone, lambda r: r[0], 2)):
        state, want = {}, {}
        for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2], r[3])):
            start, used = state.get(key(r), (None, 0))
            if start is None or r[2] - start >= 1_000_000:
                start, used = r[2], 0
            want[r[3]] = used < limit
            state[key(r)] = start, used + 1
        assert result == want


def test_merge_rewrites_touched_buckets_and_drops_old_versions(spark, tmp_path):
    log = "id string, value int, ts long, seq long, is_delete boolean"
    at = f"file://{tmp_path}"
    for n in range(4):
        spark.createDataFrame([(f"k{i}", 10 * n + i, n, i, n == 3 and i == 2) for i in range(n, 3)] + [("all", n, n, 99, False)], log).coalesce(1).write.mode("append").parquet(f"{at}/in")
    schema = spark.read.parquet(f"{at}/in").schema
    for _ in range(2):  # the second run finds nothing new
        cdc.merge_into(cdc.read_changes(spark, f"{at}/in", schema, 1), f"{at}/table", f"{at}/checkpoint", "id", buckets=8).awaitTermination()
        got = {r["id"]: r["value"] for r in cdc.current(spark, f"{at}/table", schema).collect()}
        assert got == {"k0": 0, "k1": 11, "k2": 22, "all": 3}
    assert all(len(v) <= 2 for v in cdc._versions(spark, f"{at}/table").values())


def test_stream_windows_equal_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = cdc.read_changes(spark, str(tmp_path / "in"), events.schema, 1)
    q = cdc.windowed_counts(stream, late="100 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = lambda df: sorted((r["window_start"], r["event_type"], r["events"], round(r["total"], 6)) for r in df.collect())
    assert rows(spark.table("counts")) == rows(cdc.windowed_counts(events))


def test_segments_early_stop(spark):
    rows = [(f"s{s}-{i}", [float(s), float(i)], s, 1) for s in range(12) for i in range(4)] + [("twice", [0.0, 0.0], 11, 2), ("twice", [50.0, 0.0], 10, 1)]
    segments = spark.createDataFrame(rows, "id string, vector array<float>, segment int, ts long")
    chosen = lambda k, **how: {r["segment"] for r in dml.segments_to_search(segments, [0.0, 0.0], k, "euclidean", **how).collect()}
    assert chosen(2) == set(range(4, 12)) and chosen(20) == set(range(2, 12)) and chosen(100) == set(range(12))
    assert chosen(2, fanout=1) == {11} and chosen(4, fanout=1, per_segment=1) == set(range(4, 12))
    dead = spark.createDataFrame([("s4-0", 5)], "id string, ts long")
    found = [r["id"] for r in dml.search_segments(segments, dead, [0.0, 0.0], 2, "euclidean").orderBy("rank").collect()]
    assert found == ["twice", "s4-1"]  # the older version of "twice" doesn't count, segment 4 is the last one searched


def test_batches_by_rows_and_bytes(spark):
    points = spark.createDataFrame([(f"p{i}", [1.0] * 4, {"k": "x" * (500 if i == 5 else 1)}, i) for i in range(12)], "id string, vector array<float>, payload map<string,string>, n int").coalesce(1)
    sizes = {}
    for r in dml.batches(points, 4, 200).collect():
        sizes.setdefault(r["batch"], []).append(r["n"])
    assert sorted(sizes.values()) == [[0, 1, 2, 3], [4], [5], [6, 7, 8, 9], [10, 11]]


def test_key_values(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, value int")
    assert {tuple(r) for r in K.put(K.remove(K.put(t, "d", 4), "b"), "a", 9).collect()} == {("a", 9), ("c", 3), ("d", 4)}
    ops = spark.createDataFrame([("a", 5, False, 1), ("a", None, True, 2), ("z", None, True, 1), ("z", 7, False, 2)], "key string, value int, is_delete boolean, seq int")
    assert {tuple(r) for r in K.apply_batch(t, ops).collect()} == {("b", 2), ("c", 3), ("z", 7)}
    seen = []
    assert K.iterate(t, "key", "", lambda r: seen.append(r["key"]) or r["key"] != "b") == 2 and seen == ["a", "b"]
    assert {r["key"] for r in K.rows_until(t, "key", F.col("value") == 3).collect()} == {"a", "b"} and K.rows_until(t, "key", F.col("value") > 9).count() == 3


def test_codec_of_points(spark):
    rows = [(1, [0.5, -1.0, 0.25], b"meta"), (2, [0.0, 0.0], None), (3, None, b"x"), (4, [], None)]
    df = spark.createDataFrame(rows, "n int, v array<float>, m binary")
    for compress in (False, True):
        back = {r["n"]: r["d"] for r in df.select("n", K.decode_vector(K.encode_vector(F.col("v"), F.col("m"), compress)).alias("d")).collect()}
        assert back[3] is None and back[2]["vector"] == [0.0, 0.0] and back[2]["metadata"] is None and bytes(back[1]["metadata"]) == b"meta"
        assert back[1]["vector"] == pytest.approx([0.5, -1.0, 0.25], abs=0.005 if compress else 0)
    assert spark.createDataFrame([(bytearray(b""),)], "b binary").select(K.decode_vector(F.col("b")).alias("d")).first()["d"] is None
    with pytest.raises(Exception, match="too short"):
        spark.createDataFrame([(bytearray(b"\x05\x00\x00\x00\x01"),)], "b binary").select(K.decode_vector(F.col("b"))).collect()


def test_configuration():
    c = R.load_config({"RERANK_BM25": "0.3", "RERANK_BOOSTS": "verified:0.2, new:0.1", "RERANK_STOP_WORDS": "a, the", "RERANK_CASE_SENSITIVE": "true"})
    assert (c.bm25, c.boosts, c.stop_words, c.case_sensitive, c.b) == (0.3, {"verified": 0.2, "new": 0.1}, ("a", "the"), True, 0.75)
    assert R.load_config('{"penalties": {"old": 0.5}, "k1": 2.0}') == R.RuleConfig(penalties={"old": 0.5}, k1=2.0)
    for bad in ('{"b": 2}', '{"unknown": 1}'):
        with pytest.raises(ValueError):
            R.load_config(bad)
    with pytest.raises(ValueError):
        R.load_config({"RERANK_ORIGINAL": "much"})


def test_search_with_reranking(spark):
    rows = [(f"p{i}", [1.0, i / 10], {"title": "Python programming" if i == 4 else "Cooking", "deprecated": "1" if i == 3 else ""}) for i in range(8)]
    p = spark.createDataFrame(rows, "id string, vector array<float>, payload map<string,string>")
    got = R.search_rerank(p, [1.0, 0.0], "python programming", 3).orderBy("rank").collect()
    assert got[0]["id"] == "p4" and got[0]["explanation"] == "exact match, title match, +2 tokens" and got[0]["payload"]["title"] == "Python programming" and len(got) == 3
    near = [(r["rank"], r["id"]) for r in R.search_rerank(p, [1.0, 0.0], "", 2).orderBy("rank").collect()]
    assert near == [(1, "p0"), (2, "p1")] == [(r["rank"], r["id"]) for r in R.search_rerank(p, [1.0, 0.0], "python", 2, enabled=False).orderBy("rank").collect()]
    assert R.invalidate(p.select(F.col("id").alias("key"))).count() == 0


def test_feedback_is_checked_before_it_is_stored(spark, tmp_path):
    at = f"file://{tmp_path}/feedback"
    s = spark.createDataFrame([(1, "c", "q"), (2, "c", "r")], "ref int, collection string, query string")
    item = "ref int, result_id string, relevance_score int, clicked boolean, position int"
    good = spark.createDataFrame([(1, "a", 5, True, 0), (1, "b", 1, False, 1), (2, "a", 3, True, 0)], item)
    stored = feedback.store(s, good, at)
    assert stored.select("id").distinct().count() == 2
    for bad in (good.where("ref = 1"), good.withColumn("relevance_score", F.lit(6))):
        with pytest.raises(Exception, match="needs an item|1 to 5"):
            feedback.store(s, bad, at)
    assert spark.read.parquet(f"{at}/sessions").count() == 2 and spark.read.parquet(f"{at}/items").count() == 3


def test_a_shared_folder_is_demanded_on_a_cluster():
    from quiverspan.sources import scratch

    class Far:
        master = "spark://far:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="share"):
        scratch.folder(type("Session", (), {"sparkContext": Far()})(), "x")


def test_compaction_of_a_collection(spark, tmp_path):
    c = Store(spark, f"file://{tmp_path}/store").create("c", 2, "euclidean", shards=3)
    points = "id string, vector array<float>, payload map<string,string>"
    put = lambda ts, *ids: c.upsert(spark.createDataFrame([(i, [float(ts), 0.0], None) for i in ids], points), ts)
    assert c.compact() == 0 and c.points().count() == 0
    put(1, "a", "b"), put(2, "b", "c"), c.delete(["a"], 3), put(4, "d")
    state = lambda: {r["id"]: r["vector"][0] for r in c.points().collect()}
    before = state()
    put(5, "e")
    assert c.compact() == 4 and state() == before | {"e": 5.0} and c.segments().count() == 2
    assert c.get("a") is None and c.get("b")["vector"] == [2.0, 0.0]
    assert c.vacuum() == 4 and state() == before | {"e": 5.0}
    assert c.compact(None) == 2 and c.changes().where("is_delete").count() == 0 and state() == before | {"e": 5.0}
    c.delete([], 6)  # an empty segment
    assert state() == before | {"e": 5.0} and not c.needs_index(3) and c.needs_index(5000)


def test_collection(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.list() == []
    c = store.create("test", 2, "cosine", shards=4)
    with pytest.raises(AlreadyExists):
        store.create("test", 2)
    with pytest.raises(ValueError):
        store.create("", 2)
    with pytest.raises(NotFound):
        store.open("none").points()
    points = "id string, vector array<float>, payload map<string,string>"
    assert c.get("p1") is None
    assert c.upsert(spark.createDataFrame([("p1", [1.0, 0.0], {"name": "x"}), ("p2", [0.0, 1.0], None), ("p3", [1.0, 1.0], {})], points), 1) == 3
    c.upsert(spark.createDataFrame([("p2", [1.0, 0.1], {"name": "y"})], points), 2)
    c.delete(["p3", "missing"], 3)
    assert store.open("test").get("p2")["payload"] == {"name": "y"} and c.get("p3") is None
    assert [(r["id"], r["payload"]) for r in c.search([1.0, 0.0], 5).orderBy("rank").collect()] == [("p1", {"name": "x"}), ("p2", {"name": "y"})]
    assert sum(r["points"] for r in c.status().collect()) == 2
    c.backup(f"file://{tmp_path}/backup")
    c.delete(["p1"], 4)
    c.upsert(spark.createDataFrame([("p9", [1.0, 1.0], {})], points), 5)
    c.restore(f"file://{tmp_path}/backup", 6)
    assert {r["id"] for r in c.points().collect()} == {"p1", "p2"}
    with pytest.raises(ValueError):
        c.search([1.0])
    store.drop("test")
    assert store.list() == []
