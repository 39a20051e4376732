import pickle
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverspan.operators import blocks, ivf
from quiverspan.operators import search as S
from quiverspan.plans import catalogue


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, vector array<float>")


def test_ladder_of_four(spark):
    p = frame(spark, [("1234561", [0.1] * 4), ("1234562", [0.2] * 4), ("1234563", [0.8] * 4), ("1234564", [0.9] * 4)])
    assert [r["id"] for r in S.search(p, [0.0] * 4, 2, "euclidean").orderBy("rank").collect()] == ["1234561", "1234562"]


def test_nearest_not_farthest(spark):
    p = frame(spark, [("a", [4.0, 1.0, 1.0, 2.0]), ("b", [4.1, 1.1, 1.0, 2.0]), ("c", [5.0, 5.0, 1.0, 2.0]), ("d", [5.1, 5.1, 1.0, 2.0])])
    assert {r["id"] for r in S.search(p, [4, 1, 1, 2], 2, "euclidean").collect()} == {"a", "b"}


def test_ties_by_id_and_default_k(spark):
    p = frame(spark, [(f"{i:02}", [1.0, 0.0]) for i in range(30)])
    assert [r["id"] for r in S.search(p, [1.0, 0.0], 0).orderBy("rank").collect()] == [f"{i:02}" for i in range(10)]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, qvector array<float>")
    assert [r["id"] for r in S.search_batch(p, q, 3).orderBy("rank").collect()] == ["00", "01", "02"]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_batch_equals_single(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (200, 5)).astype(float).tolist()
    p = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, vector array<float>").repartition(5)
    q = spark.createDataFrame([(i, x[i]) for i in (0, 5, 9)], "qid long, qvector array<float>")
    got = S.search_batch(p, q, 7, metric).collect()
    for i in (0, 5, 9):
        want = [(r["id"], round(r["score"], 9)) for r in S.search(p, x[i], 7, metric).orderBy("rank").collect()]
        assert sorted(((r["rank"], r["id"], round(r["score"], 9)) for r in got if r["qid"] == i)) == [(n + 1, *w) for n, w in enumerate(want)]


def test_empty_queries_and_points(spark):
    p, q = frame(spark, []), spark.createDataFrame([(1, [1.0])], "qid int, qvector array<float>")
    assert S.search_batch(p, q).count() == 0 and S.search_batch(p, q.limit(0)).count() == 0


@pytest.mark.parametrize("bytes_", [1 << 26, 20])
def test_blocks_of_queries(spark, monkeypatch, bytes_):
    """Broadcast, and dealt out as a grid of blocks of queries and groups of points."""
    for name, n in (("BLOCK_QUERIES", 2), ("CHUNK_POINTS", 2), ("BROADCAST_BYTES", bytes_), ("GROUP_BYTES", 40)):
        monkeypatch.setattr(blocks, name, n)
    p = frame(spark, [(f"{i}", [float(i), 1.0]) for i in range(9)])
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "qid int, qvector array<float>")
    assert {(r["qid"], r["id"]) for r in S.search_batch(p, q, 1, "euclidean").collect()} == {(i, str(i)) for i in range(5)}


def test_odd_queries_and_points(spark):
    p = frame(spark, [("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [1.0, 2.0, 3.0]), ("e", [None, 1.0])])
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0]), (4, [1.0])], "qid int, qvector array<float>")
    assert {(r["qid"], r["id"]) for r in S.search_batch(p, q).collect()} == {(1, "a"), (3, "d")}
    cells = ivf.fit(p)
    assert {(r["qid"], r["id"]) for r in ivf.search(ivf.index(p, cells), q, cells).collect()} == {(1, "a")}


def test_equal_vectors_keep_k(spark):
    best = blocks.Best(3, 4)
    for at in range(0, 5000, 500):
        best.add(slice(None), [f"{i:05}" for i in range(4999 - at, 4499 - at, -1)], np.full((3, 500), 2.0))
        assert best.score.shape == (3, 4) and len(best.ids) < 2 * 12 + blocks.CHUNK_POINTS + 501
    assert [sorted(best.ids[i] for i in row) for row in best.which] == [["00000", "00001", "00002", "00003"]] * 3
    p = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5000)], "id long, vector array<float>").repartition(3)
    q = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)], "qid int, qvector array<float>")
    assert {(r["rank"], r["id"]) for r in S.search_batch(p, q, 3).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_two_stage_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(4)
    q = p.where("id < 5").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    got = {(r["qid"], r["rank"]): r["id"] for r in S.search_two_stage(p, q, 3, 2).collect()}
    y = x.astype(np.float64)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    code = np.rint(unit * 127)
    for i in range(5):
        coarse = sorted(range(300), key=lambda j: (1 - code[i] @ code[j] / 16129, j))[:6]
        assert [got[i, r] for r in (1, 2, 3)] == sorted(coarse, key=lambda j: (1 - unit[i] @ unit[j], j))[:3]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ivf_recall(spark, sf_dir, seed):
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = p.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    exact = {(r["qid"], r["id"]) for r in S.search_batch(p, q, 10).collect()}
    cells = ivf.fit(p, seed=seed)
    index = ivf.index(p, cells)
    assert index.count() == p.count()
    found = {(r["qid"], r["id"]) for r in ivf.search(index, q, cells, 10).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_ivf_edge_cases(spark, tmp_path):
    none, q = frame(spark, []), spark.createDataFrame([(1, [1.0, 0.0])], "qid int, qvector array<float>")
    cells = ivf.fit(none)
    assert ivf.search(ivf.index(none, cells), q, cells).count() == 0
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 8))
    p = spark.createDataFrame([(i, (centers[i % 40] + 0.05 * rng.normal(size=8)).tolist()) for i in range(4000)], "id long, vector array<float>")
    cells = ivf.fit(p)
    assert len(cells.centers) == 4000 // ivf.PER_CELL and cells.probes < len(cells.centers) // 4  # clusters: few probes
    ivf.save(ivf.index(p, cells), cells, str(tmp_path / "index"))
    indexed, loaded = ivf.load(spark, str(tmp_path / "index"))
    q = p.where("id < 20").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    keys = lambda df: {(r["qid"], r["id"]) for r in df.collect()}
    exact = keys(S.search_batch(p, q, 10))
    assert len(exact & keys(ivf.search(indexed, q, loaded, 10))) / len(exact) >= 0.9
    assert keys(ivf.search(indexed, q, loaded, 10, ef=4000)) == exact


def test_registered_ivf_search_has_the_recall(spark, sf_dir):
    keys = lambda name: {(r["qid"], r["id"]) for r in catalogue.QUERIES[name](spark, sf_dir).collect()}
    exact = keys("ivf_exhaustive")
    assert len(keys("ivf_search") & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("probes", [4096, 3000])
def test_probed_cells_take_a_bit_each(spark, monkeypatch, probes):
    """What is sent to each task, and what the limit of a broadcast counts, is 512 bytes a query besides its vector."""
    sent, real = [], blocks.lists
    monkeypatch.setattr(blocks, "lists", lambda *a: sent.append(real(*a)) or sent[-1])
    rng = np.random.default_rng(4)
    cells = ivf.Cells(ivf.unit(rng.normal(size=(4096, 4))), probes)
    p = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "id long, vector array<float>")
    q = p.where("id < 100").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    indexed = ivf.index(p, cells)
    rows = lambda df: {(r["qid"], r["rank"], r["id"]) for r in df.collect()}
    got = rows(ivf.search(indexed, q, cells, 5))
    assert len(pickle.dumps(sent)) < 100 * (512 + 400)
    near = lambda v: np.argsort(-(cells.centers @ np.array(v)), kind="stable")
    at = {r["id"]: (r["vector"], r["cell"]) for r in indexed.collect()}
    assert all(c == near(v)[0] for v, c in at.values())
    want = set()
    for i in range(100):
        seen = set(near(at[i][0])[:probes].tolist())
        x = {j: 1 - np.dot(v, at[i][0]) / np.linalg.norm(v) / np.linalg.norm(at[i][0]) for j, (v, c) in at.items() if c in seen}
        want |= {(i, n + 1, j) for n, j in enumerate(sorted(x, key=lambda j: (round(x[j], 12), j))[:5])}
    assert got == want
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 100 * 32 + 100)  # the vectors alone would be less
    assert rows(ivf.search(indexed, q, cells, 5)) == want
    assert "CoGroup" in str(ivf.search(indexed, q, cells, 5)._jdf.queryExecution())


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("share", [None, 1.0, 0.5, 0.02])
def test_a_block_holds_few_scores_at_a_time(share):
    """A full block and nearly two chunks of points: 64 MB of scores, of which a few are held at once."""
    rng = np.random.default_rng(6)
    q, x, cell = rng.normal(size=(2048, 8)), rng.normal(size=(4095, 8)), np.sort(rng.integers(0, 64, 4095)).astype(np.int32)
    probed = None if share is None else rng.random((2048, 64)) < share
    own = None if share is None else [bytes(b) for b in np.packbits(probed, axis=1)]
    block = blocks.Block(blocks.Task(10, "cosine", cells=share is not None), list(range(2048)), list(q), own)
    assert peak(lambda: block.add(list(range(4095)), x, cell)) < 100 << 20
    score = blocks.cosine(q[:50], x)
    if share is not None:
        score[~probed[:50][:, cell]] = np.inf
    best = block.best[8]
    for i in range(50):
        want = sorted(np.flatnonzero(np.isfinite(score[i])).tolist(), key=lambda j: score[i, j])[:10]
        assert {best.ids[j] for j in best.which[i][np.isfinite(best.score[i])]} == set(want)


def test_vectors_meet_centroids_a_few_at_a_time():
    """As many vectors as an Arrow batch has, and the most cells: 328 MB of products."""
    rng = np.random.default_rng(8)
    x, cells = ivf.unit(rng.normal(size=(10_000, 8))), ivf.Cells(ivf.unit(rng.normal(size=(4096, 8))), 1)
    assert peak(lambda: cells.own(x)) < 40 << 20 and peak(lambda: cells.probed(x[:5000], 3000)) < 60 << 20
    assert cells.own(x[:500]) == (x[:500] @ cells.centers.T).argmax(axis=1).tolist()


def test_cells_of_odd_vectors(spark):
    cells = ivf.Cells(np.eye(2), 1)
    p = frame(spark, [("a", [0.1, 2.0]), ("b", None), ("c", []), ("d", [1.0, 2.0, 3.0]), ("e", [None, 1.0]), ("f", [1.0, 0.5]), ("g", [float("nan"), 1.0])])
    assert {r["id"]: r["cell"] for r in ivf.index(p, cells).collect()} == {"a": 1, "b": None, "c": None, "d": None, "e": None, "f": 0, "g": 0}


def test_progressive_ends_with_the_exact_answer(spark):
    p = frame(spark, [(f"{i}", [float(i), 1.0]) for i in range(8)])
    shards = [p.where(F.col("id").cast("int") % 2 == k) for k in (0, 1)]
    last = list(S.progressive_search(shards, [0.0, 1.0], 3, "euclidean"))[-1]
    assert [i for i, _ in last] == ["0", "1", "2"]


def test_progressive_search_ends_early(spark):
    p = frame(spark, [(f"{i}", [float(i), 1.0]) for i in range(30)])
    shards = [p.where(F.col("id").cast("int").between(3 * k, 3 * k + 2)) for k in range(10)]
    assert len(list(S.progressive_search(shards, [0.0, 1.0], 3, "euclidean"))) == 4  # three shards that change nothing
    assert len(list(S.progressive_search(shards[::-1], [0.0, 1.0], 3, "euclidean"))) == 10


def test_merge_keeps_the_least_score(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.2), (1, "", 0.0)], "qid int, id string, score double")
    b = spark.createDataFrame([(1, "x", 0.1)], "qid int, id string, score double")
    assert [(r["id"], r["score"]) for r in S.merge_hits(a, b, k=5).orderBy("rank").collect()] == [("x", 0.1), ("y", 0.2)]


def test_limits_as_columns(spark):
    grid = [(k, d, q) for k in (1, 3, 40, 99, 150) for d in (64, 512, 800, 2000) for q in ("", "ab", "long")]
    df = spark.createDataFrame(grid, "k int, d int, q string")
    for r in df.select("*", S.effective_ef_of(F.col("k"), F.col("d")).alias("ef"), S.candidate_limit_of(F.col("k"), F.col("q")).alias("n")).collect():
        assert (r["ef"], r["n"]) == (S.effective_ef(r["k"], r["d"]), S.candidate_limit(r["k"], r["q"]))


def test_limits():
    assert [S.candidate_limit(10), S.candidate_limit(10, rerank=False), S.candidate_limit(10, "ab")] == [20, 10, 15]
    assert S.effective_ef(10, 64) >= 10 and S.effective_ef(10, 1024) <= S.effective_ef(10, 64)
