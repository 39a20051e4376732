import hashlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from quiverspan.llm import exact_dedup, near_dedup
from quiverspan.llm.common import Scratch
from quiverspan.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup_equals_sql(spark, sf_dir, duck):
    same_rows(exact_dedup.op4_exact_dedup(spark, sf_dir), duck.sql(exact_dedup.ORACLE))


def test_exact_dedup_edge_cases(docs, rows, empty):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t or "").translate(LOWER) for i, t, *_ in rows if i == r["doc_id"])
        own = groups[text]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def brute(rows, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [85, 60])
def test_near_dedup_equals_brute_force(docs, rows, empty, percent):
    want = brute(rows, percent)
    got = near_dedup.near_duplicates(docs, percent=percent).collect()
    assert len(got) == len(rows)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_drops_all_but_one(docs, rows):
    want = brute(rows, 80)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}


def test_near_dedup_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(None, 2, None, True), (1, 2, 1, True), (None, 0, None, True)}


def test_group_of_copies_that_differ(spark):
    """Copies of one text with 0 to 4 edits each: many pairs in common buckets, few of them links."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(i % 5):
            w[int(rng.integers(150))] = f"e{i}-{k}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == brute(rows, 85)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (8, 10), (7, 7), *((100, k) for k in range(101, 140)), *((k, k + 1) for k in range(200, 230))]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {**{k: 1 for k in (1, 2, 3, 4)}, **{k: 8 for k in (8, 9, 10)}, **{k: 100 for k in range(100, 140)}, **{k: 200 for k in range(200, 231)}}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def test_outsiders_of_a_group_of_copies(spark):
    """Linked copies of one size, and outsiders in their buckets, some of which link with a copy but not with the original."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(90):
        w = list(base[: 160 - 3 * (i % 7 == 0) * (i % 5)])
        for k in range(i % 3 if i % 9 else 4 + i % 4):
            w[int(rng.integers(len(w)))] = f"e{i if i % 4 else i % 8}-{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 80):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, percent=percent).collect()}
        assert got == brute(rows, percent)


def test_search_across_components_is_exact(spark):
    """Every link between components is found, and nothing is paired within one."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(words)
        for k in range(int(rng.integers(0, 5))):
            w[int(rng.integers(60))] = f"x{rng.integers(6)}"
        rows.append((i, " ".join(w[: 60 - int(rng.integers(0, 6))]), int(rng.integers(0, 5)) if i % 3 else i))
    texts = spark.createDataFrame(rows, "id long, text string, component long")
    sets = {i: set(near_dedup.shingles(t).tolist()) for i, t, _ in rows}
    for percent in (60, 80, 85):
        got = {(r["a"], r["b"]) for r in near_dedup.across_components(texts, percent, Scratch(spark)).collect()}
        want = {(a, b) for a, _, c in rows for b, _, d in rows if a > b and c != d and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert want <= got and len(want) > 20
        assert all(rows[a][2] != rows[b][2] for a, b in got)


def test_rows_of_one_id(spark):
    """Rows that share an id but not a text are judged each by its own text."""
    df = spark.createDataFrame([(5, "a b c d e f g"), (5, "q r s t u v w"), (3, "q r s t u v w")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True)]


def test_exact_dedup_with_a_dense_filter(spark, docs, rows, monkeypatch):
    """A filter of too few bits passes rows for nothing; results stay."""
    want = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    kept = sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect())
    monkeypatch.setattr(exact_dedup.Filter, "_place", lambda self, hashed: (F.lit(0).cast("long").alias("__row"), F.pmod(hashed, F.lit(2).cast("long")).alias("__bit")))
    assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == want
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()) == kept


def test_exact_dedup_keeps_null_ids_apart(spark):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (1, "b"), (None, "c"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(str, (r["text"] for r in exact_dedup.drop_exact_duplicates(df).collect()))) == ["", "a", "b", "c"]


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 3000, 3).select((F.col("id") * 7919).alias("k"))
    f = exact_dedup.Filter(keys, F.xxhash64("k"), Scratch(spark))
    seen = f.test(spark.range(3000).select((F.col("id") * 7919).alias("k"), (F.col("id") % 3 == 0).alias("held")), F.xxhash64("k"))
    assert seen.where("held AND NOT __maybe").count() == 0 and seen.where("NOT held AND __maybe").count() < 300
