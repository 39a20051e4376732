import math
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quiverspan.llm import language_id, quality, toxicity

SF = "/root/testdata/sf0.01"


def out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def truth(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.char_length("text").alias("n"))
    return {r["doc_id"]: r for r in d.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()}


def auc(scores, y):
    pos, neg = [s for s, t in zip(scores, y) if t], [s for s, t in zip(scores, y) if not t]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_quality_held_out(spark, truth):
    got = [r for r in quality.op3_quality(spark, SF).collect()]
    assert len(got) == len(truth) and all(r["held_out"] == out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["score"], r["predicted"], truth[r["doc_id"]]["quality"]) for r in got if r["held_out"] and truth[r["doc_id"]]["quality"] is not None]
    assert auc([h[0] for h in held], [h[2] for h in held]) > 0.95
    assert np.mean([h[1] == h[2] for h in held]) > 0.9


def test_non_negative_risk_separates():
    rng = np.random.default_rng(1)
    good, bad = np.clip(rng.normal(0.3, 0.05, (600, quality.SIZE)), 0, 1), np.clip(rng.normal(0.6, 0.05, (150, quality.SIZE)), 0, 1)
    m = quality.fit_shapes(good[:200], np.concatenate([good[200:500], bad[:75]]), 0.8)
    assert (m.score(good[500:]) > 0.5).mean() > 0.95 and (m.score(bad[75:]) < 0.5).mean() > 0.95


def test_toxicity_held_out(spark, truth):
    got = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert auc([h[0] for h in held], [h[2] for h in held]) > 0.95
    assert sum(h[1] for h in held if not h[2]) <= 2 and np.mean([h[1] for h in held if h[2]]) > 0.75
    assert all(r["held_out"] == out(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(100, 5000, 80), 7 if k % 4 == 0 else 8)).astype(np.uint32), int(k % 4 == 0)) for k in range(1200)]
    w = toxicity.ftrl([rows] * 4)
    dense = w.dense()
    assert dense[7] > 1 and len(w.at) < 2500 and w.bias + dense[8] < 0


def test_language_held_out(spark, truth):
    got = language_id.op10_language_id(spark, SF).collect()
    assert all(r["held_out"] == out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in got if r["held_out"] and truth[r["doc_id"]]["lang"] and truth[r["doc_id"]]["n"] > 30]
    assert np.mean(held) > 0.98


def test_features_equal_the_formula():
    x = language_id.features("Ab, ab!")
    assert x is not None and np.isclose(np.linalg.norm(x), 1) and np.allclose(x, language_id.features("ab  ab"))
    assert language_id.features("123 !?") is None and language_id.features("") is None


@pytest.mark.parametrize("op,column", [(quality, "quality"), (toxicity, "toxic")])
def test_models_edge_cases(spark, docs, rows, empty, op, column):
    labels = spark.createDataFrame([(i, i % 2) for i, *_ in rows] + [(None, 1), (3, None)], f"doc_id long, {column} int")
    for data, known in ((docs, labels), (docs, labels.limit(0)), (empty, labels)):
        got = op.predict(data, op.fit(data, known)).collect()
        assert len(got) == data.count() and all(0 <= r["score"] <= 1 for r in got)
    same = {}
    for r in op.predict(docs, op.fit(docs, labels)).collect():
        assert same.setdefault(r["doc_id"], r["score"]) == r["score"]


def test_language_edge_cases(spark, docs, rows, empty):
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(none)).collect()} == {"und"}
    assert language_id.predict(empty, language_id.fit(docs)).count() == 0
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert all((got[i] == "und") == (not any(c.isalpha() for c in t or "")) for i, t, *_ in rows)


def test_drop_toxic_keeps_columns(spark, docs, rows):
    labels = spark.createDataFrame([(i, 0) for i, *_ in rows], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_drop_toxic_without_labels_keeps_all(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    null = spark.createDataFrame([(i, None) for i, *_ in rows], "doc_id long, toxic int")
    for labels in (none, null):
        kept = toxicity.drop_toxic(docs, labels)
        assert kept.columns == docs.columns and kept.count() == len(rows)


def test_toxicity_with_odd_rows(spark, docs, empty):
    """Nulls, repeated rows and clashing names: defined fates, columns as they were."""
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)] + [(None, 1), (4, None), (5, 1), (5, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and toxicity.drop_toxic(empty, labels).count() == 0
    dense = toxicity.fit(docs, labels)
    want = sorted(r["doc_id"] for r in docs.collect() if toxicity.score(r["text"], dense.dense(), dense.bias) < 0.5)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_a_text_without_a_learnt_feature_is_kept(spark):
    """Even where nearly all labels are toxic."""
    rows = [(i, f"vile scum {i}" if i % 10 else "fine day") for i in range(60)] + [(100, "words that no label has"), (101, None), (None, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(60)], "doc_id long, toxic int")
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, labels).collect()}
    assert {100, 101, None, 0, 10, 20} <= kept and not kept & {1, 2, 3, 55}


# --- plain slow versions --------------------------------------------------------------------------


def slow_grams(text):
    """Distinct hashes of unigrams, bigrams, trigrams and pairs with one or two words between, with Python's integers."""
    words = [w for w in toxicity._word.findall((text or "").lower())]
    h, size = [xxhash.xxh3_64_intdigest(w) for w in words], 1 << 64
    a, b = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    out = set(h)
    for k in (1, 2, 3):
        out |= {((h[i] * a % size) ^ (h[i + k] + k) % size) * b % size for i in range(len(h) - k)}
    out |= {(((h[i] * a % size) ^ h[i + 1]) * b % size ^ h[i + 2]) * a % size for i in range(len(h) - 2)}
    return {x >> (64 - toxicity.BITS) for x in out}


def slow_ftrl(rows, epochs, alpha, beta, l1, one_weight):
    """Coordinate by coordinate."""
    z, n = {}, {}
    zb = nb = 0.0
    sign = lambda x: (x > 0) - (x < 0)
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - sign(z[i]) * l1) / ((beta + math.sqrt(n[i])) / alpha)
    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            bias = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = (1 / (1 + math.exp(-max(-30, min(30, bias + sum(w.values()))))) - y) * (one_weight if y else 1)
            for i in x:
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * bias
            nb += g * g
    return {i: weight(i) for i in z if weight(i)}, min(toxicity.MOST_BIAS, -zb / ((beta + math.sqrt(nb)) / alpha))


def test_toxicity_query_equals_the_slow_version(spark, tmp_path):
    """The whole query, from hashing to scores, against coordinate-wise learning in the same order."""
    rng = np.random.default_rng(21)
    texts = [" ".join(rng.choice(["good", "day", "fine", "sun", "walk"], 6)) + (" vile scum" if i % 4 == 0 else "") for i in range(120)] + ["", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    order = {r["doc_id"]: r["o"] for r in spark.range(122).select(F.col("id").alias("doc_id"), F.xxhash64(F.col("id"), F.lit(11)).alias("o")).collect()}
    rows = [(slow_grams(texts[i]), int(i % 4 == 0)) for i in sorted((i for i in range(120) if not out(i)), key=order.get)]
    w, bias = slow_ftrl(rows, toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.TOXIC_WEIGHT)
    assert w
    for r in toxicity.op6_toxicity(spark, str(tmp_path)).collect():
        margin = bias + sum(w.get(i, 0.0) for i in slow_grams(texts[r["doc_id"]]))
        assert abs(r["score"] - 1 / (1 + math.exp(-margin))) < 1e-3 and r["held_out"] == out(r["doc_id"])


def test_risk_equals_plain_sums_and_its_gradient():
    rng = np.random.default_rng(4)
    p, u = (np.hstack([rng.normal(m, 1, (n, 3)), np.ones((n, 1))]) for m, n in ((0.5, 9), (-0.2, 14)))
    loss = lambda f: math.log1p(math.exp(-f))
    for w in rng.normal(size=(20, 4)):
        f = lambda x: sum(a * b for a, b in zip(x, w))
        rest = sum(loss(-f(x)) for x in u) / len(u) - 0.4 * sum(loss(-f(x)) for x in p) / len(p)
        value, g = quality.risk(w, p, u, 0.4)
        assert math.isclose(value, 0.4 * sum(loss(f(x)) for x in p) / len(p) + max(0.0, rest), rel_tol=1e-9)
        own = (lambda v: quality.risk(v, p, u, 0.4)[0]) if rest >= 0 else (lambda v: -(np.logaddexp(0, u @ v).mean() - 0.4 * np.logaddexp(0, p @ v).mean()))
        slope = [(own(w + d) - own(w - d)) / 2e-5 for d in np.eye(4) * 1e-5]
        assert np.allclose(slope, g, atol=1e-5)


def test_prior_is_estimated():
    rng = np.random.default_rng(6)
    draw = lambda centre, n: np.clip(rng.normal(centre, 0.05, (n, quality.SIZE)), 0, 1)
    for prior in (0.3, 0.7):
        n = int(2000 * prior)
        unlabelled = np.concatenate([draw(0.3, n), draw(0.6, 2000 - n)])
        assert abs(quality.estimate_prior(draw(0.3, 800), rng.permutation(unlabelled)) - prior) < 0.08


def test_quality_query_equals_plain_scores(spark, truth):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.fit(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.op3_quality(spark, SF).collect()[:200]:
        x = quality.expand(quality.shape(text[r["doc_id"]]))
        margin = m.bias + sum(w * max(-6.0, min(6.0, (v - a) / b)) for w, v, a, b in zip(m.weight, x, m.mean, m.scale))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-30, min(30, margin)))), rel_tol=1e-4, abs_tol=1e-9)


def test_language_query_equals_plain_votes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = language_id.fit(docs)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    product = lambda w, x: float(sum(w[i] * x[i] for i in np.flatnonzero(x)) + w[-1])
    for r in language_id.op10_language_id(spark, SF).collect()[:60]:
        x = language_id.features(text[r["doc_id"]])
        if x is None:
            assert r["lang_pred"] == "und"
            continue
        family = max(m.families, key=lambda f: product(m.of_family[m.families.index(f)], x))
        votes = dict.fromkeys(m.langs[family], 0)
        for a, b in combinations(m.langs[family], 2):
            votes[a if product(m.of_pair[a, b], x) > 0 else b] += 1
        assert votes[r["lang_pred"]] == max(votes.values())


def test_dirty_tags_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGS", 2)
    rows = [(i, "the quick brown fox " * 3, "en") for i in range(40)] + [(100 + i, "der schnelle braune fuchs " * 3, "de-AT") for i in range(30)] + [(200 + i, "noise text here", f"tag{i}") for i in range(20)]
    m = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == {"germanic": ["de-AT", "en"]}
    assert "fil" not in language_id.FAMILY_OF and language_id.fit_vectors({"fil": np.ones((2, language_id.DIM), np.float32), "fi": np.ones((2, language_id.DIM), np.float32)}).langs == {"uralic": ["fi"], "fil": ["fil"]}


def test_ftrl_holds_two_vectors():
    """The driver's memory: z and n, and no other vector of their length, while the weights are read off at the end."""
    import tracemalloc

    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 1 << toxicity.BITS, 300).astype(np.uint32)), k % 2) for k in range(20)]
    tracemalloc.start()
    model = toxicity.ftrl([rows] * 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.at) and peak < 2.5 * 4 * (1 << toxicity.BITS)


def test_the_driver_asks_for_the_hashed_rows_once(spark, sf_dir, monkeypatch):
    """Not again for each pass; every pass has the same rows in the same order."""
    passes, queries, plain = [], [], type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda df: queries.append(1) or plain(df))
    monkeypatch.setattr(toxicity, "ftrl", lambda found: passes.extend([(x.tobytes(), y) for x, y in rows] for rows in found) or toxicity.Weights(np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0))
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    toxicity.fit(docs, labels)
    assert len(passes) == toxicity.EPOCHS and passes[0] and all(p == passes[0] for p in passes) and len(queries) == 16
