"""The pipeline, stage by stage, against brute force on what the stage before kept."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from test_dedup import LOWER, brute
from test_models import slow_ftrl, slow_grams
from test_spans import slow_spans
from tokenizers import Tokenizer

import corpus_pipeline
from quiverspan.llm import toxicity
from quiverspan.llm.common import Scratch


def slow_margins(spark, texts, labels):
    """What coordinate-wise learning from the labelled texts gives each text."""
    order = {r["i"]: r["o"] for r in spark.createDataFrame([(i,) for i in texts], "i long").select("i", F.xxhash64(F.col("i"), F.lit(11)).alias("o")).collect()}
    known = sorted((i for i in texts if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 5), key=order.get)
    w, bias = slow_ftrl([(slow_grams(texts[i]), labels[i]) for i in known], toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.TOXIC_WEIGHT)
    return {i: bias + sum(w.get(x, 0.0) for x in slow_grams(t)) for i, t in texts.items()}


def slow_redact(text):
    """Character by character: a mark where a run of secret characters begins."""
    if not text:
        return text
    inside, mark = [False] * len(text), {}
    for kind, start, end in slow_spans(text):
        if kind != "endpoint":
            if not any(inside[start:end]) or not inside[start]:
                mark[start] = f"[{kind.upper()}]"
            inside[start:end] = [True] * (end - start)
    return "".join(mark.get(i, "") + ("" if inside[i] else c) for i, c in enumerate(text))


def write(spark, at, docs, labels):
    docs.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_odd_documents(spark, docs, rows, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names."""
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    null = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("a text of a document without an id"))
    at = write(spark, tmp_path, docs.unionByName(null), labels)
    now = spark.read.parquet(f"{at}/documents.parquet")
    columns, scratch = now.columns, Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = scratch.write(stage(spark, now, at), name)
        assert now.columns == columns
    kept = now.collect()
    assert any(r["doc_id"] is None for r in kept) and len({r["doc_id"] for r in kept}) == len(kept) < len(rows)
    assert all((r["text"] is None) == (r["n_chars"] is None) or r["doc_id"] is None for r in kept)
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, now, at).collect()} == {r["doc_id"] for r in kept}


def test_no_documents(spark, docs, tmp_path):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert corpus_pipeline.run(spark, write(spark, tmp_path, docs.limit(0), labels)).count() == 0


def test_no_labels(spark, docs, tmp_path):
    at = write(spark, tmp_path, docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert corpus_pipeline.STAGES[0][1](spark, docs, at).count() == docs.count()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, scratch, kept = docs.columns, Scratch(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = before, {r["doc_id"]: r["text"] for r in docs.collect()}

    before, after = kept["toxicity"]
    margins = slow_margins(spark, before, {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()})
    sure = {i for i, m in margins.items() if abs(m) > 0.01}  # the slow version has other roundings
    assert {i for i in after if i in sure} == {i for i in sure if margins[i] < 0} and all(after[i] == before[i] for i in after)

    before, after = kept["exact_dedup"]
    groups = defaultdict(list)
    for i, t in before.items():
        groups[t.translate(LOWER)].append(i)
    assert after == {max(g): before[max(g)] for g in groups.values()}

    before, after = kept["near_dedup"]
    assert set(after) == {c for _, c in brute(list(before.items()), 80).values()} and all(before[i] == t for i, t in after.items())

    before, after = kept["secrets"]
    assert after == {i: slow_redact(t) for i, t in before.items()}
    assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in after.items()}
    covered = {i: np.zeros(len(x), int) for i, x in ids.items()}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        piece = slice(r["start"], r["start"] + r["length"])
        covered[r["doc_id"]][piece] += 1
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][piece], "<u4").tobytes())
    assert all((c == 1).all() for c in covered.values())


def test_run_equals_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
