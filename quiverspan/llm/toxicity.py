"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import struct
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_column, arrow_map, held_out, table

#: log2 of the hashed features; labelled rows that a fit reads at most.
BITS, MAX_ROWS = 22, 12_000
#: FTRL's rates and penalties; passes; how much a toxic row's gradient counts against another's. The L1 penalty alone
#: decides which features get a weight, at every number of rows.
ALPHA, BETA, L1, L2, EPOCHS, TOXIC_WEIGHT = 2.0, 1.0, 7.0, 0.0, 4, 3.0
#: The bias of a fitted model at most: whatever share of the labels is toxic, a text without a learnt feature isn't.
MOST_BIAS = -0.1

_word = re.compile(r"[^\W_]+")


def grams(text: str | None) -> np.ndarray:
    """Hashed unigrams, bigrams, trigrams and pairs that skip one or two words, of the whole lower-cased text."""
    words = _word.findall(text.lower()) if text else []
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    spun = h * a
    parts = [h]
    for k, skip in ((1, 1), (2, 2), (3, 3)):  # apart by one (a bigram), two, three
        if len(h) > skip:
            parts.append((spun[:-skip] ^ (h[skip:] + np.uint64(k))) * b)
    if len(h) > 2:
        parts.append(((spun[:-2] ^ h[1:-1]) * b ^ h[2:]) * a)
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32)


@dataclass
class Weights:
    """The non-zero weights: hash, weight, and the bias; compact enough to broadcast (at most 2^BITS entries)."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


def score(text: str | None, dense: np.ndarray, bias: float) -> float:
    found = grams(text)
    hit = np.unique(found[dense[found] != 0])
    return float(1 / (1 + np.exp(-np.clip(bias + dense[hit].sum(dtype=np.float64), -30, 30))))


def ftrl(passes: Iterable[Iterable[tuple[np.ndarray, int]]], alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, one_weight: float = TOXIC_WEIGHT) -> Weights:
    """FTRL-proximal: each coordinate has its own rate from its squared gradients, and is zero while |z| <= l1. The bias
    is a coordinate without penalty. passes: the rows of each pass over the data, as distinct feature hashes and a label
    of 0 or 1; they are learnt one at a time and may be streamed. Gradients of rows of label 1 count one_weight times."""
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    zb = nb = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for rows in passes:
        for x, y in rows:
            zx, nx = z[x], n[x]
            w, bias = weight(zx, nx), -zb / ((beta + nb**0.5) / alpha)
            g = (1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y) * (one_weight if y else 1.0)
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    step = 1 << 16  # only what is learnt, a slice at a time: the driver holds z and n, no other vector of their length
    at = np.concatenate([low + np.flatnonzero(np.abs(z[low : low + step]) > l1) for low in range(0, len(z), step)])
    return Weights(at.astype(np.uint32), weight(z[at], n[at]).astype(np.float32), -zb / ((beta + nb**0.5) / alpha))


def replayed(rows: Iterable[tuple[bytes, int]], passes: int, kept: BinaryIO) -> Iterator[Iterator[tuple[np.ndarray, int]]]:
    """Passes over rows that are asked for once: the first pass writes them to a file, the others read it."""

    def first() -> Iterator[tuple[np.ndarray, int]]:
        for x, y in rows:
            kept.write(struct.pack("<qq", len(x), y) + x)
            yield np.frombuffer(x, np.uint32), y

    def again() -> Iterator[tuple[np.ndarray, int]]:
        kept.seek(0)
        while head := kept.read(16):
            size, y = struct.unpack("<qq", head)
            yield np.frombuffer(kept.read(size), np.uint32), y

    return (again() if k else first() for k in range(passes))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Weights:
    """Learns from labelled rows that aren't held out, all or a random share, about max_rows, of them by hash of id. Rows
    with a null id, label or other label than 0 and 1 teach nothing; no rows: every score is 0.5. The driver streams the
    hashed rows in that order, a sixteenth at a time, into a file of its own, which the later passes read; it holds two
    numbers a hash."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    total = known.count()
    order = F.xxhash64(F.col("id"), F.lit(11))
    share = min(1.0, max_rows / max(1, total))
    known = known.where(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < share).groupBy("id").agg(F.max("y").alias("y"))
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # about max_rows ids

    def hashes(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"ord": b["ord"], "y": b["y"], "x": [np.unique(grams(t)).tobytes() for t in b["text"]]}

    scratch = Scratch(docs.sparkSession)
    hashed = arrow_map(drawn.select(order.alias("ord"), "y", "text"), hashes, "ord long, y int, x binary")
    hashed = scratch.write(hashed.withColumn("part", F.shiftright("ord", 60).cast("int")), "hashed", by=["part"])

    def rows() -> Iterator[tuple[bytes, int]]:
        for part in range(-8, 8):  # the highest four bits of a signed number
            found = hashed.where(F.col("part") == part).select("ord", "y", "x").toArrow()
            yield from ((x, y) for _, y, x in sorted(zip(*(c.to_pylist() for c in found.columns))))

    with tempfile.TemporaryFile() as kept:
        model = ftrl(replayed(rows(), EPOCHS, kept))
    scratch.close()
    if len(model.at) or model.bias:
        model.bias = min(model.bias, MOST_BIAS)
    return model


def predict(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row from its whole text alone; null or empty text:
    the score of the bias. The sparse weights are broadcast; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        dense, bias = shared.value.dense(), shared.value.bias
        for b in batches:
            yield {"doc_id": b["id"], "score": [score(t, dense, bias) for t in b["text"]]}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(own, rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more, columns as they were. Scores are made beside the row: no join.

    Where no label can be learnt from, every row stays. Null and empty texts get the score of the bias; repeated rows
    share a fate; columns of docs whose names clash with those of labels don't matter; empty table: no rows."""
    model = fit(docs, labels, id_col, text_col)
    if not len(model.at) and model.bias == 0:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        dense, bias = shared.value.dense(), shared.value.bias
        return lambda text: score(text, dense, bias)

    names = docs.columns
    return docs.withColumn("__toxic", arrow_column(F.col(text_col), scorer, "double", pa.float64())).where(F.col("__toxic") < threshold).select(*names)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Learns from labels, scores documents: one row each, null or empty texts too (the score of the bias)."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
