"""Quality by positive-unlabelled learning: the non-negative unbiased risk over trusted positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out, table

#: Rows that a fit reads at most: trusted positives, and as many unlabelled ones. Steps and rate of the descent.
MAX_ROWS, STEPS, RATE, L2 = 8000, 800, 0.05, 1e-4
#: Hashed trigrams of characters. The fits that estimate the prior: steps, assumed prior.
GRAMS, PRIOR_STEPS, FIRST_PRIOR = 256, 200, 0.5

# Characters that are counted each for itself.
MARKS = "!?*#%&$|<>{}[]/\\=_~^@+-.,;:\"'()"


def shape(text: str | None) -> np.ndarray:
    """Shares that describe the form of the whole text: cases, marks, repetition, lengths; then the square roots of the
    shares of hashed character trigrams of the lower-cased text. No text: zeros."""
    text = text or ""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(c))
    low = np.bincount(c[c < 128], minlength=128)
    upper = low[65:91].sum()
    letters = upper + low[97:123].sum() + (c >= 128).sum()
    marks = np.array([low[ord(m)] for m in MARKS], np.float64)
    words = text.split()
    k = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    ends = sum(not w[-1].isalnum() for w in words)
    shouts = sum(map(str.isupper, words))
    form = np.array(
        [
            upper / max(1, letters), low[48:58].sum() / n, marks.sum() / n, *(marks / n), again / k, len(set(words)) / k, ends / k, shouts / k,
            sum(len(w) == 1 for w in words) / k, (sizes > 20).mean(), min(1.0, sizes.mean() / 40), min(1.0, sizes.std() / 40),
            1 - len(set(lines)) / max(1, len(lines)), len(lines) / k, low[32] / n, low[10] / n, (c >= 128).sum() / n, min(1.0, np.log1p(n) / 16),
        ]
    )
    return np.concatenate([form, trigrams(text)])


def trigrams(text: str) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < 3:
        return np.zeros(GRAMS)
    h = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]) * np.uint32(0x85EBCA6B) + c[2:]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.sqrt(np.bincount(h >> np.uint32(24), minlength=GRAMS) / len(h))


SIZE = len(shape(""))


def expand(x: np.ndarray) -> np.ndarray:
    form = x[..., : SIZE - GRAMS]
    return np.concatenate([x, np.sqrt(form), form * form], axis=-1)


@dataclass
class Model:
    """prior: the estimated share of good text; labelled: the share of 1 among labels, for comparison only."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float
    labelled: float = float("nan")

    def margin(self, shapes: np.ndarray) -> np.ndarray:
        return np.clip((expand(shapes) - self.mean) / self.scale, -6, 6) @ self.weight + self.bias

    def score(self, shapes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(shapes), -30, 30)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the logistic loss, and the
    direction of a step: its gradient, or where the second part is below zero, that part's gradient upwards. The last
    column of p and u is 1."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    loss = lambda x: np.logaddexp(0, -x)
    fp, fu = p @ w, u @ w
    as_negative = loss(-fu).mean() - prior * loss(-fp).mean()
    up = (sigmoid(fu) @ u) / len(u) - prior * (sigmoid(fp) @ p) / len(p)
    down = -prior * (sigmoid(-fp) @ p) / len(p) + up
    return float(prior * loss(fp).mean() + max(0.0, as_negative)), down if as_negative >= 0 else -up


def fit_shapes(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Minimises the non-negative risk of standardised features, with a small L2 penalty, by Adam with a falling rate."""
    every = expand(np.concatenate([positive, unlabelled]))
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p, u = (np.clip((expand(x) - mean) / scale, -6, 6) for x in (positive, unlabelled))
    w, m, v = (np.zeros(p.shape[1] + 1) for _ in range(3))
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    for k in range(1, steps + 1):
        g = risk(w, p, u, prior)[1] + L2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the largest that fits both distributions of scores.

    Above any score lie at least prior times as many of the unlabelled as of the positives. So the prior is at most the
    least ratio of the two shares, over scores that 10 to 98 % of the positives reach; a standard error of the share is
    added. Scores come from a fit to the other half of the rows, each half in turn."""
    found = []
    for own in (0, 1):
        m = fit_shapes(positive[1 - own :: 2], unlabelled[1 - own :: 2], FIRST_PRIOR, PRIOR_STEPS)
        p, u = np.sort(m.margin(positive[own::2])), np.sort(m.margin(unlabelled[own::2]))
        at = np.quantile(p, np.linspace(0.02, 0.9, 45))
        above = [1 - np.searchsorted(x, at) / len(x) for x in (p, u)]
        found.append(np.min((above[1] + np.sqrt(above[1] * (1 - above[1]) / len(u))) / above[0]))
    return min(0.98, max(0.05, float(np.mean(found))))


def _share(total: int, wanted: int) -> float:
    return min(1.0, 1.1 * wanted / max(1, total) + 20 / max(1, total))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model | None:
    """Learns from rows that aren't held out: trusted positives are those labelled 1, unlabelled ones any others, each a
    random max_rows at most by hash of id. The class prior is estimated from these two (estimate_prior; from fewer than 20
    of either it is the share of 1 among the labels), within 0.05 and 0.98. Rows with a null id, label or other label than
    0 and 1 teach nothing; a null text is empty. Without a positive or an unlabelled text there is no model (None)."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not ones:
        return None
    part = F.pmod(F.xxhash64(F.col("id"), F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & ~held_out("id"))
    total = texts.select("id").count()
    positives = known.where((F.col("y") == 1) & (part < _share(ones, max_rows))).select("id").dropDuplicates()

    def shapes(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"ord": b["ord"], "x": [shape(t).astype(np.float32).tobytes() for t in b["text"]]}

    def vectors(rows: DataFrame) -> np.ndarray:
        got = arrow_map(rows.select(F.xxhash64(F.col("id"), F.lit(17)).alias("ord"), "text"), shapes, "ord long, x binary").collect()
        got.sort(key=lambda r: (r["ord"], r["x"]))
        return np.array([np.frombuffer(r["x"], np.float32) for r in got[:max_rows]], np.float64).reshape(-1, SIZE)

    positive = vectors(texts.join(F.broadcast(positives), "id"))  # about 1.1 max_rows ids
    unlabelled = vectors(texts.where(part < _share(total, max_rows)))
    if not len(positive) or not len(unlabelled):
        return None
    labelled = ones / n
    prior = estimate_prior(positive, unlabelled) if min(len(positive), len(unlabelled)) >= 20 else min(0.98, max(0.05, labelled))
    model = fit_shapes(positive, unlabelled, prior)
    model.labelled = labelled
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier good) of every row from its whole text alone; without a model 0.5. Null
    text is empty; repeated rows are scored each for itself; empty table: no rows. A few hundred numbers are broadcast; no
    shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            m = shared.value
            yield {"doc_id": b["id"], "score": m.score(np.array([shape(t) for t in b["text"]])) if m else [0.5] * len(b["id"])}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(own, rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Learns from labels, scores documents: one row each, null and empty texts too."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
