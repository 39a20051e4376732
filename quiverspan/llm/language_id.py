"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_out, table

# Languages by family (ISO 639-1). A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "iranian": "fa ps ku tg",
    "celtic": "ga cy br gd",
    "austronesian": "id ms tl jv",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

#: Hashed character n-grams (1 to 3) of letters; labelled rows that a fit reads at most, over all languages; tags that a
#: fit learns at most (the commonest), so that dirty tags make no model without bound.
DIM, MAX_ROWS, MAX_LANGS = 4096, 3000, 100
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram shares over the whole text; None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, np.uint32(32))
    c = np.concatenate(([np.uint32(32)], c, [np.uint32(32)]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))].astype(np.uint32)
    if len(c) < 2:
        return None
    one = c * np.uint32(0x9E3779B1)
    two = one[:-1] * np.uint32(0x85EBCA6B) + one[1:] + np.uint32(1)
    three = two[:-1] * np.uint32(0xC2B2AE35) + one[2:] + np.uint32(2)
    x = np.zeros(DIM, np.float32)
    for grams in (one, two, three):
        if len(grams):
            g = grams ^ (grams >> np.uint32(15))
            x += np.bincount((g * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIM).astype(np.float32) / len(grams)
    x = np.sqrt(x)
    return x / np.linalg.norm(x)


def fit_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Linear SVM (squared hinge, classes weighted alike) by accelerated gradient; y of -1 and 1; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = np.float32(1 / (4 + l2))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (l2 * v - 2 * ((share * slack * y) @ x))
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    """Linear separators: one for each family against the rest, one for each pair of languages of a family."""

    families: list[str] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    of_family: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM + 1), np.float32))
    of_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return UNKNOWN, 0.0
        x = np.append(x, np.float32(1))
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            margins = 3 * (self.of_family @ x)
            p = np.exp(margins - margins.max())
            family, sure = self.families[int(p.argmax())], float(p.max() / p.sum())
        votes = {lang: [0, 0.0] for lang in self.langs[family]}
        for a, b in combinations(self.langs[family], 2):
            margin = float(self.of_pair[a, b] @ x)
            for lang, m in ((a, margin), (b, -margin)):
                votes[lang][0] += m > 0
                votes[lang][1] += m
        best = max(votes, key=lambda lang: (votes[lang], lang))
        if len(votes) > 1:
            sure *= 1 / (1 + np.exp(-3 * votes[best][1] / (len(votes) - 1)))
        return best, min(1.0, max(0.0, float(sure)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Learns from rows that aren't held out, with a lang and a letter: counts over all of them, then for each of the
    MAX_LANGS commonest languages a random sample by hash of id, max_rows together. No such rows: a model that knows no
    language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["rows"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return Model()
    each = max(2, max_rows // len(counts))
    share = F.create_map(*(F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, 1.3 * each / n + 20 / n))))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])

    def vectors(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [(lang, i, v) for lang, i, t in zip(b["lang"], b["order"], b["text"]) if (v := features(t)) is not None]
            yield {"lang": [x[0] for x in found], "ord": [x[1] for x in found], "x": [x[2].astype(np.float16).tobytes() for x in found]}

    got = arrow_map(drawn.select("lang", F.xxhash64(F.col("id"), F.lit(7)).alias("order"), "text"), vectors, "lang string, ord long, x binary").collect()
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["ord"])):
        if len(by.setdefault(r["lang"], [])) < each:
            by[r["lang"]].append(np.frombuffer(r["x"], np.float16).astype(np.float32))
    return fit_vectors({lang: np.stack(x) for lang, x in by.items()})


def fit_vectors(by: dict[str, np.ndarray]) -> Model:
    model = Model()
    for lang in sorted(by):
        model.langs.setdefault(FAMILY_OF.get(re.split("[-_]", lang.lower())[0], lang), []).append(lang)  # en-GB counts as en
    model.families = sorted(model.langs)
    if not by:
        return model
    if len(model.families) > 1:
        x = np.concatenate([by[lang] for lang in sorted(by)])
        at = np.concatenate([[f] * len(by[lang]) for lang in sorted(by) for f in [next(k for k, v in model.langs.items() if lang in v)]])
        model.of_family = np.stack([fit_svm(x, np.where(at == f, 1, -1).astype(np.float32)) for f in model.families])
    for langs in model.langs.values():
        for a, b in combinations(langs, 2):
            y = np.concatenate([np.ones(len(by[a]), np.float32), -np.ones(len(by[b]), np.float32)])
            model.of_pair[a, b] = fit_svm(np.concatenate([by[a], by[b]]), y)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row from its whole text alone; 'und' and 0 if null or without a letter.

    The model is broadcast: DIM + 1 floats for each family and each pair within one. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            got = [(UNKNOWN, 0.0) if (x := features(t)) is None else shared.value.predict(x) for t in b["text"]]
            yield {"doc_id": b["id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(own, rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from documents and predicts for all of them; null texts, and those without a letter, are und."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
