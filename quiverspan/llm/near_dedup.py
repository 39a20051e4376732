"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, table
from .components import connected_components

#: Words of a shingle; bands and minima of a band: a pair of similarity 0.8 shares no band in 1.5 cases of 100,000, one
#: of 0.85 in 7 of 100 million.
WORDS, BANDS, ROWS = 5, 28, 5
#: A pair is confirmed on its sets unless its signatures agree less than the threshold by this (over 5 deviations).
SLACK = 0.18
#: Shingles that are hashed at a time.
BLOCK = 2048

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes. A-Z are lower-cased; words are parted by space and
    control characters 9 to 13, as bytes.split() does; fewer words than a shingle has are one shingle; no word: none."""
    digest = xxhash.xxh3_64_intdigest
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(digest, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out ^= out >> np.uint64(29)
        out = (out + h[i : len(h) - k + 1 + i]) * _MIX[i % len(_MIX)]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """For each of the universal functions (a * x + b) >> 32, its least value over the set."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), BLOCK):
        block = found[i : i + BLOCK]
        hashed = _A[:, None] * block[None, :]
        hashed += _B[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest of the set (16 bytes), signature (4 bytes a minimum; null for an empty set)."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"id": b["id"], "n_shingles": [], "digest": [], "sig": []}
            for t in b["text"]:
                found = shingles(t)
                out["n_shingles"].append(len(found))
                out["digest"].append(xxhash.xxh3_128_digest(found.tobytes()))
                out["sig"].append(minima(found).tobytes() if len(found) else None)
            yield out

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(own, rows, f"id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, digest binary, sig binary")


def band_keys(reps: DataFrame) -> DataFrame:
    """(id, key) for each band: a hash of the band's number and minima."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        digest = xxhash.xxh3_64_intdigest
        width = 4 * ROWS
        for b in batches:
            keys = [digest(s[k * width : (k + 1) * width], seed=k) for s in b["sig"] for k in range(BANDS)]
            yield {"id": [i for i in b["id"] for _ in range(BANDS)], "key": np.array(keys, np.uint64).view(np.int64)}

    return arrow_map(reps.select("id", "sig"), rows, f"id {reps.schema['id'].dataType.simpleString()}, key long")


def agreeing(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in a share of least or more."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            one, two = (np.frombuffer(b"".join(b[c]), np.uint32).reshape(len(b["a"]), -1) for c in ("sig_a", "sig_b"))
            ok = (one == two).mean(axis=1) >= least
            yield {c: [x for x, y in zip(b[c], ok) if y] for c in ("a", "b")}

    kind = reps.schema["id"].dataType.simpleString()
    with_b = pairs.join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return arrow_map(with_b.join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").select("a", "b", "sig_a", "sig_b"), rows, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets of shingles; texts: id, text."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        last: tuple = (None, None)  # rows come sorted by a
        for b in batches:
            ok = []
            for a, ta, tb in zip(b["a"], b["text_a"], b["text_b"]):
                if last[0] != a or last[1] is None:
                    last = a, shingles(ta)
                one, two = last[1], shingles(tb)
                both = len(np.intersect1d(one, two, assume_unique=True))
                ok.append(100 * both >= percent * (len(one) + len(two) - both))
            yield {c: [x for x, y in zip(b[c], ok) if y] for c in ("a", "b")}

    kind = pairs.schema["a"].dataType.simpleString()
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    whole = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return arrow_map(whole.select("a", "b", "text_a", "text_b"), rows, f"a {kind}, b {kind}")


def across_components(texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of different components that can reach the threshold by prefix and position filters.

    texts: id, text, component. With shingles in one order for all texts, rarest first, two sets that reach the
    threshold share one among the first few: of the smaller, n - ceil(2pn / (100 + p)) + 1; of the larger,
    n - ceil(pn / 100) + 1. A common shingle too far back in either leaves too few behind it. What a copy has alone
    comes first in its order, so copies that differ too much have no common prefix, however many they are. Frequencies
    are counted exactly, and shingles of one text alone only count as places.

    Rows of a shingle's largest component are never paired with each other: rows outside of it are, with all others. And
    only those whose place is near enough to the front for some row of another component: for each shingle and size, the
    most forward place is known, and sizes are few, whatever the rows."""
    kind = texts.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            sizes = [len(x) for x in sets]
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield {"id": b["id"], "component": b["component"], "n": sizes, "hs": pa.ListArray.from_arrays(np.cumsum([0, *sizes], dtype=np.int32), values)}

    sets = scratch.write(arrow_map(texts.select("id", "component", "text"), rows, f"id {kind}, component {kind}, n int, hs array<long>"), "sets")
    each = sets.select("id", "component", "n", F.explode("hs").alias("h"))
    common = scratch.write(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    order = Window.partitionBy("id").orderBy("df", "h")
    placed = each.join(common, "h").withColumn("at", F.row_number().over(order)).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("id")))
    placed = placed.select("id", "component", "n", "h", (F.col("n") - F.col("shared") + F.col("at")).alias("at"))
    probes = scratch.write(placed.where(f"at <= n - ceil({percent} * n / 100.0D) + 1"), "prefixes")
    scratch.drop(sets)

    parts = probes.groupBy("h", "n", "component").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("at"))
    parts = scratch.write(parts, "parts")
    largest = parts.groupBy("h", "component").agg(F.sum("rows").alias("rows")).groupBy("h")
    largest = largest.agg(F.max(F.struct("rows", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("components")).where("components > 1")
    largest = scratch.write(largest.select("h", "largest"), "largest")
    sizes = parts.groupBy("h", "n").agg(F.min("at").alias("at"), F.min("component").alias("low"), F.max("component").alias("high"))
    sizes = scratch.write(sizes.join(largest, "h", "left_semi"), "sizes")
    side = lambda df, x, *names: df.select("h", *(F.col(c).alias(f"{c}_{x}") for c in names))
    small = f"least(n_a, n_b) - ceil({2 * percent} * least(n_a, n_b) / {100 + percent}.0D) + 1"
    alike = f"100L * least(n_a, n_b) >= {percent}L * greatest(n_a, n_b)"
    place = f"1 + n_{{0}} - ceil({percent} * (n_a + n_b) / {100 + percent}.0D)"
    most = F.expr(f"if(n_a <= n_b, least({place.format('a')}, {small}), if(at_b <= {small}, {place.format('a')}, 0))")
    met = side(sizes, "a", "n", "at", "low", "high").join(side(sizes, "b", "n", "at", "low", "high"), "h")
    met = met.where(f"{alike} AND at_b <= {place.format('b')} AND NOT (low_a = high_a AND low_b = high_b AND low_a = low_b)")
    live = scratch.write(met.groupBy("h", F.col("n_a").alias("n")).agg(F.max(most).alias("most")).where("most > 0"), "live")
    some = scratch.write(probes.join(live, ["h", "n"]).where("at <= most").drop("most").join(largest, "h"), "some")
    outside = side(some.where("component <> largest"), "a", "id", "component", "n", "at")
    fits = f"component_a <> component_b AND {alike} AND at_a <= {place.format('a')} AND at_b <= {place.format('b')} AND if(n_a <= n_b, at_a, at_b) <= {small}"
    pairs = outside.join(side(some, "b", "id", "component", "n", "at"), "h").where(fits)
    return pairs.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Every row's class: doc_id, n_shingles, component_id (the smallest id reachable over links), kept.

    Documents link when 100 * intersection >= percent * union of their shingle sets. A document without a word has an
    empty set and no link. Rows that share an id and a set are one document; rows that share an id but not the set are
    judged each by its own, under the same id. A row with a null id has a null component and is kept. Empty table: no
    rows. Other columns are ignored.

    1. One pass makes set sizes, set digests and signatures. Equal sets become one representative, by an aggregate that
       combines before the shuffle.
    2. Bands of equal minima are buckets; those of one representative go. In each, the member that shares most buckets
       with others is the pivot: the common original of a group of copies, if there is one. Each representative is
       paired with the pivot it meets most often, one pair each, verified by signature, then on full sets.
    3. Components of those links. A bucket whose members are in one component is settled. The members of all others are
       searched for links between components by prefix filtering, exact for the threshold; what it finds is verified
       likewise. So groups of copies are never paired out, linked or not.
    4. Components of all links, by alternating large-star and small-star.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = scratch.write(signatures(docs, id_col, text_col), "signatures")
    some = rows.where("n_shingles > 0 AND id IS NOT NULL")
    reps = scratch.write(some.groupBy("digest").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), "representatives")

    keys = scratch.write(band_keys(reps), "keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    live = scratch.write(keys.join(scratch.write(sizes, "sizes"), "key"), "live")
    scratch.drop(keys)
    common = live.groupBy("id").agg(F.sum("size").alias("common"))
    pivots = live.join(common, "id").groupBy("key").agg(F.max(F.struct("common", "id"))["id"].alias("pivot"))
    met = live.join(scratch.write(pivots, "pivots"), "key").where("id <> pivot").groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("times"))
    first = met.groupBy("id").agg(F.max(F.struct("times", "pivot"))["pivot"].alias("pivot"))

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(scratch.write(live.select("id").distinct(), "ids"), "id")
    texts = scratch.write(texts.dropDuplicates(["id"]), "texts")
    least = max(0.0, percent / 100 - SLACK)

    def links(pairs: DataFrame, name: str) -> DataFrame:
        candidates = scratch.write(agreeing(scratch.write(pairs, f"{name}-pairs"), reps, least), f"{name}-candidates")
        return scratch.write(confirmed(candidates, texts, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-links")

    one = links(first.select(F.col("pivot").alias("a"), F.col("id").alias("b")), "first")
    part = scratch.write(connected_components(one, scratch), "components")
    placed = live.select("id", "key").join(part.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = scratch.write(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_rows = placed.join(scratch.write(open_keys, "open-keys"), "key").select("id", "component").distinct()
    rest = across_components(texts.join(scratch.write(open_rows, "open"), "id"), percent, scratch)
    two = links(rest, "rest")

    final = scratch.write(connected_components(one.union(two), scratch), "components").select(F.col("node").alias("rep"), "component")
    classes = scratch.write(some.groupBy("digest").agg(F.min("id").alias("rep")).join(final, "rep", "left").select("digest", F.coalesce("component", "rep").cast(kind).alias("component")), "classes")
    scratch.keep(rows, classes)
    has = rows.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    found = has.join(classes, "digest", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with one document of each component, columns as they were. Documents without a word, with a null text or a
    null id stay, and so do all rows that repeat the id which stays; empty table: no rows."""
    scratch = Scratch(docs.sparkSession)
    gone = near_duplicates(docs, id_col, text_col, percent, scratch).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = scratch.write(gone, "gone")
    scratch.keep(gone)
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """near_duplicates over documents, at 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES = {"op1_near_dedup": op1_near_dedup}
