"""Rule-based reranking of candidates by their text and metadata, and a registry of strategies."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written
from .search import DEFAULT_K, candidate_limit, search


@dataclass(frozen=True)
class RuleConfig:
    """Weights, boosts and constants of the rule strategy."""

    original: float = 0.5
    bm25: float = 0.25
    keyword: float = 0.15
    coverage: float = 0.05
    recency: float = 0.05
    exact_boost: float = 0.3
    title_boost: float = 0.2
    fuzzy_boost: float = 0.05
    k1: float = 1.2
    b: float = 0.75
    boosts: dict[str, float] = field(default_factory=dict)
    penalties: dict[str, float] = field(default_factory=dict)
    recency_field: str = "created_at"
    recency_days: float = 30
    half_life_days: float = 7
    stop_words: tuple[str, ...] = tuple(T.STOP_WORDS)
    case_sensitive: bool = False

    def __post_init__(self):
        total = self.original + self.bm25 + self.keyword + self.coverage + self.recency
        if not 0 <= total <= 2 or not 0 <= self.b <= 1 or self.k1 < 0:
            raise ValueError("weights sum to 0..2, b is within 0..1, k1 isn't negative")


def parse_pairs(s: str) -> dict[str, float]:
    """k:v,k:v"""
    pairs = (p.split(":", 1) for p in s.split(",") if ":" in p)
    return {k.strip(): float(v) for k, v in pairs}


def load_config(source: Mapping[str, str] | str, prefix: str = "RERANK_") -> RuleConfig:
    """A configuration from JSON, or from a mapping such as os.environ: names in capitals after prefix, maps as k:v,k:v,
    lists with commas. What isn't there keeps its default; bad values and ranges are errors."""
    if isinstance(source, str):
        given = json.loads(source)
        unknown = set(given) - {f.name for f in fields(RuleConfig)}
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return RuleConfig(**given | ({"stop_words": tuple(given["stop_words"])} if "stop_words" in given else {}))
    found: dict = {}
    for f in fields(RuleConfig):
        if (value := source.get(prefix + f.name.upper())) is None:
            continue
        if f.name in ("boosts", "penalties"):
            found[f.name] = parse_pairs(value)
        elif f.name == "stop_words":
            found[f.name] = tuple(w.strip() for w in value.split(",") if w.strip())
        elif f.name == "case_sensitive":
            found[f.name] = value.strip().lower() in ("1", "true", "yes")
        else:
            found[f.name] = value if f.name == "recency_field" else float(value)
    return RuleConfig(**found)


def validate(candidates: DataFrame) -> DataFrame:
    """The candidates, or an error at run time for a blank id or a score that isn't finite."""
    bad = (F.trim(F.coalesce(F.col("id").cast("string"), F.lit(""))) == "") | F.coalesce(F.isnan("score") | (F.abs(F.col("score").cast("double")) == float("inf")), F.lit(True))
    return candidates.withColumn("id", F.when(bad, F.raise_error(F.lit("blank id or score that isn't finite"))).otherwise(F.col("id")))


def recency(value: Column, as_of: datetime, days: float = 30, half_life: float = 7) -> Column:
    """exp(-0.693 * age / half-life) of a parsed time; 0 if older than days, missing or unreadable. The future is over 1."""
    age = (F.lit(as_of).cast("timestamp").cast("double") - T.parse_timestamp(value).cast("double")) / 86400
    return F.coalesce(F.when(age <= days, F.exp(-0.693 * age / (half_life if half_life > 0 else 7))), F.lit(0.0))


def metadata_score(payload: Column, boosts: dict[str, float], penalties: dict[str, float]) -> Column:
    on = lambda k: F.coalesce(payload[k].isin("true", "1"), F.lit(False))
    signed = [*boosts.items(), *((k, -w) for k, w in penalties.items())]
    return sum((F.when(on(k), F.lit(float(w))).otherwise(0.0) for k, w in signed), F.lit(0.0))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row. The optimizer would put an expression in place of each later
    reference to it, also within lambdas, where it runs again for each element; it doesn't look through a generator."""
    out = df.withColumn("__pin", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return out.select(*df.columns, "__pin.*")


def signals(candidates: DataFrame, config: RuleConfig = RuleConfig(), as_of: datetime = datetime(2024, 2, 1)) -> DataFrame:
    """candidates (qid, query, id, score, payload) with tokens and every signal.

    Texts are tokenised once per candidate row. What a query needs from its candidates (how many, how many have each of
    its tokens, their mean length) comes from one aggregate per query that combines before the shuffle, of arrays no
    longer than the query; it is joined back by qid."""
    stops = list(config.stop_words)
    q = T.tokenize(F.col("query"), stops, config.case_sensitive)
    text = T.payload_text(F.col("payload"))
    base = pinned(candidates, q_tokens=q, tokens=T.tokenize(text, stops, config.case_sensitive), low_text=F.lower(text), low_title=F.lower(F.coalesce(F.col("payload")["title"], F.lit(""))))
    base = pinned(base, found=F.array_intersect("q_tokens", "tokens"))  # by hash, and no longer than the query
    base = pinned(base, hits=F.transform("q_tokens", lambda t: F.array_contains("found", t).cast("int")))
    each = base.select("qid", F.size("tokens").alias("len"), F.posexplode_outer("hits").alias("i", "hit")).groupBy("qid", "i").agg(F.sum("hit").alias("df"), F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len"))
    idf = F.log(F.col("n") / F.when(F.col("df") > 0, F.col("df")).otherwise(1).cast("double") + 1)
    stats = each.groupBy("qid").agg(F.max("n").alias("candidates"), F.max("mean_len").alias("mean_len"), F.sort_array(F.collect_list(F.struct("i", F.when(F.col("i").isNotNull(), idf).alias("idf")))).alias("idfs"))
    joined = base.join(stats, "qid")
    n_query, n_text = F.size("q_tokens"), F.size("tokens")
    phrase = F.lower(F.array_join("q_tokens", " "))
    matched = F.aggregate("hits", F.lit(0), lambda s, x: s + x)
    some = (n_query > 0) & (n_text > 0)
    mean_idf = F.aggregate("idfs", F.lit(0.0), lambda s, x: s + F.coalesce(x["idf"], F.lit(0.0))) / n_query
    share = F.when(n_query > 0, matched / n_query).otherwise(0.0)
    in_text, in_title = F.contains("low_text", phrase), F.contains("low_title", phrase)
    keyword = F.when(in_text, config.exact_boost).otherwise(0.0) + F.when(in_title, config.title_boost).otherwise(0.0) + config.fuzzy_boost * share
    return joined.select(
        "qid", "query", "id", "score", "payload", "q_tokens", "tokens", "candidates", "mean_len",
        F.when(some, 0.5 * mean_idf).otherwise(0.0).alias("bm25"),  # its saturation cancels to a half
        F.when(n_query > 0, keyword).otherwise(0.0).alias("keyword"),
        F.when(some, share).otherwise(0.0).alias("coverage"),
        recency(F.col("payload")[config.recency_field], as_of, config.recency_days, config.half_life_days).alias("recency"),
        metadata_score(F.col("payload"), config.boosts, config.penalties).alias("meta"),
        matched.alias("matched"), (F.coalesce(F.get("hits", F.lit(0)), F.lit(0)) > 0).alias("first_hit"), (in_title & (n_query > 0)).alias("title_hit"),
    )


def rule(candidates: DataFrame, top_n: int, config: RuleConfig = RuleConfig(), as_of: datetime = datetime(2024, 2, 1)) -> DataFrame:
    """qid, rank, id, rerank_score (0 to 1), original_score, explanation; by score, then id. An empty query: by the
    original score. Scores have nine digits, so that ranks don't hang on the order of a sum."""
    s = signals(candidates, config, as_of)
    total = config.original * F.col("score") + config.bm25 * F.col("bm25") + config.keyword * F.col("keyword") + config.coverage * F.col("coverage") + config.recency * F.col("recency") + F.col("meta")
    blank = F.size("q_tokens") == 0
    explained = F.concat_ws(", ", F.when(F.col("first_hit"), "exact match"), F.when(F.col("title_hit"), "title match"), F.when(F.col("matched") > 0, F.concat(F.lit("+"), F.col("matched"), F.lit(" tokens"))))
    explained = F.when(blank, "sorted by original score").when(explained == "", "keyword relevance").otherwise(explained)
    scored = s.select("qid", "id", F.round(F.when(blank, F.col("score")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))), 9).alias("rerank_score"), F.col("score").alias("original_score"), explained.alias("explanation"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "id")))
    return ranked.where(F.col("rank") <= top_n)


def identity(candidates: DataFrame, top_n: int) -> DataFrame:
    """The first top_n in the order of the original score, unchanged."""
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "id")))
    return ranked.where(F.col("rank") <= top_n).select("qid", "id", F.col("score").alias("rerank_score"), F.col("score").alias("original_score"), F.lit("").alias("explanation"), "rank")


def bm25(tokens: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Textbook BM25 over an exploded index: tokens (id, tokens), queries (qid, q_tokens) -> qid, id, bm25.

    One pass over tokens writes the postings of the queries' words, and a row without a word for each document; counts and
    the mean length come from that table. The words are joined as a table, which Spark broadcasts below its checked
    threshold."""
    words = queries.select("qid", F.explode(F.array_distinct("q_tokens")).alias("token"))
    every = tokens.select("id", F.size("tokens").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("tokens"))).alias("token"))
    asked = every.join(words.select(F.col("token").alias("asked")).distinct(), F.col("token") == F.col("asked"), "left").where("token IS NULL OR asked IS NOT NULL")
    postings = written(asked.groupBy("id", "len", "token").agg(F.count(F.lit(1)).alias("tf")), "postings")
    n, mean = postings.where("token IS NULL").agg(F.sum("tf"), F.sum(F.col("tf") * F.col("len")) / F.sum("tf")).first()
    postings = postings.where("token IS NOT NULL")
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + ((n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (mean or 1)))
    return postings.join(df, "token").join(words, "token").groupBy("qid", "id").agg(F.sum(weight).alias("bm25"))


def similarity(distance: Column, metric: str, mode: str = "similarity") -> Column:
    """Search distances as the scores that rerankers expect, higher for nearer; mode raw leaves them."""
    if mode == "raw":
        return distance
    return 1 - distance if metric == "cosine" else -distance if metric == "dot" else 1 / (1 + distance)


STRATEGIES: dict[str, Callable] = {"rule": rule, "llm": identity, "rl": identity}


def rerank(candidates: DataFrame, top_n: int, strategy: str = "rule", **options) -> DataFrame:
    if top_n <= 0:
        raise ValueError("top_n must be positive")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](validate(candidates), top_n, **options)


def search_rerank(points: DataFrame, vector: list[float], query: str = "", k: int = DEFAULT_K, metric: str = "cosine", strategy: str = "rule", mode: str = "similarity", enabled: bool = True, **options) -> DataFrame:
    """A search whose hits are reranked by a text query: rank, id, score, explanation, payload.

    More hits than k are fetched (candidate_limit), their distances become similarities (mode raw leaves them), and the
    strategy orders them. Without a query, or where reranking is off, these are the k nearest, scored by similarity."""
    asked = bool(query.strip()) and enabled
    hits = search(points, vector, candidate_limit(k, query, asked), metric, carry=["payload"])
    near = hits.select("id", similarity(F.col("score"), metric, mode).alias("score"), F.col("rank").alias("place"), "payload")
    if not asked:
        return near.select(F.col("place").alias("rank"), "id", "score", F.lit("").alias("explanation"), "payload")
    found = rerank(near.select(F.lit(0).alias("qid"), F.lit(query).alias("query"), "id", "score", "payload"), k, strategy, **options)
    return found.select("rank", "id", F.col("rerank_score").alias("score"), "explanation").join(near.select("id", "payload"), "id").select("rank", "id", "score", "explanation", "payload")


def invalidate(cache: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """A cache table without the rows of keys, or empty."""
    return cache.join(keys.select("key"), "key", "left_anti") if keys is not None else cache.limit(0)
