"""Views of the test tables in the roles of the data model: points, workers, shards, change logs, feedback."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, micros, tokenize
from ..operators.rerank import bm25
from ..operators.search import candidate_limit, top

AS_OF = datetime(2024, 1, 31)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def queries(spark, sf_dir) -> DataFrame:
    """Every vector whose id is divisible by 100."""
    return points(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))


def first_vector(spark, sf_dir) -> list[float]:
    return points(spark, sf_dir).where("id = 0").first()["vector"]


def segments(spark, sf_dir) -> DataFrame:
    """Points as segment rows; those divisible by 7 also lie in the segment before with a reversed vector."""
    p = points(spark, sf_dir)
    new = p.select("id", "vector", (F.col("id") % 4 + 4).alias("segment"), F.col("id").alias("ts"))
    return new.unionByName(p.where("id % 7 = 0").select("id", F.reverse("vector").alias("vector"), (F.col("id") % 4 + 3).alias("segment"), F.col("id").alias("ts")))


def tombstones(spark, sf_dir) -> DataFrame:
    """Ids divisible by 5: those divisible by 10 later than the point, the others earlier."""
    return points(spark, sf_dir).where("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, F.col("id") + 1).otherwise(F.col("id") - 1).alias("ts"))


SEGMENTS_SQL = """seg AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS vector, vec_id % 4 + 4 AS segment, vec_id AS ts FROM embeddings
  UNION ALL SELECT vec_id, list_reverse(embedding::DOUBLE[]), vec_id % 4 + 3, vec_id FROM embeddings WHERE vec_id % 7 = 0),
tomb AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN vec_id + 1 ELSE vec_id - 1 END AS ts FROM embeddings WHERE vec_id % 5 = 0),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY segment DESC, ts DESC) AS rn FROM seg) WHERE rn = 1),
live AS (SELECT n.* FROM newest n WHERE NOT EXISTS (SELECT 1 FROM tomb t WHERE t.id = n.id AND n.ts <= t.ts))"""


def change_log(spark, sf_dir) -> DataFrame:
    """Events by user as a log: an 'error' deletes."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), micros(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("is_delete"))


LOG_SQL = "log AS (SELECT user_id AS id, epoch_us(ts) AS ts, event_id AS seq, value, event_type = 'error' AS is_delete FROM events)"


def workers(spark, sf_dir) -> DataFrame:
    """Suppliers as workers: nations are racks, regions zones."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    key = F.col("s_suppkey")
    w = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("worker"), (key % 97).cast("double").alias("cpu"), (key * 7 % 89).cast("double").alias("memory"), (key * 13 % 83).cast("double").alias("disk"), (key * 31 % 1700).cast("double").alias("qps"), (key * 3 % 140).alias("shards"),
        (key * 11 % 900).alias("capacity"), F.col("n_regionkey").alias("zone"), F.col("n_nationkey").alias("rack"), F.when(key % 9 == 0, "draining").when(key % 8 == 0, "joining").otherwise("ready").alias("state"),
        F.when(key % 10 == 3, "search_only").otherwise("data").alias("role"), (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(secs=(key % 40).cast("decimal(18,6)"))).alias("heartbeat"),
    )
    from ..operators.cluster import load_score

    load = load_score(F.col("cpu"), F.col("memory"), F.col("disk"), F.col("qps"), F.col("shards"))
    return w.withColumn("load", load).withColumn("ratio", load / F.greatest(F.col("capacity"), F.lit(100)))


WORKERS_SQL = """w0 AS (
  SELECT s_suppkey AS worker, (s_suppkey % 97)::DOUBLE AS cpu, (s_suppkey * 7 % 89)::DOUBLE AS memory, (s_suppkey * 13 % 83)::DOUBLE AS disk, (s_suppkey * 31 % 1700)::DOUBLE AS qps,
         s_suppkey * 3 % 140 AS shards, s_suppkey * 11 % 900 AS capacity, n_regionkey AS zone, n_nationkey AS rack,
         CASE WHEN s_suppkey % 9 = 0 THEN 'draining' WHEN s_suppkey % 8 = 0 THEN 'joining' ELSE 'ready' END AS state,
         CASE WHEN s_suppkey % 10 = 3 THEN 'search_only' ELSE 'data' END AS role, s_suppkey % 40 AS age
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w1 AS (SELECT *, 0.3::DOUBLE * cpu + 0.3::DOUBLE * memory + 0.15::DOUBLE * disk + 15 * least(qps / 1000, 1.0::DOUBLE) + 10 * least(shards / 100.0::DOUBLE, 1.0::DOUBLE) AS load, state = 'ready' AND age < 30 AS healthy FROM w0),
w AS (SELECT *, load / greatest(capacity, 100) AS ratio, healthy AND role <> 'search_only' AS eligible FROM w1)"""


def shards(spark, sf_dir) -> DataFrame:
    """Orders by customer bucket as shards: their replicas are suppliers, each shard two to five of them."""
    n = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    o = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 64).alias("shard")).agg(F.count(F.lit(1)).alias("points"))
    own = F.transform(F.sequence(F.lit(0), (F.col("shard") % 4 + 1).cast("int")), lambda i: (F.col("shard") * 5 + i * 17) % F.col("n") + 1)
    s = o.join(F.broadcast(n)).select("shard", "points", F.array_distinct(own).alias("replicas"), (F.col("shard") * 37 % 1500).cast("double").alias("qps"), (F.col("shard") * 11 % 160).cast("double").alias("latency_ms"))
    return s.withColumn("leader", F.when(F.col("shard") % 13 != 0, F.col("replicas")[0])).withColumn("epoch", F.lit(1).cast("long"))


SHARDS_SQL = """s0 AS (SELECT o_custkey % 64 AS shard, count(*) AS points FROM orders GROUP BY 1),
sn AS (SELECT count(*) AS n FROM supplier),
r AS (SELECT DISTINCT shard, (shard * 5 + i * 17) % n + 1 AS worker FROM s0, sn, range(0, 5) t(i) WHERE i <= shard % 4 + 1),
s AS (SELECT shard, points, (shard * 37 % 1500)::DOUBLE AS qps, (shard * 11 % 160)::DOUBLE AS latency_ms, shard % 13 = 0 AS leaderless FROM s0),
hc AS (SELECT s.shard, count(w.worker) AS healthy_replicas, count(r.worker) AS replicas FROM s JOIN r USING (shard) LEFT JOIN w ON w.worker = r.worker AND w.healthy GROUP BY 1)"""


def sessions(spark, sf_dir) -> DataFrame:
    """Each user's events of a day as a session; the collection is the user's number modulo 3."""
    e = read(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.groupBy("user_id", day.alias("day")).agg(F.min("ts").alias("created_at")).select(F.concat_ws("/", F.col("user_id"), "day").alias("id"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("collection"), F.col("day").alias("query"), "created_at")


def items(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.select(F.concat_ws("/", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"), F.col("event_id").alias("result_id"), (F.col("event_id") % 5 + 1).cast("int").alias("relevance_score"), (F.col("event_type") == "click").alias("clicked"), F.col("event_id").alias("position"))


FEEDBACK_SQL = """sess AS (SELECT user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS id, 'c' || (user_id % 3) AS collection, min(ts) AS created_at FROM events GROUP BY 1, 2),
item AS (SELECT user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS session_id, event_id AS result_id, event_id % 5 + 1 AS relevance_score, event_type = 'click' AS clicked, event_id AS position FROM events WHERE event_type <> 'error')"""


def request_log(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_type", (F.col("event_id") % 2).alias("method"), F.col("value").alias("latency"), (F.col("event_type") == "error").alias("failed"), micros(F.col("ts")).alias("us"), "ts", "user_id", F.col("event_id").alias("seq"))


def documents(spark, sf_dir) -> DataFrame:
    """Documents as points with a payload: labels are flags, and times are written in four ways, one of them unreadable."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    flagged = d.join(lab.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    seconds = F.lit(1706659200) - (F.col("doc_id") % 50 - 3) * 86400
    iso = F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    when = F.when(F.col("doc_id") % 4 == 0, seconds.cast("string")).when(F.col("doc_id") % 4 == 1, (seconds * 1000).cast("string")).when(F.col("doc_id") % 4 == 2, iso).otherwise("soon")
    flag = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    payload = F.create_map(F.lit("title"), F.concat(F.col("source"), F.lit(" "), F.coalesce("lang", F.lit(""))), F.lit("content"), F.coalesce("text", F.lit("")), F.lit("good"), flag("quality"), F.lit("bad"), flag("toxic"), F.lit("created_at"), when)
    return flagged.select(F.col("doc_id").alias("id"), payload.alias("payload"))


def asked(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


#: Candidates of a query that wants 100 documents.
FETCHED = candidate_limit(100, "a query")


def hits(spark, sf_dir) -> DataFrame:
    """For each benchmark item whose id is divisible by 100, the documents that BM25 finds, as many as reranking fetches."""
    tokens = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tokenize(F.col("text")).alias("tokens"))
    found = bm25(tokens, asked(spark, sf_dir).select("qid", tokenize(F.col("query")).alias("q_tokens"))).withColumn("bm25", F.round("bm25", 6))
    return top(found.select("qid", "id", (-F.col("bm25")).alias("score")), FETCHED).select("qid", "id", (F.col("score") / (F.col("score") - 10)).alias("score"))


def candidates(spark, sf_dir) -> DataFrame:
    return hits(spark, sf_dir).join(documents(spark, sf_dir), "id").join(asked(spark, sf_dir), "qid").select("qid", "query", "id", "score", "payload")


STOPS_SQL = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens_sql(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace(lower({text}), '[^\\w\\s]+', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda x: strlen(x) > 1 AND NOT list_contains({STOPS_SQL}, x))"


BM25_SQL = f"""bt AS (SELECT doc_id AS id, {tokens_sql("text")} AS tokens FROM documents), bs AS (SELECT count(*) AS n, avg(len(coalesce(tokens, []))) AS mean FROM bt),
bq AS (SELECT DISTINCT item_id AS qid, unnest({tokens_sql("text")}) AS token FROM benchmark WHERE item_id % 100 = 0), bp AS (SELECT id, len(tokens) AS len, unnest(tokens) AS token FROM bt),
tf AS (SELECT id, len, token, count(*) AS tf FROM bp WHERE token IN (SELECT token FROM bq) GROUP BY 1, 2, 3), bd AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS bm25 FROM tf JOIN bd USING (token) JOIN bq USING (token), bs GROUP BY 1, 2)"""


def signals_sql(found: str, queries: str) -> str:
    """Every signal of candidates. found: SQL for (qid, id, score); queries: SQL for (qid, text)."""
    return f"""lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id AS id, source || ' ' || coalesce(lang, '') AS title, source || ' ' || coalesce(lang, '') || '   ' || coalesce(text, '') AS body,
      coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS bad, doc_id % 50 - 3 AS age, doc_id % 4 < 3 AS dated FROM documents LEFT JOIN lab USING (doc_id)),
found AS ({found}), dt AS (SELECT d.*, qid, score, {tokens_sql("body")} AS tokens FROM found JOIN d USING (id)),
q AS (SELECT qid, {tokens_sql("text")} AS q_tokens FROM ({queries})),
c AS (SELECT dt.*, q_tokens, list_transform(q_tokens, lambda t: list_contains(tokens, t)::INT) AS hits FROM dt JOIN q USING (qid)),
df AS (SELECT qid, i, sum(hits[i]) AS df, count(*) AS n FROM c, range(1, 1 + len(q_tokens)) t(i) GROUP BY 1, 2),
qi AS (SELECT qid, sum(ln(n::DOUBLE / greatest(df, 1) + 1)) / count(*) AS mean_idf FROM df GROUP BY 1),
sig AS (SELECT c.*, mean_idf, list_sum(hits)::DOUBLE AS matched, len(q_tokens) AS nq, array_to_string(q_tokens, ' ') AS phrase,
        CASE WHEN dated AND age <= 30 THEN exp(-0.693 * age / 7.0) ELSE 0 END AS recency FROM c LEFT JOIN qi USING (qid)),
scored AS (SELECT qid, id, score, tokens, round(greatest(0, least(1, 0.5::DOUBLE * score + 0.25::DOUBLE * CASE WHEN len(tokens) > 0 THEN 0.5::DOUBLE * mean_idf ELSE 0 END
        + 0.15::DOUBLE * (CASE WHEN contains(lower(body), phrase) THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN contains(lower(title), phrase) THEN 0.2::DOUBLE ELSE 0 END + 0.05::DOUBLE * matched / nq)
        + 0.05::DOUBLE * CASE WHEN len(tokens) > 0 THEN matched / nq ELSE 0 END + 0.05::DOUBLE * recency + CASE WHEN good THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN bad THEN 0.2::DOUBLE ELSE 0 END)), 9) AS s,
        CASE WHEN hits[1] = 1 THEN 'exact match, ' ELSE '' END || CASE WHEN contains(lower(title), phrase) THEN 'title match, ' ELSE '' END || CASE WHEN matched > 0 THEN '+' || matched::INT || ' tokens, ' ELSE '' END AS e FROM sig),
explained AS (SELECT *, CASE WHEN e = '' THEN 'keyword relevance' ELSE left(e, length(e) - 2) END AS explanation FROM scored)"""


HITS_SQL = f"SELECT qid, id, bm25 / (bm25 + 10.0::DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) AS rn FROM bm) WHERE rn <= {FETCHED}"
CANDIDATES_SQL = f"""{BM25_SQL}, {signals_sql(HITS_SQL, "SELECT item_id AS qid, text FROM benchmark WHERE item_id % 100 = 0")}"""
