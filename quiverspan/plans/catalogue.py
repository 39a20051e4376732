"""The registered queries, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..functions import vector as V
from ..operators import cluster as C
from ..operators import dml, feedback, ivf
from ..operators import rerank as R
from ..operators import search as S
from ..sources import collection as K
from ..sources.scratch import folder
from ..streaming import cdc
from . import tables as T
from .tables import AS_OF, CANDIDATES_SQL, FEEDBACK_SQL, LOG_SQL, SEGMENTS_SQL, SHARDS_SQL, WORKERS_SQL, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})  # no negative zero


# --- search ---------------------------------------------------------------------------------------

E, QV = "embedding::DOUBLE[]", "q.v"
COSINE = f"list_cosine_distance({E}, {QV})"
L2 = f"list_sum(list_transform(range(1, len({QV}) + 1), lambda i: power(({E})[i] - ({QV})[i], 2)))"
DOT = f"-list_inner_product({E}, {QV})"
CODE = "list_transform({0}, lambda x: round_even(greatest(-1, least(1, x)) * 127, 0)::INT)"
UNIT = f"list_transform({E}, lambda x: x / sqrt(list_inner_product({E}, {E})))"


def _one(score: str, k: int = 10) -> str:
    return f"""WITH q AS (SELECT {E} AS v FROM embeddings WHERE vec_id = 0), h AS (SELECT vec_id AS id, {score} AS score FROM embeddings, q)
               SELECT row_number() OVER (ORDER BY score, id) AS rank, id, round(score, 6) AS score FROM h ORDER BY score, id LIMIT {k}"""


def _batch(score: str, k: int, more: str = "TRUE") -> str:
    return f"""WITH q AS (SELECT vec_id AS qid, {E} AS v FROM embeddings WHERE vec_id % 100 = 0), h AS (SELECT qid, vec_id AS id, {score} AS score FROM embeddings, q WHERE {more}),
               r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM h) SELECT qid, rank, id, round(score, 6) AS score FROM r WHERE rank <= {k}"""


@query(_one(COSINE))
def knn_cosine(spark, d):
    return rounded(S.search(T.points(spark, d), T.first_vector(spark, d), 10), "score")


@query(_one(L2))
def knn_l2(spark, d):
    return rounded(S.search(T.points(spark, d), T.first_vector(spark, d), 10, "euclidean"), "score")


@query(_one(DOT))
def knn_dot(spark, d):
    return rounded(S.search(T.points(spark, d), T.first_vector(spark, d), 10, "dot"), "score")


@query(_one("1 - list_inner_product(%s, %s) / 16129.0::DOUBLE" % (CODE.format(UNIT), CODE.format("list_transform(q.v, lambda y: y / sqrt(list_inner_product(q.v, q.v)))"))))
def knn_quantized(spark, d):
    return rounded(S.search_quantized(T.points(spark, d), T.first_vector(spark, d), 10), "score")


@query(_batch(COSINE, 10))
def knn_batch(spark, d):
    return rounded(S.search_batch(T.points(spark, d), T.queries(spark, d), 10), "score")


@query(_batch(L2, 10))
def knn_batch_l2(spark, d):
    return rounded(S.search_batch(T.points(spark, d), T.queries(spark, d), 10, "euclidean"), "score")


@query(_batch(COSINE, 5, "vec_id <> qid"))
def self_exclude_neighbors(spark, d):
    return rounded(S.search_batch(T.points(spark, d), T.queries(spark, d), 5, exclude_self=True), "score")


@query(f"""WITH h AS ({_batch(COSINE, 15, "vec_id <> qid")}), v AS (SELECT qid, label, count(*) AS votes FROM h JOIN embeddings ON vec_id = id GROUP BY 1, 2)
          SELECT qid, label, votes FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) = 1""")
def label_vote(spark, d):
    labels = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return S.label_vote(S.search_batch(T.points(spark, d), T.queries(spark, d), 15, exclude_self=True), labels)


@query(f"""WITH q AS (SELECT vec_id AS qid, {E} AS v, {CODE.format(UNIT)} AS qc FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT *, {CODE.format(UNIT)} AS code FROM embeddings),
          a AS (SELECT qid, vec_id AS id, {COSINE} AS score, row_number() OVER (PARTITION BY qid ORDER BY 1 - list_inner_product(code, qc) / 16129.0::DOUBLE, vec_id) AS rn FROM p, q),
          r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM a WHERE rn <= 20) SELECT qid, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def knn_two_stage(spark, d):
    return rounded(S.search_two_stage(T.points(spark, d), T.queries(spark, d), 5), "score")


@query(f"WITH {SEGMENTS_SQL}, q AS (SELECT {E} AS v FROM embeddings WHERE vec_id = 0), h AS (SELECT id, list_cosine_distance(vector, q.v) AS score FROM live, q) SELECT row_number() OVER (ORDER BY score, id) AS rank, id, round(score, 6) AS score FROM h ORDER BY score, id LIMIT 10")
def segment_search(spark, d):
    live = dml.live_points(T.segments(spark, d), T.tombstones(spark, d))
    return rounded(S.search(live, T.first_vector(spark, d), 10), "score")


@query(f"WITH {SEGMENTS_SQL} SELECT id, segment, ts, round(list_sum(vector), 6) AS total FROM live")
def compaction(spark, d):
    kept = dml.compact(T.segments(spark, d), T.tombstones(spark, d))
    return rounded(kept.select("id", "segment", "ts", F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x).alias("total")), "total")


HOT = "vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id DESC LIMIT 200)"


@query(_batch(COSINE, 10, f"(vec_id % 3 <> 0 OR {HOT})"))
def hot_cold_merge(spark, d):
    """The hot tier holds points that the cold one lacks, and some that it has."""
    p = T.points(spark, d).withColumn("ts", F.col("id"))
    hot = p.join(S.hot_set(p, 200).select("id"), "id", "left_semi")
    q = T.queries(spark, d)
    return rounded(S.merge_hits(S.search_batch(hot, q, 10), S.search_batch(p.where("id % 3 <> 0"), q, 10), k=10), "score")


@query("SELECT vec_id AS id, ts_rank FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS ts_rank FROM embeddings) WHERE ts_rank <= 200")
def hot_set(spark, d):
    added = T.points(spark, d).select("id", F.col("id").alias("ts"))
    again = added.where("id % 10 = 0").select("id", (F.col("ts") + 100_000).alias("ts"))  # adding again doesn't move it
    hot = S.hot_set(added.union(again), 200)
    return hot.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("added"))).alias("ts_rank"))


@query(_batch(COSINE, 10))
def ivf_exhaustive(spark, d):
    p = T.points(spark, d)
    cells = ivf.fit(p)
    return rounded(ivf.search(ivf.index(p, cells), T.queries(spark, d), cells, 10, probes=len(cells.centers)), "score")


@query()
def ivf_search(spark, d):
    p = T.points(spark, d)
    cells = ivf.fit(p)
    return rounded(ivf.search(ivf.index(p, cells), T.queries(spark, d), cells, 10), "score")


@query(_batch(COSINE, 10))
def ivf_saved(spark, d):
    """Fitted, saved, loaded again, and searched in all cells."""
    p, at = T.points(spark, d), folder(spark, "ivf")
    cells = ivf.fit(p)
    ivf.save(ivf.index(p, cells), cells, at)
    indexed, loaded = ivf.load(spark, at)
    return rounded(ivf.search(indexed, T.queries(spark, d), loaded, 10, probes=len(loaded.centers)), "score")


@query(f"""WITH h AS ({_batch(COSINE, 5)}) SELECT h.qid, h.rank, h.id, h.score, e.label FROM h JOIN embeddings e ON e.vec_id = h.id""")
def attach_payload(spark, d):
    hits = S.search_batch(T.points(spark, d), T.queries(spark, d), 5)
    points = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("payload"))
    return rounded(S.attach(hits, points).withColumnRenamed("payload", "label"), "score")


# --- vector functions -----------------------------------------------------------------------------


@query(f"SELECT vec_id AS id, round(sqrt(list_inner_product({E}, {E})), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return rounded(T.points(spark, d).select("id", V.norm(F.col("vector")).alias("norm")), "norm")


@query(f"SELECT vec_id AS id, len(embedding) AS dim, round(({UNIT})[1], 6) AS first, round(list_sum({UNIT}), 6) AS total FROM embeddings")
def vector_normalize(spark, d):
    unit = V.normalize(F.col("vector"))
    return rounded(T.points(spark, d).select("id", F.size("vector").alias("dim"), unit[0].alias("first"), F.aggregate(unit, F.lit(0.0), lambda s, x: s + x).alias("total")), "first", "total")


@query(f"SELECT vec_id AS id, array_to_string({CODE.format(E)}, ',') AS code FROM embeddings")
def vector_quantize(spark, d):
    return T.points(spark, d).select("id", F.array_join(V.quantize(F.col("vector")), ",").alias("code"))


@query(f"SELECT vec_id AS id, round(list_sum(list_transform({CODE.format(E)}, lambda q: q / 127.0::DOUBLE)), 6) + 0 AS total FROM embeddings")
def vector_dequantize(spark, d):
    back = V.dequantize(V.quantize(F.col("vector")))
    return rounded(T.points(spark, d).select("id", F.aggregate(back, F.lit(0.0), lambda s, x: s + x).alias("total")), "total")


@query(f"""WITH s AS (SELECT vec_id AS id, {E} AS v, list_max(list_transform({E}, lambda x: abs(x))) AS m FROM embeddings)
          SELECT id, round(m, 6) AS scale, array_to_string(list_transform(v, lambda x: round(x * 127 / CASE WHEN m = 0 THEN 1 ELSE m END, 0)::INT), ',') AS code FROM s""")
def storage_compress(spark, d):
    c = T.points(spark, d).select("id", V.compress(F.col("vector")).alias("c"))
    return rounded(c.select("id", F.col("c.scale").alias("scale"), F.array_join("c.q", ",").alias("code")), "scale")


@query(f"""WITH s AS (SELECT vec_id AS id, {E} AS v, list_max(list_transform({E}, lambda x: abs(x))) AS m FROM embeddings)
          SELECT id, 4 + 4 * len(v) + 2 + strlen(id::VARCHAR) AS bytes, 0.0::DOUBLE AS error, 'm:' || id AS metadata, 8 + len(v) + 2 + strlen(id::VARCHAR) AS packed_bytes,
                 round(list_sum(list_transform(v, lambda x: abs(x - round(x * 127 / CASE WHEN m = 0 THEN 1 ELSE m END, 0) * m / 127))), 4) AS packed_error FROM s""")
def vector_codec(spark, d):
    meta = F.concat(F.lit("m:"), F.col("id").cast("string")).cast("binary")
    p = T.points(spark, d).select("id", "vector", K.encode_vector(F.col("vector"), meta).alias("raw"), K.encode_vector(F.col("vector"), meta, True).alias("packed"))
    back = p.select("*", K.decode_vector(F.col("raw")).alias("r"), K.decode_vector(F.col("packed")).alias("p"))
    off = F.aggregate(F.zip_with("vector", "p.vector", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return back.select("id", F.octet_length("raw").alias("bytes"), V.l2_squared(F.col("vector"), F.col("r.vector")).alias("error"), F.col("r.metadata").cast("string").alias("metadata"), F.octet_length("packed").alias("packed_bytes"), F.round(off, 4).alias("packed_error"))


@query(f"SELECT vec_id AS id, round(1 - list_inner_product({UNIT}, list_transform(q.v, lambda y: y / sqrt(list_inner_product(q.v, q.v)))), 6) + 0 AS fast, round({COSINE}, 6) + 0 AS stored FROM embeddings, (SELECT {E} AS v FROM embeddings WHERE vec_id = 0) q")
def vector_fast_paths(spark, d):
    """The distance of unit vectors without a division, and the cosine distance with norms that are columns."""
    q = F.array(*(F.lit(float(x)) for x in T.first_vector(spark, d)))
    p = T.points(spark, d).withColumn("norm", V.norm(F.col("vector")))
    fast, stored = V.normalized_cosine_distance(V.normalize(F.col("vector")), V.normalize(q)), V.cosine_distance(F.col("vector"), q, F.col("norm"), V.norm(q))
    return rounded(p.select("id", fast.alias("fast"), stored.alias("stored")), "fast", "stored")


@query(f"""WITH e AS (SELECT vec_id AS id, list_transform({E}, lambda x: CASE WHEN x = 0 THEN 0 ELSE trunc(x / pow(2.0::DOUBLE, floor(log2(abs(x))) - 8)) * pow(2.0::DOUBLE, floor(log2(abs(x))) - 8) END) AS v FROM embeddings)
          SELECT id, round(list_sum(v), 9) + 0 AS total, v[1]::DOUBLE AS first FROM e""")
def vector_truncated(spark, d):
    t = T.points(spark, d).select("id", V.truncate_mantissa(F.col("vector"), 8).alias("v"))
    return t.select("id", (F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 9) + F.lit(0.0)).alias("total"), F.col("v")[0].alias("first"))


@query("""WITH c AS (SELECT p_partkey AS id, p_size AS k, CASE p_partkey % 4 WHEN 0 THEN 64 WHEN 1 THEN 512 WHEN 2 THEN 768 ELSE 1024 END AS dim, CASE p_partkey % 5 WHEN 0 THEN 'ab' WHEN 1 THEN '' ELSE p_name END AS query FROM part),
          w AS (SELECT *, greatest(least(100, 2 * k), least(2 * k, 100)) AS wanted FROM c)
          SELECT id, greatest(k, floor(wanted * CASE dim WHEN 512 THEN 0.8::DOUBLE WHEN 768 THEN 0.65::DOUBLE WHEN 1024 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)::INT) AS ef,
                 CASE WHEN length(query) BETWEEN 1 AND 2 THEN least(2 * k, greatest(100, k), k + k // 2) ELSE least(2 * k, greatest(100, k)) END AS fetched FROM w""")
def search_limits(spark, d):
    dim = F.when(F.col("p_partkey") % 4 == 0, 64).when(F.col("p_partkey") % 4 == 1, 512).when(F.col("p_partkey") % 4 == 2, 768).otherwise(1024)
    asked = F.when(F.col("p_partkey") % 5 == 0, "ab").when(F.col("p_partkey") % 5 == 1, "").otherwise(F.col("p_name"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), S.effective_ef_of(F.col("p_size"), dim).alias("ef"), S.candidate_limit_of(F.col("p_size"), asked).alias("fetched"))


# --- key-value reads ------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17")
def point_get(spark, d):
    return K.get(read(spark, d, "documents"), "doc_id", 17).select("doc_id", "lang", "source", "n_chars")


@query("SELECT c_custkey AS key, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS found FROM customer")
def exists_batch(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return K.exists_batch(read(spark, d, "customer").select(F.col("c_custkey").alias("key")), orders, "key")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_name LIMIT 5")
def prefix_scan(spark, d):
    return K.prefix_scan(read(spark, d, "customer"), "c_name", "Customer#00000001", 5).select("c_custkey", "c_name")


@query("SELECT count(*) AS entries FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def entry_count(spark, d):
    return K.entry_count(read(spark, d, "customer"), "c_name", "Customer#0000001")


@query("SELECT c_custkey, c_name FROM customer, (SELECT min(c_name) AS first FROM customer WHERE c_acctbal < -900) WHERE first IS NULL OR c_name < first")
def iterate_until(spark, d):
    return K.rows_until(read(spark, d, "customer"), "c_name", F.col("c_acctbal") < -900).select("c_custkey", "c_name")


@query("""WITH ops AS (SELECT o_custkey AS key, max_by(o_orderstatus, o_orderkey) AS status, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1)
          SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM ops) UNION ALL SELECT key, value FROM ops WHERE status <> 'F'""")
def kv_batch_write(spark, d):
    table = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    ops = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").alias("is_delete"), F.col("o_orderkey").alias("seq"))
    return K.apply_batch(table, ops)


@query("SELECT c_custkey AS key, CASE c_custkey WHEN 7 THEN 1.5 ELSE c_acctbal END AS value FROM customer WHERE c_custkey <> 9")
def kv_put_delete(spark, d):
    table = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return K.remove(K.put(table, 7, 1.5), 9)


@query("SELECT vec_id AS id, vec_id % 3 = 0 AS deleted FROM embeddings")
def is_deleted(spark, d):
    """A point whose vector is missing or empty counts as deleted."""
    v = F.when(F.col("id") % 6 == 0, F.array().cast("array<float>")).when(F.col("id") % 3 != 0, F.col("vector"))
    return T.points(spark, d).select("id", dml.is_deleted(v).alias("deleted"))


@query("SELECT doc_id, coalesce(lang, '') AS lang, 2 AS keys FROM documents")
def payload_codec(spark, d):
    p = read(spark, d, "documents").select("doc_id", K.encode_payload(F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")))).alias("raw"))
    back = p.select("doc_id", K.decode_payload(F.col("raw")).alias("m"))
    return back.select("doc_id", F.col("m")["lang"].alias("lang"), F.size("m").alias("keys"))


FNV = """f AS (SELECT vec_id AS id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(vec_id::VARCHAR, ''), lambda c: ascii(c)::HUGEINT)),
         lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM embeddings)"""


# --- collections ----------------------------------------------------------------------------------


def _collection(spark, d) -> K.Collection:
    """Embeddings in three writes: all, a third again with reversed vectors, and a tenth deleted."""
    c = K.Store(spark, folder(spark, "store")).create("vectors", len(T.first_vector(spark, d)), "cosine")
    p = T.points(spark, d).select(F.col("id").cast("string").alias("id"), "vector", F.create_map(F.lit("n"), F.col("id").cast("string")).alias("payload"), F.col("id").alias("n"))
    c.upsert(p.drop("n"), 1)
    c.upsert(p.where("n % 3 = 0").select("id", F.reverse("vector").alias("vector"), "payload"), 2)
    c.delete([r["id"] for r in p.where("n % 10 = 0").select("id").collect()], 3)
    return c


STORED = f"st AS (SELECT vec_id::VARCHAR AS id, vec_id AS n, CASE WHEN vec_id % 3 = 0 THEN list_reverse({E}) ELSE {E} END AS v FROM embeddings WHERE vec_id % 10 <> 0)"
NEAREST = f"WITH {STORED}, h AS (SELECT id, n, list_cosine_distance(st.v, q.v) AS score FROM st, (SELECT {E} AS v FROM embeddings WHERE vec_id = 0) q) SELECT row_number() OVER (ORDER BY score, id) AS rank, id, round(score, 6) AS score, n::VARCHAR AS n FROM h ORDER BY score, id LIMIT 10"


@query(NEAREST)
def collection_search(spark, d):
    hits = _collection(spark, d).search(T.first_vector(spark, d), 10)
    return rounded(hits.select("rank", "id", "score", F.col("payload")["n"].alias("n")), "score")


@query(f"WITH {STORED} SELECT id, n::VARCHAR AS n, round(list_sum(v), 4) + 0 AS total, 1 AS segments FROM st")
def collection_compact(spark, d):
    c = _collection(spark, d)
    c.compact(fan_in=None)
    c.vacuum()
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return c.points().select("id", F.col("payload")["n"].alias("n"), (F.round(total, 4) + F.lit(0.0)).alias("total"), F.lit(c.segments().count()).cast("int").alias("segments"))


@query("SELECT * FROM (VALUES (1, (SELECT count(*) FROM embeddings)), (2, (SELECT count(*) FROM embeddings WHERE vec_id % 3 = 0)), (3, (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0))) t(segment, vectors)")
def collection_segments(spark, d):
    return _collection(spark, d).segments().select("segment", "vectors")


@query(f"WITH {STORED} SELECT id, n::VARCHAR AS n FROM st")
def collection_backup(spark, d):
    """Backed up, emptied by deletes, restored."""
    c, at = _collection(spark, d), folder(spark, "backup")
    c.backup(at)
    c.delete([r["id"] for r in c.points().select("id").collect()], 4)
    c.restore(at, 5)
    return c.points().select("id", F.col("payload")["n"].alias("n"))


@query(f"WITH {STORED}, q AS (SELECT vec_id AS qid, {E} AS v FROM embeddings WHERE vec_id % 100 = 0), h AS (SELECT qid, id, list_cosine_distance(st.v, q.v) AS score FROM st, q), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM h) SELECT qid, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10")
def collection_index(spark, d):
    """The index is built after the first two writes and searched in all cells after the third."""
    c = _collection(spark, d)
    c.build_index()
    changed = c.points().where("CAST(id AS BIGINT) % 7 = 1")
    c.delete([r["id"] for r in changed.select("id").collect()], 4)
    c.upsert(changed, 5)
    return rounded(c.search_index(T.queries(spark, d), 10, ef=1 << 20), "score")


@query(f"WITH {FNV}, {STORED}, s AS (SELECT least(15, h // 1152921504606846976::HUGEINT)::INT AS shard, count(*) AS points FROM f WHERE id % 10 <> 0 GROUP BY 1) SELECT i::INT AS shard, coalesce(points, 0) AS points FROM range(0, 16) t(i) LEFT JOIN s ON shard = i")
def collection_points(spark, d):
    return _collection(spark, d).status().select("shard", "points")


@query(f"WITH {STORED} SELECT id, n::VARCHAR AS n FROM st")
def collection_stream(spark, d):
    """The same points, as a stream into an empty collection."""
    c = _collection(spark, d)
    at, own = folder(spark, "stream"), K.Store(spark, folder(spark, "store")).create("copy", c.dimension, "cosine")
    c.points().withColumn("ts", F.lit(1)).repartition(3).write.parquet(f"{at}/in")
    rows = spark.read.parquet(f"{at}/in")
    own.upsert_stream(cdc.read_changes(spark, f"{at}/in", rows.schema, 2), f"{at}/checkpoint").awaitTermination()
    return own.points().select("id", F.col("payload")["n"].alias("n"))


# --- change logs ----------------------------------------------------------------------------------


@query(f"WITH {LOG_SQL} SELECT id, ts, seq, round(value, 6) AS value FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1")
def upsert_keep_last(spark, d):
    return rounded(dml.keep_last(T.change_log(spark, d)).select("id", "ts", "seq", "value"), "value")


@query(f"WITH {LOG_SQL}, l AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1) SELECT id, seq FROM l WHERE NOT is_delete")
def wal_replay(spark, d):
    return dml.replay(T.change_log(spark, d)).select("id", "seq")


@query(f"WITH {LOG_SQL}, t AS (SELECT id, max(ts) AS dead FROM log WHERE is_delete GROUP BY 1) SELECT log.id, count(*) AS live_changes FROM log LEFT JOIN t USING (id) WHERE NOT is_delete AND (dead IS NULL OR ts > dead) GROUP BY 1")
def delete_tombstone(spark, d):
    log = T.change_log(spark, d)
    dead = dml.latest_tombstones(log.where("is_delete")).select(F.col("id").alias("dead_id"), F.col("ts").alias("dead"))
    live = log.where("NOT is_delete").join(dead, (F.col("id") == F.col("dead_id")) & (F.col("ts") <= F.col("dead")), "left_anti")
    return live.groupBy("id").agg(F.count(F.lit(1)).alias("live_changes"))


@query("SELECT user_id AS id, ts AS since FROM (SELECT user_id, epoch_us(ts) AS ts FROM events) WHERE ts >= epoch_us(TIMESTAMP '2024-01-25')")
def wal_catch_up(spark, d):
    since = 1706140800 * 10**6
    return dml.changes_since(T.change_log(spark, d), since).select("id", F.col("ts").alias("since"))


@query("SELECT c_custkey AS id, CASE WHEN o.key IS NULL THEN c_acctbal ELSE o.total END AS value FROM customer LEFT JOIN (SELECT o_custkey AS key, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS total FROM orders GROUP BY 1) o ON o.key = c_custkey UNION ALL SELECT o_custkey, max_by(o_totalprice, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def upsert_merge(spark, d):
    points = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    changes = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))
    return dml.upsert(points, changes)


@query(f"WITH {LOG_SQL}, l AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1) SELECT id, seq, round(value, 6) AS value FROM l WHERE NOT is_delete")
def cdc_stream_merge(spark, d):
    at = folder(spark, "cdc")
    log = T.change_log(spark, d)
    log.repartition(4).write.parquet(f"{at}/log")
    stream = cdc.read_changes(spark, f"{at}/log", log.schema, files_per_trigger=2)
    cdc.merge_into(stream, f"{at}/table", f"{at}/checkpoint", "id").awaitTermination()
    return rounded(cdc.current(spark, f"{at}/table", log.schema).select("id", "seq", "value"), "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return cdc.windowed_counts(read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("SELECT user_id, epoch_us(ts) // 1000000 AS second, count(*) AS requests, greatest(count(*) - 2, 0) AS rejected FROM events GROUP BY 1, 2")
def rate_limit_windows(spark, d):
    e = read(spark, d, "events").groupBy("user_id", F.floor(text.micros(F.col("ts")) / 1000000).alias("second")).agg(F.count(F.lit(1)).alias("requests"))
    return e.withColumn("rejected", F.greatest(F.col("requests") - 2, F.lit(0)))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_id AS seq FROM events),
          w AS (SELECT user_id, min(us) AS start FROM e GROUP BY 1 UNION ALL SELECT w.user_id, (SELECT min(us) FROM e WHERE e.user_id = w.user_id AND e.us >= w.start + 1000000) FROM w WHERE w.start IS NOT NULL),
          p AS (SELECT e.*, (SELECT max(start) FROM w WHERE w.user_id = e.user_id AND w.start <= e.us) AS start FROM e)
          SELECT user_id AS "user", us, seq, row_number() OVER (PARTITION BY user_id, start ORDER BY us, seq) <= 2 AS allowed FROM p""")
def rate_limit_exact(spark, d):
    return cdc.rate_limit(T.request_log(spark, d), "user_id", 2)


@query(f"WITH {LOG_SQL}, l AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1) SELECT id, seq, round(value, 6) AS value FROM l WHERE NOT is_delete")
def snapshot_tail(spark, d):
    """A replica from a snapshot and the changes since, of which it sees some twice."""
    log = T.change_log(spark, d)
    snapshot, tail = cdc.snapshot_and_tail(log, 1706140800 * 10**6)
    twice = log.where(F.col("ts") >= (1706140800 - 86400) * 10**6)
    return rounded(cdc.apply_tail(snapshot, tail.union(twice)).select("id", "seq", "value"), "value")


# --- sharding -------------------------------------------------------------------------------------



def _hashed(spark, d) -> DataFrame:
    h = T.points(spark, d).select("id", hashing.fnv1a_64(F.col("id").cast("string")).alias("h"))
    return h.withColumn("shard", hashing.shard_of(F.col("h"), 16))


@query(f"WITH {FNV} SELECT id, h::VARCHAR AS h, least(15, h // 1152921504606846976::HUGEINT)::INT AS shard FROM f")
def shard_routing(spark, d):
    return _hashed(spark, d).withColumn("h", F.col("h").cast("string"))


@query(f"WITH {FNV}, r AS (SELECT i AS shard, i * 1152921504606846976::HUGEINT AS a, (i + 1) * 1152921504606846976::HUGEINT - 1 AS b FROM range(0, 16) t(i)) SELECT shard::INT AS shard, count(*) AS points FROM f JOIN r ON h BETWEEN a AND b GROUP BY 1")
def shard_counts(spark, d):
    return _hashed(spark, d).groupBy("shard").agg(F.count(F.lit(1)).alias("points"))


@query("SELECT i::INT AS shard, (i * 1152921504606846976::HUGEINT)::VARCHAR AS range_start, ((i + 1) * 1152921504606846976::HUGEINT - 1)::VARCHAR AS range_end FROM range(0, 16) t(i)")
def shard_ranges(spark, d):
    return hashing.shard_ranges(spark, 16).select("shard", F.col("range_start").cast("string").alias("range_start"), F.col("range_end").cast("string").alias("range_end"))


# --- reranking ------------------------------------------------------------------------------------


@query(f"SELECT doc_id AS id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {T.tokens_sql('text')} AS t FROM documents)")
def rerank_tokenize(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tokenize(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


CONFIG = R.RuleConfig(boosts={"good": 0.1}, penalties={"bad": 0.2})


def _signals(spark, d) -> DataFrame:
    return R.signals(T.candidates(spark, d), CONFIG, AS_OF)


@query(f"WITH {CANDIDATES_SQL} SELECT qid, q_tokens[i] AS token, max(df)::BIGINT AS df FROM df JOIN q USING (qid) GROUP BY 1, 2")
def rerank_df(spark, d):
    c = T.candidates(spark, d).select("qid", text.tokenize(F.col("query")).alias("q"), text.tokenize(text.payload_text(F.col("payload"))).alias("t"))
    each = c.select("qid", F.explode(F.array_distinct("q")).alias("token"), F.col("t"))
    return each.groupBy("qid", "token").agg(F.sum(F.array_contains("t", F.col("token")).cast("long")).alias("df"))


@query(f"WITH {CANDIDATES_SQL} SELECT qid, count(*) AS candidates, round(avg(len(tokens)), 6) AS mean_len FROM sig GROUP BY 1")
def rerank_mean_length(spark, d):
    return rounded(_signals(spark, d).groupBy("qid").agg(F.max("candidates").alias("candidates"), F.max("mean_len").alias("mean_len")), "mean_len")


@query(f"WITH {CANDIDATES_SQL} SELECT qid, id, round(CASE WHEN nq > 0 AND len(tokens) > 0 THEN 0.5 * mean_idf ELSE 0 END, 6) AS bm25 FROM sig")
def rerank_bm25(spark, d):
    return rounded(_signals(spark, d).select("qid", "id", "bm25"), "bm25")


@query(f"WITH {CANDIDATES_SQL} SELECT qid, id, round(CASE WHEN contains(lower(body), phrase) THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(title), phrase) THEN 0.2 ELSE 0 END + 0.05 * matched / nq, 6)::DOUBLE AS keyword FROM sig")
def rerank_keyword(spark, d):
    return rounded(_signals(spark, d).select("qid", "id", "keyword"), "keyword")


@query(f"WITH {CANDIDATES_SQL} SELECT qid, id, round(CASE WHEN len(tokens) > 0 THEN matched / nq ELSE 0 END, 6) AS coverage FROM sig")
def rerank_coverage(spark, d):
    return rounded(_signals(spark, d).select("qid", "id", "coverage"), "coverage")


@query(f"WITH {CANDIDATES_SQL} SELECT qid, id, round(recency, 6)::DOUBLE AS recency FROM sig")
def rerank_recency(spark, d):
    return rounded(_signals(spark, d).select("qid", "id", "recency"), "recency")


@query(f"WITH {CANDIDATES_SQL} SELECT qid, id, round(CASE WHEN good THEN 0.1 ELSE 0 END - CASE WHEN bad THEN 0.2 ELSE 0 END, 6)::DOUBLE AS meta FROM sig")
def rerank_metadata(spark, d):
    return rounded(_signals(spark, d).select("qid", "id", "meta"), "meta")


@query(f"WITH {CANDIDATES_SQL} SELECT qid, id, round(s, 6) AS rerank_score, round(score, 6) AS original_score, explanation FROM explained")
def rerank_full(spark, d):
    full = R.rule(T.candidates(spark, d), T.FETCHED, CONFIG, AS_OF)
    return rounded(full.select("qid", "id", "rerank_score", "original_score", "explanation"), "rerank_score", "original_score")


@query(f"WITH {CANDIDATES_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM explained) SELECT qid, id, round(s, 6) AS rerank_score, explanation, rank FROM x WHERE rank <= 10")
def rerank_top(spark, d):
    top = R.rerank(T.candidates(spark, d), 10, config=CONFIG, as_of=AS_OF)
    return rounded(top.select("qid", "id", "rerank_score", "explanation", "rank"), "rerank_score")


@query(f"WITH {CANDIDATES_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sig) SELECT qid, id, round(score, 6) AS rerank_score, rank, 'sorted by original score' AS explanation FROM x WHERE rank <= 10")
def rerank_empty_query(spark, d):
    only_stops = T.candidates(spark, d).withColumn("query", F.lit("the of"))
    return rounded(R.rerank(only_stops, 10, config=CONFIG, as_of=AS_OF).select("qid", "id", "rerank_score", "rank", "explanation"), "rerank_score")


@query(f"WITH {CANDIDATES_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM found) SELECT qid, id, round(score, 6) AS rerank_score, rank FROM x WHERE rank <= 10")
def rerank_identity(spark, d):
    return rounded(R.rerank(T.candidates(spark, d), 10, "llm").select("qid", "id", "rerank_score", "rank"), "rerank_score")


@query(f"""WITH near AS (SELECT vec_id AS id, 1 - round({COSINE}, 9) AS score FROM embeddings, (SELECT {E} AS v FROM embeddings WHERE vec_id = 0) q WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY score DESC, id LIMIT {S.candidate_limit(10, "of the first item")}),
           {T.signals_sql("SELECT 0 AS qid, id, score FROM near", "SELECT 0 AS qid, text FROM benchmark WHERE item_id = 0")}, x AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS rank FROM explained)
           SELECT rank, id, round(s, 6) AS score, explanation FROM x WHERE rank <= 10""")
def search_rerank(spark, d):
    points = T.points(spark, d).join(T.documents(spark, d), "id")
    query = read(spark, d, "benchmark").where("item_id = 0").first()["text"]
    return rounded(R.search_rerank(points, T.first_vector(spark, d), query, 10, config=CONFIG, as_of=AS_OF).select("rank", "id", "score", "explanation"), "score")


@query(f"WITH {T.BM25_SQL} SELECT qid, id, bm25 FROM bm")
def bm25_textbook(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").alias("id"), text.tokenize(F.col("text")).alias("tokens"))
    return rounded(R.bm25(t, T.asked(spark, d).select("qid", text.tokenize(F.col("query")).alias("q_tokens"))), "bm25")


@query("SELECT md5(c_name) AS key, c_custkey AS value FROM customer WHERE c_acctbal >= 0")
def rerank_invalidate(spark, d):
    cache = read(spark, d, "customer").select(F.md5("c_name").alias("key"), F.col("c_custkey").alias("value"))
    stale = read(spark, d, "customer").where("c_acctbal < 0").select(F.md5("c_name").alias("key"))
    return R.invalidate(cache, stale)


@query("SELECT lang, sha256(lang || '|' || string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS key FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def rerank_cache_key(spark, d):
    g = read(spark, d, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.collect_list(F.col("doc_id").cast("string")).alias("ids"))
    return g.select("lang", text.rerank_cache_key(F.col("lang"), F.col("ids")).alias("key"))


# --- feedback -------------------------------------------------------------------------------------


@query(f"WITH {FEEDBACK_SQL} SELECT collection, query, count(*) AS items, round(avg(relevance_score), 6) AS relevance, TRUE AS own_id FROM (SELECT *, id[strpos(id, '/') + 1:] AS query FROM sess) s JOIN item ON session_id = s.id GROUP BY 1, 2, s.id")
def feedback_store(spark, d):
    at, some = folder(spark, "feedback"), T.items(spark, d).withColumnRenamed("session_id", "ref")
    sessions = T.sessions(spark, d).withColumnRenamed("id", "ref").join(some.select("ref").distinct(), "ref", "left_semi")
    feedback.store(sessions, some, at)
    stored = spark.read.parquet(f"{at}/sessions").join(spark.read.parquet(f"{at}/items"), F.col("id") == F.col("session_id"))
    return rounded(stored.groupBy("collection", "query", "id").agg(F.count(F.lit(1)).alias("items"), F.avg("relevance_score").alias("relevance")).select("collection", "query", "items", "relevance", F.col("id").rlike("^[0-9a-f-]{36}$").alias("own_id")), "relevance")


@query(f"WITH {FEEDBACK_SQL}, n AS (SELECT * FROM sess WHERE collection = 'c1' ORDER BY created_at DESC, id LIMIT 100) SELECT n.id, count(result_id) AS items, coalesce(string_agg(result_id::VARCHAR, ',' ORDER BY position), '') AS results FROM n LEFT JOIN item ON session_id = n.id GROUP BY 1")
def feedback_by_collection(spark, d):
    f = feedback.by_collection(T.sessions(spark, d), T.items(spark, d), "c1")
    kept = F.filter("items", lambda x: x["result_id"].isNotNull())
    return f.select("id", F.size(kept).alias("items"), F.array_join(F.transform(kept, lambda x: x["result_id"].cast("string")), ",").alias("results"))


@query(f"WITH {FEEDBACK_SQL} SELECT collection, round(avg(relevance_score), 6) AS avg_relevance, count(*) AS total_feedback, sum(clicked::INT)::BIGINT AS clicks, count(DISTINCT id) AS total_sessions, round(sum(clicked::INT) / count(*), 6) AS ctr FROM sess JOIN item ON session_id = id GROUP BY 1")
def feedback_stats(spark, d):
    return rounded(feedback.stats(T.sessions(spark, d), feedback.validate_items(T.items(spark, d))), "avg_relevance", "ctr")


@query(f"WITH {FEEDBACK_SQL} SELECT result_id, relevance_score, position FROM item WHERE session_id = '1/2024-01-05'")
def feedback_session(spark, d):
    return feedback.of_session(T.items(spark, d), "1/2024-01-05").select("result_id", "relevance_score", "position")


# --- cluster state --------------------------------------------------------------------------------


@query(f"WITH {WORKERS_SQL} SELECT worker, round(load, 6) AS load, greatest(100, floor(cpu / 8 * 300 + memory / 32 * 400 + disk / 500 * 300))::BIGINT AS capacity_score FROM w")
def worker_load(spark, d):
    w = T.workers(spark, d)
    gib = float(1 << 30)
    return rounded(w.select("worker", "load", C.capacity_score(F.col("cpu"), F.col("memory") * gib, F.col("disk") * gib).alias("capacity_score")), "load")


@query(f"WITH {WORKERS_SQL} SELECT worker, round(ratio, 6) AS ratio FROM w WHERE eligible")
def workers_by_load(spark, d):
    return rounded(C.by_load_ratio(T.workers(spark, d), AS_OF).select("worker", "ratio"), "ratio")


@query(f"WITH {WORKERS_SQL} SELECT worker, capacity, row_number() OVER (ORDER BY capacity DESC, worker) AS place FROM w")
def workers_by_capacity(spark, d):
    return C.by_capacity(T.workers(spark, d)).select("worker", "capacity", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("capacity"), "worker")).alias("place"))


@query(f"""WITH {WORKERS_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ratio, worker) AS rn FROM w WHERE eligible), f AS (SELECT * FROM z WHERE rn = 1 ORDER BY ratio, worker LIMIT 8),
          k AS (SELECT z.*, row_number() OVER (PARTITION BY zone, rack ORDER BY ratio, worker) AS rr FROM z WHERE worker NOT IN (SELECT worker FROM f)),
          a AS (SELECT worker, zone, rack, ratio, 1 AS pass FROM f UNION ALL SELECT worker, zone, rack, ratio, CASE WHEN rr = 1 AND (zone, rack) NOT IN (SELECT (zone, rack) FROM f) THEN 2 ELSE 3 END FROM k)
          SELECT worker, zone, rack, pass, row_number() OVER (ORDER BY pass, ratio, worker) AS place FROM a QUALIFY place <= 8""")
def replica_placement(spark, d):
    return C.place_replicas(T.workers(spark, d).where(C.eligible(AS_OF)), 8).select("worker", "zone", "rack", "pass", "place")


BASE = f"{WORKERS_SQL}, {SHARDS_SQL}"


@query(f"WITH {BASE} SELECT shard, healthy_replicas FROM hc WHERE healthy_replicas < 3")
def under_replicated(spark, d):
    return C.under_replicated(T.shards(spark, d), T.workers(spark, d), AS_OF)


@query(f"WITH {BASE} SELECT shard, CASE WHEN qps > 1000 THEN 'high_qps' ELSE 'high_latency' END AS reason FROM s WHERE qps > 1000 OR latency_ms > 100")
def hot_shards(spark, d):
    return C.hot_shards(T.shards(spark, d)).select("shard", "reason")


@query(f"WITH {BASE} SELECT w.worker, count(r.shard) AS replicas FROM w LEFT JOIN r USING (worker) GROUP BY 1")
def shard_distribution(spark, d):
    return C.shard_distribution(T.shards(spark, d), T.workers(spark, d))


@query(f"WITH {BASE} SELECT worker FROM r UNION SELECT worker FROM w WHERE healthy AND role = 'search_only'")
def worker_union(spark, d):
    return C.workers_for(T.shards(spark, d), T.workers(spark, d), AS_OF)


@query(f"WITH {BASE} SELECT (SELECT count(*) FROM w) AS workers, (SELECT count(*) FROM w WHERE healthy) AS healthy_workers, (SELECT count(*) FROM s) AS shards, (SELECT count(*) FROM s WHERE leaderless) AS leaderless_shards, (SELECT count(*) FROM hc WHERE healthy_replicas < 3) AS under_replicated, (SELECT count(*) FROM s WHERE qps > 1000 OR latency_ms > 100) AS hot_shards")
def health_report(spark, d):
    return C.health_report(T.workers(spark, d), T.shards(spark, d), AS_OF)


@query(f"""WITH {BASE}, n AS (SELECT shard, least(3 - healthy_replicas, 5 - replicas) AS wanted FROM hc WHERE healthy_replicas < 3),
          p AS (SELECT n.shard, wanted, w.worker, row_number() OVER (PARTITION BY n.shard ORDER BY ratio, w.worker) AS place FROM n, w WHERE eligible AND NOT EXISTS (SELECT 1 FROM r WHERE r.shard = n.shard AND r.worker = w.worker)) SELECT shard, worker, place FROM p WHERE place <= wanted""")
def repair_plan(spark, d):
    return C.repair_plan(T.shards(spark, d), T.workers(spark, d), AS_OF)


@query()
def rebalance_plan(spark, d):
    return spark.createDataFrame(C.rebalance_plan(T.shards(spark, d), T.workers(spark, d), AS_OF), "shard long, source long, target long, reason string")


EDITED = """e AS (SELECT shard, list(worker ORDER BY worker) AS own FROM r GROUP BY 1), able AS (SELECT min(worker) AS add FROM w WHERE healthy AND worker NOT IN (SELECT worker FROM r WHERE shard = 7)),
           dead AS (SELECT min(worker) AS dead FROM w WHERE NOT healthy AND worker NOT IN (SELECT worker FROM r WHERE shard = 6))"""


@query(f"""WITH {BASE}, {EDITED} SELECT e.shard, array_to_string(CASE e.shard WHEN 7 THEN list_sort(CASE WHEN len(own) < 5 AND add IS NOT NULL THEN list_append(own, add) ELSE own END)
             WHEN 3 THEN CASE WHEN len(own) > 3 THEN own[2:] ELSE own END ELSE own END, ',') AS replicas,
             1 + (e.shard = 7 AND len(own) < 5 AND add IS NOT NULL OR e.shard = 3 AND len(own) > 3)::BIGINT AS epoch FROM e, able, dead""")
def replica_edit(spark, d):
    """A healthy worker joins shard 7, one that isn't can't join shard 6, the least replica of shard 3 leaves if three stay."""
    s, w = T.shards(spark, d), T.workers(spark, d)
    r = C.replica_rows(s)
    new = w.where(C.healthy(AS_OF)).join(r.where("shard = 7"), "worker", "left_anti").agg(F.min("worker")).first()[0]
    dead = w.where(~C.healthy(AS_OF)).join(r.where("shard = 6"), "worker", "left_anti").agg(F.min("worker")).first()[0]
    s = C.edit_replicas(s, 7, w, AS_OF, add=new)
    s = C.edit_replicas(s, 6, w, AS_OF, add=dead)
    s = C.edit_replicas(s, 3, w, AS_OF, remove=r.where("shard = 3").agg(F.min("worker")).first()[0])
    return s.select("shard", F.array_join(F.sort_array("replicas"), ",").alias("replicas"), "epoch")


@query(f"""WITH {BASE}, m AS (SELECT min(worker) AS source FROM r WHERE shard = 2), t AS (SELECT min(worker) AS target FROM w WHERE worker NOT IN (SELECT worker FROM r WHERE shard = 2)),
           v AS (SELECT shard, CASE WHEN shard = 2 AND worker = source AND target IS NOT NULL THEN target ELSE worker END AS worker FROM r, m, t)
           SELECT shard, string_agg(worker::VARCHAR, ',' ORDER BY worker) AS replicas, 1 + (shard = 2 AND (SELECT target FROM t) IS NOT NULL)::BIGINT AS epoch FROM v GROUP BY 1""")
def replica_move(spark, d):
    s, w = T.shards(spark, d), T.workers(spark, d)
    r = C.replica_rows(s).where("shard = 2")
    target = w.join(r, "worker", "left_anti").agg(F.min("worker")).first()[0]
    s = C.edit_replicas(s, 2, w, AS_OF, add=target, remove=r.agg(F.min("worker")).first()[0]) if target is not None else s
    return s.select("shard", F.array_join(F.sort_array("replicas"), ",").alias("replicas"), "epoch")


@query("SELECT event_type, event_id % 2 AS method, count(*) AS requests, round(avg(value), 6) AS mean_latency, sum((event_type = 'error')::INT)::BIGINT AS errors FROM events GROUP BY 1, 2")
def endpoint_stats(spark, d):
    return rounded(C.endpoint_stats(T.request_log(spark, d), ["event_type", "method"]), "mean_latency")


@query("SELECT count(*) AS requests, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6)::DOUBLE AS rps, round(avg((event_type = 'error')::INT), 6) AS error_rate FROM events")
def gateway_stats(spark, d):
    return rounded(C.gateway_stats(T.request_log(spark, d)), "rps", "error_rate")


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
          SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(max(CASE WHEN i = floor(n * 0.5::DOUBLE) THEN value END), 6) AS p50, round(max(CASE WHEN i = floor(n * 0.95::DOUBLE) THEN value END), 6) AS p95, round(max(CASE WHEN i = floor(n * 0.99::DOUBLE) THEN value END), 6) AS p99 FROM o GROUP BY 1""")
def latency_percentiles(spark, d):
    return rounded(C.latency_percentiles(T.request_log(spark, d), "event_type", "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "mean", "stddev", "p50", "p95", "p99")


@query("""WITH RECURSIVE o AS (SELECT event_type AS k, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
          n AS (SELECT k, count(*) AS n FROM o GROUP BY 1), z AS (SELECT o.k, sum(v * CASE WHEN i = 1 THEN power(0.7::DOUBLE, n - 1) ELSE 0.3::DOUBLE * power(0.7::DOUBLE, n - i) END) AS e, max(n) AS n FROM o JOIN n USING (k) GROUP BY 1)
          SELECT k AS event_type, round(e, 6) AS ewma, n AS samples FROM z""")
def ewma_metrics(spark, d):
    return rounded(C.ewma(T.request_log(spark, d), "event_type", "latency", ["ts", "seq"]), "ewma")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 0")
def alert_filter(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", (F.col("value") <= 0).alias("resolved"), F.col("event_type").alias("level"))
    return C.filter_alerts(e, "active", "error").select("event_id", "user_id")


@query("SELECT CASE WHEN count(*) FILTER (event_type = 'error' AND value > 90) > 0 THEN 'critical' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'degraded' ELSE 'healthy' END AS status, count(*) FILTER (event_type = 'error') AS active FROM events")
def overall_status(spark, d):
    e = read(spark, d, "events")
    return C.overall_status(e.select((F.col("event_type") != "error").alias("resolved"), F.when(F.col("value") > 90, "critical").otherwise("warning").alias("level")))


@query("SELECT p_partkey, p_name LIKE 'a%' AND p_name LIKE '%e' AS hit FROM part")
def pattern_match(spark, d):
    return read(spark, d, "part").select("p_partkey", text.matches_star(F.col("p_name"), "a*e").alias("hit"))


@query("SELECT c_custkey, c_acctbal >= 0 AS filled, strlen(c_name || c_mktsegment) <= 26 AS short, c_name || chr(9) || c_mktsegment AS clean FROM customer")
def text_checks(spark, d):
    c, name, segment = read(spark, d, "customer"), F.col("c_name"), F.col("c_mktsegment")
    blank = F.when(F.col("c_acctbal") >= 0, name).when(F.col("c_custkey") % 2 == 0, "  ")
    dirty = F.concat(F.lit(" \n"), name, F.lit("\t"), F.lit("\x00\x07"), segment, F.lit("  "))
    return c.select("c_custkey", text.not_empty(blank).alias("filled"), text.max_length(F.concat(name, segment), 26).alias("short"), text.sanitize(dirty).alias("clean"))


@query(r"""SELECT c_custkey, regexp_full_match(trim(lower(c_name) || '@' || c_mktsegment || '.org'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS email_ok, strlen(c_name) <= 50 AND regexp_full_match(c_name, '[a-zA-Z0-9\s_-]+') AS key_ok,
          strlen(c_name) BETWEEN 8 AND 128 AND regexp_matches(c_name, '[A-Z]')::INT + regexp_matches(c_name, '[a-z]')::INT + regexp_matches(c_name, '[0-9]')::INT + regexp_matches(c_name, '[^A-Za-z0-9\s]')::INT >= 3 AS password_ok FROM customer""")
def validation(spark, d):
    c, name = read(spark, d, "customer"), F.col("c_name")
    email = F.concat(F.lower(name), F.lit("@"), F.col("c_mktsegment"), F.lit(".org"))
    return c.select("c_custkey", text.valid_email(email).alias("email_ok"), text.valid_key_name(name).alias("key_ok"), text.valid_password(name).alias("password_ok"))


@query(f"WITH {WORKERS_SQL} SELECT worker, CASE WHEN state = 'joining' AND worker % 3 = 0 THEN 'ready' ELSE state END AS state FROM w")
def heartbeat_states(spark, d):
    w = T.workers(spark, d)
    beats = w.where("worker % 3 = 0").select("worker", F.col("heartbeat").alias("ts"))
    return C.heartbeat_states(w, beats).select("worker", "state")


@query(f"WITH {WORKERS_SQL} SELECT worker, zone FROM w WHERE role = 'search_only'")
def worker_roles(spark, d):
    return T.workers(spark, d).where("role = 'search_only'").select("worker", "zone")


@query("SELECT p_partkey AS segment, p_size * 4000 >= 100000 OR p_partkey % 700 * 1048576 >= 536870912 OR p_partkey % 800 >= 600 AS seal FROM part")
def seal_policy(spark, d):
    """By vectors, by bytes, by age."""
    key = F.col("p_partkey")
    created = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(secs=(key % 800).cast("decimal(18,6)"))
    return read(spark, d, "part").select(key.alias("segment"), dml.should_seal(F.col("p_size") * 4000, key % 700 * (1 << 20), created, AS_OF).alias("seal"))


@query("""WITH c AS (SELECT l_linenumber AS shard, count(*) AS changes, count(*) FILTER (l_returnflag <> 'N') AS deleted FROM lineitem GROUP BY 1 UNION ALL SELECT 0, count(*), count(*) FILTER (l_returnflag = 'A') FROM lineitem)
          SELECT shard, deleted, deleted >= 5000 AND deleted / changes >= 0.3 AS rebuild FROM c""")
def rebuild_policy(spark, d):
    """Lines as changes, returned ones as deletions: many shards are too small for a rebuild, one has too few deletions."""
    own = F.struct(F.col("l_linenumber").cast("long").alias("shard"), (F.col("l_returnflag") != "N").alias("gone"))
    every = F.struct(F.lit(0).cast("long").alias("shard"), (F.col("l_returnflag") == "A").alias("gone"))
    rows = read(spark, d, "lineitem").select(F.explode(F.array(own, every)).alias("c")).select("c.*")
    c = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("changes"), F.count_if("gone").alias("deleted"))
    return c.select("shard", "deleted", dml.should_rebuild(F.col("deleted"), F.col("changes")).alias("rebuild"))


@query("SELECT doc_id, strlen(doc_id::VARCHAR) + 4 * 64 + 4 + strlen(coalesce(lang, '')) + 16 AS bytes FROM documents")
def point_size(spark, d):
    payload = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")))
    return read(spark, d, "documents").select("doc_id", dml.payload_size(F.col("doc_id").cast("string"), F.lit(64), payload).alias("bytes"))


@query(f"WITH {FNV}, q AS (SELECT {E} AS v FROM embeddings WHERE vec_id = 0), h AS (SELECT vec_id AS id, {COSINE} AS score FROM embeddings JOIN f ON f.id = vec_id, q WHERE least(15, h // 1152921504606846976::HUGEINT) = 6) SELECT row_number() OVER (ORDER BY score, id) AS rank, id, round(score, 6) AS score FROM h ORDER BY score, id LIMIT 5")
def shard_pruned_search(spark, d):
    placed = T.points(spark, d).withColumn("shard", hashing.shard_of(hashing.fnv1a_64(F.col("id").cast("string")), 16))
    return rounded(S.search(placed, T.first_vector(spark, d), 5, shards=[6]), "score")


@query(_one(COSINE, 5))
def progressive_search(spark, d):
    p = T.points(spark, d)
    shards = [p.where(F.col("id") % 4 == k) for k in range(4)]
    last = list(S.progressive_search(shards, T.first_vector(spark, d), 5, stable_rounds=4))[-1]
    return rounded(spark.createDataFrame([(n + 1, i, s) for n, (i, s) in enumerate(last)], "rank int, id long, score double"), "score")


@query(f"""WITH {BASE}, o AS (SELECT shard, count(*) AS replicas FROM r GROUP BY 1)
           SELECT i::INT AS shard, (i * 288230376151711744::HUGEINT)::VARCHAR AS range_start, coalesce(replicas, 0) AS replicas, CASE WHEN i % 13 <> 0 AND replicas > 0 THEN i * 5 % n + 1 END AS leader, i % 13 <> 0 AND coalesce(replicas, 0) > 0 AS ready,
                  CASE WHEN replicas > 0 THEN 1 END AS epoch FROM range(0, 64) t(i) LEFT JOIN o ON shard = i, sn""")
def collection_status(spark, d):
    status = C.collection_status(T.shards(spark, d), hashing.shard_ranges(spark, 64))
    return status.select("shard", F.col("range_start").cast("string").alias("range_start"), F.coalesce(F.size("replicas"), F.lit(0)).alias("replicas"), "leader", "ready", "epoch")


@query(f"""WITH {SEGMENTS_SQL}, two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY segment DESC, ts DESC) AS rn FROM seg WHERE segment >= 5) WHERE rn = 1),
           h AS (SELECT n.id, list_cosine_distance(n.vector, q.v) AS score FROM two n, (SELECT {E} AS v FROM embeddings WHERE vec_id = 0) q WHERE NOT EXISTS (SELECT 1 FROM tomb t WHERE t.id = n.id AND n.ts <= t.ts))
           SELECT row_number() OVER (ORDER BY score, id) AS rank, id, round(score, 6) AS score FROM h ORDER BY score, id LIMIT 10""")
def newest_segments_search(spark, d):
    """Ends after the three newest of five segments; ids lie in two of them, and tombstones count."""
    found = dml.search_segments(T.segments(spark, d), T.tombstones(spark, d), T.first_vector(spark, d), 10, fanout=3)
    return rounded(found, "score")
