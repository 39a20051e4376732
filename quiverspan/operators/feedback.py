"""Relevance feedback: sessions, items, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def validate_items(items: DataFrame) -> DataFrame:
    """The items, or an error at run time for a relevance outside 1 to 5."""
    ok = F.coalesce(F.col("relevance_score").between(1, 5), F.lit(False))
    return items.withColumn("relevance_score", F.when(ok, F.col("relevance_score")).otherwise(F.raise_error(F.lit("relevance_score must be 1 to 5"))))


def store(sessions: DataFrame, items: DataFrame, path: str) -> DataFrame:
    """Appends feedback under path: sessions (ref, collection, query, user_id, created_at) get an id of their own, and their
    items (ref, result_id, relevance_score, clicked, position) its number. A session without an item, or a relevance
    outside 1 to 5, is an error, before anything is written. Returns the stored sessions."""
    some = items.select("ref").distinct().withColumn("__has", F.lit(True))
    checked = sessions.join(some, "ref", "left").withColumn("ref", F.when(F.col("__has"), F.col("ref")).otherwise(F.raise_error(F.lit("feedback needs an item")).cast("string")))
    named = written(checked.drop("__has").withColumn("id", F.uuid()), "feedback")  # ids are drawn once
    own = written(validate_items(items).join(named.select("ref", F.col("id").alias("session_id")), "ref").drop("ref"), "feedback")
    own.write.mode("append").parquet(f"{path}/items")
    named.drop("ref").write.mode("append").parquet(f"{path}/sessions")
    return named


def by_collection(sessions: DataFrame, items: DataFrame, collection: str, limit: int = 100) -> DataFrame:
    """The collection's newest sessions (limit of 0 or less: 100) with their items nested by position."""
    newest = sessions.where(F.col("collection") == collection).orderBy(F.desc("created_at"), "id").limit(limit if limit > 0 else 100)
    own = items.select(F.col("session_id").alias("of"), F.struct("position", "result_id", "relevance_score", "clicked").alias("item"))
    joined = newest.join(own, F.col("id") == F.col("of"), "left")
    return joined.groupBy("id", "query", "created_at").agg(F.sort_array(F.collect_list("item")).alias("items"))


def of_session(items: DataFrame, session: str) -> DataFrame:
    return items.where(F.col("session_id") == session).orderBy("position")


def stats(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Per collection: average relevance, items, clicks, sessions with items, click-through rate."""
    joined = sessions.select("id", "collection").join(items, F.col("id") == F.col("session_id"))
    clicks = F.sum(F.when(F.col("clicked"), 1).otherwise(0))
    return joined.groupBy("collection").agg(F.avg("relevance_score").alias("avg_relevance"), F.count(F.lit(1)).alias("total_feedback"), clicks.alias("clicks"), F.countDistinct("id").alias("total_sessions"), (clicks / F.count(F.lit(1))).alias("ctr"))
