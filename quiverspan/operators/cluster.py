"""Cluster-state analytics: load, placement, health, repair and rebalancing as queries over worker and shard tables."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of a live heartbeat, replicas, thresholds of hot shards, weights of moving averages.
HEARTBEAT_S, MAX_REPLICAS, REPLICATION = 30, 5, 3
HOT_QPS, HOT_LATENCY_MS = 1000, 100
EWMA_OLD, EWMA_NEW = 0.7, 0.3
OVER = 1.3


def capacity_score(cpu: Column, memory: Column, disk: Column) -> Column:
    """Weighted sizes against 8 cores, 32 GiB and 500 GiB, truncated, 100 at least."""
    score = cpu / F.lit(8.0) * 300 + memory / F.lit(float(32 << 30)) * 400 + disk / F.lit(float(500 << 30)) * 300
    return F.greatest(F.lit(100), score.cast("long"))


def load_score(cpu: Column, memory: Column, disk: Column, qps: Column, shards: Column) -> Column:
    return 0.3 * cpu + 0.3 * memory + 0.15 * disk + 15 * F.least(qps / 1000, F.lit(1.0)) + 10 * F.least(shards / 100, F.lit(1.0))


def healthy(as_of: datetime) -> Column:
    return (F.col("state") == "ready") & (F.lit(as_of).cast("timestamp").cast("double") - F.col("heartbeat").cast("double") < HEARTBEAT_S)


def eligible(as_of: datetime) -> Column:
    return healthy(as_of) & (F.col("role") != "search_only")


def by_load_ratio(workers: DataFrame, as_of: datetime) -> DataFrame:
    ratio = F.col("load") / F.greatest(F.col("capacity"), F.lit(100))
    return workers.where(eligible(as_of)).withColumn("ratio", ratio).orderBy("ratio", "worker")


def by_capacity(workers: DataFrame) -> DataFrame:
    return workers.orderBy(F.desc("capacity"), "worker")


def place_replicas(workers: DataFrame, rf: int = REPLICATION) -> DataFrame:
    """rf workers by order of ratio: first one of each zone, then one of each rack not yet used, then any. Worker tables
    are small; the windows run over them alone."""
    order = [F.col("ratio"), F.col("worker")]
    zoned = workers.withColumn("in_zone", F.row_number().over(Window.partitionBy("zone").orderBy(*order)))
    first = zoned.where("in_zone = 1").orderBy(*order).limit(rf)
    used = first.select("zone", "rack").distinct()
    racks = zoned.join(first.select("worker"), "worker", "left_anti").withColumn("in_rack", F.row_number().over(Window.partitionBy("zone", "rack").orderBy(*order)))
    racks = racks.join(used.withColumn("taken", F.lit(True)), ["zone", "rack"], "left")
    fresh = (F.col("in_rack") == 1) & F.col("taken").isNull()
    every = first.select("worker", "zone", "rack", "ratio", F.lit(1).alias("pass")).unionByName(racks.select("worker", "zone", "rack", "ratio", F.when(fresh, 2).otherwise(3).alias("pass")))
    ranked = every.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pass", *order)))
    return ranked.where(F.col("place") <= rf)


def ewma(samples: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """0.7 * old + 0.3 * new over each key's samples in order, beginning with the first: key, ewma, samples.

    A sample is an affine step, and steps compose. Samples are range-partitioned by key and order, so that a hot key
    spreads over many tasks; each task folds what it has of a key to one step, and a key's steps, one a task, compose in
    order. Null values and keys don't count."""
    own = samples.select(key, *order, F.col(value).cast("double").alias("__value")).where(F.col(key).isNotNull() & F.col("__value").isNotNull())
    placed = own.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(key, "__value", F.spark_partition_id().alias("__part"))
    kind = samples.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: dict = {}  # key: part, first value, number, and the fold of what follows the first as scale and shift
        for b in batches:
            for k, v, p in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (s := steps.get(k)) is None:
                    steps[k] = [p, v, 1, 1.0, 0.0]
                else:
                    s[2], s[3], s[4] = s[2] + 1, s[3] * EWMA_OLD, s[4] * EWMA_OLD + v * EWMA_NEW
        if steps:
            columns = [list(steps), *map(list, zip(*steps.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.types)], schema=fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"{key} {kind}, part int, first double, n long, scale double, shift double")
    fields = to_arrow_schema(schema)
    steps = placed.mapInArrow(fold, schema).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", "first", "scale", "shift", "n"))).alias("steps"))
    step = lambda s, x: (s * EWMA_OLD + x["first"] * EWMA_NEW) * x["scale"] + x["shift"]
    start = F.col("steps")[0]["first"] * F.col("steps")[0]["scale"] + F.col("steps")[0]["shift"]
    total = F.aggregate(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), start, step)
    return steps.select(key, total.alias("ewma"), F.aggregate("steps", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("samples"))


def replica_rows(shards: DataFrame) -> DataFrame:
    return shards.select("shard", F.explode("replicas").alias("worker"))


def under_replicated(shards: DataFrame, workers: DataFrame, as_of: datetime, rf: int = REPLICATION) -> DataFrame:
    """Shards with fewer healthy replicas than rf (kept within 1 and 5)."""
    rf = min(MAX_REPLICAS, max(1, rf))
    good = workers.where(healthy(as_of)).select("worker", F.lit(1).alias("good"))
    counted = shards.select("shard", F.explode_outer("replicas").alias("worker")).join(good, "worker", "left").groupBy("shard").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("healthy_replicas"))
    return counted.where(F.col("healthy_replicas") < rf)


def hot_shards(shards: DataFrame) -> DataFrame:
    reason = F.when(F.col("qps") > HOT_QPS, "high_qps").when(F.col("latency_ms") > HOT_LATENCY_MS, "high_latency")
    return shards.withColumn("reason", reason).where("reason IS NOT NULL")


def shard_distribution(shards: DataFrame, workers: DataFrame) -> DataFrame:
    counts = replica_rows(shards).groupBy("worker").agg(F.count(F.lit(1)).alias("n"))
    return workers.select("worker").join(counts, "worker", "left").select("worker", F.coalesce("n", F.lit(0)).alias("replicas"))


def health_report(workers: DataFrame, shards: DataFrame, as_of: datetime, rf: int = REPLICATION) -> DataFrame:
    w = workers.agg(F.count(F.lit(1)).alias("workers"), F.count_if(healthy(as_of)).alias("healthy_workers"))
    s = shards.agg(F.count(F.lit(1)).alias("shards"), F.count_if(F.col("leader").isNull()).alias("leaderless_shards"))
    u = under_replicated(shards, workers, as_of, rf).agg(F.count(F.lit(1)).alias("under_replicated"))
    h = hot_shards(shards).agg(F.count(F.lit(1)).alias("hot_shards"))
    return w.crossJoin(s).crossJoin(u).crossJoin(h)  # four single rows


def repair_plan(shards: DataFrame, workers: DataFrame, as_of: datetime, rf: int = REPLICATION) -> DataFrame:
    """Workers to add to each under-replicated shard: healthy, without a replica of it, least loaded first."""
    short = under_replicated(shards, workers, as_of, rf).join(shards.select("shard", "replicas"), "shard")
    short = short.withColumn("wanted", F.least(rf - F.col("healthy_replicas"), MAX_REPLICAS - F.size("replicas"))).where("wanted > 0")
    able = workers.where(eligible(as_of)).select("worker", "ratio")
    pairs = short.join(F.broadcast(able), ~F.array_contains("replicas", F.col("worker")))
    ranked = pairs.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("ratio", "worker")))
    return ranked.where("place <= wanted").select("shard", "worker", "place")


def workers_for(shards: DataFrame, workers: DataFrame, as_of: datetime) -> DataFrame:
    """Replica holders, and healthy search-only workers: a distinct union."""
    helpers = workers.where(healthy(as_of) & (F.col("role") == "search_only")).select("worker")
    return replica_rows(shards).select("worker").union(helpers).distinct()


def rebalance_plan(shards: DataFrame, workers: DataFrame, as_of: datetime, most: int = 10, rf: int = REPLICATION) -> list[tuple]:
    """(shard, source, target, reason): all shards of draining workers; then, up to most moves, from workers above 1.3 times
    the mean number of replicas to those below the mean over 1.3, only shards with two healthy replicas; then hot shards
    from their leaders to where there is most room for the capacity. Targets are healthy data workers without the shard.

    One move after the other, as each changes the counts. What the driver reads are a count for each worker, and the
    replicas of the shards that a draining, overloaded or leading worker of a hot shard holds."""
    state = workers.select("worker", "capacity", "state", healthy(as_of).alias("healthy"), eligible(as_of).alias("able"))
    rows = {r["worker"]: r for r in shard_distribution(shards, workers).join(state, "worker").collect()}
    count = {w: r["replicas"] for w, r in rows.items()}
    able = sorted(w for w, r in rows.items() if r["able"])
    if len(able) < 2:
        return []
    mean = shards.count() * rf / len(able)
    draining = sorted(w for w, r in rows.items() if r["state"] == "draining")
    over = sorted((w for w in able if count[w] > mean * OVER), key=lambda w: (-count[w], w))
    under = [w for w in able if count[w] < mean / OVER]
    hot = hot_shards(shards).where("leader IS NOT NULL").select("shard", "leader", "reason").orderBy(F.desc("qps"), "shard").limit(most).collect()
    sources = workers.sparkSession.createDataFrame([(w,) for w in {*draining, *over}], workers.select("worker").schema)
    held = replica_rows(shards).join(sources, "worker", "left_semi").select("shard").union(workers.sparkSession.createDataFrame([(h["shard"],) for h in hot], shards.select("shard").schema))
    own = {r["shard"]: list(r["replicas"]) for r in shards.select("shard", "replicas").join(held.distinct(), "shard", "left_semi").collect()}
    moves: list[tuple] = []
    moved = set()

    def move(shard, source, targets: list, reason: str, load) -> bool:
        free = [w for w in targets if w not in own[shard]]
        if shard in moved or not free:
            return False
        target = min(free, key=lambda w: (load(w), w))
        own[shard] = [target if w == source else w for w in own[shard]]
        count[source], count[target] = count[source] - 1, count[target] + 1
        moves.append((shard, source, target, reason))
        moved.add(shard)
        return True

    for source in draining:
        for shard in sorted(s for s, r in own.items() if source in r):
            move(shard, source, able, "drain", count.__getitem__)
    drained = len(moves)
    for source in over:
        for shard in sorted(s for s, r in own.items() if source in r):
            if len(moves) - drained >= most or count[source] <= mean * OVER:
                break
            if sum(rows[w]["healthy"] for w in own[shard] if w in rows) >= 2:
                move(shard, source, [w for w in under if count[w] < mean / OVER], "load_imbalance", count.__getitem__)
    for h in hot:
        if h["leader"] in rows:
            move(h["shard"], h["leader"], able, f"hot_shard_{h['reason']}", lambda w: count[w] / max(1, rows[w]["capacity"]))
    return moves


def edit_replicas(shards: DataFrame, shard, workers: DataFrame, as_of: datetime, add=None, remove=None, rf: int = REPLICATION) -> DataFrame:
    """Membership of one shard with guards; a change bumps the epoch, and what a guard forbids changes nothing.

    add: a worker that exists, is ready and has a live heartbeat, isn't a replica yet, up to 5 of them. remove: a replica,
    as long as rf stay. Both: a move, from a replica to a worker that exists."""
    r, unchanged = F.col("replicas"), F.lit(False)
    able = workers.where(F.col("worker") == F.lit(add))
    there = able.agg(F.count(F.lit(1)).alias("__known"), F.count_if(healthy(as_of)).alias("__healthy"))  # one row
    if add is not None and remove is not None:
        ok = F.array_contains(r, remove) & ~F.array_contains(r, add) & (F.col("__known") > 0)
        new = F.transform(r, lambda w: F.when(w == F.lit(remove), F.lit(add)).otherwise(w))
    elif add is not None:
        ok = ~F.array_contains(r, add) & (F.col("__healthy") > 0) & (F.size(r) < MAX_REPLICAS)
        new = F.array_append(r, F.lit(add))
    elif remove is not None:
        ok = F.array_contains(r, remove) & (F.size(r) > rf)
        new = F.array_remove(r, remove)
    else:
        ok, new = unchanged, r
    fair = (F.col("shard") == F.lit(shard)) & ok
    joined = shards.crossJoin(F.broadcast(there)) if add is not None else shards
    return joined.select(*(F.when(fair, new).otherwise(r).alias(c) if c == "replicas" else F.when(fair, F.col("epoch") + 1).otherwise(F.col("epoch")).alias(c) if c == "epoch" else F.col(c) for c in shards.columns))


def collection_status(shards: DataFrame, ranges: DataFrame) -> DataFrame:
    """shard, range_start, range_end, replicas, leader, epoch, ready (whether it has a leader) of each shard of the ranges."""
    own = shards.select("shard", "replicas", "leader", "epoch")
    return ranges.join(own, "shard", "left").withColumn("ready", F.col("leader").isNotNull())


def endpoint_stats(log: DataFrame, keys: list[str]) -> DataFrame:
    """log: keys, latency, failed."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.avg("latency").alias("mean_latency"), F.sum(F.col("failed").cast("long")).alias("errors"))


def gateway_stats(log: DataFrame) -> DataFrame:
    """log: us (microseconds), failed. Requests, their rate over the span of the log, and the share that failed."""
    span = (F.max("us") - F.min("us")) / 1e6
    n = F.count(F.lit(1))
    return log.agg(n.alias("requests"), F.when(span > 0, n / span).otherwise(0.0).alias("rps"), (F.sum(F.col("failed").cast("double")) / n).alias("error_rate"))


def latency_percentiles(log: DataFrame, key: str, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Nearest-rank percentiles (the value at index int(n * p) in order), mean and population deviation; exact.

    A sketch, which combines before the shuffle, brackets each percentile within some ranks in accuracy. A second pass
    counts what lies below a bracket, again with partial sums, and only the values within are put in order: a hot key
    costs a few rows in accuracy, not all of its rows in one task."""
    v, slack = F.col("v"), 2.0 / accuracy
    own = log.select(key, F.col(value).alias("v")).where(F.col(key).isNotNull() & v.isNotNull())
    ends = [p for x in shares.values() for p in (max(0.0, x - slack), min(1.0, x + slack))]
    n = own.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", ends, accuracy).alias("ends"))
    bracket = F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("at"), (F.col("ends")[2 * i] if p > slack else F.col("least")).alias("low"), (F.col("ends")[2 * i + 1] if p < 1 - slack else F.col("most")).alias("high")) for i, (name, p) in enumerate(shares.items())))
    brackets = n.select(key, F.explode(bracket).alias("b")).select(key, "b.*")
    met = own.groupBy(key, "v").agg(F.count(F.lit(1)).alias("times")).join(brackets, key)
    below = met.groupBy(key, "name").agg(F.sum(F.when(v < F.col("low"), F.col("times")).otherwise(0)).alias("below"))
    within = met.where((v >= F.col("low")) & (v <= F.col("high"))).join(below, [key, "name"])
    upto = within.withColumn("upto", F.col("below") + F.sum("times").over(Window.partitionBy(key, "name").orderBy("v")))
    found = upto.where("upto > at").groupBy(key).agg(*(F.min(F.when(F.col("name") == name, v)).alias(name) for name in shares))
    return n.select(key, "n", "mean", "stddev").join(found, key)


def heartbeat_states(workers: DataFrame, beats: DataFrame) -> DataFrame:
    """joining and unknown become ready with the first heartbeat; the newest heartbeat stays."""
    newest = beats.groupBy("worker").agg(F.max("ts").alias("beat"))
    joined = workers.join(newest, "worker", "left")
    state = F.when(F.col("beat").isNotNull() & F.col("state").isin("joining", "unknown"), "ready").otherwise(F.col("state"))
    return joined.withColumn("state", state).withColumn("heartbeat", F.greatest("heartbeat", "beat")).drop("beat")


def filter_alerts(alerts: DataFrame, status: str | None = None, level: str | None = None) -> DataFrame:
    if status:
        alerts = alerts.where(F.col("resolved") == F.lit(status == "resolved"))
    return alerts.where(F.col("level") == level) if level else alerts


def overall_status(alerts: DataFrame) -> DataFrame:
    """One row: critical if an unresolved alert is, degraded if there is any, else healthy."""
    live = ~F.col("resolved")
    status = F.when(F.count_if(live & (F.col("level") == "critical")) > 0, "critical").when(F.count_if(live) > 0, "degraded").otherwise("healthy")
    return alerts.agg(status.alias("status"), F.count_if(live).alias("active"))
