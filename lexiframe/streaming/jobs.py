"""Job telemetry: the same transforms for batches and streams.

An event is (id, at, status, delay_ms, out_status, duration_sec, processing_time_sec, agent, token_ok); a job is polled many times and
counts once, when it first reaches a final status.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import day_key, source_key

# Statuses after which a job doesn't change.
FINAL = ["COMPLETED", "FAILED", "CANCELLED", "TIMED_OUT"]
DETAIL_HOURS, STAT_DAYS, STORE_BYTES = 2, 120, 20 << 20


def last_state(events: DataFrame, key: str, at: str, fields: list[str], tie: str) -> DataFrame:
    """One row per key: each field's latest non-null value (later patches win), as partial aggregates."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(at, tie))).alias(c) for c in fields]
    return events.groupBy(key).agg(*latest, F.max(at).alias(at), F.count("*").alias("patches"))


def finished_once(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The first event of each key with a final status."""
    rest = [c for c in events.columns if c not in (key, at, tie)]
    first = events.where(F.col("status").isin(FINAL)).groupBy(key).agg(F.min(F.struct(at, tie, *rest)).alias("r"))
    return first.select(key, *[F.col(f"r.{c}").alias(c) for c in (at, tie, *rest)])


def with_measures(finished: DataFrame) -> DataFrame:
    """Adds failed, audio_sec, proc_sec and queue_sec."""
    failed = (F.col("status") != "COMPLETED") | (F.coalesce(F.col("out_status"), F.lit("success")) != "success")
    return finished.withColumn("failed", failed).withColumn("queue_sec", F.col("delay_ms") / 1000.0)


def daily_stats(finished: DataFrame, at: str) -> DataFrame:
    d = with_measures(finished)
    return d.groupBy(day_key(F.col(at)).alias("day")).agg(F.count("*").alias("jobs"), F.count_if("failed").alias("errors"), F.sum("duration_sec").alias("audio_sec"), F.sum("processing_time_sec").alias("proc_sec"), F.sum("queue_sec").alias("queue_sec"))


def bounded_counter(events: DataFrame, day: str, source: str, at: str, tie: str, most: int = 12, other: str = "boshqa") -> DataFrame:
    """(day, source, n): counts of the `most` sources seen first on each day; the rest go to other. Sources are aggregated before they are
    ranked."""
    per = events.groupBy(day, source).agg(F.count("*").alias("n"), F.min(F.struct(at, tie)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(day).orderBy("first", source))
    named = per.withColumn("source2", F.when(rank <= most, F.col(source)).otherwise(F.lit(other)))
    return named.groupBy(day, F.col("source2").alias(source)).agg(F.sum("n").alias("n"))


def feed(states: DataFrame, at: str, key: str, n: int = 200) -> DataFrame:
    return states.orderBy(F.desc(at), key).limit(n)


def by_day(stats: DataFrame) -> DataFrame:
    """Daily statistics from the oldest day on."""
    return stats.orderBy("day")


def unexpired(stats: DataFrame, day: str, now: str, days: int = STAT_DAYS) -> DataFrame:
    """Daily statistics of the last `days` days before now (a date); older ones have expired."""
    return stats.where(F.to_date(F.col(day)) > F.date_sub(F.to_date(F.lit(now)), days))


def storable(df: DataFrame, content: str, most: int = STORE_BYTES) -> DataFrame:
    """Adds kind, stored or too_big, and bytes; what is too big is to be noted and not kept. Null contents have null."""
    n = F.octet_length(content)
    return df.withColumn("bytes", n.cast("long")).withColumn("kind", F.when(n > most, "too_big").when(n.isNotNull(), "stored"))


def stream_counters(events: DataFrame, folder: str, day: str, source: str, at: str, tie: str, checkpoint: str, most: int = 12):
    """Streaming form of the counters by source: each batch is added to the counts so far (partial counts with their first event, so that
    the order of sources is that of all events) and written as a version of its own, so that a repeated batch counts once. Returns the
    writer; `counters_of` reads the newest version."""

    def add(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        part = batch.groupBy(day, source).agg(F.count("*").alias("n"), F.min(F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))).alias("first"))
        if k > 0:
            part = part.unionByName(spark.read.parquet(f"{folder}/v{k - 1}"))
        part.groupBy(day, source).agg(F.sum("n").alias("n"), F.min("first").alias("first")).write.mode("overwrite").parquet(f"{folder}/v{k}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def counters_of(counts: DataFrame, day: str, source: str, most: int = 12, other: str = "boshqa") -> DataFrame:
    """(day, source, n) of a version written by stream_counters."""
    rank = F.row_number().over(Window.partitionBy(day).orderBy("first", source))
    return counts.withColumn("_s", F.when(rank <= most, F.col(source)).otherwise(F.lit(other))).groupBy(day, F.col("_s").alias(source)).agg(F.sum("n").alias("n"))


def pull_until(rows: DataFrame, keep, n: int, folder: str, checkpoint: str, order: list[str]) -> int:
    """Streaming ingest that stops at n kept rows: takes batch by batch (the reader says how many files a batch has), writes the rows that
    pass `keep`, in order, up to n in all, and stops the query when they are there. Returns how many there are."""
    kept = {}

    def take(batch: DataFrame, k: int) -> None:
        have = sum(v for b, v in kept.items() if b < k)
        out = f"{folder}/batch={k}"
        batch.where(F.coalesce(keep, F.lit(False))).orderBy(*order).limit(max(0, n - have)).write.mode("overwrite").parquet(out)
        kept[k] = batch.sparkSession.read.schema(batch.schema).parquet(out).count()

    q = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while q.isActive and sum(kept.values()) < n:
        q.awaitTermination(1)
    q.stop()
    if q.exception() is not None:
        raise q.exception()
    return min(n, sum(kept.values()))


def stream_early_stop(steps: DataFrame, run: str, step: str, loss: str, patience: int) -> DataFrame:
    """Streaming form of the early stop: (run, stop_step) once per run, when `patience` evaluations in a row brought no new least loss. Steps
    of a run must come in order from batch to batch; within a batch they are sorted."""

    def follow(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, since, done = state.get if state.exists else (float("inf"), 0, False)
        out = []
        every = [b[[step, loss]] for b in batches]
        for at, x in pd.concat(every).sort_values(step).itertuples(index=False):
            if done or x is None or x != x:
                continue
            best, since = (x, 0) if x < best else (best, since + 1)
            if since >= patience:
                done = True
                out.append((k[0], at))
        state.update((best, since, done))
        yield pd.DataFrame(out, columns=[run, "stop_step"])

    kinds = {c: steps.schema[c].dataType.simpleString() for c in (run, step)}
    return steps.groupBy(run).applyInPandasWithState(follow, f"{run} {kinds[run]}, stop_step {kinds[step]}", "best double, since int, done boolean", "append", GroupStateTimeout.NoTimeout)


def stream_daily(events: DataFrame, key: str, at: str, lateness: str = "1 day") -> DataFrame:
    """Streaming form of daily_stats: final events, once per key within the watermark, in daily windows."""
    d = events.withWatermark(at, lateness).where(F.col("status").isin(FINAL)).dropDuplicatesWithinWatermark([key])
    return with_measures(d).groupBy(F.window(at, "1 day")).agg(F.count("*").alias("jobs"), F.count_if("failed").alias("errors"), F.sum("duration_sec").alias("audio_sec"), F.sum("processing_time_sec").alias("proc_sec"), F.sum("queue_sec").alias("queue_sec")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "jobs", "errors", "audio_sec", "proc_sec", "queue_sec")


def stream_states(events: DataFrame, key: str, at: str, hours: int = DETAIL_HOURS, lateness: str = "1 day") -> DataFrame:
    """Streaming merge of patches per job: emits (key, status, duration_sec, counted) at each change; a job's state is dropped `hours`
    after its last event, by event time."""

    def merge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, seconds, counted = state.get if state.exists else (None, None, False)
        newly, latest = False, 0
        for b in batches:
            latest = max(latest, int(b[at].max().timestamp() * 1000))
            for s, d in b.sort_values(at)[["status", "duration_sec"]].itertuples(index=False):
                status = s if s is not None and not (isinstance(s, float) and s != s) else status
                seconds = d if d is not None and d == d else seconds
                if status in FINAL and not counted:
                    counted = newly = True
        state.update((status, seconds, counted))
        state.setTimeoutTimestamp(max(latest + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "status": [status], "duration_sec": [seconds], "counted": [newly]})

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark(at, lateness).groupBy(key).applyInPandasWithState(merge, f"{key} {kind}, status string, duration_sec double, counted boolean", "status string, seconds double, counted boolean", "append", GroupStateTimeout.EventTimeTimeout)


def agents(events: DataFrame, agent: str) -> DataFrame:
    return events.withColumn("source", source_key(F.col(agent)))
