"""Structured Streaming forms: messages that come late or twice, revisions, windows, sessions, leases."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.guard.inspect import admit_documents
from gradelake.guard.language import SUPPORTED, Profiles
from gradelake.sources.replace import ReplaceByKey
from gradelake.streaming.stateful import LatestRevisions, Lease, Phases, Stuck, SubmitOnce, process


def dedupe_messages(stream: DataFrame, key: str = "job_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the time that messages may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def latest_answers(
    stream: DataFrame, key: str = "attempt_id", item: str = "question_id", late: str = "1 hour",
    keep: timedelta = timedelta(days=7),
) -> DataFrame:
    """(key, item, revision, event_id): the highest revision of each item of a key, of equal ones the first, whenever it
    changes; older revisions that come late change nothing. A key is forgotten when it has been still for `keep`."""
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, item long, revision long, event_id long"
    out = process(stream, key, LatestRevisions(keep, key, item), schema, late)
    return out.withColumnRenamed("item", item)


def sweep(df: DataFrame, now: Column) -> DataFrame:
    """What is stuck and what to do: queued over 3 minutes is queued again, generating over 20 fails, ready without scores for 5 is scored again (6 tries at most)."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("since").cast("timestamp"))
    action = F.when((F.col("status") == "queued") & (age > 180), "requeue").when((F.col("status") == "generating") & (age > 1200), "fail")
    action = action.when((F.col("status") == "ready") & F.col("scored_at").isNull() & (age > 300) & (F.col("scoring_attempts") < 6), "rescore")
    return df.withColumn("action", action).where("action is not null")


def stream_sweep(stream: DataFrame, tries: int = 6, late: str = "1 minute", keep: timedelta = timedelta(days=1)) -> DataFrame:
    """(quiz_id, action, at_ms): what sweep() finds, found by timers: requeue after 3 minutes in `queued`, fail after 20 in
    `generating`, rescore after 5 in `ready` without scores, once for each time a quiz enters the state. stream: (quiz_id,
    event_id, status, scoring_attempts, ts); other states end the watch."""
    return process(stream, "quiz_id", Stuck(keep, tries), "quiz_id long, action string, at_ms long", late)


def claims(stream: DataFrame, lease_seconds: int = 150, late: str = "10 minutes", keep: timedelta = timedelta(days=7)) -> DataFrame:
    """Each claim of a job granted or refused: granted if no lease runs; a lease lasts so long or until a release. A job
    that has been still for `keep` begins anew. stream: (job_id, event_id, kind claim/release, ts)."""
    schema = "job_id long, event_id long, granted boolean, attempts int"
    return process(stream, "job_id", Lease(keep, lease_seconds), schema, late)


def retry_plan(df: DataFrame, received: str = "received", most: int = 3) -> DataFrame:
    """Delay before the next try, min(300, 20 * 2^(n-1)) seconds, and whether a message goes to the dead letters."""
    n = F.col(received)
    return df.withColumn("delay", F.least(F.lit(300.0), 20 * F.pow(F.lit(2.0), n - 1)).cast("int")).withColumn("dead_letter", n >= most)


def rate_windows(stream: DataFrame, key: str = "user_id", limit: int = 10, late: str = "10 minutes") -> DataFrame:
    """Calls of a user in each minute, and whether they are over the limit."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("window.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def quota_windows(stream: DataFrame, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Rows of a key in each sliding window of 24 hours. State is a row a key and day: the counts of the 24 windows that
    begin on this day, which two days hold. So a row counts in two states and not in 24, and stays countable until the
    second day is over."""
    days = stream.withWatermark("ts", late).select(key, "ts", F.window("ts", "48 hours", "24 hours").alias("days"))
    hour = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("days.start").cast("timestamp"))) / 3600)
    counts = days.withColumn("hour", hour).groupBy("days", key).agg(*(F.count_if(F.col("hour").between(k, k + 23)).alias(f"n{k}") for k in range(24)))
    w = counts.select(key, "days.start", F.posexplode(F.array(*(f"n{k}" for k in range(24)))).alias("k", "n")).where("n > 0")
    return w.select(key, (F.col("start") + F.make_interval(hours=F.col("k"))).alias("start"), "n")


def metric_alarms(stream: DataFrame, mean_floor: float = 0.6, single_floor: float = 0.4, late: str = "1 hour") -> DataFrame:
    """Hourly mean and least value of a metric with the alarms they raise. stream: (metric, value, ts)."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.sum("value").alias("total"))
    return w.select("metric", F.col("window.start").alias("start"), "mean", "least", "total", (F.col("mean") < mean_floor).alias("mean_alarm"), (F.col("least") < single_floor).alias("single_alarm"))


def answer_sessions(stream: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events with no gap of that length."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), (F.unix_timestamp("session_window.end") - F.unix_timestamp("session_window.start")).alias("seconds"), "n")


def submissions(stream: DataFrame, late: str = "1 hour", keep: timedelta = timedelta(days=30)) -> DataFrame:
    """The first submission of each attempt counts; later ones return it and are counted as replays, until the attempt has
    been still for `keep`. stream: (attempt_id, event_id, ts, score)."""
    schema = "attempt_id long, submitted_by long, score double, replays int"
    return process(stream, "attempt_id", SubmitOnce(keep), schema, late)


def phase_updates(stream: DataFrame, late: str = "1 hour", keep: timedelta = timedelta(days=7)) -> DataFrame:
    """Progress applied only while a quiz is generating: after `ready` or `failed` no update changes it. A quiz is forgotten
    when it has been still for `keep`. stream: (quiz_id, event_id, kind, ts)."""
    return process(stream, "quiz_id", Phases(keep), "quiz_id long, status string, steps int, ignored int", late)


def stream_admission(
    stream: DataFrame, table: ReplaceByKey, checkpoint: str, profiles: Profiles, allowed: tuple[str, ...] = SUPPORTED
) -> None:
    """Admit arriving documents (doc_id, text) into a table that has one row for each id, that of its last arrival: a batch
    that is tried again, or delivered again under its number, replaces itself."""

    def admit(batch: DataFrame, batch_id: int) -> None:
        table.write(admit_documents(batch, profiles, allowed=allowed), batch_id)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(admit).start()
    query.awaitTermination()
