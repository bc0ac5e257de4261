"""Streaming queries, run over all events there are, and their batch SQL."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.guard import language
from gradelake.plans.catalog import ALL, Query
from gradelake.plans.guarding import planted
from gradelake.sources.replace import ReplaceByKey
from gradelake.sources.shared import drain, shared_dir
from gradelake.streaming import jobs as J

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them: a path that is no pattern must be a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


class StreamQuery(Query):
    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.make(events_stream(spark, sf_dir))


def stream(name: str, sql: str | None = None):
    def add(f):
        ALL[name] = StreamQuery(name, ("events",), f, sql)
        return f

    return add


@stream("j1_dedupe_messages", "select event_type job, count(*) n from (select distinct event_type, user_id from events) x group by event_type")
def j1(e):
    once = J.dedupe_messages(e.withColumn("job_id", F.concat_ws("-", "event_type", "user_id")), late="60 days")
    return drain(once, "append").groupBy(F.col("event_type").alias("job")).agg(F.count(F.lit(1)).alias("n"))


@stream("j2_latest_answers", "select attempt_id, question_id, event_id, revision from (select *, row_number() over (partition by attempt_id, question_id order by revision desc, ts, event_id) r from (select event_id, ts, user_id attempt_id, event_id % 11 question_id, event_id % 7 revision from events) e) x where r = 1")
def j2(e):
    rows = e.select("event_id", "ts", F.col("user_id").alias("attempt_id"), (F.col("event_id") % 11).alias("question_id"), (F.col("event_id") % 7).alias("revision"))
    return drain(J.latest_answers(rows), "append", ("attempt_id", "question_id")).select("attempt_id", "question_id", "event_id", "revision")


#: Claims in order, each judged by the lease that the one before has left: what no window can say, a recursion can.
@stream("j4_claims", """
    with recursive e as (select user_id job, event_id, epoch_ms(ts) t, event_type = 'error' rel, row_number() over (partition by user_id order by ts, event_id) r from events),
    s(job, r, event_id, rel, granted, until, attempts) as (
        select job, r, event_id, rel, not rel, case when rel then 0 else t + 150000 end, case when rel then 0 else 1 end from e where r = 1
        union all select e.job, e.r, e.event_id, e.rel, not e.rel and e.t >= s.until, case when e.rel then 0 when e.t >= s.until then e.t + 150000 else s.until end, s.attempts + case when not e.rel and e.t >= s.until then 1 else 0 end from s join e on e.job = s.job and e.r = s.r + 1)
    select job job_id, event_id, granted, cast(attempts as int) attempts from s where not rel""")  # fmt: skip
def j4(e):
    rows = e.select("event_id", "ts", F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "error", "release").otherwise("claim").alias("kind"))
    return drain(J.claims(rows, keep=timedelta(days=400)), "append")


@stream("j6_rate_windows", "select user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') as start, count(*) n, count(*) > 1 as over from events group by user_id, date_trunc('minute', ts)")
def j6(e):
    out = drain(J.rate_windows(e, limit=1), "update", ("user_id", "start"))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@stream("j7_quota_windows", """
    select user_id, strftime(w, '%Y-%m-%d %H:%M') as start, count(*) n from (select user_id, date_trunc('hour', ts) - k * interval '1' hour w from events, (select unnest(range(24)) k) ks) x group by user_id, w""")  # fmt: skip
def j7(e):
    out = drain(J.quota_windows(e), "update", ("user_id", "start"))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@stream("j8_metric_alarms", """
    select event_type metric, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, round(avg(value / 500), 6) mean, round(min(value / 500), 6) least, avg(value / 500) < 0.6 mean_alarm, min(value / 500) < 0.4 single_alarm from events group by event_type, date_trunc('hour', ts)""")  # fmt: skip
def j8(e):
    rows = e.select(F.col("event_type").alias("metric"), (F.col("value") / 500).alias("value"), "ts")
    out = drain(J.metric_alarms(rows), "update", ("metric", "start"))
    return out.select("metric", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), "mean_alarm", "single_alarm")


@stream("j9_answer_sessions", """
    with s as (select user_id, ts, sum(case when ts - p < interval '6' hour then 0 else 1 end) over (partition by user_id order by ts, event_id) g from (select *, lag(ts) over (partition by user_id order by ts, event_id) p from events) x)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) n from s group by user_id, g""")  # fmt: skip
def j9(e):
    out = drain(J.answer_sessions(e, gap="6 hours"), "complete", ("user_id", "start"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@stream("j11_submissions", "select attempt_id, arg_min(event_id, (ts, event_id)) submitted_by, cast(count(*) - 1 as int) replays from (select user_id * 5 + event_id % 5 attempt_id, event_id, ts from events) x group by attempt_id")
def j11(e):
    rows = e.select((F.col("user_id") * 5 + F.col("event_id") % 5).alias("attempt_id"), "event_id", "ts", F.col("value").alias("score"))
    return drain(J.submissions(rows), "append", ("attempt_id",)).select("attempt_id", "submitted_by", "replays")


KINDS = "(select user_id quiz_id, event_id, ts, case when event_id % 40 = 0 then 'ready' when event_id % 41 = 0 then 'failed' else 'step' end kind from events)"


@stream("j12_phase_updates", f"""
    with k as (select *, row_number() over (partition by quiz_id order by ts, event_id) r from {KINDS} x), f as (select quiz_id, min(r) filter (where kind <> 'step') fr, arg_min(kind, r) filter (where kind <> 'step') fk, count(*) n from k group by quiz_id)
    select quiz_id, coalesce(fk, 'generating') as status, cast(coalesce(fr - 1, n) as int) steps, cast(coalesce(n - fr, 0) as int) ignored from f""")  # fmt: skip
def j12(e):
    kind = F.when(F.col("event_id") % 40 == 0, "ready").when(F.col("event_id") % 41 == 0, "failed").otherwise("step")
    return drain(J.phase_updates(e.select(F.col("user_id").alias("quiz_id"), "event_id", kind.alias("kind"), "ts")), "append", ("quiz_id",))


@stream("j3_stream_sweep", """
    with e as (select user_id quiz_id, event_id, epoch_us(ts) // 1000 t, event_id % 4 k, event_id % 8 tries, lead(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) next from events),
    d as (select quiz_id, case k when 0 then 'requeue' when 1 then 'fail' else 'rescore' end action, t + case k when 0 then 180000 when 1 then 1200000 else 300000 end due, next from e where k < 2 or (k = 2 and tries < 6))
    select quiz_id, action, due at_ms from d where next > due or (next is null and due <= (select max(epoch_us(ts) // 1000) - 60000 from events))""")  # fmt: skip
def j3_stream(e):
    status = F.element_at(F.array(*map(F.lit, ("queued", "generating", "ready", "failed"))), (1 + F.col("event_id") % 4).cast("int"))
    rows = e.select(F.col("user_id").alias("quiz_id"), "event_id", status.alias("status"), (F.col("event_id") % 8).alias("scoring_attempts"), "ts")
    return drain(J.stream_sweep(rows), "append")


class DocumentStream(Query):
    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return self.make(table_stream(spark, sf_dir, "documents"), docs)


def j10(stream, docs):
    """Admission of a stream of documents of 200 letters or more; then the stream is delivered anew, under the same batch
    numbers, and changes nothing."""
    spark, base = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/admitted-{uuid.uuid4().hex}"
    some = planted(stream.where(F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) >= 200))
    table, profiles = ReplaceByKey(spark, f"{base}/table", ("doc_id",), merge_at=2), language.fit(docs)
    for run in range(2):
        J.stream_admission(some, table, f"{base}/checkpoint-{run}", profiles)
    return table.read().select("doc_id", "outcome")


ALL["j10_stream_admission"] = DocumentStream("j10_stream_admission", ("documents",), j10, """
    select doc_id, case when lang in ('fr', 'de') then 'unsupported_language' when doc_id % 10 in (2, 3, 4, 5, 6, 7, 8) then 'unsafe_document' else 'admitted' end outcome
    from documents where length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) >= 200""")  # fmt: skip


def _batch(name: str, reads: tuple[str, ...], sql: str):
    def add(f):
        ALL[name] = Query(name, reads, f, sql)
        return f

    return add


@_batch("j5_retry_plan", ("events",), "select event_id, cast(least(300, 20 * pow(2, event_id % 7)) as int) delay, event_id % 7 + 1 >= 3 dead_letter from events")
def j5(events):
    return J.retry_plan(events.select("event_id", (F.col("event_id") % 7 + 1).alias("received"))).select("event_id", "delay", "dead_letter")


@_batch("j3_sweep", ("events",), """
    select event_id, case when event_id % 3 = 0 then 'requeue' when event_id % 3 = 1 then 'fail' else 'rescore' end action from events
    where case event_id % 3 when 0 then ts < timestamp '2024-01-15 11:57:00' when 1 then ts < timestamp '2024-01-15 11:40:00' else ts < timestamp '2024-01-15 11:55:00' and event_id % 8 < 6 end""")  # fmt: skip
def j3(events):
    status = F.when(F.col("event_id") % 3 == 0, "queued").when(F.col("event_id") % 3 == 1, "generating").otherwise("ready")
    rows = events.select("event_id", status.alias("status"), F.date_trunc("second", F.col("ts")).alias("since"), F.lit(None).cast("timestamp").alias("scored_at"), (F.col("event_id") % 8).alias("scoring_attempts"))
    return J.sweep(rows, F.expr("timestamp'2024-01-15 12:00:00'")).select("event_id", "action")
