import json
import pickle
import re
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelake.sources import files
from gradelake.sources.replace import ReplaceByKey
from gradelake.sources.schemas import TABLES
from gradelake.sources.shared import drain
from gradelake.streaming import jobs as J
from gradelake.streaming import stateful


def test_tables_round_trip(spark, tmp_path):
    for n, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{n}")
    got = files.read_tables(spark, str(tmp_path))
    assert {n: [f.name for f in d.schema] for n, d in got.items()} == {n: [c.split()[0] for c in re.split(r', (?![0-9])', s)] for n, s in TABLES.items()}


def test_corpus_results_and_outputs(spark, tmp_path):
    (tmp_path / "md" / "es").mkdir(parents=True)
    (tmp_path / "md" / "es" / "a.md").write_text("# Hola\ntexto")
    assert [(r["language"], r["text"]) for r in files.read_corpus(spark, str(tmp_path / "md")).collect()] == [("es", "# Hola\ntexto")]
    (tmp_path / "r.json").write_text(json.dumps({"results": {"results": [{"output": '{"status": "ok", "n": 1}'}, {"output": "not json"}, {"output": None}]}}))
    rows = files.read_results(spark, str(tmp_path / "r.json"), T.StructType.fromDDL("output string"))
    assert sorted(r["status"] for r in files.parse_outputs(rows, "output", T.StructType.fromDDL("status string, n int")).collect()) == ["error", "error", "ok"]


def test_every_result_file_is_read_whole(spark):
    """Two thousand rows are two files: a file with two JSON texts is read to the end of the first."""
    from gradelake.plans.sources import _results

    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source")).coalesce(1)
    assert _results(docs).agg(F.count("id"), F.sum("id")).first()[:] == (2500, 2500 * 2499 // 2)


def test_a_table_in_several_files_is_a_stream(spark, tmp_path):
    from gradelake.plans.streams import table_stream

    for name, parts in (("events", 3), ("documents", 1)):
        spark.range(9).repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
    assert drain(table_stream(spark, str(tmp_path), "events"), "append").count() == 9
    (part,) = (tmp_path / "documents.parquet").glob("part-*")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "events.parquet").write_bytes(part.read_bytes())
    assert drain(table_stream(spark, str(tmp_path / "one"), "events"), "append").count() == 9


def test_runs_are_never_overwritten(spark, tmp_path):
    base = f"file://{tmp_path}/runs"
    files.write_run(spark.range(3).repartition(2), base, "a")
    files.write_run(spark.range(5), base, "b")
    with pytest.raises(Exception, match="never overwritten"):
        files.write_run(spark.range(1), base, "a")
    assert files.read_run(spark, base).count() == 5 and sorted(r["id"] for r in files.read_run(spark, base, "a").collect()) == [0, 1, 2]


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    base = f"file://{tmp_path}/runs"
    files.write_run(spark.range(2), base, "a")
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        files.write_run(broken, base, "b")
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["latest", "run_id=a"] and files.read_run(spark, base).count() == 2


def test_corpus_round_trip(spark, tmp_path):
    rows = {("en", "a", "one\ntwo"), ("es", "a", "ñ")}
    files.write_corpus(spark.createDataFrame(sorted(rows), "language string, name string, text string"), f"file://{tmp_path}/c")
    got = files.read_corpus(spark, f"file://{tmp_path}/c").collect()
    assert {(r["language"], r["path"].rsplit("/", 1)[1][:-3], r["text"]) for r in got} == rows


def test_metric_lines(spark):
    df = spark.createDataFrame([(1, "x", 2.5, None)], "t long, service string, seconds double, cost double")
    assert [json.loads(r["value"]) for r in files.to_metric_lines(df, "ns", "t", ("service",), {"seconds": "Seconds", "cost": "None"}).collect()] == [{"time": 1, "namespace": "ns", "dimensions": {"service": "x"}, "name": "seconds", "unit": "Seconds", "value": 2.5}]


SCHEMA = "quiz_id long, event_id long, kind string, status string, revision int, attempt_id long, question_id long, job_id long, score double, scoring_attempts int, ts timestamp"
HOUR = timedelta(hours=1)


def stream(spark, path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/f{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))


def event(i, minute, **more):
    base = dict(quiz_id=1, event_id=i, kind="step", status="generating", revision=i, attempt_id=1, question_id=1, job_id=1, score=float(i), scoring_attempts=0, ts=datetime(2024, 1, 1) + timedelta(minutes=minute)) | more
    return tuple(base.values())


def test_revisions_across_batches(spark, tmp_path):
    s = stream(spark, tmp_path, [event(1, 0, revision=5)], [event(2, 1, revision=4), event(3, 2, revision=5)], [event(4, 3, revision=7)])
    got = drain(J.latest_answers(s), "append", ("attempt_id", "question_id")).collect()
    assert [(r["event_id"], r["revision"]) for r in got] == [(4, 7)]


def test_state_goes_when_a_key_is_still(spark, tmp_path):
    """After an hour without events (and a later event of another key that moves the clock) a key begins anew; within it, it goes on."""
    far = lambda i, minute: [event(i, minute, attempt_id=9, quiz_id=9, job_id=9)]
    first = [event(1, 0, revision=9, kind="claim")]
    for name, job, last in (
        ("answers", lambda s: J.latest_answers(s, late="1 minute", keep=HOUR), lambda r: r["revision"]),
        ("claims", lambda s: J.claims(s.withColumn("kind", F.lit("claim")), late="1 minute", keep=HOUR), lambda r: r["attempts"]),
        ("submissions", lambda s: J.submissions(s, late="1 minute", keep=HOUR), lambda r: r["replays"]),
        ("phases", lambda s: J.phase_updates(s, late="1 minute", keep=HOUR), lambda r: r["steps"]),
    ):
        for still, want in ((30, {"answers": [9, 9], "claims": [1, 2], "submissions": [0, 1], "phases": [1, 2]}), (200, {"answers": [9, 2], "claims": [1, 1], "submissions": [0, 0], "phases": [1, 1]})):
            if still == 30 and name != "claims":
                continue
            s = stream(spark, tmp_path / f"{name}{still}", first, far(5, still), far(6, still + 1), [event(2, still + 2, revision=2)])
            rows = [r for r in drain(job(s), "append").collect() if 9 not in (r[0], r[1]) or name == "answers" and r["attempt_id"] == 1]
            assert sorted(map(last, rows)) == sorted(want[name]), (name, still)


def _state_rows(spark, out):
    """Rows of state that a stream's first batch leaves."""
    name = f"n{uuid.uuid4().hex}"
    q = out.writeStream.outputMode("update" if "start" in out.columns else "append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress[0]["stateOperators"][0]["numRowsTotal"]


def test_keys_share_entries_of_state(spark, tmp_path, monkeypatch):
    """Nine keys and a null one in two slots, over three batches: each key goes its own way, and three entries are kept."""
    monkeypatch.setattr(stateful, "SLOTS", 2)
    keys = [*range(9), None, 2**53 + 1]
    batches = [[event(100 * n + i, 10 * n + i % 3, attempt_id=k) for i, k in enumerate(keys)] for n in range(3)]
    got = {r["attempt_id"]: (r["submitted_by"], r["replays"]) for r in drain(J.submissions(stream(spark, tmp_path / "a", *batches)), "append", ("attempt_id",)).collect()}
    assert got == {k: (i, 2) for i, k in enumerate(keys)}
    assert _state_rows(spark, J.submissions(stream(spark, tmp_path / "b", batches[0]))) <= 3


def test_a_timer_of_a_slot_ends_only_what_is_due(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "SLOTS", 1)
    s = stream(spark, tmp_path, [event(1, 0, quiz_id=1, status="queued"), event(2, 0, quiz_id=2, status="generating")], [event(3, 10, quiz_id=3, status="failed")], [event(4, 40, quiz_id=3, status="failed")])
    got = drain(J.stream_sweep(s), "append").collect()
    start = 1_704_067_200_000
    assert sorted(map(tuple, got)) == [(1, "requeue", start + 180_000), (2, "fail", start + 1_200_000)]


def test_an_event_counts_in_few_states_of_quota_windows(spark, tmp_path):
    rows = [event(1, 30, quiz_id=7), event(2, 23 * 60, quiz_id=7), event(3, 25 * 60, quiz_id=7)]
    got = {(r["start"] - datetime(2024, 1, 1)) // HOUR: r["n"] for r in drain(J.quota_windows(stream(spark, tmp_path / "a", rows[:2], rows[2:]), "quiz_id"), "update", ("quiz_id", "start")).collect()}
    want = {h: n for h in range(-30, 50) if (n := sum(h <= at < h + 24 for at in (0, 23, 25)))}
    assert got == want
    assert _state_rows(spark, J.quota_windows(stream(spark, tmp_path / "b", rows[:1]), "quiz_id")) == 2


def test_one_batch_is_not_grouped_again(spark, tmp_path):
    one = drain(J.quota_windows(stream(spark, tmp_path, [event(1, 0)]), "quiz_id"), "update", ("quiz_id", "start"))
    assert one.count() == 24 and "Aggregate" not in one._jdf.queryExecution().optimizedPlan().toString()


def test_late_phase_updates_change_nothing(spark, tmp_path):
    s = stream(spark, tmp_path, [event(1, 0), event(2, 1)], [event(3, 2, kind="ready")], [event(4, 3), event(5, 4, kind="failed")])
    assert [tuple(r) for r in drain(J.phase_updates(s), "append", ("quiz_id",)).collect()] == [(1, "ready", 2, 2)]


def test_leases(spark, tmp_path):
    s = stream(spark, tmp_path, [event(1, 0, kind="claim"), event(2, 1, kind="claim")], [event(3, 3, kind="claim"), event(4, 4, kind="release"), event(5, 4, kind="claim")])
    assert sorted((r["event_id"], r["granted"], r["attempts"]) for r in drain(J.claims(s), "append").collect()) == [(1, True, 1), (2, False, 1), (3, True, 2), (5, True, 3)]


def test_submissions_count_once(spark, tmp_path):
    s = stream(spark, tmp_path, [event(1, 5), event(2, 6)], [event(3, 1)])
    assert [tuple(r) for r in drain(J.submissions(s), "append", ("attempt_id",)).collect()] == [(1, 1, 1.0, 2)]


def test_stuck_quizzes_are_found_alike_in_one_batch_and_in_many(spark, tmp_path):
    ms = lambda minute: (datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() + 60 * minute) * 1000
    events = [
        event(1, 0), event(2, 0, quiz_id=2), event(3, 5, quiz_id=2, status="ready"), event(4, 6, quiz_id=4, status="queued"), event(5, 8, quiz_id=4, status="queued"), event(6, 9, quiz_id=5, status="ready", scoring_attempts=6),
        event(7, 30, quiz_id=2, status="scored"), event(8, 300, quiz_id=3, status="queued"), event(9, 400, quiz_id=6, status="scored"),
    ]
    want = {(1, "fail", ms(20)), (2, "rescore", ms(10)), (4, "requeue", ms(11)), (3, "requeue", ms(303))}
    for name, batches in (("one", [events]), ("many", [[e] for e in events])):
        got = drain(J.stream_sweep(stream(spark, tmp_path / name, *batches)), "append").collect()
        assert {tuple(r) for r in got} == want and len(got) == 4, name


def test_replaced_by_key_and_merged(spark, tmp_path):
    table = ReplaceByKey(spark, f"file://{tmp_path}/t", ("id",), merge_at=3)
    rows = lambda *x: spark.createDataFrame(list(x), "id long, v string")
    with pytest.raises(FileNotFoundError):
        table.read()
    now = lambda: dict(map(tuple, table.read().collect()))
    table.write(rows((1, "a"), (2, "a")), 0)
    table.write(rows((2, "b"), (3, "b")), 1)
    table.write(rows((2, "b"), (3, "b")), 1)  # delivered again
    assert now() == {1: "a", 2: "b", 3: "b"}
    table.write(rows((3, "c")), 2)
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["merged=2"] and now() == {1: "a", 2: "b", 3: "c"}
    table.write(rows((3, "z")), 2)  # again after the merge: it is part of it already
    table.write(rows((4, "d")), 3)
    (tmp_path / "t" / "batch=7").mkdir()  # a writer that died
    assert now() == {1: "a", 2: "b", 3: "c", 4: "d"}


def test_redelivered_messages_count_once(spark, tmp_path):
    s = stream(spark, tmp_path, [event(1, 0), event(2, 1, job_id=2)], [event(3, 2), event(4, 3, job_id=3)])
    assert sorted(r["job_id"] for r in drain(J.dedupe_messages(s), "append").collect()) == [1, 2, 3]


def test_retries(spark):
    df = spark.createDataFrame([(1,), (2,), (6,)], "received int")
    assert [tuple(r)[1:] for r in J.retry_plan(df).collect()] == [(20, False), (40, False), (300, True)]
    assert J.sweep(spark.createDataFrame([("queued", "2024-01-01 00:00:00", None, 0)], "status string, since string, scored_at string, scoring_attempts int"), F.lit("2024-01-01 00:04:00")).collect()[0]["action"] == "requeue"


def test_corpus_of_many_files_is_read_by_few_tasks(spark, tmp_path):
    rows = [(("en", "es", "a b")[k % 3], f"n {k}é", f"text {k}\r\nñ") for k in range(400)]
    files.write_corpus(spark.createDataFrame(rows, "language string, name string, text string"), f"file://{tmp_path}/c")
    for skipped in ("_x.md", ".y.md", "z.txt", "empty.md"):
        (tmp_path / "c" / "en" / skipped).write_text("" if skipped == "empty.md" else "no")
    (tmp_path / "c" / "en" / "broken.md").write_bytes(b"a\xffb")
    got, plain = files.read_corpus(spark, f"file://{tmp_path}/c"), files.read_corpus(spark, f"file://{tmp_path}/[c]")  # a pattern: Spark's reader
    assert got.rdd.getNumPartitions() == 1
    key = lambda df: sorted(map(tuple, df.selectExpr("path", "hex(text)").collect()))
    assert key(got) == key(plain) and len(key(got)) == 401
    assert {r["language"] for r in got.collect()} == {"en", "es", "a b"}


def test_the_driver_lists_no_files_of_a_corpus(spark, tmp_path, monkeypatch):
    """the paths of all files went through the driver."""
    from gradelake.sources.runs import CorpusSource

    sizes = []
    for n in (10, 3000):
        for folder in ("en", "es/deep"):
            (tmp_path / f"c{n}" / folder).mkdir(parents=True)
        for k in range(n):
            (tmp_path / f"c{n}" / ("en", "es/deep")[k % 2] / f"n{k}.md").write_text(f"text {k}")
        (tmp_path / f"c{n}" / "top.md").write_text("top")
        sizes.append(len(pickle.dumps(CorpusSource({"path": f"file://{tmp_path}/c{n}"}).reader(None).partitions())))
    assert sizes[0] == sizes[1]
    monkeypatch.setattr(files, "FILES", 1000)
    got = files.read_corpus(spark, f"file://{tmp_path}/c3000")
    assert got.rdd.getNumPartitions() == 4
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted([(("en", "deep")[k % 2], f"text {k}") for k in range(3000)] + [("c3000", "top")])
