import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradelake.operators import evaluation as E
from gradelake.operators import rails as K
from gradelake.operators import relational as R
from gradelake.operators import scoring as S


def score(spark, rows):
    df = spark.createDataFrame(rows, "correct array<int>, selected array<int>")
    return [r[0] for r in df.select(S.question_score(F.col("correct"), F.col("selected"))).collect()]


def test_question_scores(spark):
    rows = [([1], [1]), ([1], [2]), ([1, 2], [1]), ([1, 2], [1, 2]), ([1, 2], [1, 2, 3]), ([1, 2, 3], [1, 1, 2]), ([1], [1, 2, 3, 4]), ([1, 2], []), ([], [1])]
    got = score(spark, rows)
    assert got[:8] == [4, 0, 2, 4, 2, pytest.approx(8 / 3), 0, 0] and got[8] is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 3), min_size=1, max_size=3), st.sets(st.integers(0, 3))), min_size=1, max_size=8))
def test_scores_stay_in_bounds(spark, questions):
    rows = [(1, i + 1, sorted(c), sorted(s)) for i, (c, s) in enumerate(questions)]
    per = S.question_scores(spark.createDataFrame(rows, "attempt_id long, position int, correct array<int>, selected array<int>"))
    want = [4 * max(0, (len(c & s) - len(s - c)) / len(c)) for c, s in questions]
    w = [1.1**i for i in range(len(want))]
    (f,) = S.final_scores(per).collect()
    assert f["final_score"] == pytest.approx(sum(a * b for a, b in zip(want, w)) / sum(w)) and 0 <= f["percent"] <= 100 + 1e-9


def test_submitting_twice_changes_nothing(spark):
    a = spark.createDataFrame([(1, 7, 3, "in_progress", None), (2, 7, 3, "submitted", "2024-01-01")], "attempt_id long, user_id long, quiz_id long, status string, submitted_at string")
    s = spark.createDataFrame([(1, 1, 4.0), (1, 2, 0.0)], "attempt_id long, position int, score double")
    once = S.submit_attempts(a, s, F.lit("2024-02-02"))
    twice = S.submit_attempts(once.withColumn("status", F.lit("submitted")), s, F.lit("2025-01-01"))
    pick = lambda df: sorted((r["attempt_id"], r["submitted_at"], r["final_score"]) for r in df.collect())
    assert pick(once) == pick(twice)


def test_equal_revisions_are_stale(spark):
    e = spark.createDataFrame([(1, 1, 1, 5, 10), (2, 1, 1, 5, 11), (3, 1, 1, 4, 12), (4, 1, 1, 6, 9)], "event_id long, attempt_id long, question_id long, revision int, ts long")
    got = {r["event_id"]: r["status"] for r in S.revision_status(e).collect()}
    assert got == {4: "applied", 1: "stale", 2: "stale", 3: "stale"}
    assert S.latest_answers(e).collect()[0]["event_id"] == 4


def test_replacing_is_idempotent(spark):
    stored, new = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (1, 2), (2, 3)], [(1, 9), (3, 4)]))
    once = R.replace_by_key(stored, new, ("k",))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, R.replace_by_key(once, new, ("k",)).collect())) == [(1, 9), (2, 3), (3, 4)]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("s", F.col("id") % 3)
    a, b = (sorted(map(tuple, R.sample_by_hash(df.repartition(n), ("s",), "id", "x", 7).collect())) for n in (1, 8))
    assert a == b and len(a) == 21


def test_as_of_takes_the_newest_version_before(spark):
    r = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    v = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, t int, v string")
    assert sorted(map(str, R.latest_as_of(r, v, "k", "at", "t", "v").collect())) == sorted(map(str, [("a", 5, "y"), ("a", 1, None), ("b", 9, None)])) or {tuple(x) for x in R.latest_as_of(r, v, "k", "at", "t", "v").collect()} == {("a", 5, "y"), ("a", 1, None), ("b", 9, None)}


def test_overall_scores_renormalise_and_gate(spark):
    rows = [({"judge_overall": 0.8, "lint_pass": 1.0},), ({"lint_pass": 1.0, "grounded": 0.0},), ({"judge_overall": 0.8, "grounded": 0.0},), ({},), ({"judge_overall": 7.0},)]
    df = spark.createDataFrame(rows, "scores map<string,double>")
    assert [r["quality"] for r in E.quality_overall(df).collect()] == [pytest.approx((0.45 * 0.8 + 0.15) / 0.6), None, 0.0, None, 1.0]
    assert [r["composite"] for r in E.composite(df).collect()] == [pytest.approx((0.35 * 0.8 + 0.1) / 0.45), 0.0, 0.0, 0.0, 1.0]


def test_quizzes_that_share_questions_do_not_copy_them(spark):
    """Questions are nested for each quiz that has them, not for each that shares them: no join below the nesting."""
    z = spark.createDataFrame([(k, 1, "ready") for k in (1, 4, 7, 8)], "quiz_id long, source_id long, status string")
    jobs = spark.createDataFrame([(k, 1, "succeeded") for k in (1, 4, 7, 8)], "quiz_id long, attempt_no int, status string")
    src = spark.createDataFrame([(1, 5, "en")], "source_id long, n_chars long, lang string")
    q = spark.createDataFrame([(1, 2, 11, "b", ["x"], [0]), (1, 1, 10, "a", ["x"], [0])], "quiz_id long, position int, question_id long, prompt string, options array<string>, correct array<int>")
    got = R.scoring_input(jobs, z, src, q, F.col("quiz_id") % 3).collect()
    assert sorted((r["quiz_id"], r["questions"] and [x["prompt"] for x in r["questions"]]) for r in got) == [(1, ["a", "b"]), (4, ["a", "b"]), (7, ["a", "b"]), (8, None)]


def test_breakdown_does_not_shuffle_attempts_times_questions(spark):
    a = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "attempt_id long, quiz_id long")
    q = spark.createDataFrame([(7, 10, 1, ["x", "y"], [0]), (7, 11, 2, ["x", "y"], [1])], "quiz_id long, question_id long, position int, options array<string>, correct array<int>")
    s = spark.createDataFrame([(1, 1, [0], 4.0), (1, 1, [1], 0.0), (2, 2, [1], 4.0), (2, 9, [1], 4.0)], "attempt_id long, position int, selected array<int>, score double")
    out = S.attempt_breakdown(a, q, s)
    got = sorted((r["attempt_id"], r["question_id"], -1 if r["score"] is None else r["score"], [o["is_correct"] for o in r["options"]], [o["selected"] for o in r["options"]]) for r in out.collect())
    assert got == [
        (1, 10, 0.0, [True, False], [False, True]), (1, 10, 4.0, [True, False], [True, False]), (1, 11, -1, [False, True], [False, False]),
        (2, 10, -1, [True, False], [False, False]), (2, 11, 4.0, [False, True], [False, True]),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    assert len(joins) == 2 and "quiz_id" in plan[joins[0]]  # what multiplies the rows comes last


def test_breakdown_does_little_for_each_attempt_and_question(spark):
    """what a question says was made anew for each attempt, by lambdas, which don't compile."""
    from gradelake.plans.service import c3

    a = spark.createDataFrame([(1, 7, "in_progress"), (2, 7, "in_progress")], "attempt_id long, quiz_id long, status string")
    q = spark.createDataFrame([(7, 10, 1, ["x", "y"], [0, 1]), (7, 11, 2, None, [1]), (7, 12, None, ["x"], None)], "quiz_id long, question_id long, position int, options array<string>, correct array<int>")
    s = spark.createDataFrame([(1, 1, 2, 1, 0), (1, None, 1, 1, 0)], "attempt_id long, position int, k long, hits long, misses long")
    out = c3(a, q, s)
    rows = sorted((tuple(r) for r in out.collect()), key=repr)
    assert rows == [(1, 10, 1, 2.0, 2, 2), (1, 11, 2, None, None, None), (1, 12, None, None, 1, 0), (2, 10, 1, None, 2, 2), (2, 11, 2, None, None, None), (2, 12, None, None, 1, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = plan[: next(i for i, line in enumerate(plan) if "Join" in line)]
    assert len(above) > 1 and not any("lambda" in line for line in above)
