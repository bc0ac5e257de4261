"""Queries over the service's relations: scores, attempts, quizzes, jobs, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.functions.errors import classifier_finding, user_message
from gradelake.functions.hashing import fnv1a
from gradelake.operators import relational as R
from gradelake.operators import scoring as S
from gradelake.plans.catalog import query

CHOICES = "cast(concat(case when hits > 0 then sequence(1, hits) else array() end, case when misses > 0 then sequence(101, 100 + misses) else array() end) as array<int>)"


def chosen(answers: DataFrame) -> DataFrame:
    """answers with the correct and the chosen options as arrays."""
    return answers.withColumn("correct", F.expr("cast(sequence(1, k) as array<int>)")).withColumn("selected", F.expr(CHOICES))


SCORE = "4 * greatest(0.0, (hits - misses) / k)"
SCORES = f"(select attempt_id, position, {SCORE} score from answers)"
FINAL = f"(select attempt_id, count(*) n_questions, sum(score * pow(1.1, position - 1)) / sum(pow(1.1, position - 1)) final_score from {SCORES} s group by attempt_id)"
SUBMITTED = f"(select a.*, coalesce(f.final_score, 0) final_score from attempts a left join {FINAL} f using (attempt_id))"


@query("d1_question_scores", "answers", sql=f"select attempt_id, cast(position as int) as position, round({SCORE}, 6) score from answers")
def d1(answers):
    return S.question_scores(chosen(answers)).withColumn("score", F.round("score", 6))


@query("d2_final_scores", "answers", sql=f"select attempt_id, n_questions, round(final_score, 6) final_score, round(final_score / 4 * 100, 5) percent from {FINAL} f")
def d2(answers):
    return S.final_scores(S.question_scores(chosen(answers))).select("attempt_id", "n_questions", F.round("final_score", 6).alias("final_score"), F.round("percent", 5).alias("percent"))


@query("d3_submit_attempts", "attempts", "answers", sql=f"select attempt_id, user_id, 'submitted' as status, status <> 'in_progress' as replayed, cast(final_score as decimal(7, 5)) final_score, 1 scoring_version from {SUBMITTED} s")
def d3(attempts, answers):
    out = S.submit_attempts(attempts, S.question_scores(chosen(answers)), F.expr("timestamp_ntz'2030-01-01 00:00:00'"))
    return out.select("attempt_id", "user_id", "status", "replayed", "final_score", "scoring_version")


@query("d4_quiz_progress", "attempts", "answers", sql=f"""
    select user_id, quiz_id, count(*) attempts, arg_max(attempt_id, (started_at, attempt_id)) filter (where status = 'in_progress') open_attempt,
        arg_max(attempt_id, (submitted_at, attempt_id)) filter (where status = 'submitted') last_attempt,
        round(arg_max(final_score, (submitted_at, attempt_id)) filter (where status = 'submitted') / 4 * 100, 4) last_percent, round(max(final_score) filter (where status = 'submitted'), 6) best
    from {SUBMITTED} s group by user_id, quiz_id""")  # fmt: skip
def d4(attempts, answers):
    f = S.final_scores(S.question_scores(chosen(answers))).select(F.col("attempt_id").alias("k"), "final_score")
    scored = attempts.join(f, F.col("attempt_id") == F.col("k"), "left").withColumn("final_score", F.coalesce("final_score", F.lit(0.0)))
    return S.quiz_progress(scored).withColumns({"last_percent": F.round("last_percent", 4), "best": F.round("best", 6)})


@query("e1_question_weights", "questions", sql="select quiz_id, question_id, i, round(pow(1.1, i - 1), 6) weight from (select quiz_id, question_id, cast(row_number() over (partition by quiz_id order by position) as int) i from questions) q")
def e1(questions):
    return S.question_weights(questions).withColumn("weight", F.round("weight", 6))


@query("e2_next_attempt", "jobs", sql="select quiz_id, coalesce(max(attempt_no) filter (where status = 'running'), max(attempt_no) + 1) attempt_no, max(attempt_no) filter (where status = 'running') is not null reused from jobs group by quiz_id")
def e2(jobs):
    return R.next_attempt(jobs)


@query("e3_first_by_key", "quizzes", sql="select owner, idem, quiz_id from (select owner, idem, quiz_id, row_number() over (partition by owner, idem order by created_at, quiz_id) r from quizzes) q where r = 1")
def e3(quizzes):
    return R.first_by_key(quizzes.select("owner", "idem", "quiz_id", "created_at"), ("owner", "idem"), ("created_at", "quiz_id")).select("owner", "idem", "quiz_id")


@query("e4_revision_status", "answer_events", sql="""
    select event_id, revision, case when seen is null or seen < revision then 'applied' else 'stale' end as status
    from (select *, max(revision) over (partition by attempt_id, question_id order by ts, event_id rows between unbounded preceding and 1 preceding) seen from answer_events) e""")  # fmt: skip
def e4(events):
    return S.revision_status(events).select("event_id", "revision", "status")


@query("e4_latest_answers", "answer_events", sql="""
    select attempt_id, question_id, event_id, revision from (select *, row_number() over (partition by attempt_id, question_id order by revision desc, ts, event_id) r from answer_events) e where r = 1""")  # fmt: skip
def e4_latest(events):
    return S.latest_answers(events).select("attempt_id", "question_id", "event_id", "revision")


@query("e5_open_attempt", "attempts", sql="""
    select attempt_id, user_id, quiz_id, first_value(attempt_id) over (partition by user_id, quiz_id order by started_at, attempt_id) resumed from attempts where status = 'in_progress'""")  # fmt: skip
def e5(attempts):
    w = Window.partitionBy("user_id", "quiz_id").orderBy("started_at", "attempt_id")
    return attempts.where("status = 'in_progress'").select("attempt_id", "user_id", "quiz_id", F.first("attempt_id").over(w).alias("resumed"))


@query("c3_attempt_breakdown", "attempts", "questions", "answers", heavy=True, sql=f"""
    select a.attempt_id, q.question_id, cast(q.position as int) as position, round(s.score, 6) score, len(q.options) n_options, cast(list_sum(list_transform(q.options, lambda o, i: case when list_contains(q.correct, i - 1) then 1 else 0 end)) as bigint) n_correct
    from attempts a join questions q on a.quiz_id = q.quiz_id left join {SCORES} s on s.attempt_id = a.attempt_id and s.position = q.position""")  # fmt: skip
def c3(attempts, questions, answers):
    out = S.attempt_breakdown(attempts, questions, S.question_scores(chosen(answers), "selected"))
    return out.select("attempt_id", "question_id", "position", F.round("score", 6).alias("score"), F.col("n_options").cast("long").alias("n_options"), F.col("n_correct").cast("long").alias("n_correct"))


@query("c4_attempts_by_quiz", "attempts", sql="select user_id, quiz_id, array_to_string(list(cast(attempt_id as varchar) order by started_at desc, attempt_id desc), ',') attempts from attempts group by user_id, quiz_id")
def c4(attempts):
    rows = F.sort_array(F.collect_list(F.struct("started_at", "attempt_id")), asc=False)
    return attempts.groupBy("user_id", "quiz_id").agg(F.array_join(F.transform(rows, lambda r: r["attempt_id"].cast("string")), ",").alias("attempts"))


@query("c5_attempt_progress", "attempts", "answers", sql="select a.attempt_id, count(s.position) answered, coalesce(sum(s.hits + s.misses), 0) selected from attempts a left join answers s on a.attempt_id = s.attempt_id where a.status = 'in_progress' group by a.attempt_id")
def c5(attempts, answers):
    a = chosen(answers).select(F.col("attempt_id").alias("k"), "position", F.size("selected").alias("n"))
    return attempts.where("status = 'in_progress'").join(a, F.col("attempt_id") == F.col("k"), "left").groupBy("attempt_id").agg(F.count("position").alias("answered"), F.coalesce(F.sum("n"), F.lit(0)).alias("selected"))


@query("b15_validate_answers", "answer_events", "attempts", "questions", sql="""
    with e as (select event_id, attempt_id % 50 * 32 attempt_id, question_id * 300 + attempt_id % 50 * 3 question_id, case when event_id % 5 = 0 then list_value() when event_id % 5 = 1 then list_value(0, 7) when event_id % 5 = 2 then list_value(1, 2) else list_value(cast(event_id % 4 as int)) end selected from answer_events)
    select event_id, case when a.attempt_id is null then 'not_found' when a.status = 'submitted' then 'attempt_submitted' when q.question_id is null or q.quiz_id <> a.quiz_id then 'not_found'
        when list_contains(selected, 7) or len(selected) = 0 or (len(correct) = 1 and len(selected) <> 1) then 'invalid' else 'accepted' end status
    from e left join attempts a using (attempt_id) left join questions q using (question_id)""")  # fmt: skip
def b15(events, attempts, questions):
    picked = F.expr("case when event_id % 5 = 0 then cast(array() as array<int>) when event_id % 5 = 1 then array(0, 7) when event_id % 5 = 2 then array(1, 2) else array(cast(event_id % 4 as int)) end")
    e = events.select("event_id", F.expr("attempt_id % 50 * 32").alias("attempt_id"), F.expr("question_id * 300 + attempt_id % 50 * 3").alias("question_id"), picked.alias("selected"))
    return S.validate_answers(e, attempts, questions).select("event_id", "status")


@query("b16_idempotency", "quizzes", sql="""
    select quiz_id, case when r = 1 then 'created' when f = source_id then 'replayed' else 'conflict' end idempotency
    from (select quiz_id, source_id, row_number() over (partition by owner, idem order by created_at, quiz_id) r, first_value(source_id) over (partition by owner, idem order by created_at, quiz_id) f from quizzes) q""")  # fmt: skip
def b16(quizzes):
    return R.idempotency_status(quizzes, ("owner", "idem"), ("created_at", "quiz_id"), "source_id").select("quiz_id", "idempotency")


@query("b9_constraint_audit", "lineitem", "orders", "answers", sql="""
    select 'lineitem' table_name, 'unique:l_orderkey,l_linenumber' as rule, count(*) n from (select l_orderkey from lineitem group by l_orderkey, l_linenumber having count(*) > 1) x
    union all select 'lineitem', 'range:l_linenumber', count(*) from lineitem where l_linenumber not between 1 and 5 having count(*) > 0
    union all select 'lineitem', 'enum:l_returnflag', count(*) from lineitem where l_returnflag not in ('A', 'N') having count(*) > 0
    union all select 'orders', 'foreign:o_orderkey', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)""")  # fmt: skip
def b9(lineitem, orders, answers):
    found = R.violations(lineitem, "lineitem", ("l_orderkey", "l_linenumber"), {"l_linenumber": (1, 5)}, {"l_returnflag": ("A", "N")})
    orphans = R.foreign_key_violations(orders, lineitem, "o_orderkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(orphans.select(F.lit("orders").alias("table_name"), F.lit("foreign:o_orderkey").alias("rule"), "n"))


@query("b5_owned_quizzes", "quizzes", sql="select quiz_id, owner, status from quizzes where owner = 7")
def b5(quizzes):
    return R.owned(quizzes, F.lit(7)).select("quiz_id", "owner", "status")


@query("d5_quota_usage", "quizzes", sql="select owner, count(*) n, count(*) >= 2 over_quota from quizzes where created_at >= (select max(created_at) from quizzes) - interval '400' day group by owner")
def d5(quizzes):
    now = quizzes.agg(F.max("created_at").alias("m"))
    recent = quizzes.join(F.broadcast(now), F.lit(True)).where(F.col("created_at") >= F.col("m") - F.expr("interval 400 days"))
    return recent.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 2).alias("over_quota"))


@query("d5_trailing_quota", "quizzes", sql="select quiz_id, count(*) over (partition by owner order by epoch(created_at) range between 8640000 preceding and current row) in_window from quizzes")
def d5_trailing(quizzes):
    return R.trailing_quota(quizzes, 8640000).select("quiz_id", "in_window")


@query("c2_unscored_jobs", "jobs", sql="select quiz_id, attempt_no, scoring_attempts from jobs where status = 'succeeded' and scored_at is null and finished_at < timestamp '1996-01-01 00:00:00' and scoring_attempts < 6 order by finished_at, quiz_id limit 100")
def c2(jobs):
    return R.unscored_jobs(jobs, F.expr("timestamp_ntz'1996-01-01 00:00:00'")).select("quiz_id", "attempt_no", "scoring_attempts")


@query("c1_scoring_input", "jobs", "quizzes", "sources", "questions", sql="""
    select j.quiz_id, j.attempt_no, z.source_id, s.lang, s.n_chars, q.n n_questions, q.first_prompt from jobs j join quizzes z on j.quiz_id = z.quiz_id and z.status = 'ready' join sources s on z.source_id = s.source_id
    left join (select quiz_id, count(*) n, arg_min(prompt, position) first_prompt from questions group by quiz_id) q on q.quiz_id = j.quiz_id % 300 where j.status = 'succeeded'""")  # fmt: skip
def c1(jobs, quizzes, sources, questions):
    """There are questions of 300 quizzes; quizzes of equal number modulo 300 share them."""
    out = R.scoring_input(jobs, quizzes, sources, questions, F.col("quiz_id") % 300)
    return out.select("quiz_id", "attempt_no", "source_id", "lang", "n_chars", F.size("questions").cast("long").alias("n_questions"), F.col("questions")[0]["prompt"].alias("first_prompt"))


@query("b2_generation_progress", "quizzes", sql="""
    select quiz_id, case when p then phase end phase, case when p then phase_step end as step, case when p then phase_total end total from (select *, status = 'generating' and phase is not null and phase_step is not null and phase_total is not null p from quizzes) q""")  # fmt: skip
def b2(quizzes):
    return R.generation_progress(quizzes).select("quiz_id", "progress.*")


@query("b3_user_messages", "quizzes", sql="""
    select quiz_id, case when error is null then null when error like '%host not allowed%' then 'The host "evil.example/x" is not allowed. Use a Markdown file hosted on github.com or raw.githubusercontent.com.' when error like '%HTTP 404%' then 'The document was not found (HTTP 404). Check the URL.'
        when error like '%classifier scored%' then 'Our prompt-injection classifier rejected this document. If it is a legitimate README, you can ask for it to be reviewed and added to the document list.' when error like '%unsupported_language%' then 'This document is not in a supported language. Supported: English, Portuguese and Spanish.'
        when error like '%timed out%' then 'Generation took too long. Please try again.' else 'Quiz generation failed. Please try again.' end message from quizzes""")  # fmt: skip
def b3(quizzes):
    return quizzes.select("quiz_id", user_message(F.col("error")).alias("message"))


@query("b4_classifier_finding", "quizzes", "documents", sql="""
    select quiz_id, cast('0.' || (10 + quiz_id % 90) as double) score, trim(case when quiz_id % 2 = 0 then substr(text, 1, 600) else 'x: the classifier scored 0.' || (10 + quiz_id % 90) || ' on this' end)[1:500] excerpt from quizzes join documents on doc_id = source_id where quiz_id % 3 > 0
    union all select quiz_id, null, null from quizzes join documents on doc_id = source_id where quiz_id % 3 = 0""")  # fmt: skip
def b4(quizzes, documents):
    """Failures that name a score, with the document's beginning as the excerpt or without one, and others."""
    rows = quizzes.join(documents.select("doc_id", "text"), F.col("doc_id") == F.col("source_id"))
    said = F.concat(F.lit("x: the classifier scored 0."), 10 + F.col("quiz_id") % 90, F.lit(" on this"))
    raw = F.when(F.col("quiz_id") % 3 == 0, "boom").when(F.col("quiz_id") % 2 == 0, F.concat(said, F.lit(" — excerpt: "), F.substring("text", 1, 600))).otherwise(said)
    return rows.select("quiz_id", classifier_finding(raw).alias("f")).select("quiz_id", "f.*")


@query("h39_fnv1a", "conversations", sql="""
    with c as (select conv_id, turn, list_transform(string_split(substr(text, 1, 40), ''), lambda x: unicode(x)) u from conversations)
    select conv_id, turn, cast(list_reduce(list_prepend(2166136261::hugeint, list_transform(u, lambda x: x::hugeint)), lambda h, x: (xor(h, x) * 16777619) % 4294967296) as bigint) h from c where len(list_filter(u, lambda x: x > 65535)) = 0 and len(u) > 0""")  # fmt: skip
def h39(c):
    """Of the first 40 characters of each text."""
    return c.where("length(text) > 0").select("conv_id", "turn", fnv1a(F.substring("text", 1, 40)).alias("h"))


@query("c17_catalogue_status", "sources", "quizzes", sql="""
    with used as (select source_id, min(created_at) used_at from quizzes where status = 'ready' and quiz_id % 5 <> 0 group by source_id), gone as (select distinct url from sources where source_id % 17 = 3)
    select source_id, case when g.url is null then coalesce(s.listed_at, u.used_at) end listed_at from sources s left join used u using (source_id) left join gone g on g.url = s.url""")  # fmt: skip
def c17(sources, quizzes):
    used = quizzes.where("status = 'ready'").select("source_id", F.col("created_at").alias("at"), (F.col("quiz_id") % 5 == 0).alias("flagged"))
    return R.catalogue_status(sources, used, sources.where("source_id % 17 = 3").select("url"))


@query("f3_approved_entries", "sources", sql="""
    select 'approved-' || substr(cast(source_id as varchar), 1, 8) id, 'T' || source_id title, coalesce(case when source_id % 2 = 0 then source end, 'Approved after review') description, url, 'approved' kind, 'en' as language, 'medium' size,
        'Let in by review on ' || coalesce(strftime(listed_at, '%Y-%m-%d'), '?') || case when source_id % 3 = 1 then ' (classifier had scored ' || printf('%.2f', (source_id % 100) / 100.0) || ')' else '' end tests
    from sources where source_id % 4 < 3 order by listed_at desc nulls first, source_id limit 100""")  # fmt: skip
def f3(sources):
    status = F.when(F.col("source_id") % 4 < 3, "approved").otherwise("pending")
    score = F.when(F.col("source_id") % 3 == 1, F.col("source_id") % 100 / 100)
    requests = sources.select(F.col("source_id").alias("request_id"), F.concat(F.lit("T"), "source_id").alias("title"), F.when(F.col("source_id") % 2 == 0, F.col("source")).alias("description"), "url", status.alias("status"), F.col("listed_at").alias("reviewed_at"), score.alias("detector_score"))
    return R.approved_entries(requests)


@query("d27_usage_cost", "jobs", sql="""
    select model, count(*) jobs, sum(prompt_tokens) prompt_tokens, sum(completion_tokens) completion_tokens, round(sum(prompt_tokens * case model when 'model-a' then 0.3 when 'model-b' then 3.0 else 15.0 end + completion_tokens * case model when 'model-a' then 1.2 when 'model-b' then 15.0 else 75.0 end) / 1000000, 4) as cost
    from jobs group by model""")  # fmt: skip
def d27(jobs):
    prices = jobs.sparkSession.createDataFrame([("model-a", 0.3, 1.2), ("model-b", 3.0, 15.0), ("model-c", 15.0, 75.0)], "model string, price_in double, price_out double")
    return R.usage_cost(jobs, prices).withColumn("cost", F.round("cost", 4))


@query("d28_expired_groups", "answer_events", sql="select attempt_id, count(*) n from answer_events group by attempt_id having max(ts) < timestamp '2024-01-30 20:00:00'")
def d28(events):
    return R.expired_groups(events, "attempt_id", "ts", F.expr("timestamp_ntz'2024-01-30 20:00:00'")).select("attempt_id", F.col("rows").alias("n"))


@query("f1_newest_quizzes", "quizzes", sql="select owner, quiz_id, rank from (select owner, quiz_id, cast(row_number() over (partition by owner order by created_at desc, quiz_id desc) as int) rank from quizzes) q where rank <= 3")
def f1(quizzes):
    return R.newest_per_key(quizzes, "owner", "created_at", 3, "quiz_id").select("owner", "quiz_id", "rank")


@query("f2_catalogue_entries", "sources", sql="""
    select concat('used-', substr(sha256(coalesce(url, '')), 1, 8)) id, url, coalesce(lang, 'en') as language, case when n_chars < 4000 then 'short' when n_chars < 20000 then 'medium' else 'long' end size, strftime(listed_at, '%Y-%m-%d') listed
    from sources where listed_at is not null order by listed_at desc, source_id limit 200""")  # fmt: skip
def f2(sources):
    listed = sources.where("listed_at is not null").orderBy(F.desc("listed_at"), "source_id").limit(200)
    return listed.select(F.concat(F.lit("used-"), F.substring(F.sha2("url", 256), 1, 8)).alias("id"), "url", F.coalesce("lang", F.lit("en")).alias("language"), R.size_class(F.col("n_chars")).alias("size"), F.date_format("listed_at", "yyyy-MM-dd").alias("listed"))


@query("g1_catalogue", "sources", sql="""
    with e as (select url, source_id id, 0 p, 'curated' origin from sources where source_id % 5 = 0 union all select url, source_id, 1, 'approved' from sources where source_id % 2 = 0 union all select url, source_id, 2, 'used' from sources where listed_at is not null)
    select url, id, origin from (select *, row_number() over (partition by url order by p, id) r from e) x where r = 1""")  # fmt: skip
def g1(sources):
    part = lambda cond, origin: sources.where(cond).select("url", F.col("source_id").alias("id"), F.lit(origin).alias("origin"), F.col("lang").alias("language"), R.size_class(F.col("n_chars")).alias("size"))
    return R.catalogue([part("source_id % 5 = 0", "curated"), part("source_id % 2 = 0", "approved"), part("listed_at is not null", "used")]).select("url", "id", "origin")


@query("g4_replace_scores", "eval_scores", sql="""
    select quiz_id, evaluator, event_id from eval_scores e where event_id % 3 = 0 or not exists (select 1 from eval_scores n where n.event_id % 3 = 0 and n.quiz_id = e.quiz_id and n.evaluator = e.evaluator)""")  # fmt: skip
def g4(scores):
    rows = scores.select("quiz_id", "evaluator", "event_id")
    return R.replace_by_key(rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0"), ("quiz_id", "evaluator"))


@query("g5_replace_questions", "questions", sql="select quiz_id, question_id from questions where quiz_id % 4 = 0 and question_id % 2 = 0 union all select quiz_id, question_id from questions where quiz_id not in (select quiz_id from questions where quiz_id % 4 = 0 and question_id % 2 = 0)")
def g5(questions):
    rows = questions.select("quiz_id", "question_id")
    return R.replace_by_key(rows, rows.where("quiz_id % 4 = 0 and question_id % 2 = 0"), ("quiz_id",))


@query("g6_upsert_sources", "sources", sql="""
    select sha, arg_min(source_id, (o, source_id)) source_id, count(*) seen from (select sha256(content_text) sha, source_id, case when source_id % 2 = 0 then 0 else 1 end o from sources) x group by sha""")  # fmt: skip
def g6(sources):
    rows = sources.select(F.sha2("content_text", 256).alias("sha"), "source_id", "fetched_at")
    return R.upsert_by_content(rows.where("source_id % 2 = 0"), rows.where("source_id % 2 <> 0")).select("sha", "source_id", "seen")


@query("c6_approved_flag", "sources", sql="select source_id, coalesce(source_id % 5 = 0 or concat(url, '/raw') in (select concat(url, '/raw') from sources where source_id % 7 = 0), false) approved from sources")
def c6(sources):
    keys = sources.where("source_id % 5 = 0").select(F.col("url").alias("k")).unionByName(sources.where("source_id % 7 = 0").select(F.concat("url", F.lit("/raw")).alias("k"))).distinct()
    both = sources.select("source_id", F.explode(F.array("url", F.concat("url", F.lit("/raw")))).alias("u"))
    return both.join(keys, F.col("u") == F.col("k"), "left").groupBy("source_id").agg(F.max(F.col("k").isNotNull()).alias("approved"))


@query("c8_latest_source", "sources", sql="select source, arg_max(source_id, (fetched_at, source_id)) source_id from sources group by source")
def c8(sources):
    return sources.groupBy("source").agg(F.max_by("source_id", F.struct("fetched_at", "source_id")).alias("source_id"))


@query("c8_as_of", "attempts", "jobs", sql="""
    select a.attempt_id, j.model from (select attempt_id, user_id, started_at from attempts) a asof left join
    (select completion_tokens, started_at, max(model) model from jobs group by completion_tokens, started_at) j on a.user_id = j.completion_tokens and a.started_at >= j.started_at""")  # fmt: skip
def c8_as_of(attempts, jobs):
    versions = jobs.groupBy(F.col("completion_tokens").alias("user_id"), F.col("started_at").alias("since")).agg(F.max("model").alias("model"))
    return R.latest_as_of(attempts.select("attempt_id", "user_id", "started_at"), versions, "user_id", "started_at", "since", "model").select("attempt_id", "model")


@query("e11_even_pick", "questions", sql="""
    select quiz_id, question_id from (select quiz_id, question_id, row_number() over (partition by quiz_id order by position) - 1 rn, count(*) over (partition by quiz_id) n from questions) q
    where n <= 4 or rn in (0, floor(1 * (n - 1) / 3.0 + 0.5), floor(2 * (n - 1) / 3.0 + 0.5), n - 1)""")  # fmt: skip
def e11(questions):
    return R.even_pick(questions, "quiz_id", "position", 4).select("quiz_id", "question_id")


@query("e8_stratified_sample", "cases", sql="select case_id, dataset, language from (select *, row_number() over (partition by dataset, language order by md5('s1:' || case_id), case_id) r from cases) c where r <= 3")
def e8(cases):
    return R.sample_by_hash(cases, ("dataset", "language"), "case_id", "s1", 3).select("case_id", "dataset", "language")


@query("e16_claimable_jobs", "jobs", sql="select quiz_id, scoring_attempts + 1 scoring_attempts from jobs where status = 'succeeded' and scored_at is null and started_at + interval '150' second < timestamp '1997-01-01 00:00:00'")
def e16(jobs):
    free = F.col("scored_at").isNull() & (F.col("started_at") + F.expr("interval 150 seconds") < F.expr("timestamp_ntz'1997-01-01 00:00:00'"))
    return jobs.where((F.col("status") == "succeeded") & free).select("quiz_id", (F.col("scoring_attempts") + 1).alias("scoring_attempts"))


@query("b1_quiz_summary", "quizzes", sql="""
    select quiz_id, status, case when status <> 'failed' then null when error like '%host not allowed%' then 'host' when error like '%HTTP 404%' then 'not_found' when error like '%classifier scored%' then 'classifier' when error like '%unsupported_language%' then 'language' when error like '%timed out%' then 'timeout' else 'other' end message,
        coalesce(status = 'failed' and error like '%the classifier scored%', false) reviewable, case when status = 'generating' and phase is not null then concat(phase, ' ', cast(phase_step as varchar), '/', cast(phase_total as varchar)) end progress from quizzes""")  # fmt: skip
def b1(quizzes):
    from gradelake.functions.errors import classifier_finding, error_kind

    failed = F.col("status") == "failed"
    p = F.when((F.col("status") == "generating") & F.col("phase").isNotNull() & F.col("phase_step").isNotNull() & F.col("phase_total").isNotNull(), F.concat_ws(" ", "phase", F.concat_ws("/", "phase_step", "phase_total")))
    return quizzes.select("quiz_id", "status", F.when(failed, error_kind(F.col("error"))).alias("message"), F.coalesce(failed & classifier_finding(F.col("error")).isNotNull(), F.lit(False)).alias("reviewable"), p.alias("progress"))


@query("b14_fingerprint", "quizzes", sql="select quiz_id, sha256(concat('{\"owner\":', cast(owner as varchar), case when phase is null then '' else concat(',\"phase\":\"', phase, '\"') end, ',\"source_id\":', cast(source_id as varchar), '}')) fingerprint from quizzes")
def b14(quizzes):
    from gradelake.functions.hashing import fingerprint

    return quizzes.select("quiz_id", fingerprint("source_id", "phase", "owner").alias("fingerprint"))


@query("b17_hash_user", "attempts", sql="select distinct user_id, substr(sha256(cast(user_id as varchar)), 1, 16) pseudonym from attempts")
def b17(attempts):
    from gradelake.functions.hashing import hash_user

    return attempts.select("user_id").distinct().select("user_id", hash_user(F.col("user_id").cast("string")).alias("pseudonym"))
