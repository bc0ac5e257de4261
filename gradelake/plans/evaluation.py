"""Queries over quizzes' quality, experiments and red-team cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradelake.operators import evaluation as E
from gradelake.operators import redteam as T
from gradelake.plans.catalog import query

#: Quizzes and their scores by evaluator stand in for judged quizzes: five event types are five metrics.
METRICS = {"click": "judge_overall", "purchase": "lint_pass", "signup": "relevance", "view": "coverage", "error": "grounded"}


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("d6_quiz_metrics", "questions", sql="""
    select quiz_id, round(avg(case when prompt like '%a%' then 1.0 else 0 end), 6) lint_pass, least(1.0, (count(distinct difficulty) - 1) / 2.0) difficulty_spread,
        round(least(1.0, (len(list_distinct(flatten(list(correct)))) - 1) / 3.0), 6) position_spread, round(avg(case when len(correct) = 1 then 1.0 else 0 end), 6) single_share from questions group by quiz_id""")  # fmt: skip
def d6(questions):
    return _round(E.quiz_metrics(questions, F.col("prompt").contains("a")), "lint_pass", "position_spread", "single_share")


SAMPLES = "(select event_id, user_id quiz_id, 1 + event_id % 5 faithfulness, 1 + floor(value) % 5 clarity, 1 + event_id % 3 distractors, 1 + floor(value / 3) % 5 coverage, 2 + event_id % 2 difficulty_mix from events)"
OVERALL = "((faithfulness - 1) / 4.0 * 2 + (clarity - 1) / 4.0 + (distractors - 1) / 4.0 + (coverage - 1) / 4.0 + (difficulty_mix - 1) / 4.0 * 0.5) / 5.5"


@query("d7_judge_scores", "events", sql=f"""
    with s as (select *, {OVERALL} o from {SAMPLES} x), m as (select quiz_id, median(faithfulness) faithfulness, median(clarity) clarity, median(distractors) distractors, median(coverage) coverage, median(difficulty_mix) difficulty_mix, max(o) - min(o) spread, median(o) mo, count(*) samples from s group by quiz_id)
    select quiz_id, faithfulness, clarity, distractors, coverage, difficulty_mix, round({OVERALL}, 6) overall, round(spread, 6) spread, samples, reasoning
    from m join (select quiz_id, arg_min(event_id, (round(abs(s.o - m.mo), 9), event_id)) reasoning from s join m using (quiz_id) group by quiz_id) n using (quiz_id)""")  # fmt: skip
def d7(events):
    e = events.select(
        F.col("event_id").alias("sample"), F.col("user_id").alias("quiz_id"), (1 + F.col("event_id") % 5).alias("faithfulness"), (1 + F.floor("value") % 5).alias("clarity"), (1 + F.col("event_id") % 3).alias("distractors"),
        (1 + F.floor(F.col("value") / 3) % 5).alias("coverage"), (2 + F.col("event_id") % 2).alias("difficulty_mix"), F.col("event_id").alias("reasoning"),
    )
    return _round(E.judge_scores(e), "overall", "spread")


def _maps(events):
    metric = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])
    rows = events.groupBy("user_id", F.to_date("ts").alias("day"), metric[F.col("event_type")].alias("metric")).agg(F.round(F.avg(F.least(F.lit(1.2), F.col("value") / 100)), 9).alias("v")).where("metric is not null and (metric <> 'grounded' or v < 0.4)")
    return rows.groupBy(F.col("user_id").alias("quiz_id"), "day").agg(F.map_from_entries(F.collect_list(F.struct("metric", "v"))).alias("scores"))


MAPS = """(select user_id quiz_id, cast(ts as date) as day, max(v) filter (where m = 'click') j, max(v) filter (where m = 'purchase') l, max(v) filter (where m = 'signup') r, max(v) filter (where m = 'view') c, max(v) filter (where m = 'error' and v < 0.4) g from
    (select user_id, ts, m, v from (select user_id, min(ts) ts, event_type m, round(avg(least(1.2, value / 100)), 9) v from events group by user_id, cast(ts as date), event_type) a where m in ('click', 'purchase', 'signup', 'view') or (m = 'error' and v < 0.4)) b group by user_id, cast(ts as date))"""


def _mean(weights):
    up = " + ".join(f"coalesce({w} * least(1.0, greatest(0.0, {c})), 0)" for c, w in weights.items())
    down = " + ".join(f"case when {c} is null then 0 else {w} end" for c, w in weights.items())
    return f"({up}) / nullif({down}, 0)"


@query("d8_quality_overall", "events", sql=f"select quiz_id, day, case when j is not null then case when coalesce(g < 1, false) then 0.0 else round({_mean({'j': 0.45, 'l': 0.15, 'r': 0.15, 'c': 0.1})}, 6) end end quality, coalesce(g < 1, false) gated from {MAPS} m")
def d8(events):
    return _round(E.quality_overall(_maps(events)).select("quiz_id", "day", "quality", "gated"), "quality")


@query("d9_composite", "events", sql=f"select quiz_id, day, case when coalesce(g < 1, false) then 0.0 else coalesce(round({_mean({'j': 0.35, 'l': 0.1, 'c': 0.1})}, 6), 0) end composite, coalesce(g < 1, false) gated from {MAPS} m")
def d9(events):
    return _round(E.composite(_maps(events)).select("quiz_id", "day", "composite", "gated"), "composite")


@query("d10_threshold_failures", "events", sql="""
    select user_id item, count(*) filter (where value / 100 < f) n_failures, coalesce(array_to_string(list(event_type order by event_type) filter (where value / 100 < f), ','), '') failures
    from (select user_id, event_type, value, case event_type when 'click' then 0.3 when 'view' then 0.1 end f from events) x where f is not null group by user_id""")  # fmt: skip
def d10(events):
    scores = events.select(F.col("user_id").alias("item"), F.col("event_type").alias("metric"), (F.col("value") / 100).alias("value"))
    return E.threshold_failures(scores, events.sparkSession.createDataFrame([("click", 0.3), ("view", 0.1)], "metric string, floor double"))


@query("d11_dataset_gate", "events", sql="""
    select event_type metric, round(avg(value / 100), 6) mean, count(*) items, cast(case event_type when 'click' then 0.7 else 0.4 end as double) bar, avg(value / 100) >= case event_type when 'click' then 0.7 else 0.4 end passed from events where event_type in ('click', 'view') group by event_type""")  # fmt: skip
def d11(events):
    scores = events.select(F.col("event_type").alias("metric"), (F.col("value") / 100).alias("value"))
    return _round(E.dataset_gate(scores, events.sparkSession.createDataFrame([("click", 0.7), ("view", 0.4)], "metric string, bar double")), "mean")


@query("d12_variant_summary", "cells", sql="""
    with i as (select variant, item, avg(composite) m from cells group by variant, item)
    select variant, round(composite, 6) composite, round(composite_sd, 6) composite_sd, failed, gated, round(cost, 4) as cost, round(secs, 6) as seconds, round(calls, 6) as calls
    from (select variant, avg(m) composite, coalesce(stddev_samp(m), 0) composite_sd from i group by variant) a
    join (select variant, count(*) filter (where not ok) failed, count(*) filter (where gated) gated, sum(cost) as cost, avg(seconds) secs, avg(calls) filter (where ok) as calls from cells group by variant) b using (variant)""")  # fmt: skip
def d12(cells):
    return _round(E.variant_summary(cells), "composite", "composite_sd", "seconds", "calls").withColumn("cost", F.round("cost", 4))


@query("d13_rep_noise", "cells", sql="""
    select round(sqrt(avg(v)), 6) noise, count(*) pairs, false ok_only from (select var_samp(composite) v from cells group by variant, item having count(*) >= 2) x
    union all select round(sqrt(avg(v)), 6), count(*), true from (select var_samp(composite) v from cells group by variant, item having count(*) >= 2 and bool_and(ok)) y""")  # fmt: skip
def d13(cells):
    both = E.rep_noise(cells).withColumn("ok_only", F.lit(False)).unionByName(E.rep_noise(cells, True).withColumn("ok_only", F.lit(True)))
    return _round(both, "noise")


@query("d14_lead_verdict", "cells", sql="""
    with i as (select variant, item, avg(composite) m from cells group by variant, item), t as (select variant, row_number() over (order by avg(m) desc, variant) r from i group by variant),
    d as (select a.item, a.m - b.m x, ta.variant best, tb.variant runner_up from t ta join i a using (variant) join t tb on tb.r = 2 join i b on b.variant = tb.variant and a.item = b.item where ta.r = 1),
    n as (select sqrt(avg(v)) noise from (select var_samp(composite) v from cells group by variant, item having count(*) >= 2 and bool_and(ok)) x)
    select best, runner_up, round(avg(x), 6) as lead, round(coalesce(stddev_samp(x), 0) / sqrt(count(*)), 6) se, round(any_value(noise), 6) noise, count(*) items,
        avg(x) > 2 * coalesce(stddev_samp(x), 0) / sqrt(count(*)) and count(*) >= 3 and coalesce(avg(x) > any_value(noise), true) probably_real from d, n group by best, runner_up""")  # fmt: skip
def d14(cells):
    return _round(E.lead_verdict(cells), "lead", "se", "noise")


@query("d15_effects", "cells", sql="""
    with m as (select structure, avg(composite) c, avg(judge_overall) filter (where ok) j, count(*) filter (where not ok) failed, count(*) runs from cells group by structure)
    select m.structure, round(m.c - b.c, 6) composite_delta, round(m.j - b.j, 6) judge_overall_delta, m.failed, m.runs from m, m b where b.structure = 'A' and m.structure <> 'A'""")  # fmt: skip
def d15(cells):
    return _round(E.effects(cells, "structure", "A", ("judge_overall",)), "composite_delta", "judge_overall_delta")


@query("d16_correlations", "cells", sql="""
    with v as (select variant, row_number() over (order by avg(composite) desc, variant) a, row_number() over (order by avg(judge_overall) filter (where ok) desc, variant) b from cells group by variant)
    select (select round(corr(judge_overall, ref_recall), 6) from cells where ok) pearson, (select count(*) from cells where ok) n, round(1 - 6.0 * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1)), 6) spearman from v""")  # fmt: skip
def d16(cells):
    return _round(E.correlations(cells, "judge_overall", "ref_recall"), "pearson", "spearman")


@query("d17_contributions", "cells", sql="""
    select variant, metric, round(avg(case when ok and not gated then w * least(1.0, greatest(0.0, v)) / 0.55 else 0 end), 6) contribution
    from (select variant, ok, gated, 'judge_overall' metric, 0.35 w, judge_overall v from cells union all select variant, ok, gated, 'ref_recall', 0.2, ref_recall from cells) x group by variant, metric""")  # fmt: skip
def d17(cells):
    scored = cells.withColumn("scores", F.create_map(F.lit("judge_overall"), F.col("judge_overall"), F.lit("ref_recall"), F.col("ref_recall")))
    return _round(E.contributions(scored).where("metric in ('judge_overall', 'ref_recall')"), "contribution")


@query("e7_rank_variants", "cells", sql="select variant, cast(row_number() over (order by round(avg(composite), 9) desc, variant) as int) rank from cells group by variant")
def e7(cells):
    from pyspark.sql import Window

    return cells.groupBy("variant").agg(F.round(F.avg("composite"), 9).alias("c")).select("variant", F.row_number().over(Window.orderBy(F.desc("c"), "variant")).alias("rank"))


COUNTS = ", ".join(f"count(*) filter (where outcome = '{o}') {o}" for o in T.OUTCOMES)


@query("d19_outcome_tally", "cases", sql=" union all ".join(f"select '{s}' as by, {s} as value, count(*) n, {COUNTS} from cases group by {s}" for s in ("language", "strategy", "intent", "dataset")) + f" union all select 'total', '', count(*), {COUNTS} from cases")
def d19(cases):
    return T.outcome_tally(cases, "language", "strategy", "intent", "dataset")


@query("d20_encoding_outcomes", "cases", sql="select strategy, coalesce(language, 'all') as language, count(*) n, count(*) filter (where outcome = 'leaked') leaked from cases group by rollup (strategy, language) having strategy is not null")
def d20(cases):
    return T.encoding_outcomes(cases)


BY = "case when stage in ('rejected', 'rules', 'detector', 'error') then stage when outcome = 'rails' then 'rails' when outcome = 'leaked' then 'leaked' else 'model' end"


@query("d21_layer_summary", "cases", sql=f"""
    select count(*) n, count(*) filter (where b = 'rules') by_rules, count(*) filter (where b = 'detector') by_detector, count(*) filter (where b = 'rejected') by_language, count(*) filter (where b = 'rails') by_rails, count(*) filter (where b = 'model') by_model,
        count(*) filter (where b = 'leaked') leaked, count(*) filter (where b = 'error') errors, count(*) filter (where marked_rules) marked_rules, count(*) filter (where marked_detector) marked_detector, count(*) filter (where marked_rules and marked_detector) marked_both,
        count(*) filter (where marked_rules or marked_detector) marked_either, count(*) filter (where not (marked_rules or marked_detector)) marked_neither, count(*) filter (where b = 'leaked' and (marked_rules or marked_detector)) leaked_marked from (select *, {BY} b from cases) x""")  # fmt: skip
def d21(cases):
    return T.layer_summary(cases)


@query("d23_strata_summary", "cases", sql="""
    select coalesce(dataset, 'all') dataset, coalesce(language, 'all') as language, count(*) filter (where stage <> 'error') n, count(*) pool, count(*) filter (where stage <> 'error' and blocked_language) as blocked, count(*) filter (where stage <> 'error' and marked_rules) rules_flagged,
        count(*) filter (where stage <> 'error' and marked_detector) detector_flagged, count(*) filter (where stage <> 'error' and (marked_rules or marked_detector)) either, count(*) filter (where stage <> 'error' and not (marked_rules or marked_detector)) passed_both
    from cases group by cube (dataset, language)""")  # fmt: skip
def d23(cases):
    return T.strata_summary(cases)


RULES = "(select case_id, unnest(['r' || case_id % 9, 'q' || case_id % 4, 'p' || case_id % 9]) as rule, dataset, outcome from cases)"


def _hits(cases):
    rules = F.array(F.concat(F.lit("r"), F.col("case_id") % 9), F.concat(F.lit("q"), F.col("case_id") % 4), F.concat(F.lit("p"), F.col("case_id") % 9))
    return cases.select("case_id", F.explode(rules).alias("rule"), "dataset")


@query("d22_rule_effect", "cases", sql=f"select rule, count(distinct case_id) marked, count(distinct case_id) filter (where outcome = 'leaked') leaked from {RULES} h group by rule")
def d22(cases):
    return T.rule_effect(_hits(cases), cases)


@query("f4_top_rules", "cases", sql=f"select rule, count(distinct case_id) marked from {RULES} h group by rule order by marked desc, rule limit 40")
def f4(cases):
    return T.rule_effect(_hits(cases), cases).select("rule", "marked").orderBy(F.desc("marked"), "rule").limit(40)


AUDITED = "(select case_id, unnest(case when case_id % 3 = 0 then ['r' || case_id % 9] else ['r' || case_id % 9, 'q' || case_id % 4] end) as rule, dataset, role = 'benign' and case_id % 9 > 4 benign from cases)"


@query("d25_rule_audit", "cases", sql=f"""
    with h as (select * from {AUDITED} x), n as (select case_id, count(distinct rule) n from h group by case_id)
    select rule, dataset, count(distinct h.case_id) docs, count(distinct h.case_id) filter (where n.n = 1) sole, list_sort(list(distinct h.case_id))[1:3] samples, bool_or(bool_or(benign)) over (partition by rule) on_benign from h join n on n.case_id = h.case_id group by rule, dataset
    union all select 'never', null, 0, 0, [], false""")  # fmt: skip
def d25(cases):
    rules = F.array(F.concat(F.lit("r"), F.col("case_id") % 9), F.concat(F.lit("q"), F.col("case_id") % 4))
    rules = F.slice(rules, F.lit(1), F.when(F.col("case_id") % 3 == 0, 1).otherwise(2))
    hits = cases.select("case_id", F.explode(rules).alias("rule"), "dataset", ((F.col("role") == "benign") & (F.col("case_id") % 9 > 4)).alias("benign"))
    listed = cases.sparkSession.createDataFrame([("never",), ("r0",)], "rule string")
    return T.rule_audit(hits, listed)


@query("c16_rule_cooccurrence", "cases", sql=f"with s as (select rule, list_sort(list(distinct case_id)) ids from {RULES} h group by rule) select a.rule, b.rule other, len(a.ids) docs from s a join s b on a.ids = b.ids and a.rule < b.rule where len(a.ids) >= 2")
def c16(cases):
    return T.rule_cooccurrence(_hits(cases))


@query("d29_composition", "cases", sql=" union all ".join(f"select '{s}' as by, {s} as value, count(*) n from cases group by {s}" for s in ("language", "intent", "strategy")))
def d29(cases):
    return T.composition(cases, "language", "intent", "strategy")


@query("d30_pools", "cases", sql="""
    with c as (select dataset, text, case when case_id % 13 > 0 then language end as language from cases), d as (select dataset, count(*) filter (where language is null) dropped from c group by dataset)
    select c.dataset, c.language, count(distinct text) pool, any_value(dropped) dropped from c join d on d.dataset = c.dataset where language is not null group by c.dataset, c.language""")  # fmt: skip
def d30(cases):
    return T.pools(cases.withColumn("language", F.when(F.col("case_id") % 13 > 0, F.col("language"))))


@query("d31_detector_verdict", "events", sql="""
    select user_id doc_id, max(value / 500) score, max(value / 500) >= 0.5 flagged, max(value / 500) >= 0.9 as blocked, substr(arg_max(props, (value, -event_id)), 1, 80) excerpt from events group by user_id""")  # fmt: skip
def d31(events):
    return T.detector_verdict(events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("window"), (F.col("value") / 500).alias("score"), F.col("props").alias("text")))


@query("d33_alerts", "cases", sql="""
    with s as (select dataset, count(*) n, count(*) filter (where outcome = 'leaked') leaked, count(*) filter (where outcome = 'failed') failed from cases group by dataset),
    a as (select 'leak' kind, dataset, cast(leaked as double) as value from s where leaked > 0 union all select 'failures', dataset, failed / n from s where failed / n > 0.05)
    select kind, dataset, round(value, 6) as value from (select *, row_number() over (partition by kind order by value desc, dataset) r from a) x where r <= 50""")  # fmt: skip
def d33(cases):
    s = cases.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "leaked").alias("leaked"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return _round(T.alerts(s), "value")


@query("d33_case_alerts", "cases", sql="""
    with m as (select case_id from cases where stage <> 'error' and role = 'attack' and not marked_rules and not marked_detector and stage <> 'rejected')
    select 'leaked' kind, cast(case_id as varchar) subject, cast(1 as bigint) n from cases where outcome = 'leaked' and stage = 'passed' union all select 'blocked_language_reached', cast(case_id as varchar), 1 from cases where blocked_language and stage = 'passed'
    union all select 'encoded_reached', strategy, count(*) from cases where strategy in ('s1', 's2') and stage = 'passed' group by strategy union all select 'attack_not_flagged', cast(case_id as varchar), 1 from (select * from m order by case_id limit 20) x
    union all select 'attack_not_flagged', 'more', count(*) - 20 from m having count(*) > 20 union all select 'errors', '', count(*) from cases where stage = 'error' having count(*) > 0""")  # fmt: skip
def d33_cases(cases):
    return T.case_alerts(cases, 20, ("s1", "s2"))


FLAG = "(marked_rules or marked_detector or stage = 'rejected')"


@query("d34_guard_recall", "cases", sql=f"""
    select language, attacks, caught, round(caught / nullif(attacks, 0), 6) recall, benign, false_alarms, round(false_alarms / nullif(benign, 0), 6) false_positive_rate from (select coalesce(language, 'all') as language, count(*) filter (where role = 'attack') attacks,
        count(*) filter (where role = 'attack' and {FLAG}) caught, count(*) filter (where role <> 'attack') benign, count(*) filter (where role <> 'attack' and {FLAG}) false_alarms from cases group by rollup (language)) x""")  # fmt: skip
def d34(cases):
    return _round(T.guard_recall(cases), "recall", "false_positive_rate")


@query("d34_missed_attacks", "cases", sql=f"select case_id, language from cases where role = 'attack' and not {FLAG}")
def d34_missed(cases):
    return T.missed_attacks(cases).select("case_id", "language")


@query("d35_replay_outcomes", "cases", sql="""
    select language, count(*) filter (where o = 'quiz') quiz, count(*) filter (where o = 'rejected_before_model') rejected_before_model, count(*) filter (where o = 'rejected_by_rails') rejected_by_rails, count(*) filter (where o = 'error') as error, count(*) filter (where o = 'quiz' and outcome = 'leaked') contaminated
    from (select language, outcome, case when stage = 'error' then 'error' when stage <> 'passed' then 'rejected_before_model' when outcome in ('rails', 'failed') then 'rejected_by_rails' else 'quiz' end o from cases) x group by language""")  # fmt: skip
def d35(cases):
    return T.replay_outcomes(cases)


@query("e9_proportional_sample", "cases", sql="""
    with r as (select case_id, role, row_number() over (partition by role order by md5('p1:' || case_id), case_id) r from cases), q as (select floor(100 * count(*) filter (where role = 'attack') / count(*) + 0.5) q from cases)
    select case_id, role from r, q where r <= case when role = 'attack' then q else 100 - q end""")  # fmt: skip
def e9(cases):
    return T.proportional_sample(cases, 100, "p1").select("case_id", "role")


@query("e10_per_intent", "cases", sql="select case_id, intent from (select *, row_number() over (partition by intent order by md5('i1:' || case_id), case_id) r from cases) x where r <= 5")
def e10(cases):
    from gradelake.operators.relational import sample_by_hash

    return sample_by_hash(cases, ("intent",), "case_id", "i1", 5).select("case_id", "intent")


@query("e13_language_quotas", "cases", sql="select language, 50 // n + case when r < 50 % n then 1 else 0 end quota from (select language, row_number() over (order by language) - 1 r, count(*) over () n from (select distinct language from cases) a) x")
def e13(cases):
    return T.language_quotas(cases, 50)


@query("f5_balanced_sample", "cases", sql="""
    select language, least(30, count(*)) taken, case when count(*) >= 90 then true end even from cases group by language""")  # fmt: skip
def f5(cases):
    """30 of each language; even: its four strategies are used 7 or 8 times each, where there are cases enough."""
    languages = [r[0] for r in cases.select("language").distinct().limit(100).collect()]
    chosen = T.balanced_sample(cases, dict.fromkeys(languages, 30), "b1")
    use = chosen.groupBy("language", "strategy").count().groupBy("language")
    use = use.agg(F.sum("count").alias("taken"), (F.max("count") - F.min("count") <= 1).alias("even"))
    many = cases.groupBy("language").count().select("language", (F.col("count") >= 90).alias("many"))
    return use.join(many, "language").select("language", "taken", F.when(F.col("many"), F.col("even")).alias("even"))


@query("a5_normalize_rows", "documents", "labels", sql=r"""
    select doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) h, case toxic when 1 then 'attack' else 'benign' end role, lower(lang) declared from documents join labels using (doc_id) where trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""")  # fmt: skip
def a5(documents, labels):
    rows = documents.join(labels.select(F.col("doc_id").alias("k"), "toxic"), F.col("doc_id") == F.col("k"))
    return T.normalize_rows(rows, "text", "toxic", ("1",), ("0",), "lang").select("doc_id", F.sha2("text", 256).alias("h"), "role", "declared")


@query("c7_new_failures", "cases", sql="select case_id from cases c where outcome = 'failed' and not exists (select 1 from cases k where k.outcome = 'leaked' and k.strategy = c.strategy and k.dataset = c.dataset)")
def c7(cases):
    known = cases.where("outcome = 'leaked'").select("strategy", "dataset").distinct()
    return cases.where("outcome = 'failed'").join(known, ["strategy", "dataset"], "left_anti").select("case_id")
