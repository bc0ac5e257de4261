"""Quality scores of quizzes and statistics of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights and gates of the two overall scores, and of the judge's criteria.
QUALITY_WEIGHTS = {"judge_overall": 0.45, "lint_pass": 0.15, "relevance": 0.15, "question_diversity": 0.15, "coverage": 0.1}
QUALITY_GATES = ("grounded", "language_match")
COMPOSITE_WEIGHTS = {"judge_overall": 0.35, "ref_recall": 0.2, "ref_precision": 0.05, "emb_relevance": 0.1, "emb_diversity": 0.1, "lint_pass": 0.1, "coverage": 0.1}
COMPOSITE_GATES = ("grounded", "injection_resisted", "language_match")
JUDGE_WEIGHTS = {"faithfulness": 2.0, "clarity": 1.0, "distractors": 1.0, "coverage": 1.0, "difficulty_mix": 0.5}


def _weighted(scores: str, weights: dict[str, float]) -> tuple[Column, Column]:
    total, value = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        v = F.col(scores)[name]
        total = total + F.when(v.isNotNull(), w).otherwise(0.0)
        value = value + F.coalesce(w * F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), F.lit(0.0))
    return value, total


def _gated(scores: str, gates: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for g in gates:
        out = out | F.coalesce(F.col(scores)[g] < 1, F.lit(False))
    return out


def quality_overall(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Weighted mean of the scores present (a map), clamped; 0 if a gate fails; null without a judge, gated or not."""
    value, total = _weighted(scores, QUALITY_WEIGHTS)
    gated = _gated(scores, QUALITY_GATES)
    return df.withColumn("quality", F.when(F.col(scores)["judge_overall"].isNotNull(), F.when(gated, 0.0).otherwise(value / total))).withColumn("gated", gated)


def composite(df: DataFrame, scores: str = "scores") -> DataFrame:
    """The same rule with the experiment's weights: 0 when gated or when nothing applies."""
    value, total = _weighted(scores, COMPOSITE_WEIGHTS)
    gated = _gated(scores, COMPOSITE_GATES)
    return df.withColumn("composite", F.when(gated | (total == 0), 0.0).otherwise(value / total)).withColumn("gated", gated)


def judge_overall(values: dict[str, Column]) -> Column:
    return sum(((values[k] - 1) / 4 * w for k, w in JUDGE_WEIGHTS.items()), F.lit(0.0)) / sum(JUDGE_WEIGHTS.values())


def judge_scores(samples: DataFrame, key: str = "quiz_id") -> DataFrame:
    """Samples (key, sample, one column a criterion, reasoning) to medians, their overall, the spread, and the reasoning of the sample nearest the median overall (ties: the first)."""
    rows = samples.withColumn("o", judge_overall({k: F.col(k) for k in JUDGE_WEIGHTS}))
    med = rows.groupBy(key).agg(*(F.percentile(k, 0.5).alias(k) for k in JUDGE_WEIGHTS), F.percentile("o", 0.5).alias("mo"), (F.max("o") - F.min("o")).alias("spread"), F.count(F.lit(1)).alias("samples"))
    near = rows.join(med.select(F.col(key).alias("mk"), "mo"), F.col(key) == F.col("mk")).groupBy(key).agg(F.min_by("reasoning", F.struct(F.round(F.abs(F.col("o") - F.col("mo")), 9), "sample")).alias("reasoning")).withColumnRenamed(key, "nk")
    return med.join(near, F.col(key) == F.col("nk")).select(key, *JUDGE_WEIGHTS, judge_overall({k: F.col(k) for k in JUDGE_WEIGHTS}).alias("overall"), "spread", "samples", "reasoning")


def quiz_metrics(questions: DataFrame, lint_ok: Column) -> DataFrame:
    """Per quiz: share without lint, spread of difficulty and of correct positions, share of single-answer questions."""
    positions = F.size(F.array_distinct(F.flatten(F.collect_set("correct"))))
    return questions.groupBy("quiz_id").agg(
        F.avg(lint_ok.cast("double")).alias("lint_pass"), F.least(F.lit(1.0), (F.count_distinct("difficulty") - 1) / 2).alias("difficulty_spread"),
        F.least(F.lit(1.0), (positions - 1) / 3).alias("position_spread"), F.avg((F.size("correct") == 1).cast("double")).alias("single_share"),
    )


def threshold_failures(scores: DataFrame, floors: DataFrame) -> DataFrame:
    """Long scores (item, metric, value) against floors (metric, floor), a handful of rows: per item the metrics below, in order."""
    f = F.broadcast(floors.withColumnRenamed("metric", "m"))
    low = F.sort_array(F.collect_list(F.when(F.col("value") < F.col("floor"), F.col("metric"))))
    return scores.join(f, F.col("metric") == F.col("m")).groupBy("item").agg(F.count_if(F.col("value") < F.col("floor")).alias("n_failures"), F.array_join(low, ",").alias("failures"))


def dataset_gate(scores: DataFrame, bars: DataFrame) -> DataFrame:
    """Mean over items of each metric against its bar."""
    b = F.broadcast(bars.withColumnRenamed("metric", "m"))
    mean = scores.groupBy("metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("items"))
    return mean.join(b, F.col("metric") == F.col("m")).select("metric", "mean", "items", "bar", (F.col("mean") >= F.col("bar")).alias("passed"))


def variant_summary(cells: DataFrame) -> DataFrame:
    """Per variant: mean of its items' means (each item counts once) and their sample deviation (0 for one item), failed, gated, cost, seconds, calls of successful cells."""
    items = cells.groupBy("variant", "item").agg(F.avg("composite").alias("m"))
    per = items.groupBy("variant").agg(F.avg("m").alias("composite"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("composite_sd"))
    rest = cells.groupBy("variant").agg(
        F.count_if(~F.col("ok")).alias("failed"), F.count_if("gated").alias("gated"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.avg("seconds").alias("seconds"), F.avg(F.when(F.col("ok"), F.col("calls"))).alias("calls")
    )
    return per.join(rest, "variant")


def rep_noise(cells: DataFrame, ok_only: bool = False) -> DataFrame:
    """One row: root of the mean variance over repetitions of (variant, item) with two or more; ok_only leaves out pairs with a failed one."""
    pairs = cells.groupBy("variant", "item").agg(F.var_samp("composite").alias("v"), F.count(F.lit(1)).alias("n"), F.min("ok").alias("all_ok")).where("n >= 2")
    return (pairs.where("all_ok") if ok_only else pairs).agg(F.sqrt(F.avg("v")).alias("noise"), F.count(F.lit(1)).alias("pairs"))


def lead_verdict(cells: DataFrame) -> DataFrame:
    """One row: best and second variant, mean lead over items, its standard error, noise, and whether the lead is probably real."""
    items = cells.groupBy("variant", "item").agg(F.avg("composite").alias("m"))
    rank = F.row_number().over(Window.orderBy(F.desc("c"), "variant"))
    top = items.groupBy("variant").agg(F.avg("m").alias("c")).withColumn("r", rank).where("r <= 2")
    best, second = (F.broadcast(top.where(f"r = {i}").select(F.col("variant").alias(f"v{i}"))) for i in (1, 2))
    a = items.join(best, F.col("variant") == F.col("v1")).select("item", "v1", F.col("m").alias("m1"))
    b = items.join(second, F.col("variant") == F.col("v2")).select(F.col("item").alias("i2"), "v2", F.col("m").alias("m2"))
    d = a.join(b, F.col("item") == F.col("i2")).groupBy("v1", "v2").agg(F.avg(F.col("m1") - F.col("m2")).alias("lead"), F.coalesce(F.stddev_samp(F.col("m1") - F.col("m2")), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("items"))
    noise = F.broadcast(rep_noise(cells, ok_only=True).select("noise"))
    se = F.col("sd") / F.sqrt("items")
    real = (F.col("lead") > 2 * se) & (F.col("items") >= 3) & (F.col("noise").isNull() | (F.col("lead") > F.col("noise")))
    return d.join(noise, F.lit(True)).select(F.col("v1").alias("best"), F.col("v2").alias("runner_up"), "lead", se.alias("se"), "noise", "items", real.alias("probably_real"))


def effects(cells: DataFrame, factor: str, base: str, metrics: tuple[str, ...]) -> DataFrame:
    """Per level of a factor, how its means differ from those of the base level; metrics over successful cells, the composite over all."""
    means = cells.groupBy(factor).agg(F.avg("composite").alias("composite"), *(F.avg(F.when(F.col("ok"), F.col(m))).alias(m) for m in metrics), F.count_if(~F.col("ok")).alias("failed"), F.count(F.lit(1)).alias("runs"))
    names = ("composite", *metrics)
    b = F.broadcast(means.where(F.col(factor) == base).select(*(F.col(m).alias(f"b_{m}") for m in names)))
    return means.where(F.col(factor) != base).join(b, F.lit(True)).select(factor, *((F.col(m) - F.col(f"b_{m}")).alias(f"{m}_delta") for m in names), "failed", "runs")


def correlations(cells: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson of x and y over successful cells (null under 3 or without variance), Spearman of variants by descending means, ties in order of their name."""
    ok = cells.where(F.col("ok") & F.col(x).isNotNull() & F.col(y).isNotNull())
    p = ok.agg(F.when(F.count(F.lit(1)) >= 3, F.corr(x, y)).alias("pearson"), F.count(F.lit(1)).alias("n"))
    v = cells.groupBy("variant").agg(F.avg("composite").alias("a"), F.avg(F.when(F.col("ok"), F.col(x))).alias("b"))
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "variant"))
    d = v.withColumn("d", F.pow(rank("a") - rank("b"), 2.0)).agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("m"))
    return p.join(F.broadcast(d), F.lit(True)).select("pearson", "n", (1 - 6 * F.col("s") / (F.col("m") * (F.col("m") * F.col("m") - 1))).alias("spearman"))


def contributions(cells: DataFrame, weights: dict[str, float] = COMPOSITE_WEIGHTS, scores: str = "scores") -> DataFrame:
    """Per variant and metric its mean weighted part of the composite over all cells; failed and gated cells count as 0."""
    _, total = _weighted(scores, weights)
    part = F.when(F.col("ok") & ~F.col("gated"), F.coalesce(F.col("w") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v"))) / F.col("t"), F.lit(0.0))).otherwise(0.0)
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(w).alias("w"), F.col(scores)[m].alias("v")) for m, w in weights.items()))
    rows = cells.select("variant", "ok", "gated", F.when(total > 0, total).otherwise(1.0).alias("t"), F.explode(parts).alias("p")).select("variant", "ok", "gated", "t", "p.*")
    return rows.groupBy("variant", "metric").agg(F.avg(part).alias("contribution"))
