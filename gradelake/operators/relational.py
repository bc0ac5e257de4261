"""Reads, checks and joins over the tables of the service: owners, quotas, jobs, catalogue, replacement by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owned(df: DataFrame, owner: Column, column: str = "owner") -> DataFrame:
    """Rows of one owner; what is not yours is not there."""
    return df.where(F.col(column) == owner)


def newest_per_key(df: DataFrame, key: str, order: str, n: int, tie: str) -> DataFrame:
    """The n newest rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie)))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def first_by_key(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row a key: the first in order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def idempotency_status(requests: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], fingerprint: str) -> DataFrame:
    """created for the first request of a key, replayed for the same fingerprint again, conflict for another one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    status = F.when(F.row_number().over(w) == 1, "created").when(F.first(fingerprint).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == F.col(fingerprint), "replayed").otherwise("conflict")
    return requests.withColumn("idempotency", status)


def quota_usage(quizzes: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """Per owner: quizzes created within 24 hours before now, and whether the quota is used up."""
    recent = quizzes.where(F.col("created_at") >= now - F.expr("interval 24 hours"))
    return recent.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).withColumn("over_quota", F.col("n") >= limit)


def trailing_quota(quizzes: DataFrame, seconds: int = 86400) -> DataFrame:
    """Per quiz how many its owner created within the trailing window, itself included."""
    w = Window.partitionBy("owner").orderBy(F.unix_timestamp(F.col("created_at").cast("timestamp"))).rangeBetween(-seconds, 0)
    return quizzes.withColumn("in_window", F.count(F.lit(1)).over(w))


def unscored_jobs(jobs: DataFrame, before: Column, max_attempts: int = 6, limit: int = 100) -> DataFrame:
    """The oldest finished jobs without a score: a report of at most `limit` rows."""
    todo = (F.col("status") == "succeeded") & F.col("scored_at").isNull() & (F.col("finished_at") < before) & (F.col("scoring_attempts") < max_attempts)
    return jobs.where(todo).orderBy("finished_at", "quiz_id").limit(limit)


def next_attempt(jobs: DataFrame) -> DataFrame:
    """Per quiz the number of the running job, else one more than the last."""
    running = F.max(F.when(F.col("status") == "running", F.col("attempt_no")))
    return jobs.groupBy("quiz_id").agg(F.coalesce(running, F.max("attempt_no") + 1).alias("attempt_no"), running.isNotNull().alias("reused"))


def scoring_input(jobs: DataFrame, quizzes: DataFrame, sources: DataFrame, questions: DataFrame, questions_of: Column | None = None) -> DataFrame:
    """Succeeded jobs of ready quizzes with their source text's length and their questions in order, nested. questions_of: whose
    questions a job takes, where quizzes share them (else its quiz's); they are nested once, however many share them."""
    s = sources.select(F.col("source_id").alias("sid"), "n_chars", "lang")
    q = questions.groupBy("quiz_id").agg(F.sort_array(F.collect_list(F.struct("position", "question_id", "prompt", "options", "correct"))).alias("questions")).withColumnRenamed("quiz_id", "qid")
    z = quizzes.where(F.col("status") == "ready").select(F.col("quiz_id").alias("zid"), "source_id")
    rows = jobs.where(F.col("status") == "succeeded").join(z, F.col("quiz_id") == F.col("zid")).join(s, F.col("source_id") == F.col("sid"))
    return rows.join(q, (F.col("quiz_id") if questions_of is None else questions_of) == F.col("qid"), "left").select("quiz_id", "attempt_no", "source_id", "lang", "n_chars", "questions")


def usage_cost(jobs: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost per model: (prompt * in + completion * out) / 1e6. prices is a handful of rows, one a model."""
    p = F.broadcast(prices.select(F.col("model").alias("m"), "price_in", "price_out"))
    cost = (F.coalesce("prompt_tokens", F.lit(0)) * F.col("price_in") + F.coalesce("completion_tokens", F.lit(0)) * F.col("price_out")) / 1e6
    return jobs.join(p, F.col("model") == F.col("m")).groupBy("model").agg(F.count(F.lit(1)).alias("jobs"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(cost).alias("cost"))


def expired_groups(rows: DataFrame, key: str, time: str, cutoff: Column) -> DataFrame:
    """Keys whose last row is older than the cutoff, with the number of rows to delete."""
    return rows.groupBy(key).agg(F.max(time).alias("last"), F.count(F.lit(1)).alias("rows")).where(F.col("last") < cutoff).select(key, "rows")


def replace_by_key(stored: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Stored rows whose key is not among the new ones, and the new ones: applying it twice changes nothing more."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def upsert_by_content(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row a content hash: the first id stays, the fetch time is the last."""
    both = stored.select("sha", "source_id", "fetched_at", F.lit(0).alias("o")).unionByName(new.select("sha", "source_id", "fetched_at", F.lit(1).alias("o")))
    return both.groupBy("sha").agg(F.min_by("source_id", F.struct("o", "source_id")).alias("source_id"), F.max("fetched_at").alias("fetched_at"), F.count(F.lit(1)).alias("seen"))


def latest_as_of(requests: DataFrame, versions: DataFrame, key: str, at: str, time: str, value: str) -> DataFrame:
    """As-of join: for each request the newest version of its key no later than it. Versions ride along in one sort by (key, time), so no pair is ever built."""
    r = requests.select(*requests.columns, F.lit(None).cast(versions.schema[value].dataType).alias("__v"), F.col(at).alias("__t"), F.lit(1).alias("__o"))
    v = versions.select(F.col(key), F.col(value).alias("__v"), F.col(time).alias("__t"), F.lit(0).alias("__o"))
    w = Window.partitionBy(key).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(v, allowMissingColumns=True).withColumn("version", F.last("__v", ignorenulls=True).over(w))
    return both.where("__o = 1").select(*requests.columns, F.col("version").alias(value))


def catalogue(entries: list[DataFrame]) -> DataFrame:
    """Entries of several sources in order of precedence; the first of a URL wins."""
    both = None
    for i, e in enumerate(entries):
        e = e.withColumn("priority", F.lit(i))
        both = e if both is None else both.unionByName(e)
    return both.groupBy("url").agg(F.min_by(F.struct("id", "origin", "language", "size"), F.struct("priority", "id")).alias("e")).select("url", "e.*")


def size_class(chars: Column) -> Column:
    return F.when(chars < 4000, "short").when(chars < 20000, "medium").otherwise("long")


def violations(df: DataFrame, table: str, unique: tuple[str, ...] = (), ranges: dict[str, tuple[float, float]] | None = None, enums: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Constraint audit of one table: rows (table, rule, n)."""
    checks = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"range:{c}") for c, (lo, hi) in (ranges or {}).items()]
    checks += [F.count_if(~F.col(c).isin(*v)).alias(f"enum:{c}") for c, v in (enums or {}).items()]
    out = None
    if checks:
        wide = df.agg(*checks)
        pairs = ", ".join(f"'{c}', `{c}`" for c in wide.columns)
        out = wide.select(F.expr(f"stack({len(wide.columns)}, {pairs}) as (rule, n)"))
    if unique:
        u = df.groupBy(*unique).count().agg(F.count_if(F.col("count") > 1).alias("n")).select(F.lit(f"unique:{','.join(unique)}").alias("rule"), "n")
        out = u if out is None else out.unionByName(u)
    return out.select(F.lit(table).alias("table_name"), "rule", "n").where("n > 0")


def foreign_key_violations(child: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    return child.join(parent, child[column] == parent[parent_column], "left_anti")


def even_pick(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """k rows of each key, spread evenly, first and last included: the i-th is round(i * (n - 1) / (k - 1)); all if there are no more than k."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    i = F.floor(F.col("rn") * (k - 1) / F.greatest(F.lit(1), F.col("n") - 1) + 0.5)
    hit = F.floor(i * (F.col("n") - 1) / (k - 1) + 0.5) == F.col("rn")
    return ranked.where((F.col("n") <= k) | hit).drop("n", "rn")


def sample_by_hash(df: DataFrame, strata: tuple[str, ...], key: str, seed: str, k: int) -> DataFrame:
    """k rows of each stratum in the order of md5(seed:key): the same rows however they are partitioned.

    Two steps: k of each stratum within 16 salts, then k of those, so a stratum with most of the rows is not ranked in one task.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.withColumn("__h", h).withColumn("__salt", F.substring("__h", 1, 1))
    some = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*strata, "__salt").orderBy("__h", key))).where(F.col("__r") <= k)
    return some.withColumn("__r", F.row_number().over(Window.partitionBy(*strata).orderBy("__h", key))).where(F.col("__r") <= k).drop("__h", "__salt", "__r")


def generation_progress(quizzes: DataFrame) -> DataFrame:
    """(quiz_id, progress): (phase, step, total) of a quiz that is being generated and says all three, else null."""
    known = (F.col("status") == "generating") & F.col("phase").isNotNull() & F.col("phase_step").isNotNull() & F.col("phase_total").isNotNull()
    said = F.struct("phase", F.col("phase_step").alias("step"), F.col("phase_total").alias("total"))
    return quizzes.select("quiz_id", F.when(known, said).alias("progress"))


def catalogue_status(sources: DataFrame, used: DataFrame, rejected: DataFrame) -> DataFrame:
    """(source_id, listed_at): when each source came into the shared catalogue, null if it is not in it.

    A source is listed when it is first used without any guard having objected (used: source_id, at, flagged), and keeps
    its first date; sources whose address was rejected since (rejected: url) leave. sources: (source_id, url, listed_at).
    """
    first = used.where(~F.coalesce("flagged", F.lit(False))).groupBy(F.col("source_id").alias("u")).agg(F.min("at").alias("at"))
    gone = rejected.where("url is not null and url <> ''").select(F.col("url").alias("r")).distinct()
    rows = sources.join(first, F.col("source_id") == F.col("u"), "left").join(gone, F.col("url") == F.col("r"), "left")
    return rows.select("source_id", F.when(F.col("r").isNull(), F.coalesce("listed_at", "at")).alias("listed_at"))


def approved_entries(requests: DataFrame, limit: int = 100) -> DataFrame:
    """Catalogue entries of the newest approved requests (request_id, title, description, url, status, reviewed_at,
    detector_score): a report of at most `limit` rows; of equal times those of the least id."""
    day = F.coalesce(F.date_format("reviewed_at", "yyyy-MM-dd"), F.lit("?"))
    score = F.when(F.col("detector_score").isNotNull(), F.concat(F.lit(" (classifier had scored "), F.format_string("%.2f", F.col("detector_score").cast("double")), F.lit(")"))).otherwise("")
    newest = requests.where("status = 'approved'").orderBy(F.desc_nulls_first("reviewed_at"), "request_id").limit(limit)
    return newest.select(
        F.concat(F.lit("approved-"), F.substring(F.col("request_id").cast("string"), 1, 8)).alias("id"), "title", F.coalesce("description", F.lit("Approved after review")).alias("description"),
        "url", F.lit("approved").alias("kind"), F.lit("en").alias("language"), F.lit("medium").alias("size"), F.concat(F.lit("Let in by review on "), day, score).alias("tests"),
    )
