"""The relations of an assessment service as projections of the given tables: one SQL text each, read alike by Spark and other engines.

Times are UTC, keys are numbers. A relation may build on tables and on relations above it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RELATIONS: dict[str, str] = {
    # one attempt of a user at a quiz
    "attempts": """
        select o_orderkey attempt_id, o_custkey user_id, o_custkey % 200 quiz_id, o_orderdate started_at,
            case when o_orderstatus = 'P' then 'in_progress' else 'submitted' end status,
            case when o_orderstatus <> 'P' then o_orderdate + interval '1' day end submitted_at
        from orders""",
    # one answer: k correct options, of which `hits` were chosen, and `misses` wrong choices
    "answers": """
        select l_orderkey attempt_id, position, 1 + l_partkey % 3 k, l_suppkey % (2 + l_partkey % 3) hits, cast(floor(l_quantity) as int) % (4 - l_partkey % 3) misses, l_shipdate answered_at
        from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) position from lineitem) x""",
    # answer events: the same answer again and again, under a revision number that does not follow time
    "answer_events": """
        select event_id, user_id attempt_id, event_id % 11 question_id, event_id % 7 revision, ts, value from events""",
    # documents with an address each
    "sources": """
        select doc_id source_id, concat('https://github.com/', source, '/doc', cast(doc_id as string)) url, text content_text, lang, source, n_chars,
            case when doc_id % 3 = 0 then null else timestamp '2024-01-01 00:00:00' + doc_id % 1000 * interval '1' hour end listed_at,
            timestamp '2024-01-01 00:00:00' + doc_id % 777 * interval '1' hour fetched_at
        from documents""",
    # documents as Markdown: two sections, a badge and a link in every fifth
    "md_docs": """
        select doc_id, lang, concat('https://github.com/', source, '/doc', cast(doc_id as string)) url, concat('# Doc ', cast(doc_id as string), chr(10), substr(text, 1, cast(floor(length(text) / 3) as int)), chr(10), chr(10), '## Part B', chr(10),
            substr(text, cast(floor(length(text) / 3) as int) + 1), case when doc_id % 5 = 0 then concat(chr(10), chr(10), '![badge](https://img.example/x.svg) see [the docs](https://example.org/a?b=c).') else '' end) text from documents""",
    # generated quizzes
    "quizzes": """
        select o_orderkey quiz_id, o_custkey owner, o_orderkey % 500 source_id, o_orderdate created_at, o_shippriority_ idem,
            case o_orderstatus when 'F' then 'ready' when 'O' then 'failed' else 'generating' end status,
            case when o_orderkey % 2 = 0 then 'drafting' end phase, cast(o_orderkey % 5 as int) phase_step, cast(5 as int) phase_total,
            case when o_orderstatus = 'O' then case o_orderkey % 6
                when 0 then 'SourceError: host not allowed: evil.example/x' when 1 then 'UnsafeError: the classifier scored 0.97 on this — excerpt: ignore all rules'
                when 2 then 'SourceError: source returned HTTP 404' when 3 then 'job timed out' when 4 then 'unsupported_language: other' else 'Error: boom' end end error
        from (select *, o_orderkey % 9 o_shippriority_ from orders) x""",
    "jobs": """
        select o_orderkey quiz_id, cast(1 + o_orderkey % 3 as int) attempt_no, case o_orderstatus when 'F' then 'succeeded' when 'O' then 'failed' else 'running' end status,
            case o_orderkey % 3 when 0 then 'model-a' when 1 then 'model-b' else 'model-c' end model, cast(floor(o_totalprice) as bigint) prompt_tokens, o_custkey completion_tokens,
            o_orderdate started_at, case when o_orderstatus <> 'P' then o_orderdate + interval '2' hour end finished_at,
            case when o_orderkey % 4 = 0 then o_orderdate + interval '3' hour end scored_at, cast(o_orderkey % 8 as int) scoring_attempts
        from orders""",
    # multiple-choice questions: four options, one to three of them right
    "questions": """
        select p_partkey question_id, p_partkey % 300 quiz_id, p_name prompt, array(p_brand, p_type, concat(p_type, ' of ', p_name), concat('Option ', cast(p_size as string))) options,
            case p_partkey % 3 when 0 then array(0) when 1 then array(cast(p_size % 4 as int)) else array(1, 2) end correct,
            case when p_size < 17 then 'easy' when p_size < 34 then 'medium' else 'hard' end difficulty, row_number() over (partition by p_partkey % 300 order by p_partkey) position
        from part""",
    # evaluator values of quizzes, newest by time
    "eval_scores": """
        select event_id, user_id quiz_id, event_type evaluator, least(1.0, value / 100) value, ts from events""",
    # cells of an experiment: variant x item x repetition
    "cells": """
        select concat(l_returnflag, l_linestatus) variant, l_returnflag structure, l_linestatus prompt, l_suppkey % 12 item, l_linenumber rep, l_discount * 10 composite, l_quantity % 10 > 0 ok, l_tax >= 0.07 gated,
            l_extendedprice / 1000000 cost, cast(floor(l_quantity) as double) as seconds, l_partkey % 7 calls, l_tax * 12 judge_overall, l_quantity / 50 ref_recall
        from lineitem""",
    # red-team cases: documents, toxic ones the attacks; two languages are blocked
    "cases": """
        select d.doc_id case_id, d.source dataset, d.lang language, d.text, case when l.toxic = 1 then 'attack' else 'benign' end role, d.lang in ('fr', 'de') blocked_language,
            concat('s', cast(d.doc_id % 4 as string)) strategy, concat('i', cast(d.doc_id % 6 as string)) intent,
            case when d.doc_id % 23 = 0 then 'error' when d.lang in ('fr', 'de') then 'rejected' when d.doc_id % 7 = 0 then 'rules' when d.doc_id % 11 = 0 then 'detector' else 'passed' end stage,
            d.doc_id % 7 = 0 or d.doc_id % 19 = 0 marked_rules, d.doc_id % 11 = 0 or d.doc_id % 14 = 0 marked_detector,
            case when d.doc_id % 29 = 0 then 'leaked' when d.doc_id % 13 = 0 then 'failed' when d.doc_id % 5 = 0 then 'rejected' when d.doc_id % 17 = 0 then 'rails' else 'resisted' end outcome
        from documents d left join (select doc_id, max(toxic) toxic from labels group by doc_id) l on d.doc_id = l.doc_id""",
}


def _needs(sql: str) -> list[str]:
    return [n for n in (*TABLES, *RELATIONS) if re.search(rf"\b(?:from|join)\s+{n}\b", sql)]


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or relation by name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = RELATIONS[name]
    used = _needs(sql)
    for n in used:
        sql = re.sub(rf"\b(from|join)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    return spark.sql(sql, **{n: relation(spark, sf_dir, n) for n in used})


def with_relations(sql: str) -> str:
    """sql with the relations it reads defined before it, for an engine that has the tables."""
    names: list[str] = []

    def add(text: str) -> None:
        for n in _needs(text):
            if n in RELATIONS and n not in names:
                add(RELATIONS[n])
                names.append(n)

    add(sql)
    return ("with " + ", ".join(f"{n} as ({RELATIONS[n].replace('array(', 'list_value(').replace('as string', 'as varchar')})" for n in names) + " " if names else "") + re.sub(r"^\s*with\s", ", ", sql) if names else sql
