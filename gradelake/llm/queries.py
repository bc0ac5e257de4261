"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from gradelake.llm import bpe, collocations, line_quality, near_vectors, order_minhash, packing, pieces, pii, sharding, spelling
from gradelake.llm import suffix_dedup, token_counts, toxicity
from gradelake.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on this machine; the files themselves are never part of this repository."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.range_join(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=200)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.answers(token_counts.histogram(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), n_shards=16)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.annotate(docs, pii.fit(docs))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, first=2000)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), loses_one=spelling.LOSES_ONE)


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_minhash_near_dedup, op3_suffix_array_dedup, op4_toxicity, op5_bpe, op6_token_counts,
        op7_best_fit_packing, op8_sharding, op9_quality_rules, op10_pii, op11_phrase_collocations, op12_sentencepiece,
        op13_spelling_variants,
    )
}
OP1_SQL = """
with recursive v as (select vec_id, label, cast(embedding as double[]) e from embeddings where label is not null and vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
n as (select *, sqrt(list_dot_product(e, e)) norm from v where list_dot_product(e, e) > 0),
link as (select a.vec_id a, b.vec_id b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join link l on r.b = l.a)
select e.vec_id, (select count(*) from link where a = e.vec_id) n_links, r.b component_id, r.b = e.vec_id kept from embeddings e join (select a, min(b) b from reach group by a) r on r.a = e.vec_id
"""
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": OP1_SQL,
    "op9_quality_rules": line_quality.ORACLE,
    "op11_phrase_collocations": collocations.ORACLE,
}
