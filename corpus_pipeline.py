"""The corpus pipeline: five operators, each on what the one before has kept, written as Parquet and read again in between.

Every stage reads whole texts, very long ones too, takes columns besides those of documents for what they are (not looked at, not returned), and gives no rows
for an empty table. A null text is an empty one to all of them. Null ids are kept but for the second stage's copies: they come last in a class.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import order_minhash, packing, pii, suffix_dedup, toxicity
from gradelake.llm.common import shared_dir, table
from gradelake.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels on these documents, does not call toxic.

    Null and empty texts get the score of a text without known n-grams. Repeated rows are scored alike and all stay or all go. A score of 0.5 is toxic.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or near-equal texts: the one of the least id, once.

    Null and empty texts are one group. Rows that repeat an id and a text become one; where they differ in other columns (a tie) the least values win, nulls first.
    """
    kept = order_minhash.classes(docs, carry=COLUMNS[1:]).where("kept")
    return kept.groupBy("doc_id", "text_class").agg(F.min(F.struct(*COLUMNS[1:])).alias("one")).select("doc_id", "one.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that also stand elsewhere.

    A null text becomes an empty one. Repeated rows are copies of each other and lose all from 200 bytes on.
    """
    kept = suffix_dedup.remove_repeats(docs, keep_text=True, carry=COLUMNS[2:4])
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets.

    A null text stays null. Spans that overlap (ties) are replaced as one, under the first one's kind. Repeated rows are masked alike.
    """
    found = pii.annotate(docs, pii.fit(docs), carry=COLUMNS[2:4], mask=True)
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence and place there.

    A null text is one piece of one id. Repeated rows are packed each; pieces of one length tie and are told apart by id, number and hash.
    """
    return packing.pack(docs, tokenizer_path())


#: So many bytes of rows go to Python at once. Executors keep the memory of their largest batches, outside the heap, from stage to stage.
BATCH = 2 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with Arrow batches of BATCH bytes, or fewer if the session says so. The setting stays: the caller runs what a stage returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES))
        if not 0 < size <= BATCH:
            spark.conf.set(BATCH_BYTES, BATCH)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _in_small_batches(without_toxic)),
    ("minhash_near_dedup", _in_small_batches(without_near_duplicates)),
    ("suffix_array_dedup", _in_small_batches(without_repeats)),
    ("pii", _in_small_batches(without_personal_data)),
    ("best_fit_packing", _in_small_batches(packed)),
]

#: SQL can express neither the classifiers nor the sketches; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
