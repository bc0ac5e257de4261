from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradelake.llm import pii, queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "pii", "best_fit_packing"]
    seen, columns = {"": docs}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == columns
    ids = {k: [r["doc_id"] for r in v.collect()] for k, v in seen.items()}
    assert all(len(v) == len(set(v)) for k, v in ids.items() if k != "best_fit_packing")
    toxic = {r["doc_id"] for r in queries.op4_toxicity(spark, small).where("predicted = 1").collect()}
    assert set(ids["toxicity"]) == set(ids[""]) - toxic and toxic
    text = {k: {r["doc_id"]: r["text"] for r in v.collect()} for k, v in seen.items() if k != "best_fit_packing"}
    assert set(ids["minhash_near_dedup"]) < set(ids["toxicity"]) and len({*text["minhash_near_dedup"].values()}) == len(ids["minhash_near_dedup"])
    assert ids["suffix_array_dedup"] and Counter(ids["suffix_array_dedup"]) == Counter(ids["minhash_near_dedup"]) == Counter(ids["pii"])
    assert all(len(text["suffix_array_dedup"][i]) <= len(text["minhash_near_dedup"][i]) for i in ids["pii"])
    assert not any(pii.base_spans(t)["email"] for t in text["pii"].values())
    assert {*ids["best_fit_packing"]} == {*ids["pii"]}
    assert sorted(map(tuple, docs.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, small).select("doc_id", "piece", "length").collect()))


def test_odd_documents(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(1, 0, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs.select(*corpus_pipeline.COLUMNS)
    for k, start in enumerate((docs, docs.limit(0))):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{name}")
            now = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert (now.count() == 0) == (k == 1)


def test_batches_are_bounded_by_bytes(spark, small):
    session = spark.newSession()
    rows = session.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 33_333).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).alias("n_chars"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    largest = lambda: rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    dict(corpus_pipeline.STAGES)["pii"](session, rows, small)
    assert largest() < 3 << 20
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    dict(corpus_pipeline.STAGES)["pii"](session, rows, small)
    assert largest() < 2 << 20
