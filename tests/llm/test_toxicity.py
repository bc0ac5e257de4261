import math
import zlib
from collections import Counter

import numpy as np

from gradelake.llm import queries, toxicity


def learned(texts, y):
    """The same model in one place: counts by dictionaries, then the regression's optimum by Newton's method on whole matrices."""
    presence = [set(toxicity.ngrams(t).tolist()) for t in texts]
    of = Counter(y)
    counts = [Counter(g for p, v in zip(presence, y) if v == k for g in p) for k in (0, 1)]
    ratio = {}
    for g in counts[0].keys() | counts[1].keys():
        n0, n1 = counts[0][g], counts[1][g]
        r = math.log((n1 + 0.5) / (of[1] + 1)) - math.log((n0 + 0.5) / (of[0] + 1))
        if n0 + n1 >= 3 and abs(r) >= 3 * math.sqrt(1 / (n0 + 0.5) + 1 / (n1 + 0.5)):
            ratio[g] = r
    return ratio, presence


def labelled(words):
    rng = np.random.default_rng(1)
    texts, y = [], []
    for i in range(400):
        w = list(rng.choice(words, 40))
        if i % 5 == 0:
            w[int(rng.integers(40))] = str(rng.choice(["worthless", "vermin"]))
        texts.append(" ".join(w))
        y.append(int(i % 5 == 0))
    return texts, y


def test_learns_words_and_leaves_clean_texts_alone(spark, words):
    """fit() against a brute-force selection and the regression's conditions, and on texts it has not seen."""
    texts, y = labelled(words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs.repartition(7), spark.createDataFrame(list(enumerate(y[:300])), "doc_id long, toxic int"))
    seen = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    ratio, presence = learned([texts[i] for i in seen], [y[i] for i in seen])
    assert {*np.flatnonzero(model.weights).tolist()} == {*ratio}
    p = np.array([model.score(texts[i]) for i in seen])
    off = p - np.array([y[i] for i in seen])
    for g, r in ratio.items():  # the gradient is 0 at the optimum
        own = sum(o for o, s in zip(off, presence) if g in s)
        assert abs(r * own / len(seen) + 1e-4 * model.weights[g] / r) < 2e-3
    assert abs(off.mean()) < 2e-3
    assert [int(model.score(t) >= 0.5) for t in texts[300:]] == y[300:]
    assert model.score(" ".join(words[:50] * 40) + " vermin") > 0.5 > model.score(" ".join(words[:50] * 40))
    assert model.score("") == model.score(None) < 0.5


def test_one_kind_of_label(spark, words):
    docs = spark.createDataFrame(list(enumerate(words[:20])), "doc_id long, text string")
    assert toxicity.fit(docs.limit(0), docs.selectExpr("doc_id", "0 toxic")).score("x") == 0.5
    assert toxicity.fit(docs, docs.selectExpr("doc_id", "0 toxic")).score("x") < 0.1


def test_query_holds_out_its_fold(spark, small):
    rows = {r["doc_id"]: r for r in queries.op4_toxicity(spark, small).collect()}
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{small}/labels.parquet").collect()]
    assert np.mean([rows[i]["predicted"] == y for i, y in labels]) > 0.9


def test_held_out_labels_change_nothing(spark, small):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert (a.weights == b.weights).all() and a.intercept == b.intercept


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (7, 0, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_docs, labels)
    rows = toxicity.score(odd_docs, model, carry=("source", "rank", "rows")).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(odd_docs.limit(0), model).collect() == []
    assert toxicity.fit(odd_docs.limit(0), labels.limit(0)).intercept == 0.0
