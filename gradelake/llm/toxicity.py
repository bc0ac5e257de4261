"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios (Wang and Manning, 2012)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import cut, drop

SIZES = (4, 5, 6)
BITS = 20


def ngrams(text: str) -> np.ndarray:
    """Bucket numbers, repeats included, of the n-grams of a text's lower-case UTF-8 bytes, a space before and after."""
    b = np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8).astype(np.uint64)
    out = []
    h = b + np.uint64(1)
    for n in range(2, max(SIZES) + 1):
        if len(b) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + b[n - 1 :]
        if n in SIZES:
            x = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 + 2 * n)
            out.append((x >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    """Weight of each bucket (log-count ratio times learned coefficient; 0: not used) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        i = ngrams(text or "")
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[np.unique(i[self.weights[i] != 0])].sum(), -500, 500))))


def ratios(counts: np.ndarray, of: np.ndarray, least: int = 3, z: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """From counts of texts by class (other, toxic) and bucket, and of texts by class: which buckets are used, and r of each, the log of its smoothed share of toxic
    over that of other texts. Buckets in fewer than `least` texts, or with a ratio less than z standard errors from 0, are not used."""
    share = (counts + 0.5) / (of[:, None] + 1)
    ratio = np.log(share[1]) - np.log(share[0])
    return (counts.sum(axis=0) >= least) & (np.abs(ratio) >= z * np.sqrt((1 / (counts + 0.5)).sum(axis=0))), ratio


def regress(columns: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, steps: int = 300, ridge: float = 1e-4, at_once: int = 512) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of n-grams (columns of each text), each scaled by its ratio: weights with the ratios in them, and the intercept."""
    n, size, y = len(columns), len(ratio), toxic.astype(float)
    b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if not 0 < y.sum() < n:  # one kind of label alone: the share of toxic labels is all there is to learn
        return np.zeros(size), b
    blocks = []
    for k in range(0, n, at_once):  # a block's products are small whatever the number of texts
        own = columns[k : k + at_once]
        blocks.append((np.concatenate(own).astype(np.int32), np.array([len(c) for c in own]), y[k : k + at_once]))
    w, m, v = np.zeros(size), np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, steps + 1):
        scaled, g, g0 = ratio * w, np.zeros(size), 0.0
        for col, sizes, own in blocks:
            ends = np.cumsum(sizes)
            total = np.r_[0, np.cumsum(scaled[col])]
            off = 1 / (1 + np.exp(-np.clip(b + total[ends] - total[ends - sizes], -500, 500))) - own
            g += np.bincount(col, np.repeat(off, sizes), size)
            g0 += off.sum()
        g = np.append(ratio * g / n + ridge * w, g0 / n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return ratio * w, float(b)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> Model:
    """A model learned from at most max_rows labelled documents (a bounded sample, in the order of a hash of the id).

    Rows whose crc32(id as text) is divisible by `folds` are held out and never seen. Labels other than 0 and 1, null ids and null texts are left out; an id
    labelled twice is toxic if any label says so; repeated rows count as often as they occur; very long texts are read whole; further columns change nothing; empty
    tables give a model that says 0.5. Tasks count the n-grams of their texts, and tasks by ranges of buckets add the counts up and choose the n-grams; those (2^BITS at
    most) go to all tasks, which turn texts into short lists of numbers. Only these, of the bounded sample, meet in one task for the regression.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    known = known.where(F.crc32(F.col("__id").cast("string").cast("binary")) % folds != 0).groupBy("__id").agg(F.max("__y").alias("__y"))
    known = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows))
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("t")).where("t is not null").join(known, F.col("__doc") == F.col("__id"))
    sample = cut(rows.select(F.xxhash64("__doc", "t").alias("k"), "t", F.col("__y").alias("y")), "labelled")
    of = np.zeros(2)
    for r in sample.groupBy("y").count().collect():
        of[r["y"]] = r["count"]
    if not of.all():
        drop(sample)
        return Model(np.zeros(1 << BITS), float(np.log((of[1] + 0.5) / (of[0] + 0.5))))
    width = 1 << BITS - 6

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[y][np.unique(ngrams(t))] += 1
        for k in range(64):
            own = counts[:, k * width : (k + 1) * width]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["block", "counts"])

    def choose(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int32).reshape(2, width).astype(float) for c in group["counts"])
        used, ratio = ratios(total, of)
        return pa.table({"i": pa.array(np.flatnonzero(used) + key[0].as_py() * width, pa.int32()), "r": pa.array(ratio[used])})

    chosen = sample.select("t", "y").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(choose, "i int, r double").orderBy("i").collect()
    bucket, ratio = np.array([r["i"] for r in chosen], np.int64), np.array([r["r"] for r in chosen], float)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(1 << BITS, -1, np.int32)
        column[bucket] = np.arange(len(bucket))
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                own = [np.unique(c[c >= 0]) for c in (column[ngrams(t)] for t in part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(own, pa.list_(pa.int32()))], ["k", "y", "columns"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, y = [], []
        for b in batches:
            y += b.column(1).to_pylist()
            columns += [c.values.to_numpy() for c in b.column(2)]
        weights, intercept = regress(columns, np.array(y), ratio)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([intercept])], ["w", "b"])

    numbers = sample.select("k", "t", "y").mapInArrow(number, "k long, y int, columns array<int>").repartition(1).sortWithinPartitions("k", "y")
    got = numbers.mapInArrow(learn, "w binary, b double").first()
    drop(sample)
    weights = np.zeros(1 << BITS)
    weights[bucket] = np.frombuffer(got["w"])
    return Model(weights, got["b"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), folds: int = 5) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 from 0.5 on); carry names further columns to return.

    Only the text counts; a null one is empty, and an empty one gets the score of a text without any known n-gram. held_out tells whether crc32(id as text)
    is divisible by folds (a null id is not). Scores may tie. Each row is scored on its own, whole, so repeated rows, long texts and columns of any name change nothing; an empty
    table gives no rows. The model travels with the tasks: a few thousand weights of a table of 2^20.
    """
    some = np.flatnonzero(model.weights)
    values, intercept = model.weights[some], model.intercept
    kept = docs.select(F.col(id_col), *carry, F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        weights[some] = values
        own = Model(weights, intercept)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                s = [own.score(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [*part.schema.names[:-1], "score", "predicted"])

    return kept.mapInArrow(run, schema)
