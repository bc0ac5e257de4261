"""Runs of words that texts share, found from the smaller side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fingerprints of so many runs of the smaller side travel to every task; with more, texts meet in a join.
MOST_SENT = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprints(words: list[str], n: int) -> np.ndarray:
    """64 bits for each run of n words, in order. Equal runs have equal ones; others hardly ever."""
    if len(words) < n:
        return np.zeros(0, np.int64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : k + len(out)]) * _ODD + np.uint64(k + 1)
    return out.view(np.int64)


def runs_of(texts: DataFrame, n: int, only: np.ndarray | None = None, but: np.ndarray | None = None) -> DataFrame:
    """(id, h, run): the different runs of n words of each text (id, words: one string), of those with a fingerprint among
    `only`, if given, and not among `but`. A text is read once; strings are made for what is left alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, hashes, found = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                words = (text or "").split(" ")
                words = words if all(words) else list(filter(None, words))
                h, first = np.unique(fingerprints(words, n), return_index=True)
                keep = np.ones(len(h), bool)
                for some, wanted in ((only, True), (but, False)):
                    if some is not None and len(h):
                        at = np.minimum(np.searchsorted(some, h), max(0, len(some) - 1))
                        keep &= ((some[at] == h) if len(some) else np.zeros(len(h), bool)) == wanted
                for i in np.flatnonzero(keep):
                    where.append(k)
                    hashes.append(h[i])
                    found.append(" ".join(words[first[i] : first[i] + n]))
            own = b.column(0).take(pa.array(where, pa.int64()))
            columns = [own, pa.array(hashes, pa.int64()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h", "run"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "words").mapInArrow(run, f"id {kind}, h long, run string")


def sent(runs: DataFrame, most: int = MOST_SENT) -> np.ndarray | None:
    """The different fingerprints of runs, sorted, if there are no more than so many; else None."""
    got = runs.select("h").distinct().limit(most + 1).toArrow().column("h").to_numpy()
    return np.sort(got) if len(got) <= most else None


def shared_runs(left: DataFrame, right: DataFrame, n: int, ignore: DataFrame | None = None, most: int = MOST_SENT) -> DataFrame:
    """(left_id, right_id, runs, first_run): how many different runs of n words two texts share, and the first in binary
    order. left, right: (id, words); right is the smaller side. Runs that a text of `ignore` has do not count.

    The runs of the right side are taken first and those to ignore away from them; what is left goes, as fingerprints, to
    the scan of the left side, which makes rows for its hits alone. With more than `most` of them the scan makes rows for
    all its runs. Either way runs meet by an equi join and are compared as strings.
    """
    wanted = runs_of(right, n)
    only = sent(wanted, most)
    if ignore is not None:
        texts = ignore.select(F.lit(0).alias("id"), "words")
        wanted = wanted.join(runs_of(texts, n, only).select("h", "run").distinct(), ["h", "run"], "left_anti")
        only = sent(wanted, most)
    other = wanted.select(F.col("id").alias("right_id"), F.col("h").alias("h2"), F.col("run").alias("run2"))
    own = runs_of(left, n, only).withColumnRenamed("id", "left_id")
    rows = own.join(other, (F.col("h") == F.col("h2")) & (F.col("run") == F.col("run2")))
    return rows.groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("runs"), F.min("run").alias("first_run"))


def shared_within(left: DataFrame, right: DataFrame, n: int, key: str, without: DataFrame | None = None) -> DataFrame:
    """(id, key, run): runs of n words that a text of left shares with one of right of the same key, and that the text of
    `without` of that key does not have. left: (id, key, words); right, without: (key, words).

    Left and right are short texts beside the long ones of `without`: these are only looked at for keys with a shared run,
    and no rows are made of theirs.
    """
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    names = left.select(F.struct("id", F.col(key).alias("k")).alias("id"), "words")
    own = runs_of(names, n).select("id.*", "h", "run")
    other = runs_of(right.select(F.col(key).alias("id"), "words"), n)
    other = other.select(F.col("id").alias("k2"), F.col("h").alias("h2"), F.col("run").alias("run2")).distinct()
    rows = own.join(other, (F.col("k") == F.col("k2")) & (F.col("h") == F.col("h2")) & (F.col("run") == F.col("run2")))
    rows = rows.select(F.col("id").cast(kinds["id"]), F.col("k").alias(key), "run")
    if without is None:
        return rows
    asked = rows.select(F.col(key).alias("k"), "run").distinct().groupBy("k").agg(F.collect_set("run").alias("asked"))
    held = asked.join(without.select(F.col(key).alias("k"), F.concat(F.lit(" "), "words", F.lit(" ")).alias("hay")), "k")
    held = held.select("k", F.explode(F.filter("asked", lambda r: F.contains("hay", F.concat(F.lit(" "), r, F.lit(" "))))).alias("r"))
    return rows.join(held, (F.col(key) == F.col("k")) & (F.col("run") == F.col("r")), "left_anti")
