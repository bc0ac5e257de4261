import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradelake.llm import packing, queries


def bins_of(counts, capacity, groups=20):
    p = packing.plan(dict(counts), capacity, groups=groups)
    fill, used = defaultdict(list), Counter()
    for length, start, n, per_bin, first, offset in p.runs:
        assert used[length] == start
        used[length] += n
        for r in range(n):
            fill[first + r // per_bin].append((offset + r % per_bin * length, length))
    assert used == Counter({k: v for k, v in counts.items() if v}) and set(fill) == set(range(p.bins))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return p.bins


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=20))
def test_plans_place_each_piece_once_without_gaps(counts):
    n = bins_of(counts, 64)
    assert n >= -(-sum(k * v for k, v in counts.items()) // 64)


def test_plans_are_close_to_the_bound():
    rng = random.Random(2)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6.4, 0.9)))) for _ in range(20_000))
    assert bins_of(counts, 2048, 160) <= 1.006 * sum(k * v for k, v in counts.items()) / 2048


def test_configurations_reach_a_known_optimum():
    found = packing.configurations(np.array([60, 40]), np.array([100.0, 100.0]), 100)
    assert abs(sum(x for _, x in found) - 100) < 1e-6


def check(rows, docs, path):
    tok, texts = Tokenizer.from_file(path), Counter()
    want = Counter()
    for d in docs:
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want[d["doc_id"], k // 2048, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_query_packs_all_documents(spark, small, path):
    rows = queries.op7_best_fit_packing(spark, small).collect()
    n = check(rows, spark.read.parquet(f"{small}/documents.parquet").collect(), path)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_odd_rows(spark, odd_docs, path):
    check(packing.pack(odd_docs, path).collect(), odd_docs.collect(), path)
    assert packing.pack(odd_docs.limit(0), path).collect() == []


def test_one_length_may_hold_most_rows(spark, path):
    docs = spark.createDataFrame([(i, "one two three") for i in range(700)] + [(9999, "one")], "doc_id long, text string")
    n = check(packing.pack(docs, path).collect(), docs.collect(), path)
    assert n == pytest.approx(2, abs=0)
