import zlib
from collections import Counter, defaultdict

from gradelake.llm import queries, sharding


def check(rows, docs, n):
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(docs) and max(sizes.values()) - min(sizes.get(k, 0) for k in range(n)) <= 1 and set(sizes) <= set(range(n))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    raw = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d["doc_id"], len(raw(d["text"])) + 1, zlib.crc32(raw(d["text"]))) for d in docs)


def test_query_and_mixture(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = queries.op8_sharding(spark, small).collect()
    check(rows, docs, 16)
    source = {d["doc_id"]: d["source"] for d in docs}
    per = Counter((r["shard"], source[r["doc_id"]]) for r in rows)
    for s, n in Counter(source.values()).items():
        assert all(abs(per[k, s] - n / 16) <= 2 for k in range(16))


def test_brute_force_order(spark):
    import hashlib

    docs = [(i, f"t{i % 7}", "big" if i % 3 else f"s{i % 5}") for i in range(500)]
    got = sharding.shards(spark.createDataFrame(docs, "doc_id long, text string, source string"), 7, rows_per_part=4).collect()
    h = lambda d: hashlib.md5(f"shard-1:{d[0]}:{zlib.crc32(d[1].encode())}".encode()).hexdigest()
    by = defaultdict(list)
    for d in docs:
        by[d[2]].append(d)
    phase = lambda s: (int(hashlib.md5(f"shard-1:={s}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    line = sorted(((k + phase(s)) / len(v), s, h(d), d[0]) for s, v in by.items() for k, d in enumerate(sorted(v, key=h)))
    want, low, extra, at = {}, *divmod(len(docs), 7), 0
    for shard in range(7):
        for slot in range(low + (shard < extra)):
            want[line[at][3]] = (shard, slot)
            at += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want


def test_sources_of_one_row_lie_all_over(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i}") for i in range(1600)], "doc_id long, text string, source string")
    rows = sharding.shards(docs, 16, rows_per_part=25).collect()
    check(rows, docs.collect(), 16)
    near = [r["shard"] for r in rows if r["doc_id"] < 400]
    assert all(8 <= near.count(k) <= 45 for k in range(16))


def test_odd_rows(spark, odd_docs):
    check(sharding.shards(odd_docs, 4).collect(), odd_docs.collect(), 4)
    assert sharding.shards(odd_docs.limit(0)).collect() == []


def test_plan_is_native(spark, odd_docs):
    plan = sharding.shards(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
