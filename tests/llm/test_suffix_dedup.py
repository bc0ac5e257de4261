import hashlib
import random
from collections import Counter

import pytest

from gradelake.llm import queries, suffix_dedup


def brute(texts, width):
    """(bytes, removed, spans, sha256 of what is kept) of each text."""
    starts = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if starts[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def patchwork(rng, base, n):
    texts = []
    for _ in range(n):
        t = b""
        for _ in range(rng.randint(1, 5)):
            a = rng.randrange(len(base))
            t += rng.choice([lambda: bytes(rng.choices(b"abcdefgh ", k=rng.randint(0, 300))), lambda: base[a : a + rng.randint(1, 700)], lambda: b"a" * rng.randint(0, 500), lambda: t[: rng.randint(0, 400)]])()
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed", range(25))
def test_sorting_groups_finds_each_repeated_string(seed):
    rng = random.Random(seed)
    width = rng.choice([64, 200])
    texts = patchwork(rng, bytes(rng.choices(b"abcdefgh" if seed % 2 else b"ab", k=900)), rng.randint(1, 6))
    groups = {}
    for i, s0, n, a, h in zip(*(c.tolist() for c in suffix_dedup.anchors(texts, width))):
        assert s0 <= a and n > 0
        groups.setdefault(h, []).append((i, s0, n, a))
    gone = [bytearray(len(t)) for t in texts]
    for rows in groups.values():
        for (i, s0, n, _), ranges in zip(rows, suffix_dedup.repeated([(a - s0, texts[i][s0 : s0 + n + width - 1]) for i, s0, n, a in rows], width)):
            for x, y in ranges:
                assert 0 <= x < y <= n
                gone[i][s0 + x : s0 + y + width - 1] = b"\1" * (y - x + width - 1)
    assert [sum(g) for g in gone] == [r[1] for r in brute(texts, width)]


def test_blocks_of_long_texts_overlap(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    rng = random.Random(9)
    t = bytes(rng.choices(b"abcdefgh", k=3000))
    i, s0, n, a, h = suffix_dedup.anchors([t, t[700:1900]], 200)
    for k, text in ((0, t), (1, t[700:1900])):
        mine = i == k
        assert sorted(x for s, m in zip(s0[mine].tolist(), n[mine].tolist()) for x in range(s, s + m)) == list(range(len(text) - 199))


def test_multikey_and_trie_order_strings():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=40)) + bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for _ in range(300)] + [b"ab" * 40] * 3
    order = []
    for depth, group in suffix_dedup.multikey(list(range(len(keys))), keys):
        assert len({keys[i][: min(depth, 32)] for i in group}) == 1 or len(group) == 1
        trie = suffix_dedup.BlindTrie(keys)
        for i in group:
            trie.add(i)
        whole = trie.order()
        assert sorted(whole) == sorted(group)
        order += whole
    assert [keys[i] for i in order] == sorted(keys)


def test_multikey_splits_what_follows_an_anchor():
    """All of a group begin with its anchor: sorting starts behind it, and strings that part there are still found repeated."""
    rng, gram = random.Random(4), bytes(range(100))
    keys = [gram + bytes(rng.choices(b"ab", k=60)) for _ in range(400)]
    groups = list(suffix_dedup.multikey(list(range(400)), keys, 100, 132))
    assert len(groups) > 300 and all(len({keys[i][:depth] for i in g}) == 1 for depth, g in groups)
    assert [keys[i] for i in (i for _, g in suffix_dedup.multikey(list(range(400)), keys, 100, 160) for i in g)] == sorted(keys)
    before = bytes(rng.choices(b"xyz", k=95))
    found = suffix_dedup.repeated([(95, before + gram + tail) for tail in (b"12345" + b"p" * 60, b"12345" + b"q" * 60, b"1234" + b"r" * 60)], 200)
    assert found == [[(0, 1)], [(0, 1)], []]


def test_runs_of_sorted_strings():
    rng = random.Random(5)
    keys = sorted(bytes(rng.choices(b"ab", k=rng.randint(1, 9))) for _ in range(80))
    got = {(depth, tuple(run)) for depth, run in suffix_dedup.intervals(list(range(80)), keys)}
    want = set()
    for a in range(80):
        for b in range(a + 1, 80):
            depth = min(suffix_dedup.common(keys[k], keys[k + 1]) for k in range(a, b))
            if (a == 0 or suffix_dedup.common(keys[a - 1], keys[a]) < depth) and (b == 79 or suffix_dedup.common(keys[b], keys[b + 1]) < depth):
                want.add((depth, tuple(range(a, b + 1))))
    assert got == want
    deep = [b"a" * k for k in range(3000)]  # no recursion, however deep
    assert len(list(suffix_dedup.intervals(list(range(3000)), deep))) == 2999


def run(spark, docs, **more):
    rows = suffix_dedup.remove_repeats(docs, **more).collect()
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def want(docs, width=200):
    rows = docs.collect()
    return Counter((r["doc_id"], *x) for r, x in zip(rows, brute([(r["text"] or "").encode() for r in rows], width)))


def test_query(spark, small):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op3_suffix_array_dedup(spark, small).collect())
    assert got == want(spark.read.parquet(f"{small}/documents.parquet"))


def test_odd_rows(spark, odd_docs):
    assert run(spark, odd_docs) == want(odd_docs)
    assert suffix_dedup.remove_repeats(odd_docs.limit(0)).collect() == []


def test_split_groups_and_kept_text(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = words(60)
    docs = spark.createDataFrame([(i, words(rng.randint(0, 30)) + passage + words(rng.randint(0, 30)) + "é") for i in range(60)], "doc_id long, text string")
    assert run(spark, docs, most_in_group=5) == want(docs) == run(spark, docs)
    for r in suffix_dedup.remove_repeats(docs, keep_text=True).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] and passage not in r["kept"]


def test_periodic_text_is_settled_at_once(spark):
    run_of_one, period = b"=" * 40_000, b"abc-" * 3_000
    for t in (run_of_one, period):
        i, s0, n, a, h = suffix_dedup.anchors([t], 200)
        gone, ranges = suffix_dedup.settled([t], 200, i, s0, n, a, h)
        assert (~gone).sum() <= 4 and sum(r[2] for r in ranges) >= len(t) - 400
    docs = spark.createDataFrame([(1, "=" * 5000), (2, "x" + "=" * 300 + "y"), (3, "ab" * 700 + "c"), (4, "z" * 199), (5, "q" + "ab" * 150)], "doc_id long, text string")
    assert run(spark, docs) == want(docs) == run(spark, docs, most_in_group=1)


def test_widths(spark):
    docs = spark.createDataFrame([(1, "abcdefghij" * 40), (2, "x" * 50 + "abcdefghij" * 35)], "doc_id long, text string")
    for width in (32, 33, 300, 330):
        assert run(spark, docs, width=width) == want(docs, width)
    for width in (31, 4096):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(docs, width=width)
