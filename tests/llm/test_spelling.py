import random
import re
import zlib
from collections import Counter

from gradelake.llm import queries, spelling


def brute(rows, least_chars=6, least_n=5, ratio=5, loses_one=None):
    """Words of (id, text) rows by their definition: neighbours by trying every edit of every word."""
    count = Counter()
    for name, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if name is None else name}:{w}".encode())
            if loses_one and h % loses_one == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_chars and n >= least_n}
    letters = sorted({c for w in words for c in w})
    near, form = {}, {}
    for w, n in words.items():
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        made |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = [v for v in made if v in words and v != w]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    root = lambda w: root(form[w]) if form[w] else w
    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_is_what_trying_every_edit_gives(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute(docs, loses_one=199)
    assert found(queries.op13_spelling_variants(spark, small)) == want and sum(r[4] for r in want) > 20


def test_dense_neighbourhoods_in_many_parts(spark, monkeypatch):
    """Short alphabets, runs of one letter, words that are prefixes of others, chains of forms; parts of a few words."""
    monkeypatch.setattr(spelling, "WORDS_IN_PART", 9)
    rng = random.Random(3)
    texts = []
    for k in range(400):
        w = "".join(rng.choice("abÿ") for _ in range(rng.choice((2, 3, 4, 5, 6, 9))))
        texts.append((k, " ".join([w] * int(5 ** rng.uniform(0, 3)))))
    texts += [(900, "book " * 3 + "boook " * 20 + "bok " * 120 + "BOK boooook " + "É" * 5 + " " + "é" * 6)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want = brute(texts, least_chars=2, least_n=1)
    assert found(spelling.variants(df, least_chars=2, least_n=1)) == want
    assert max(r[4] for r in want) >= 10 and any(r[1] and r[1] != r[2] for r in want)


def test_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for loses_one in (None, 7):
        got = found(spelling.variants(odd_docs, least_chars=3, least_n=2, loses_one=loses_one))
        assert got == brute(rows, least_chars=3, least_n=2, loses_one=loses_one)
    assert spelling.variants(odd_docs.limit(0)).collect() == []
    long = spark.createDataFrame([(k, "x" * 50_000 + "y" * (k % 2)) for k in range(12)], "doc_id long, text string")
    assert {r[4] for r in found(spelling.variants(long))} == {1}


def test_shared():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))
        assert spelling.shared(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
