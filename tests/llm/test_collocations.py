import random
import re
from collections import Counter

import duckdb
import numpy as np

from gradelake.llm import collocations, queries

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, first):
    """Rows of (lang, text) by their definition."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    candidates = {g: a for g, a in f.items() if a >= least and len(g) > 2}
    inside = Counter()
    for (lang, *g), a in candidates.items():
        for k in range(1, len(g)):
            for i in range(len(g) - k + 1):
                inside[lang, *g[i : i + k]] = max(inside[lang, *g[i : i + k]], a)
    for (lang, *g), a in candidates.items():
        if inside[lang, *g] < a:
            cuts = [(f[lang, *g[:k]], f[lang, *g[k:]], k) for k in range(1, len(g))]
            score, _, left, right = min((1000 * a * total[lang] // (x * y), k, x, y) for x, y, k in cuts)
            out.append((lang, -score, -a, " ".join(g).encode(), left, right))
    ranks, rows = Counter(), set()
    for lang, score, a, phrase, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= first:
            rows.add((lang, ranks[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return rows


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_intervals_are_all_n_grams():
    rng = np.random.default_rng(4)
    symbols = np.r_[0, rng.integers(0, 6, 3000), 0].astype(np.uint32)
    symbols = np.unique(symbols, return_inverse=True)[1].astype(np.uint32)
    text = np.r_[symbols, symbols[:8]].tolist()
    made = collocations.Intervals(collocations.index(symbols))
    names = [(s,) for s in range(6)]
    for depth in range(1, 6):
        if depth > 1:
            a, b = made.deeper()
            names = [(*names[x], names[y][-1]) for x, y in zip(a, b)]
            assert all(n[1:] == before[y] for n, y in zip(names, b))
        assert dict(zip(names, made.sizes())) == Counter(tuple(text[i : i + depth]) for i in range(len(symbols)))
        before = names


def corpus(rng, n):
    words = ["The", "of", "a", "B", "é", "new", "york", "É", "x y", "\x1c"]
    join = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]
    text = lambda k: "".join(rng.choice(words) + rng.choice(join) for _ in range(k)) + "new york city hall"
    return [(rng.choice(["en", "en", None, "fr"]), text(rng.randrange(60)), k) for k in range(n)]


def test_many_small_shards(spark, monkeypatch):
    rows = corpus(random.Random(6), 300)
    df = spark.createDataFrame(rows, "lang string, text string, doc_id long").repartition(5)
    for size, whole in ((collocations.SHARD_WORDS, collocations.ALL_OPEN), (150, 400)):
        monkeypatch.setattr(collocations, "SHARD_WORDS", size)
        monkeypatch.setattr(collocations, "ALL_OPEN", whole)
        got = found(collocations.collocations(df, least=3, first=150))
        assert got == brute([r[:2] for r in rows], 3, 150)
    assert {r[0] for r in got} == {"en", "fr", "und"} and {r[2].count(" ") for r in got} == {1, 2, 3, 4}


def test_query_is_what_counting_gives(spark, small):
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = found(queries.op11_phrase_collocations(spark, small))
    assert got == brute(docs, 100, 2000)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    assert set(con.sql(f"select {', '.join(COLUMNS)} from ({collocations.ORACLE})").fetchall()) == got


def test_odd_rows(spark, odd_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert found(collocations.collocations(odd_docs, least=2, first=500)) == brute(rows, 2, 500)
    assert collocations.collocations(odd_docs.limit(0)).collect() == []
    solid = spark.createDataFrame([("en", "x" * 500_000), ("en", " ".join("ab" * 100_000))], "lang string, text string")
    assert found(collocations.collocations(solid, least=1000)) == brute([tuple(r) for r in solid.collect()], 1000, 2000)


def test_products_beyond_64_bits(spark, monkeypatch):
    level = [("en", ["p", "q"], 10**11, [10**12, 10**11], [3 * 10**11, 10**11], False)]
    every = spark.createDataFrame(level, "lang string, words array<string>, n long, starts array<long>, ends array<long>, extended boolean")
    total = spark.createDataFrame([("en", 10**13)], "lang string, n_words long")
    monkeypatch.setattr(collocations, "phrases", lambda *_: (every, total))
    assert found(collocations.collocations(None)) == {("en", 1, "p q", 10**11, 10**12, 3 * 10**11, 10**13, 1000 * 10**24 // (3 * 10**23))}
