import re
from collections import Counter, defaultdict

from gradelake.llm import line_quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def frequent_words(rows, least=10, share=0.02):
    lines_of = lambda t: [" ".join(x.split(" ")).strip(" ") for x in re.sub(r"[ \x09\x0B-\x0D]+", " ", t or "").lower().split("\n")]
    texts = defaultdict(list)
    for r in rows:
        texts[r["source"]].append(r["text"] or "")
    count = Counter((s, x) for s, ts in texts.items() for t in ts for x in {*lines_of(t)} if x)
    gone = {k for k, n in count.items() if n > least and n > share * len(texts[k[0]])}
    return [sum(len(x.split(" ")) for x in lines_of(r["text"]) if x and (r["source"], x) in gone) for r in rows]


def check(got, rows, least=10, share=0.02):
    want = Counter()
    for r, gone in zip(rows, frequent_words(rows, least, share)):
        b = base(r["text"])
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want[(r["doc_id"], *b, failed, not failed and gone <= 0.5 * b[0], gone)] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")
    assert Counter(tuple(r[c] for c in names) for r in got) == want


def test_query(spark, small):
    check(queries.op9_quality_rules(spark, small).collect(), spark.read.parquet(f"{small}/documents.parquet").collect())


def test_odd_rows(spark, odd_docs):
    check(line_quality.judge(odd_docs).collect(), odd_docs.collect())
    assert line_quality.judge(odd_docs.limit(0)).collect() == []


def test_frequent_lines_and_depleted_documents(spark, words):
    common = [" ".join(words[k : k + 30]) for k in (0, 40)]
    texts = ["\n".join([*common[: i % 3], " ".join(words[i : i + (20 if i % 2 else 90)]) + f" {i}"]) for i in range(90)]
    docs = spark.createDataFrame([(i, t, "h" if i % 4 else "g") for i, t in enumerate(texts)] + [(1000 + i, texts[1], "h") for i in range(50)], "doc_id long, text string, source string")
    got = line_quality.judge(docs).collect()
    check(got, docs.collect())
    assert any(not r["kept"] and not r["base_failed"] for r in got) and any(r["kept"] and r["n_frequent_words"] for r in got)


def test_repeats_and_spaces(spark):
    texts = ["a b c a b c", "a a a a", "x\x0by\x0cz x y z", "one two", "a b c d a b c e a b c", " 　nbsp stays\n\nline\n line\nline ", "p q r " * 4000, "#*$%&|<>"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    check(line_quality.judge(docs).collect(), docs.collect())


def test_plan_is_native(spark, odd_docs):
    plan = line_quality.judge(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
