import itertools
import random
from collections import Counter, defaultdict

from gradelake.llm import order_minhash as M
from gradelake.llm import queries


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(max(1, len(w)))
        if k >= len(w):
            return w
        w[k : k + 1] = rng.choice([[], ["new" + str(k)], [w[k], "in" + str(k)]])
    return w


def test_banded_alignment_is_the_edit_distance():
    rng = random.Random(3)
    for t in range(500):
        a = [rng.choice("abcdef" * (1 + t % 3)) for _ in range(rng.choice([0, 1, 7, 40, 400]) if t % 25 == 0 else rng.randint(0, 50))]
        b = changed(rng, a, rng.randint(0, 12)) if a else [rng.choice("ab") for _ in range(t % 5)]
        d = edit(a, b)
        for limit in (0, 2, 8, 60):
            assert M.distance(a, b, limit) == (d if d <= limit else None)
        assert M.bounded_distance(a, b, 3, 15) == (d if d <= 15 else None)
        assert sum(abs(x - y) for x, y in zip(M.bins(a), M.bins(b))) / 2 <= d


def test_sketches_keep_order_and_occurrence(words):
    w = words[:60]
    assert M.sketches(w) == M.sketches(list(w)) and len(M.sketches(w)) == 20 and M.sketches([]) == []
    assert len(set(M.sketches(w)) & set(M.sketches(w[30:] + w[:30]))) < 8  # much the same k-mers in another order
    assert M.sketches(["a"] * 9) != M.sketches(["a"] * 30)
    assert len(set(M.sketches(["one", "two"])) & set(M.sketches(["one", "two", "x"]))) == 0


def test_pairs_of_high_similarity_meet(words):
    rng, missed, seen = random.Random(8), 0, 0
    for _ in range(200):
        a = [rng.choice(words) for _ in range(200)]
        b = changed(rng, a, 4)
        x, y = ({*zip(*(w[k:] for k in range(5)))} for w in (a, b))
        if len(x & y) / len(x | y) >= 0.8:
            seen += 1
            missed += not set(M.sketches(a)) & set(M.sketches(b))
    assert seen > 100 and missed == 0


def components(rows):
    """Least ids by brute force: texts link if a sketch agrees and the edit similarity is 0.8."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[" ".join((t or "").lower().split())].append(i)
    keys = list(texts)
    words = {k: k.split() for k in keys}
    sk = {k: set(M.sketches(words[k])) for k in keys}
    root = {k: k for k in keys}
    find = lambda k: k if root[k] == k else find(root[k])
    links = Counter()
    for a, b in itertools.combinations(keys, 2):
        n = max(len(words[a]), len(words[b]))
        if sk[a] & sk[b] and M.bounded_distance(words[a], words[b], n, int(0.2 * n + 1e-9)) is not None:
            root[find(b)] = find(a)
            links[a] += 1
    least = defaultdict(list)
    for k in keys:
        least[find(k)] += texts[k]
    return Counter((i, min((x for x in least[find(" ".join((t or "").lower().split()))] if x is not None), default=None)) for i, t in rows)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, c string, s long")
    return M.classes(df, **more)


def test_classes_against_brute_force(spark, words):
    rng = random.Random(6)
    rows = []
    for g in range(12):
        a = [rng.choice(words) for _ in range(rng.choice([12, 80, 200]))]
        rows.append((len(rows), " ".join(a)))
        for _ in range(g % 5):
            a = changed(rng, a, rng.choice([0, 1, 2, 5]))  # chains: each near the one before
            rows.append((len(rows), "  ".join(a).title()))
    rng.shuffle(rows)
    got = run(spark, rows).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == components(rows)
    assert {r["doc_id"] for r in got if r["kept"]} == {r["class_id"] for r in got}


def test_links_past_the_leader(spark, words):
    """l - x - y where x is near both and l and y are not near each other, and a second round's leader."""
    rng = random.Random(12)
    core = [rng.choice(words) for _ in range(100)]
    front, back = [f"f{i}" for i in range(20)], [f"b{i}" for i in range(20)]
    rows = [(1, " ".join(front + core)), (2, " ".join(core)), (3, " ".join(core + back)), (4, " ".join(core + back + ["z"]))]
    for rounds in (1, 2, 3):
        assert Counter((r["doc_id"], r["class_id"]) for r in run(spark, rows, rounds=rounds, minima=1).collect()) == Counter({(i, 1): 1 for i in range(1, 5)})


def test_odd_rows(spark, odd_docs):
    rows = M.classes(odd_docs, carry=("source", "rank")).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in rows) == components([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert M.classes(odd_docs.limit(0)).collect() == []


def test_query_misses_no_near_copy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_minhash_near_dedup(spark, small).collect()}
    grams = {d["doc_id"]: {*zip(*(d["text"].lower().split()[k:] for k in range(5)))} for d in docs}
    pairs = [(a, b) for a, b in itertools.combinations(grams, 2) if grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    assert pairs and all(got[a] == got[b] for a, b in pairs)


def test_short_texts_miss_no_near_copy(spark, words):
    """All pairs of short texts with J >= 0.8 and an edit similarity of 0.8 are of one class, whether or not a sketch agrees."""
    rng, rows = random.Random(21), []
    for g in range(60):
        a = [f"{rng.choice(words)}{g}" for _ in range(8 + g % 30)]
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(a + ["end"] if g < 30 else [*a[:-1], "end"]))]
    got = {r["doc_id"]: r["class_id"] for r in run(spark, rows).collect()}
    grams = {i: Counter(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    near = [(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if (grams[i] & grams[j]).total() >= 0.8 * (grams[i] | grams[j]).total() and edit(a.split(), b.split()) <= 0.2 * max(len(a.split()), len(b.split())) + 1e-9]
    apart = [(i, j) for i, j in near if not set(M.sketches(rows[i][1].split())) & set(M.sketches(rows[j][1].split()))]
    assert len(near) > 40 and apart and all(got[i] == got[j] for i, j in near)
    assert all(got[i] // 2 == i // 2 for i in got)  # and no others are joined


def test_texts_around_one_passage(spark, words):
    """Many texts of which sketches agree though they don't link, and near copies among them that no leader shows."""
    rng, rows = random.Random(31), []
    passage = [rng.choice(words) for _ in range(60)]
    for g in range(40):
        own = [f"{rng.choice(words)}{rng.randrange(60)}" for _ in range(30)]
        rows.append((3 * g, " ".join(own[:15] + passage + own[15:])))
        if g % 4 == 0:
            rows.append((3 * g + 1, " ".join(own[:15] + passage + changed(rng, own[15:], 1))))
    want = components(rows)
    assert len({c for _, c in want}) < len(rows)
    for rounds in (1, 2):
        assert Counter((r["doc_id"], r["class_id"]) for r in run(spark, rows, rounds=rounds).collect()) == want


def test_recall_on_what_is_promised(spark, words):
    """Long texts with any share of words changed: all pairs with J >= 0.8 that alignment links are found, against alignments of all pairs."""
    rng, rows = random.Random(41), []
    for g in range(120):
        a = [f"{rng.choice(words)}{g % 7}" for _ in range(rng.randint(100, 400))]
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(changed(rng, a, 1 + g * len(a) // 2400)))]
    got = {r["doc_id"]: r["class_id"] for r in run(spark, rows).collect()}
    split = {i: t.split() for i, t in rows}
    grams = {i: Counter(zip(*(w[k:] for k in range(5)))) for i, w in split.items()}
    near = [(i, j) for i, j in itertools.combinations(split, 2) if (grams[i] & grams[j]).total() >= 0.8 * (grams[i] | grams[j]).total() and edit(split[i], split[j]) <= 0.2 * max(len(split[i]), len(split[j])) + 1e-9]
    assert len(near) > 30 and sum(got[i] == got[j] for i, j in near) >= 0.99 * len(near)
    assert all(got[i] // 2 == i // 2 for i in got)
