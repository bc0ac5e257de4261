import random
from collections import Counter

import numpy as np

from gradelake.llm import near_vectors


def brute(rows, threshold=0.93):
    """n_links, component and kept of (id, vector, label) rows, as counted rows."""
    unit = []
    for i, v, g in rows:
        x = None if i is None or g is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, float)
        unit.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    n = len(rows)
    link = [[a != b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and rows[a][2] == rows[b][2] and float(unit[a] @ unit[b]) >= threshold for b in range(n)] for a in range(n)]
    root = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(n):
                if (link[a][b] or (rows[a][0] == rows[b][0] and unit[a] is not None and unit[b] is not None)) and root[b] < root[a]:
                    root[a], changed = root[b], True
    return Counter((rows[a][0], sum(link[a]), root[a], rows[a][0] is None or rows[a][0] == root[a]) for a in range(n))


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n long, cell int")
    return Counter(tuple(r) for r in near_vectors.range_join(df, **more).select("vec_id", "n_links", "component_id", "kept").collect())


def test_against_brute_force_in_many_cells_and_tiles(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), [float(np.float32(c)) for c in centres[i % 6] + rng.normal(size=8) * rng.choice([0.05, 0.4, 2])], int(i % 2)) for i in rng.permutation(240)]
    want = brute(rows)
    assert sum(k[1] for k in want) > 100
    assert run(spark, rows, per_pivot=20, tile=16) == want
    assert run(spark, rows) == want


def test_a_vector_goes_to_no_more_tiles_than_its_group_has_blocks(spark):
    """Cells of random vectors see each other all: tiles of the square of a cell's blocks would take ten times as many rows."""
    every = list(range(6))
    rows = [(1, i, 1, [1.0], [i % 6, *(c for c in every if c != i % 6)]) for i in range(1200)]
    placed = spark.createDataFrame(rows, "label int, rep long, n long, embedding array<float>, cells array<int>")
    tiles = near_vectors._tiles(placed, 50)
    assert tiles.count() == 1200 * 24
    pairs = tiles.groupBy("i", "j").count().collect()
    assert len(pairs) == 24 * 25 // 2 and sum(r["i"] == r["j"] for r in pairs) == 24


def test_copies_and_chains(spark):
    angle = lambda d: [float(np.cos(d)), float(np.sin(d))]
    rows = [(i, angle(0.3 * i), 1) for i in range(8)] + [(100 + i, [1.0, 0.0], 1) for i in range(30)]
    rows = [(i, [float(np.float32(c)) for c in v], g) for i, v, g in rows]
    assert run(spark, rows, tile=4) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0),
        (9, [None, 1.0], 0), (None, [1.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1e30, 0.0], 0), (12, [1e-30, 0.0], 0), (13, [-1.0, 0.0], 0), (14, [-0.0, 1.0], 0), (15, [0.0, 1.0], 0),
    ]
    assert run(spark, rows) == brute(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors.range_join(empty).collect() == []


def test_components(spark):
    from gradelake.llm.common import components

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(7, None), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {k: find(k) for k in root}
