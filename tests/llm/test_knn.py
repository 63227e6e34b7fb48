import math
import random

import numpy as np
import pytest

from codestrata.llm import knn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in fine if i % 20 == 0}:
        score = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(score)[:k], 1)]
    return sorted(out)


def run(spark, rows, **kw):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(tuple(x) for x in knn.top_k(table, table.filter("vec_id % 20 = 0"), **kw).collect())


@pytest.mark.parametrize(("block", "group"), ((4096, 2048), (60, 3)))
def test_equals_all_scores(spark, block, group):
    r = random.Random(10)
    centre = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + r.gauss(0, 0.05))) for x in r.choice(centre)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(50)]  # ties
    rows += [(900, None), (920, [None] * 8), (940, [float("nan")] + [0.0] * 7), (960, [float("inf")] * 8), (None, [1.0] * 8), (980, [1.0, 2.0])]
    assert run(spark, rows, block=block, group=group) == plain(rows, 20)


def test_few_candidates_empty_tables_and_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0])]
    assert run(spark, rows) == plain(rows, 20) and len(plain(rows, 20)) == 2
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, []) == []


def test_components_of_any_size(spark):
    """Scores as of Python's whole numbers, within the range of a long."""
    r = random.Random(12)
    sizes = (1.0, 1e3, 1e6, 1e9, 1e12)
    rows = [(i, [r.gauss(0, 1) * r.choice(sizes) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [1e17 * (1 + i % 3), -1e17, float(i)]) for i in range(45)] + [(300, [1.7e308, 1.0]), (301, [-1e308, 5.0]), (302, [1e-300, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in knn.top_k(table, table.filter("vec_id % 20 = 0"), block=50, group=3).collect())
    whole = [(i, [math.floor(64 * x) if math.isfinite(64 * x) else int(math.copysign(1.7976931348623157e308, x)) for x in v]) for i, v in rows]
    want = []
    for q, v in whole:
        if q % 20 == 0:
            clip = lambda s: min(max(s, -(1 << 63) + 1), (1 << 63) - 1)
            score = sorted((-clip(sum(a * b for a, b in zip(v, w))), i) for i, w in whole if i != q)
            want += [(q, n, i, -s) for n, (s, i) in enumerate(score[:20], 1)]
    assert got == sorted(want)


def test_sums_beyond_doubles(spark):
    """4,096 dimensions of components below 2**22: products add up beyond 2**53, with ties of near scores."""
    r = random.Random(13)
    rows = [(i, [float(r.randrange(-(1 << 15), 1 << 15)) + r.choice((0.0, 0.25)) for _ in range(4096)]) for i in range(25)]
    rows += [(40, [65535.0] * 4096), (41, [65535.0] * 4095 + [65534.984375]), (42, [65535.0] * 4096), (43, [65534.984375] * 4096)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in knn.top_k(table, table.filter("vec_id % 20 = 0")).collect())
    assert got == plain(rows, 20)


def test_clusters_are_pruned():
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16)) * 64
    points = np.floor(np.repeat(centres, 100, 0) + r.normal(size=(2000, 16)))
    tree, ids = knn.CoverTree(points), np.arange(2000)
    queries = knn.CoverTree(points[::20])
    best = knn.Best(ids[::20][queries.order], np.full(100, knn._NONE), 20)
    assert knn.search(queries, tree, ids[tree.order], best) < 0.5 * 100 * 2000


def test_cover_tree_invariants():
    points = np.random.default_rng(2).normal(size=(1500, 3)) * 50
    tree = knn.CoverTree(points)
    assert sorted(tree.order) == list(range(1500))
    for node, children in enumerate(tree.children):
        own = tree.points[tree.first[node]:tree.end[node]]
        away = np.sqrt(((own - tree.centre[node]) ** 2).sum(1))
        assert away.max() <= tree.radius[node] + 1e-9
        if children:
            assert sum(tree.end[c] - tree.first[c] for c in children) == len(own)
            assert any((tree.centre[c] == tree.centre[node]).all() for c in children)
            gaps = [np.linalg.norm(tree.centre[a] - tree.centre[b]) for a in children for b in children if a < b]
            assert min(gaps, default=np.inf) > tree.radius[node] / 2
