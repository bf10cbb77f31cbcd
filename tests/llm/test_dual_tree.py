import numpy as np
import pytest

from tallyspark.llm.dual_tree import CoverTree, search, top_k


def _brute(x, ids, asks, k):
    out = []
    for q in np.nonzero(asks)[0]:
        s = x[q] @ x.T
        best = sorted(((-int(v), int(i)) for v, i in zip(s, ids) if i != ids[q]))[:k]
        out += [(int(ids[q]), r + 1, i, -v) for r, (v, i) in enumerate(best)]
    return out


def test_radii_cover_and_clusters_are_pruned():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (40, 8))
    x = (centres[rng.integers(0, 40, 6000)] + rng.integers(-4, 5, (6000, 8))).astype(float)
    tree, stack = CoverTree(x), []
    stack.append(tree.root)
    while stack:
        n = stack.pop()
        rows = tree.order[n.lo : n.hi]
        assert n.centre in rows and np.sqrt(((x[rows] - x[n.centre]) ** 2).sum(1)).max() <= n.radius + 1e-9
        assert not n.children or sorted(r for c in n.children for r in range(c.lo, c.hi)) == list(range(n.lo, n.hi))
        stack += n.children
    ids = np.arange(6000)
    best, taken = search(x[::20], ids[::20], x, ids, 20)
    assert taken < 0.8 * 300 * 6000
    want = _brute(x, ids, ids % 20 == 0, 20)
    got = [(int(i), r + 1, int(best.id[q, r]), int(best.score[q, r])) for q, i in enumerate(ids[::20]) for r in range(20)]
    assert got == want


def test_blocks_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4) / 64], 0) for i in range(300)]  # many ties
    odd = [(400, None, 0), (420, [1.0, None, 0.0, 0.0], 0), (440, [float("nan")] * 4, 0), (460, [float("inf"), 0.0, 0.0, 0.0], 0), (None, [1.0] * 4, 0), (480, [], 0), (500, [1.0, 2.0], 0), (501, [1.0, 2.0], 0)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(d, "vec_id % 20 = 0", 20, query_block=5, block=37).collect())
    x, ids = np.array([r[1] for r in rows]) * 64, np.array([r[0] for r in rows])
    assert got == sorted(_brute(np.floor(x), ids, ids % 20 == 0, 20) + [(500, 1, 501, 64 * 64 + 128 * 128)])
    assert top_k(d.limit(0), "vec_id % 20 = 0").count() == 0


def test_repeated_rows_are_candidates_as_often_as_they_come(spark):
    d = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0]), (0, [1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(d, "vec_id = 0", 3).collect())
    assert got == [(0, 1, 1, 8192), (0, 2, 1, 8192)]


def test_a_query_number_with_two_vectors_asks_with_the_smallest(spark):
    d = spark.createDataFrame([(0, [3.0]), (0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    for block in (1, 100):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(d, "vec_id = 0", 3, query_block=block).collect())
        assert got == [(0, 1, 1, 64 * 128), (0, 2, 2, -64 * 64)]


def test_scores_that_could_be_rounded_are_refused(spark):
    d = spark.createDataFrame([(0, [1e16, 1.0]), (1, [3e15, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ArithmeticError):
        top_k(d, "vec_id = 0")
