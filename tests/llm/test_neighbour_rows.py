"""Nearest neighbours where ids repeat, and deep trees, against brute force."""

import numpy as np

from stratasize.llm import neighbours


def test_rows_that_share_an_id(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (60, 6)).astype(float)
    x[(x == 0).all(axis=1)] = 1.0
    ids = [i // 2 * 2 for i in range(60)]
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    schema = "vec_id long, embedding array<double>, q long, v array<double>, shard int, leaf int"
    docs = spark.createDataFrame([(i, v, 1, [2.0], 3, 4) for i, v in rows + rows[:6]], schema)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(docs, every=4, k=5, leaf_rows=8, search_share=8.0).collect())
    one, want = sorted({(i, tuple(v)) for i, v in rows}), []
    for i, v in one:
        if i % 4 == 0:
            others = sorted((-float(np.dot(v, w)), j) for j, w in one if (j, w) != (i, v))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(others)]
    assert got == sorted(want)


def test_deep_trees_share_normals():
    x = np.random.default_rng(3).standard_normal((20_000, 8))
    forest = neighbours.fit_forest(x, 2, 12)
    assert forest.normals.shape == (2, 2**9 - 1 + 3, 8) and forest.thresholds.shape == (2, 2**12 - 1)
    leaves = forest.leaves(x)
    sizes = np.stack([np.bincount(own, minlength=2**12) for own in leaves])
    assert sizes.max() < 40
    others = np.random.default_rng(4).standard_normal((50, 8))  # no threshold is one of their projections
    found, leaves = forest.search(others, sizes.tolist(), 400), forest.leaves(others)
    for i, own in enumerate(found):  # each row's own leaves come first
        assert {(t, int(leaves[t, i])) for t in range(2)} == set(own[:2])
