import numpy as np
import pytest
from wordmill.llm import embedding_dedup as ed


def brute(ids, vectors, threshold=0.95):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[k], *label[near[k]]) if near[k].any() else label[k] for k in range(len(ids))])
        if (new == label).all():
            return {i: (int(near[k].sum()), int(label[k])) for k, i in enumerate(ids)}
        label = new


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n int, links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicates(df, **kw).collect()}
    assert got == brute([i for i, _ in rows], [v for _, v in rows])


def test_real_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(spark, rows, leaf=32)


def test_recall_at_the_threshold():
    """Pairs at exactly the threshold, the hardest to keep together."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((8192, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.951 * x + np.sqrt(1 - 0.951**2) * y
    forest = ed.grow(np.concatenate([x, near]), 16_384, leaf=64)
    row_x, leaf_x = forest.leaves(x)
    row_y, leaf_y = forest.leaves(near)
    both = np.intersect1d(row_x << 32 | leaf_x, row_y << 32 | leaf_y) >> 32
    assert len(np.unique(both)) / len(x) > 0.999


def test_hot_copies_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 40)
    monkeypatch.setattr(ed.grow, "__defaults__", (ed.TREES, 16, 40, ed.SPILL, 7))
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(8)
    rows = [(i, (centre + 0.12 * rng.standard_normal(8)).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0] * 8) for i in range(100)] + [(400 + i, rng.standard_normal(8).tolist()) for i in range(60)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    check(spark, rows, leaf=16)
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e38, 0.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(df).collect()}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, None, 9))
    assert got[7] == (2, 7, True) and got[8] == got[10] == (2, 7, False)
    assert ed.near_duplicates(df.limit(0)).count() == 0


def test_trees_grow_with_the_table():
    """Leaves of a table far larger than the sample stay small."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ed.grow(x[:1000], len(x), trees=1, leaf=32)
    _, leaf = forest.leaves(x)
    assert forest.depth == 11 and np.bincount(leaf).max() < len(x) / 16


def test_near_copies_are_not_copied_at_every_split():
    rng = np.random.default_rng(4)
    x = np.ones(32) + 1e-4 * rng.standard_normal((4096, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, _ = ed.grow(x, len(x)).leaves(x)
    assert len(row) < 2 * ed.TREES * len(x)


def test_leaves_do_not_depend_on_the_batch():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ed.grow(x, len(x), leaf=16)
    whole = sorted(zip(*(c.tolist() for c in forest.leaves(x)), strict=True))
    parts = [(i + k, leaf) for i in range(0, 3000, 7) for k, leaf in zip(*(c.tolist() for c in forest.leaves(x[i : i + 7])), strict=True)]
    assert whole == sorted(parts)


def test_rounds_nodes_and_leaves_that_travel_alone(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 40)
    monkeypatch.setattr(ed, "ROUND", 1)
    monkeypatch.setattr(ed, "PAIRS", 50)
    monkeypatch.setattr(ed.grow, "__defaults__", (ed.TREES, 16, 40, ed.SPILL, 7))
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 16))
    x[:200] = x[200] + 0.01 * rng.standard_normal((200, 16))  # near copies: one leaf of several blocks
    x[300:400] = x[400:500] + 0.2 * rng.standard_normal((100, 16))
    x = x.astype(np.float32)
    unit = ed.unit_rows(x)
    forest = ed.grow(unit, len(x), leaf=16)
    plan = ed.deal(forest, unit, len(x), 16 * 4 + 16)
    assert plan.rounds > 1 and 0 < plan.top < forest.depth and plan.hot.any() and not plan.hot.all()
    check(spark, list(zip(rng.permutation(600).tolist(), x.tolist(), strict=True)), leaf=16)


@pytest.mark.parametrize("n", [1, 50])
def test_spanning(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, n, 3 * n), rng.integers(0, n, 3 * n)

    def labels(pairs):
        out = list(range(n))
        for x, y in pairs:
            old, new = max(out[x], out[y]), min(out[x], out[y])
            out = [new if v == old else v for v in out]
        return out

    used = ed.spanning(a, b, n)
    assert labels(zip(a[used], b[used], strict=True)) == labels(zip(a, b, strict=True))
    assert len(used) == n - len(set(labels(zip(a, b, strict=True))))
