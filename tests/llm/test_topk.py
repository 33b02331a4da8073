"""Top-k search against brute force."""

import math
import random

import numpy as np
import pytest

from bandscan.llm.topk import Search, Tree, cover_tree, top_k


def brute(rows, k, every, scale=64):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[(i, tuple(math.floor(scale * x) for x in v))] = None
    out = []
    for q, v in ok:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread,block", [(0.0, 8192), (0.02, 60)])
def test_matches_brute_force(spark, spread, block):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.2) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(centres)] if i % 3 else [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    rows += [(1000, None), (1020, [0.1, None]), (1040, [float("nan")]), (1060, [float("inf"), 1.0]), (1080, []), (1100, [0.5]), (0, rows[0][1]), (None, [0.1])]
    got = top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int"), k=7, candidate_block=block, query_block=20)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == brute(rows, 7, 20)


def test_few_and_none(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 64 * 128)]


def checked_tree(points):
    """Nodes cover their points, children part them and are centred on them, apart by more than the shrunk radius."""
    order, nodes = cover_tree(points)
    tree, depth = Tree(points[order], nodes), {0: 1}
    assert sorted(order) == list(range(len(points)))
    for n in range(len(nodes)):
        here = tree.points[tree.lo[n] : tree.hi[n]]
        assert tree.lo[n] <= tree.centre[n] < tree.hi[n]
        assert (np.linalg.norm(here - tree.points[tree.centre[n]], axis=1) <= tree.radius[n] + 1e-9).all()
        kids = range(tree.first[n], tree.first[n] + tree.children[n])
        if tree.children[n]:
            assert tree.lo[kids[0]] == tree.lo[n] and tree.hi[kids[-1]] == tree.hi[n]
            assert all(tree.hi[x] == tree.lo[x + 1] for x in kids[:-1]) and len(kids) > 1
            assert any(tree.centre[x] == tree.centre[n] for x in kids)
            assert all(tree.radius[x] <= tree.radius[n] / 1.3 + 1e-6 for x in kids)
            some = tree.points[tree.centre[list(kids)]][:50]
            gaps = np.linalg.norm(some[:, None] - some[None], axis=2)[~np.eye(len(some), dtype=bool)]
            assert gaps.min() > tree.radius[n] / 1.3 * (1 - 1e-9)
        depth |= {x: depth[n] + 1 for x in kids}
    return tree, max(depth.values())


def test_tree_covers():
    rng = np.random.default_rng(1)
    assert checked_tree(rng.normal(size=(2000, 2)))[1] > 8
    assert checked_tree(np.repeat(rng.normal(size=(3, 2)), 50, axis=0))[1] >= 2
    assert checked_tree(rng.normal(size=(1500, 64)))[1] >= 2


@pytest.mark.parametrize("table", ["sf0.1"])
def test_pairs_are_pruned_on_the_given_vectors(table):
    import pyarrow.parquet as pq

    x = np.floor(64 * np.array(pq.read_table(f"/root/testdata/{table}/embeddings.parquet")["embedding"].to_pylist(), float)).astype(np.int64)
    tree, _ = checked_tree(x)
    queries, _ = checked_tree(x[::20])
    search = Search(queries, np.full(len(queries.points), np.iinfo(np.int64).min), 21)
    found = search.run(tree, np.arange(len(x)))
    search = Search(queries, np.array([s[-1] for s, _ in found]), 21)
    assert all(sorted(s) == sorted(t) for (s, _), (t, _) in zip(found, search.run(tree, np.arange(len(x)))))
    print("nodes", len(tree.radius), "pairs", search.tried, "pruned", search.pruned)
    assert len(tree.radius) > 1 and search.pruned > 0


def test_far_clusters_are_given_up():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 200
    x = np.floor(np.concatenate([c + rng.normal(size=(100, 16)) * 4 for c in centres])).astype(np.int64)
    tree, _ = checked_tree(x)
    queries, _ = checked_tree(x[::20])
    search = Search(queries, np.full(len(queries.points), np.iinfo(np.int64).min), 21)
    found = search.run(tree, np.arange(len(x)))
    full = queries.exact @ tree.exact.T
    assert all(sorted(s)[::-1] == sorted(row)[::-1][:21] for (s, _), row in zip(found, full))
    assert search.pruned > 0 and search.tried < 0.1 * full.size


def test_equal_ids_with_different_vectors(spark):
    rows = [(0, [1.0]), (0, [2.0]), (0, [-1.0]), (1, [1.0]), (2, [0.5]), (3, [0.25])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 128 * 64), (0, 2, 1, 64 * 64)]
