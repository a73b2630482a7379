"""Dual-tree rounds against plain ones."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import centroid_clusters


def brute(rows, dims, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, [min(max(c, -(2**25)), 2**25) for c in v]) for i, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, to, strict=True) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    to = assign()
    inertia = Counter()
    for d, n in to:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, to, strict=True))


def found(spark, rows, dims, **sizes):
    frame = spark.createDataFrame([(i, v, "c", "c") for i, v in rows], "vec_id long, embedding array<float>, x string, cluster string").repartition(3)
    return Counter(tuple(r) for r in centroid_clusters.cluster(spark, frame, dims=dims, **sizes).collect())


def f32(v):
    return [None if c is None else float(np.float32(c)) for c in v]


@pytest.mark.parametrize("sizes", [{"shard_rows": 40, "leaf_rows": 3}, {}])
def test_clusters_against_brute_force(spark, sizes):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, f32([c + rng.gauss(0, 0.2) for c in rng.choice(centres)])) for i in range(200)]
    rows += [(500 + i, f32([0.5, 0, -0.5, 1, 1])) for i in range(80)] + [(3, f32([1] * 5)), (3, f32([1] * 5)), (3, f32([2] * 5)), (None, f32([0.1] * 5))]
    rows += [(600, None), (601, []), (602, [1.0] * 4), (603, [float("nan")] * 5), (604, [1.0, None, 1.0, 1.0, 1.0]), (605, [float("inf")] * 5)]
    assert found(spark, rows, 5, **sizes) == brute(rows, 5)


def test_ties_equal_centroids_and_far_vectors(spark):
    grid = [(i, f32([i % 4 / 1024, i // 4 % 4 / 1024])) for i in range(64)]  # every place four times: equal and empty centroids, ties
    assert found(spark, grid, 2, shard_rows=10, leaf_rows=1) == brute(grid, 2)
    far = [(i, f32([x, -x])) for i, x in enumerate([0, 1, 5e3, 2.5e4, 1e30, -1e30, 3, 4, 7, 9, 1e4])]
    assert found(spark, far, 2) == brute(far, 2)
    assert found(spark, [(1, [1.0, 2.0])], 2) == brute([(1, [1.0, 2.0])], 2) and not found(spark, [], 2)


def test_cover_tree_invariants_and_whole_nodes():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(600, 4)) * 20 + np.repeat(rng.normal(size=(6, 4)) * 3000, 100, axis=0)).astype(np.int64)
    tree = centroid_clusters.CoverTree(x, 4)
    assert sorted(tree.order.tolist()) == list(range(600))

    def below(at):
        if not tree.children[at]:
            return tree.order[slice(*tree.span[at])].tolist()
        return [r for c in range(tree.first[at], tree.first[at] + tree.children[at]) for r in below(c)]

    for at, centre in enumerate(tree.centre):
        rows = below(at)
        d = np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))
        assert d.max() <= tree.radius[at] + 1e-9 and tree.n[at] == len(rows) and (tree.sums[at] == x[rows].sum(axis=0)).all()
        kids = [tree.centre[c] for c in range(tree.first[at], tree.first[at] + tree.children[at])]
        apart = [((x[a] - x[b]) ** 2).sum() ** 0.5 for i, a in enumerate(kids) for b in kids[:i]]
        assert not apart or min(apart) > tree.radius[at] / 2 - 1e-9
    arrays = {"x": x[tree.order], "centre": x[tree.centre], "radius": np.array(tree.radius), "first": np.array(tree.first), "children": np.array(tree.children), "span": np.array(tree.span)}
    seen = Counter()
    centroids = x[[0, 100, 200, 300, 400, 500]]
    centroid_clusters.dual_walk(arrays, centroids, lambda nodes, k: seen.update(whole=int(tree.n[nodes].sum())), lambda rows, to, d: seen.update(single=len(to)))
    assert seen["whole"] + seen["single"] == 600 and seen["whole"] > 500
