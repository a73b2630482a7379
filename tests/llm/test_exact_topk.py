"""Exact search against brute force, and its trees."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import exact_topk

INF, NAN = float("inf"), float("nan")


def brute(rows, every, k):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = Counter()
    for at, (q_id, q) in enumerate(kept):
        if q_id is None or q_id % every:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1), i is None, i) for n, (i, v) in enumerate(kept) if n != at and len(v) == len(q)]
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out.update((q_id, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:k], 1))
    return out


def found(spark, rows, every=5, kind="float", **sizes):
    frame = spark.createDataFrame([(i, v, "c", "c") for i, v in rows], f"vec_id long, embedding array<{kind}>, x string, shard string").repartition(3)
    return Counter(tuple(r) for r in exact_topk.top_k(spark, frame, f"vec_id % {every} = 0", **sizes).collect())


@pytest.mark.parametrize("shard_rows", [7, 2048])
def test_top_k_against_brute_force(spark, shard_rows):
    rng = random.Random(shard_rows)
    f32 = lambda v: [float(np.float32(c)) for c in v]
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, f32([c + rng.gauss(0, 0.1) for c in rng.choice(centres)])) for i in range(250)]
    rows += [(1000 + i, f32([0.5] * 6)) for i in range(90)]  # one very common vector
    rows += [(5, f32([0.25] * 6)), (5, f32([0.25] * 6)), (10, None), (15, []), (20, []), (25, f32([1, 2])), (26, f32([3, -4])), (None, f32([2.0] * 6)), (None, None)]
    rows += [(30, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (35, [NAN] * 6), (40, [INF] * 6), (-45, f32([-1.0] * 6))]
    assert found(spark, rows, sample_rows=60, shard_rows=shard_rows, leaf_rows=4) == brute(rows, 5, 5)


def test_very_large_components(spark):
    rows = [(i, [float(x), -float(x) / 3, 1.5]) for i, x in enumerate([1e6, 1e9, 3e12, -7e15, 2.5e17, 1e30, -1e30, 0.1, 2**40, 2**40])]
    assert found(spark, rows, every=1, kind="double", shard_rows=3) == brute(rows, 1, 5)


def test_small_and_empty_tables(spark):
    assert not found(spark, [])
    assert not found(spark, [(5, [1.0])])
    assert found(spark, [(5, [1.0]), (6, [2.0]), (7, [-1.0])]) == Counter([(5, 1, 6, 256 * 512), (5, 2, 7, -256 * 256)])


def test_boxes_are_tight_and_prune():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 8)) * 50) + np.repeat(np.eye(8)[:5] * 2000, 100, axis=0)
    tree = exact_topk.Tree(x, np.arange(500), 8)
    packed = exact_topk.Packed(8, *tree.pack(), *(np.ascontiguousarray(a).tobytes() for a in (tree.order.astype("i8"), tree.order.astype("i8"), x[tree.order])))
    assert sorted(tree.order.tolist()) == list(range(500))
    for node, (lo, hi) in enumerate(packed.span):
        if lo >= 0:
            assert (packed.x[lo:hi].min(axis=0) == packed.lo[node]).all() and (packed.x[lo:hi].max(axis=0) == packed.hi[node]).all()
    up = exact_topk.bounds(x[:1], packed.lo, packed.hi)[0]
    looked = []
    real, exact_topk._scores = exact_topk._scores, lambda rows, q, exact: looked.append(len(rows)) or real(rows, q, exact)
    try:
        got = exact_topk.search(packed, x[0], up, 0, 5, -math.inf)
    finally:
        exact_topk._scores = real
    want = sorted(((int(s), i) for i, s in enumerate(x @ x[0]) if i), key=lambda s: (-s[0], s[1]))[:5]
    assert sorted(got, key=lambda s: (-s[0], s[1])) == want and sum(looked) < 250
    assert not exact_topk.search(packed, x[0], up, 0, 5, up[0] + 1)


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_only_counted_tables_are_broadcast(spark, monkeypatch, bound):
    # the estimates of Spark go by compressed files: the shards that queries ask for, or their trees, would be held by the driver
    for name in ("BROADCAST_ROWS", "QUERY_COMPONENTS"):
        monkeypatch.setattr(exact_topk, name, bound)
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(4)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exact_topk.top_k(spark, frame, "vec_id % 5 = 0", shard_rows=16)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and all(("strategy=broadcast" if bound else "strategy=merge") in line for line in joins)
    assert Counter(map(tuple, got.collect())) == brute(rows, 5, exact_topk.TOP)
