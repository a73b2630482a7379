"""Centroid clustering: dual-tree Lloyd rounds over whole numbers.

Vectors are held in shards of a bounded number of rows, dealt by a hash of the row, one cover tree a shard: a node
has a centre (one of its vectors) and a radius that covers all below it; its children's centres lie apart by
more than half that radius and cover all within half of it. Each node keeps the number and the sum of the
vectors below it. The trees are a table in the shared folder, built once.

In every round the centroids get a tree of their own, and each shard walks pairs of nodes, level by level: a
node of the vectors' tree drops the centroid nodes that lie further, by triangle inequality, than the nearest
one surely does. Where one centroid is left, the node's sum and count are its share as a whole; leaf pairs are
compared exactly. Shards give one row of sums per centroid, which Spark adds up; the driver divides k sums of
64 numbers and nothing else. After the last round the same walk names each vector's cluster and distance.

All decisions are made on whole numbers: bounds are widened by more than their rounding, so ties and
near-ties are always settled by the exact comparison (the smaller number wins).

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no part;
components are held at +-2**25 after scaling, so that squared distances fit a long; repeated rows are vectors of their own;
of the first centroids with equal hashes the smaller vector comes first; a null vec_id has no hash and comes last;
fewer vectors than centroids give fewer centroids; a centroid without vectors stays where it is; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, lean, materialize, table

SCALE = 1024
DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
SHARD_ROWS = 1_024
LEAF_ROWS = 16
LIMIT = 1 << 25
#: Components up to this give squared distances that are exact in doubles, by the expanded form too.
EXACT_LIMIT = 1 << 21


def quantised(vectors: DataFrame, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """``(vec_id, x)`` of the vectors that take part."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dims) & finite)
    held = lambda c: F.greatest(F.least(c * float(scale), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(held(c))).alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows of ``x`` by rows of ``c`` (both int64)."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    if max(int(np.abs(x).max()), int(np.abs(c).max())) <= EXACT_LIMIT:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


# --- trees ------------------------------------------------------------------------------------


class CoverTree:
    """A cover tree over rows of whole numbers, in breadth-first order; a leaf holds up to ``leaf_rows`` rows or equal ones."""

    def __init__(self, x: np.ndarray, leaf_rows: int):
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.first: list[int] = []  # of the children, which stand together
        self.children: list[int] = []
        self.span: list[tuple[int, int]] = []
        todo, order, level = [], [], []

        def add(centre, rows, dist):
            at = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(dist.max())))
            self.first.append(0)
            self.children.append(0)
            self.span.append((0, 0))
            level.append((at, centre, rows, dist))

        def from_centre(rows, at):
            return squared(x[rows], x[at : at + 1])[:, 0]

        everything = np.arange(len(x))
        mean = np.floor(x.mean(axis=0)).astype(np.int64)
        centre = int(squared(x, mean[None, :])[:, 0].argmin())
        add(centre, everything, from_centre(everything, centre))
        leaves = []
        while level:
            todo, level = level, []
            for at, centre, rows, dist in todo:
                if len(rows) <= leaf_rows or self.radius[at] == 0:
                    leaves.append((at, rows))
                    continue
                self.first[at] = len(self.centre)
                half = self.radius[at] ** 2 / 4
                left, d = rows, dist
                own = centre
                while True:
                    near = d <= half
                    add(own, left[near], d[near])
                    left = left[~near]
                    if not len(left):
                        break
                    own = int(left[0])
                    d = from_centre(left, own)
                self.children[at] = len(self.centre) - self.first[at]
        # rows in the order of the leaves; a node's rows stand together only in leaves
        for at, rows in leaves:
            begun = len(order)
            order += rows.tolist()
            self.span[at] = (begun, len(order))
        self.order = np.array(order, np.int64)
        self.n = np.zeros(len(self.centre), np.int64)
        self.sums = np.zeros((len(self.centre), x.shape[1]), np.int64)
        for at, rows in leaves:
            self.n[at], self.sums[at] = len(rows), x[rows].sum(axis=0)
        for at in range(len(self.centre) - 1, -1, -1):
            if k := self.children[at]:
                below = slice(self.first[at], self.first[at] + k)
                self.n[at], self.sums[at] = self.n[below].sum(), self.sums[below].sum(axis=0)


class CentroidTree:
    """A small tree over the centroids: halves by the farthest pair, each node with its mean and radius."""

    def __init__(self, c: np.ndarray):
        self.members: list[np.ndarray] = []
        self.children: list[tuple[int, int]] = []
        centres, radii, todo = [], [], [(np.arange(len(c)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.members)
            if parent >= 0:
                pair = list(self.children[parent])
                pair[side] = at
                self.children[parent] = tuple(pair)
            centre = c[rows].mean(axis=0)
            self.members.append(rows)
            self.children.append((-1, -1))
            centres.append(centre)
            d = squared(c[rows], c[rows])
            radii.append(float(np.sqrt(((c[rows] - centre) ** 2).sum(axis=1)).max()) if len(rows) > 1 else 0.0)
            if len(rows) > 1 and d.max() > 0:
                a, b = np.unravel_index(d.argmax(), d.shape)
                one = d[:, a] <= d[:, b]
                todo += [(rows[~one], at, 1), (rows[one], at, 0)]
        self.centre, self.radius = np.array(centres, float), np.array(radii)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances in doubles, of rows by rows; no expanded form, so their error is a few parts in 2**50."""
    return np.sqrt(np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1))


def dual_walk(tree: dict, c: np.ndarray, whole, single) -> None:
    """Assigns all of a shard: ``whole(nodes, centroid)`` for node pairs decided as a whole, ``single(rows, centroids, distances)`` for exact ones.

    ``tree`` has centre vectors, radii, children and spans by node, and ``x`` in the order of leaves.
    """
    theirs = CentroidTree(c)
    owner = np.full(len(theirs.members), -1)
    for at, (rows, pair) in enumerate(zip(theirs.members, theirs.children, strict=True)):
        if pair[0] < 0:
            owner[at] = at  # a centroid node that isn't cut further: one centroid, or equal ones
    nodes = np.array([0])
    held = np.zeros((1, len(theirs.members)), bool)
    held[0, 0] = True
    while len(nodes):
        centres, radii = tree["centre"][nodes].astype(float), tree["radius"][nodes]
        # cut the centroids' side down to its leaves, dropping what lies further than the nearest surely does
        while True:
            gaps = _apart(centres, theirs.centre)
            slack = 1e-9 * (gaps + radii[:, None] + theirs.radius + 1)
            far = np.where(held, gaps + radii[:, None] + theirs.radius + slack, np.inf).min(axis=1)
            held &= gaps - radii[:, None] - theirs.radius - slack <= far[:, None]
            cut = [at for at in np.flatnonzero(held.any(axis=0)) if owner[at] < 0]
            if not cut:
                break
            for at in cut:
                one, two = theirs.children[at]
                held[:, one] |= held[:, at]
                held[:, two] |= held[:, at]
                held[:, at] = False
        alone = held.sum(axis=1) == 1
        last = held.argmax(axis=1)
        for at in np.unique(last[alone]):
            # of equal centroids the smallest number
            whole(nodes[alone & (last == at)], int(theirs.members[at].min()))
        nodes, held = nodes[~alone], held[~alone]
        leaf = tree["children"][nodes] == 0
        for node, row in zip(nodes[leaf], held[leaf], strict=True):
            lo, hi = tree["span"][node]
            among = np.sort(np.concatenate([theirs.members[at] for at in np.flatnonzero(row)]))
            d = squared(tree["x"][lo:hi], c[among])
            single(slice(lo, hi), among[d.argmin(axis=1)], d.min(axis=1))
        inner, held = nodes[~leaf], held[~leaf]
        times = tree["children"][inner]
        nodes = np.concatenate([np.arange(f, f + k) for f, k in zip(tree["first"][inner], times, strict=True)]) if len(inner) else inner
        held = np.repeat(held, times, axis=0)


# --- shards -----------------------------------------------------------------------------------

_TREE = "shard long, n int, rids binary, x binary, centre binary, radius binary, first binary, children binary, span binary, counts binary, sums binary"


def _grow(leaf_rows: int):
    def run(batches):
        shard, held = None, []

        def give():
            rows = pa.Table.from_batches(held).combine_chunks()
            x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            tree = CoverTree(x, leaf_rows)
            o = tree.order
            ids = rows["vec_id"].combine_chunks().take(pa.array(o))
            known = np.array([i is not None for i in ids.to_pylist()], "i8")
            packed = [np.stack([ids.fill_null(0).to_numpy(), known]).astype("i8"), x[o].astype("i8"), x[tree.centre].astype("i8"), np.array(tree.radius, "f8"), np.array(tree.first, "i4"), np.array(tree.children, "i4"), np.array(tree.span, "i4"), tree.n, tree.sums]
            values = [shard, rows.num_rows, *(np.ascontiguousarray(p).tobytes() for p in packed)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), pa.int32(), *[pa.binary()] * 9], strict=True)], names=[c.split()[0] for c in _TREE.split(", ")])

        for batch in batches:
            at = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if at[lo] != shard:
                    if held:
                        yield give()
                    shard, held = int(at[lo]), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield give()

    return run


def build_trees(spark: SparkSession, rows: DataFrame, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One cover tree per shard of about ``shard_rows`` rows, a table in the shared folder."""
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard"), "vec_id", "x")
    return materialize(spark, dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(_grow(leaf_rows)), _TREE), "cover-trees")


def _trees(batches, dims: int):
    for batch in batches:
        for row in range(batch.num_rows):
            of = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
            yield {
                "ids": np.frombuffer(of["rids"], "i8").reshape(2, -1), "x": np.frombuffer(of["x"], "i8").reshape(-1, dims), "centre": np.frombuffer(of["centre"], "i8").reshape(-1, dims),
                "radius": np.frombuffer(of["radius"], "f8"), "first": np.frombuffer(of["first"], "i4"), "children": np.frombuffer(of["children"], "i4"),
                "span": np.frombuffer(of["span"], "i4").reshape(-1, 2), "counts": np.frombuffer(of["counts"], "i8"), "sums": np.frombuffer(of["sums"], "i8").reshape(-1, dims),
            }


def _rounds_sums(c: np.ndarray):
    def run(batches):
        for tree in _trees(batches, c.shape[1]):
            n, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)

            def whole(nodes, k, n=n, sums=sums, tree=tree):
                n[k] += tree["counts"][nodes].sum()
                sums[k] += tree["sums"][nodes].sum(axis=0)

            def single(rows, to, _, n=n, sums=sums, tree=tree):
                np.add.at(n, to, 1)
                np.add.at(sums, to, tree["x"][rows])

            dual_walk(tree, c, whole, single)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assign(c: np.ndarray):
    def run(batches):
        for tree in _trees(batches, c.shape[1]):
            rows = len(tree["x"])
            to, d = np.zeros(rows, np.int32), np.zeros(rows, np.int64)

            def whole(nodes, k, tree=tree, to=to, d=d):
                todo = nodes.tolist()
                while todo:
                    at = todo.pop()
                    todo += range(tree["first"][at], tree["first"][at] + tree["children"][at])
                    if not tree["children"][at]:
                        lo, hi = tree["span"][at]
                        to[lo:hi], d[lo:hi] = k, squared(tree["x"][lo:hi], c[k : k + 1])[:, 0]

            def single(at, own, near, to=to, d=d):
                to[at], d[at] = own, near

            dual_walk(tree, c, whole, single)
            ids = pa.array(tree["ids"][0], mask=tree["ids"][1] == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(to), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in rows.select("x", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "x").limit(clusters).collect()]


def cluster(spark: SparkSession, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each vector that takes part."""
    bounded_batches(spark)
    rows = materialize(spark, quantised(vectors, scale, dims), "whole-numbers")
    centroids = first_centroids(rows, clusters, seed)
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], names)
    trees = build_trees(spark, rows, shard_rows, leaf_rows)
    for _ in range(rounds):
        shares = trees.mapInArrow(lean(_rounds_sums(np.array(centroids, np.int64))), "cluster int, n long, sums array<long>")
        each = shares.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dims)))
        for r in each.collect():  # a row per centroid
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    assigned = materialize(spark, trees.mapInArrow(lean(_assign(np.array(centroids, np.int64))), "vec_id long, cluster int, distance long"), "assigned")
    within = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    told = {r["cluster"]: int(r["own"]) for r in within.collect()}
    most = (1 << 63) - 1
    whole = min(sum(told.values()), most)
    facts = [(k, min(v, most), whole, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, v in told.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark, table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out."""
    out = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS INT) AS k, x FROM v ORDER BY k LIMIT {CLUSTERS}
)"""
    for i in range(ROUNDS + 1):
        out += f""", a{i} AS MATERIALIZED (
  SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT rid, k, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i} AS c) GROUP BY rid
)"""
        if i < ROUNDS:
            out += f""", m{i} AS MATERIALIZED (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM (
    SELECT k, pos, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM a{i} JOIN v USING (rid)) GROUP BY k, pos) GROUP BY k
), c{i + 1} AS MATERIALIZED (SELECT c.k, CAST(coalesce(m.x, c.x) AS BIGINT[]) AS x FROM c{i} AS c LEFT JOIN m{i} AS m USING (k))"""
    last = ROUNDS
    return (
        out
        + f"""
SELECT vec_id, a.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{last} AS a JOIN v USING (rid) JOIN c{last} AS c ON c.k = a.k"""
    )


OP13_SQL = _sql()
