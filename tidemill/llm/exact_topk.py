"""Exact top-k by inner product: KD-trees per shard, searched best first.

1. Cells. A bounded sample (``SAMPLE_ROWS`` vectors, by the smallest hashes) is halved at medians of its
   widest components; the splits, at most ``MAX_CELLS`` of them, send every vector to a cell. They only decide
   who lies beside whom: results don't depend on the sample.
2. Shards. A cell of more than ``SHARD_ROWS`` rows is dealt over several shards by a hash of the row, so a vector
   that a third of all rows repeat fills no task. Each shard gets a KD-tree: median splits on the
   widest component, tight bounding boxes, leaves in order of vec_id. A shard's tree is one row of a table
   in the shared folder.
3. Search, twice. The bound of a box for a query is the sum over components of the larger of q*lo and q*hi. Each
   query first searches a shard of the cell whose box has the largest bound; its k-th score so far goes with it to
   the shards of the cells whose boxes reach it, no others. In a shard, nodes are visited by falling bound until none reaches
   the k-th score; leaves are scored whole. Queries go to a shard's task in blocks, one shard's tree and one
   batch of queries at a time.

Scores are sums of products of whole numbers, exact in doubles below 2^53; beyond, whole-number arithmetic
without bounds is used, and a score that no long holds is held at the nearest long.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; a vector meets
those of its own length only; of repeated vec_ids each row is a query (or candidate) of its own; a null vec_id is
no query and, as a candidate, comes after all others of its score; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, bounded_batches, is_small, lean, materialize, maybe_broadcast, table

SCALE = 256
TOP = 5
EVERY = 50
SAMPLE_ROWS = 20_000
MAX_CELLS = 1 << 10
SHARD_ROWS = 2_048
LEAF_ROWS = 32
#: Queries that a task has of one shard.
BLOCK_QUERIES = 512
#: Boxes of a few kilobytes each that may be broadcast: those of two lengths.
BOXES = 2 * MAX_CELLS
#: Components of all queries together that may be broadcast (8 MB).
QUERY_COMPONENTS = 1 << 20
#: Whole numbers up to this are exact doubles.
EXACT = 1 << 53
LAST_ID = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """``(rid, vec_id, dims, x)`` of the vectors that take part; x holds whole numbers as doubles."""
    x = F.transform(F.col("embedding"), lambda c: F.expr("double(0)") + c.cast("double"))
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("x").isNotNull() & finite).select("rid", "vec_id", F.size("x").alias("dims"), F.transform("x", lambda c: F.expr(f"{scale}D") * c).alias("x"))
    # floor() of Spark gives longs; very large components are whole already
    whole = lambda c: F.when(F.abs(c) < float(EXACT), F.floor(c).cast("double")).otherwise(c)
    return rows.select("rid", "vec_id", "dims", F.transform("x", whole).alias("x"))


# --- cells ------------------------------------------------------------------------------------


def split_cells(sample: np.ndarray, cells: int, least: int) -> list[tuple[int, float, int, int]]:
    """Median splits of a sample as nodes ``(component, value, left, right)``; a leaf is ``(-1, 0, cell, 0)``."""
    nodes: list = []
    cell = 0
    todo = [(np.arange(len(sample)), cells, -1, 0)]
    while todo:
        rows, share, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        spread = np.ptp(sample[rows], axis=0) if len(rows) else np.zeros(1)
        dim = int(spread.argmax()) if spread.size else 0
        if share < 2 or len(rows) < 2 * least or spread.size == 0 or spread[dim] <= 0:
            nodes.append([-1, 0.0, cell, 0])
            cell += 1
            continue
        value = float(np.median(sample[rows, dim]))
        right = sample[rows, dim] >= value
        if right.all():
            right = sample[rows, dim] > value
            value = float(sample[rows, dim][right].min())
        nodes.append([dim, value, 0, 0])
        todo += [(rows[right], share // 2, at, 1), (rows[~right], share // 2, at, 0)]
    return [tuple(n) for n in nodes]


def cells_of(nodes: list, x: np.ndarray) -> np.ndarray:
    """The cell of each row of ``x``."""
    dims, values = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
    sides = np.array([[n[2], n[3]] for n in nodes])
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while len(rows):
        rows = rows[dims[at[rows]] >= 0]
        here = at[rows]
        at[rows] = sides[here, (x[rows, dims[here]] >= values[here]).astype(int)]
    return sides[at, 0]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _celled(splits: dict[int, list]):
    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            cell = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if d and d in splits:
                    cell[rows] = cells_of(splits[d], _matrix(batch.column(3).take(pa.array(rows))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


# --- trees ------------------------------------------------------------------------------------


class Tree:
    """A KD-tree over rows: nodes in preorder with tight boxes; ``order`` lists rows by leaf."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.lo, self.hi, self.left, self.right, self.span = [], [], [], [], []
        order, todo = [], [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.span)
            if parent >= 0:
                (self.left if side == 0 else self.right)[parent] = at
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.left.append(-1)
            self.right.append(-1)
            dim = int((hi - lo).argmax()) if x.shape[1] else 0
            if len(rows) <= leaf_rows or x.shape[1] == 0 or hi[dim] == lo[dim]:
                begun = sum(map(len, order))
                order.append(rows[np.lexsort((rows, ids[rows]))])
                self.span.append((begun, begun + len(rows)))
                continue
            self.span.append((-1, -1))
            half = len(rows) // 2
            by = rows[np.argpartition(x[rows, dim], half)]
            todo += [(by[half:], at, 1), (by[:half], at, 0)]
        self.order = np.concatenate(order)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def pack(self) -> tuple:
        return tuple(np.ascontiguousarray(a, t).tobytes() for a, t in ((self.lo, "f8"), (self.hi, "f8"), (self.left, "i4"), (self.right, "i4"), (self.span, "i4")))


class Packed:
    """A shard's tree, read back; rows are in the order of its leaves."""

    def __init__(self, dims, lo, hi, left, right, span, rids, ids, x):
        shape = (-1, dims) if dims else (len(span) // 8, 0)
        self.lo, self.hi = np.frombuffer(lo).reshape(shape), np.frombuffer(hi).reshape(shape)
        self.left, self.right, self.span = np.frombuffer(left, "i4"), np.frombuffer(right, "i4"), np.frombuffer(span, "i4").reshape(-1, 2)
        self.rids, self.ids = np.frombuffer(rids, "i8"), np.frombuffer(ids, "i8")
        self.x = np.frombuffer(x).reshape(len(self.ids), dims)
        self.most = float(np.abs(self.x).max()) if self.x.size else 0.0
        self.flat = (self.lo == self.hi).all(axis=1)


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest inner product that each box can hold, for each row of ``q``; rounding is on the safe side."""
    up = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    slack = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
    return np.where(slack < EXACT, up, up + slack * 1e-12)


def _scores(x: np.ndarray, q: np.ndarray, exact: bool) -> list:
    if exact:
        return (x @ q).astype(np.int64).tolist()
    whole = [int(c) for c in q]
    return [min(max(sum(a * int(b) for a, b in zip(whole, row, strict=True)), -(1 << 63)), LAST_ID) for row in x]


def search(tree: Packed, q: np.ndarray, bound: np.ndarray, rid: int, k: int, least: float) -> list[tuple[int, int]]:
    """The k best ``(score, vec_id)`` of a shard for one query that score at least ``least``; ``rid`` is the query's own row.

    Nodes are visited by falling bound. A node whose bound equals the k-th score is still visited, as a
    smaller vec_id wins a tie. In a leaf of equal rows the k + 1 smallest vec_ids are enough.
    """
    exact = float(np.abs(q).sum()) * tree.most < EXACT
    best: list[tuple[int, int]] = []  # a heap: the worst is first; vec_ids are negated
    todo = [(-bound[0], 0)]
    while todo:
        up, node = heapq.heappop(todo)
        kth = best[0][0] if len(best) == k else least
        if -up < kth:
            break
        if tree.left[node] >= 0:
            for child in (int(tree.left[node]), int(tree.right[node])):
                if bound[child] >= kth:
                    heapq.heappush(todo, (-bound[child], child))
            continue
        lo, hi = tree.span[node]
        hi = min(hi, lo + k + 1) if tree.flat[node] else hi
        for score, vec_id, own in zip(_scores(tree.x[lo:hi], q, exact), tree.ids[lo:hi].tolist(), tree.rids[lo:hi].tolist(), strict=True):
            if own == rid or score < least:
                continue
            if len(best) < k:
                heapq.heappush(best, (score, -vec_id))
            elif (score, -vec_id) > best[0]:
                heapq.heapreplace(best, (score, -vec_id))
    return [(s, -i) for s, i in best]


_SHARD = "shard long, cell int, dims int, n int, lo binary, hi binary, left binary, right binary, span binary, rids binary, ids binary, x binary, box_lo array<double>, box_hi array<double>"


def _grow(leaf_rows: int):
    """Rows sorted by shard, as a stream: one tree a shard."""

    def run(batches):
        shard, held = None, []

        def give():
            rows = pa.Table.from_batches(held).combine_chunks()
            x = _matrix(rows["x"].combine_chunks())
            dims = x.shape[1]
            x = x if dims else x.reshape(rows.num_rows, 0)
            ids = rows["vec_id"].fill_null(LAST_ID).to_numpy()
            tree = Tree(x, ids, leaf_rows)
            o = tree.order
            packed = tree.pack()
            values = [shard, rows["cell"][0].as_py(), dims, rows.num_rows, *packed, rows["rid"].to_numpy()[o].astype("i8").tobytes(), ids[o].astype("i8").tobytes(), np.ascontiguousarray(x[o], "f8").tobytes(), tree.lo[0].tolist(), tree.hi[0].tolist()]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 8, pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in _SHARD.split(", ")])

        for batch in batches:
            at = batch.column(batch.schema.get_field_index("shard")).to_numpy()
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


def build_shards(spark: SparkSession, vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The index: one row per shard with its packed tree, a table in the shared folder."""
    sample = vectors.where("dims > 0").orderBy(F.xxhash64("vec_id", "x")).limit(sample_rows).select("dims", "x").toArrow()
    splits = {}
    dims = sample["dims"].to_numpy()
    for d in np.unique(dims):
        own = _matrix(sample["x"].combine_chunks().take(pa.array(np.flatnonzero(dims == d))))
        splits[int(d)] = split_cells(own, MAX_CELLS, max(16, min(shard_rows, sample_rows // MAX_CELLS)))
    celled = materialize(spark, vectors.mapInArrow(lean(_celled(splits)), "rid long, vec_id long, dims int, x array<double>, cell int"), "celled")
    # cells of the split lengths number MAX_CELLS each at most; other lengths are one cell
    sizes = celled.groupBy("dims", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    salted = celled.join(sizes, ["dims", "cell"]).withColumn("shard", F.xxhash64("dims", "cell", F.pmod(F.xxhash64("rid"), F.col("parts"))))
    grown = salted.select("shard", "rid", "vec_id", "cell", "x").repartition("shard").sortWithinPartitions("shard")
    return materialize(spark, grown.mapInArrow(lean(_grow(leaf_rows)), _SHARD), "kd-trees")


def _beside(small: DataFrame, may_broadcast: bool | None = None) -> DataFrame:
    """``small`` as the side of a join that is broadcast if a count allows it; else both sides are shuffled.

    Without a hint Spark goes by the size of compressed files. Millions of queries' shards are a few megabytes there, and hundreds on the driver.
    """
    if may_broadcast is None:
        may_broadcast = is_small(small, BROADCAST_ROWS)
    return F.broadcast(small) if may_broadcast else small.hint("merge")


_ASKED = "shard long, block int, rid long, query_id long, least double"


def _answer(k: int):
    """A stream sorted by shard and block in which the shard's tree comes before its queries."""
    names = ["rid", "query_id", "vec_id", "score"]

    def run(batches):
        tree = None
        for batch in batches:
            out = []
            kinds = batch.column(batch.schema.get_field_index("kind")).to_pylist()
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            at = 0
            while at < len(kinds):
                if kinds[at] == 0:
                    tree = Packed(*(column[c][at].as_py() for c in ("dims", "lo", "hi", "left", "right", "span", "rids", "ids", "x")))
                    at += 1
                    continue
                end = at
                while end < len(kinds) and kinds[end] == 1:
                    end += 1
                q = _matrix(column["q"].slice(at, end - at)).reshape(end - at, tree.x.shape[1])
                up = bounds(q, tree.lo, tree.hi)
                for i in range(end - at):
                    rid, query_id, least = (column[c][at + i].as_py() for c in ("rid", "query_id", "least"))
                    for score, vec_id in search(tree, q[i], up[i], rid, k, -math.inf if least is None else least):
                        out.append((rid, query_id, None if vec_id == LAST_ID else vec_id, score))
                at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def _searched(spark: SparkSession, shards: DataFrame, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``asked(rid, shard, least)`` answered: ``(rid, query_id, vec_id, score)``."""
    tree = ["lo", "hi", "left", "right", "span", "rids", "ids", "x"]
    block = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    sizes = materialize(spark, asked.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks")), "blocks")
    sizes = _beside(sizes)
    held = queries.agg(F.sum(F.col("dims").cast("long") + 8)).first()[0] or 0
    asking = _beside(queries.select("rid", F.col("vec_id").alias("query_id"), F.col("x").alias("q"), "dims"), held <= QUERY_COMPONENTS)
    left = shards.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "dims", *tree, F.lit(None).cast("long").alias("rid"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("least"), F.lit(None).cast("array<double>").alias("q"))
    right = asked.join(sizes, "shard").join(asking, "rid")
    right = right.select("shard", block.alias("block"), F.lit(1).alias("kind"), "dims", *(F.lit(None).cast("binary").alias(c) for c in tree), "rid", "query_id", "least", "q")
    both = left.unionByName(right).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    return both.mapInArrow(lean(_answer(k)), "rid long, query_id long, vec_id long, score long")


def top_k(spark: SparkSession, vectors: DataFrame, is_query: str, k: int = TOP, scale: int = SCALE, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that satisfies ``is_query`` (SQL over vec_id) its k best others."""
    bounded_batches(spark)
    rows = materialize(spark, quantised(vectors, scale), "quantised")
    shards = build_shards(spark, rows, sample_rows, shard_rows, leaf_rows)
    queries = rows.where(is_query)
    # a length has MAX_CELLS cells at most, so their boxes can go to all queries; shards come in by cell
    spread = shards.select("dims", "cell", F.posexplode_outer(F.arrays_zip("box_lo", "box_hi")).alias("at", "b")).groupBy("dims", "cell", "at").agg(F.min("b.box_lo").alias("lo"), F.max("b.box_hi").alias("hi"))
    boxes = materialize(spark, spread.groupBy("dims", "cell").agg(F.sort_array(F.collect_list(F.struct("at", "lo", "hi"))).alias("box")), "cell-boxes")
    # without components every product is zero
    up = F.expr("IF(dims = 0, 0D, aggregate(zip_with(x, box, (q, b) -> greatest(q * b.lo, q * b.hi)), 0D, (s, v) -> s + v))")
    reach = queries.select("rid", "dims", "x").join(maybe_broadcast(boxes, BOXES), "dims").select("rid", "dims", "cell", up.alias("up"))
    reach = materialize(spark, reach, "reach")
    parts = materialize(spark, shards.select("dims", "cell", "shard"), "shard-cells")
    best = reach.groupBy("rid", "dims").agg(F.max_by("cell", F.struct("up", "cell")).alias("cell"))
    first = materialize(spark, best.join(_beside(parts.groupBy("dims", "cell").agg(F.min("shard").alias("shard"))), ["dims", "cell"]).select("rid", "shard", F.lit(None).cast("double").alias("least")), "first-asked")
    found = materialize(spark, _searched(spark, shards, first, queries, k), "first-shards")
    kth = found.groupBy("rid").agg(F.count("*").alias("found"), F.min("score").alias("kth")).select("rid", F.when(F.col("found") >= k, F.col("kth").cast("double")).alias("least"))
    # sums of products beyond 2^53 are rounded, and a score may be held at the largest long
    slack = lambda c: F.when(F.abs(c) < float(EXACT), 0.0).otherwise(F.abs(c) * 1e-9)
    rest = reach.join(_beside(kth), "rid", "left").withColumn("least", F.col("least") - slack("least")).where(F.col("least").isNull() | (F.col("up") + slack("up") >= F.col("least")))
    rest = rest.join(_beside(parts), ["dims", "cell"]).select("rid", "shard", "least").join(_beside(first.select("rid", "shard")), ["rid", "shard"], "left_anti")
    rest = materialize(spark, rest, "other-shards")
    found = found.unionByName(_searched(spark, shards, rest, queries, k))
    by = Window.partitionBy("rid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings"), f"vec_id % {EVERY} = 0")


OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.rid <> v.rid AND len(q.x) = len(v.x) WHERE q.vec_id % {EVERY} = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
