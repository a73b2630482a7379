"""What the corpus operators share: scratch tables, row-safe column handling, set-wise components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, notebooks).
_OWN_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(tempfile.mkdtemp(prefix="tidemill-"))
    return _OWN_ROOT[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; its life ends with that folder's retention."""
    return f"{shared_root(spark)}/tidemill/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes a query's shuffle files at its end.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of any executor. The schema is
    handed to the reader, so no listing job is needed to infer it. Shuffle files of the
    write go with it; else they stay until the driver's next collection of garbage.
    """
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more."""
    root = f"{shared_root(spark)}/tidemill/"
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            files = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if path.getParent().equals(files.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root))):
                files.delete(path, True)


#: Bytes of an Arrow batch: what crosses to Python, and is copied there, at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches, so that the tasks of an executor hold little beside the heap.

    Only ever lowers the limit. It stays set, as plans are run after the operator has returned them.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key, "64m"))
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def lean(run):
    """``run`` over batches, after which its worker gives back memory that it doesn't use.

    Workers are kept between tasks; without this each keeps the most that any of its tasks took.
    """

    def leaner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:
                pass  # another C library

    return leaner


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


#: Rows of a few fixed-width columns that may be broadcast (about 8 MB of longs).
BROADCAST_ROWS = 200_000


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it to be small, else as it is (shuffle join)."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` (longs); root is the smallest node reachable.

    Alternates large-star and small-star steps, each one aggregation and one join
    on the edge list; only one count and one checksum reach the driver per round.
    Hub nodes are pre-aggregated (partial min) and their joins are left to the
    skew handling of adaptive execution. Each round's edges are a table in the
    shared folder. Self-loops and null ends are ignored.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e = materialize(spark, e.distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is linked to the smallest one
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: the smaller neighbours, and the node itself, are linked to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("x")
        )
        e = small.select("x.u", "x.v").where("u <> v").distinct()
        e = materialize(spark, e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
