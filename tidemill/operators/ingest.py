"""Index maintenance: one pass over the files, rows replaced only where content changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.config import Config
from tidemill.functions import text as X
from tidemill.operators import chunk, parse, scan, search, state
from tidemill.sources.scratch import materialize
from tidemill.sources.store import IndexStore


@dataclass
class IngestReport:
    version: int
    dirty: int
    deleted: int
    indexed: int


def tree_nodes(files: DataFrame) -> DataFrame:
    return files.select("path", X.parent_dir(F.col("path")).alias("parent"), F.lit("file").alias("node_type"), X.language_of(F.col("ext")).alias("language"), "size_bytes", F.md5("content").alias("hash"), X.depth(F.col("path")).cast("int").alias("depth"))


def update(store: IndexStore, files: DataFrame, config: Config, embedder: Callable | None = None, force: bool = False, only: DataFrame | None = None) -> IngestReport:
    """Indexes what is new or changed, drops what is gone, and commits one new version.

    ``only(path)`` says that nothing else has changed: then the state of those paths' buckets alone is read, and
    ``files`` needs to hold no other files. What is to be indexed is a table in the shared folder before it is parsed.
    """
    make = embedder or (lambda: search.hash_embedder(config.dimension))
    with store.lock():
        first = store.version is None
        if only is None:
            known, present = store.read("state"), files
        else:
            wanted = materialize(only.select("path").where("path is not null").distinct(), "changed-paths")
            known = store.read("state", buckets=store.buckets_of(wanted)).join(wanted, "path", "left_semi")
            present = files.join(wanted, "path", "left_semi")
        present = scan.indexable(present, config).select("path", "ext", "size_bytes", "content")
        todo = materialize(state.dirty(present, known, force).withColumn("language", X.language_of(F.col("ext"))), "to-index")
        gone = materialize(state.stale(present, known), "gone")
        n_dirty, n_gone = todo.count(), gone.count()
        if not n_dirty and not n_gone and not first:
            return IngestReport(store.version, 0, 0, 0)
        parsed = materialize(parse.parse_files(todo), "parsed")
        fresh = {
            "state": todo.select("path", "hash"),
            "chunks": search.embed_rows(chunk.chunk_files(todo, config), "content", make, config.dimension),
            "symbols": parse.symbols_of(parsed).drop("signature", "body"),
            "calls": parse.calls_of(parsed),
            "imports": parse.imports_of(parsed),
            "tree": tree_nodes(todo),
        }
        version = store.upsert(fresh, todo.select("path").unionByName(gone))
        return IngestReport(version, n_dirty, n_gone, n_dirty)


def status(store: IndexStore, files: DataFrame, config: Config) -> DataFrame:
    """One row: known files, new, changed, deleted, dirty (changed or deleted), chunks, symbols."""
    changes = state.changeset(scan.indexable(files, config), store.read("state"))
    count = lambda what: F.count_if(F.col("status") == what)
    base = changes.agg(count("new").alias("new"), count("changed").alias("changed"), count("deleted").alias("deleted"), (count("changed") + count("deleted")).alias("dirty"))
    for name in ("chunks", "symbols", "calls", "imports"):
        base = base.withColumn(name, F.lit(store.read(name).count()))
    return base
