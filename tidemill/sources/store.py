"""The index as versioned, bucketed Parquet tables.

Every table is cut into buckets by the hash of the path that its rows belong to. A version is a manifest: for each
table the folder of every bucket. A run writes the buckets that its paths fall into and carries all others by
reference, then replaces one pointer by a rename, so readers see all of a version or none of it, and a reader of
an older one keeps its files until they are vacuumed. How many buckets there are is set when a store is made.

A lock file keeps a second writer out. Its holder renews it while it works; one that hasn't been renewed for
``STALE_LOCK`` seconds was left behind by a writer that died, and is taken over, after which the former holder can't
commit. Paths are of any Hadoop file system.
"""

from __future__ import annotations

import contextlib
import json
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill import schemas
from tidemill.functions import text as X

TABLES: dict[str, T.StructType] = {
    "state": schemas.STATE,
    "chunks": schemas.CHUNKS,
    "symbols": schemas.SYMBOLS,
    "calls": schemas.CALLS,
    "imports": schemas.IMPORTS,
    "tree": schemas.TREE,
}


#: The path that a row of a table belongs to.
KEYS = {"state": "path", "chunks": "source", "symbols": "path", "calls": "caller_id", "imports": "importer", "tree": "path"}
BUCKETS = 64
#: Seconds without a renewal after which a lock counts as left behind, and between renewals.
STALE_LOCK, RENEW = 600, 60


def key_of(table: str) -> Column:
    key = F.col(KEYS[table])
    return X.caller_path(key) if table == "calls" else key


class Locked(RuntimeError):
    pass


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._buckets, self._token = spark, root.rstrip("/"), buckets, None
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str, overwrite: bool = True) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), overwrite)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    @property
    def version(self) -> int | None:
        text = self._read_text("CURRENT")
        return int(text) if text else None

    def manifest(self, version: int | None = None) -> dict:
        """``{"buckets": n, "tables": {table: {bucket: folder}}}`` of a version, the present one by default."""
        version = self.version if version is None else version
        text = None if version is None else self._read_text(f"manifests/v{version:08d}.json")
        return json.loads(text) if text else {"buckets": self._buckets, "tables": {t: {} for t in TABLES}}

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        name, token, done = self._path(f"{self.root}/LOCK"), uuid.uuid4().hex, threading.Event()
        self._fs.mkdirs(self._path(self.root))
        if not self._fs.createNewFile(name):
            age = time.time() - self._fs.getFileStatus(name).getModificationTime() / 1000
            if age < STALE_LOCK or not self._fs.delete(name, False) or not self._fs.createNewFile(name):
                raise Locked(f"another run holds {self.root}/LOCK")
        self._write_text("LOCK", token)

        def renew() -> None:
            while not done.wait(RENEW):
                self._fs.setTimes(name, int(time.time() * 1000), -1)

        beat = threading.Thread(target=renew, daemon=True)
        beat.start()
        self._token = token
        try:
            yield
        finally:
            done.set()
            self._token = None
            if self._read_text("LOCK") == token:
                self._fs.delete(name, False)

    def bucket(self, key: Column, buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets or self.manifest()["buckets"])).cast("int")

    def buckets_of(self, paths: DataFrame) -> list[int]:
        """The buckets that ``paths(path)`` fall into."""
        return sorted(r[0] for r in paths.select(self.bucket(F.col("path")).alias("b")).distinct().collect())

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version, or some of its buckets."""
        own = self.manifest(version)["tables"][table]
        folders = [f"{self.root}/{own[k]}" for k in sorted(own, key=int) if buckets is None or int(k) in buckets]
        return self.spark.read.schema(TABLES[table]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[table])

    def _write(self, table: str, rows: DataFrame, buckets: int, version: int) -> dict[str, str]:
        """Writes rows by bucket; the folder of each bucket that has any."""
        where = f"data/{table}/v{version:08d}-{uuid.uuid4().hex[:12]}"
        rows = rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) for f in TABLES[table].fields))
        # large buckets are dealt over several tasks
        rows.withColumn("bucket", self.bucket(F.coalesce(key_of(table), F.lit("")), buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{where}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{where}"))]
        return {name.partition("=")[2]: f"{where}/{name}" for name in found if name.startswith("bucket=")}

    def _point(self, manifest: dict) -> int:
        if self._token is not None and self._read_text("LOCK") != self._token:
            raise Locked(f"{self.root}/LOCK was taken over by another run")
        new = (self.version or 0) + 1
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        self._write_text(f"manifests/v{new:08d}.json", json.dumps(manifest))
        self._write_text("CURRENT.next", str(new))
        target, source = self._path(f"{self.root}/CURRENT"), self._path(f"{self.root}/CURRENT.next")
        # replaces the old pointer in one step, where the file system can
        jvm = self.spark._jvm
        mode = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        mode[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, mode)
        return new

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """A new version with whole tables; those that aren't given are carried over."""
        manifest, new = self.manifest(), (self.version or 0) + 1
        for name, rows in tables.items():
            manifest["tables"][name] = self._write(name, rows, manifest["buckets"], new)
        return self._point(manifest)

    def upsert(self, fresh: dict[str, DataFrame], touched: DataFrame) -> int:
        """A new version in which all rows of the ``touched(path)`` have given way to the fresh ones.

        Only the buckets of touched paths are read and written, in every table; fresh rows are of touched paths.
        """
        manifest, new = self.manifest(), (self.version or 0) + 1
        gone = touched.select(F.col("path").alias("_touched")).distinct()
        some = self.buckets_of(touched)
        for name in TABLES:
            if name not in fresh and not any(int(k) in some for k in manifest["tables"][name]):
                continue
            rows = self.read(name, buckets=some)
            rows = rows.join(gone, key_of(name) == F.col("_touched"), "left_anti")
            if name in fresh:
                rows = rows.unionByName(fresh[name].select(*(fresh[name][f.name].cast(f.dataType).alias(f.name) for f in TABLES[name].fields)))
            own = manifest["tables"][name]
            written = self._write(name, rows, manifest["buckets"], new)
            manifest["tables"][name] = {k: v for k, v in own.items() if int(k) not in some} | written
        return self._point(manifest)

    def vacuum(self, keep: int = 2) -> int:
        """Forgets versions older than the last ``keep``, and deletes the folders that no other one refers to; how many versions went."""
        last = self.version or 0
        kept = {f for v in range(max(1, last - keep + 1), last + 1) for own in self.manifest(v)["tables"].values() for f in own.values()}
        gone = 0
        for version in range(last - keep, 0, -1):
            name = self._path(f"{self.root}/manifests/v{version:08d}.json")
            if not self._fs.exists(name):
                break
            for folder in {f for own in self.manifest(version)["tables"].values() for f in own.values()} - kept:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            gone += int(self._fs.delete(name, False))
        return gone

    def clean(self) -> None:
        self._fs.delete(self._path(self.root), True)
