"""A data source over a tree of files that leaves out excluded folders before it lists them, and files before it opens them.

The driver lists folders breadth first until there are ``FOLDERS`` to deal out; a task walks its folder, and where a folder that the
driver has listed holds many files they are dealt over several tasks. A folder that is excluded is one row (its path with
a slash at its end) and isn't entered; a file whose extension or size rules it out is a row without content, and isn't opened.
So ``scan.classify`` tells the same reasons as over whole rows. Links aren't followed. Bytes that aren't UTF-8, and
files that can't be read, have null content.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemill.config import Config
from tidemill.sources.files import read_tree

#: Folders that the driver lists at most, files of one of these that a task reads, and bytes of texts that are given on at once.
FOLDERS, FILES, GIVE_BYTES = 1_000, 2_000, 4 << 20
SCHEMA = "path string, ext string, size_bytes bigint, content string"
_ARROW = pa.schema([("path", pa.string()), ("ext", pa.string()), ("size_bytes", pa.int64()), ("content", pa.string())])


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if ":/" in root else (pafs.LocalFileSystem(), os.path.abspath(root))


def extension(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name.lstrip(".") else ""


@dataclass
class Folder(InputPartition):
    """A folder to read: all below it, or one share of the files right in it."""

    path: str
    deep: bool
    share: int = 0
    shares: int = 1


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        rules = json.loads(options["rules"])
        self.root, self.include = options["path"], rules["include_dirs"]
        self.excluded, self.extensions = frozenset(rules["exclude_dirs"]), frozenset(rules["include_extensions"])
        self.max_bytes = (rules["max_file_kb"] + 1) * 1024

    def _list(self, store: pafs.FileSystem, folder: str) -> tuple[list[pafs.FileInfo], list[pafs.FileInfo]]:
        """Folders and files right in a folder, by name."""
        found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        if isinstance(store, pafs.LocalFileSystem):
            found = [f for f in found if not os.path.islink(f.path)]
        found.sort(key=lambda f: f.path)
        return [f for f in found if f.type == pafs.FileType.Directory], [f for f in found if f.type == pafs.FileType.File]

    def partitions(self) -> list[Folder]:
        store, base = filesystem(self.root)
        starts = [f"{base.rstrip('/')}/{d.strip('/')}" for d in self.include] or [base]
        waiting, out = deque(dict.fromkeys(starts)), []
        for _ in range(FOLDERS):
            if not waiting:
                break
            folder = waiting.popleft()
            folders, files = self._list(store, folder)
            out += [Folder(folder, False, i, n) for n in [-(-len(files) // FILES)] for i in range(n)]
            # the row of an excluded folder comes from the task that meets it
            waiting.extend(f.path for f in folders if f.base_name not in self.excluded)
            if any(f.base_name in self.excluded for f in folders) and not files:
                out.append(Folder(folder, False))
        return out + [Folder(f, True) for f in waiting]

    def read(self, part: Folder | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing to deal out
            return
        store, base = filesystem(self.root)
        cut = len(base.rstrip("/")) + 1
        rows, size, waiting = [], 0, deque([part.path])
        while waiting:
            folders, files = self._list(store, waiting.popleft())
            if part.deep:
                waiting.extend(f.path for f in folders if f.base_name not in self.excluded)
            if part.share == 0:
                rows += [(f.path[cut:] + "/", "", 0, None) for f in folders if f.base_name in self.excluded]
            for f in files[part.share :: part.shares]:
                path = f.path[cut:]
                ext, content = extension(path), None
                if ext in self.extensions and f.size < self.max_bytes:
                    content = read_text(store, f.path)
                rows.append((path, ext, f.size, content))
                size += f.size if content is not None else 0
                if size > GIVE_BYTES or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def read_text(store: pafs.FileSystem, path: str) -> str | None:
    try:
        with store.open_input_file(path) as stream:
            return stream.read().decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_pruned(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """``files(path, ext, size_bytes, content)`` below ``root``, pruned by the configuration's rules.

    File systems that Arrow can't open are read by Spark, whole.
    """
    try:
        filesystem(root)
    except (pa.ArrowInvalid, OSError):
        return read_tree(spark, root, config.max_file_kb * 1024 + 1024)
    spark.dataSource.register(TreeSource)
    rules = {k: getattr(config, k) for k in ("include_dirs", "exclude_dirs", "include_extensions", "max_file_kb")}
    return spark.read.format(TreeSource.name()).option("rules", json.dumps(rules)).load(root)
