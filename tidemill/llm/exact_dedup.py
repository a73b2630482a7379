"""Exact duplicates by an extendible-hash index on shared files.

A text's key is the 64-bit hash of its normalised form (A-Z lower-cased). The directory
is addressed by the leading bits of the key; a bucket whose entries exceed its capacity is
split on its next bit, and the directory doubles when a bucket that is already told apart
by all its bits must be split. Owner tasks each process whole buckets, that is ranges of
keys, in key order: texts of one key form a chain, and each entry is compared byte by byte
with the texts of its chain, so texts whose keys collide stay apart. The index (key, place
in the chain, SHA-256, the row that stays, the number of rows) is a table in the shared
folder, sorted by key within each bucket, beside the directory.

Copies are folded before they are moved: a task keeps the texts it has seen lately and only
counts their repeats, so a group of any size reaches its owner as about one entry per task.
Each row then finds its entry by key and SHA-256 in a join whose hot keys adaptive execution
may split. The directory is the only thing that reaches the driver, and the tasks: 16 bits at
most, as buckets hold a fixed share of a large corpus, not a fixed size.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id
stays (a null doc_id is smaller than any other); of repeated rows (the same doc_id and text)
one stays; repeated rows are returned as often as they come; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, free_names, lean, materialize, maybe_broadcast, scratch_path, table

#: Bytes of entries that a bucket holds, or this share of all if that is more: there are never many more than twice as many buckets.
BUCKET_BYTES = 1 << 20
BUCKET_SHARE = 1 << 13
#: The directory never has more bits (65,536 slots, half a megabyte); these are counted in one pass. Beyond it a bucket is an
#: oversized run of keys, still processed as a stream.
MAX_BITS = 16
#: Bytes of texts that a task remembers for folding repeats.
FOLD_BYTES = 16 << 20
#: Rows of a batch that are copied out of Arrow at once.
SLICE_ROWS = 256


class Directory:
    """An extendible-hash directory over 64-bit unsigned keys, addressed by their leading bits."""

    def __init__(self):
        self.depth = 0
        self.slots = np.zeros(1, np.int64)
        #: bucket -> (its bits, their value)
        self.buckets: list[tuple[int, int]] = [(0, 0)]

    def double(self) -> None:
        self.slots = np.repeat(self.slots, 2)
        self.depth += 1

    def split(self, bucket: int) -> int:
        """Tells a bucket's entries apart by one more bit; the new bucket has those with the bit set."""
        bits, value = self.buckets[bucket]
        if bits == self.depth:
            self.double()
        new, width = len(self.buckets), 1 << (self.depth - bits)
        lo = value * width
        self.slots[lo + width // 2 : lo + width] = new
        self.buckets[bucket] = (bits + 1, value * 2)
        self.buckets.append((bits + 1, value * 2 + 1))
        return new

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Buckets of unsigned 64-bit keys."""
        if not self.depth:
            return np.zeros(len(keys), np.int64)
        return self.slots[(keys >> np.uint64(64 - self.depth)).astype(np.int64)]


def build_directory(count, capacity: int = BUCKET_BYTES, max_bits: int = MAX_BITS, step: int = MAX_BITS) -> Directory:
    """Splits overfull buckets until none is left that more bits can split.

    ``count(prefixes, bits)`` gives ``{value of the leading bits: (bytes, distinct keys)}`` within
    the given prefixes, ``(bits, value)``; it is asked once for every ``step`` bits, and only
    about the buckets that are overfull by then.
    """
    directory = Directory()
    overfull, bits = [0], 0
    while overfull and bits < max_bits:
        bits = min(bits + step, max_bits)
        weights = count([directory.buckets[b] for b in overfull], bits)
        values = np.array(sorted(weights), np.int64)
        size = np.array([weights[v][0] for v in values.tolist()], np.int64)
        keys = np.array([weights[v][1] for v in values.tolist()], np.int64)
        sums = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(keys)]
        open_buckets, overfull = overfull, []
        while open_buckets:
            bucket = open_buckets.pop()
            own, value = directory.buckets[bucket]
            lo, hi = np.searchsorted(values, [value << (bits - own), (value + 1) << (bits - own)])
            if sums[0][hi] - sums[0][lo] <= capacity or sums[1][hi] - sums[1][lo] <= 1:
                continue
            if own < bits:
                open_buckets += [bucket, directory.split(bucket)]
            else:
                overfull.append(bucket)
    return directory


def _slices(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(lo, SLICE_ROWS)


def _entries(batches):
    """(key, text, low id, high id, rows at the high id, rows) per text, folded over what the task remembers."""
    schema = pa.schema([("key", pa.int64()), ("text", pa.binary()), ("high", pa.int64()), ("at_high", pa.int64()), ("n", pa.int64())])
    seen: OrderedDict[bytes, list] = OrderedDict()
    held = 0
    out: list[tuple] = []
    size = 0

    def give():
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def leave(text, fold):
        return (xxhash.xxh64_intdigest(text) - (1 << 63), text, *fold)

    for batch in _slices(batches):
        texts = pc.ascii_lower(pc.fill_null(batch.column(1), "")).cast(pa.binary())
        for doc_id, text in zip(batch.column(0).to_pylist(), texts.to_pylist(), strict=True):
            fold = seen.get(text)
            if fold is None:
                seen[text] = [doc_id, 1, 1]
                held += len(text) + 200
                while held > FOLD_BYTES and len(seen) > 1:
                    old, fold = seen.popitem(last=False)
                    held -= len(old) + 200
                    out.append(leave(old, fold))
                    size += len(old)
                    if size > 8 << 20:
                        yield give()
                        out, size = [], 0
                continue
            seen.move_to_end(text)
            fold[2] += 1
            if doc_id == fold[0]:
                fold[1] += 1
            elif doc_id is not None and (fold[0] is None or doc_id > fold[0]):
                fold[0], fold[1] = doc_id, 1
    while seen:
        text, fold = seen.popitem()
        out.append(leave(text, fold))
        size += len(text)
        if size > 8 << 20:
            yield give()
            out, size = [], 0
    if out:
        yield give()


def _keys(batches):
    """(doc_id, key, sha, bytes, raw) of every row. Keys are shifted so that signed order is key order.

    ``raw`` is the hash of the text as it stands, as Spark's xxhash64 has it.
    """
    for batch in _slices(batches):
        given = pc.fill_null(batch.column(1), "")
        raw = np.fromiter((xxhash.xxh64_intdigest(t.as_py(), 42) for t in given.cast(pa.binary())), np.uint64, len(given))
        texts = pc.ascii_lower(given).cast(pa.binary()).to_pylist()
        keys = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts]
        shas = [hashlib.sha256(t).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(shas, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(raw.view(np.int64))], names=["doc_id", "key", "sha", "bytes", "raw"])


def _place(slots: np.ndarray, depth: int):
    directory = Directory()
    directory.depth, directory.slots = depth, slots

    def run(batches):
        for batch in _entries(batches):
            unsigned = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
            yield pa.RecordBatch.from_arrays([pa.array(directory.find(unsigned)), *batch.columns], names=["bucket", *batch.schema.names])

    return run


def _chain(batches):
    """An owner task: entries in key order; chains are compared byte by byte, and end with their key."""
    names = ["bucket", "key", "link", "sha", "bytes", "keep_id", "at_keep", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    key, bucket, chain, out = None, None, [], []

    def close():
        for link, (text, high, at_high, n) in enumerate(chain):
            out.append((bucket, key, link, hashlib.sha256(text).digest(), len(text), high, at_high, n))

    def give():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in _slices(batches):
        for b, k, text, high, at_high, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                close()
                key, bucket, chain = k, b, []
                if len(out) >= 20_000:
                    yield give()
                    out = []
            for link in chain:
                if link[0] == text:
                    link[3] += n
                    if high == link[1]:
                        link[2] += at_high
                    elif high is not None and (link[1] is None or high > link[1]):
                        link[1], link[2] = high, at_high
                    break
            else:
                chain.append([text, high, at_high, n])
    close()
    if out:
        yield give()


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def build_index(spark: SparkSession, docs: DataFrame, keys: DataFrame, path: str, capacity: int = BUCKET_BYTES) -> DataFrame:
    """Writes the index of ``docs`` below ``path`` and returns it: one row per distinct text."""
    one_per_key = materialize(spark, keys.groupBy("key").agg(F.max("bytes").alias("bytes")), "index-keys")

    # one pass counts all that the directory can tell apart: 65,536 rows at most
    value = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - MAX_BITS)
    weights = {r[0]: (r[1], r[2]) for r in one_per_key.groupBy(value.alias("value")).agg(F.sum("bytes"), F.count("*")).collect()}
    directory = build_directory(lambda prefixes, bits: weights, max(capacity, sum(w for w, _ in weights.values()) // BUCKET_SHARE))
    rows = [(i, b, v) for i, (b, v) in enumerate(directory.buckets)]
    spark.createDataFrame(rows, "bucket long, bits int, value long").coalesce(1).write.parquet(f"{path}/directory")
    placed = _narrow(docs).mapInArrow(lean(_place(directory.slots, directory.depth)), "bucket long, key long, text binary, high long, at_high long, n long")
    # a bucket is a range of keys, and has one owner, which takes its keys in order
    owned = placed.repartition(F.col("bucket"))
    index = owned.sortWithinPartitions("bucket", "key").mapInArrow(lean(_chain), "bucket long, key long, link int, sha binary, bytes long, keep_id long, at_keep long, n long")
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def find_duplicates(spark: SparkSession, docs: DataFrame, capacity: int = BUCKET_BYTES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, raw)``: one row per document."""
    bounded_batches(spark)
    keys = materialize(spark, _narrow(docs).mapInArrow(lean(_keys), "doc_id long, key long, sha binary, bytes long, raw long"), "row-keys")
    index = build_index(spark, docs, keys, scratch_path(spark, "exact-index"), capacity)
    entry = index.select("key", "sha", "keep_id", "at_keep", F.col("n").alias("group_size"))
    found = keys.join(entry, ["key", "sha"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if index.where("at_keep > 1").limit(1).count():
        # repeated rows: one of those at the id that stays
        tied = (F.col("at_keep") > 1) & stays
        first = F.row_number().over(Window.partitionBy("key", "sha").orderBy("doc_id")) == 1
        found = found.where(~tied).withColumn("kept", stays).unionByName(found.where(tied).withColumn("kept", first))
    else:
        found = found.withColumn("kept", stays)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "raw")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_duplicates(spark, table(spark, sf_dir, "documents")).drop("raw")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts, the row with the largest doc_id stays, once."""
    found = find_duplicates(spark, docs)
    found = materialize(spark, found.where("group_size > 1").select("doc_id", "keep_id", "kept", "raw"), "duplicates")
    gone_id, gone_raw, same = free_names(docs, "_gone_id", "_gone_raw", "_same_text")
    gone = found.where("not kept and not (doc_id <=> keep_id)").select(F.col("doc_id").alias(gone_id), F.col("raw").alias(gone_raw)).distinct()
    raw = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = docs.join(maybe_broadcast(gone), F.col("doc_id").eqNullSafe(F.col(gone_id)) & (raw == F.col(gone_raw)), "left_anti")
    repeated = materialize(spark, found.where("not kept and doc_id <=> keep_id").select(F.col("doc_id").alias(gone_id)).distinct(), "repeated-ids")
    if repeated.isEmpty():
        return kept
    # repeated rows are one document: rows that share the id that stays and the normalised text; only rows with such an id move
    repeated = maybe_broadcast(repeated)
    own = F.col("doc_id").eqNullSafe(F.col(gone_id))
    norm = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    once = kept.join(repeated, own, "left_semi").withColumn(same, norm).dropDuplicates(["doc_id", same]).drop(same)
    return kept.join(repeated, own, "left_anti").unionByName(once)


#: A-Z only: DuckDB's lower() would also fold other scripts.
OP1_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""
