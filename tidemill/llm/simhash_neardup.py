"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits. Two that differ in at most three bits differ in at most
one bit in one of their 32-bit halves, so each half is searched with threshold one.
A half is 31 bits of a perfect single-error-correcting code plus one free bit:
its codewords are the anchors (2**27 per half, covering radius one). A fingerprint
is replicated to every anchor within covering radius plus threshold, that is to its
own anchor, the 15 codewords at distance two and its own anchor with the free bit
turned; of these only anchors that sort after its own are needed, as any pair is
found at the later of its two own anchors. Per anchor, members are compared with
those whose own anchor it is. All pairs within three bits meet; none is sampled.

Rows, not groups, are shuffled: equal fingerprints are first folded to one class
with its smallest doc_id (partial aggregation), so a group of copies of any size is
one row. Pairs found in a task leave it as a spanning forest, never as all pairs.

Defined results: a null text counts as empty; a text without words has fingerprint
zero and links like any other; a null doc_id keeps its fingerprint and takes the
smallest non-null doc_id of its component (null if there is none); repeated rows are
returned as often as they come; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, connected_components, free_names, lean, materialize, maybe_broadcast, table

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Shingles whose bits are counted at once; bounds memory on very long texts.
_CHUNK = 1 << 15
#: Members of one anchor above which they are compared on their own, in blocks.
_SMALL_GROUP = 48


def fingerprint(words: list[bytes], shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority bits of the shingles' XXH64; zero for no words; repeats count."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    votes, total = np.zeros(64, np.int64), len(words) - shingle + 1
    for lo in range(0, total, _CHUNK):
        part = words[lo : lo + _CHUNK + shingle - 1]
        runs = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.array([digest(x, seed) for x in runs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def _words(texts: pa.Array) -> Iterator[list[bytes]]:
    """Lower-cases A-Z only and splits on space and \\t..\\r."""
    lowered = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.binary())
    for text in lowered:
        yield text.as_py().split()


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(w, shingle, seed) for w in _words(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_key"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)``, one row per document; one narrow pass, no shuffle."""
    return _keyed_fingerprints(docs, shingle, seed).drop("text_key")


def _keyed_fingerprints(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``(doc_id, fp, text_key)``, by the hash of the raw text."""
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _text_key(text).alias("text_key"))
    return narrow.mapInArrow(lean(_fingerprint_batches(shingle, seed)), "doc_id long, fp long, text_key long")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def half_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own anchor of each 32-bit half, and (row, anchor) for the later anchors in reach."""
    code, free = half & np.uint32(0x7FFFFFFF), half & np.uint32(0x80000000)
    syndrome = np.zeros(len(half), np.uint32)
    for i in range(31):
        syndrome ^= ((code >> np.uint32(i)) & np.uint32(1)) * np.uint32(i + 1)
    flip = np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1) - 1).astype(np.uint32), 0).astype(np.uint32)
    own = code ^ flip
    rows, anchors = [np.flatnonzero(free == 0)], [(own | np.uint32(0x80000000))[free == 0]]
    for i in range(1, 32):
        j = syndrome ^ np.uint32(i)
        ok = (syndrome > 0) & (j > i)
        other = code[ok] ^ np.uint32(1 << (i - 1)) ^ (np.uint32(1) << (j[ok] - 1)).astype(np.uint32)
        later = other > own[ok]
        rows.append(np.flatnonzero(ok)[later])
        anchors.append((other | free[ok])[later])
    return own | free, np.concatenate(rows), np.concatenate(anchors)


def _replicate(batches):
    """fp -> (anchor, away, fp): away is 0 at the fingerprint's own anchor, else 1."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(fps), 1 << 15):
            part = fps[lo : lo + (1 << 15)]
            out = []
            for side, shift in ((0, 32), (1, 0)):
                half = ((part >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                own, rows, later = half_anchors(half)
                base = np.int64(side) << np.int64(32)
                out.append((own.astype(np.int64) | base, np.zeros(len(part), np.int8), part))
                out.append((later.astype(np.int64) | base, np.ones(len(rows), np.int8), part[rows]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in ([o[0] for o in out], [o[1] for o in out], [o[2].view(np.int64) for o in out])],
                names=["anchor", "away", "fp"],
            )


class _Forest:
    """Labels over one array of members; links only ever lower a label to a linked member's index."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                deeper = label[label]
                if (deeper == label).all():
                    break
                label[:] = deeper


def _link_members(anchor: np.ndarray, away: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between members, of whole anchors sorted with own members first."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    group = np.repeat(np.arange(len(starts)), sizes)
    forest = _Forest(len(anchor))
    live = np.flatnonzero((sizes[group] <= _SMALL_GROUP) & (away == 0))
    for k in range(1, _SMALL_GROUP):
        live = live[live + k < len(anchor)]
        live = live[group[live + k] == group[live]]
        if not len(live):
            break
        near = live[np.bitwise_count(fp[live] ^ fp[live + k]) <= max_bits]
        forest.union(near, near + k)
    for s, n in zip(starts[sizes > _SMALL_GROUP], sizes[sizes > _SMALL_GROUP], strict=True):
        members, own = fp[s : s + n], int((away[s : s + n] == 0).sum())
        mine = _Forest(n)
        step = max(1, (1 << 21) // int(n))
        for lo in range(0, own, step):
            i, j = np.nonzero(np.bitwise_count(members[lo : min(own, lo + step), None] ^ members[None, :]) <= max_bits)
            mine.union(i + lo, j)
        forest.label[s : s + n] = mine.label + s
    linked = np.flatnonzero(forest.label != np.arange(len(anchor)))
    return fp[linked], fp[forest.label[linked]]


def _compare(max_bits: int):
    def run(batches):
        """Streams rows sorted by anchor; holds back only the anchor that a batch ends within."""
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts):
            u, v = _link_members(*(np.concatenate(x) for x in zip(*parts, strict=True)), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            anchor, away, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            if not len(anchor):
                continue
            cut = int(np.searchsorted(anchor, anchor[-1], side="left"))
            if cut:
                held.append((anchor[:cut], away[:cut], fp[:cut]))
                yield flush(held)
                held = []
            elif held and held[-1][0][-1] != anchor[0]:
                yield flush(held)
                held = []
            held.append((anchor[cut:].copy(), away[cut:].copy(), fp[cut:].copy()))
        if held:
            yield flush(held)

    return run


def link_fingerprints(spark: SparkSession, distinct_fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(u, v)``: links that connect exactly the fingerprints reachable by steps of ``max_bits`` bits or fewer."""
    if max_bits > 3:
        raise ValueError("the halves' anchors cover at most three differing bits")
    members = distinct_fps.select("fp").mapInArrow(lean(_replicate), "anchor long, away byte, fp long")
    dealt = members.repartition(F.col("anchor")).sortWithinPartitions("anchor", "away")
    return dealt.mapInArrow(lean(_compare(max_bits)), "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE_WORDS, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per document; component_id is the smallest doc_id reachable."""
    found = _rooted(spark, fingerprints(docs, shingle, seed), max_bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(spark: SparkSession, prints: DataFrame, max_bits: int) -> DataFrame:
    """The fingerprints' rows with the root of their component and its smallest doc_id."""
    bounded_batches(spark)
    fps = materialize(spark, prints, "fingerprints")
    classes = materialize(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "fp-classes")
    roots = connected_components(spark, link_fingerprints(spark, classes, max_bits))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(spark, rooted, "fp-roots")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(rooted.join(lows, "root").select("fp", "root", "component_id"), "fp")


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component, the document with the smallest doc_id stays.

    A document is known by doc_id and raw text. Documents without a doc_id stay, unless their
    component has one with; of a component's rows that share the doc_id that stays, one stays.
    """
    found = materialize(spark, _rooted(spark, _keyed_fingerprints(docs, SHINGLE_WORDS, SEED), MAX_BITS), "near-duplicates")
    gone_id, gone_key, again_id, again_key = free_names(docs, "_gone_id", "_gone_key", "_again_id", "_again_key")
    # texts of a component that share the smallest doc_id, or rows that are the same
    own = found.where("doc_id = component_id").groupBy("root").agg(F.count("*").alias("rows"), F.min("text_key").alias("low_key"))
    twice = materialize(spark, own.where("rows > 1"), "near-twice")
    gone = found.where("component_id is not null and not (doc_id <=> component_id)").select("doc_id", "text_key")
    again = None
    if not twice.isEmpty():
        more = found.where("doc_id = component_id").join(maybe_broadcast(twice), "root")
        again = materialize(spark, more.where("text_key = low_key").select(F.col("doc_id").alias(again_id), F.col("text_key").alias(again_key)).distinct(), "near-again")
        gone = gone.unionByName(more.where("text_key <> low_key").select("doc_id", "text_key"))
    gone = materialize(spark, gone.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct(), "near-gone")
    key = _text_key(F.col("text").cast("string"))
    kept = docs.join(maybe_broadcast(gone), F.col("doc_id").eqNullSafe(F.col(gone_id)) & (key == F.col(gone_key)), "left_anti")
    if again is None:
        return kept
    on = (F.col("doc_id") == F.col(again_id)) & (key == F.col(again_key))
    again = maybe_broadcast(again)
    once = kept.join(again, on, "left_semi").withColumn(again_key, key)
    return kept.join(again, on, "left_anti").unionByName(once.dropDuplicates(["doc_id", again_key]).drop(again_key))
