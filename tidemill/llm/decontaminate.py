"""Benchmark decontamination: SimHash over item-sized windows, in DataFrame operations only.

A document is contaminated by a benchmark item if one of its windows, as many words long as
the item, has a weighted similarity of 0.8 or more to it: the sum of the smaller over the sum
of the larger counts of their five-word shingles.

1. Windows. At a similarity of t, ``t (n + w) / (1 + t)`` of a window's w shingles occur in the item
   of n, and moving a window right past a shingle that doesn't occur loses nothing. So windows are
   laid at each shingle that occurs in any item of that width, and at the last start, if enough such
   shingles follow within the window: a look at the sorted places. No start that can reach 0.8 is left
   out, wherever the item's parts stand in the window. This first pass hashes every five words of every
   text and meets the benchmark's shingles in a join whose small side is broadcast after a check of
   its size; beyond that size a set of bits of fixed size leaves out what can't meet before anything is shuffled.
2. Fingerprints. Windows are folded to their distinct contents, so a passage that a third of all
   documents hold is one row. Each content and each item gets ``PRINTS`` 64-bit majority fingerprints
   of its shingles, from independent hashes.
3. Multi-index blocks. A fingerprint is cut into four blocks of 16 bits. Two that differ in no more
   than ``RADIUS`` (15) bits differ in at most three bits of some block; contents meet items of their
   width where a block equals one of the 697 values within three bits of the item's. All fingerprints
   within the radius meet; those beyond are dropped by their exact distance. This generates the
   candidates: which item a window resembles isn't known before.
4. Verification. The exact weighted similarity of each content and item that is left.

At a similarity of 0.8 each bit differs with a probability of 0.15 (the angle between the two sums of votes), so a
fingerprint lies beyond 15 bits in 2.3 per cent and all four in about one case of four million. With few shingles bits
differ more often: four shingles of an item's five differ at 0.19, a fingerprint lies beyond in 13 per cent, and all eight
in about one case of ten million. Of unrelated pairs one in 18 meets in some fingerprint's blocks, and one in 75,000 is
within the radius.

Words are runs of letters and digits, lower-cased. Defined results: a null text counts as
empty and matches nothing; a text shorter than the item is one window; an item of fewer than five
words is one shingle of all its words; an item without words matches nothing; repeated rows
give one finding; a null doc_id stays null; empty tables give an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, free_names, is_small, materialize, maybe_broadcast, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
PRINTS = 4
#: Windows and items of at most so many shingles get more fingerprints, as their bits differ more often.
SHORT, SHORT_PRINTS = 16, 8
BLOCK_BITS = 16
#: Bits of the set that stands before the join with a large benchmark's shingles.
BITS = 1 << 24
BLOCKS = 64 // BLOCK_BITS


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, without the empty strings that the split leaves at either end."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def grams(hashes: str, k: int) -> Column:
    """Hashes of every k words in a row; empty if there are fewer."""
    inner = ", ".join(f"a[i + {j}]" for j in range(k))
    return F.expr(f"transform(array({hashes}), a -> IF(size(a) < {k}, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, size(a) - {k}), i -> xxhash64({inner}))))[0]")


def fingerprints(contents: DataFrame, prints: int = PRINTS, short_prints: int | None = None) -> DataFrame:
    """``(content, k, width, print, fp)``: the bits that are set in over half of a row's shingles, for each of ``prints`` hashes (``short_prints`` for the short ones).

    Counts are sums of packed lanes, two of 32 bits in a number, so an aggregation of 32 sums counts 64 bits.
    """
    votes = contents.select("content", "k", "width", F.size("shingles").alias("size"), F.explode("shingles").alias("h"))
    # both sides of a pair have one width, and so the same number of fingerprints
    most = f"IF(width - k + 1 <= {SHORT}, {short_prints or prints}, {prints}) - 1"
    hashes = F.expr(f"transform(sequence(0, {most}), i -> named_struct('print', i, 'g', IF(i = 0, h, xxhash64(h, i))))")
    votes = votes.select("content", "k", "width", "size", F.explode(hashes).alias("v")).select("content", "k", "width", "size", "v.print", "v.g")
    lanes = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned("g", b).bitwiseAND(lanes)).alias(f"s{b}") for b in range(32)]
    counted = votes.groupBy("content", "k", "width", "size", "print").agg(*sums).select("content", "k", "width", "size", "print", F.array(*(f"s{b}" for b in range(32))).alias("s"))
    fp = F.expr("aggregate(sequence(0, 63), 0L, (fp, b) -> fp | IF(2 * (shiftrightunsigned(s[b % 32], b - b % 32) & 4294967295L) > size, shiftleft(1L, b), 0L))")
    return counted.select("content", "k", "width", "print", fp.alias("fp"))


def weighted_similarity(a: str, b: str) -> Column:
    """Sum of the smaller over sum of the larger counts of two arrays of hashes."""
    shared = f"aggregate(array_intersect({a}, {b}), 0, (n, g) -> n + least(size(filter({a}, x -> x = g)), size(filter({b}, x -> x = g))))"
    return F.expr(f"CAST({shared} AS DOUBLE) / (size({a}) + size({b}) - {shared})")


def _block_keys(near: int) -> Column:
    """Keys of a fingerprint's blocks, with all values within ``near`` bits of a block's; a key is of one hash, ``k`` and ``width``."""
    mask = (1 << BLOCK_BITS) - 1
    # by the rule, once, not in each row
    flips = ", ".join(str(x) for x in range(mask + 1) if x.bit_count() <= near)
    value = f"CAST(shiftrightunsigned(fp, b * {BLOCK_BITS}) & {mask} AS INT) ^ x"
    return F.expr(f"flatten(transform(sequence(0, {BLOCKS - 1}), b -> transform(array({flips}), x -> xxhash64(k, width, print, b, {value}))))")


def prepare_items(spark: SparkSession, items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(item_id, content, k, width, shingles)`` of every item with words; k is the words of its shingles."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("h")).where("size(h) > 0")
    sized = words.select("item_id", F.size("h").alias("width"), F.least(F.lit(shingle), F.size("h")).alias("k"), "h")
    shingles = F.coalesce(*(F.when(F.col("k") == k, grams("h", k)) for k in range(1, shingle + 1)))
    known = sized.select("item_id", "width", "k", shingles.alias("shingles"))
    return materialize(spark, known.select("item_id", F.xxhash64("k", "width", "shingles").alias("content"), "k", "width", "shingles").distinct(), "items")


def window_starts(places: str, n: str, m: str, similarity: float) -> Column:
    """Starts of windows of ``n`` shingles that can be similar enough, from the sorted places of known shingles in a text of ``m``."""
    need = f"CAST(ceil(2 * {n} * {similarity} / (1 + {similarity}) - 1e-9) AS INT)"
    dense = f"filter({places}, (p, i) -> p <= {m} - {n} AND get({places}, i + {need} - 1) < p + {n})"
    last = f"greatest(0, {m} - {n})"
    short = f"size(filter({places}, p -> p >= {last})) * (1 + {similarity}) >= ({n} + least({n}, {m})) * {similarity} - 1e-9"
    return F.expr(f"array_distinct(concat({dense}, IF({short}, array({last}), CAST(array() AS ARRAY<INT>))))")


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _bits(grams: DataFrame) -> DataFrame:
    """One row with a set of ``BITS`` bits, of which those of the low digits of ``grams(gram)`` are set: 2 MB, whatever their number."""
    at = F.col("gram").bitwiseAND(F.lit(BITS - 1))
    words = grams.select(F.shiftright(at, 6).alias("id"), F.expr("shiftleft(1L, CAST(gram & 63 AS INT))").alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("word"))
    dense = grams.sparkSession.range(BITS // 64).join(words, "id", "left").select(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")).alias("w"))
    return dense.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["word"]).alias("bits"))


def _windows(docs: DataFrame, known: DataFrame, sizes: list[int], similarity: float) -> DataFrame:
    """``(doc_id, text_key, k, width, start)``: where windows are to be laid."""
    hashed = _narrow(docs).select("doc_id", "text_key", word_hashes(F.col("text")).alias("h"))
    spark = docs.sparkSession
    places = materialize(spark, known.select("k", "width", F.explode("shingles").alias("gram")).distinct(), "known-grams")
    few = is_small(places, BROADCAST_ROWS)
    # of a large benchmark the bits of its shingles tell most of the texts' apart before any row moves
    known_bits = None if few else materialize(spark, _bits(places.select("gram")), "known-bits").scalar()
    hits = None
    for k in sizes:
        spread = hashed.select("doc_id", "text_key", (F.size("h") - (k - 1)).alias("m"), F.posexplode(grams("h", k)).alias("place", "gram"))
        if known_bits is not None:
            word = F.get(known_bits, F.shiftright(F.col("gram").bitwiseAND(F.lit(BITS - 1)), 6).cast("int"))
            spread = spread.where(word.bitwiseAND(F.expr("shiftleft(1L, CAST(gram & 63 AS INT))")) != 0)
        own = places.where(F.col("k") == k)
        met = spread.join(F.broadcast(own) if few else own, "gram").select("doc_id", "text_key", "k", "width", "m", "place")
        hits = met if hits is None else hits.unionByName(met)
    found = hits.groupBy("doc_id", "text_key", "k", "width").agg(F.sort_array(F.collect_set("place")).alias("places"), F.max("m").alias("m"))
    starts = window_starts("places", "(width - k + 1)", "m", similarity)
    return found.select("doc_id", "text_key", "k", "width", F.explode(starts).alias("start"))


def candidates(spark: SparkSession, printed: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(content, item, bits)``: contents and items of which a fingerprint is within the radius; bits is the smallest distance.

    The items' keys are a table first, so that plans know their true size.
    """
    theirs = materialize(spark, items.select(F.col("content").alias("item"), F.col("fp").alias("item_fp"), F.explode(_block_keys(radius // BLOCKS)).alias("key")), "item-keys")
    mine = printed.select("content", "fp", F.explode(_block_keys(0)).alias("key"))
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = mine.join(maybe_broadcast(theirs), "key").where(bits <= radius)
    return near.groupBy("content", "item").agg(F.min(bits).cast("int").alias("bits"))


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    shingle: int = SHINGLE,
    prints: int = PRINTS,
) -> DataFrame:
    """``(doc_id, text_key, item_id, start_word, bits, similarity)``: each contaminated text's best window for an item."""
    if not 0 <= radius < 16 or not 1 <= prints:
        raise ValueError("the blocks cover radii under 16, of one fingerprint or more")
    known = prepare_items(spark, items, shingle)
    sizes = sorted(r[0] for r in known.select("k").distinct().collect()) or [shingle]
    windows = materialize(spark, _windows(docs, known, sizes, similarity), "windows")

    # the texts that windows are laid on, once more
    laid = windows.select("text_key", "k", "width", "start").distinct()
    asked = laid.select(F.col("text_key").alias("own_key")).distinct()
    again = _narrow(docs).select(F.col("text_key").alias("own_key"), "text").join(maybe_broadcast(asked), "own_key", "left_semi").dropDuplicates(["own_key"])
    hashed = again.join(laid, F.col("own_key") == F.col("text_key")).select("text_key", "k", "width", "start", word_hashes(F.col("text")).alias("h"))
    shingles = F.coalesce(*(F.when(F.col("k") == k, grams("slice(h, start + 1, width)", k)) for k in sizes))
    cut = hashed.select("text_key", "k", "width", "start", shingles.alias("shingles"))
    cut = materialize(spark, cut.select("*", F.xxhash64("k", "width", "shingles").alias("content")), "window-shingles")

    contents = materialize(spark, cut.dropDuplicates(["content"]).select("content", "k", "width", "shingles"), "window-contents")
    printed = materialize(spark, fingerprints(contents, prints, max(prints, SHORT_PRINTS)), "fingerprinted")
    items_printed = materialize(spark, fingerprints(known.dropDuplicates(["content"]), prints, max(prints, SHORT_PRINTS)), "items-fingerprinted")
    near = materialize(spark, candidates(spark, printed, items_printed, radius), "candidates")
    pairs = near.join(contents.select(F.col("content").alias("_c"), "shingles"), F.col("content") == F.col("_c"))
    theirs = known.dropDuplicates(["content"]).select(F.col("content").alias("_i"), F.col("shingles").alias("item_shingles"))
    pairs = pairs.join(theirs, F.col("item") == F.col("_i"))
    scored = pairs.select("content", "item", "bits", weighted_similarity("shingles", "item_shingles").alias("similarity")).where(F.col("similarity") >= similarity - 1e-9)
    scored = materialize(spark, scored, "contamination")

    # back to items and documents
    named = scored.join(known.select(F.col("content").alias("_i"), "item_id"), F.col("item") == F.col("_i")).select(F.col("content").alias("_c"), "item_id", "bits", "similarity")
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"), F.col("bits"))).alias("best")
    of_text = cut.select("text_key", "start", "content").join(named, F.col("content") == F.col("_c")).groupBy("text_key", "item_id").agg(best)
    of_text = of_text.select(F.col("text_key").alias("_t"), "item_id", "best")
    found = windows.select("doc_id", "text_key").distinct().join(of_text, F.col("text_key") == F.col("_t"))
    return found.select("doc_id", "text_key", "item_id", (-F.col("best.s")).alias("start_word"), F.col("best.bits").alias("bits"), F.col("best.similarity").alias("similarity"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "bits", "similarity")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    found = find_contamination(spark, docs, table(spark, sf_dir, "benchmark"))
    gone_id, gone_key = free_names(docs, "_gone_id", "_gone_key")
    gone = materialize(spark, found.select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct(), "contaminated")
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    on = docs["doc_id"].eqNullSafe(F.col(gone_id)) & (key == F.col(gone_key))
    return docs.join(maybe_broadcast(gone), on, "left_anti")
