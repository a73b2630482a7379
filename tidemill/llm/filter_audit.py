"""Filter interaction audit: what each of five filters removes, in all 120 orders.

A relational word pipeline. Texts are dealt by document, their words exploded and aggregated by
(document, word) and then by document, which gives totals and distinct words; the other flags are
columns of a second, narrow pass that is outer-joined to them. A document's five failures make a
number from 0 to 31; per part, 32 conditional counts of it (and as many of the good and of the
toxic documents) hold all that any order of the filters can tell, so the 600 rows of a part are
sums over its counts and no order looks at a document again.

Scale. Whole texts move once. A word stands for its 64-bit hash within its document (two of a
document's words share one in about d*d / 2^65 cases of d distinct words). Documents are dealt by
id, text and the partition that they were read from, so that a row that a third of a table repeats is
spread over it. Copies are found by SHA-256; only hashes that occur under several ids are joined
back, in a plain join whose hot keys adaptive execution may split. Parts are folded before they move.

Defined results: a null text counts as empty and fails A only (unless its copies make it fail E); a
null source is the part ''; a null doc_id is smaller or larger than none, so such a row never fails
E and has no labels; repeated rows count as often as they come, and are no copies of each other; of
repeated labels of a document one that says 1 is enough; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SPACES = " \t\n\x0b\f\r"


def _rows(docs: DataFrame) -> DataFrame:
    """One row per document: key (a, b) of its id and text, at (the partition it is read from), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    # a row without an id is known by two hashes of its text
    key = F.coalesce(doc_id, F.xxhash64(F.lit("null"), text))
    return docs.select(key.alias("a"), F.xxhash64(text).alias("b"), doc_id.alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """``(a, b, words, distinct_words)``: totals and distinct words of each document, by (document, word) first."""
    begun = F.ltrim("text", F.lit(SPACES))
    # exactly one empty word a row, at its end: it counts the rows of a key
    words = F.split(F.when(begun == "", "").otherwise(F.concat(begun, F.lit(" "))), f"[{SPACES}]+")
    dealt = rows.select("a", "b", F.spark_partition_id().alias("at"), "text").repartition("a", "b", "at")
    exploded = dealt.select("a", "b", "at", F.explode(words).alias("word")).select("a", "b", "at", F.xxhash64("word").alias("word"))
    by_word = exploded.groupBy("a", "b", "at", "word").agg(F.count("*").alias("n"))
    empty = F.col("word") == F.xxhash64(F.lit(""))
    by_row = by_word.groupBy("a", "b", "at").agg(F.sum("n").alias("n"), F.sum(F.when(empty, F.col("n"))).alias("rows"), F.count("*").alias("kinds"))
    each = by_row.select("a", "b", F.expr("(n - rows) div rows").alias("words"), (F.col("kinds") - 1).alias("distinct_words"))
    return each.groupBy("a", "b").agg(F.max("words").alias("words"), F.max("distinct_words").alias("distinct_words"))


def failures(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask, n)``: rows of an id and part that fail alike; bit i of mask is set if the i-th filter fails."""
    rows = _rows(docs)
    capitals = 100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITALS_PERCENT * F.length("text")
    marks = F.col("text").rlike("[#$%&*|]")
    flags = rows.select("a", "b", "doc_id", "part", (F.when(capitals, 4).otherwise(0) + F.when(marks, 8).otherwise(0)).alias("own"), F.unhex(F.sha2("text", 256)).alias("sha"))
    flags = flags.groupBy("a", "b", "doc_id", "part", "own", "sha").agg(F.count("*").alias("n"))
    copied = flags.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("last_id > first_id").select("sha", "first_id")
    flags = flags.join(copied, "sha", "left")
    counted = flags.join(word_counts(rows), ["a", "b"], "left")
    few = F.when(F.coalesce("words", F.lit(0)) < MIN_WORDS, 1).otherwise(0)
    repetitive = F.when(100 * F.col("distinct_words") < MIN_DISTINCT_PERCENT * F.col("words"), 2).otherwise(0)
    copy = F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0)
    return counted.select("doc_id", "part", (few + repetitive + F.col("own") + copy).alias("mask"), "n")


def _over(counts: str, which: str) -> Column:
    """The sum of the counts of the masks ``m`` for which the condition holds."""
    return F.expr(f"aggregate(sequence(0, 31), 0L, (x, m) -> x + IF({which}, {counts}[m], 0L))")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report: a row per part, order and step."""
    told = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality"), F.col("toxic"))
    told = told.groupBy("labelled").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failures(docs).join(told, F.col("doc_id") == F.col("labelled"), "left")
    cells = []
    for name, only in (("c", F.lit(True)), ("g", F.col("good")), ("t", F.col("toxic"))):
        cells += [F.sum(F.when((F.col("mask") == m) & only, F.col("n")).otherwise(0)).alias(f"{name}{m}") for m in range(32)]
    parts = rows.groupBy("part").agg(*cells).select("part", *(F.array(*(F.col(f"{name}{m}") for m in range(32))).alias(name) for name in "cgt"))

    bit = "shiftleft(1, instr('ABCDE', {}) - 1)"
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(ORDERS)), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("own", F.expr(bit.format("substr(filter_order, step, 1)")))
    steps = steps.withColumn("before", F.expr(f"aggregate(IF(step > 1, sequence(1, step - 1), CAST(array() AS ARRAY<INT>)), 0, (x, i) -> x | {bit.format('substr(filter_order, i, 1)')})"))
    here = "(m & own) <> 0 AND (m & before) = 0"
    # a document that fails k filters goes by each of them in 120 / k of the orders
    shapley = F.expr(f"aggregate(sequence(0, 31), 0L, (x, m) -> x + IF((m & own) <> 0, c[m] * {len(ORDERS)} div bit_count(m), 0L))")
    return steps.select(
        "part", "filter_order", "step",
        _over("c", "(m & (own | before)) = 0").alias("kept"), _over("c", here).alias("removed"),
        _over("c", "(m & own) <> 0 AND (m & before) <> 0").alias("redundant"), _over("c", "m = own").alias("unique_fails"),
        _over("g", here).alias("good_lost"), _over("t", here).alias("toxic_lost"), shapley.alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = (
    """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * strlen(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL
), o AS (SELECT unnest(string_split('"""
    + " ".join(ORDERS)
    + """', ' ')) AS filter_order),
s AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS step FROM o),
b AS (
  SELECT filter_order, step, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS own,
         CAST(list_sum([0] || list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', substr(filter_order, i, 1)) - 1))) AS INT) AS before
  FROM s
)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (WHERE (mask & (own | before)) = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (WHERE (mask & own) <> 0 AND (mask & before) = 0), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (WHERE (mask & own) <> 0 AND (mask & before) <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (WHERE mask = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(n) FILTER (WHERE (mask & own) <> 0 AND (mask & before) = 0 AND good), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(n) FILTER (WHERE (mask & own) <> 0 AND (mask & before) = 0 AND toxic), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum((n * 120) // greatest(bit_count(mask), 1)) FILTER (WHERE (mask & own) <> 0), 0) AS BIGINT) AS shapley
FROM m, b GROUP BY part, filter_order, step
"""
)
