"""Context assembly under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import text as X

SNIPPET = 400
PER_FILE = 3


def result_json() -> Column:
    """A scored chunk as it is delivered; its cost is counted on this text."""
    return F.to_json(F.struct("chunk_id", "path", F.round("score", 3).alias("score"), "start_line", "end_line", "language", X.clamp(F.col("content"), SNIPPET).alias("snippet")))


#: Chunks without a cost that a budget takes at most.
FREE = 1_000


def per_file_cap(chunks: DataFrame, cap: int = PER_FILE) -> DataFrame:
    """The best ``cap`` chunks of each path."""
    w = Window.partitionBy("path").orderBy(F.desc("score"), "chunk_id")
    return chunks.withColumn("file_rank", F.row_number().over(w)).where(F.col("file_rank") <= cap)


def pack(chunks: DataFrame, tokens: str, limit: int) -> DataFrame:
    """Chunks in order of score while what came before them is under the limit.

    At most ``limit`` chunks that cost something can be packed, and ``FREE`` of those that cost nothing (or
    whose cost is null) are: a top-k, of which each task gives its own, comes before the one ordered window.
    """
    cost = F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0))
    best = lambda rows, n: rows.orderBy(F.desc("score"), "chunk_id").limit(max(0, n))
    chunks = best(chunks.where(cost > 0), limit).unionByName(best(chunks.where(cost <= 0), FREE))
    w = Window.orderBy(F.desc("score"), "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("used_before", F.coalesce(F.sum(cost).over(w), F.lit(0))).where(F.col("used_before") < limit)


def select_chunks(candidates: DataFrame, budget: int, cap: int = PER_FILE, share: int = 60) -> DataFrame:
    costed = candidates.withColumn("tokens", X.token_estimate(result_json(), F.lit("text")))
    return pack(per_file_cap(costed, cap), "tokens", budget * share // 100)


def metrics(candidate: int, selected: int, used: int, baseline: int) -> dict[str, float]:
    """Savings against reading the matched files whole; zero where there is nothing to divide by."""
    saved = max(0, baseline - used)
    return {
        "candidate_tokens": candidate,
        "selected_tokens": selected,
        "used_tokens": used,
        "baseline_tokens": baseline,
        "saved_tokens": saved,
        "saved_percent": round(saved * 100 / baseline, 2) if baseline else 0.0,
        "saving_ratio": round(baseline / used, 2) if used else 0.0,
        "trim_percent": round(max(0, candidate - selected) * 100 / candidate, 2) if candidate else 0.0,
    }


def metric_columns(candidate: Column, selected: Column, used: Column, baseline: Column) -> list[Column]:
    saved = F.greatest(baseline - used, F.lit(0))
    zero = F.lit(0.0)
    return [
        saved.alias("saved_tokens"),
        F.coalesce(F.round(F.try_divide(saved * 100.0, baseline), 2), zero).alias("saved_percent"),
        F.coalesce(F.round(F.try_divide(baseline * 1.0, used), 2), zero).alias("saving_ratio"),
        F.coalesce(F.round(F.try_divide(F.greatest(candidate - selected, F.lit(0)) * 100.0, candidate), 2), zero).alias("trim_percent"),
    ]
