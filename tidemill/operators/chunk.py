"""Overlapping chunks of characters, as one projection and one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.config import Config
from tidemill.functions import text as X


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def chunk_spans(files: DataFrame, size: int, overlap: int) -> DataFrame:
    """``files`` without content, one row per chunk: chunk_total, chunk_index, chunk, start_line, end_line. Empty texts have none.

    A text is cut into pieces as long as the stride in one pass; a chunk is its first characters of the pieces from its own
    on, and its line the sum of the line ends of those before it, so no chunk goes back to the text's beginning.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    stride = size - overlap
    n = F.when(F.length("content") <= size, 1).otherwise(F.ceil((F.length("content") - size) / stride) + 1).cast("int")
    some = files.where(F.length("content") > 0).withColumn("chunk_total", n)
    some = some.withColumn("_pieces", F.regexp_extract_all("content", F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)))
    some = some.withColumn("_ends", F.transform("_pieces", _newlines))

    def cut(i: Column) -> Column:
        chunk = F.left(F.array_join(F.slice("_pieces", i + 1, F.lit(-(-size // stride))), ""), F.lit(size))
        line = F.aggregate(F.slice("_ends", F.lit(1), i), F.lit(1), lambda total, k: total + k)
        return F.struct(i.alias("chunk_index"), chunk.alias("chunk"), line.alias("start_line"))

    # cut before the explode, so that rows carry their chunk and not the whole text
    others = [c for c in some.columns if c not in ("content", "_pieces", "_ends")]
    each = some.select(*others, F.inline(F.transform(F.sequence(F.lit(0), F.col("chunk_total") - 1), cut)))
    return each.withColumn("end_line", (F.col("start_line") + _newlines(F.col("chunk"))).cast("int"))


def chunk_files(files: DataFrame, config: Config) -> DataFrame:
    """The chunk table, without vectors."""
    ext = F.col("ext")
    rows = chunk_spans(files.select("path", "ext", "content", F.md5("content").alias("file_hash")), config.chunk_size, config.chunk_overlap)
    rows = rows.withColumn("language", X.language_of(ext))
    return rows.select(
        F.concat_ws(":", "path", "chunk_index").alias("chunk_id"),
        F.col("chunk").alias("content"),
        F.col("path").alias("source"),
        "chunk_index",
        "chunk_total",
        "start_line",
        "end_line",
        "file_hash",
        X.content_type(ext).alias("content_type"),
        "language",
        X.chunk_symbol(F.col("chunk"), F.col("language")).alias("symbol"),
    )


def by_ids(chunks: DataFrame, ids: list[str], max_chars: int = 2000) -> DataFrame:
    """Chunks in the order of the request, their text clamped; unknown ids are left out."""
    wanted = chunks.sparkSession.createDataFrame([(i, c) for i, c in enumerate(ids)], "position int, chunk_id string")
    return chunks.join(F.broadcast(wanted), "chunk_id").withColumn("content", X.clamp(F.col("content"), max_chars)).orderBy("position")
