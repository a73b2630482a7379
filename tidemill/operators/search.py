"""Exact cosine search with metadata filters, and embedding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.sources.scratch import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def scored(vectors: DataFrame, query: Sequence[float], language: str | None = None) -> DataFrame:
    """Adds ``score``; the query's norm is folded into the plan, the language filter reaches the scan."""
    rows = vectors.where(F.col("language") == X.language_filter(language)) if language else vectors
    length = float(np.sqrt(sum(float(v) ** 2 for v in query)))
    if not length:
        raise ValueError("the query vector is zero")
    return rows.withColumn("score", F.try_divide(dot(F.col("embedding"), literal_vector(query)), norm(F.col("embedding")) * length))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, language: str | None = None, glob: str | None = None, overfetch: bool = False) -> DataFrame:
    """The k best rows, by score rounded to three places, then by chunk_id.

    The glob is applied before the cut; with ``overfetch`` it is applied to the 4 k best only.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    order = [F.col("score").desc(), F.col("chunk_id")]
    rows = scored(vectors, query, language).withColumn("score", F.round("score", 3))
    match = F.col("path").rlike(X.glob_to_regex(glob)) if glob else None
    if match is not None and overfetch:
        return rows.orderBy(*order).limit(4 * k).where(match).orderBy(*order).limit(k)
    if match is not None:
        rows = rows.where(match)
    return rows.orderBy(*order).limit(k)


#: Scores that a task holds at once, of a block of queries and a batch of rows (32 MB).
CELLS = 1 << 22
#: Filters that a query may have, and the column of the rows that each looks at.
FILTERS = {"language": "language", "glob": "path"}


def knn(vectors: DataFrame, queries: DataFrame, k: int, max_queries: int = 10_000) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` for a stated set of queries against all rows.

    The queries go to the tasks in blocks of at most ``max_queries``; every row of ``vectors`` is
    scored against a block in a streaming pass that keeps k per query and batch, so at most k rows
    per query and batch are shuffled for the final ranking. With several blocks each one's rows are
    a table, so the driver holds one block. Where queries have a ``language`` or a ``glob``, rows that
    don't fit it are left out before the cut; null fits everything.
    """
    kind = dict(queries.dtypes)["query_id"]
    filters = [c for c in FILTERS if c in queries.columns]
    near, rows = None, queries.select("query_id", "embedding", *filters).toLocalIterator()
    while block := list(islice(rows, max_queries)):
        found = _nearest(vectors, block, k, kind)
        if near is not None or len(block) == max_queries:
            found = materialize(found, "knn")
        near = found if near is None else near.unionByName(found)
    if near is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id string, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(vectors: DataFrame, block: list, k: int, kind: str) -> DataFrame:
    ids = [r[0] for r in block]
    filters = [c for c in FILTERS if c in block[0].__fields__]
    wanted = [tuple(r[c] for c in filters) for r in block]
    columns = {c: FILTERS[c] for c in filters}
    matrix = np.array([r[1] for r in block], dtype=np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            names = rows["chunk_id"].to_numpy()
            place = np.empty(len(names), np.int64)  # of each name in their order
            place[np.argsort(names, kind="stable")] = np.arange(len(names))
            x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            fits = {w: _fits(rows, columns, w) for w in set(wanted)} if columns else {}
            step = max(1, CELLS // len(x))
            for lo in range(0, len(matrix), step):
                out = []
                for i, row in enumerate(np.round(matrix[lo : lo + step] @ x.T, 3), lo):
                    of = fits.get(wanted[i], slice(None))
                    some = row[of]
                    # all that score like the k-th stay until the names have decided
                    least = np.partition(some, -k)[-k] if k < len(some) else -np.inf
                    near = np.arange(len(row))[of][some >= least]
                    top = near[np.lexsort((place[near], -row[near]))[:k]]
                    out.append(pd.DataFrame({"query_id": ids[i], "chunk_id": names[top], "score": row[top]}))
                yield pd.concat(out)

    return vectors.select("chunk_id", "embedding", *columns.values()).mapInPandas(best, f"query_id {kind}, chunk_id string, score double")


def _fits(rows: pd.DataFrame, columns: dict[str, str], wanted: tuple) -> np.ndarray:
    """Which rows of a batch a query's filters let through."""
    out = np.ones(len(rows), bool)
    for (name, column), value in zip(columns.items(), wanted, strict=True):
        if value is not None and name == "language":
            out &= (rows[column] == X.language_filter(value)).to_numpy()
        elif value is not None:
            match = re.compile(X.glob_to_regex(value)).match
            out &= np.fromiter((p is not None and match(p) is not None for p in rows[column]), bool, len(rows))
    return out


def collection_info(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("points"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))


def hash_embedder(dimension: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder: signed counts of hashed words, scaled to length one."""
    import xxhash

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
                out[i, h % dimension] += 1.0 if h >> 63 else -1.0
            length = np.linalg.norm(out[i])
            out[i] /= length if length else 1.0
        return out

    return embed


def embed_rows(rows: DataFrame, column: str, make: Callable[[], Callable[[list[str]], np.ndarray]], dimension: int, batch: int = 256) -> DataFrame:
    """Adds ``embedding``; ``make`` builds the embedder once per task, and it is called with ``batch`` texts at a time."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for part in batches:
            for lo in range(0, len(part), batch):
                some = part.iloc[lo : lo + batch]
                got = embed([t or "" for t in some[column]])
                if got.shape != (len(some), dimension):
                    raise ValueError(f"the embedder gave {got.shape}, not {(len(some), dimension)}")
                yield some.assign(embedding=list(got.astype(np.float32)))

    return rows.mapInPandas(run, schema)
