"""The engine's queries over the test tables, each with its SQL oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import code_corpus
from tidemill.config import Config
from tidemill.corpus import base, derive, duckdb_lines, with_ctes
from tidemill.functions import rules
from tidemill.functions import text as X
from tidemill.operators import ann, bundle, chunk, diff, graph, ingest, parse, ranges, requests, scan, search, skeleton, state, walks
from tidemill.sources.scratch import scratch
from tidemill.sources.store import IndexStore
from tidemill.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SCAN = Config(include_extensions=["rs", "py", "js", "md", "toml", "html"], max_file_kb=8)
NAME = "fn_7"
HUB = "new"
PATH = "src/m7.rs"


def query(oracle: str | None = None, name: str | None = None):
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return add


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(base(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


# --- search ---------------------------------------------------------------------------------

_SCORED = with_ctes("vectors") + (
    ", s AS (SELECT chunk_id, path, language, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 3) AS score "
    "FROM vectors v CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q) "
)


@query(_SCORED + "SELECT chunk_id, path, score FROM s ORDER BY score DESC, chunk_id LIMIT 20")
def cosine_topk(spark, d):
    return search.top_k(derive(spark, d, "vectors"), query_vector(spark, d), 20).select("chunk_id", "path", "score")


@query(_SCORED + "SELECT chunk_id, language, score FROM s WHERE language = 'rust' ORDER BY score DESC, chunk_id LIMIT 20")
def cosine_topk_filtered(spark, d):
    return search.top_k(derive(spark, d, "vectors"), query_vector(spark, d), 20, language="rs").select("chunk_id", "language", "score")


@query(_SCORED + "SELECT chunk_id, score FROM s WHERE lower(path) LIKE 'src/l1/%7%.rs' ORDER BY score DESC, chunk_id LIMIT 10")
def cosine_topk_glob(spark, d):
    return search.top_k(derive(spark, d, "vectors"), query_vector(spark, d), 10, glob="SRC/l1/*7*.rs").select("chunk_id", "score")


@query(_SCORED + "SELECT chunk_id, score FROM (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 40) WHERE lower(path) LIKE 'src/l1/%.rs' ORDER BY score DESC, chunk_id LIMIT 10")
def cosine_topk_overfetch(spark, d):
    return search.top_k(derive(spark, d, "vectors"), query_vector(spark, d), 10, glob="src/l1/*.rs", overfetch=True).select("chunk_id", "score")


@query(
    with_ctes("vectors")
    + """, s AS (SELECT q.vec_id AS query_id, v.chunk_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 3) AS score
         FROM vectors v CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q),
       r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s)
       SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 5"""
)
def batch_knn(spark, d):
    vectors = derive(spark, d, "vectors")
    return search.knn(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


_NEAREST = (
    with_ctes("vectors")
    + """, s AS (SELECT q.vec_id AS query_id, v.chunk_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 3) AS score
         FROM vectors v CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q),
       r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s), n AS (SELECT * FROM r WHERE rank <= 5) """
)
RECALL = 0.9


def _ivf(spark, d):
    vectors = derive(spark, d, "vectors")
    index = ann.IvfIndex.build(vectors, scratch(spark, "ivf"))
    return index, vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(_NEAREST + "SELECT query_id, chunk_id, score, rank FROM n")
def ivf_knn_all_cells(spark, d):
    """Every cell probed and every row on the shortlist: the index gives what exact search gives."""
    index, vectors, queries = _ivf(spark, d)
    return index.knn(queries, 5, len(index.quantiser.cells), vectors.count())


@query(_NEAREST + f"SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, {RECALL} <= 1 AS recall_reached FROM n")
def ivf_recall(spark, d):
    """Exact neighbours of every twentieth row that the index finds, with probes and a shortlist that find 95 in a hundred of a few rows'."""
    index, vectors, queries = _ivf(spark, d)
    exact = search.knn(vectors, queries, 5)
    hit = ann.hits(exact, index.knn(queries, 5, *index.tuned(0.95, 5)))
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.count_if("hit") >= RECALL * F.count("*")).alias("recall_reached"))


@query("SELECT count(*) AS points, CAST(max(len(embedding)) AS INT) AS dimension FROM embeddings")
def collection_info(spark, d):
    return search.collection_info(derive(spark, d, "vectors"))


# --- chunks ---------------------------------------------------------------------------------

_CHUNKS = with_ctes("files") + (
    ", c AS (SELECT path, ext, content, CASE WHEN length(content) <= 700 THEN 1 ELSE CAST(ceil((length(content) - 700) / 620.0) AS INT) + 1 END AS n FROM files WHERE length(content) > 0), "
    "k AS (SELECT path, ext, content, n, CAST(i AS INT) AS i, substr(content, i * 620 + 1, 700) AS chunk FROM c, LATERAL (SELECT unnest(range(0, n)) AS i)) "
)


@query(_CHUNKS + "SELECT path || ':' || i AS chunk_id, i AS chunk_index, CAST(n AS INT) AS chunk_total, md5(chunk) AS chunk_md5, md5(content) AS file_hash FROM k")
def doc_chunks(spark, d):
    rows = chunk.chunk_files(derive(spark, d, "files"), Config())
    return rows.select("chunk_id", "chunk_index", "chunk_total", F.md5("content").alias("chunk_md5"), "file_hash")


@query(
    _CHUNKS
    + """SELECT path || ':' || i AS chunk_id, CAST(length(substr(content, 1, i * 620)) - length(replace(substr(content, 1, i * 620), chr(10), '')) + 1 AS INT) AS start_line,
         CAST(length(substr(content, 1, i * 620)) - length(replace(substr(content, 1, i * 620), chr(10), '')) + 1 + length(chunk) - length(replace(chunk, chr(10), '')) AS INT) AS end_line FROM k"""
)
def doc_chunk_lines(spark, d):
    return chunk.chunk_files(derive(spark, d, "files"), Config()).select("chunk_id", "start_line", "end_line")


_IDS = ["src/src1/doc_1.py:0", "src/src2/doc_2.js:0", "src/src3/doc_3.ts:1", "src/src9/doc_9.json:2", "missing:0"]


@query(_CHUNKS + f"SELECT path || ':' || i AS chunk_id, CASE WHEN length(chunk) > 300 THEN substr(chunk, 1, 300) || '…' ELSE chunk END AS content FROM k WHERE path || ':' || i IN ({', '.join(repr(i) for i in _IDS)})")
def chunks_by_id(spark, d):
    return chunk.by_ids(chunk.chunk_files(derive(spark, d, "files"), Config()), _IDS, 300).select("chunk_id", "content")


@query(_CHUNKS + "SELECT path || ':' || i AS chunk_id, CASE WHEN length(chunk) > 400 THEN substr(chunk, 1, 400) || '…' ELSE chunk END AS snippet FROM k")
def snippet_clamp(spark, d):
    rows = chunk.chunk_files(derive(spark, d, "files"), Config())
    return rows.select("chunk_id", X.clamp(F.col("content"), 400).alias("snippet"))


# --- scan and state -------------------------------------------------------------------------


@query(with_ctes("files") + "SELECT path, md5(content) AS hash FROM files")
def doc_hash(spark, d):
    return state.hashed(derive(spark, d, "files")).select("path", "hash")


_STATE = with_ctes("files", "index_state")


@query(_STATE + "SELECT f.path, md5(f.content) AS hash FROM files f LEFT JOIN index_state s USING (path) WHERE s.hash IS NULL OR s.hash <> md5(f.content)")
def doc_dirty(spark, d):
    return state.dirty(derive(spark, d, "files"), derive(spark, d, "index_state")).select("path", "hash")


@query(_STATE + "SELECT s.path FROM index_state s ANTI JOIN files f USING (path)")
def doc_stale(spark, d):
    return state.stale(derive(spark, d, "files"), derive(spark, d, "index_state"))


@query(
    _STATE
    + """, x AS (SELECT coalesce(f.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted' WHEN md5(f.content) <> s.hash THEN 'changed' ELSE 'same' END AS status
         FROM files f FULL JOIN index_state s ON f.path = s.path) SELECT path, status FROM x"""
)
def doc_changeset(spark, d):
    return state.changeset(derive(spark, d, "files"), derive(spark, d, "index_state")).select("path", "status")


@query(_STATE + "SELECT count(*) FILTER (WHERE f.path IS NULL OR (s.path IS NOT NULL AND md5(f.content) <> s.hash)) AS dirty, count(*) FILTER (WHERE s.path IS NULL) AS new FROM files f FULL JOIN index_state s ON f.path = s.path")
def dirty_count(spark, d):
    changes = state.changeset(derive(spark, d, "files"), derive(spark, d, "index_state"))
    return changes.agg(F.count_if(F.col("status").isin("changed", "deleted")).alias("dirty"), F.count_if(F.col("status") == "new").alias("new"))


@query(_STATE + "SELECT bool_or(s.hash IS DISTINCT FROM md5(f.content)) AS any_dirty FROM files f LEFT JOIN index_state s USING (path)")
def any_dirty(spark, d):
    joined = state.hashed(derive(spark, d, "files")).join(derive(spark, d, "index_state").select("path", F.col("hash").alias("h")), "path", "left")
    return joined.agg(F.bool_or(~F.col("hash").eqNullSafe(F.col("h"))).alias("any_dirty"))


@query(_STATE + "SELECT path, hash FROM index_state ANTI JOIN (SELECT path FROM files WHERE ext = 'rs') t USING (path) UNION ALL SELECT path, md5(content) FROM files WHERE ext = 'rs'")
def state_replace(spark, d):
    fresh = state.hashed(derive(spark, d, "files").where("ext = 'rs'")).select("path", "hash")
    return state.replace_rows(derive(spark, d, "index_state"), fresh, fresh.select("path"), "path")


_REASON = (
    with_ctes("files")
    + """, r AS (SELECT path, CASE
      WHEN list_has_any(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), ['node_modules', 'target', 'dist', 'build', 'vendor']) THEN 'excluded_dir'
      WHEN ext NOT IN ('rs', 'py', 'js', 'md', 'toml', 'html') THEN 'extension'
      WHEN floor(size_bytes / 1024.0) > 8 THEN 'too_large'
      WHEN strpos(content, chr(0)) > 0 THEN 'binary'
      WHEN path LIKE '%.min.js' THEN 'minified' ELSE 'indexed' END AS reason FROM files) """
)


@query(_REASON + "SELECT reason, count(*) AS n FROM r GROUP BY reason")
def skip_stats(spark, d):
    return scan.skip_stats(derive(spark, d, "files"), SCAN)


@query(_REASON + "SELECT path FROM r WHERE reason = 'indexed'")
def indexable_files(spark, d):
    return scan.indexable(derive(spark, d, "files"), SCAN).select("path")


@query(with_ctes("files") + "SELECT ext, count(*) AS n FROM files GROUP BY ext")
def ext_tally(spark, d):
    return scan.extension_tally(derive(spark, d, "files"))


@query(with_ctes("files") + "SELECT path, CAST(max(length(l)) AS INT) AS longest, CAST(count(*) AS INT) AS n_lines, CAST(max(length(content)) AS INT) AS n_chars FROM (SELECT path, content, unnest(string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))) AS l FROM files WHERE content <> '') GROUP BY path")
def line_measures(spark, d):
    lines = X.lines_of(F.col("content"))
    return derive(spark, d, "files").where("content <> ''").select("path", F.array_max(F.transform(lines, F.length)).alias("longest"), F.size(lines).alias("n_lines"), F.length("content").alias("n_chars"))


# --- scalar functions -----------------------------------------------------------------------

_LANGUAGE = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts)}) THEN '{k}'" for k, exts in rules.EXTENSION_LANGUAGE.items()) + " ELSE 'text' END"
_TYPE = f"CASE WHEN ext IN ({', '.join(map(repr, rules.DOCUMENTATION))}) THEN 'documentation' WHEN ext IN ({', '.join(map(repr, rules.CONFIGURATION))}) THEN 'config' ELSE 'code' END"
_TOKENS = f"CAST(ceil(length(content) / CASE WHEN regexp_matches(lower(content), '{rules.TURKISH}') THEN 3.0 WHEN {_LANGUAGE} IN ('markdown', 'text') THEN 4.0 ELSE 3.5 END) AS BIGINT)"


@query(with_ctes("files") + f"SELECT {_LANGUAGE} AS language, count(*) AS n FROM files GROUP BY 1")
def lang_counts(spark, d):
    return derive(spark, d, "files").groupBy(X.language_of(X.extension(F.col("path"))).alias("language")).agg(F.count("*").alias("n"))


@query(with_ctes("files") + f"SELECT {_TYPE} AS content_type, count(*) AS n FROM files GROUP BY 1")
def content_types(spark, d):
    return derive(spark, d, "files").groupBy(X.content_type(F.col("ext")).alias("content_type")).agg(F.count("*").alias("n"))


@query(with_ctes("files") + f"SELECT path, {_TOKENS} AS tokens, CAST(ceil(length(content) / 4.0) AS BIGINT) AS simple FROM files")
def token_estimate(spark, d):
    files = derive(spark, d, "files")
    return files.select("path", X.token_estimate(F.col("content"), X.language_of(F.col("ext"))).alias("tokens"), X.simple_tokens(F.col("content")).alias("simple"))


@query(with_ctes("files") + "SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, CAST(len(string_split(path, '/')) - 1 AS INT) AS depth, ext FROM files")
def path_parts(spark, d):
    return derive(spark, d, "files").select("path", X.parent_dir(F.col("path")).alias("parent"), X.depth(F.col("path")).alias("depth"), X.extension(F.col("path")).alias("ext"))


@query(with_ctes("files") + "SELECT path, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS flat FROM files")
def collapse_space(spark, d):
    return derive(spark, d, "files").select("path", X.collapse_space(F.col("content")).alias("flat"))


@query(with_ctes("files") + "SELECT path, '<\"' || path || '\">' AS quoted, path AS bare, list_filter(string_split_regex(path, '[/.\\\\]'), lambda x: x <> '')[-1] AS leaf FROM files")
def module_leaf(spark, d):
    rows = derive(spark, d, "files").select("path", F.concat(F.lit('<"'), "path", F.lit('">')).alias("quoted"))
    bare = X.strip_quotes(F.col("quoted"))
    return rows.select("path", "quoted", bare.alias("bare"), X.path_leaf(bare).alias("leaf"))


# --- graph ----------------------------------------------------------------------------------

_SYMBOLS = with_ctes("symbols")
_GRAPH = with_ctes("symbols", "symbol_calls")
_IMPORTS = with_ctes("symbol_imports")


@query(with_ctes("symbols", "symbol_calls", "symbol_imports") + "SELECT 'symbols' AS what, count(*) AS n FROM symbols UNION ALL SELECT 'calls', count(*) FROM symbol_calls UNION ALL SELECT 'imports', count(*) FROM symbol_imports")
def graph_totals(spark, d):
    return graph.graph_totals(*(derive(spark, d, t) for t in ("symbols", "symbol_calls", "symbol_imports")))


@query(_SYMBOLS + "SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def kind_counts(spark, d):
    return graph.kind_counts(derive(spark, d, "symbols"))


@query(_GRAPH + "SELECT callee_name, count(*) AS n FROM symbol_calls WHERE callee_name IN (SELECT name FROM symbols) GROUP BY 1 ORDER BY n DESC, callee_name LIMIT 20")
def hot_symbols(spark, d):
    return graph.hot_symbols(derive(spark, d, "symbols"), derive(spark, d, "symbol_calls"), 20)


@query(_SYMBOLS + "SELECT path, count(*) AS n FROM symbols GROUP BY 1 ORDER BY n DESC, path LIMIT 20")
def top_files(spark, d):
    return graph.top_files(derive(spark, d, "symbols"), 20)


@query(_SYMBOLS + "SELECT lower(name) AS low_name, count(*) AS definitions FROM symbols GROUP BY 1 HAVING count(*) > 1")
def ambiguous_names(spark, d):
    return graph.ambiguous_names(derive(spark, d, "symbols"))


@query(
    _GRAPH
    + f"""SELECT s.id, s.name AS symbol, s.kind, s.path, s.start_line, s.end_line,
      coalesce((SELECT list_sort(list(DISTINCT callee_name)) FROM symbol_calls c WHERE c.caller_id = s.id), []) AS calls,
      (SELECT count(DISTINCT (c.caller_id, c.call_line)) FROM symbol_calls c WHERE c.callee_name = s.name) AS n_called_by
      FROM symbols s WHERE lower(s.name) = lower('{NAME.upper()}')"""
)
def symbol_resolve(spark, d):
    out = graph.symbol_resolve(derive(spark, d, "symbols"), derive(spark, d, "symbol_calls"), NAME.upper())
    return out.withColumn("n_called_by", F.coalesce(F.size("called_by"), F.lit(0)).cast("bigint")).drop("called_by")


@query(_GRAPH + "SELECT s.id, c.callee_name, c.call_line FROM symbols s JOIN symbol_calls c ON s.id = c.caller_id")
def callees(spark, d):
    return graph.callees(derive(spark, d, "symbols"), derive(spark, d, "symbol_calls"))


@query(_GRAPH + f"SELECT s.id, split_part(c.caller_id, '::', 2) AS caller, split_part(c.caller_id, '::', 1) AS path, c.call_line AS line FROM symbols s JOIN symbol_calls c ON s.name = c.callee_name WHERE s.path = '{PATH}'")
def callers(spark, d):
    return graph.callers(derive(spark, d, "symbols").where(F.col("path") == PATH), derive(spark, d, "symbol_calls"))


@query(_SYMBOLS + f"SELECT name, kind, start_line, end_line FROM symbols WHERE path = '{PATH}'")
def symbols_in_file(spark, d):
    return derive(spark, d, "symbols").where(F.col("path") == PATH).orderBy("start_line").select("name", "kind", "start_line", "end_line")


@query(with_ctes("files") + f"SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, {_LANGUAGE} AS language, size_bytes, md5(content) AS hash, CAST(len(string_split(path, '/')) - 1 AS INT) AS depth FROM files WHERE path LIKE 'src/src1%' AND len(string_split(path, '/')) - 1 <= 2")
def tree_subtree(spark, d):
    return graph.subtree(ingest.tree_nodes(derive(spark, d, "files")), "src/src1", 2).select("path", "parent", "language", "size_bytes", "hash", "depth")


_BFS = (
    _GRAPH
    + f""", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY path, start_line, id) AS r FROM symbols) WHERE r = 1),
    root AS (SELECT id FROM f WHERE lower(name) = '{NAME}'),
    h1 AS (SELECT callee_name AS symbol, min(call_line) AS call_line FROM symbol_calls WHERE caller_id IN (SELECT id FROM root) GROUP BY 1),
    n1 AS (SELECT DISTINCT f.id FROM h1 JOIN f ON lower(f.name) = lower(h1.symbol)),
    h2 AS (SELECT callee_name AS symbol, min(call_line) AS call_line FROM symbol_calls WHERE caller_id IN (SELECT id FROM n1) AND callee_name NOT IN (SELECT symbol FROM h1) GROUP BY 1),
    n2 AS (SELECT DISTINCT f.id FROM h2 JOIN f ON lower(f.name) = lower(h2.symbol)),
    h3 AS (SELECT callee_name AS symbol, min(call_line) AS call_line FROM symbol_calls WHERE caller_id IN (SELECT id FROM n2) AND callee_name NOT IN (SELECT symbol FROM h1 UNION ALL SELECT symbol FROM h2) GROUP BY 1),
    a AS (SELECT 1 AS hop, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3)
    SELECT a.symbol, a.hop, coalesce(f.path, '') AS path, coalesce(f.start_line, 0) AS line, a.call_line FROM a LEFT JOIN f ON lower(f.name) = lower(a.symbol)"""
)


def _calls_by(spark, d, end):
    """The calls as a walk reads them: stored once, in buckets of the end that it starts from."""
    return walks.stored(derive(spark, d, "symbol_calls"), end)


@query(_BFS)
def call_graph_bfs(spark, d):
    return graph.call_graph(derive(spark, d, "symbols"), _calls_by(spark, d, "caller_id"), NAME, 3, 1 << 30)


@query(_BFS + " ORDER BY hop, symbol LIMIT 200")
def call_graph_capped(spark, d):
    return graph.call_graph(derive(spark, d, "symbols"), _calls_by(spark, d, "caller_id"), NAME, 3, 200)


def _impact_sql(hops: int = 2) -> str:
    return (
        _GRAPH
        + f""", seeds AS (SELECT DISTINCT id, name, path, kind FROM symbols WHERE lower(name) = '{NAME}' OR path = '{PATH}'),
        amb AS (SELECT lower(name) AS low_name FROM symbols GROUP BY 1 HAVING count(*) > 1),
        f0 AS (SELECT DISTINCT name AS via FROM seeds WHERE lower(name) NOT IN (SELECT low_name FROM amb) OR name = '{NAME}'),
        m1 AS (SELECT caller_id, min((via, call_line)) AS first FROM f0 JOIN symbol_calls ON callee_name = via WHERE caller_id NOT IN (SELECT id FROM seeds) GROUP BY 1),
        f1 AS (SELECT DISTINCT split_part(caller_id, '::', 2) AS via FROM m1 WHERE lower(split_part(caller_id, '::', 2)) NOT IN (SELECT low_name FROM amb)),
        m2 AS (SELECT caller_id, min((via, call_line)) AS first FROM f1 JOIN symbol_calls ON callee_name = via WHERE caller_id NOT IN (SELECT id FROM seeds UNION ALL SELECT caller_id FROM m1) GROUP BY 1),
        hit AS (SELECT caller_id, split_part(caller_id, '::', 2) AS name, split_part(caller_id, '::', 1) AS path, first[2] AS line, 1 AS distance, first[1] AS via FROM m1
                UNION ALL SELECT caller_id, split_part(caller_id, '::', 2), split_part(caller_id, '::', 1), first[2], 2, first[1] FROM m2) """
    )


_IMPACT = _impact_sql().replace("min((via, call_line)) AS first", "min({'v': via, 'l': call_line}) AS first").replace("first[2]", "first.l").replace("first[1]", "first.v")


@query(_IMPACT + "SELECT caller_id, name, path, line, distance, via FROM hit")
def impact_callers(spark, d):
    return graph.impact_callers(derive(spark, d, "symbols"), _calls_by(spark, d, "callee_name"), [NAME], [PATH], 2)


_DEPENDENT = "regexp_replace(regexp_replace({0}, '^src/', ''), '\\.rs$', '')"


def _imports_hop(source: str, target: str, seen: str) -> str:
    """Files whose module text starts with a path's own module."""
    return f"""{target} AS (SELECT DISTINCT importer AS path FROM symbol_imports i JOIN {source} c
        ON starts_with(lower(i.from_module), 'crate::' || {_DEPENDENT.format('c.path')}) OR starts_with(lower(i.from_module), {_DEPENDENT.format('c.path')})
        OR starts_with(lower(i.from_module), 'super::' || {_DEPENDENT.format('c.path')}) OR starts_with(lower(i.from_module), 'self::' || {_DEPENDENT.format('c.path')})
        WHERE importer NOT IN ({seen}))"""


@query(
    _IMPACT.replace("WITH ", with_ctes("symbol_imports") + ", ", 1)
    + ", ch AS (SELECT DISTINCT path FROM seeds), "
    + _imports_hop("ch", "i1", "SELECT path FROM ch")
    + ", "
    + _imports_hop("i1", "i2", "SELECT path FROM ch UNION ALL SELECT path FROM i1")
    + " SELECT DISTINCT path FROM (SELECT path FROM hit UNION ALL SELECT path FROM i1 UNION ALL SELECT path FROM i2) WHERE path NOT IN (SELECT path FROM ch)"
)
def impact_files(spark, d):
    return graph.impact_files(derive(spark, d, "symbols"), _calls_by(spark, d, "callee_name"), derive(spark, d, "symbol_imports"), [NAME], [PATH], 2)


@query(
    _IMPACT
    + """, dir AS (SELECT via, count(*) AS n, count(DISTINCT path) AS files, list_sort(list(DISTINCT name)) AS who FROM hit WHERE distance = 1 GROUP BY via)
    SELECT name AS symbol, 'Changing ''' || name || ''' (' || kind || ', ' || path || ') impacts ' || n || ' direct caller(s) in ' || files || ' file(s): ' || array_to_string(who[1:3], ', ')
      || CASE WHEN len(who) > 3 THEN ', +' || (len(who) - 3) || ' more' ELSE '' END AS signal FROM seeds JOIN dir ON name = via
    UNION ALL SELECT DISTINCT name, 'Symbol ''' || name || ''' is defined in multiple places — name-based caller matching would be unreliable, so its call-graph walk was skipped (pass it explicitly in ''symbols'' to force it)' FROM seeds WHERE lower(name) IN (SELECT low_name FROM amb)"""
)
def breaking_signals(spark, d):
    return graph.breaking_signals(derive(spark, d, "symbols"), _calls_by(spark, d, "callee_name"), [NAME], [PATH], 2)


_STEMS = with_ctes("files") + """, e AS (SELECT DISTINCT path, CASE WHEN contains(path, '.') THEN regexp_extract(path, '[^.]*$') ELSE '' END AS ext FROM files),
  s AS (SELECT path, ext, substr(path, 1, length(path) - length(ext) - 1) AS stem FROM e),
  r AS (SELECT *, replace(regexp_replace(regexp_replace(stem, '^src/', ''), '/mod$', ''), '/', '::') AS scoped, regexp_extract(stem, '[^/]*$') AS leaf FROM s) """


@query(
    _STEMS
    + """SELECT path, unnest(CASE ext WHEN 'rs' THEN ['crate::' || scoped || '%', scoped || '%', 'super::' || leaf || '%', 'self::' || leaf || '%']
      WHEN 'py' THEN [replace(stem, '/', '.') || '%', '%.' || leaf, '%.' || leaf || '.%']
      WHEN 'js' THEN ['%/' || leaf, '%/' || leaf || '.js'] WHEN 'ts' THEN ['%/' || leaf, '%/' || leaf || '.ts'] ELSE ['%' || path || '%'] END) AS pattern FROM r"""
)
def import_patterns(spark, d):
    return graph.pattern_rows(derive(spark, d, "files").select("path").distinct())


_CHANGED = f"ch AS (SELECT DISTINCT path FROM (VALUES ('{PATH}'), ('src/m14.rs'), ('src/m21.rs')) t(path))"


def _changed(spark):
    return spark.createDataFrame([(PATH,), ("src/m14.rs",), ("src/m21.rs",)], "path string")


@query(_IMPORTS + f", {_CHANGED}, " + _imports_hop("ch", "i1", "SELECT path FROM ch") + " SELECT path AS dependent FROM i1")
def import_dependents(spark, d):
    return graph.import_dependents(derive(spark, d, "symbol_imports"), _changed(spark)).select("dependent").distinct()


@query(_IMPORTS + f", {_CHANGED}, " + _imports_hop("ch", "i1", "SELECT path FROM ch") + ", " + _imports_hop("i1", "i2", "SELECT path FROM ch UNION ALL SELECT path FROM i1") + " SELECT path AS dependent, 1 AS hop FROM i1 UNION ALL SELECT path, 2 FROM i2")
def import_dependents_transitive(spark, d):
    return graph.import_dependents_transitive(derive(spark, d, "symbol_imports"), _changed(spark), 2)


@query(_IMPORTS + "SELECT DISTINCT importer FROM symbol_imports WHERE lower(from_module) LIKE '%m70::%'")
def importers_of(spark, d):
    return graph.importers_of(derive(spark, d, "symbol_imports"), "m70::")


@query(_GRAPH + ", l AS (SELECT DISTINCT split_part(caller_id, '::', 1) AS path, call_line AS line FROM symbol_calls) SELECT l.path, l.line, max_by(s.id, (s.start_line, s.id)) AS id FROM l JOIN symbols s ON s.path = l.path AND l.line BETWEEN s.start_line AND s.end_line GROUP BY 1, 2")
def enclosing_symbol(spark, d):
    lines = derive(spark, d, "symbol_calls").select(X.caller_path(F.col("caller_id")).alias("path"), F.col("call_line").alias("line")).distinct()
    return graph.enclosing_symbols(lines, derive(spark, d, "symbols"))


@query(_SYMBOLS + "SELECT id, path, start_line, coalesce(greatest(lead(start_line) OVER (PARTITION BY path ORDER BY start_line, id) - 1, start_line), end_line) AS end_line FROM symbols")
def symbol_end_lines(spark, d):
    return graph.symbol_end_lines(derive(spark, d, "symbols")).select("id", "path", "start_line", "end_line")


@query(_SYMBOLS + "SELECT id, start_line, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start_line DESC, seq DESC) AS r FROM symbols) WHERE r = 1")
def last_wins_symbols(spark, d):
    return state.last_wins(derive(spark, d, "symbols"), ["id"], ["start_line", "seq"]).select("id", "start_line", "seq")


@query(_GRAPH + "SELECT caller_id, callee_name, min(call_line) AS call_line FROM symbol_calls GROUP BY 1, 2")
def first_call_edges(spark, d):
    return state.first_seen(derive(spark, d, "symbol_calls"), ["caller_id", "callee_name"], ["call_line"])


@query(with_ctes("changes") + "SELECT path, ts, event_id, op FROM (SELECT *, lag(op) OVER (PARTITION BY path ORDER BY ts, event_id) AS before FROM changes) WHERE op IS DISTINCT FROM before")
def consecutive_dedup(spark, d):
    rows = derive(spark, d, "changes").select("path", "ts", "event_id", "op")
    return state.without_consecutive(rows, ["path"], ["ts", "event_id"], ["op"])


@query(_GRAPH + ", keep AS (SELECT DISTINCT path FROM symbols WHERE kind = 'function') SELECT (SELECT count(DISTINCT path) FROM symbols WHERE path NOT IN (SELECT path FROM keep)) AS pruned, (SELECT count(*) FROM symbols WHERE path IN (SELECT path FROM keep)) AS kept")
def graph_prune(spark, d):
    symbols = derive(spark, d, "symbols")
    keep = symbols.where("kind = 'function'").select("path").distinct()
    kept = state.prune(symbols, keep, "path").agg(F.count("*").alias("kept"))
    return state.pruned_count(symbols, keep, "path").join(kept, F.lit(True))


# --- parsing --------------------------------------------------------------------------------

_UNITS = with_ctes("source_units")
_SOURCES = with_ctes("sources")


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names})"


def _sources(spark, d):
    return derive(spark, d, "sources")


_LINES = _SOURCES + (
    ", l AS (SELECT path, language, line, CAST(n AS INT) AS n FROM (SELECT path, language, unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(content, '\\n$', ''), chr(10)), 1) AS n FROM sources)) "
)
_PREFIX_ROWS = [(lang, p, k) for lang, ps in rules.SYMBOL_PREFIXES.items() for p, k in ps]
_PREFIXED = (
    _LINES
    + ", p AS ("
    + _values(_PREFIX_ROWS, "language, prefix, kind")
    + """), m AS (SELECT l.path, l.n, p.kind, regexp_extract(substr(trim(l.line, ' ' || chr(9)), length(p.prefix) + 1), '^[\\p{L}\\p{N}_]+') AS name,
         row_number() OVER (PARTITION BY l.path, l.n ORDER BY length(p.prefix) DESC) AS r FROM l JOIN p ON l.language = p.language AND starts_with(trim(l.line, ' ' || chr(9)), p.prefix)),
       t AS (SELECT path, max(n) AS total FROM l GROUP BY path),
       s AS (SELECT m.path, m.name, m.kind, m.n AS start_line, coalesce(greatest(lead(m.n) OVER (PARTITION BY m.path ORDER BY m.n) - 1, m.n), t.total) AS end_line FROM m JOIN t USING (path) WHERE r = 1 AND strlen(name) >= 2) """
)


@query(_PREFIXED + "SELECT path || '::' || name AS id, path, name, kind, start_line, end_line FROM s")
def regex_symbols(spark, d):
    return parse.prefix_symbols(_sources(spark, d))


@query(
    _PREFIXED
    + """, c AS (SELECT path, n, unnest(regexp_extract_all(line, '\\b([\\p{L}\\p{N}_]{2,})\\s*\\(', 1)) AS callee, generate_subscripts(regexp_extract_all(line, '\\b([\\p{L}\\p{N}_]{2,})\\s*\\(', 1), 1) AS i FROM l),
       o AS (SELECT c.path, c.n, c.i, c.callee, max_by(s.name, s.start_line) AS caller FROM c JOIN s ON s.path = c.path AND c.n BETWEEN s.start_line AND s.end_line WHERE (c.path, c.callee) IN (SELECT (path, name) FROM s) GROUP BY ALL),
       x AS (SELECT *, lag(caller || '>' || callee) OVER (PARTITION BY path ORDER BY n, i) AS before FROM o WHERE caller <> callee)
       SELECT path || '::' || caller AS caller_id, callee AS callee_name, n AS call_line FROM x WHERE before IS DISTINCT FROM caller || '>' || callee"""
)
def regex_calls(spark, d):
    return parse.prefix_calls(_sources(spark, d), parse.prefix_symbols(_sources(spark, d)))


def _heads(rows: list[tuple], names: str, columns: str) -> str:
    """SQL over files: what is known of the first lines of each language's."""
    return _UNITS + f", p AS (SELECT DISTINCT path, language, m FROM source_units) SELECT {columns} FROM p JOIN {code_corpus.values(rows, names)} AS f USING (language)"


def _in_file(column: str) -> str:
    out = column
    for name, value in (("{m}", "CAST(m AS STRING)"), ("{n}", "chr(10)"), ("{t}", "chr(9)"), ("{q}", "chr(39)"), ("{bs}", "chr(92)")):
        out = f"replace({out}, '{name}', {value})"
    return out


_IMPORT_COLUMNS = f"path AS importer, {_in_file('module')} AS from_module, {_in_file('bound')} AS symbol_name"


@query(_heads([(name, *row) for name, head in code_corpus.HEADS.items() for row in head[3]], "language, module, bound", _IMPORT_COLUMNS))
def regex_imports(spark, d):
    return parse.prefix_imports(_sources(spark, d))


@query(_heads([(name, *row) for name, head in code_corpus.HEADS.items() for row in head[2]], "language, module, bound", _IMPORT_COLUMNS))
def parse_imports(spark, d):
    return parse.imports_of(parse.parse_files(_sources(spark, d)))


_USES = [("sea::m{m}::{tide, wave as swell}", "sea::m{m}::tide", "tide"), ("sea::m{m}::{tide, wave as swell}", "sea::m{m}::wave", "swell"), ("deep::*", "deep::*", "*")]


@query(_heads([("rust", *row) for row in _USES], "language, item, module, bound", f"path, {_in_file('item')} AS item, {_in_file('module')} AS full_path, {_in_file('bound')} AS bound"))
def rust_use_expand(spark, d):
    return parse.use_items(_sources(spark, d).where("language = 'rust'"))


_FILLED = code_corpus.filled


@query(_UNITS + f"SELECT path || '::' || {_FILLED('name')} AS id, path, {_FILLED('name')} AS name, kind, above + lo AS start_line, above + hi AS end_line " + code_corpus.facts(code_corpus.SYMBOL_FACTS, "language, form, name, kind, lo, hi"))
def file_symbols(spark, d):
    return parse.symbols_of(parse.parse_files(_sources(spark, d))).drop("signature", "body")


_CALLS = _UNITS + f", c AS (SELECT path, {_FILLED('caller')} AS caller, {_FILLED('callee')} AS callee_name, above + line AS line " + code_corpus.facts(code_corpus.CALL_FACTS, "language, form, caller, callee, line") + ") "


@query(_CALLS + "SELECT path || '::' || caller AS caller_id, callee_name, min(line) AS call_line FROM c GROUP BY 1, 2")
def file_calls(spark, d):
    return parse.calls_of(parse.parse_files(_sources(spark, d)))


@query(_CALLS + "SELECT callee_name, count(DISTINCT path || '::' || caller) AS callers, count(DISTINCT path) AS files FROM c GROUP BY 1")
def parse_calls(spark, d):
    """How many symbols and files call a name, over all files."""
    found = parse.calls_of(parse.parse_files(_sources(spark, d)))
    return found.groupBy("callee_name").agg(F.count_distinct("caller_id").alias("callers"), F.count_distinct(X.caller_path(F.col("caller_id"))).alias("files"))


@query(_UNITS + f"SELECT path || '::' || {_FILLED('name')} AS id, {_FILLED('name')} AS name, kind, {_FILLED('signature')} AS signature, {_FILLED('body')} AS body " + code_corpus.facts([("rust", *row) for row in code_corpus.DETAILS], "language, form, name, kind, signature, body"))
def parse_udtf(spark, d):
    """Signatures and bodies of what Rust files declare."""
    return parse.symbols_of(parse.parse_files(_sources(spark, d).where("language = 'rust'"))).select("id", "name", "kind", "signature", "body")


_SHORT = with_ctes("source_units").rstrip() + ", short AS (" + code_corpus.text_sql(code_corpus.short_units(), 0).replace("{source_units}", "SELECT * FROM source_units") + ") "
_SHORT = duckdb_lines(_SHORT)


@query(_SHORT + "SELECT path, content AS skeleton FROM short")
def skeletons(spark, d):
    return skeleton.skeletons(_sources(spark, d).where("language in ('rust', 'go')")).select("path", "skeleton")


@query()
def skeleton_files(spark, d):
    return skeleton.skeletons(_sources(spark, d)).select("path", F.md5("skeleton").alias("skeleton_md5"), (F.length("content") - F.length("skeleton")).alias("saved"))


# --- bundle ---------------------------------------------------------------------------------

_CAP = _SCORED + ", c AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, chunk_id, score FROM s), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_id) AS INT) AS file_rank FROM c) "


def _candidates(spark, d):
    rows = search.scored(derive(spark, d, "vectors"), query_vector(spark, d))
    return rows.select("chunk_id", X.parent_dir(F.col("path")).alias("path"), F.round("score", 3).alias("score"))


@query(_CAP + "SELECT path, chunk_id, score, file_rank FROM r WHERE file_rank <= 3")
def per_file_cap(spark, d):
    return bundle.per_file_cap(_candidates(spark, d))


_PACKED = _CAP + ", k AS (SELECT chunk_id, path, score, length(chunk_id) AS tokens FROM r WHERE file_rank <= 3), w AS (SELECT *, CAST(coalesce(sum(tokens) OVER (ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM k) "


def _packed(spark, d):
    capped = bundle.per_file_cap(_candidates(spark, d)).withColumn("tokens", F.length("chunk_id"))
    return bundle.pack(capped, "tokens", 200)


@query(_PACKED + "SELECT chunk_id, score, used_before FROM w WHERE used_before < 200")
def budget_pack(spark, d):
    return _packed(spark, d).select("chunk_id", "score", "used_before")


@query(
    _PACKED
    + f""", fb AS ({with_ctes('files')} SELECT CAST(sum({_TOKENS}) AS BIGINT) AS baseline FROM files WHERE path LIKE 'src/src1/%'),
     t AS (SELECT (SELECT CAST(sum(length(chunk_id)) AS BIGINT) FROM c) AS candidate, (SELECT CAST(sum(tokens) AS BIGINT) FROM w WHERE used_before < 200) AS selected, (SELECT baseline FROM fb) AS baseline)
     SELECT candidate, selected, baseline, greatest(baseline - selected, 0) AS saved_tokens, round(greatest(baseline - selected, 0) * 100.0::DOUBLE / baseline, 2) AS saved_percent,
       round(baseline::DOUBLE / selected, 2) AS saving_ratio, round(greatest(candidate - selected, 0) * 100.0::DOUBLE / candidate, 2) AS trim_percent FROM t"""
)
def bundle_metrics(spark, d):
    files = derive(spark, d, "files").where(F.col("path").startswith("src/src1/"))
    baseline = files.agg(F.sum(X.token_estimate(F.col("content"), X.language_of(F.col("ext")))).alias("baseline"))
    selected = _packed(spark, d).agg(F.sum("tokens").alias("selected"))
    one = _candidates(spark, d).agg(F.sum(F.length("chunk_id")).alias("candidate")).join(selected, F.lit(True)).join(baseline, F.lit(True))
    return one.select("candidate", "selected", "baseline", *bundle.metric_columns(F.col("candidate"), F.col("selected"), F.col("selected"), F.col("baseline")))


# --- diff -----------------------------------------------------------------------------------


@query(with_ctes("files", "new_files") + "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'A' WHEN n.path IS NULL THEN 'D' ELSE 'M' END AS status FROM files o FULL JOIN new_files n ON o.path = n.path WHERE o.content IS DISTINCT FROM n.content OR o.path IS NULL OR n.path IS NULL")
def changed_files(spark, d):
    return diff.changed_files(derive(spark, d, "files"), derive(spark, d, "new_files"))


_DIFF = (
    with_ctes("old_details", "new_details", "symbol_calls")
    + """, x AS (SELECT coalesce(o.path, n.path) AS path, coalesce(o.name, n.name) AS symbol, coalesce(n.kind, o.kind) AS kind,
       CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.signature <> n.signature THEN 'signature_changed' WHEN n.body <> '' AND o.body <> n.body THEN 'modified' END AS change,
       o.signature AS os, n.signature AS ns FROM old_details o FULL JOIN new_details n ON o.path = n.path AND o.name = n.name),
     ch AS (SELECT path, symbol, kind, change, CASE WHEN change IN ('removed', 'signature_changed') THEN os END AS before, CASE WHEN change IN ('added', 'signature_changed') THEN ns END AS after FROM x WHERE change IS NOT NULL) """
)


@query(_DIFF + "SELECT path, symbol, kind, change, before, after FROM ch")
def semantic_diff(spark, d):
    return diff.symbol_changes(derive(spark, d, "old_details"), derive(spark, d, "new_details"))


@query(
    _DIFF
    + """, w AS (SELECT DISTINCT callee_name, split_part(caller_id, '::', 1) AS cp, split_part(caller_id, '::', 2) AS cs FROM symbol_calls),
     g AS (SELECT ch.*, (SELECT list_sort(list(cp || '::' || cs)) FROM w WHERE callee_name = symbol AND NOT (cp = path AND cs = symbol) AND change <> 'added') AS who FROM ch),
     k AS (SELECT *, least(coalesce(len(who), 0), 25) AS n FROM g)
     SELECT path, symbol, change, CASE change WHEN 'signature_changed' THEN '⚠ ' || path || '::' || symbol || ' signature changed: `' || before || '` → `' || after || '`'
       WHEN 'removed' THEN '✗ ' || path || '::' || symbol || ' removed' WHEN 'modified' THEN '~ ' || path || '::' || symbol || ' body changed' ELSE '+ ' || path || '::' || symbol || ' added (' || kind || ')' END
       || CASE WHEN change = 'added' THEN '' WHEN n = 0 THEN ' — no known callers' ELSE ' — affects ' || n || ' caller(s): ' || array_to_string(who[1:5], ', ') || CASE WHEN n > 5 THEN ', +' || (n - 5) || ' more' ELSE '' END END AS line FROM k"""
)
def diff_summary(spark, d):
    changes = diff.symbol_changes(derive(spark, d, "old_details"), derive(spark, d, "new_details"))
    return diff.summary_lines(diff.with_callers(changes, derive(spark, d, "symbol_calls")))


# --- requests -------------------------------------------------------------------------------


def _tokens_sql(text: str, ratio: str = "4.0") -> str:
    return f"CAST(ceil(length({text}) / CASE WHEN regexp_matches(lower({text}), '{rules.TURKISH}') THEN 3.0 ELSE {ratio} END) AS BIGINT)"


def _requests(spark, d, *columns):
    return derive(spark, d, "requests").select("request_id", *columns)


_SEARCHED = with_ctes("passages", "requests") + (
    ", s AS (SELECT r.request_id, r.budget, p.* EXCLUDE (embedding), round(list_cosine_similarity(p.embedding::DOUBLE[], r.embedding::DOUBLE[]), 3) AS score FROM passages p JOIN requests r ON {on}), "
    "k AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s) "
)
_FITS = "(r.language IS NULL OR p.language = CASE r.language WHEN 'rs' THEN 'rust' ELSE r.language END) AND (r.glob IS NULL OR lower(p.path) LIKE replace(lower(r.glob), '*', '%'))"


@query(_SEARCHED.replace("{on}", _FITS) + "SELECT request_id, chunk_id, score, rank FROM k WHERE rank <= 6")
def search_batch(spark, d):
    return requests.search_batch(derive(spark, d, "passages"), _requests(spark, d, "embedding", "language", "glob"), 6)


_PAIRS = """mods AS (SELECT DISTINCT importer, regexp_extract(from_module, '^crate::m([0-9]+)::', 1) AS k FROM symbol_imports),
    pairs AS (SELECT DISTINCT 'src/m' || k[1:n] || '.rs' AS path, importer AS dependent FROM mods, LATERAL (SELECT unnest(range(1, length(k) + 1)) AS n))"""


def _callers_hop(frontier: str, target: str, seen: str) -> str:
    return f"""{target} AS (SELECT request_id, caller_id, min({{'v': via, 'l': call_line}}) AS first FROM {frontier} JOIN symbol_calls ON callee_name = via
        WHERE (request_id, caller_id) NOT IN ({seen}) GROUP BY 1, 2)"""


_IMPACTS = (
    with_ctes("symbols", "symbol_calls", "symbol_imports", "requests")
    + f""", seeds AS (SELECT r.request_id, s.id, min(s.name) AS name, min(s.kind) AS kind, min(s.path) AS path FROM symbols s JOIN requests r ON lower(s.name) = lower(r.name) OR s.path = r.path GROUP BY 1, 2),
    amb AS (SELECT lower(name) AS low_name FROM symbols GROUP BY 1 HAVING count(*) > 1),
    f0 AS (SELECT DISTINCT s.request_id, s.name AS via FROM seeds s JOIN requests r USING (request_id) WHERE lower(s.name) NOT IN (SELECT low_name FROM amb) OR s.name = r.name),
    {_callers_hop('f0', 'm1', 'SELECT (request_id, id) FROM seeds')},
    f1 AS (SELECT DISTINCT request_id, split_part(caller_id, '::', 2) AS via FROM m1 WHERE lower(split_part(caller_id, '::', 2)) NOT IN (SELECT low_name FROM amb)),
    {_callers_hop('f1', 'm2', 'SELECT (request_id, id) FROM seeds UNION ALL SELECT (request_id, caller_id) FROM m1')},
    hit AS (SELECT request_id, caller_id, split_part(caller_id, '::', 2) AS name, split_part(caller_id, '::', 1) AS path, first.l AS line, distance, first.v AS via
            FROM (SELECT 1 AS distance, * FROM m1 UNION ALL SELECT 2, * FROM m2)),
    ch AS (SELECT request_id, path FROM seeds UNION SELECT request_id, path FROM requests), {_PAIRS},
    i1 AS (SELECT DISTINCT c.request_id, p.dependent AS path FROM ch c JOIN pairs p USING (path) WHERE (c.request_id, p.dependent) NOT IN (SELECT (request_id, path) FROM ch)),
    i2 AS (SELECT DISTINCT c.request_id, p.dependent AS path FROM i1 c JOIN pairs p USING (path) WHERE (c.request_id, p.dependent) NOT IN (SELECT (request_id, path) FROM ch UNION ALL SELECT (request_id, path) FROM i1)) """
)


def _impacts(spark, d, wanted):
    asked = _requests(spark, d, F.array("name").alias("names"), F.array("path").alias("paths"))
    return requests.impact_batch(derive(spark, d, "symbols"), _calls_by(spark, d, "callee_name"), derive(spark, d, "symbol_imports"), asked, 2, 50, [wanted])[wanted]


@query(_IMPACTS + "SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance, via, caller_id) AS place FROM hit) WHERE place <= 50")
def impact_batch(spark, d):
    return _impacts(spark, d, "callers")


@query(_IMPACTS + "SELECT DISTINCT request_id, path FROM (SELECT request_id, path FROM hit UNION ALL FROM i1 UNION ALL FROM i2) WHERE (request_id, path) NOT IN (SELECT (request_id, path) FROM ch)")
def impact_batch_files(spark, d):
    return _impacts(spark, d, "files")


@query(
    _IMPACTS
    + """, dir AS (SELECT request_id, via, count(*) AS n, count(DISTINCT path) AS files, list_sort(list(DISTINCT name)) AS who FROM hit WHERE distance = 1 GROUP BY 1, 2)
    SELECT s.request_id, name AS symbol, 'Changing ''' || name || ''' (' || kind || ', ' || path || ') impacts ' || n || ' direct caller(s) in ' || files || ' file(s): ' || array_to_string(who[1:3], ', ')
      || CASE WHEN len(who) > 3 THEN ', +' || (len(who) - 3) || ' more' ELSE '' END AS signal FROM seeds s JOIN dir d ON s.request_id = d.request_id AND name = via
    UNION ALL SELECT request_id, name, 'Symbol ''' || name || ''' was not found in the symbol graph — impact for it is unknown (run ensure_index again, or check the name)' FROM requests WHERE lower(name) NOT IN (SELECT lower(name) FROM symbols)
    UNION ALL SELECT request_id, name, 'Note: ''' || name || ''' has multiple definitions in the project — some listed callers may refer to the other definitions' FROM requests WHERE lower(name) IN (SELECT low_name FROM amb)
    UNION ALL SELECT DISTINCT s.request_id, s.name, 'Symbol ''' || s.name || ''' is defined in multiple places — name-based caller matching would be unreliable, so its call-graph walk was skipped (pass it explicitly in ''symbols'' to force it)'
      FROM seeds s JOIN requests r USING (request_id) WHERE lower(s.name) IN (SELECT low_name FROM amb) AND s.name <> r.name"""
)
def impact_batch_signals(spark, d):
    return _impacts(spark, d, "signals")


@query(
    ORACLES["diff_summary"].replace("WITH ", with_ctes("requests", "symbol_imports").rstrip() + ", ", 1).replace("SELECT path, symbol, change, CASE change", f", {_PAIRS}, o AS (SELECT path, symbol, change, CASE change")
    + """), few AS (SELECT path, array_to_string(list_sort(list(dependent))[1:25], ' ') AS affected FROM pairs WHERE dependent <> path GROUP BY path)
    SELECT r.request_id, o.path, symbol, change, line, CASE WHEN change = 'added' THEN '' ELSE coalesce(affected, '') END AS affected
    FROM o LEFT JOIN few USING (path) JOIN requests r ON r.folder = '' OR starts_with(o.path, r.folder || CASE WHEN r.folder LIKE '%/' THEN '' ELSE '/' END)"""
)
def review_batch(spark, d):
    changes = requests.reviewed(derive(spark, d, "old_details"), derive(spark, d, "new_details"), derive(spark, d, "symbol_calls"), derive(spark, d, "symbol_imports"))
    shown = changes.withColumn("affected", F.array_join("affected_files", " ")).drop("affected_files")
    return requests.below_folders(shown, _requests(spark, d, "folder"))


_OWN = "CASE WHEN language IN ('markdown', 'text') THEN 4.0 ELSE 3.5 END"


def _stage(name: str, rows: str, used: str, percent: int) -> str:
    """A stage's rows (request_id, grp, pos, item, tokens), those that are taken, and what is used after it."""
    return f""", {name} AS ({rows}),
    {name}_g AS (SELECT g.request_id, grp, used + coalesce(sum(cost) OVER (PARTITION BY g.request_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, budget
                 FROM (SELECT request_id, grp, sum(tokens) AS cost FROM {name} GROUP BY 1, 2) g JOIN {used} u ON u.request_id = g.request_id),
    {name}_t AS (SELECT t.request_id, t.grp, t.pos, t.item, t.tokens FROM {name} t JOIN {name}_g g ON g.request_id = t.request_id AND g.grp = t.grp WHERE before < floor(budget * {percent} / 100)),
    {name}_u AS (SELECT u.request_id, budget, CAST(used + coalesce(spent, 0) AS BIGINT) AS used FROM {used} u LEFT JOIN (SELECT request_id, sum(tokens) AS spent FROM {name}_t GROUP BY 1) USING (request_id))"""


_BUNDLES = (
    _SEARCHED.replace("{on}", "TRUE").replace("WITH ", with_ctes("symbols", "symbol_imports").rstrip() + ", ", 1)
    + f""", {_PAIRS}, hits AS (SELECT *, {_tokens_sql('content', _OWN)} AS own_tokens,
      '{{"chunk_id":"' || chunk_id || '","path":"' || path || '","score":' || score || ',"start_line":' || start_line || ',"end_line":' || end_line || ',"language":"' || language || '","snippet":"'
      || CASE WHEN length(content) > 400 THEN substr(content, 1, 400) || '…' ELSE content END || '"}}' AS item FROM k WHERE rank <= 20),
    matched AS (SELECT DISTINCT request_id, path FROM hits WHERE rank <= 8), u0 AS (SELECT request_id, budget, 0 AS used FROM requests),
    cand AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS grp, 1 AS pos, item, {_tokens_sql('item')} AS tokens, own_tokens
             FROM (SELECT *, row_number() OVER (PARTITION BY request_id, path ORDER BY rank) AS own FROM hits) WHERE own <= 3)"""
    + _stage("c", "SELECT request_id, grp, pos, item, tokens FROM cand", "u0", 60)
    + ", sym AS (SELECT request_id, m.path AS grp, row_number() OVER (PARTITION BY request_id, m.path ORDER BY start_line, name, kind, id) AS pos, "
    + """'{"symbol":"' || name || '","kind":"' || kind || '","path":"' || m.path || '","line":' || start_line || '}' AS item FROM matched m JOIN symbols s ON s.path = m.path)"""
    + _stage("y", f"SELECT *, {_tokens_sql('item')} AS tokens FROM sym", "c_u", 80)
    + """, dep AS (SELECT DISTINCT m.request_id, dependent FROM matched m JOIN pairs USING (path) WHERE (m.request_id, dependent) NOT IN (SELECT (request_id, path) FROM matched)),
    said AS (SELECT request_id, count(*) || ' file(s) depend on the matched code: ' || array_to_string(list_sort(list(dependent))[1:5], ', ') AS text FROM dep GROUP BY 1),
    line AS (SELECT request_id, 1 AS grp, 1 AS pos, coalesce(text, 'No downstream dependents detected.') AS item FROM requests LEFT JOIN said USING (request_id))"""
    + _stage("i", f"SELECT *, {_tokens_sql('item')} AS tokens FROM line", "y_u", 90)
    + """, node AS (SELECT DISTINCT path FROM passages),
    dirs AS (SELECT request_id, dir, row_number() OVER (PARTITION BY request_id ORDER BY dir) AS n FROM (SELECT DISTINCT request_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM matched)),
    tree AS (SELECT request_id, dir AS grp, row_number() OVER (PARTITION BY request_id, dir ORDER BY node.path) AS pos, node.path AS item FROM dirs JOIN node ON starts_with(node.path, dir || '/') WHERE n <= 3)"""
    + _stage("t", "SELECT *, CAST(floor(strlen(item) / 4) AS BIGINT) + 1 AS tokens FROM tree WHERE pos <= 20", "i_u", 100)
    + " "
)


def _bundles(spark, d):
    passages = derive(spark, d, "passages")
    asked = _requests(spark, d, "embedding", "budget")
    near = requests.search_batch(passages, asked.drop("budget"), Config().bundle_max_chunks)
    hits = near.join(passages, "chunk_id").select("request_id", "chunk_id", "path", "score", bundle.result_json().alias("item"), X.token_estimate(F.col("content"), F.col("language")).alias("own_tokens"))
    tree = passages.select("path").distinct().withColumn("depth", X.depth(F.col("path")))
    return requests.BundleBatch(asked, hits, derive(spark, d, "symbols"), derive(spark, d, "symbol_imports"), tree)


_TAKEN = [("chunk", "c", "lpad(grp::VARCHAR, 4, '0')"), ("symbol", "y", "grp"), ("impact", "i", "''"), ("tree", "t", "grp")]


@query(
    _BUNDLES
    + "SELECT request_id, stage, CAST(row_number() OVER (PARTITION BY request_id, stage ORDER BY g, pos) AS INT) AS pos, item, CAST(tokens AS BIGINT) AS tokens FROM ("
    + " UNION ALL ".join(f"SELECT request_id, '{stage}' AS stage, {grp} AS g, pos, item, tokens FROM {name}_t" for stage, name, grp in _TAKEN)
    + ")"
)
def bundle_batch(spark, d):
    """Context within a budget for every request: chunks, symbols, a sentence on dependents, folders."""
    return _bundles(spark, d).items()


@query(
    _BUNDLES
    + """, size AS (SELECT path, CAST(sum(length(id)) * 10 AS BIGINT) AS tokens FROM symbols GROUP BY path),
    w AS (SELECT request_id, CAST(sum(own_tokens) AS BIGINT) AS candidate FROM hits GROUP BY 1),
    x AS (SELECT cand.request_id, CAST(sum(own_tokens) AS BIGINT) AS selected FROM cand JOIN c_t ON cand.request_id = c_t.request_id AND cand.grp = c_t.grp GROUP BY 1),
    b AS (SELECT request_id, CAST(sum(tokens) AS BIGINT) AS baseline FROM matched JOIN size USING (path) GROUP BY 1),
    m AS (SELECT request_id, used, coalesce(candidate, 0) AS candidate, coalesce(selected, 0) AS selected, coalesce(baseline, 0) AS baseline
          FROM t_u LEFT JOIN w USING (request_id) LEFT JOIN x USING (request_id) LEFT JOIN b USING (request_id))
    SELECT *, greatest(baseline - used, 0) AS saved_tokens, coalesce(round(greatest(baseline - used, 0) * 100.0::DOUBLE / nullif(baseline, 0), 2), 0) AS saved_percent,
      coalesce(round(baseline::DOUBLE / nullif(used, 0), 2), 0) AS saving_ratio, coalesce(round(greatest(candidate - selected, 0) * 100.0::DOUBLE / nullif(candidate, 0), 2), 0) AS trim_percent FROM m"""
)
def bundle_batch_metrics(spark, d):
    sizes = derive(spark, d, "symbols").groupBy("path").agg((F.sum(F.length("id")) * 10).alias("tokens"))
    return _bundles(spark, d).metrics(sizes)


# --- ranges ---------------------------------------------------------------------------------


@query(with_ctes("files") + "SELECT path, 2 AS start_line, 4 AS end_line, coalesce(array_to_string(string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))[2:4], chr(10)), '') AS text FROM files")
def line_ranges(spark, d):
    files = derive(spark, d, "files")
    return ranges.line_ranges(files, files.select("path", F.lit(2).alias("start_line"), F.lit(4).alias("end_line")))


def _bare(line: str) -> str:
    out = f"regexp_replace({line}, '^[\\s]+|[\\s]+$', '', 'g')"
    for q in rules.RANGE_QUALIFIERS:
        out = f"regexp_replace({out}, '^{re.escape(q)}', '')"
    return out


@query(
    _PREFIXED.replace("WITH ", with_ctes("source_units").rstrip() + ", ", 1)
    + f""", w AS (SELECT path, 'run_' || CAST(k AS STRING) AS symbol FROM source_units WHERE form = 0),
       own AS (SELECT w.path, w.symbol, min({{'a': s.start_line, 'b': s.end_line}}) AS r FROM w JOIN s ON s.path = w.path AND lower(s.name) = lower(w.symbol) GROUP BY 1, 2),
       h AS (SELECT l.path, w.symbol, min(l.n) AS pos FROM w JOIN l ON l.path = w.path WHERE (w.path, w.symbol) NOT IN (SELECT (path, symbol) FROM own) AND regexp_matches({_bare('l.line')}, '^({'|'.join(rules.RANGE_PREFIXES)})') AND contains({_bare('l.line')}, w.symbol) GROUP BY 1, 2)
       SELECT path, symbol, CAST(r.a AS INT) AS start_line, CAST(r.b AS INT) AS end_line FROM own UNION ALL SELECT path, symbol, pos, CAST(least(pos - 1 + {rules.RANGE_LINES}, total) AS INT) FROM h JOIN t USING (path)"""
)
def symbol_ranges(spark, d):
    wanted = derive(spark, d, "source_units").where("form = 0").select("path", F.concat(F.lit("run_"), F.col("k").cast("string")).alias("symbol"))
    files = _sources(spark, d)
    return ranges.symbol_ranges(files, parse.prefix_symbols(files), wanted).select("path", "symbol", "start_line", "end_line")


# --- streaming ------------------------------------------------------------------------------


_BURSTS = (
    with_ctes("changes")
    + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM changes),
     s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
     SELECT path, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, max_by(op, {'a': ts, 'b': op}) AS op FROM s GROUP BY path, burst"""
)


@query(_BURSTS)
def debounce_sessions(spark, d):
    return watch.debounce(derive(spark, d, "changes"), "30 minutes").select("path", "events", "first_ts", "last_ts", "op")


@query(_BURSTS)
def stream_reindex(spark, d):
    """Changes stream into bursts; the rows are those of all bursts."""
    return watch.debounce_table(spark, derive(spark, d, "changes"), scratch(spark, "stream"), "30 minutes")


@query(with_ctes("changes") + "SELECT path, md5('v' || CAST(event_id AS VARCHAR)) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM changes) WHERE r = 1 AND op <> 'remove'")
def stream_index(spark, d):
    """Changes stream through timers per path into bucket upserts and deletes; the index at the end is that of a batch build."""
    where = scratch(spark, "stream-index")
    store = IndexStore(spark, f"{where}/index", buckets=8)

    def rows_of(last):
        # what a path holds is known by its last event
        return {"state": last.select("path", F.md5(F.concat(F.lit("v"), F.col("seq").cast("string"))).alias("hash"))}

    watch.index_changes(spark, derive(spark, d, "changes").withColumnRenamed("event_id", "seq"), store, rows_of, where, 30 * 60_000)
    return store.read("state")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
