"""Tables of the index' model, derived from the test tables by one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemill import code_corpus

_EXTENSIONS = [".rs", ".py", ".js", ".ts", ".go", ".java", ".md", ".toml", ".yaml", ".json", ".txt", ""]
_EXT_CASE = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTENSIONS)) + " END"

#: name -> (base tables, SQL); BYTES( is the dialect's byte length. Base tables stand in braces.
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "files": (
        ("documents", "pages"),
        f"""
        SELECT path, CASE WHEN strpos_ext = '' THEN '' ELSE substr(strpos_ext, 2) END AS ext, CAST(BYTES(content) AS BIGINT) AS size_bytes, content, file_no
        FROM (
          SELECT CASE WHEN doc_id % 17 = 0 THEN 'src/node_modules/' ELSE 'src/' END || source || '/doc_' || CAST(doc_id AS STRING)
                 || CASE WHEN doc_id % 24 = 2 THEN '.min' ELSE '' END || {_EXT_CASE} AS path,
                 {_EXT_CASE} AS strpos_ext, text AS content, doc_id AS file_no
          FROM {{documents}}
          UNION ALL
          SELECT 'src/web/page_' || CAST(page_id AS STRING) || '.html', '.html', html, -1 - page_id FROM {{pages}}
        ) AS f
        """,
    ),
    "source_units": (("part", "lineitem"), code_corpus.UNITS_SQL),
    "sources": (("part", "lineitem"), code_corpus.SOURCES_SQL),
    "index_state": (
        ("documents", "pages"),
        """
        SELECT path, CASE WHEN file_no % 7 = 0 THEN md5(content || 'x') ELSE md5(content) END AS hash FROM ({files}) AS f1 WHERE file_no % 11 <> 0
        UNION ALL
        SELECT 'src/gone/file_' || CAST(file_no AS STRING) || '.rs', md5('gone') FROM ({files}) AS f2 WHERE file_no % 13 = 0
        """,
    ),
    "vectors": (
        ("embeddings",),
        """
        SELECT 'src/l' || CAST(label AS STRING) || '/v' || CAST(vec_id AS STRING) || '.rs:0' AS chunk_id,
               'src/l' || CAST(label AS STRING) || '/v' || CAST(vec_id AS STRING) || '.rs' AS path,
               CASE label % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'markdown' END AS language,
               embedding, vec_id
        FROM {embeddings}
        """,
    ),
    "passages": (
        ("embeddings",),
        """
        SELECT path || ':' || CAST(vec_id AS STRING) AS chunk_id, path, CASE label % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'markdown' END AS language,
               CAST(vec_id % 900 + 1 AS INT) AS start_line, CAST(vec_id % 900 + 20 AS INT) AS end_line,
               repeat('fn of passage ' || CAST(vec_id AS STRING) || ' ', CAST(vec_id % 40 + 1 AS INT)) AS content, embedding, vec_id
        FROM (SELECT 'src/m' || CAST(vec_id % 200 AS STRING) || '.rs' AS path, * FROM {embeddings}) AS e
        """,
    ),
    "requests": (
        ("embeddings",),
        """
        SELECT vec_id AS request_id, embedding, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'rs' ELSE 'python' END AS language,
               CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'src/m1*.rs' ELSE 'SRC/*7*.rs' END AS glob,
               'fn_' || CAST(vec_id + 1 AS STRING) AS name, 'src/m' || CAST(vec_id % 200 AS STRING) || '.rs' AS path,
               CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'src/' ELSE 'lib' END AS folder, CAST(200 + k * 137 % 1500 AS BIGINT) AS budget
        FROM (SELECT *, CAST(floor(vec_id / 50) AS INT) AS k FROM {embeddings} WHERE vec_id % 50 = 0) AS e
        """,
    ),
    "symbols": (
        ("part",),
        """
        SELECT path || '::' || name AS id, path, name, kind, start_line, start_line + 8 AS end_line, p_partkey AS seq
        FROM (
          SELECT 'src/m' || CAST(p_partkey % 200 AS STRING) || '.rs' AS path,
                 CASE WHEN p_partkey % 10 = 0 THEN 'new' ELSE 'fn_' || CAST(p_partkey AS STRING) END AS name,
                 CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'enum' ELSE 'trait' END AS kind,
                 CAST(floor(p_partkey / 200) * 10 + 1 AS INT) AS start_line, p_partkey
          FROM {part}
        ) AS s
        """,
    ),
    "symbol_calls": (
        ("lineitem", "part"),
        """
        SELECT DISTINCT 'src/m' || CAST(l_partkey % 200 AS STRING) || '.rs::' || CASE WHEN l_partkey % 10 = 0 THEN 'new' ELSE 'fn_' || CAST(l_partkey AS STRING) END AS caller_id,
               CASE WHEN l_orderkey % n % 10 = 0 THEN 'new' ELSE 'fn_' || CAST(l_orderkey % n AS STRING) END AS callee_name,
               CAST(l_suppkey % 100 + 1 AS INT) AS call_line
        FROM {lineitem} CROSS JOIN (SELECT count(*) AS n FROM {part}) AS size
        """,
    ),
    "symbol_imports": (
        ("lineitem",),
        """
        SELECT DISTINCT 'src/m' || CAST(l_partkey % 2000 AS STRING) || '.rs' AS importer,
               'crate::m' || CAST(l_suppkey * 7 % 2000 AS STRING) || '::item_' || CAST(l_linenumber AS STRING) AS from_module,
               'item_' || CAST(l_linenumber AS STRING) AS symbol_name
        FROM {lineitem}
        """,
    ),
    "changes": (
        ("events",),
        """
        SELECT 'src/u' || CAST(user_id AS STRING) || '.rs' AS path, ts, event_id,
               CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'remove' ELSE 'modify' END AS op
        FROM {events}
        """,
    ),
    "new_files": (
        ("documents", "pages"),
        """
        SELECT path, CASE WHEN file_no % 5 = 0 THEN content || ' edited' ELSE content END AS content FROM ({files}) AS f1 WHERE file_no % 9 <> 0
        UNION ALL
        SELECT 'added/' || path, content FROM ({files}) AS f2 WHERE file_no % 19 = 0
        """,
    ),
    "old_details": (
        ("part",),
        "SELECT path, name, min(kind) AS kind, 'fn ' || name || '(' || CAST(min(seq) AS STRING) || ')' AS signature, 'body' || CAST(max(seq) AS STRING) AS body, min(seq) AS seq FROM ({symbols}) AS s GROUP BY path, name",
    ),
    "new_details": (
        ("part",),
        """
        SELECT path, CASE WHEN seq % 11 = 3 THEN name || '_v2' ELSE name END AS name, kind,
               CASE WHEN seq % 7 = 1 THEN signature || ' -> u8' ELSE signature END AS signature,
               CASE WHEN seq % 5 = 2 THEN body || '!' ELSE body END AS body
        FROM ({old_details}) AS o WHERE seq % 13 <> 4
        """,
    ),
}
#: Derived tables that stand for others' text.
_NESTED = ("files", "symbols", "old_details", "source_units")


#: Texts joined by line ends, in an order.
_LINES = re.compile(r"LINES\((\w+) BY (\w+)\)")


def duckdb_lines(text: str) -> str:
    return _LINES.sub(r"string_agg(\1, chr(10) ORDER BY \2)", text)


def sql(name: str, dialect: str = "duckdb") -> str:
    """The text of a derived table; in DuckDB's, base tables are views of their own name."""
    text = DERIVED[name][1]
    for inner in reversed(_NESTED):
        if inner != name:
            text = text.replace("{" + inner + "}", DERIVED[inner][1])
    for inner in _NESTED:
        text = text.replace("{" + inner + "}", DERIVED[inner][1])
    text = text.replace("BYTES(", "strlen(" if dialect == "duckdb" else "octet_length(")
    text = duckdb_lines(text) if dialect == "duckdb" else _LINES.sub(r"listagg(\1, chr(10)) WITHIN GROUP (ORDER BY \2)", text)
    if dialect == "duckdb":
        for base in DERIVED[name][0]:
            text = text.replace("{" + base + "}", base)
    return text


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # braces that name no table are text
    text = sql(name, "spark").replace("{", "{{").replace("}", "}}")
    for t in DERIVED[name][0]:
        text = text.replace("{{" + t + "}}", "{" + t + "}")
    return spark.sql(text, **{t: base(spark, sf_dir, t) for t in DERIVED[name][0]})


def with_ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({sql(n)})" for n in names) + " "
