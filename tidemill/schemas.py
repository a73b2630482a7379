"""Schemas of the index' tables. Nothing is inferred."""

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(), "floats": T.ArrayType(T.FloatType())}

FILES = _struct("path string, ext string, size_bytes bigint, content string")
STATE = _struct("path string, hash string")
CHUNKS = _struct("chunk_id string, content string, source string, chunk_index int, chunk_total int, start_line int, end_line int, file_hash string, content_type string, language string, symbol string, embedding floats")
SYMBOLS = _struct("id string, path string, name string, kind string, start_line int, end_line int")
CALLS = _struct("caller_id string, callee_name string, call_line int")
IMPORTS = _struct("importer string, from_module string, symbol_name string")
TREE = _struct("path string, parent string, node_type string, language string, size_bytes bigint, hash string, depth int")
