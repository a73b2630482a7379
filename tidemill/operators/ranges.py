"""Cutting lines out of files, by number or by the name of what they declare."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import rules
from tidemill.functions import text as X


def line_ranges(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(path, start_line, end_line)`` with the text of those lines."""
    return wanted.join(files.select("path", "content"), "path").select("path", "start_line", "end_line", X.line_range(F.col("content"), F.col("start_line"), F.col("end_line")).alias("text"))


def heuristic_ranges(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(path, symbol)``: from the first line that declares something with the name, and up to 59 more."""
    choice = "|".join(map(re.escape, rules.RANGE_PREFIXES))
    bare = X.trimmed(F.col("line"))
    for q in rules.RANGE_QUALIFIERS:
        bare = F.regexp_replace(bare, "^" + re.escape(q), "")
    lines = wanted.join(files.select("path", "content"), "path").select("path", "symbol", F.posexplode(X.lines_of(F.col("content"))).alias("at", "line"), F.size(X.lines_of(F.col("content"))).alias("n"))
    hits = lines.where(bare.rlike(f"^(?:{choice})") & bare.contains(F.col("symbol")))
    first = hits.groupBy("path", "symbol").agg(F.min("at").alias("at"), F.max("n").alias("n"))
    return first.select("path", "symbol", (F.col("at") + 1).alias("start_line"), F.least(F.col("at") + rules.RANGE_LINES, F.col("n")).alias("end_line"))


def symbol_ranges(files: DataFrame, symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(path, symbol)`` with line range and text: from the symbol table, else by the heuristic."""
    known = symbols.select("path", F.lower("name").alias("low"), "start_line", "end_line")
    own = wanted.join(known, (wanted["path"] == known["path"]) & (F.lower("symbol") == F.col("low"))).groupBy(wanted["path"], "symbol").agg(F.min(F.struct("start_line", "end_line")).alias("r"))
    own = own.select("path", "symbol", "r.start_line", "r.end_line")
    rest = wanted.join(own.select("path", "symbol"), ["path", "symbol"], "left_anti")
    found = own.unionByName(heuristic_ranges(files, rest))
    return found.join(files.select("path", "content"), "path").select("path", "symbol", "start_line", "end_line", X.line_range(F.col("content"), F.col("start_line"), F.col("end_line")).alias("text"))
