"""Symbols, calls and imports as edge tables: look-ups, bounded walks, impact."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import walks
from tidemill.operators.walks import MAX_HOPS, ambiguous_names, first_definitions  # noqa: F401
from tidemill.sources.scratch import materialize

#: Characters of the pieces by which texts are looked up.
GRAM = 3


def same_name(column: str | Column, name: str) -> Column:
    return F.lower(column) == name.lower()


def resolve(symbols: DataFrame, name: str) -> DataFrame:
    """Definitions of a name, whatever its case."""
    return symbols.where(same_name("name", name))


def callees(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Outgoing calls of each symbol.

    Definitions with one id are counted and meet its calls once, in one pass over these; they are then dealt over all tasks, by
    the call and not by the id, before they are written out, so an id with many definitions and many calls fills no task.
    """
    defined = symbols.where("id is not null").groupBy("id").agg(F.count("*").alias("times"))
    met = calls.join(defined, F.col("id") == F.col("caller_id")).select("id", "callee_name", "call_line", "times")
    n = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(n, "id", "callee_name", "call_line")
    return dealt.select("id", "callee_name", "call_line", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")


def callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Incoming calls of each symbol; names are compared as they are."""
    return symbols.select("id", "name").join(calls, F.col("name") == F.col("callee_name")).select(
        "id", X.caller_name(F.col("caller_id")).alias("caller"), X.caller_path(F.col("caller_id")).alias("path"), F.col("call_line").alias("line")
    )


def symbol_resolve(symbols: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """Each definition with its outgoing and incoming calls as arrays."""
    found = resolve(symbols, name)
    out = callees(found, calls).groupBy("id").agg(F.array_sort(F.collect_set("callee_name")).alias("calls"))
    into = callers(found, calls).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("path", "caller", "line"))).alias("called_by"))
    empty = F.array()
    joined = found.join(out, "id", "left").join(into, "id", "left")
    return joined.select("id", F.col("name").alias("symbol"), "kind", "path", "start_line", "end_line", F.coalesce("calls", empty.cast("array<string>")).alias("calls"), "called_by")


def graph_totals(symbols: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return one(symbols, "symbols").unionByName(one(calls, "calls")).unionByName(one(imports, "imports"))


def kind_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


def hot_symbols(symbols: DataFrame, calls: DataFrame, n: int) -> DataFrame:
    """The most called names among those that the project defines."""
    names = symbols.select(F.col("name").alias("callee_name")).distinct()
    counted = calls.groupBy("callee_name").agg(F.count("*").alias("n"))
    return counted.join(names, "callee_name", "left_semi").orderBy(F.desc("n"), "callee_name").limit(n)


def top_files(symbols: DataFrame, n: int) -> DataFrame:
    return symbols.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(n)


def subtree(tree: DataFrame, prefix: str, max_depth: int = 99) -> DataFrame:
    return tree.where(F.col("path").startswith(prefix) & (F.col("depth") <= max_depth)).orderBy("path")


def _request(symbols: DataFrame, **columns: str | list[str]) -> DataFrame:
    """One request for a walk."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>")
    return symbols.sparkSession.range(1).select(F.col("id").alias("request_id"), *(as_column(v).alias(k) for k, v in columns.items()))


def call_graph(symbols: DataFrame, calls: DataFrame | walks.Edges, name: str, depth: int = 2, max_nodes: int = 200) -> DataFrame:
    """``(symbol, hop, path, line, call_line)`` of what a symbol calls, directly or not: ``walks.outgoing`` for one name."""
    return walks.outgoing(symbols, calls, _request(symbols, name=name), depth, max_nodes).drop("request_id").orderBy("hop", "symbol")


def _incoming(symbols: DataFrame, calls: DataFrame | walks.Edges, names: list[str], paths: list[str], hops: int) -> walks.Incoming:
    if not names and not paths:
        raise ValueError("give symbols or paths")
    return walks.Incoming(symbols, calls, _request(symbols, names=names, paths=paths), hops)


def impact_callers(symbols: DataFrame, calls: DataFrame | walks.Edges, names: list[str], paths: list[str], hops: int = 2, max_nodes: int | None = None) -> DataFrame:
    """``(caller_id, name, path, line, distance, via)``: who calls the seeds, directly or not; ``walks.Incoming`` for one request."""
    out = _incoming(symbols, calls, names, paths, hops).callers(max_nodes).drop("request_id")
    return out.orderBy("distance", "via", "caller_id") if max_nodes else out


def dependents(imports: DataFrame) -> DataFrame:
    return imports.select(F.col("from_module").alias("imported"), F.col("importer").alias("dependent")).distinct()


def pattern_rows(paths: DataFrame) -> DataFrame:
    return paths.select("path", F.explode(X.import_patterns(F.col("path"))).alias("pattern"))


def _grams(text: Column, q: Column | int) -> Column:
    """The distinct pieces of ``q`` characters of a text at least as long."""
    n = F.lit(q) if isinstance(q, int) else q
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, n)))


def containing(modules: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys(path, key)`` with each ``modules(from_module)`` that contains the key, whatever its case: an inverted index on pieces.

    A key is looked up by the rarest of its pieces (of ``GRAM`` characters, or of its own length if that is less), and what
    shares that piece is verified. A piece that no module has rules its key out.
    """
    keys = keys.select("path", "key", F.least(F.lit(GRAM), F.length("key")).alias("q"))
    sizes = sorted(r[0] for r in keys.select("q").distinct().collect())  # GRAM numbers at most
    texts = modules.where("from_module is not null").select("from_module", F.lower("from_module").alias("low"))
    index = None
    for q in sizes:
        own = texts.where(F.length("low") >= q).select("from_module", "low", F.explode(_grams(F.col("low"), q)).alias("gram"))
        index = own if index is None else index.unionByName(own)
    if index is None:
        return keys.select("path", "key", F.lit("").alias("from_module")).limit(0)
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = keys.select("key", "q").distinct()
    pieces = asked.select("key", F.explode(_grams(F.col("key"), F.col("q"))).alias("gram")).join(counts, "gram", "left")
    rarest = pieces.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("key", "r.gram")
    hits = index.join(rarest, "gram").where(F.contains("low", F.col("key"))).select("key", "from_module")
    return keys.select("path", "key").join(hits, "key")


def import_pairs(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path, dependent)``: files that import a path, itself included, by the patterns of its language.

    Modules are few next to imports, so patterns meet distinct modules first. A pattern that is open at
    one end is an equality on as many characters of the module, one key per distinct length; those open
    at both ends are looked up by their rarest piece. Wildcards in paths are taken literally, case doesn't count.
    """
    patterns = materialize(pattern_rows(paths).select("path", F.lower("pattern").alias("pattern")), "patterns")
    low = F.lower("from_module")
    modules = imports.select("from_module").distinct()
    open_left, open_right = F.startswith("pattern", F.lit("%")), F.endswith("pattern", F.lit("%"))
    body = F.regexp_replace("pattern", "^%|%$", "")
    met = patterns.where(~open_left & ~open_right).join(modules, low == F.col("pattern")).select("path", "from_module")
    for own, cut in ((patterns.where(~open_left & open_right), F.left), (patterns.where(open_left & ~open_right), F.right)):
        keyed = own.select("path", body.alias("key"))
        lengths = [r[0] for r in keyed.select(F.length("key")).distinct().collect()]
        if lengths:
            cuts = modules.select("from_module", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: cut(F.lower("from_module"), n)))).alias("key"))
            met = met.unionByName(keyed.join(cuts, "key").select("path", "from_module"))
    inside = patterns.where(open_left & open_right).select("path", body.alias("key")).where("key <> ''")
    met = met.unionByName(containing(modules, inside).select("path", "from_module"))
    return met.distinct().join(dependents(imports), F.col("from_module") == F.col("imported")).select("path", "dependent").distinct()


def import_dependents(imports: DataFrame, paths: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """``(path, dependent)``: files that import a path; ``within`` (the paths themselves, if not given) are left out."""
    leave = within if within is not None else paths
    return import_pairs(imports, paths).join(leave.select(F.col("path").alias("dependent")).distinct(), "dependent", "left_anti")


def same_start(changed: DataFrame) -> DataFrame:
    """``(request_id, start)``: requests with the same distinct paths share a start, 128 bits of what they are."""
    one = changed.select("request_id", "path").distinct()
    bits = lambda seed: F.xxhash64("path", F.lit(seed)).cast("decimal(38,0)")
    return one.groupBy("request_id").agg(F.concat_ws(":", F.count("*"), F.sum(bits(1)), F.sum(bits(2))).alias("start"))


def dependents_of(imports: DataFrame, changed: DataFrame, hops: int) -> DataFrame:
    """``(request_id, path, hop)`` of the files that import those of ``changed(request_id, path)``, directly or not.

    What is reached depends on the paths that a request starts from and on nothing else of it, so requests with equal ones are
    walked once. Each hop looks up the paths of all frontiers once. A walk that has met every importer has no hop beyond.
    """
    starts = materialize(same_start(changed), "starts")
    seen = materialize(starts.join(changed.select("request_id", "path").distinct(), "request_id").select("start", "path").distinct(), "start-paths")
    frontier, found = seen, []
    everyone = imports.select(F.col("importer").alias("path")).where("path is not null").distinct() if hops > 1 else None
    for hop in range(1, max(1, min(hops, MAX_HOPS)) + 1):
        if hop > 1:
            # a walk goes on only where a file is left to be met
            everyone = materialize(everyone, "importers") if hop == 2 else everyone
            met = seen.join(everyone, "path", "left_semi").groupBy("start").agg(F.count("*").alias("met"))
            left = met.where(F.col("met") < everyone.count()).select("start")
            frontier = materialize(frontier.join(left, "start", "left_semi"), "left")
            if frontier.isEmpty():
                break
        pairs = import_pairs(imports, frontier.select("path").distinct())
        new = frontier.join(pairs, "path").select("start", F.col("dependent").alias("path")).distinct().join(seen, ["start", "path"], "left_anti")
        frontier = materialize(new, "dependents")
        found.append(frontier.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return starts.join(walks.union(found), "start").select("request_id", "path", "hop")


def import_dependents_transitive(imports: DataFrame, paths: DataFrame, hops: int) -> DataFrame:
    """``(dependent, hop)`` of the files that import the paths, directly or not."""
    return dependents_of(imports, paths.select(F.lit(0).alias("request_id"), "path"), hops).select(F.col("path").alias("dependent"), "hop")


def importers_of(imports: DataFrame, module: str) -> DataFrame:
    return imports.where(F.lower("from_module").contains(module.lower())).select("importer").distinct()


def impact_files(symbols: DataFrame, calls: DataFrame | walks.Edges, imports: DataFrame, names: list[str], paths: list[str], hops: int = 2) -> DataFrame:
    """``(path)`` of the files that a change reaches, by calls or imports, without the changed ones."""
    walk = _incoming(symbols, calls, names, paths, hops)
    return walk.files(dependents_of(imports, walk.changed(), hops)).select("path")


#: The sentences of an impact report.
SIGNALS = {
    "impacts": "Changing '%s' (%s, %s) impacts %d direct caller(s) in %d file(s): %s%s",
    "more": ", +%d more",
    "unknown": "Symbol '%s' was not found in the symbol graph — impact for it is unknown (run ensure_index again, or check the name)",
    "skipped": "Symbol '%s' is defined in multiple places — name-based caller matching would be unreliable, so its call-graph walk was skipped (pass it explicitly in 'symbols' to force it)",
    "several": "Note: '%s' has multiple definitions in the project — some listed callers may refer to the other definitions",
}


def breaking_signals(symbols: DataFrame, calls: DataFrame | walks.Edges, names: list[str], paths: list[str], hops: int = 2) -> DataFrame:
    """``(symbol, signal)``: a sentence for each seed with direct callers, and notes on unclear or unknown names."""
    return _incoming(symbols, calls, names, paths, 1).signals(SIGNALS).drop("request_id")


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by path and line, spans before the lines that they may hold: a stack of the spans that are open."""
    path, stack = None, []
    for rows in batches:
        out = []
        for own, at, span, symbol, end in zip(rows["path"], rows["at"], rows["span"], rows["id"], rows["end_line"], strict=True):
            if own != path:
                path, stack = own, []
            if span:
                stack.append((end, symbol))
                continue
            while stack and stack[-1][0] < at:
                stack.pop()
            if stack:
                out.append((own, at, stack[-1][1]))
        yield pd.DataFrame(out, columns=["path", "line", "id"])


def enclosing_symbols(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """``lines(path, line)``, each once, with the id of the innermost symbol around it: the one that starts last.

    One sweep over the lines and spans of a path in their order; a task holds the spans that are open, not a file's.
    A span that ends above a line is dropped when the line is reached, so the last one left is the answer.
    """
    asked = lines.select("path", F.col("line").cast("int").alias("at")).where("path is not null and at is not null").distinct()
    asked = asked.select("path", "at", F.lit(False).alias("span"), F.lit("").alias("id"), F.lit(0).alias("end_line"))
    spans = symbols.where("path is not null and start_line <= end_line").select("path", F.col("start_line").cast("int").alias("at"), F.lit(True).alias("span"), "id", F.col("end_line").cast("int").alias("end_line"))
    rows = spans.unionByName(asked).repartition("path").sortWithinPartitions("path", "at", F.desc("span"), "id")
    return rows.mapInPandas(_sweep, "path string, line int, id string")


def symbol_end_lines(symbols: DataFrame) -> DataFrame:
    """Ends estimated from the next symbol's start; the last one in a file keeps its own."""
    w = Window.partitionBy("path").orderBy("start_line", "id")
    return symbols.withColumn("end_line", F.coalesce(F.greatest(F.lead("start_line").over(w) - 1, "start_line"), "end_line"))
