"""Bounded walks over calls for many requests at once, over adjacency that is stored by the end a walk starts from.

``stored`` writes calls once, bucketed and sorted by caller or by callee. A hop then joins its frontier with the bucketed
table: the frontier is moved (or broadcast, where Spark sees that it is small), the edges stay where they are, and what
is shuffled afterwards are the edges that were met. Every request is a column of the frontier, so a thousand walks are
as many joins as one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.sources.scratch import materialize, scratch

#: Hops beyond this are refused: each is one join over the frontier.
MAX_HOPS = 5


@dataclass
class Edges:
    """Edges in buckets of the end ``by`` and of a salt, and the keys that have more than one salt (fewer than there are buckets)."""

    table: DataFrame
    by: str
    hot: DataFrame
    salts: int


def stored(edges: DataFrame, by: str, buckets: int | None = None) -> Edges:
    """``edges`` as a table in buckets of ``by``, sorted within; as many buckets as shuffles have partitions.

    A key with more than a bucket's share of all edges is dealt over all buckets by a salt of its edges. Edges whose key is
    null can't be met and are left out.
    """
    spark = edges.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tidemill_adjacency_{uuid.uuid4().hex}"
    edges = materialize(edges.where(F.col(by).isNotNull()), "edges")
    share = edges.count() // n
    hot = materialize(edges.groupBy(F.col(by).alias("hot")).agg(F.count("*").alias("n")).where(F.col("n") > share).select("hot"), "hot")
    salt = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*(c for c in edges.columns if c != by)), F.lit(n))).cast("int")
    dealt = edges.join(F.broadcast(hot), F.col(by) == F.col("hot"), "left").withColumn("_salt", salt).drop("hot")
    dealt.repartition(n, by, "_salt").write.bucketBy(n, by, "_salt").sortBy(by).option("path", scratch(spark, "adjacency")).format("parquet").saveAsTable(name)
    return Edges(spark.table(name), by, hot, n)


def meet(frontier: DataFrame, column: str, edges: DataFrame | Edges, by: str) -> DataFrame:
    """The frontier's rows with the edges at their ``column``; rows at a hot key go to each of its salts."""
    if isinstance(edges, DataFrame):
        return frontier.join(edges, F.col(column) == F.col(by))
    if edges.by != by:
        raise ValueError(f"these edges are stored by {edges.by}, not by {by}")
    salts = F.when(F.col("hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(edges.salts - 1)))
    salted = frontier.join(F.broadcast(edges.hot), F.col(column) == F.col("hot"), "left").withColumn("_at", F.explode(salts)).drop("hot")
    return salted.join(edges.table, (F.col(column) == F.col(by)) & (F.col("_at") == F.col("_salt"))).drop("_at", "_salt")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def first_definitions(symbols: DataFrame) -> DataFrame:
    """One definition for each lower-cased name: the first by path, line and id."""
    low = symbols.withColumn("low_name", F.lower("name"))
    first = F.min(F.struct("path", "start_line", "id", "name", "kind")).alias("d")
    return low.groupBy("low_name").agg(first).select("low_name", "d.*")


def ambiguous_names(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(F.lower("name").alias("low_name")).agg(F.count("*").alias("definitions")).where("definitions > 1")


def capped(rows: DataFrame, max_nodes: int | None, *order: str | Column) -> DataFrame:
    """The first ``max_nodes`` rows of each request; each task cuts before the shuffle."""
    if max_nodes is None:
        return rows
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= max_nodes).drop("_place")


def outgoing(symbols: DataFrame, calls: DataFrame | Edges, requests: DataFrame, depth: int, max_nodes: int | None) -> DataFrame:
    """``(request_id, symbol, hop, path, line, call_line)`` of what the symbol of each of ``requests(request_id, name)`` calls, directly or not.

    A callee is listed at its first hop, and the walk goes on through its first definition. Beyond ``max_nodes`` rows of a
    request, by hop and name, they are cut. A name that nobody defines gives no rows.
    """
    depth = max(1, min(depth, MAX_HOPS))
    firsts = materialize(first_definitions(symbols), "definitions").select("low_name", F.col("path").alias("d_path"), F.col("start_line").alias("d_line"), F.col("id").alias("d_id"))
    asked = requests.select("request_id", F.lower("name").alias("low_name"))
    frontier = asked.join(firsts, "low_name").select("request_id", F.col("d_id").alias("from_id"))
    hops: list[DataFrame] = []
    for hop in range(1, depth + 1):
        met = meet(frontier, "from_id", calls, "caller_id").groupBy("request_id", F.col("callee_name").alias("symbol")).agg(F.min("call_line").alias("call_line"))
        if hops:
            met = met.join(union([h.select("request_id", "symbol") for h in hops]), ["request_id", "symbol"], "left_anti")
        found = met.join(firsts, F.lower("symbol") == F.col("low_name"), "left").select(
            "request_id", "symbol", F.lit(hop).alias("hop"), F.coalesce("d_path", F.lit("")).alias("path"), F.coalesce("d_line", F.lit(0)).alias("line"), "call_line", "d_id"
        )
        hops.append(materialize(found, "hop"))
        frontier = hops[-1].where("d_id is not null").select("request_id", F.col("d_id").alias("from_id")).distinct()
    return capped(union(hops).drop("d_id"), max_nodes, "hop", "symbol")


class Incoming:
    """The walk from changed symbols to their callers, for ``requests(request_id, names array, paths array)``.

    A request's seeds are the definitions of its names, whatever their case, and all symbols of its paths. Names with several
    definitions are walked through only where the request names them. A caller is listed at its first distance, through the
    smallest name that led to it.
    """

    def __init__(self, symbols: DataFrame, calls: DataFrame | Edges, requests: DataFrame, hops: int = 2):
        self.symbols, self.requests = symbols, requests
        self.asked = requests.select("request_id", F.explode("names").alias("name")).where("name is not null").distinct()
        self.paths = requests.select("request_id", F.explode("paths").alias("path")).where("path is not null").distinct()
        columns = ["request_id", "id", F.struct("start_line", "name", "kind", "path").alias("s")]
        by_name = self.asked.select("request_id", F.lower("name").alias("low")).distinct().join(symbols, F.lower(symbols["name"]) == F.col("low")).select(columns)
        # a path's definitions of one id are folded before every request at the path meets them
        ids = symbols.where("path is not null").groupBy("path", "id").agg(F.min(F.struct("start_line", "name", "kind", "path")).alias("s"))
        by_path = ids.join(self.paths, "path").select("request_id", "id", "s")
        # of definitions with one id the first stands for all
        self.seeds = materialize(by_name.unionByName(by_path).groupBy("request_id", "id").agg(F.min("s").alias("s")).select("request_id", "id", "s.name", "s.kind", "s.path"), "seeds")
        self.doubtful = materialize(ambiguous_names(symbols).select("low_name"), "ambiguous")
        self.found = self._walk(calls, max(1, min(hops, MAX_HOPS)))

    def skipped(self) -> DataFrame:
        """``(request_id, name)`` of the seeds that are not walked through."""
        unclear = self.seeds.select("request_id", "name").distinct().join(self.doubtful, F.lower("name") == F.col("low_name"), "left_semi")
        return unclear.join(self.asked, ["request_id", "name"], "left_anti")

    def _walk(self, calls: DataFrame | Edges, hops: int) -> DataFrame:
        frontier = self.seeds.select("request_id", "name").distinct().join(self.skipped(), ["request_id", "name"], "left_anti").withColumnRenamed("name", "via")
        seen, found = self.seeds.select("request_id", F.col("id").alias("caller_id")), []
        for hop in range(1, hops + 1):
            met = meet(frontier, "via", calls, "callee_name").groupBy("request_id", "caller_id").agg(F.min(F.struct("via", "call_line")).alias("first"))
            new = met.join(seen, ["request_id", "caller_id"], "left_anti").select(
                "request_id", "caller_id", X.caller_name(F.col("caller_id")).alias("name"), X.caller_path(F.col("caller_id")).alias("path"), F.col("first.call_line").alias("line"), F.lit(hop).alias("distance"), F.col("first.via").alias("via")
            )
            found.append(materialize(new, "callers"))
            seen = seen.unionByName(found[-1].select("request_id", "caller_id"))
            frontier = found[-1].join(self.doubtful, F.lower("name") == F.col("low_name"), "left_anti").select("request_id", F.col("name").alias("via")).distinct()
        return union(found)

    def callers(self, max_nodes: int | None = None) -> DataFrame:
        return capped(self.found, max_nodes, "distance", "via", "caller_id")

    def changed(self) -> DataFrame:
        """``(request_id, path)`` of the files that a request changes."""
        return self.seeds.select("request_id", "path").unionByName(self.paths).distinct()

    def files(self, dependents: DataFrame) -> DataFrame:
        """``(request_id, path)`` reached by calls or by ``dependents(request_id, path)``, without the changed ones."""
        reached = self.found.select("request_id", "path").unionByName(dependents.select("request_id", "path")).distinct()
        return reached.join(self.changed(), ["request_id", "path"], "left_anti")

    def signals(self, sentences: dict[str, str]) -> DataFrame:
        """``(request_id, symbol, signal)``: a sentence for each seed with direct callers, and notes on unclear or unknown names.

        Callers are counted by partial aggregates; of their names no more than the three that a sentence shows are gathered.
        """
        direct = self.found.where("distance = 1")
        key = ["request_id", "via"]
        counts = direct.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"), F.count_distinct("name").alias("names"))
        place = F.row_number().over(Window.partitionBy(key).orderBy("name"))
        few = direct.select(*key, "name").distinct().withColumn("_place", place).where("_place <= 3")
        few = few.groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("who"))
        more = F.when(F.col("names") > 3, F.format_string(sentences["more"], F.col("names") - 3)).otherwise("")
        text = F.format_string(sentences["impacts"], "name", "kind", "path", "n", "files", F.array_join("who", ", "), more)
        shown = self.seeds.join(counts.join(few, key).withColumnRenamed("via", "name"), ["request_id", "name"])
        known = self.symbols.select(F.lower("name").alias("low_name")).distinct()
        unknown = self.asked.join(known, F.lower("name") == F.col("low_name"), "left_anti")
        several = self.asked.join(self.doubtful, F.lower("name") == F.col("low_name"), "left_semi")
        out = [shown.select("request_id", F.col("name").alias("symbol"), text.alias("signal"))]
        for rows, what in ((unknown, "unknown"), (several, "several"), (self.skipped(), "skipped")):
            out.append(rows.select("request_id", F.col("name").alias("symbol"), F.format_string(sentences[what], "name").alias("signal")))
        return union(out)
