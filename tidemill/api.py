"""One method per tool, over an index store."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import Config
from tidemill.functions import text as X
from tidemill.operators import bundle, chunk, diff, graph, ingest, parse, ranges, requests, scan, search, skeleton, state, walks
from tidemill.sources.store import IndexStore
from tidemill.sources.tree import read_pruned


class Engine:
    """Search, structure and impact over an indexed tree of files.

    ``files`` is a callable that gives the present ``files(path, ext, size_bytes, content)``;
    by default the tree below ``root`` is read, without what the configuration excludes. ``observer`` is told of every call.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        store: str | None = None,
        config: Config | None = None,
        files: Callable[[], DataFrame] | None = None,
        embedder: Callable | None = None,
        observer: Callable[[str, dict], None] | None = None,
    ):
        self.spark, self.root = spark, root
        self.config = config or Config()
        self.store = IndexStore(spark, store or f"{root.rstrip('/')}/.tidemill")
        self.files = files or (lambda: read_pruned(spark, root, self.config))
        dimension = self.config.dimension
        self.embedder = embedder or (lambda: search.hash_embedder(dimension))
        self.observer = observer
        self.bundle_stats: list[dict[str, float]] = []
        self._adjacency: dict[tuple[int | None, str], walks.Edges] = {}

    def _tell(self, tool: str, **args: Any) -> None:
        if self.observer:
            self.observer(tool, args)

    # --- index ----------------------------------------------------------------------------

    def ensure_index(self, force: bool = False) -> ingest.IngestReport:
        self._tell("ensure_index", force=force)
        return ingest.update(self.store, self.files(), self.config, self.embedder, force)

    update = ensure_index

    def index_status(self) -> dict[str, Any]:
        self._tell("index_status")
        row = ingest.status(self.store, self.files(), self.config).first().asDict()
        return row | {"version": self.store.version, "last_bundle": self.bundle_stats[-1] if self.bundle_stats else None}

    def skip_report(self) -> DataFrame:
        return scan.skip_stats(self.files(), self.config)

    def graph_stats(self, n: int = 10) -> dict[str, DataFrame]:
        symbols, calls, imports = (self.store.read(t) for t in ("symbols", "calls", "imports"))
        return {
            "totals": graph.graph_totals(symbols, calls, imports),
            "kinds": graph.kind_counts(symbols),
            "hot_symbols": graph.hot_symbols(symbols, calls, n),
            "top_files": graph.top_files(symbols, n),
        }

    def clean(self) -> None:
        self.store.clean()

    # --- search ---------------------------------------------------------------------------

    def _vectors(self) -> DataFrame:
        return self.store.read("chunks").withColumnRenamed("source", "path")

    def search(self, query: str, k: int | None = None, language: str | None = None, glob: str | None = None, overfetch: bool = False) -> DataFrame:
        k = self.config.context_chunks if k is None else k
        self._tell("search", query=query, k=k, language=language, glob=glob)
        vector = self.embedder()([query])[0].tolist()
        found = search.top_k(self._vectors(), vector, min(k, self.config.max_results), language, glob, overfetch)
        return found.select("chunk_id", "path", "score", "start_line", "end_line", "language", X.clamp(F.col("content"), 400).alias("snippet"), "symbol")

    def get_chunks(self, ids: Sequence[str], max_chars: int = 2000) -> DataFrame:
        self._tell("get_chunks", ids=list(ids))
        return chunk.by_ids(self.store.read("chunks").drop("embedding"), list(ids), max_chars)

    def get_ranges(self, path: str, lines: Sequence[tuple[int, int]] = (), symbols: Sequence[str] = ()) -> DataFrame:
        path = scan.resolve_in_root(path)
        self._tell("get_ranges", path=path)
        files = self.files().where(F.col("path") == path)
        by_line = ranges.line_ranges(files, self.spark.createDataFrame([(path, a, b) for a, b in lines], "path string, start_line int, end_line int"))
        by_name = ranges.symbol_ranges(files, self.store.read("symbols"), self.spark.createDataFrame([(path, s) for s in symbols], "path string, symbol string"))
        return by_line.withColumn("symbol", F.lit(None).cast("string")).unionByName(by_name)

    def get_skeleton(self, path: str) -> dict[str, Any]:
        path = scan.resolve_in_root(path)
        self._tell("get_skeleton", path=path)
        file = self.files().where(F.col("path") == path).withColumn("language", X.language_of(F.col("ext")))
        row = skeleton.skeletons(file).select("skeleton", X.simple_tokens(F.col("content")).alias("full"), X.simple_tokens(F.col("skeleton")).alias("short")).first()
        if row is None:
            raise FileNotFoundError(path)
        return {"skeleton": row["skeleton"], "full_tokens": row["full"], "skeleton_tokens": row["short"], "ratio": round(row["full"] / row["short"], 2) if row["short"] else 0.0}

    # --- structure ------------------------------------------------------------------------

    def symbol_resolve(self, symbol: str) -> DataFrame:
        self._tell("symbol_resolve", symbol=symbol)
        return graph.symbol_resolve(self.store.read("symbols"), self.store.read("calls"), symbol)

    def call_graph(self, symbol: str, depth: int | None = None) -> DataFrame:
        self._tell("call_graph", symbol=symbol, depth=depth)
        depth = min(depth or self.config.graph_depth, self.config.graph_depth)
        return graph.call_graph(self.store.read("symbols"), self._calls_by("caller_id"), symbol, depth, self.config.max_nodes)

    def _calls_by(self, end: str) -> walks.Edges:
        """The calls of the present version in buckets of one end: written once, read by every walk until the index changes."""
        key = (self.store.version, end)
        if key not in self._adjacency:
            self._adjacency = {k: v for k, v in self._adjacency.items() if k[0] == key[0]}
            self._adjacency[key] = walks.stored(self.store.read("calls"), end)
        return self._adjacency[key]

    def importers_of(self, module: str) -> DataFrame:
        return graph.importers_of(self.store.read("imports"), module)

    def impact(self, symbols: Sequence[str] = (), paths: Sequence[str] = ()) -> dict[str, Any]:
        self._tell("impact", symbols=list(symbols), paths=list(paths))
        tables = [self.store.read("symbols"), self._calls_by("callee_name"), self.store.read("imports")]
        names, changed, hops, cap = list(symbols), [scan.resolve_in_root(p) for p in paths], self.config.graph_depth, self.config.max_nodes
        affected = graph.impact_callers(*tables[:2], names, changed, hops, cap + 1).limit(cap + 1).collect()
        files = sorted(r[0] for r in graph.impact_files(*tables, names, changed, hops).limit(cap).collect())
        signals = [r["signal"] for r in graph.breaking_signals(*tables[:2], names, changed, hops).limit(cap).collect()]
        return {"changed_paths": changed, "affected_files": files, "affected_symbols": [r.asDict() for r in affected[:cap]], "breaking_signals": signals, "truncated": len(affected) > cap}

    def review_diff(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Changes by symbol between two snapshots ``(path, content)``, with the callers they touch."""
        touched = diff.diffable(diff.changed_files(old, new)).select("path")

        def details(files: DataFrame) -> DataFrame:
            some = files.join(touched, "path", "left_semi").withColumn("language", X.language_of(X.extension(F.col("path"))))
            found = parse.symbols_of(parse.parse_files(some))
            return state.last_wins(found, ["path", "name"], ["start_line"]).select("path", "name", "kind", "signature", "body")

        return diff.summary_lines(diff.with_callers(diff.symbol_changes(details(old), details(new)), self.store.read("calls")))

    # --- tables of requests ---------------------------------------------------------------

    def _embedded(self, asked: DataFrame, column: str) -> DataFrame:
        return search.embed_rows(asked, column, self.embedder, self.config.dimension)

    def search_batch(self, asked: DataFrame, k: int | None = None) -> DataFrame:
        """``search`` for ``asked(request_id, query[, language, glob])`` in one plan."""
        k = min(self.config.context_chunks if k is None else k, self.config.max_results)
        self._tell("search_batch", k=k)
        found = requests.search_batch(self._vectors(), self._embedded(asked, "query"), k)
        rows = self._vectors().select("chunk_id", "path", "start_line", "end_line", "language", X.clamp(F.col("content"), 400).alias("snippet"), "symbol")
        return found.join(rows, "chunk_id")

    def impact_batch(self, asked: DataFrame) -> dict[str, DataFrame]:
        """``impact`` for ``asked(request_id, names array, paths array)``: tables of callers, files and signals."""
        self._tell("impact_batch")
        return requests.impact_batch(self.store.read("symbols"), self._calls_by("callee_name"), self.store.read("imports"), asked, self.config.graph_depth, self.config.max_nodes)

    def bundle_batch(self, asked: DataFrame) -> requests.BundleBatch:
        """``context_bundle`` for ``asked(request_id, task[, budget])``: no request is collected."""
        cfg = self.config
        self._tell("bundle_batch")
        budget = F.least(F.coalesce(F.col("budget"), F.lit(cfg.bundle_budget)), F.lit(cfg.bundle_max_tokens)) if "budget" in asked.columns else F.lit(min(cfg.bundle_budget, cfg.bundle_max_tokens))
        asked = asked.select("request_id", "task", budget.alias("budget"))
        near = requests.search_batch(self._vectors(), self._embedded(asked, "task"), cfg.bundle_max_chunks)
        hits = near.join(self._vectors(), "chunk_id").select("request_id", "chunk_id", "path", "score", bundle.result_json().alias("item"), X.token_estimate(F.col("content"), F.col("language")).alias("own_tokens"))
        return requests.BundleBatch(asked, hits, self.store.read("symbols"), self.store.read("imports"), self.store.read("tree"), cfg.bundle_max_files)

    # --- context --------------------------------------------------------------------------

    def context_bundle(self, task: str, budget_tokens: int | None = None) -> dict[str, Any]:
        """Chunks, symbols, dependents and folders for a task, within a token budget."""
        cfg = self.config
        budget = min(budget_tokens or cfg.bundle_budget, cfg.bundle_max_tokens)
        self._tell("context_bundle", task=task, budget=budget)
        vector = self.embedder()([task])[0].tolist()
        hits = search.top_k(self._vectors(), vector, cfg.bundle_max_chunks).drop("embedding")
        # at most bundle_max_chunks rows: the rest of the assembly reads them from the driver
        rows = hits.collect()
        local = self.spark.createDataFrame(rows, hits.schema)
        chosen = bundle.select_chunks(local, budget).orderBy(F.desc("score"), "chunk_id").select("chunk_id", "path", "score", "start_line", "end_line", "tokens", bundle.result_json().alias("item"), X.token_estimate(F.col("content"), F.col("language")).alias("own")).collect()
        used = sum(r["tokens"] for r in chosen)
        candidate = local.agg(F.coalesce(F.sum(X.token_estimate(F.col("content"), F.col("language"))), F.lit(0))).first()[0]
        matched = sorted(dict.fromkeys(r["path"] for r in rows[: cfg.bundle_max_files]))
        paths = self.spark.createDataFrame([(p,) for p in matched], "path string")
        symbols: list[dict] = []
        if used < budget * 80 // 100:
            for r in self.store.read("symbols").join(F.broadcast(paths), "path", "left_semi").orderBy("path", "start_line").limit(cfg.bundle_max_tokens).collect():
                if used >= budget * 80 // 100 and (not symbols or symbols[-1]["path"] != r["path"]):
                    break
                item = {"symbol": r["name"], "kind": r["kind"], "path": r["path"], "line": r["start_line"]}
                used += -(-len(json.dumps(item)) // 4)
                symbols.append(item)
        impact = None
        if used < budget * 90 // 100:
            reached = sorted(r[0] for r in graph.import_dependents(self.store.read("imports"), paths).select("dependent").distinct().limit(cfg.max_nodes).collect())
            impact = f"{len(reached)} file(s) depend on the matched code: {', '.join(reached[:5])}" if reached else "No downstream dependents detected."
            used += -(-len(impact) // 4)
        tree: list[str] = []
        if used < budget:
            for folder in sorted({p.rpartition("/")[0] for p in matched})[:3]:
                for r in graph.subtree(self.store.read("tree"), folder + "/" if folder else "", 2).limit(20).collect():
                    if r["path"] not in tree:
                        tree.append(r["path"])
                        used += len(r["path"].encode()) // 4 + 1
        baseline = self.files().join(F.broadcast(paths), "path", "left_semi").agg(F.coalesce(F.sum(X.token_estimate(F.col("content"), X.language_of(F.col("ext")))), F.lit(0))).first()[0]
        stats = bundle.metrics(candidate, sum(r["own"] for r in chosen), used, baseline)
        self.bundle_stats.append(stats)
        return {"chunks": [json.loads(r["item"]) for r in chosen], "symbols": symbols, "impact_summary": impact, "tree_snapshot": tree, "metrics": stats}
