"""Walks and tools over tables of requests, against loops and single calls."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.api import Engine
from tidemill.operators import diff, graph, requests, walks

SYMBOLS = "id string, path string, name string, kind string, start_line int, end_line int"
CALLS = "caller_id string, callee_name string, call_line int"
IMPORTS = "importer string, from_module string, symbol_name string"


@pytest.fixture(scope="module")
def project(spark):
    rng = random.Random(11)
    symbols = [(f"src/p{i % 5}.rs::f{i % 28}", f"src/p{i % 5}.rs", f"f{i % 28}", "function", i + 1, i + 2) for i in range(32)]
    calls = sorted({(f"src/p{a % 5}.rs::f{a % 28}", f"f{b}", a + b) for a, b in ((rng.randrange(32), rng.randrange(34)) for _ in range(70))})
    imports = [("src/p1.rs", "crate::p0::x", "x"), ("src/p2.rs", "crate::p1::y", "y"), ("src/p0.rs", "crate::p0::z", "z")]
    return symbols, calls, [spark.createDataFrame(rows, schema) for rows, schema in ((symbols, SYMBOLS), (calls, CALLS), (imports, IMPORTS))]


def loop_callers(symbols, calls, names, paths, hops):
    low = {n.lower() for n in names}
    seeds = {s[0]: s[2] for s in symbols if s[2].lower() in low or s[1] in paths}
    count = {n: sum(s[2].lower() == n for s in symbols) for n in {s[2].lower() for s in symbols}}
    frontier = {n for n in seeds.values() if count[n.lower()] == 1 or n in names}
    seen, out = set(seeds), {}
    for hop in range(1, hops + 1):
        met = {}
        for caller, callee, line in calls:
            if callee in frontier and caller not in seen:
                met[caller] = min(met.get(caller, (callee, line)), (callee, line))
        out |= {c: (hop, *v) for c, v in met.items()}
        seen |= set(met)
        frontier = {c.split("::", 1)[1] for c in met if count.get(c.split("::", 1)[1].lower(), 0) < 2}
    return out


def test_walks_of_many_requests_equal_loops(spark, project):
    symbols, calls, (s, c, _) = project
    asked = [(1, ["F3", "f7"], []), (2, [], ["src/p2.rs"]), (3, ["f1"], ["src/p4.rs", None]), (4, ["nobody", None], None), (5, None, ["src/none.rs"]), (6, ["f1", "f1"], [])]
    walk = walks.Incoming(s, walks.stored(c, "callee_name"), spark.createDataFrame(asked, "request_id int, names array<string>, paths array<string>"), 3)
    got = {}
    for r in walk.callers().collect():
        got.setdefault(r["request_id"], {})[r["caller_id"]] = (r["distance"], r["via"], r["line"])
    want = {i: loop_callers(symbols, calls, {n for n in names or () if n}, paths or (), 3) for i, names, paths in asked}
    assert got == {i: w for i, w in want.items() if w} and len(got) >= 3
    few = [(r["request_id"], r["caller_id"]) for r in walk.callers(2).collect()]
    assert sorted(few) == sorted((i, c) for i, w in want.items() for _, _, c in sorted((v[0], v[1], c) for c, v in w.items())[:2])
    signals = {(r["request_id"], r["symbol"]) for r in walk.signals(graph.SIGNALS).collect()}
    assert (4, "nobody") in signals and (1, "F3") in signals
    single = graph.impact_callers(s, c, ["f1"], ["src/p4.rs"], 3)
    assert {r["caller_id"] for r in single.collect()} == set(want[3])


def test_outgoing_walks_of_many_requests(spark, project):
    _, _, (s, c, _) = project
    asked = spark.createDataFrame([(1, "F3"), (2, "f9"), (3, "nobody"), (4, None)], "request_id int, name string")
    got = walks.outgoing(s, walks.stored(c, "caller_id"), asked, 3, 6).collect()
    for i, name in ((1, "F3"), (2, "f9"), (3, "nobody")):
        assert sorted((r["hop"], r["symbol"], r["call_line"]) for r in got if r["request_id"] == i) == sorted((r["hop"], r["symbol"], r["call_line"]) for r in graph.call_graph(s, c, name, 3, 6).collect())


def test_a_hop_moves_the_frontier_and_no_edges(spark, project):
    _, _, (_, c, _) = project
    edges = walks.stored(c, "callee_name")
    frontier = spark.createDataFrame([(1, "f1"), (2, "f2")], "request_id int, via string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = walks.meet(frontier, "via", edges, "callee_name")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 1 and "Bucketed: true" in plan


def test_hot_keys_are_dealt_over_all_buckets(spark):
    rows = [(f"p::c{i}", "new" if i % 3 else f"f{i}", i) for i in range(600)] + [("p::c0", None, 1)]
    edges = walks.stored(spark.createDataFrame(rows, CALLS), "callee_name", 8)
    assert [r[0] for r in edges.hot.collect()] == ["new"] and edges.table.where("callee_name = 'new'").select("_salt").distinct().count() == 8
    frontier = spark.createDataFrame([(1, "new"), (2, "f3"), (2, "new"), (3, "none"), (3, None)], "request_id int, via string")
    got = sorted((r["request_id"], r["caller_id"], r["call_line"]) for r in walks.meet(frontier, "via", edges, "callee_name").collect())
    assert got == sorted((q, c, n) for q, v in ((1, "new"), (2, "f3"), (2, "new")) for c, name, n in rows if name == v)
    with pytest.raises(ValueError):
        walks.meet(frontier, "via", edges, "caller_id")


def loop_bundle(budget, hits, symbols, dependents, tree):
    used, per_file, out = 0, {}, []
    cost = lambda text: -(-len(text) // 4)
    for _, path, item in hits:
        if used >= budget * 60 // 100:
            break
        if per_file.get(path, 0) < 3:
            per_file[path] = per_file.get(path, 0) + 1
            out.append(("chunk", item))
            used += cost(item)
    matched = sorted({path for _, path, _ in hits[:8]})
    for path in matched:
        if used >= budget * 80 // 100:
            break
        for s in (s for s in symbols if s[1] == path):
            item = f'{{"symbol":"{s[2]}","kind":"{s[3]}","path":"{path}","line":{s[4]}}}'
            out.append(("symbol", item))
            used += cost(item)
    if used < budget * 90 // 100:
        found = sorted(d for p in matched for d in dependents.get(p, ()) if d not in matched)
        item = f"{len(found)} file(s) depend on the matched code: {', '.join(found[:5])}" if found else requests.NO_DEPENDENTS
        out.append(("impact", item))
        used += cost(item)
    for folder in sorted({p.rpartition("/")[0] for p in matched})[:3]:
        if used >= budget:
            break
        for p in sorted(p for p in tree if p.startswith(folder + "/"))[:20]:
            out.append(("tree", p))
            used += len(p) // 4 + 1
    return sorted(out), used


def test_bundles_equal_a_loop(spark, project):
    symbols, _, (s, _, i) = project
    rng = random.Random(2)
    tree = [f"src/p{n}.rs" for n in range(5)] + [f"lib/q{n:02}.rs" for n in range(30)]
    hits = {q: [(f"c{n:02}", rng.choice(["src/p0.rs", "src/p1.rs", "lib/q01.rs"]), "x" * rng.randint(1, 90)) for n in range(12)] for q in range(1, 9)}
    asked = [(q, b) for q, b in zip(range(1, 10), (0, 40, 100, 200, 300, 500, 900, 4000, 200), strict=True)]  # the last one has no hits
    rows = [(q, c, path, 1 - n / 100, item, len(item)) for q, own in hits.items() for n, (c, path, item) in enumerate(own)]
    bundles = requests.BundleBatch(
        spark.createDataFrame(asked, "request_id int, budget int"),
        spark.createDataFrame(rows, "request_id int, chunk_id string, path string, score double, item string, own_tokens int"),
        s, i, spark.createDataFrame([(p, p.count("/")) for p in tree], "path string, depth int"),
    )
    got = {}
    for r in bundles.items().collect():
        got.setdefault(r["request_id"], []).append((r["stage"], r["item"]))
    used = {r["request_id"]: r["used"] for r in bundles.metrics(spark.createDataFrame([("src/p0.rs", 1000)], "path string, tokens long")).collect()}
    for q, budget in asked:
        want, total = loop_bundle(budget, hits.get(q, []), symbols, {"src/p0.rs": ["src/p1.rs"], "src/p1.rs": ["src/p2.rs"]}, tree)
        assert sorted(got.get(q, [])) == want and used[q] == total, q


def test_reviews_by_folder(spark, project):
    _, _, (_, c, i) = project
    details = "path string, name string, kind string, signature string, body string"
    old = spark.createDataFrame([("src/p0.rs", "f1", "function", "f1()", "a"), ("lib/q.rs", "g", "function", "g()", "a"), ("srcx/r.rs", "h", "function", "h()", "a")], details)
    new = spark.createDataFrame([("src/p0.rs", "f1", "function", "f1(x)", "a"), ("src/p0.rs", "f99", "function", "f99()", "a"), ("lib/q.rs", "g", "function", "g()", "b")], details)
    asked = spark.createDataFrame([(1, "src/"), (2, ""), (3, None), (4, "lib/q"), (5, "lib")], "request_id int, folder string")
    got = {}
    for r in requests.review_batch(old, new, c, i, asked).collect():
        got.setdefault(r["request_id"], {})[r["symbol"]] = (r["change"], r["affected_files"])
    src = {"f1": ("signature_changed", ["src/p1.rs"]), "f99": ("added", [])}
    assert got == {1: src, 2: src | {"g": ("modified", []), "h": ("removed", [])}, 3: got[2], 5: {"g": ("modified", [])}}


def test_only_calls_of_what_changed_are_sorted(spark):
    changes = spark.createDataFrame([("a", "f", "function", "modified", None, None), ("a", "g", "function", "added", None, "g()")], "path string, symbol string, kind string, change string, before string, after string")
    calls = spark.createDataFrame([("b::x", "f", 1), ("b::x", "f", 2), ("a::f", "f", 3), ("b::y", "g", 4), ("b::z", "other", 5)], CALLS)
    got = diff.with_callers(changes, calls)
    assert {r["symbol"]: r["callers"] for r in got.collect()} == {"f": ["b::x"], "g": []}
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_engine_answers_tables_of_requests(spark, tmp_path):
    root = tmp_path / "project"
    (root / "src").mkdir(parents=True)
    (root / "src" / "boat.rs").write_text("use crate::sea;\npub fn sail() {\n    wave();\n}\n")
    (root / "src" / "sea.rs").write_text("pub fn wave() {\n    tide()\n}\n\nfn tide() {}\n")
    engine = Engine(spark, str(root), str(tmp_path / "index"))
    engine.ensure_index()
    asked = spark.createDataFrame([(1, "wave tide", None), (2, "sail", "*boat*"), (3, "sail", "*.py")], "request_id int, query string, glob string")
    found = {(r["request_id"], r["rank"]): r["path"] for r in engine.search_batch(asked, 1).collect()}
    assert found == {(1, 1): engine.search("wave tide", 1).first()["path"], (2, 1): "src/boat.rs"}
    impact = engine.impact_batch(spark.createDataFrame([(1, [], ["src/sea.rs"]), (2, ["sail"], [])], "request_id int, names array<string>, paths array<string>"))
    assert {(r["request_id"], r["path"]) for r in impact["files"].collect()} == {(1, "src/boat.rs")}
    task = "wave tide sail"
    single, batch = engine.context_bundle(task), engine.bundle_batch(spark.createDataFrame([(1, task, None), (2, task, 0)], "request_id int, task string, budget int"))
    items = batch.items().collect()
    assert {r["request_id"] for r in items} == {1}
    count = lambda stage: sum(r["stage"] == stage for r in items)
    assert (count("chunk"), count("symbol"), count("tree")) == (len(single["chunks"]), len(single["symbols"]), len(single["tree_snapshot"]))
    assert [r["item"] for r in items if r["stage"] == "impact"] == [single["impact_summary"]]
    engine.call_graph("sail").count()
    assert len(engine._adjacency) == 2


def test_callees_are_right_for_ids_defined_many_times(spark):
    symbols = spark.createDataFrame([("a::f", "a", "f", "function", i, i) for i in range(30)] + [("b::g", "b", "g", "function", 1, 1), (None, "b", "h", "function", 1, 1)], SYMBOLS)
    calls = spark.createDataFrame([("a::f", f"n{i}", i) for i in range(20)] + [("b::g", "f", 3), ("b::g", None, None), (None, "f", 1)], CALLS)
    got = graph.callees(symbols, calls)
    assert got.count() == 30 * 20 + 2 and got.columns == ["id", "callee_name", "call_line"]
    assert {r["count"] for r in got.where("id = 'a::f'").groupBy("callee_name").count().collect()} == {30}
    # definitions are folded before they meet the calls, so no task holds an id's product
    assert "REPARTITION" in got._jdf.queryExecution().executedPlan().toString()


def test_callees_meet_calls_in_one_pass(spark):
    symbols = spark.createDataFrame([("a::f", "a", "f", "function", i, i) for i in range(3)] + [("b::g", "b", "g", "function", 1, 1)], SYMBOLS)
    calls = spark.createDataFrame([("a::f", "x", 1), ("b::g", "f", 3)], CALLS)
    got = graph.callees(symbols, calls)
    # calls may be costly to derive: ids that are defined once and those that are defined often aren't two branches
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan
    assert sorted(map(tuple, got.collect())) == [("a::f", "x", 1)] * 3 + [("b::g", "f", 3)]


def test_walks_over_imports_are_done_once_for_equal_starts(spark, monkeypatch):
    imports = spark.createDataFrame([(f"src/p{i}.rs", f"crate::p{j}::x", "x") for i, j in ((1, 0), (2, 1), (3, 2), (4, 0), (5, 9))], IMPORTS)
    changed = spark.createDataFrame([(r, f"src/p{r % 2}.rs") for r in range(40)] + [(99, "src/none.rs")], "request_id int, path string")
    got = {}
    for r in graph.dependents_of(imports, changed, 3).collect():
        got.setdefault(r["request_id"], set()).add((r["path"], r["hop"]))
    even, odd = {("src/p1.rs", 1), ("src/p4.rs", 1), ("src/p2.rs", 2), ("src/p3.rs", 3)}, {("src/p2.rs", 1), ("src/p3.rs", 2)}
    assert got == {r: odd if r % 2 else even for r in range(40)}
    assert graph.same_start(changed).select("start").distinct().count() == 3
    # callers and signals walk no imports
    symbols, calls = spark.createDataFrame([("a::f", "a", "f", "function", 1, 1)], SYMBOLS), spark.createDataFrame([("b::g", "f", 3)], CALLS)
    monkeypatch.setattr(graph, "dependents_of", lambda *_: pytest.fail("imports are walked"))
    asked = spark.createDataFrame([(1, ["f"], [])], "request_id int, names array<string>, paths array<string>")
    out = requests.impact_batch(symbols, calls, imports, asked, 2, wanted=["callers", "signals"])
    assert [r["caller_id"] for r in out["callers"].collect()] == ["b::g"] and out["signals"].count() == 1


def test_a_files_symbols_are_costed_once_for_all_requests(spark, monkeypatch):
    sizes, keep = {}, requests.materialize

    def counted(df, name):
        out = keep(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(requests, "materialize", counted)
    n = 30
    asked = spark.createDataFrame([(r, 10 * r) for r in range(n)], "request_id int, budget long")
    hits = spark.createDataFrame([(r, f"{p}:0", p, 0.5, "item", 3) for r in range(n) for p in ("src/a.rs", "src/b.rs")], "request_id int, chunk_id string, path string, score double, item string, own_tokens long")
    symbols = spark.createDataFrame([(f"{p}::f{i}", p, f"f{i}", "function", i, i) for p in ("src/a.rs", "src/b.rs") for i in range(20)], SYMBOLS)
    tree = spark.createDataFrame([("src/a.rs", 2)], "path string, depth int")
    bundle = requests.BundleBatch(asked, hits, symbols, spark.createDataFrame([], IMPORTS), tree)
    rows = [r for r in bundle.items().collect() if r["stage"] == "symbol"]
    own = {r: sorted(x["pos"] for x in rows if x["request_id"] == r) for r in range(n)}
    assert own[0] == [] and own[29] == list(range(1, 21))  # the first file overshoots the share
    assert max(size for name, size in sizes.items() if "symbol" in name) <= 40


def test_changes_of_one_folder_are_written_out_by_all_tasks(spark):
    """Changes in one part, all below the folders that are asked for: each task gets a share of them."""
    changes = spark.range(4000, numPartitions=1).selectExpr("concat('src/m', id, '.rs') AS path", "concat('fn_', id) AS symbol", "'added' AS change")
    asked = spark.createDataFrame([(1, ""), (2, "src/"), (3, None), (4, "lib"), (5, "src/m7.rs")], "request_id long, folder string")
    got = requests.below_folders(changes, asked)
    rows = got.select("request_id", F.spark_partition_id().alias("part")).groupBy("request_id", "part").count().collect()
    total = {i: sum(r["count"] for r in rows if r["request_id"] == i) for i in range(1, 6)}
    assert total == {1: 4000, 2: 4000, 3: 4000, 4: 0, 5: 0}
    assert len({r["part"] for r in rows}) > 1
