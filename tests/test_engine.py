"""Functions, operators and the engine against plain-Python versions."""

import datetime
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.api import Engine
from tidemill.config import Config
from tidemill.functions import text as X
from tidemill.operators import bundle, chunk, graph, ingest, ranges, scan, search, state
from tidemill.sources.files import read_tree
from tidemill.sources.store import TABLES, IndexStore, Locked
from tidemill.streaming import watch


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


def loop_chunks(text, size, overlap):
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        line = text.count("\n", 0, at) + 1
        out.append((text[at:end], line, line + text.count("\n", at, end)))
        if end == len(text):
            break
        at = end - overlap
    return out


def test_chunks_equal_a_loop(spark):
    rng = random.Random(3)
    texts = ["", "a", "x" * 50, "\n" * 51, *("".join(rng.choice("ab \né") for _ in range(rng.randint(0, 400))) for _ in range(40))]
    files = spark.createDataFrame([(f"f{i}.rs", "rs", t) for i, t in enumerate(texts)], "path string, ext string, content string")
    got = {(r["source"], r["chunk_index"]): (r["content"], r["start_line"], r["end_line"]) for r in chunk.chunk_files(files, Config(chunk_size=50, chunk_overlap=7)).collect()}
    want = {(f"f{i}.rs", k): c for i, t in enumerate(texts) for k, c in enumerate(loop_chunks(t, 50, 7))}
    assert got == want


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=300), st.integers(2, 60), st.integers(0, 59))
def test_chunks_cover_the_text(text, size, overlap):
    overlap = min(overlap, size - 1)
    parts = [c for c, _, _ in loop_chunks(text, size, overlap)]
    assert "".join([*parts[:1], *(p[overlap:] for p in parts[1:])]) == text


def test_overlap_is_checked(spark):
    with pytest.raises(ValueError):
        Config(chunk_size=10, chunk_overlap=10)


@pytest.mark.parametrize(("path", "ext"), [("a/b.RS", "rs"), ("a/.env", ""), ("a.b/c", ""), ("x.tar.gz", "gz"), ("a/b.", ""), ("", "")])
def test_extension(spark, path, ext):
    assert one(spark, path, X.extension) == ext


@pytest.mark.parametrize(
    ("path", "patterns"),
    [
        ("src/store/box.rs", ["crate::store::box%", "store::box%", "super::box%", "self::box%"]),
        ("src/main.rs", []),
        ("app/models.py", ["app.models%", "%.models", "%.models.%"]),
        ("src/utils/date.ts", ["%/date", "%/date.ts"]),
        ("ui/index.tsx", ["%/ui", "%/ui/index%"]),
        ("README", ["%README%"]),
    ],
)
def test_import_patterns(spark, path, patterns):
    assert one(spark, path, X.import_patterns) == patterns


def test_text_functions(spark):
    assert one(spark, "a::b::*", X.scope_leaf) == "b"
    assert one(spark, "..\\x/y.z", X.path_leaf) == "z"
    assert one(spark, "/", X.path_leaf) == "/"
    assert one(spark, "p.rs::S::f", X.caller_name) == "S::f"
    assert one(spark, "a\r\nb\n", X.lines_of) == ["a", "b"]
    assert one(spark, "", X.lines_of) == []
    assert one(spark, "a\n\n", X.lines_of) == ["a", ""] and one(spark, "\n\n\n", X.lines_of) == ["", "", ""]
    assert one(spark, "file:///a%20b", X.uri_to_path) == "/a b"
    assert one(spark, "My Proj-1", X.collection_name) == "my_proj_1"
    assert one(spark, "x" * 5, lambda c: X.clamp(c, 3)) == "xxx…"
    assert one(spark, "x" * 5, lambda c: X.ellipsize(c, 3)) == "…xx"
    assert one(spark, 0.5, lambda c: X.bar(c, 4), "double") == "██░░"
    assert one(spark, "\t  x", X.indent_width) == 3
    assert one(spark, "pub async fn go(x)", lambda c: X.chunk_symbol(c, F.lit("rust"))) == "pub async fn go"
    assert one(spark, "nothing", lambda c: X.chunk_symbol(c, F.lit("rust"))) is None
    assert X.language_filter("rust") == "rust" and X.language_filter("rs") == "rust" and X.language_filter("ruby") == "ruby"
    assert re.match(X.glob_to_regex("src/**/*.{rs,py}"), "SRC/a/b.py") and not re.match(X.glob_to_regex("*.rs"), "a.rst")


def test_line_ranges_clamp(spark):
    files = spark.createDataFrame([("a", "1\n2\n3\n")], "path string, content string")
    wanted = spark.createDataFrame([("a", 2, 9), ("a", 3, 2), ("a", 0, 1), ("a", 7, 9)], "path string, start_line int, end_line int")
    got = {(r["start_line"], r["end_line"]): r["text"] for r in ranges.line_ranges(files, wanted).collect()}
    assert got == {(2, 9): "2\n3", (3, 2): "", (0, 1): "1", (7, 9): ""}


def test_scan_reasons(spark):
    rows = [("src/a.rs", "ok"), ("src/a.rs", "ok"), ("src/target/b.rs", "x"), ("src/c.xyz", "x"), ("src/d.rs", "y" * 3000), ("src/e.rs", "a\x00b"), ("src/f.rs", None), ("other/g.rs", "z"), ("src/h.min.js", "x"), ("src/empty.rs", "")]
    files = spark.createDataFrame([(p, c) for p, c in rows], "path string, content string").select("path", X.extension(F.col("path")).alias("ext"), F.coalesce(F.octet_length("content"), F.lit(1)).cast("bigint").alias("size_bytes"), "content")
    got = {r["reason"]: r["n"] for r in scan.skip_stats(files, Config(include_extensions=["rs", "js"], max_file_kb=1)).collect()}
    assert got == {"indexed": 2, "excluded_dir": 1, "extension": 1, "too_large": 1, "binary": 2, "minified": 1}
    for bad in ("../x", "/etc/x", "a/../b"):
        with pytest.raises(ValueError):
            scan.resolve_in_root(bad)
    assert scan.resolve_in_root("./a//b") == "a/b"


def test_search_ties_zero_vectors_and_limits(spark):
    rows = [("b", "p1", "rust", [1.0, 0.0]), ("a", "p2", "rust", [2.0, 0.0]), ("z", "p3", "go", [0.0, 0.0]), ("c", "p4", "go", [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "chunk_id string, path string, language string, embedding array<float>")
    assert [r["chunk_id"] for r in search.top_k(vectors, [1.0, 0.0], 2).collect()] == ["a", "b"]
    assert [r["chunk_id"] for r in search.top_k(vectors, [1.0, 0.0], 5, glob="P4").collect()] == ["c"]
    with pytest.raises(ValueError):
        search.top_k(vectors, [1.0, 0.0], 0)
    with pytest.raises(ValueError):
        search.top_k(vectors, [0.0, 0.0], 1)
    assert search.knn(vectors, spark.createDataFrame([], "query_id long, embedding array<float>"), 2).count() == 0


def loop_walk(calls, firsts, root, depth):
    seen, frontier, out = set(), {root}, {}
    for hop in range(1, depth + 1):
        names = {c for a, c, _ in calls if a in frontier} - seen
        for n in names:
            out[n] = hop
        seen |= names
        frontier = {firsts[n.lower()] for n in names if n.lower() in firsts}
    return out


def test_call_graph_equals_a_loop(spark):
    rng = random.Random(5)
    symbols = [(f"p{i % 4}::f{i}", f"p{i % 4}", f"f{i}", "function", i + 1, i + 2) for i in range(30)]
    calls = list({(f"p{a % 4}::f{a}", f"f{b}", 1) for a, b in ((rng.randrange(30), rng.randrange(35)) for _ in range(60))})
    s = spark.createDataFrame(symbols, "id string, path string, name string, kind string, start_line int, end_line int")
    c = spark.createDataFrame(calls, "caller_id string, callee_name string, call_line int")
    got = {r["symbol"]: r["hop"] for r in graph.call_graph(s, c, "F3", 4, 1000).collect()}
    assert got == loop_walk(calls, {n.lower(): i for i, _, n, *_ in symbols}, "p3::f3", 4)
    assert graph.call_graph(s, c, "nobody", 2).count() == 0
    with pytest.raises(ValueError):
        graph.impact_callers(s, c, [], [])


def test_open_patterns_are_looked_up_by_pieces(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcD./é") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    keys = [(f"p{i}", "".join(rng.choice("abcd./é") for _ in range(rng.randint(1, 4)))) for i in range(60)]
    modules = spark.createDataFrame([(n,) for n in {*names}] + [(None,)], "from_module string")
    found = graph.containing(modules, spark.createDataFrame(keys, "path string, key string"))
    got = sorted((r["path"], r["key"], r["from_module"]) for r in found.collect())
    assert got == sorted((p, k, n) for p, k in keys for n in {*names} if k in n.lower()) and got
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())
    assert graph.containing(modules, spark.createDataFrame([], "path string, key string")).count() == 0


def test_knn_in_blocks_keeps_ties_by_name(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"c{i:03}", [float(rng.randint(-1, 1)), float(rng.randint(-1, 1)), 1.0]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows[:15])], "query_id int, embedding array<float>")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 3)
    want = {(q, rank): name for q in range(15) for rank, (_, name) in enumerate(sorted((-cos(rows[q][1], v), n) for n, v in rows)[:4], 1)}
    for cells in (1 << 22, 100):
        monkeypatch.setattr(search, "CELLS", cells)
        assert {(r["query_id"], r["rank"]): r["chunk_id"] for r in search.knn(vectors, queries, 4).collect()} == want


def test_packing_equals_a_loop(spark):
    rng = random.Random(8)
    rows = [(f"c{i}", f"p{i % 5}", round(rng.random(), 2), rng.randint(1, 40)) for i in range(40)]
    got = {r["chunk_id"] for r in bundle.pack(bundle.per_file_cap(spark.createDataFrame(rows, "chunk_id string, path string, score double, tokens int"), 3), "tokens", 120).collect()}
    used, per_file, want = 0, {}, set()
    for name, path, _, tokens in sorted(rows, key=lambda r: (-r[2], r[0])):
        if used >= 120:
            break
        if per_file.get(path, 0) >= 3:
            continue
        want.add(name)
        used += tokens
        per_file[path] = per_file.get(path, 0) + 1
    assert got == want
    assert bundle.metrics(0, 0, 0, 0) == {"candidate_tokens": 0, "selected_tokens": 0, "used_tokens": 0, "baseline_tokens": 0, "saved_tokens": 0, "saved_percent": 0.0, "saving_ratio": 0.0, "trim_percent": 0.0}


def test_state_operators(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "x")], "k string, t int, v string")
    assert [r["t"] for r in state.without_consecutive(rows, ["k"], ["t"], ["v"]).orderBy("t").collect()] == [1, 3, 4]
    assert state.last_wins(rows, ["v"], ["t"]).count() == 2


def test_store_versions_and_lock(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.version is None and store.read("symbols").count() == 0
    with store.lock(), pytest.raises(Locked), store.lock():
        pass
    store.commit({"state": spark.createDataFrame([("a", "h")], "path string, hash string")})
    assert store.commit({}) == 2 and store.read("state").count() == 1
    assert store.commit({}) == 3 and store.vacuum(2) == 1 and store.read("state").count() == 1


def test_one_changed_file_rewrites_one_bucket_of_each_table(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=16)
    files = spark.range(400).selectExpr("concat('src/f', id, '.rs') as path", "'rs' as ext", "10L as size_bytes", "concat('use crate::a', id, ';\nfn f', id, '() { g', id, '() }\n') as content")
    edited = files.withColumn("content", F.when(F.col("path") == "src/f7.rs", "fn other() {}\n").otherwise(F.col("content"))).where("path <> 'src/f8.rs'")
    config = Config()
    assert ingest.update(store, files, config).dirty == 400
    before, rows = store.manifest(), {t: store.read(t) for t in TABLES}
    counts = {t: df.count() for t, df in rows.items()}
    assert counts["symbols"] == counts["calls"] == counts["imports"] == counts["state"] == 400
    only = spark.createDataFrame([("src/f7.rs",)], "path string")
    assert ingest.update(store, edited, config, only=only).dirty == 1
    after = store.manifest()
    for t in TABLES:
        changed = {k for k in before["tables"][t].keys() | after["tables"][t].keys() if before["tables"][t].get(k) != after["tables"][t].get(k)}
        assert changed <= set(map(str, store.buckets_of(only))) and len(changed) == 1, t
    # readers of the old version are unharmed, and a replay finds nothing to do
    assert {t: df.count() for t, df in rows.items()} == counts and store.read("symbols", version=1).where("name = 'f7'").count() == 1
    assert ingest.update(store, edited, config, only=only).dirty == 0 and store.version == 2
    assert {r["name"] for r in store.read("symbols").where("path = 'src/f7.rs'").collect()} == {"other"} and store.read("calls").count() == 399
    # without a list of paths all changes are found: one file is gone
    report = ingest.update(store, edited, config)
    assert (report.dirty, report.deleted) == (0, 1) and store.read("state").count() == 399
    whole = IndexStore(spark, str(tmp_path / "whole"), buckets=4)
    ingest.update(whole, edited, config)
    for t in TABLES:
        assert sorted(map(str, whole.read(t).collect())) == sorted(map(str, store.read(t).collect())), t
    assert store.vacuum(1) == 2 and store.read("state").count() == 399


def test_a_lost_lock_cannot_commit(spark, tmp_path, monkeypatch):
    from tidemill.sources import store as module

    first, second = IndexStore(spark, str(tmp_path / "index")), IndexStore(spark, str(tmp_path / "index"))
    with pytest.raises(Locked), first.lock():
        monkeypatch.setattr(module, "STALE_LOCK", -1)
        with second.lock():
            second.commit({})
            first.commit({})
    assert second.version == 1


def test_debounce_batch_and_stream_agree(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("a", t + datetime.timedelta(seconds=s), op) for s, op in ((0, "create"), (1, "modify"), (3, "modify"), (10, "remove"))] + [("b", t, "create"), ("z", t + datetime.timedelta(hours=1), "create")]
    changes = spark.createDataFrame(rows, "path string, ts timestamp, op string")
    got = {(r["path"], r["events"], r["op"]) for r in watch.debounce(changes, "2 seconds").collect()}
    assert got == {("a", 3, "modify"), ("a", 1, "remove"), ("b", 1, "create"), ("z", 1, "create")}
    changes.write.parquet(str(tmp_path / "in"))
    stream = watch.file_changes(spark, str(tmp_path / "in"), "path string, ts timestamp, op string")
    watch.debounced_stream(stream, str(tmp_path / "cp"), str(tmp_path / "out"), "2 seconds", "1 second").awaitTermination()
    closed = {(r["path"], r["events"], r["op"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert closed == got - {("z", 1, "create")}


def test_table_of_changes_streams_whole(spark, tmp_path):
    """More files than one trigger takes, in no order of time, and bursts that are open at the end."""
    rng = random.Random(8)
    t = datetime.datetime(2024, 1, 1)
    rows = [(f"p{rng.randint(0, 9)}", t + datetime.timedelta(seconds=rng.randint(0, 90_000)), rng.choice(["create", "modify"])) for _ in range(400)]
    changes = spark.createDataFrame(rows, "path string, ts timestamp, op string").repartition(8)
    key = lambda df: sorted(map(tuple, df.select("path", "events", "first_ts", "last_ts").collect()))
    got = watch.debounce_table(spark, changes, str(tmp_path / "whole"), "30 minutes", per_trigger=2)
    assert key(got) == key(watch.debounce(changes, "30 minutes")) and got.count() > 10
    assert watch.debounce_table(spark, changes.limit(0), str(tmp_path / "none"), "30 minutes").count() == 0


def test_stateful_capture_fires_into_the_index(spark, tmp_path):
    """Create, modify and remove, out of order within a file, over several triggers; the bursts are those of a batch."""
    rng = random.Random(4)
    t = datetime.datetime(2024, 1, 1)
    rows = [(f"p{rng.randint(0, 5)}", t + datetime.timedelta(seconds=rng.randint(0, 3000)), rng.choice(["create", "modify", "remove"]), i) for i in range(120)]
    changes = spark.createDataFrame(rows, "path string, ts timestamp, op string, seq long").repartition(3)
    store, fired = IndexStore(spark, str(tmp_path / "index"), buckets=4), []

    def rows_of(last):
        fired.extend(r["path"] for r in last.collect())
        return {"state": last.select("path", F.col("seq").cast("string").alias("hash"))}

    watch.index_changes(spark, changes, store, rows_of, str(tmp_path / "work"), 60_000, files=3)
    last = {p: max((x for x in rows if x[0] == p), key=lambda x: (x[1], x[3])) for p in {x[0] for x in rows}}
    assert {r["path"]: r["hash"] for r in store.read("state").collect()} == {p: str(x[3]) for p, x in last.items() if x[2] != "remove"}
    assert store.version > 1 and len(fired) > len(set(fired))


def test_reindexing_sees_every_path_of_a_batch(spark, tmp_path, monkeypatch):
    config = Config()
    excluded = [(f"{config.exclude_dirs[0]}/lib/f{i}.{config.include_extensions[0]}",) for i in range(4000)]
    paths = [p for (p,) in excluded[:3]] + ["src/a.rs", ".rs", "src/.hidden.RS", "src/..rs", "a.rs/b", "x.", "readme.md", "c.py", "..a.md"]
    for some in (config, Config(include_dirs=["src"])):
        got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "path string").select(scan.is_indexable_path(F.col("path"), some)).collect()]
        assert got == [scan.should_index(p, some) for p in paths]
    told = []
    monkeypatch.setattr(watch.ingest, "update", lambda *a: told.append(a))
    for name, extra in (("none", []), ("one", [("src/a.rs",)])):
        spark.createDataFrame([*excluded, *extra], "path string").coalesce(1).write.parquet(str(tmp_path / name))
        stream = watch.file_changes(spark, str(tmp_path / name), "path string")
        watch.reindex_on_change(stream, None, lambda: None, config, str(tmp_path / f"{name}-cp")).awaitTermination()
        assert len(told) == len(extra)


def test_engine_end_to_end(spark, tmp_path):
    root = tmp_path / "project"
    (root / "src").mkdir(parents=True)
    (root / "src" / "boat.rs").write_text("use crate::sea;\npub fn sail() {\n    wave();\n}\n")
    (root / "src" / "sea.rs").write_text("pub fn wave() {\n    tide()\n}\n\nfn tide() {}\n")
    (root / "src" / "note.md").write_text("the harbour at dawn\n")
    (root / "src" / "raw.rs").write_bytes(b"\xff\xfe\x00")
    told = []
    engine = Engine(spark, str(root), str(tmp_path / "index"), observer=lambda tool, args: told.append(tool))
    assert read_tree(spark, str(root)).count() == 4
    first = engine.ensure_index()
    assert (first.dirty, first.deleted) == (3, 0)
    assert engine.ensure_index().dirty == 0
    assert engine.search("harbour dawn", 1).first()["path"] == "src/note.md"
    assert [r["symbol"] for r in engine.call_graph("sail").collect()] == ["wave", "tide"]
    assert engine.symbol_resolve("WAVE").first()["called_by"][0]["caller"] == "sail"
    impact = engine.impact(paths=["src/sea.rs"])
    assert impact["affected_files"] == ["src/boat.rs"] and "sail" in impact["breaking_signals"][0]
    assert "..." in engine.get_skeleton("src/boat.rs")["skeleton"]
    assert engine.get_ranges("src/sea.rs", [(1, 1)], ["tide"]).count() == 2
    got = engine.context_bundle("wave tide sail")
    assert got["chunks"] and got["metrics"]["used_tokens"] > 0 and "src/boat.rs" in got["tree_snapshot"]
    (root / "src" / "sea.rs").unlink()
    (root / "src" / "boat.rs").write_text("pub fn sail() {}\n")
    assert engine.index_status()["dirty"] == 2
    second = engine.ensure_index()
    assert (second.dirty, second.deleted) == (1, 1)
    assert {r["name"] for r in engine.store.read("symbols").collect()} == {"sail"}
    assert engine.store.read("calls").count() == 0
    old = spark.createDataFrame([("a.rs", "fn f(x: u8) { g() }\nfn h() {}\n")], "path string, content string")
    new = spark.createDataFrame([("a.rs", "fn f(x: u16) { g() }\nfn k() {}\n")], "path string, content string")
    assert {(r["symbol"], r["change"]) for r in engine.review_diff(old, new).collect()} == {("f", "signature_changed"), ("h", "removed"), ("k", "added")}
    assert "search" in told and "impact" in told


def test_bursts_of_many_paths_are_merged_at_once():
    import random

    import pandas as pd

    rng = random.Random(5)
    events = [(f"p{rng.randrange(9)}", rng.randrange(3000), rng.choice("abc"), i) for i in range(400)]
    want = []
    for path in sorted({e[0] for e in events}):
        own = sorted((t, seq, op) for p, t, op, seq in events if p == path)
        runs = [[own[0]]]
        for e in own[1:]:
            runs.append([e]) if e[0] - runs[-1][-1][0] > 20 else runs[-1].append(e)
        want += [(path, r[0][0], r[-1][0], len(r), r[-1][2], r[-1][1]) for r in runs]
    rng.shuffle(events)
    found = None
    for lo in range(0, 400, 90):  # in parts, as bursts that are open meet new events
        part = pd.DataFrame([(p, t, t, 1, op, seq) for p, t, op, seq in events[lo : lo + 90]], columns=["path", "first_us", "last_us", "events", "op", "seq"])
        found = watch.merged(part if found is None else pd.concat([found, part]), 20)
    assert sorted(found.itertuples(index=False, name=None)) == want
