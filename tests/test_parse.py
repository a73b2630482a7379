"""Scanner, prefixes and skeletons on small pieces of code."""

import random
import time

import pytest

from tidemill.operators import bundle, graph, lex, parse, skeleton

RUST = """use deep::sea::{crab, eel as snake};
use shore::*;

pub struct Boat { oars: u8 }

impl Boat {
    pub fn new(oars: u8) -> Self {
        let text = "} not an end {";
        launch(oars); launch(oars)
    }
}

fn launch(oars: u8) -> Boat {
    Boat::new(oars)
}
"""


def names(text, language):
    return [(s.name, s.kind) for s in parse.parse_text(text, language).symbols]


def test_rust_spans_calls_and_imports():
    got = parse.parse_text(RUST, "rust")
    spans = {(s.name, s.kind): (s.start_line, s.end_line) for s in got.symbols}
    assert spans["Boat", "struct"] == (4, 4)
    assert spans["Boat", "impl"] == (6, 11)
    assert spans["new", "function"] == (7, 10)
    assert spans["launch", "function"] == (13, 15)
    assert got.imports == [("deep::sea::crab", "crab"), ("deep::sea::eel", "snake"), ("shore::*", "*")]
    calls = [(got.symbols[i].name, c, line) for i, c, line in got.calls]
    assert ("new", "launch", 9) in calls and ("launch", "new", 14) in calls
    assert len([c for c in calls if c[:2] == ("new", "launch")]) == 1


@pytest.mark.parametrize(
    ("language", "text", "expected"),
    [
        ("python", "class Tide:\n    height = 2\n\n    def rise(self, by):\n        return add(self.height, by)\n\nasync def ebb():\n    pass\n", {("Tide", "class"), ("rise", "function"), ("ebb", "function")}),
        ("javascript", "class Lighthouse {\n  beam(angle) {\n    turn(angle);\n  }\n}\nfunction* flashes() {\n  yield 1;\n}\nconst dim = (level) => level / 2;\n", {("Lighthouse", "class"), ("beam", "method"), ("flashes", "function"), ("dim", "function")}),
        ("typescript", "export interface Berth {\n  depth: number;\n}\nexport type Draft = number | null;\nenum Flag { Red, White }\nexport default class Pilot {\n  steer(to: Berth): boolean {\n    return true;\n  }\n}\n", {("Berth", "interface"), ("Draft", "type"), ("Flag", "enum"), ("Pilot", "class"), ("steer", "method")}),
        ("go", "package quay\n\ntype Crane struct {\n\treach int\n}\n\nfunc (c *Crane) Lift(load int) bool {\n\treturn load < c.reach\n}\n\nfunc main() {}\n", {("Crane", "type"), ("Lift", "function"), ("main", "function")}),
        ("java", "public final class Ferry {\n  private int cars;\n  int board(int more) {\n    cars = load(cars, more);\n    return cars;\n  }\n}\ninterface Dock {\n  void moor(Ferry f);\n}\n", {("Ferry", "class"), ("board", "method"), ("Dock", "interface"), ("moor", "method")}),
        ("c", "struct knot {\n  double turns;\n};\nstatic double tie(struct knot k)\n{\n  return k.turns;\n}\n", {("knot", "class"), ("tie", "function")}),
        ("cpp", "class Sonar {\npublic:\n  int range;\n};\nint Sonar_ping(int depth) { return depth * 2; }\n", {("Sonar", "class"), ("Sonar_ping", "function")}),
        ("csharp", "public interface IBuoy { }\npublic sealed class Buoy {\n  internal bool Drift(int metres) {\n    return metres > 3;\n  }\n}\n", {("IBuoy", "interface"), ("Buoy", "class"), ("Drift", "method")}),
        ("ruby", "module Harbour\n  class Warehouse\n    def self.open?(hour)\n      staffed(hour)\n    end\n  end\nend\n", {("Harbour", "module"), ("Warehouse", "class"), ("open?", "method")}),
        ("php", "<?php\ninterface Cargo {}\nfinal class Crate implements Cargo {\n  private function &weight($tare) {\n    return scale($tare);\n  }\n}\n", {("Cargo", "interface"), ("Crate", "class"), ("weight", "function")}),
    ],
)
def test_each_language_names_its_declarations(language, text, expected):
    assert expected <= set(names(text, language))


@pytest.mark.parametrize("language", [*sorted(lex.KINDS), "python", "text", None])
def test_odd_texts_do_not_break_the_scanner(language):
    for text in ("", "{", "}}}", '"', "'''", "/*", "fn (", "use ;", "\n\n", "def f(:", "class"):
        parse.parse_text(text, language)
        skeleton.skeleton(text, language)


def test_comments_and_strings_hide_declarations():
    assert names('// fn no() {}\n/* fn nor() {} */\nlet s = "fn not() {}";\nfn yes() {}\n', "rust") == [("yes", "function")]


def test_skeletons():
    short = skeleton.skeleton(RUST, "rust")
    assert "pub fn new(oars: u8) -> Self {\n        ...\n    }" in short and "launch(oars); launch" not in short
    python = skeleton.skeleton('def f(a,\n      b):\n    """Says."""\n    x = 1\n\n    return x\n\ny = 2\n', "python")
    assert python == 'def f(a,\n      b):\n    """Says."""\n    ...\ny = 2\n'
    assert skeleton.skeleton("plain words", "text") == "plain words"
    assert skeleton.skeleton("fn f();\nstruct S {\n  a: u8,\n}\n", "rust") == "fn f();\nstruct S {\n  a: u8,\n}\n"


def test_prefix_symbols_take_the_longest_prefix(spark):
    files = spark.createDataFrame([("a.java", "java", "public class Foo {\n}\nclass Bar {}\n"), ("e.rs", "rust", "")], "path string, language string, content string")
    got = {(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in parse.prefix_symbols(files).collect()}
    assert got == {("Foo", "class", 1, 2), ("Bar", "class", 3, 3)}


def test_parse_files_as_tables(spark):
    files = spark.createDataFrame([("b.rs", "rust", RUST), ("x.txt", "text", "words"), ("n.rs", "rust", None)], "path string, language string, content string")
    parsed = parse.parse_files(files)
    assert {r["id"] for r in parse.symbols_of(parsed).collect()} >= {"b.rs::Boat", "b.rs::new", "b.rs::launch"}
    assert ("b.rs", "shore::*", "*") in {tuple(r) for r in parse.imports_of(parsed).collect()}
    assert ("b.rs::launch", "new", 14) in {tuple(r) for r in parse.calls_of(parsed).collect()}


@pytest.mark.parametrize(
    ("language", "text", "symbols", "calls"),
    [
        ("java", "@Note(1) class Reef<T> extends Bank { <U> java.util.List<U> shoal(int a) throws E { if (a > 1) { return drift(a); } return new Sand(a); } Reef() { sink(); } }", [("Reef", "class"), ("shoal", "method")], [("shoal", "drift"), ("shoal", "sink")]),
        ("csharp", "class Reef { int Depth { get; set; } int Shoal(int x) => Drift(x); }", [("Reef", "class"), ("Shoal", "method")], [("Shoal", "Drift")]),
        ("javascript", "const ebb = x => { flow(x); };\nlet set = { rise(q) { return crest(q); } };\nrun(function () { stop(); });\n", [("ebb", "function"), ("rise", "method")], [("ebb", "flow"), ("rise", "crest")]),
        ("rust", "impl<T: Sail> Rig<T> for Mast<T> where T: Q { fn raise() -> Self { hoist!{ pull::<u8>() } } } static mut N: T = T { a: 1 }; macro_rules! knot { () => {} }", [("Mast", "impl"), ("raise", "function"), ("N", "static"), ("knot", "macro")], None),
        ("cpp", "namespace n { template <class T>\nclass Hull : public Deck { public: int beam() const { return keel(); } };\n}\nint n::Hull::draft(int a) { return load(a); }\nvoid (*fp)(int);\n", [("Hull", "class"), ("beam", "function"), ("draft", "function")], [("beam", "keel"), ("draft", "load")]),
        ("kotlin", "class Buoy(val x: Int) {\n  fun bob(): Int = sway(x)\n  fun String.ring() { toll() }\n}\n", [("Buoy", "class"), ("bob", "function"), ("ring", "function")], [("bob", "sway"), ("ring", "toll")]),
        ("go", "type Crane interface {\n\tLift(x int) int\n}\nfunc (c *Quay) haul(x interface{}) (int, error) {\n\treturn lift(x), nil\n}\n", [("Crane", "type"), ("haul", "function")], [("haul", "lift")]),
        ("ruby", "class Pier; def moor(x) = tie(x)\n def self.free?\n loose() if wind\n end\nend\n", [("Pier", "class"), ("moor", "method"), ("free?", "method")], [("moor", "tie"), ("free?", "loose")]),
    ],
)
def test_declarations_need_not_start_a_line(language, text, symbols, calls):
    got = parse.parse_text(text, language)
    assert [(s.name, s.kind) for s in got.symbols] == symbols
    if calls is not None:
        assert [(got.symbols[i].name, c) for i, c, _ in got.calls] == calls


def test_use_items():
    assert parse.expand_use("x::y as z") == [("x::y", "z")]
    assert parse.expand_use("a::{b::{c, d as e}, self, f::*};") == [("a::b::c", "c"), ("a::b::d", "e"), ("a", "a"), ("a::f::*", "*")]


def test_deep_and_large_texts():
    deep = "def g():\n    return " + " + ".join(["h()"] * 3000) + "\n"
    assert parse.parse_text(deep, "python").calls == [(0, "h", 2)]
    for text in ("{" * 20_000 + "}" * 20_000, "(" * 40_000, "a<" * 20_000, "/*" * 20_000, "fn a() {" * 5_000):
        for language in ("rust", "cpp", "java", "typescript"):
            parse.parse_text(text, language)

    def seconds(n):
        text = "class A {\n" + "".join(f"  int m{i}(int a) {{\n    return n{i}(a) + f(a);\n  }}\n" for i in range(n)) + "}\n"
        began = time.process_time()
        got = parse.parse_text(text, "java")
        assert len(got.symbols) == n + 1 and len(got.calls) == 2 * n
        return time.process_time() - began

    assert seconds(8000) < 8 * max(seconds(2000), 0.05)  # in proportion, not its square


def test_user_rules_take_the_place_of_a_languages_own(spark):
    rules = spark.createDataFrame([("python", "def", "routine"), ("ruby", "no such word", "x"), (None, "def", "y")], "language string, keyword string, kind string")
    overrides = parse.overrides_of(rules)
    kinds = lambda text, language: [(s.name, s.kind) for s in parse.parse_text(text, language, overrides).symbols]
    assert kinds("class Foo:\n    def bar(self): pass\n", "python") == [("bar", "routine")]
    assert kinds("def foo(:\n  pass\n", "python") == [("foo", "routine")]  # also where the text doesn't parse
    assert kinds("class Foo\nend\n", "ruby") == [("Foo", "class")]  # rules that name nothing fall back
    files = spark.createDataFrame([("a.py", "python", "def foo():\n    pass\n")], "path string, language string, content string")
    assert [r["kind"] for r in parse.symbols_of(parse.parse_files(files, overrides)).collect()] == ["routine"]


def test_enclosing_symbols_against_a_loop(spark):
    rng = random.Random(2)
    spans = [(f"p{rng.randrange(3)}", i, a, a + rng.choice([0, 1, 5, 40])) for i, a in ((i, rng.randrange(60)) for i in range(150))]
    symbols = spark.createDataFrame([(p, f"{p}::{i:03}", a, b) for p, i, a, b in spans], "path string, id string, start_line int, end_line int")
    lines = [(f"p{rng.randrange(4)}", rng.randrange(110)) for _ in range(300)]
    got = {(r["path"], r["line"]): r["id"] for r in graph.enclosing_symbols(spark.createDataFrame(lines, "path string, line int"), symbols).collect()}
    want = {}
    for path, line in lines:
        inside = [(a, f"{p}::{i:03}") for p, i, a, b in spans if p == path and a <= line <= b]
        if inside:
            want[path, line] = max(inside)[1]
    assert got == want


def test_chunks_that_cost_nothing_are_packed(spark):
    rows = [("a", 0.9, 0), ("b", 0.8, 5), ("c", 0.7, None), ("d", 0.6, 5), ("e", 0.5, 0), ("f", 0.4, 1)]
    got = bundle.pack(spark.createDataFrame(rows, "chunk_id string, score double, tokens int"), "tokens", 10)
    assert [(r["chunk_id"], r["used_before"]) for r in got.orderBy("chunk_id").collect()] == [("a", 0), ("b", 0), ("c", 5), ("d", 5)]


def test_files_are_given_on_in_small_parts():
    """A batch of many files isn't held as parsed rows: each part of it is given on before the next is parsed."""
    import pandas as pd

    unit = "fn run() { dep(1); }\n" * 1000
    rows = pd.DataFrame({"path": [f"a{i}.rs" for i in range(200)], "content": [unit] * 198 + [None, "x" * (2 * parse.SLICE_CHARS)], "language": ["rust"] * 200})
    parts = list(parse._parse_batches(iter([rows])))
    assert [p for part in parts for p in part["path"]] == list(rows["path"])
    assert max(len(part) for part in parts) <= parse.SLICE_CHARS // len(unit) + 1
    assert list(parse._parse_batches(iter([rows[:0]]))) == []
