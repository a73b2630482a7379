"""Symbols, imports and calls from source text.

Two ways: declaration prefixes, line by line, as DataFrame operations (``prefix_symbols`` and
what follows); and a scanner that knows strings, comments and braces, as a table function over
Arrow batches (``parse_files``), which gives exact spans, signatures and bodies.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import rules
from tidemill.functions import text as X
from tidemill.operators import lex, state

NAME = r"[\p{L}\p{N}_]+"


# --- declaration prefixes -------------------------------------------------------------------


def numbered_lines(files: DataFrame) -> DataFrame:
    """``files(path, content, language)`` by line: path, language, n_lines, line_no (from 1), line."""
    lines = X.lines_of(F.col("content"))
    return files.select("path", "language", F.size(lines).alias("n_lines"), F.posexplode(lines).alias("at", "line")).select("path", "language", "n_lines", (F.col("at") + 1).alias("line_no"), "line")


def prefix_symbols(files: DataFrame) -> DataFrame:
    """One symbol per line at most: the longest prefix that fits decides; ends come from the next symbol's start."""
    pattern = F.lit("(?!)")
    kinds = []
    for language, prefixes in rules.SYMBOL_PREFIXES.items():
        ordered = sorted((p for p, _ in prefixes), key=len, reverse=True)
        # atomic: a longer prefix without a name after it doesn't give way to a shorter one
        own = "^((?>" + "|".join(map(re.escape, ordered)) + f"))({NAME})"
        pattern = F.when(F.col("language") == language, own).otherwise(pattern)
        kinds += [(language, p, k) for p, k in prefixes]
    lines = numbered_lines(files).withColumn("bare", X.trimmed(F.col("line"))).withColumn("pattern", pattern)
    cut = lines.select("path", "language", "n_lines", "line_no", F.expr("regexp_extract(bare, pattern, 1)").alias("prefix"), F.expr("regexp_extract(bare, pattern, 2)").alias("name"))
    table = files.sparkSession.createDataFrame(kinds, "language string, prefix string, kind string")
    found = cut.where(F.octet_length("name") >= 2).join(F.broadcast(table), ["language", "prefix"])
    w = Window.partitionBy("path").orderBy("line_no")
    end = F.coalesce(F.greatest(F.lead("line_no").over(w) - 1, F.col("line_no")), F.col("n_lines"))
    return found.select(F.concat_ws("::", "path", "name").alias("id"), "path", "name", "kind", F.col("line_no").alias("start_line"), end.alias("end_line"))


def prefix_imports(files: DataFrame) -> DataFrame:
    """``(importer, from_module, symbol_name)`` of rust, python, javascript, typescript and go."""
    lines = numbered_lines(files).withColumn("t", X.trimmed(F.col("line")))
    split = lambda c: F.filter(F.transform(F.split(c, ","), X.trimmed), lambda x: x != "")
    whole = F.regexp_extract("t", r"(?U)^use\s+([\w:]+(?:::\{[^}]+\}|::\*|\w+)?)\s*;", 1)
    rust = lines.where("language = 'rust'").select("path", whole.alias("m")).where("m <> ''").select("path", "m", F.substring_index("m", "::", -1).alias("s"))
    python = lines.where("language = 'python'")
    module, names = F.regexp_extract("t", r"(?U)^from\s+(\S+)\s+import\s+(.+)", 1), F.regexp_extract("t", r"(?U)^from\s+(\S+)\s+import\s+(.+)", 2)
    from_rows = python.select("path", module.alias("m"), names.alias("n")).where("m <> ''").select("path", "m", F.explode(split(F.col("n"))).alias("s"))
    plain = python.select("path", F.regexp_extract("t", r"(?U)^import\s+(\S+)", 1).alias("m")).where("m <> ''").select("path", "m", F.lit("*").alias("s"))
    js_re = r"""(?U)import\s+(?:\{([^}]+)\}|(\w+))\s+from\s+['"]([^'"]+)['"]"""
    js = lines.where("language in ('javascript', 'typescript')").select("path", *(F.regexp_extract("t", js_re, i).alias(n) for i, n in ((1, "many"), (2, "one"), (3, "m")))).where("m <> ''")
    js = js.select("path", "m", F.explode(F.when(F.col("many") != "", F.transform(F.split("many", ","), X.trimmed)).otherwise(F.array("one"))).alias("s"))
    # a Go import stands alone or in a block; a line is in a block if the last opening before it is not yet closed
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("t") == "import (", 1).when(F.col("t") == ")", 0)
    go = lines.where("language = 'go'").withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)))
    quoted = F.when(F.col("inside") == 1, F.regexp_extract("t", r'^(?:[\w.]+\s+)?"([^"]+)"', 1)).otherwise(F.regexp_extract("t", r'^import\s+(?:[\w.]+\s+)?"([^"]+)"', 1))
    go = go.select("path", quoted.alias("m")).where("m <> ''").select("path", "m", F.lit("*").alias("s"))
    both = rust.unionByName(from_rows).unionByName(plain).unionByName(js).unionByName(go)
    return both.select(F.col("path").alias("importer"), F.col("m").alias("from_module"), F.col("s").alias("symbol_name"))


def prefix_calls(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(caller_id, callee_name, call_line)``: names that the file defines, before a bracket, within another symbol."""
    found = numbered_lines(files).select("path", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(r"(?U)\b(\w{2,})\s*\("), F.lit(1))).alias("seq", "callee_name"))
    names = symbols.select("path", F.col("name").alias("callee_name")).distinct()
    known = found.join(names, ["path", "callee_name"], "left_semi")
    spans = symbols.select(F.col("path").alias("s_path"), "id", "start_line", "end_line")
    on = (F.col("path") == F.col("s_path")) & F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    owned = known.join(spans, on).groupBy("path", "line_no", "seq", "callee_name").agg(F.max_by("id", "start_line").alias("caller_id"))
    others = owned.where(~F.endswith("caller_id", F.concat(F.lit("::"), "callee_name")))
    kept = state.without_consecutive(others, ["path"], ["line_no", "seq"], ["caller_id", "callee_name"])
    return kept.select("caller_id", "callee_name", F.col("line_no").alias("call_line"))


# --- scanner --------------------------------------------------------------------------------

@dataclass
class Symbol:
    name: str
    kind: str
    start_line: int
    end_line: int
    signature: str
    body: str
    braces: tuple[int, int] | None = None  # offsets of the braces around the body


@dataclass
class Parsed:
    symbols: list[Symbol]
    imports: list[tuple[str, str]]
    calls: list[tuple[int, str, int]]  # (index of the caller among symbols, callee, line)


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _scan(text: str, language: str, kinds: dict[str, str]) -> tuple[list[Symbol], list[tuple[str, int]], str]:
    """Symbols in order of their starts, calls, and the text without comments and strings, of a language with braces or ``end``."""
    found, clean = lex.lexed(text, language)
    made, quiet = (lex.ruby_declarations(text, kinds, found), []) if language == "ruby" else lex.declarations(text, language, kinds, found)
    symbols = []
    for d in made:
        if d.braces:
            signature, body = text[d.start : d.braces[0]], text[d.braces[0] + 1 : d.braces[1]]
        elif language == "ruby":
            first = text.find("\n", d.start)
            signature, _, body = text[d.start : d.end].partition("\n") if 0 <= first < d.end else (text[d.start : d.end], "", "")
            body = body.removesuffix("end")
        else:
            signature, body = text[d.start : d.end], ""
        symbols.append(Symbol(d.name, d.kind, d.start_line, d.end_line, _squeeze(signature), _squeeze(body), d.braces))
    return symbols, lex.calls(language, found, {d.name_at for d in made}, quiet), clean


def _scan_python(text: str, kinds: dict[str, str]) -> tuple[list[Symbol], list[tuple[str, str]], list[tuple[int, str, int]]] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = text.splitlines()
    symbols, imports, calls = [], [], []

    # a stack, as deep expressions would end recursion
    todo = [(child, None) for child in reversed(list(ast.iter_child_nodes(tree)))]
    while todo:
        node, owner = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = node.body[0].lineno
            signature = _squeeze(" ".join(lines[node.lineno - 1 : max(node.lineno, first - 1)])).rstrip(":")
            kind = kinds.get("class" if isinstance(node, ast.ClassDef) else "def")
            if kind is not None:
                symbols.append(Symbol(node.name, kind, node.lineno, node.end_lineno, signature, _squeeze(" ".join(lines[first - 1 : node.end_lineno]))))
                owner = len(symbols) - 1
        elif isinstance(node, ast.Import):
            imports.extend((a.name, a.name.rpartition(".")[2]) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            imports.append((module, module.rstrip(".").rpartition(".")[2] or module))
        elif isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else None
            if name and owner is not None:
                calls.append((owner, name, node.lineno))
        todo += [(child, owner) for child in reversed(list(ast.iter_child_nodes(node)))]
    return symbols, imports, calls


def _loose_python(text: str, kinds: dict[str, str]) -> tuple[list[Symbol], list[tuple[str, str]], list[tuple[int, str, int]]]:
    """The same from declaration lines and indents, for a text that doesn't parse."""
    lines = text.splitlines()
    symbols, imports, calls, around = [], [], [], []
    for number, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        width = len(line) - len(line.lstrip())
        while around and around[-1][0] >= width:
            around.pop()
        for _, i in around:
            symbols[i].end_line = number
        if (m := re.match(r"(?:async\s+)?(def|class)\s+(\w+)", bare)) and m[1] in kinds:
            symbols.append(Symbol(m[2], kinds[m[1]], number, number, _squeeze(bare).rstrip(":"), ""))
            around.append((width, len(symbols) - 1))
            bare = bare[m.end() :].partition(":")[2]
        elif m := re.match(r"from\s+([\w.]+)\s+import\b", bare):
            imports.append((m[1], m[1].rstrip(".").rpartition(".")[2] or m[1]))
        elif m := re.match(r"import\s+(.+)", bare):
            names = [re.sub(r"\s+as\s+\w+$", "", x.strip()) for x in m[1].split(",")]
            imports += [(x, x.rpartition(".")[2]) for x in names if re.fullmatch(r"[\w.]+", x)]
        if around:
            calls += [(around[-1][1], name, number) for name in re.findall(r"(\w+)\s*\(", bare) if name not in lex.KEYWORDS and not name.isdigit()]
    for s in symbols:
        s.body = _squeeze(" ".join(lines[s.start_line : s.end_line]))
    return symbols, imports, calls


def expand_use(item: str) -> list[tuple[str, str]]:
    """A Rust use item: (full path, name bound). An alias is the name bound, and the path stays.

    Braces are expanded to any depth; an alias within them binds its own part.
    """
    item = _squeeze(item).rstrip(";").strip()
    out, todo = [], [("", item)]
    while todo:
        prefix, part = todo.pop()
        part = part.strip()
        if not part:
            continue
        if part.endswith("}") and "{" in part:
            head, _, inner = part[:-1].partition("{")
            head = head.strip().removesuffix("::").strip()
            path = "::".join(x for x in (prefix, head) if x)
            pieces, depth, last = [], 0, 0
            for at, c in enumerate(inner):
                depth += (c == "{") - (c == "}")
                if c == "," and depth == 0:
                    pieces.append(inner[last:at])
                    last = at + 1
            todo += [(path, x) for x in reversed([*pieces, inner[last:]])]
            continue
        path, _, alias = (x.strip() for x in part.partition(" as "))
        full = prefix if path == "self" and prefix else "::".join(x for x in (prefix, path) if x)
        out.append((full, alias or full.rpartition("::")[2] or full))
    return out


def use_items(files: DataFrame) -> DataFrame:
    """``(path, item, full_path, bound)``: the use items of Rust files, expanded."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(path, item, *x) for path, item in zip(rows["path"], rows["item"], strict=True) for x in expand_use(item)], columns=["path", "item", "full_path", "bound"])

    items = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"), F.lit(1))).alias("item"))
    return items.mapInPandas(expand, "path string, item string, full_path string, bound string")


_IMPORTS = {
    "javascript": r"""(?:import|export)\b[^;'"\n]*?['"]([^'"\n]+)['"]|require\(\s*['"]([^'"\n]+)['"]""",
    "go": r'(?:^import\s+(?:[\w.]+\s+)?|^\s+(?:[\w.]+\s+)?)"([^"\n]+)"',
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
    "kotlin": r"^\s*import\s+([\w.]+)",
    "scala": r"^\s*import\s+([\w.]+)",
    "c": r'^\s*#\s*include\s*([<"][^>"\n]+[>"])',
    "csharp": r"^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",
    "php": r"^\s*use\s+([\w\\]+)",
}
_IMPORTS["typescript"], _IMPORTS["cpp"] = _IMPORTS["javascript"], _IMPORTS["c"]


def _leaf(module: str) -> str:
    parts = [p for p in re.split(r"[/.\\]", module) if p]
    return parts[-1] if parts else module


def _imports(text: str, clean: str, language: str) -> list[tuple[str, str]]:
    if language == "rust":
        return [x for m in re.finditer(r"(?:^|(?<=[;{}]))[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", clean, re.MULTILINE) for x in expand_use(m[1])]
    pattern = _IMPORTS.get(language)
    if not pattern:
        return []
    block = None
    if language == "go":
        block = [(m.start(), m.end()) for m in re.finditer(r"^import\s*\([^)]*\)", text, re.MULTILINE)]
    out = []
    for m in re.finditer(pattern, text, re.MULTILINE):
        if language == "go" and not m[0].startswith("import") and not any(a <= m.start() < b for a, b in block):
            continue
        if clean[m.start() : m.start() + len(m[0])].strip() == "" and language not in ("c", "cpp"):
            continue
        module = next(g for g in m.groups() if g).strip("\"'`<>")
        out.append((module, _leaf(module)))
    return out


def kinds_of(language: str, overrides: dict[str, dict[str, str]] | None = None) -> dict[str, str]:
    """What declares what: a user's rows for a language take the place of its own, if they name keywords that it has."""
    own = lex.KINDS.get(language, {})
    mine = {k: v for k, v in (overrides or {}).get(language, {}).items() if k in own}
    return mine or own


def overrides_of(rules: DataFrame) -> dict[str, dict[str, str]]:
    """``rules(language, keyword, kind)`` as ``parse_files`` takes it; a table of at most a few hundred rows."""
    out: dict[str, dict[str, str]] = {}
    for r in rules.select("language", "keyword", "kind").dropna().dropDuplicates(["language", "keyword"]).limit(1000).collect():
        out.setdefault(r["language"], {})[r["keyword"]] = r["kind"]
    return out


def parse_text(text: str, language: str, overrides: dict[str, dict[str, str]] | None = None) -> Parsed:
    """Symbols with exact spans, imports, and calls by the symbol around them that starts latest, each pair once."""
    kinds = kinds_of(language, overrides)
    if language == "python":
        symbols, imports, raw = _scan_python(text, kinds) or _loose_python(text, kinds)
    elif language in lex.LANGUAGES:
        symbols, called, clean = _scan(text, language, kinds)
        imports = _imports(text, clean, language)
        owner = lex.owners([(s.start_line, s.end_line) for s in symbols], [line for _, line in called])
        raw = [(i, name, line) for i, (name, line) in zip(owner, called, strict=True) if i is not None]
    else:
        return Parsed([], [], [])
    seen, calls = set(), []
    for owner, name, number in raw:
        if (symbols[owner].name, name) not in seen:
            seen.add((symbols[owner].name, name))
            calls.append((owner, name, number))
    return Parsed(symbols, imports, calls)


#: Characters of the files that are parsed, and given on, at once, and bytes of an Arrow batch: a worker holds no more than these and their rows.
SLICE_CHARS, BATCH_BYTES = 1 << 18, 4 << 20


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows ``[lo, hi)`` of up to ``SLICE_CHARS`` together, or one that is longer."""
    lo = total = 0
    for at, size in enumerate(sizes):
        if at > lo and total + size > SLICE_CHARS:
            yield lo, at
            lo, total = at, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def _parse_batches(batches: Iterator[pd.DataFrame], overrides: dict[str, dict[str, str]] | None = None) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for lo, hi in _slices([len(text or "") for text in rows["content"]]):
            out = []
            for path, content, language in zip(*(rows[c][lo:hi] for c in ("path", "content", "language")), strict=True):
                got = parse_text(content or "", language or "", overrides)
                out.append(
                    {
                        "path": path,
                        "symbols": [{"id": f"{path}::{s.name}", "path": path, "name": s.name, "kind": s.kind, "start_line": s.start_line, "end_line": s.end_line, "signature": s.signature, "body": s.body} for s in got.symbols],
                        "imports": [{"importer": path, "from_module": m, "symbol_name": n} for m, n in got.imports],
                        "calls": [{"caller_id": f"{path}::{got.symbols[i].name}", "callee_name": c, "call_line": line} for i, c, line in got.calls],
                    }
                )
            yield pd.DataFrame(out)


PARSED = (
    "path string, symbols array<struct<id:string,path:string,name:string,kind:string,start_line:int,end_line:int,signature:string,body:string>>, "
    "imports array<struct<importer:string,from_module:string,symbol_name:string>>, calls array<struct<caller_id:string,callee_name:string,call_line:int>>"
)


def parse_files(files: DataFrame, overrides: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``files(path, content, language)`` -> one row per file with its symbols, imports and calls."""
    # only ever lowered, and it stays so, as plans are run later
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", files.sparkSession.conf
    now = re.fullmatch(r"(\d+)b?", conf.get(key, "64m"))
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return files.select("path", "content", "language").mapInPandas(lambda batches: _parse_batches(batches, overrides), PARSED)


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.inline("symbols"))


def imports_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.inline("imports")).distinct()


def calls_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.inline("calls")).distinct()
