"""Skeletons: declarations without their insides."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import groupby, takewhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import parse

BRACED = {"rust", "javascript", "typescript", "go", "java", "c", "cpp", "csharp", "php", "swift", "kotlin", "scala"}
_BODIED = {"function", "method"}


def _render(lines: list[str], hidden: set[int]) -> str:
    """The lines; in place of each run of hidden ones (blank ones don't count) one placeholder, indented as the first of them."""
    out = []
    for gone, run in groupby(enumerate(lines), key=lambda x: x[0] in hidden):
        run = [line for _, line in run]
        if gone:
            shown = [line for line in run if line.strip()][:1]
            out += [re.match(r"\s*", line)[0] + "..." for line in shown]
        else:
            out += run
    return "".join(f"{x}\n" for x in out)


def _braced(text: str, language: str) -> str:
    """The lines between the braces of functions and methods are hidden."""
    hidden: set[int] = set()
    for s in parse.parse_text(text, language).symbols:
        if s.kind in _BODIED and s.braces:
            hidden.update(range(text.count("\n", 0, s.braces[0]) + 1, text.count("\n", 0, s.braces[1])))
    return _render(text.splitlines(), hidden)


def _bodies(tree: ast.AST) -> Iterator[tuple[int, int]]:
    """(first line, last line) of what outermost functions hide: their statements after the docstring."""
    for node in ast.iter_child_nodes(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield from _bodies(node)
            continue
        first = node.body[0]
        documented = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
        start = first.end_lineno + 1 if documented else first.lineno
        # a body on the header's own line stays with it
        signature = max([node.lineno, *(x.end_lineno for x in ast.walk(node.args) if hasattr(x, "end_lineno")), *([node.returns.end_lineno] if node.returns else [])])
        if start > signature:
            yield start, node.end_lineno


def _loose_bodies(lines: list[str]) -> Iterator[tuple[int, int]]:
    """The same by brackets and indents, for text that doesn't parse (docstrings are hidden with the rest)."""
    width = [len(re.match(r"[ \t]*", x)[0]) if x.strip() else None for x in lines]
    done = 0
    for k, line in enumerate(lines):
        if k < done or not re.match(r"\s*(?:async\s+)?def\s", line):
            continue
        open_brackets, last = 0, k
        for last in range(k, len(lines)):
            open_brackets += sum(lines[last].count(c) for c in "([{") - sum(lines[last].count(c) for c in ")]}")
            if open_brackets <= 0:
                break
        inside = takewhile(lambda i: width[i] is None or width[i] > width[k], range(last + 1, len(lines)))
        done = last + 1 + len(list(inside))
        yield last + 2, done


def _python(text: str) -> str:
    """Signatures and docstrings stay; the rest of each function is hidden, inner functions with it."""
    lines = text.splitlines()
    try:
        bodies = list(_bodies(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        bodies = list(_loose_bodies(lines))
    hidden: set[int] = set()
    for first, last in bodies:
        # comments above the first statement, and blank lines on either side, go with the body
        while first > 1 and re.match(r"\s*(#|$)", lines[first - 2]):
            first -= 1
        while last < len(lines) and not lines[last].strip():
            last += 1
        hidden.update(range(first - 1, last))
    return _render(lines, hidden)


def skeleton(text: str, language: str) -> str:
    if language == "python":
        return _python(text)
    return _braced(text, language) if language in BRACED else text


@F.pandas_udf(T.StringType())
def _skeletons(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else skeleton(t, lang or "") for t, lang in zip(text, language, strict=True)])


def skeletons(files: DataFrame) -> DataFrame:
    """``files(path, content, language)`` with ``skeleton``."""
    return files.withColumn("skeleton", _skeletons("content", "language"))
