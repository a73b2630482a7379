"""Source text to tokens, and tokens to declarations, in one pass each.

A lexer per language knows comments, strings and words. Declarations come from a stack of scopes: each open
bracket is a frame that holds the tokens of its present statement, with closed brackets inside it folded to one
token, so every token is looked at once however deep the text nests. Where a statement opens a brace, or
ends, grammar rules over its few tokens tell whether it declares something. Nothing has to start a line.

What a declaring keyword declares is data (``KINDS``): rows of a user's table take the place of a language's own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

#: language -> declaring keyword -> kind; ``()`` stands for methods and functions told by their form alone.
KINDS: dict[str, dict[str, str]] = {
    "rust": {"fn": "function", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "mod": "module", "const": "const", "static": "static", "type": "type", "macro_rules": "macro", "impl": "impl"},
    "javascript": {"function": "function", "class": "class", "=>": "function", "()": "method"},
    "typescript": {"function": "function", "class": "class", "=>": "function", "()": "method", "interface": "interface", "type": "type", "enum": "enum"},
    "go": {"func": "function", "type": "type"},
    "java": {"class": "class", "record": "class", "enum": "class", "interface": "interface", "()": "method"},
    "csharp": {"class": "class", "record": "class", "struct": "class", "enum": "class", "interface": "interface", "()": "method"},
    "c": {"struct": "class", "union": "class", "enum": "class", "()": "function"},
    "cpp": {"class": "class", "struct": "class", "union": "class", "()": "function"},
    "php": {"class": "class", "trait": "class", "interface": "interface", "function": "function"},
    "ruby": {"def": "method", "class": "class", "module": "module"},
    "kotlin": {"fun": "function", "class": "class", "object": "class", "interface": "interface"},
    "scala": {"def": "function", "class": "class", "object": "class", "trait": "trait"},
    "swift": {"func": "function", "class": "class", "struct": "struct"},
    "python": {"def": "function", "class": "class"},
}
LANGUAGES = frozenset(KINDS) - {"python"}
#: Words that are no callee and no name of a method.
KEYWORDS = set("if else for while do switch match return catch try finally throw case in of loop fn func function def class struct enum impl trait sizeof await yield typeof instanceof using lock foreach elif unless until and or not with assert where let var const static synchronized".split())
_STOPS = {"return", "else", "new", "throw", "await", "case", "yield", "assert", "do", "goto", "delete", "package", "import", "using", "echo"}
#: Languages whose statements end with their line, unless brackets are open or the next line begins with one.
_BY_LINE = {"go", "kotlin", "scala", "swift", "javascript", "typescript"}
_CLASSES = {"class", "interface", "impl", "trait", "struct", "enum", "module", "type"}
_TYPED = {"java", "csharp", "c", "cpp"}


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, mark, line, directive, or "()" "[]" "{}" for what was folded
    text: str
    start: int
    line: int


@dataclass
class Declared:
    name: str
    kind: str
    start: int
    name_at: int
    start_line: int
    end: int = 0
    end_line: int = 0
    braces: tuple[int, int] | None = None
    open_brace: int = -1


@dataclass
class _Frame:
    bracket: str
    flat: list[Token]
    owner: Declared | None = None  # what the brace is the body of
    scope: str = ""  # the kind of the innermost declaration around
    keeps: bool = False  # closing it doesn't end the statement around
    opened: Token | None = None
    quiet: bool = False  # it holds signatures, not statements


@lru_cache(maxsize=None)
def _pattern(language: str) -> re.Pattern:
    """Alternatives in order of preference; group names are token kinds."""
    hidden = [r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"]
    if language == "php":
        hidden.append(r"\#(?!\[)[^\n]*")
    if language == "ruby":
        hidden = [r"\#[^\n]*", r"^=begin\b(?:.|\n)*?(?:^=end\b[^\n]*|\Z)"]
    line_string, free_string = r'"(?:\\(?:.|\n)|[^"\\\n])*(?:"|(?=\n)|\Z)', r'"(?:\\(?:.|\n)|[^"\\])*(?:"|\Z)'
    strings = [free_string if language in ("rust", "php", "ruby") else line_string]
    if language == "rust":
        strings = [r'b?r(?P<hashes>\#*)"(?:.|\n)*?(?:"(?P=hashes)|\Z)', *strings, r"b?'(?:\\[^'\n]+|[^'\\\n])'", r"'\w+"]
    elif language in ("kotlin", "scala", "swift"):
        strings = [r'"""(?:.|\n)*?(?:"""|\Z)', *strings, *([r"'(?:\\.|[^'\\\n])'"] if language != "swift" else [])]
    elif language in ("php", "ruby"):
        strings.append(r"'(?:\\(?:.|\n)|[^'\\])*(?:'|\Z)")
    else:
        strings.append(r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)")
        if language == "csharp":
            strings.insert(0, r'[$@]*@[$@]*"(?:""|[^"])*(?:"|\Z)')
        if language in ("go", "javascript", "typescript"):
            strings.append(r"`(?:\\(?:.|\n)|[^`\\])*(?:`|\Z)" if language != "go" else r"`[^`]*(?:`|\Z)")
    directive = [r"(?P<directive>^[ \t]*\#(?:\\\n|[^\n])*)"] if language in ("c", "cpp") else []
    word = r"(?P<word>[$@]?[^\W\d][\w$]*[?!]?)" if language == "ruby" else r"(?P<word>[^\W\d][\w$]*|\$[\w$]+)"
    return re.compile("|".join(["(?P<hidden>" + "|".join(hidden) + ")", *directive, "(?P<string>" + "|".join(strings) + ")", word, r"(?P<number>\d[\w.]*)", r"(?P<line>\n)", r"(?P<mark>=>|->|::|:=|[=!<>]=|[^\s\w])"]), re.MULTILINE)


def _hide(found: str, string: bool) -> str:
    """Spaces in place of a comment, or of a string's inside."""
    if string and len(found) > 1 and found[0] in "\"'`":
        return found[0] + "\n".join(" " * len(x) for x in found[1:-1].split("\n")) + found[-1]
    return re.sub(r"[^\n\"']" if string else r"[^\n]", " ", found)


def lexed(text: str, language: str) -> tuple[list[Token], str]:
    """The tokens of a text, comments left out; and the text with comments and the insides of strings blanked, offsets kept."""
    out, line, clean, done = [], 1, [], 0
    add = out.append
    for m in _pattern(language).finditer(text):
        kind, found = m.lastgroup, m[0]
        if kind == "word" or kind == "mark":
            add(Token(kind, found, m.start(), line))
            continue
        if kind == "line":
            add(Token(kind, found, m.start(), line))
            line += 1
            continue
        if kind == "hashes":
            kind = "string"
        if kind != "hidden":
            add(Token(kind, found, m.start(), line))
        if kind in ("hidden", "string"):
            clean += text[done : m.start()], _hide(found, kind == "string")
            done = m.end()
        line += found.count("\n")
    return out, "".join([*clean, text[done:]])


# --- grammar rules ----------------------------------------------------------------------------


def _skip_angles(flat: list[Token], at: int) -> int:
    """Past a list of type parameters that opens at ``at``."""
    if at >= len(flat) or flat[at].text != "<":
        return at
    depth = 0
    while at < len(flat):
        depth += (flat[at].text == "<") - (flat[at].text == ">")
        at += 1
        if depth == 0:
            return at
    return at


def _head(flat: list[Token], language: str) -> tuple[int, list[Token]]:
    """Where a statement's declaration begins, and the statement without attributes, labels, annotations and template lists before it."""
    at, n, begun = 0, len(flat), None
    while at < n:
        t = flat[at]
        if t.text == "#" and at + 1 < n and flat[at + 1].kind in ("[]", "mark"):
            at += 2 + (flat[at + 1].text == "!")
        elif t.text == "@" and at + 1 < n and flat[at + 1].kind == "word" and flat[at + 1].text != "interface":
            # annotations belong to what they stand at, decorators don't
            begun = at if begun is None and language not in ("javascript", "typescript") else begun
            at += 2
            while at + 1 < n and flat[at].text == ".":
                at += 2
            at += at < n and flat[at].kind == "()"
        elif language == "csharp" and t.kind == "[]":
            begun = at if begun is None else begun
            at += 1
        elif language == "cpp" and t.text in ("public", "private", "protected") and at + 1 < n and flat[at + 1].text == ":":
            at += 2
        elif language == "cpp" and t.text == "template":
            at = _skip_angles(flat, at + 1)
        elif t.kind in ("line", "directive") or t.text == "<" and language == "php" or t.text in ("?", "?php"):
            at += 1
        elif t.text == "php" and language == "php":
            at += 1
        else:
            break
    return (at if begun is None else begun), flat[at:]


def _after(head: list[Token], at: int, language: str) -> Token | None:
    """The name that follows the keyword at ``at``."""
    at += 1
    while at < len(head) and (head[at].text in ("*", "&", "!") or head[at].kind == "line"):
        at += 1
    if language == "go" and at < len(head) and head[at].kind == "()":
        at += 1
    at = _skip_angles(head, at)
    if language == "kotlin":  # a receiver stands before the name
        while at + 2 < len(head) and head[at].kind == "word" and head[_skip_angles(head, at + 1)].text == ".":
            at = _skip_angles(head, at + 1) + 1
    if language == "ruby":
        while at + 2 < len(head) and head[at].kind == "word" and head[at + 1].text in (".", "::"):
            at += 2
    return head[at] if at < len(head) and head[at].kind == "word" else None


def _impl_name(head: list[Token], at: int) -> Token | None:
    """The type that a Rust block implements something for: after ``for``, without path and parameters."""
    words, at = [], _skip_angles(head, at + 1)
    while at < len(head) and head[at].text != "where":
        if head[at].text == "for":
            words = []
        elif head[at].kind == "word":
            words.append(head[at])
            at = _skip_angles(head, at + 1) - 1
        at += 1
    return words[-1] if words else None


def _formed(head: list[Token], language: str, scope: str, end: str) -> Token | None:
    """A method or function without a keyword: ``[type] name(...)`` before a body."""
    at = next((i for i, t in enumerate(head) if t.kind == "()" and i and head[i - 1].kind == "word" and head[i - 1].text not in ("noexcept", "throw", "decltype", "__attribute__", "alignas")), None)
    if at is None:
        return None
    name, before, after = head[at - 1], head[: at - 1], head[at + 1 :]
    if name.text in KEYWORDS or any(t.text in _STOPS for t in before) or any(t.text == "=" for t in before):
        return None
    if language in ("javascript", "typescript"):
        fine = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "*", "#"}
        bare = end == "{" and all(t.text in fine for t in before) and (not after or after[0].text == ":")
        return name if bare and name.text != "constructor" else None
    while before and before[-1].text in ("*", "&", "~", "?"):
        before = before[:-1]
    while len(before) >= 2 and before[-1].text == "::":  # a qualified name
        before = before[:-2]
    if not any(t.kind in ("word", "[]") or t.text == ">" for t in before):
        return None
    if before and before[-1].text in (".", "->", "(", ",", "+", "-", "/", "|", "="):
        return None
    if language in ("java", "csharp"):
        fine = scope in ("class", "interface") and (end in "{;" or after and after[0].text == "=>")
        return name if fine and not any(t.text in ("=", "?") for t in after[:1]) else None
    return name if end == "{" and scope not in ("function", "method") and not any(t.text == "," for t in before) else None


def declared(flat: list[Token], language: str, kinds: dict[str, str], scope: str, end: str) -> Declared | None:
    """What a statement declares; ``end`` is the brace it opens, or what ends it."""
    begun, head = _head(flat, language)
    if not head:
        return None
    assigned = next((i for i, t in enumerate(head) if t.text in ("=", ":=")), len(head))
    name, kind = None, None
    for at, t in enumerate(head[:assigned]):
        if t.kind == "()" and not (at and head[at - 1].text in ("pub", "func", "extern", "internal", "private", "package")):
            break
        if t.text not in kinds or t.kind != "word" or at and head[at - 1].text in (".", "::", "new", "->", ":", "extends"):
            continue
        if language == "rust" and t.text in ("const", "static") and at + 1 < len(head) and head[at + 1].text in ("fn", "unsafe", "async", "extern", "move"):
            continue
        if language == "rust" and t.text == "union" and not (at + 1 < len(head) and head[at + 1].kind == "word"):
            continue
        if language in ("c", "cpp") and (end != "{" or any(x.kind == "()" for x in head[at:])):
            continue  # a type that is used, or only announced
        if t.text == "type" and language == "typescript" and assigned == len(head):
            continue
        if language == "csharp" and t.text == "struct" and at + 1 < len(head) and head[at + 1].text == ",":
            continue
        found = _impl_name(head, at) if t.text == "impl" else _after(head, at + (t.text == "static" and at + 1 < len(head) and head[at + 1].text == "mut"), language)
        if found is not None and not (found.text in KEYWORDS and language != "ruby"):
            name, kind = found, kinds[t.text]
            break
        return None
    if name is None and "=>" in kinds and 2 <= assigned < len(head) and any(t.text in ("const", "let", "var") for t in head[: assigned - 1]):
        value = head[assigned + 1 :]
        value = value[value[:1] != [] and value[0].text == "async" :]
        arrow = len(value) > 1 and value[0].kind in ("()", "word") and next((t.text for t in value[1:] if t.text in ("=>", "=", ";", ".")), "") == "=>" and (value[1].text in ("=>", ":"))
        if arrow or value and value[0].text == "function":
            names = [t for t in head[:assigned] if t.kind == "word" and t.text not in ("export", "const", "let", "var", "default", "declare")]
            if names:
                name, kind = names[0], kinds["=>"]
    if name is None and "()" in kinds and assigned == len(head) or name is None and "()" in kinds and language == "csharp" and any(t.text == "=>" for t in head):
        name = _formed(head, language, scope, end)
        kind = kinds["()"]
    if name is None:
        return None
    return Declared(name.text, kind, flat[begun].start, name.start, flat[begun].line)


def _keeps(flat: list[Token], language: str) -> bool:
    """Whether a brace is part of an expression: its end doesn't end the statement."""
    head = [t for t in flat if t.kind != "line"]
    if not head:
        return False
    if language == "go" and head[0].text == "func" and head[-1].text in ("interface", "struct"):
        return True
    return any(t.text in ("=", ":=") for t in head) or head[0].text == "return" and language in ("javascript", "typescript")


def declarations(text: str, language: str, kinds: dict[str, str], found: list[Token]) -> tuple[list[Declared], list[tuple[int, int]]]:
    """All declarations of a text with braces, in the order of their starts; and the ranges in which a name before a bracket is a signature."""
    quiet: list[tuple[int, int]] = []
    out: list[Declared] = []
    stack = [_Frame("", [])]
    last_line, by_line = 1, language in _BY_LINE
    unset = object()

    def close(d: Declared, end: int, line: int) -> None:
        d.end, d.end_line = end, max(line, d.start_line)

    def ended(frame: _Frame, mark: str, at: int, line: int) -> None:
        if frame.flat and frame.bracket in ("", "{"):
            d = declared(frame.flat, language, kinds, frame.scope, mark)
            if d is not None and not (mark in ("\n", "") and d.kind in ("class", "interface", "impl", "trait") and language in ("javascript", "typescript")):
                close(d, at, line)
                out.append(d)
        frame.flat = []

    for i, t in enumerate(found):
        frame = stack[-1]
        if t.kind == "line":
            if by_line and frame.bracket in ("", "{") and frame.flat:
                following = next((x for x in found[i + 1 : i + 8] if x.kind != "line"), unset)
                goes_on = following is unset or following.text in ("{", ".", "=", "=>", "?", ":", "+", "-", "*", "|", "&", ")", "]") or frame.flat[-1].text in ("=", "=>", ",", "+", "-", "*", "|", "&", "(", ".", ":", "->") or len(frame.flat) == 1 and frame.flat[0].text in ("export", "public", "private", "static", "async")
                if not goes_on or following is unset:
                    ended(frame, "\n", t.start, last_line)
            continue
        last_line = t.line
        if t.kind == "directive":
            continue
        if t.text in ("(", "["):
            stack.append(_Frame(t.text, [], scope=frame.scope, opened=t))
        elif t.text == "{":
            d, keeps = None, frame.bracket not in ("", "{")
            if not keeps:
                d = declared(frame.flat, language, kinds, frame.scope, "{")
                arrow = d is not None and any(x.text in ("=", ":=") for x in frame.flat)
                keeps = _keeps(frame.flat, language) and not (arrow and language in ("javascript", "typescript") and frame.flat[-1].text in ("=>",) or arrow and frame.flat[-1].kind == "()" and any(x.text == "function" for x in frame.flat))
                if keeps:
                    d = None
            if d is not None:
                d.open_brace = t.start
                out.append(d)
            signatures = language == "go" and bool(frame.flat) and frame.flat[-1].text == "interface" or language == "typescript" and d is not None and d.kind == "interface"
            stack.append(_Frame("{", [], d, d.kind if d is not None and d.kind in (*_CLASSES, "function", "method") else frame.scope, keeps, t, signatures))
        elif t.text in (")", "]", "}"):
            want = {")": "(", "]": "[", "}": "{"}[t.text]
            if t.text == "}":
                while len(stack) > 1 and stack[-1].bracket != "{":
                    stack.pop()
            if len(stack) == 1 or stack[-1].bracket != want:
                if t.text == "}":
                    ended(stack[-1], "}", t.start, t.line)
                continue  # it closes nothing
            if want == "{":
                ended(stack[-1], "}", t.start, t.line)
            done = stack.pop()
            outer = stack[-1]
            if want == "{" and done.quiet:
                quiet.append((done.opened.start, t.start))
            if done.owner is not None:
                done.owner.braces = (done.owner.open_brace, t.start)
                close(done.owner, t.start + 1, t.line)
            if want != "{" or done.keeps:
                outer.flat.append(Token({"(": "()", "[": "[]", "{": "{}"}[want], "", done.opened.start, done.opened.line))
            else:
                outer.flat = []
        elif t.text in (";", ",") and frame.bracket in ("", "{") and (t.text == ";" or language in ("rust", "javascript", "typescript") and frame.flat and frame.flat[-1].kind == "{}"):
            ended(frame, t.text, t.start, t.line)
        else:
            frame.flat.append(t)
    n_lines = text.count("\n") + (not text.endswith("\n"))
    while stack:
        frame = stack.pop()
        ended(frame, "", len(text), last_line)
        if frame.owner is not None:  # nothing closes it
            close(frame.owner, len(text), n_lines)
    return sorted(out, key=lambda d: (d.start, d.name_at)), sorted(quiet)


def ruby_declarations(text: str, kinds: dict[str, str], found: list[Token]) -> list[Declared]:
    """Declarations of a text with ``end`` lines, by a stack of what they close."""
    out: list[Declared] = []
    stack: list[Declared | None] = []
    flat: list[Token] = []
    loop = False
    n_lines = text.count("\n") + (not text.endswith("\n"))
    for i, t in enumerate(found):
        if t.kind == "line" or t.text == ";":
            flat, loop = [], False
            continue
        after_dot = bool(flat) and flat[-1].text in (".", "::", "&.")
        if t.kind == "word" and not after_dot:
            first = not flat
            if t.text in ("class", "module", "def") and (first or flat[-1].text in ("private", "protected", "public", "module_function", "=")):
                head = []
                for x in found[i : i + 12]:
                    if x.kind == "line" or x.text == ";":
                        break
                    head.append(x)
                name = _after(head, 0, "ruby") if len(head) > 1 and head[1].text != "<" else None
                start = flat[0] if flat and flat[0].text != "=" else t
                d = None
                if name is not None and t.text in kinds:
                    text_name = name.text + ("=" if t.text == "def" and text[name.start + len(name.text) : name.start + len(name.text) + 2] in ("=(",) else "")
                    d = Declared(text_name, kinds[t.text], start.start, name.start, start.line)
                    out.append(d)
                endless = t.text == "def" and re.match(r"def\s+[\w.?!]+\s*(?:\([^)\n]*\))?\s*=\s", text[t.start : t.start + 300])
                if endless:
                    if d is not None:
                        d.end, d.end_line = text.find("\n", t.start), t.line
                else:
                    stack.append(d)
            elif t.text in ("if", "unless", "while", "until", "case", "for", "begin") and (first or flat[-1].text in ("=", "(", "return", "<<", "||", "&&") or t.text in ("case", "begin")):
                stack.append(None)
                loop = t.text in ("while", "until", "for")
            elif t.text == "do":
                if not loop:
                    stack.append(None)
                loop = False
            elif t.text == "end" and stack:
                d = stack.pop()
                if d is not None:
                    d.end, d.end_line = t.start + 3, t.line
        flat.append(t)
    for d in stack:
        if d is not None:
            d.end, d.end_line = len(text), n_lines
    return sorted(out, key=lambda d: (d.start, d.name_at))


def calls(language: str, found: list[Token], names: set[int], quiet: list[tuple[int, int]] = ()) -> list[tuple[str, int]]:
    """``(callee, line)`` of every call, in the order of the text; ``names`` are the offsets of declared names, ``quiet`` ranges without calls."""
    out = []
    starts = [lo for lo, _ in quiet]
    n = len(found)
    closes: dict[int, int] = {}
    if language in ("java", "csharp"):
        still = []
        for i, t in enumerate(found):
            if t.text == "(":
                still.append(i)
            elif t.text == ")" and still:
                closes[still.pop()] = i
    for i, t in enumerate(found):
        if t.kind != "word" or t.start in names or t.text in KEYWORDS:
            continue
        k = i + 1
        macro = language == "rust" and k < n and found[k].text == "!"
        if macro:
            k += 1
        elif language == "rust" and k + 1 < n and found[k].text == "::" and found[k + 1].text == "<":
            depth, k = 0, k + 1
            while k < n:
                depth += (found[k].text == "<") - (found[k].text == ">")
                k += 1
                if depth == 0 or found[k - 1].text in (";", "{"):
                    break
        if k < n and (found[k].text == "(" or macro and found[k].text in ("[", "{")) and not (i and found[i - 1].text in ("new", "fn", "func", "function", "def", "fun", "class", "struct", "macro_rules", "@")):
            if macro and t.text == "macro_rules":
                continue
            around = bisect_right(starts, t.start) - 1
            if around >= 0 and t.start < quiet[around][1]:
                continue
            after = closes.get(k, n) + 1
            if closes and after < n and found[after].text in ("{", "throws"):
                continue  # a constructor
            out.append((t.text, t.line))
    return out


def owners(spans: list[tuple[int, int]], lines: list[int]) -> list[int | None]:
    """For each line the last of the spans (first line, last line; in order) that hold it, of those that start latest."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], i))
    out: list[int | None] = [None] * len(lines)
    stack: list[int] = []
    at = 0
    for j in sorted(range(len(lines)), key=lambda j: lines[j]):
        line = lines[j]
        while at < len(order) and spans[order[at]][0] <= line:
            stack.append(order[at])
            at += 1
        while stack and spans[stack[-1]][1] < line:
            stack.pop()
        out[j] = stack[-1] if stack else None
    return out
