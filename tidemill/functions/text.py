"""Scalar functions as Spark columns: all stay inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions import rules


def extension(path: Column) -> Column:
    """Lower-cased extension, '' if there is none; a leading dot starts a name, not an extension."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def language_of(ext: Column) -> Column:
    out = F.lit("text")
    for language, known in reversed(rules.EXTENSION_LANGUAGE.items()):
        out = F.when(ext.isin(*known), language).otherwise(out)
    return out


def content_type(ext: Column) -> Column:
    return F.when(ext.isin(*rules.DOCUMENTATION), "documentation").when(ext.isin(*rules.CONFIGURATION), "config").otherwise("code")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def is_turkish(text: Column) -> Column:
    return F.lower(text).rlike(rules.TURKISH)


def token_estimate(text: Column, language: Column) -> Column:
    """Characters over a ratio that depends on the kind of text, rounded up."""
    ratio = F.when(is_turkish(text), rules.TOKEN_RATIOS["turkish"]).when(language.isin("markdown", "text"), rules.TOKEN_RATIOS["text"]).otherwise(rules.TOKEN_RATIOS["code"])
    return F.ceil(F.length(text) / ratio).cast("bigint")


def simple_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4.0).cast("bigint")


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\"'`<>]+|[\"'`<>]+$", "")


def path_leaf(module: Column) -> Column:
    """Last non-empty part on slash, dot and backslash; the whole text if there is none."""
    parts = F.filter(F.split(module, r"[/.\\]"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), module)


def scope_leaf(module: Column) -> Column:
    return F.substring_index(F.regexp_replace(module, r"::\*$", ""), "::", -1)


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clamp(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def caller_path(symbol_id: Column) -> Column:
    return F.substring_index(symbol_id, "::", 1)


def caller_name(symbol_id: Column) -> Column:
    """After the first separator."""
    return F.substr(symbol_id, F.locate("::", symbol_id) + 2)


def lines_of(text: Column) -> Column:
    """Lines without their ends; a final line end starts no line, and an empty text has none."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(plain, "\n", -1))


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end, from 1, clamped; empty where start is beyond end."""
    lines = lines_of(text)
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(lines))
    return F.when(first > last, "").otherwise(F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n"))


def indent_width(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^[ \t]*", 0))


def uri_to_path(uri: Column) -> Column:
    return F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("%20"), F.lit(" "))


def collection_name(name: Column) -> Column:
    return F.lower(F.translate(name, " -", "__"))


def bar(share: Column, width: int = 20) -> Column:
    """A text bar of filled and empty blocks."""
    filled = F.least(F.greatest(F.round(share * width), F.lit(0)), F.lit(width)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def ellipsize(text: Column, limit: int) -> Column:
    """Keeps the end of a long text."""
    return F.when(F.length(text) > limit, F.concat(F.lit("…"), F.right(text, F.lit(limit - 1)))).otherwise(text)


def chunk_symbol(content: Column, language: Column) -> Column:
    """The first declaration in a chunk, as its prefix and name; null if there is none."""
    out = F.lit(None).cast("string")
    for lang, prefixes in rules.CHUNK_PREFIXES.items():
        choice = "|".join(re.escape(p) for p in prefixes)
        found = F.regexp_extract(content, rf"(?m)^[^\S\n]*((?:{choice})[\p{{L}}\p{{N}}_]+)", 1)
        out = F.when(language == lang, F.nullif(found, F.lit(""))).otherwise(out)
    return out


def glob_to_regex(glob: str) -> str:
    """A glob as a regular expression; ``*`` crosses separators and case doesn't count."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(glob_to_regex(x)[6:-1] for x in glob[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?is)^{out}$"


def language_filter(value: str) -> str:
    """A known language's own name, else a short word is taken as an extension, else as it is."""
    low = value.lower()
    if low in rules.EXTENSION_LANGUAGE or low == "text":
        return low
    if len(low) <= 5 and " " not in low:
        return next((k for k, exts in rules.EXTENSION_LANGUAGE.items() if low.lstrip(".") in exts), "text")
    return low


def import_patterns(path: Column) -> Column:
    """LIKE patterns under which other files import a path; an array, empty for crate roots."""
    has_ext = path.contains(".")
    ext = F.when(has_ext, F.substring_index(path, ".", -1)).otherwise("")
    stem = F.when(has_ext, F.substr(path, F.lit(1), F.length(path) - F.length(ext) - 1)).otherwise(path)
    last = lambda c: F.substring_index(c, "/", -1)
    rust = F.regexp_replace(F.regexp_replace(stem, "^src/", ""), "/mod$", "")
    scoped = F.replace(rust, F.lit("/"), F.lit("::"))
    python = F.regexp_replace(stem, "/__init__$", "")
    dotted = F.replace(python, F.lit("/"), F.lit("."))
    folder = F.regexp_replace(stem, "/index$", "")
    any_ = F.array(F.concat(F.lit("%"), path, F.lit("%")))
    return (
        F.when(~has_ext, any_)
        .when((ext == "rs") & rust.isin("main", "lib"), F.array().cast("array<string>"))
        .when(ext == "rs", F.array(F.concat(F.lit("crate::"), scoped, F.lit("%")), F.concat(scoped, F.lit("%")), F.concat(F.lit("super::"), last(rust), F.lit("%")), F.concat(F.lit("self::"), last(rust), F.lit("%"))))
        .when(ext.isin("py", "pyi"), F.array(F.concat(dotted, F.lit("%")), F.concat(F.lit("%."), last(python)), F.concat(F.lit("%."), last(python), F.lit(".%"))))
        .when(
            ext.isin("js", "jsx", "mjs", "cjs", "ts", "tsx", "vue", "svelte"),
            F.when(stem == "index", F.array(F.concat(F.lit("%"), stem, F.lit("%"))))
            .when(last(stem) == "index", F.array(F.concat(F.lit("%/"), last(folder)), F.concat(F.lit("%/"), last(folder), F.lit("/index%"))))
            .otherwise(F.array(F.concat(F.lit("%/"), last(stem)), F.concat(F.lit("%/"), last(stem), F.lit("."), ext))),
        )
        .otherwise(any_)
    )
