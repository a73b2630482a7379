"""Rule tables. They decide results and are stated as they must be."""

EXTENSION_LANGUAGE = {
    "rust": ["rs"],
    "python": ["py"],
    "javascript": ["js", "mjs", "cjs"],
    "typescript": ["ts", "tsx"],
    "go": ["go"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cxx", "cc", "hpp"],
    "csharp": ["cs"],
    "ruby": ["rb"],
    "php": ["php"],
    "swift": ["swift"],
    "dart": ["dart"],
    "kotlin": ["kt", "kts"],
    "scala": ["scala"],
    "shell": ["sh", "bash", "zsh"],
    "markdown": ["md", "mdx"],
    "toml": ["toml"],
    "yaml": ["yaml", "yml"],
    "json": ["json"],
    "xml": ["xml"],
    "html": ["html", "htm"],
    "css": ["css", "scss", "sass"],
    "sql": ["sql"],
    "dockerfile": ["dockerfile"],
}
DOCUMENTATION = ["md", "mdx", "txt", "rst"]
CONFIGURATION = ["toml", "yaml", "yml", "json", "xml", "ini", "cfg", "conf"]
EXCLUDED_DIRS = [".git", ".rag", ".tidemill", "target", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".nuxt", "vendor", "coverage", ".cache", ".turbo", ".idea", ".vscode"]
DIFFABLE_LANGUAGES = ["rust", "python", "javascript", "typescript", "go", "java", "c", "cpp", "csharp", "ruby", "php"]

#: language -> (declaration prefix, kind); where several fit a line the longest counts.
SYMBOL_PREFIXES = {
    "rust": [("pub async fn ", "function"), ("pub fn ", "function"), ("async fn ", "function"), ("fn ", "function"), ("pub struct ", "struct"), ("struct ", "struct"), ("pub enum ", "enum"), ("enum ", "enum"), ("pub trait ", "trait"), ("trait ", "trait"), ("impl ", "impl")],
    "python": [("async def ", "function"), ("def ", "function"), ("class ", "class")],
    "javascript": [("export async function ", "function"), ("export function ", "function"), ("async function ", "function"), ("function ", "function"), ("export class ", "class"), ("class ", "class"), ("export const ", "const"), ("const ", "const")],
    "go": [("func ", "function"), ("type ", "type")],
    "java": [("public class ", "class"), ("class ", "class"), ("public interface ", "interface"), ("interface ", "interface"), ("fun ", "function"), ("public ", "function")],
    "ruby": [("def ", "function"), ("class ", "class"), ("module ", "module")],
    "php": [("function ", "function"), ("class ", "class")],
    "swift": [("func ", "function"), ("class ", "class"), ("struct ", "struct")],
}
SYMBOL_PREFIXES["typescript"] = SYMBOL_PREFIXES["javascript"]
SYMBOL_PREFIXES["kotlin"] = SYMBOL_PREFIXES["scala"] = SYMBOL_PREFIXES["java"]

#: language -> prefixes by which a chunk is named after its first declaration, in order of preference.
CHUNK_PREFIXES = {
    "rust": ["pub async fn ", "pub fn ", "async fn ", "fn ", "pub struct ", "struct ", "pub enum ", "enum ", "pub trait ", "trait ", "impl "],
    "python": ["async def ", "def ", "class "],
    "javascript": ["export async function ", "export function ", "async function ", "function ", "export class ", "class ", "export const ", "const "],
    "go": ["func "],
    "java": ["public class ", "private class ", "protected class ", "class ", "public static ", "public "],
    "ruby": ["def ", "class "],
    "php": ["function ", "class "],
    "swift": ["func ", "class ", "struct "],
}
CHUNK_PREFIXES["typescript"] = CHUNK_PREFIXES["javascript"]
CHUNK_PREFIXES["kotlin"] = CHUNK_PREFIXES["scala"] = CHUNK_PREFIXES["csharp"] = CHUNK_PREFIXES["java"]

#: Prefixes of a declaration when a range is asked for by name, and qualifiers that may precede them.
RANGE_PREFIXES = ["fn ", "async fn ", "def ", "async def ", "class ", "function ", "func ", "struct ", "impl ", "trait ", "enum ", "export ", "const ", "static ", "type ", "let ", "var ", "interface ", "module ", "mod "]
RANGE_QUALIFIERS = ["pub(crate) ", "pub ", "export default ", "default ", "unsafe "]
RANGE_LINES = 60

TURKISH = r" ve | için | bir | ile |[şğıçöü]"
TOKEN_RATIOS = {"turkish": 3.0, "code": 3.5, "text": 4.0}
