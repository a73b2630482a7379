"""The pruned source against a walk of the tree."""

import os

import pytest

from tidemill.config import Config
from tidemill.operators import scan
from tidemill.sources import tree

CONFIG = Config(include_extensions=["rs", "md"], include_dirs=["src", "docs", "none"], exclude_dirs=["target", "vendor"], max_file_kb=1)


@pytest.fixture
def root(tmp_path):
    made = {
        "src/a.rs": "fn a() {}", "src/B.RS": "é", "src/deep/er/c.rs": "c", "src/deep/target/x.rs": "x", "src/target/y.rs": "y", "src/target/sub/z.rs": "z",
        "src/big.rs": "b" * 3000, "src/edge.rs": "e" * 2047, "src/pic.png": "p", "src/empty.rs": "", "docs/vendor/v.md": "v", "docs/.md": "hidden", "docs/x.tar.md": "t", "other/o.rs": "o", "src/only/target/q.rs": "q",
    }
    for path, text in made.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "src/raw.rs").write_bytes(b"\xff\x00")
    os.symlink(tmp_path / "other", tmp_path / "src/link")
    os.symlink(tmp_path / "other/o.rs", tmp_path / "src/link.rs")
    for i in range(7):
        (tmp_path / "src/many").mkdir(exist_ok=True)
        (tmp_path / f"src/many/m{i}.rs").write_text(str(i))
    return tmp_path


def test_pruned_source_equals_a_walk(spark, root, monkeypatch):
    got = {r["path"]: (r["ext"], r["size_bytes"], r["content"]) for r in tree.read_pruned(spark, str(root), CONFIG).collect()}
    want = {}
    for top in ("src", "docs"):
        for folder, folders, names in os.walk(root / top):
            rel = os.path.relpath(folder, root)
            want |= {f"{rel}/{f}/": ("", 0, None) for f in folders if f in CONFIG.exclude_dirs}
            folders[:] = [f for f in folders if f not in CONFIG.exclude_dirs and not os.path.islink(f"{folder}/{f}")]
            for n in (n for n in names if not os.path.islink(f"{folder}/{n}")):
                data = open(f"{folder}/{n}", "rb").read()
                ext = n.rpartition(".")[2].lower() if "." in n.lstrip(".") else ""
                read = ext in CONFIG.include_extensions and len(data) // 1024 <= CONFIG.max_file_kb and n != "raw.rs"
                want[f"{rel}/{n}"] = (ext, len(data), data.decode() if read else None)
    assert got == want and {"src/target/", "docs/vendor/", "src/only/target/"} <= set(got)
    reasons = {r["reason"]: r["n"] for r in scan.skip_stats(tree.read_pruned(spark, f"file://{root}", CONFIG), CONFIG).collect()}
    assert reasons == {"excluded_dir": 4, "extension": 2, "too_large": 1, "binary": 1, "indexed": 13}
    assert tree.read_pruned(spark, str(root / "nowhere"), CONFIG).count() == 0


@pytest.mark.parametrize(("folders", "files"), [(1000, 2000), (1, 2000), (3, 2), (0, 1)])
def test_excluded_folders_are_not_listed_and_files_not_opened(root, monkeypatch, folders, files):
    """However the tree is dealt, each row comes once, and nothing is touched that the rules leave out."""
    monkeypatch.setattr(tree, "FOLDERS", folders)
    monkeypatch.setattr(tree, "FILES", files)
    opened, listed, text, look = [], [], tree.read_text, tree.TreeReader._list
    monkeypatch.setattr(tree, "read_text", lambda store, path: opened.append(path) or text(store, path))
    monkeypatch.setattr(tree.TreeReader, "_list", lambda self, store, folder: listed.append(folder) or look(self, store, folder))
    rules = {k: getattr(CONFIG, k) for k in ("include_dirs", "exclude_dirs", "include_extensions", "max_file_kb")}
    reader = tree.TreeReader({"path": str(root), "rules": tree.json.dumps(rules)})
    parts = reader.partitions()
    paths = [p for part in parts for batch in reader.read(part) for p in batch.column("path").to_pylist()]
    assert len(paths) == len(set(paths)) == 21
    assert not [p for p in listed if p.rpartition("/")[2] in CONFIG.exclude_dirs]
    assert not [p for p in opened if p.endswith(("big.rs", "png", "/.md")) or "target" in p.split("/")] and len(opened) == 14
