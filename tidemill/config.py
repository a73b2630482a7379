"""Configuration: defaults, TOML loading and validation."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from tidemill.functions import rules


@dataclass
class Config:
    chunk_size: int = 700
    chunk_overlap: int = 80
    max_file_kb: int = 250
    include_extensions: list[str] = field(default_factory=lambda: ["rs", "toml", "md"])
    include_dirs: list[str] = field(default_factory=lambda: ["src"])
    exclude_dirs: list[str] = field(default_factory=lambda: list(rules.EXCLUDED_DIRS))
    context_chunks: int = 4
    max_results: int = 20
    graph_depth: int = 2
    max_nodes: int = 200
    bundle_budget: int = 6000
    bundle_max_tokens: int = 12000
    bundle_max_files: int = 8
    bundle_max_chunks: int = 20
    debounce_ms: int = 2000
    dimension: int = 64

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and less than chunk_size")
        if self.max_results < 1 or self.max_nodes < 1 or self.context_chunks < 1:
            raise ValueError("limits must be at least 1")

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """From a TOML file; tables are flattened, unknown keys are refused."""
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        flat: dict = {}
        for key, value in raw.items():
            flat |= value if isinstance(value, dict) else {key: value}
        known = {f.name for f in fields(cls)}
        if unknown := set(flat) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**flat)
