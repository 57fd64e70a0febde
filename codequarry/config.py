"""Settings from a JSON file, with defaults for what it leaves out."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from .sources.walk import EXCLUDED


@dataclass
class Config:
    root: str = "."
    store: str = "codequarry-store"
    project: str = "project"
    exclude_dirs: list[str] = field(default_factory=lambda: list(EXCLUDED))
    ignore_file: str | None = None
    vector_weight: float = 0.7
    keyword_weight: float = 0.3
    dims: int = 64
    encoder_url: str | None = None
    encoder_protocol: str = "embed"
    encoder_model: str = ""
    batch: int = 32
    max_changed_nodes: int = 100_000
    debounce: str = "2 seconds"


def load(path: str | None = None) -> Config:
    """The file's values over the defaults; without a file, the defaults. Unknown names are an error."""
    given = json.loads(Path(path).read_text(encoding="utf-8")) if path and Path(path).exists() else {}
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return Config(**given)
