"""Defaults of all operators."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Retrieval:
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    graph_weight: float = 0.3
    rrf_k: int = 60
    hop_decay: float = 0.5
    overfetch: int = 5
    hops: int = 2
    recency_days: float = 30.0


@dataclass(frozen=True)
class Edges:
    similarity_threshold: float = 0.82
    similarity_candidates: int = 20
    temporal_window_s: int = 300
    tag_min_shared: int = 2
    tag_min_jaccard: float = 0.5
    relation_weight: float = 0.8


@dataclass(frozen=True)
class Lifecycle:
    min_strength: float = 0.1
    prune_strength: float = 0.05
    consolidation_threshold: float = 0.3
    cold_age_days: int = 14
    cold_access: int = 3
    cluster_threshold: float = 0.75
    min_cluster: int = 2
    summary_window: int = 30
    summary_top: int = 10
    ngram: int = 3
    ngram_support: int = 2
    ngram_top: int = 5
    ngram_min_rows: int = 4


@dataclass(frozen=True)
class Jobs:
    batch: int = 64
    max_attempts: int = 3
    backoff_s: int = 10
    backoff_cap: int = 6


@dataclass(frozen=True)
class Privacy:
    redaction_tags: tuple[str, ...] = ("private", "secret", "confidential")
    exclude_paths: tuple[str, ...] = ("**/.env", "**/*.pem", "**/*.key", "**/secrets/**")
    max_content_bytes: int = 102_400
    passive_importance: float = 0.3


@dataclass(frozen=True)
class Config:
    retrieval: Retrieval = field(default_factory=Retrieval)
    edges: Edges = field(default_factory=Edges)
    lifecycle: Lifecycle = field(default_factory=Lifecycle)
    jobs: Jobs = field(default_factory=Jobs)
    privacy: Privacy = field(default_factory=Privacy)
    session_gap_s: int = 1800
    context_tokens: int = 2000
    context_candidates: int = 200
    chars_per_token: int = 4
    blast_depth: int = 5
    code_exclude: tuple[str, ...] = ("**/target/**", "**/node_modules/**", "**/.git/**", "**/*.test.ts", "**/*_test.rs")


DEFAULTS = Config()


def interpolate(value: Any, env: dict[str, str] | None = None) -> Any:
    """``{ env.X }`` in strings, lists and tables replaced by the variable, an unset one by nothing."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, str):
        return re.sub(r"\{\s*env\.(\w+)\s*\}", lambda m: env.get(m.group(1), ""), value)
    if isinstance(value, list):
        return [interpolate(v, env) for v in value]
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    return value


def merged(base: Any, changes: dict[str, Any]) -> Any:
    """A settings object with the given values; sections are merged, arrays replaced, unknown keys ignored."""
    known = {f.name for f in fields(base)}
    out = {}
    for k, v in changes.items():
        if k in known:
            old = getattr(base, k)
            out[k] = merged(old, v) if is_dataclass(old) and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v
    return replace(base, **out)


def load(path: str, env: dict[str, str] | None = None) -> Config:
    """Defaults changed by a TOML file."""
    with open(path, "rb") as f:
        return merged(DEFAULTS, interpolate(tomllib.load(f), env))
