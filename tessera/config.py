"""Settings: defaults, overridden by a mapping or a YAML file with ${VAR} references."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

_VAR = re.compile(r"\$\{(\w+)\}")


@dataclass(frozen=True)
class Settings:
    """Every number an operator takes by default."""

    max_tokens: int = 600
    overlap_tokens: int = 150
    min_tokens: int = 50
    merge_below: int = 100
    parent_tokens: int = 2500
    fetch_factor: int = 4
    rrf_k: int = 60
    rrf_k_keyword: int = 40
    utility_alpha: float = 0.15
    utility_start: float = 0.5
    utility_weight: float = 0.3
    decay_days: int = 30
    ppr_alpha: float = 0.85
    ppr_iterations: int = 30
    ppr_tolerance: float = 1e-6
    synonymy_threshold: float = 0.80
    bridge_threshold: float = 0.75
    crag_correct: float = 0.8
    crag_ambiguous: float = 0.5
    self_rag_threshold: float = 0.6
    soft_assignment: float = 0.1
    tree_levels: int = 3
    community_resolutions: tuple[float, ...] = (0.5, 1.0, 2.0)

    @classmethod
    def of(cls, values: Mapping[str, Any]) -> "Settings":
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def substitute(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """${VAR} in strings of nested dicts and lists; an unset variable is a ValueError."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def found(m: re.Match) -> str:
        if m[1] not in env:
            raise ValueError(f"environment variable {m[1]} is not set")
        return env[m[1]]

    return _VAR.sub(found, value)


def read_dotenv(text: str, env: dict[str, str]) -> dict[str, str]:
    """KEY=VALUE lines added to env; what is set stays."""
    for line in text.splitlines():
        key, eq, value = line.partition("=")
        if eq and not key.lstrip().startswith("#"):
            env.setdefault(key.strip(), value.strip().strip("'\""))
    return env


def load(path: str, env: Mapping[str, str] | None = None) -> Settings:
    import yaml

    with open(path, encoding="utf-8") as f:
        data = substitute(yaml.safe_load(f) or {}, env)
    flat: dict[str, Any] = {}
    for k, v in data.items():
        flat |= v if isinstance(v, dict) else {k: v}
    return Settings.of(flat)
