"""Branches of a pipeline: named configs, overrides, and where their outputs go."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
SECTIONS = {"config", "axes"}


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a safe branch name: {name!r}")
    return name


def load(path: str) -> dict[str, dict[str, Any]]:
    """{branch: {config, axes}} from JSON, or from YAML where a reader is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    for name, own in found.items():
        check_name(name)
        if not isinstance(own or {}, dict):
            raise ValueError(f"branch {name!r}: not a mapping")
        if unknown := set(own or {}) - SECTIONS:
            raise ValueError(f"branch {name!r}: unknown section {', '.join(sorted(unknown))}")
        for section, value in (own or {}).items():
            if not isinstance(value or {}, dict):
                raise ValueError(f"branch {name!r}: {section} isn't a mapping")
        for axis, ids in ((own or {}).get("axes") or {}).items():
            if not isinstance(ids, list):
                raise ValueError(f"branch {name!r}: axis {axis!r} isn't a list")
    return {n: dict(own or {}) for n, own in found.items()}


def merge(base: Mapping[str, Any], override: Mapping[str, Any]) -> dict[str, Any]:
    """Override wins, also with null; mappings merge only where both sides are mappings."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def override_name(config: Mapping[str, Any], axes: Mapping[str, Any]) -> str:
    """Name of a temporary branch, by its content."""
    text = json.dumps({"axes": axes, "config": config}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return "main_override_" + hashlib.sha256(text.encode()).hexdigest()[:12]


def from_environment(prefix: str, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """PREFIX__FIELD__INNER=value as nested config; values are JSON where they parse, else text."""
    out: dict[str, Any] = {}
    for key, text in sorted((os.environ if env is None else env).items()):
        head, *path = key.split("__")
        if head.lower() != prefix.lower() or not path:
            continue
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        at = out
        for part in path[:-1]:
            at = at.setdefault(part.lower(), {})
        at[path[-1].lower()] = value
    return out


@dataclasses.dataclass(frozen=True)
class Branch:
    name: str
    config: dict[str, Any]
    axes: dict[str, list[Any]]
    root: str
    is_temporary: bool = False

    @property
    def temporary(self) -> dict[str, Any] | None:
        """What a temporary branch's store is claimed for."""
        return {"config": self.config, "axes": self.axes} if self.is_temporary else None


def resolve(base: str, defaults: Mapping[str, Any], branches: Mapping[str, Any] | None = None, branch: str = "main", override: Mapping[str, Any] | None = None, axes: Mapping[str, Any] | None = None, env: Mapping[str, Any] | None = None) -> Branch:
    """Override over branch over environment over defaults; overrides go to a temporary root."""
    known = branches or {}
    check_name(branch)
    if branch != "main" and branch not in known:
        raise ValueError(f"unknown branch {branch!r}")
    own = known.get(branch, {})
    config = merge(merge(defaults, env or {}), own.get("config") or {})
    chosen = dict(own.get("axes") or {})
    if not override and not axes:
        return Branch(branch, config, chosen, f"{base}/{branch}")
    config, chosen = merge(config, override or {}), chosen | dict(axes or {})
    name = override_name(config, chosen)
    return Branch(name, config, chosen, f"{base}/tmp/{name}", True)
