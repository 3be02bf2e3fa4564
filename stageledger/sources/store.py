"""The store of one output root: atomic JSON records, a lock, versioned data folders."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import Any

#: 2: keys are canonical JSON of JSON texts, roots are sums.
SCHEMA = 2


def canonical(value: Any) -> str:
    """Sorted keys, compact, UTF-8 as it is; NaN and unknown types are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()


class CorruptStore(RuntimeError):
    pass


class StoreLocked(RuntimeError):
    pass


class Store:
    def __init__(self, root: str):
        self.root = Path(root)

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """One writer at a time; a second one is refused, not queued."""
        self.root.mkdir(parents=True, exist_ok=True)
        with (self.root / "lock").open("a") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                raise StoreLocked(f"another run writes to {self.root}") from None
            yield

    def _path(self, kind: str, *names: str) -> Path:
        *folders, last = (n.replace("/", "_") for n in names)
        return self.root.joinpath(kind, *folders, f"{last}.json")

    def read(self, kind: str, *names: str) -> dict[str, Any] | None:
        """Missing and other-schema records are None; what isn't JSON is an error."""
        path = self._path(kind, *names)
        try:
            found = json.loads(path.read_text())
        except FileNotFoundError:
            return None
        except ValueError as e:
            raise CorruptStore(f"{path}: {e}") from e
        return found if found.get("schema") == SCHEMA else None

    def write(self, record: dict[str, Any], kind: str, *names: str) -> None:
        path = self._path(kind, *names)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        part.write_text(canonical(record | {"schema": SCHEMA}))
        os.replace(part, path)

    def drop(self, kind: str, *names: str) -> None:
        self._path(kind, *names).unlink(missing_ok=True)

    def manifest(self) -> dict[str, Any] | None:
        path = self.root / "manifest.json"
        try:
            found = json.loads(path.read_text())
        except FileNotFoundError:
            return None
        except ValueError as e:
            raise CorruptStore(f"{path}: {e}") from e
        if not isinstance(found, dict) or "pipeline" not in found:
            raise CorruptStore(f"{path}: not a store's manifest")
        return found

    def initialize(self, pipeline: str, temporary: dict[str, Any] | None = None) -> None:
        """Claim the root, or check the claim: the pipeline, and of a temporary branch its config and axes.

        Of another schema the data and its records stay (they count as outdated), the rest is dropped.
        """
        found = self.manifest()
        if found is not None:
            if found["pipeline"] != pipeline:
                raise ValueError(f"{self.root} belongs to pipeline {found['pipeline']!r}")
            if temporary is not None and found.get("temporary") != temporary:
                raise ValueError(f"{self.root} is of another temporary branch")
            if found.get("schema") != SCHEMA:
                for kind in ("reviews", "failures", "attempts", "partial"):
                    shutil.rmtree(self.root / kind, ignore_errors=True)
        kept = temporary if temporary is not None else (found or {}).get("temporary")
        self.write({"pipeline": pipeline, "temporary": kept}, "", "manifest")

    def outdated(self, kind: str, *names: str) -> bool:
        """Whether there is a record, but of another schema."""
        path = self._path(kind, *names)
        return path.exists() and json.loads(path.read_text()).get("schema") != SCHEMA

    @property
    def known(self) -> bool:
        return (self.root / "manifest.json").exists()

    def partial(self, stage: str, key: str) -> dict[int, dict[str, Any]]:
        folder = self._path("partial", stage, key, "x").parent
        return {int(p.stem): r for p in sorted(folder.glob("[0-9]*.json")) if (r := self.read("partial", stage, key, p.stem))}

    def partials(self, stage: str) -> dict[str, dict[int, dict[str, Any]]]:
        """Checkpoints of a stage under every key."""
        folder = self._path("partial", stage, "x").parent
        found = {p.name: self.partial(stage, p.name) for p in sorted(folder.iterdir())} if folder.is_dir() else {}
        return {k: v for k, v in found.items() if v}

    def drop_partial(self, stage: str) -> None:
        shutil.rmtree(self._path("partial", stage, "x").parent, ignore_errors=True)

    def fresh(self, stage: str) -> str:
        """A new data folder; readers of the old one aren't disturbed."""
        return str(self.root / "data" / stage.replace("/", "_") / uuid.uuid4().hex)


def listing(path: str) -> list[list[Any]]:
    """Files of an artifact with size and change stamp: what a fingerprint may be reused by."""
    root = Path(path)
    return [[str(p.relative_to(root)), p.stat().st_size, p.stat().st_mtime_ns] for p in sorted(root.rglob("*")) if p.is_file()] if root.is_dir() else []


_BRANCH = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def discover(base: str) -> list[dict[str, Any]]:
    """Stores under a folder, by their manifests in folders named as branches; below a valid root nothing is looked for."""
    found = []
    for folder, below, files in os.walk(base):
        below.sort()
        if "manifest.json" in files:
            with contextlib.suppress(ValueError, OSError):
                record = json.loads((Path(folder) / "manifest.json").read_text())
                if isinstance(record, dict) and isinstance(record.get("pipeline"), str) and _BRANCH.fullmatch(Path(folder).name):
                    found.append({"pipeline": record["pipeline"], "branch": Path(folder).name, "root": folder, "temporary": record.get("temporary")})
                    below.clear()
    return sorted(found, key=lambda x: (x["pipeline"], x["branch"], x["root"]))
