"""Records which config fields a stage reads; what can't be told apart counts as all."""

from __future__ import annotations

import dataclasses
import enum
from collections.abc import Mapping
from pathlib import PurePath
from typing import Any


def _plain(value: Any) -> Any:
    """JSON values of what a typed config may hold."""
    if isinstance(value, enum.Enum):
        return _plain(value.value)
    if isinstance(value, PurePath):
        return str(value)
    if isinstance(value, Mapping):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def as_dict(config: Any) -> dict[str, Any]:
    """The config as JSON values: what keys are made of."""
    return _plain(dataclasses.asdict(config) if dataclasses.is_dataclass(config) else dict(config or {}))


def _top(config: Any) -> dict[str, Any]:
    """Top-level fields with their values as they are."""
    if dataclasses.is_dataclass(config):
        return {f.name: getattr(config, f.name) for f in dataclasses.fields(config)}
    return dict(config or {})


def _itself(config: Any) -> Any:
    return config


class RecordingConfig:
    """Attribute and item access by top-level field.

    What can't be told apart latches all fields: a name that is no field (it may become
    one), ``__dict__``, methods and properties of the config, iteration, length,
    membership, equality, text, copies and pickles. All of these are the config's own: a
    typed one keeps its methods, and a copy or pickle of it is of its type.
    """

    __slots__ = ("_config", "_data", "_read")  # no instance dict, so that ``__dict__`` comes by __getattr__

    def __init__(self, config: Any):
        object.__setattr__(self, "_config", config if dataclasses.is_dataclass(config) else dict(config or {}))
        object.__setattr__(self, "_data", _top(config))
        object.__setattr__(self, "_read", set())

    def __getattr__(self, name: str) -> Any:
        if name in self._data:
            return self[name]
        data = dict(self._all())
        return data if name == "__dict__" else getattr(self._config, name)

    def __getitem__(self, name: str) -> Any:
        if name not in self._data:
            return self._all()[name]
        if self._read is not None:
            self._read.add(name)
        return self._data[name]

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("a config can't be changed")

    def _all(self) -> dict[str, Any]:
        object.__setattr__(self, "_read", None)
        return self._data

    def __iter__(self):
        return iter(self._all())

    def __len__(self) -> int:
        return len(self._all())

    def __contains__(self, name: object) -> bool:
        return name in self._all()

    def __eq__(self, other: object) -> bool:
        other = other._config if isinstance(other, RecordingConfig) else other
        return self._all() == other or self._config == other

    __hash__ = None

    def __repr__(self) -> str:
        self._all()
        return repr(self._config)

    def __reduce_ex__(self, protocol: int):
        self._all()
        return _itself, (self._config,)

    def recorded(self) -> list[str] | None:
        """Fields read so far, sorted; None for all."""
        return None if self._read is None else sorted(self._read)


def project(config: dict[str, Any], access: list[str] | None) -> dict[str, Any]:
    return config if access is None else {k: config[k] for k in sorted(access) if k in config}


def merge(recorded: list[str] | None, previous: list[str] | None, has_previous: bool, same_source: bool) -> list[str] | None:
    if recorded is None or same_source and has_previous and previous is None:
        return None
    return sorted({*recorded, *(previous or ())}) if same_source and has_previous else sorted(recorded)
