"""Dataclasses as schemas: of a pipeline's ``Config`` and ``Args``, and as command line flags."""

from __future__ import annotations

import argparse
import dataclasses
import enum
import json
import types
import typing
from collections.abc import Iterator, Mapping
from typing import Any


def _inner(kind: Any) -> tuple[Any, bool]:
    """(the type without None, whether None is allowed)."""
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        rest = [k for k in typing.get_args(kind) if k is not type(None)]
        return (rest[0] if len(rest) == 1 else typing.Union[tuple(rest)]), len(rest) < len(typing.get_args(kind))
    return kind, False


def build(schema: type, values: Any, at: str = "") -> Any:
    """An instance of ``schema`` (a dataclass, a plain type, a container of them) from JSON values.

    Unknown and missing fields and values of another type are errors that name the field.
    """
    inner, optional = _inner(schema)
    where = at or getattr(inner, "__name__", str(inner))
    if values is None and (optional or inner in (Any, type(None))) or inner is Any:
        return values
    if dataclasses.is_dataclass(inner):
        if isinstance(values, inner):
            return values
        if not isinstance(values, Mapping):
            raise ValueError(f"{where}: not a mapping: {values!r}")
        hints = typing.get_type_hints(inner)
        fields = {f.name: f for f in dataclasses.fields(inner) if f.init}
        if unknown := sorted(set(values) - set(fields)):
            raise ValueError(f"{where}: unknown field {', '.join(unknown)}")
        if missing := [n for n, f in fields.items() if n not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]:
            raise ValueError(f"{where}: missing field {', '.join(missing)}")
        return inner(**{n: build(hints[n], v, f"{at}.{n}" if at else n) for n, v in values.items()})
    origin, args = typing.get_origin(inner), typing.get_args(inner)
    if origin is typing.Literal:
        if values not in args:
            raise ValueError(f"{where}: not one of {', '.join(map(str, args))}: {values!r}")
        return values
    if origin in (list, tuple):
        if not isinstance(values, (list, tuple)):
            raise ValueError(f"{where}: not a list: {values!r}")
        return origin(build(args[0] if args else Any, v, f"{at}[{i}]") for i, v in enumerate(values))
    if origin is dict:
        if not isinstance(values, Mapping):
            raise ValueError(f"{where}: not a mapping: {values!r}")
        return {k: build(args[1], v, f"{at}.{k}") for k, v in values.items()}
    if isinstance(inner, type) and issubclass(inner, enum.Enum):
        try:
            return values if isinstance(values, inner) else inner(values)
        except ValueError:
            raise ValueError(f"{where}: not one of {', '.join(str(m.value) for m in inner)}: {values!r}") from None
    if inner is float and isinstance(values, int) and not isinstance(values, bool):
        return float(values)
    if isinstance(inner, type) and (not isinstance(values, inner) or isinstance(values, bool) and inner is not bool):
        raise ValueError(f"{where}: not {inner.__name__}: {values!r}")
    return values


def _fields(schema: type, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Any]]:
    hints = typing.get_type_hints(schema)
    for f in dataclasses.fields(schema):
        inner, _ = _inner(hints[f.name])
        if dataclasses.is_dataclass(inner):
            yield from _fields(inner, (*path, f.name))
        else:
            yield (*path, f.name), hints[f.name]


def add_flags(parser: argparse.ArgumentParser, schema: type) -> None:
    """A flag for each field: ``--a.b``; booleans also as ``--no-a.b``, lists as JSON, ``null`` where None is allowed."""
    taken = {o for action in parser._actions for o in action.option_strings}
    for path, kind in _fields(schema):
        name = ".".join(path)
        flag = "--" + name.replace("_", "-")
        if flag in taken:
            raise ValueError(f"argument {name!r} clashes with the option {flag}")
        inner, optional = _inner(kind)
        own: dict[str, Any] = {"dest": f"args.{name}", "default": argparse.SUPPRESS, "help": f"Args.{name}"}
        if inner is bool:
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, **own)
            continue
        parse = json.loads if inner in (list, tuple, dict, int, float) or typing.get_origin(inner) in (list, tuple, dict) else str
        choices = list(typing.get_args(inner)) if typing.get_origin(inner) is typing.Literal else [m.value for m in inner] if isinstance(inner, type) and issubclass(inner, enum.Enum) else None
        if choices:
            own["choices"] = [*choices, *([None] if optional else [])]
        kind_of = (lambda text, parse=parse: None if text == "null" else parse(text)) if optional else parse
        parser.add_argument(flag, type=kind_of, metavar=name.upper(), **own)


def collect(namespace: argparse.Namespace, schema: type) -> dict[str, Any]:
    """What the command line gave, nested as the schema is."""
    out: dict[str, Any] = {}
    given = vars(namespace)
    for path, _ in _fields(schema):
        if (key := f"args.{'.'.join(path)}") in given:
            at = out
            for part in path[:-1]:
                at = at.setdefault(part, {})
            at[path[-1]] = given[key]
    return out
