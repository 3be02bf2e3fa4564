"""Command line: ``python -m stageledger.cli MODULE:CLASS COMMAND`` and ``... stores FOLDER COMMAND``.

Exit codes: 0 done and complete, 1 something isn't or failed, 2 a review is pending.
A pipeline's ``Args`` dataclass gives it a flag per field.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Iterator
from typing import Any

from .api import Graph, Pipeline
from .functions import branches, typed
from .plans import bulk
from .plans.engine import Blocked, Engine, PendingReview
from .sources.store import StoreLocked, discover

STATUSES = ("hit", "needs-review", "needs-run", "resume", "failed", "error")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stageledger", allow_abbrev=False)
    p.add_argument("pipeline", help="MODULE:CLASS, or 'stores' for all stores under a folder")
    p.add_argument("command", help="run, status, plan, ls, reuse, invalidate, clean; for stores: the folder")
    p.add_argument("targets", nargs="*", help="selectors: base or base@axis=id; for stores: ls, status, run, reuse or invalidate")
    p.add_argument("--out", default="out")
    p.add_argument("--branches", help="JSON or YAML file of branches")
    p.add_argument("--branch", default=None, help="main where none is given; for stores: only this one")
    p.add_argument("--config", default="{}", help="JSON over the branch's config")
    p.add_argument("--axes", default="{}", help="JSON: axis -> active ids")
    p.add_argument("--args", default="null", help="JSON for ctx.args; never part of a key")
    p.add_argument("--force", action="store_true")
    p.add_argument("--rehash", action="store_true")
    p.add_argument("--expand", action="store_true", help="status: a row per cell")
    p.add_argument("--upto", action="append", default=[])
    p.add_argument("--downstream", nargs="?", const=True, default=False)
    p.add_argument("--slice", action="append", default=[], metavar="AXIS=ID[,ID]")
    p.add_argument("--module-prefix", default="", help="stores: only pipelines of this prefix")
    p.add_argument("--include-temp", action="store_true", help="stores: also those of temporary branches")
    p.add_argument("--status", action="append", default=[], choices=STATUSES, help="stores: only those of this status")
    return p


def shorten(name: str, width: int = 32) -> str:
    """A stage name for a table: lines of at most ``width``, cut after ``_`` or ``-`` where it has them, else in the middle."""
    if len(name) <= width:
        return name
    lines, rest = [], name
    while len(rest) > width:
        at = max(rest.rfind(c, 0, width) for c in "_-")
        if at <= 0:
            return f"{name[: width // 2]}…{name[len(name) - (width - width // 2 - 1) :]}"
        lines.append(rest[: at + 1])
        rest = rest[at + 1 :]
    return "\n".join([*lines, rest])


def table(rows: list[tuple[str, ...]]) -> str:
    """Aligned columns; a cell of several lines takes several rows."""
    lines: list[list[str]] = []
    for row in rows:
        cells = [c.split("\n") for c in row]
        for i in range(max(map(len, cells))):
            lines.append([c[i] if i < len(c) else "" for c in cells])
    widths = [max(map(len, column)) for column in zip(*lines, strict=True)] if lines else []
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in lines)


def load(name: str) -> type[Pipeline]:
    module, _, cls = name.partition(":")
    found: Any = importlib.import_module(module)
    for part in cls.split("."):
        found = getattr(found, part)
    return found


def load_qualified(name: str) -> type[Pipeline]:
    """``module.Class`` as stores record it: the longest prefix that is a module."""
    parts = name.split(".")
    for cut in range(len(parts) - 1, 0, -1):
        try:
            return load(f"{'.'.join(parts[:cut])}:{'.'.join(parts[cut:])}")
        except ModuleNotFoundError as e:
            if not ".".join(parts[:cut]).startswith(e.name or "\0"):
                raise
    raise ValueError(f"no pipeline {name!r}")


def _spark(spark):
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    return spark


def main(argv: list[str] | None = None, spark=None) -> int:
    own, rest = parser(), list(sys.argv[1:] if argv is None else argv)
    first, _ = own.parse_known_args(rest)
    try:
        if first.pipeline == "stores":
            return _stores(own.parse_args(rest), spark)
        pipeline = load(first.pipeline)
        if schema := getattr(pipeline, "Args", None):
            typed.add_flags(own, schema)
        return _dispatch(own.parse_args(rest), pipeline, spark)
    except PendingReview as e:
        print(e, file=sys.stderr)
        return 2
    except (Blocked, StoreLocked, ValueError, KeyError, FileNotFoundError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def _args(a: argparse.Namespace, pipeline: type[Pipeline]) -> Any:
    given = json.loads(a.args)
    schema = getattr(pipeline, "Args", None)
    return branches.merge(given or {}, typed.collect(a, schema)) if schema else given


def _engines(a: argparse.Namespace, spark) -> Iterator[Engine]:
    """An engine for each store that the options choose, with the config that its branch or claim names."""
    known = branches.load(a.branches) if a.branches else {}
    for s in discover(a.command):
        if not s["pipeline"].startswith(a.module_prefix) or a.branch and s["branch"] != a.branch or s["temporary"] and not a.include_temp:
            continue
        pipeline = load_qualified(s["pipeline"])
        if s["temporary"]:
            config, axes = s["temporary"]["config"], s["temporary"]["axes"]
        else:
            own = branches.resolve(a.command, getattr(pipeline, "config", {}), known | {s["branch"]: known.get(s["branch"], {})}, s["branch"], env=branches.from_environment(pipeline.__name__))
            config, axes = own.config, own.axes
        yield Engine(spark, pipeline, s["root"], config, _args(a, pipeline), axes, s["temporary"])


def _stores(a: argparse.Namespace, spark) -> int:
    command = a.targets[0] if a.targets else "ls"
    if command == "ls" and not a.status:
        for s in discover(a.command):
            if s["pipeline"].startswith(a.module_prefix) and (not a.branch or s["branch"] == a.branch):
                print(f"{s['pipeline']}\t{s['branch']}\t{s['root']}")
        return 0
    spark = _spark(spark)
    engines = list(_engines(a, spark))
    if command in ("ls", "status") or a.status:
        rows = [r for r in bulk.overview(spark, engines).collect() if not a.status or r.status in a.status]
        if command in ("ls", "status"):
            print(table([(r.store, r.status, r.reason) for r in rows]))
            return 0 if {r.status for r in rows} <= {"hit"} else 1
        engines = [e for e in engines if str(e.store.root) in {r.store for r in rows}]
    if command == "run":
        return bulk.run_all(engines)
    if command in ("reuse", "invalidate"):
        totals = bulk.review_all(engines, command)
        print(" ".join(f"{k}={v}" for k, v in totals.items()))
        return 1 if totals["failed"] else 0
    raise ValueError(f"unknown command for stores {command!r}")


def _dispatch(a: argparse.Namespace, pipeline: type[Pipeline], spark) -> int:
    own = branches.resolve(a.out, getattr(pipeline, "config", {}), branches.load(a.branches) if a.branches else None, a.branch or "main", json.loads(a.config), json.loads(a.axes), branches.from_environment(pipeline.__name__))
    if a.command == "ls":
        for s in Graph(pipeline, own.axes).pipeline.templates().values():
            print(f"{s.name}\t{s.kind}\t{','.join(s.needs) or '-'}\t{','.join(x.name for x in s.axes) or '-'}")
        return 0
    e = Engine(_spark(spark), pipeline, own.root, own.config, _args(a, pipeline), own.axes, own.temporary)
    if a.command == "run":
        slices = {k: v.split(",") for k, _, v in (s.partition("=") for s in a.slice)}
        down = a.targets if a.downstream else []
        for o in e.run(a.force, only=[] if down else a.targets, upto=a.upto, downstream=down, slices=slices):
            print(f"{o['stage']}\t{o['status']}\t{o['reason']}\t{'ran' if o['ran'] else 'kept'}\t{o['elapsed']:.2f}s")
        return 0
    if a.command == "status":
        rows = [r for t in (a.targets or [None]) for r in e.status(t, a.rehash, a.expand).collect()]
        for r in rows:
            print(f"{r.base}\t{r.status}\t{r.reason}\t{r.cells}\t{'-' if r.recorded_seconds is None else f'{r.recorded_seconds:.2f}s'}")
        left = {r.status for r in rows} - {"hit"}
        return 0 if not left else 2 if left == {"needs-review"} else 1
    if a.command == "plan":
        chosen = set(e.graph.select(upto=a.targets)) if a.targets else set(e.graph.order)
        for p in e.probe():
            if p["stage"] in chosen:
                print(f"{shorten(p['stage'])}\t{p['status']}\t<- {', '.join(e.graph.stages[p['stage']].concrete_needs) or '-'}")
        return 0
    if a.command in ("reuse", "invalidate"):
        for base, outcome in e.review(a.command, *a.targets).items():
            print(f"{base}\t{outcome}")
        return 0
    if a.command == "clean":
        print("\n".join(e.clean(*a.targets, downstream=bool(a.downstream))))
        return 0
    raise ValueError(f"unknown command {a.command!r}")


if __name__ == "__main__":
    sys.exit(main())
