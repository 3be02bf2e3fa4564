"""Probe, run, review and clean one output root.

No key depends on another stage's decision, only on what is recorded and stored, so
a probe lays down relations and keys and decides all stages in one Spark plan
(``stageledger.plans.probe``).
Execution is serial; each artifact goes to a fresh folder, and its record flips last.
"""

from __future__ import annotations

import asyncio
import inspect
import json
import time
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..api import Dependencies, Graph, Outputs, Pipeline, Stage
from ..functions import config_access, source_code, typed
from ..functions.config_access import RecordingConfig
from ..operators import batch, keys, rollup
from ..sources import manifest
from ..sources.recordlog import RecordLog
from ..sources.store import Store, canonical, digest, listing
from ..sources.tables import discard
from . import probe

#: Tags rows of a stage with several outputs.
OUTPUT = "_output"
#: Commits of input digests before they are compacted.
COMPACT = 20


class PendingReview(RuntimeError):
    """Source changes that need a decision: reuse or invalidate."""


class Unfingerprinted(RuntimeError):
    """An artifact was written, but its content can't be read back: not its stage's failure."""


class Blocked(RuntimeError):
    """A stage outside the selection isn't a hit, or can't be evaluated."""


@dataclass
class Ctx:
    """What a stage body sees: config, args, cell and its needs as DataFrames."""

    spark: SparkSession
    config: Any
    args: Any
    stage: Stage
    artifacts: dict[str, dict[str, Any]]
    done: dict[int, Any] = field(default_factory=dict)
    _resumed: list[int] | None = None
    _total: int | None = None
    #: (index, folder) of the items whose rows are there as they were committed; of a batch by rows.
    _valid: Callable[[], DataFrame] | None = None
    _by_rows: bool = False

    @property
    def cell(self) -> dict[str, str]:
        return dict(self.stage.cell)

    def _needed(self, need: str) -> list[str]:
        name = need if isinstance(need, str) else need.__name__
        for logical, cells in self.stage.need_cells:
            if logical == name:
                return list(cells)
        raise KeyError(f"stage {self.stage.name!r} reads {name!r} without needing it")

    def inputs(self, need: str) -> list[DataFrame]:
        """All artifacts of a need in order: cells, then indexes, then names."""
        return [_opened(self.spark, a) for c in self._needed(need) for a in self.artifacts[c]["artifacts"]]

    def input(self, need: str) -> DataFrame:
        found = [a for c in self._needed(need) for a in self.artifacts[c]["artifacts"]]
        if len(found) != 1:
            raise ValueError(f"{need!r} has {len(found)} artifacts; input() takes one, inputs() or union() all")
        return _opened(self.spark, found[0])

    def union(self, need: str) -> DataFrame:
        """All artifacts of a need in one frame, with their position."""
        frames = [f.withColumn("position", F.lit(i)) for i, f in enumerate(self.inputs(need))]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def resume(self, items: Iterable[Any]) -> Iterable[Any]:
        """Items whose index has no valid checkpoint yet, by anti-join on the index."""
        items = list(items)
        self._total = len(items)
        rows = self.spark.createDataFrame([(i,) for i in range(len(items))], "index long")
        done = self.spark.createDataFrame([(i,) for i in self.done], "index long")
        self._resumed = sorted(r.index_ for r in batch.remaining(rows, done, ["index"]).withColumnRenamed("index", "index_").collect())
        return [items[i] for i in self._resumed]


    def remaining(self, items: DataFrame) -> DataFrame:
        """Those of ``items`` (index, ...) that have no valid rows yet; nothing comes to the driver.

        The body then yields frames with a column ``index``, of as many items as it likes:
        each frame is written in one job, by index, and committed with its items' sums. A
        later run does again what is missing or was altered. An item that makes no row is
        done each time.
        """
        self._by_rows = True
        return batch.remaining(items, self._valid(), ["index"])


def _opened(spark: SparkSession, artifact: dict[str, Any]) -> DataFrame:
    """What is stored of an artifact; of one that was written among others, its own columns."""
    found = spark.read.parquet(artifact["path"])
    return found.select(*[found[c] for c in artifact["columns"]]) if "columns" in artifact else found


def _digest(df: DataFrame, row: dict[str, Any]) -> str:
    return digest({"schema": df.schema.jsonValue(), "n": row["n"], "a": row["a"], "b": row["b"]})


def fingerprint(df: DataFrame) -> str:
    """Content digest of a dataset: schema and its rows as a multiset."""
    return _digest(df, keys.dataset_fingerprint(df).first().asDict())


def _write(spark: SparkSession, df: DataFrame, path: str, name: str) -> dict[str, Any]:
    """Write an artifact and digest its rows on their way, in one pass."""
    seen = Observation()
    df.observe(seen, *keys.fingerprint_aggregates(df)).write.parquet(path)
    try:
        stored = spark.read.parquet(path)
        found = seen.get
        return {"name": name, "path": path, "fingerprint": _digest(stored, found) if found.keys() == {"n", "a", "b"} else fingerprint(stored), "listing": listing(path)}
    except Exception as e:
        raise Unfingerprinted(f"{name}: {type(e).__name__}: {e}") from e


def _write_split(spark: SparkSession, outputs: Outputs, folder: str) -> list[dict[str, Any]]:
    """Several outputs of one frame in one job: a row goes to each output that takes it.

    Files hold the columns of all outputs, those of others null; rows are tagged, dealt
    out by tag as they are written, and digested by tag on their way.
    """
    parts = outputs.resolved()
    frames = {name: outputs.frame.select(*columns) for name, (_, columns) in parts.items()}
    kinds: dict[str, Any] = {}
    for name, frame in frames.items():
        for f in frame.schema.fields:
            if kinds.setdefault(f.name, f.dataType) != f.dataType:
                raise TypeError(f"column {f.name!r} has two types among the outputs: return a dict of frames")
    if OUTPUT in kinds:
        raise ValueError(f"no output may have a column {OUTPUT!r}")
    rows = []
    for name, (where, columns) in parts.items():
        own = dict(zip(frames[name].columns, [F.col(c) if isinstance(c, str) else c for c in columns], strict=True))
        fields = [own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
        rows.append(F.when(F.expr(where) if isinstance(where, str) else where, F.struct(F.lit(name).alias(OUTPUT), *fields)))
    tagged = outputs.frame.select(F.inline(F.array_compact(F.array(*rows))))
    aggregates = [a for i, (name, frame) in enumerate(frames.items()) for a in keys.fingerprint_aggregates(tagged.select(*frame.columns), where=tagged[OUTPUT] == name, prefix=f"{i}_")]
    seen = Observation()
    tagged.observe(seen, *aggregates).write.partitionBy(OUTPUT).parquet(folder)
    out, totals = [], seen.get
    for i, (name, frame) in enumerate(frames.items()):
        path = f"{folder}/{OUTPUT}={name}"
        if not listing(path):  # no row went there
            frame.limit(0).write.parquet(path)
        made = {"name": name, "path": path, "columns": frame.columns, "listing": listing(path)}
        row = {x: totals.get(f"{i}_{x}") for x in "nab"}
        out.append(made | {"fingerprint": _digest(_opened(spark, made), row) if None not in row.values() else fingerprint(_opened(spark, made))})
    return out


def _current(spark: SparkSession, artifact: dict[str, Any], rehash: bool) -> str | None:
    """Fingerprint of what is stored now: by its listing if unchanged, else from the data; None if gone."""
    now = listing(artifact["path"])
    if not now:
        return None
    if not rehash and now == artifact["listing"]:
        return artifact["fingerprint"]
    try:
        return fingerprint(_opened(spark, artifact))
    except Exception:  # files that no longer are a dataset
        return "unreadable"


class Snapshot:
    """What one session of probes has read: each record, checkpoint, artifact, source and input once.

    A stage that ran is read anew, nothing else is.
    """

    def __init__(self, engine: "Engine", rehash: bool = False):
        self.engine, self.rehash = engine, rehash
        self.bases: dict[str, dict[str, Any]] = {}
        self.sources = source_code.Sources()
        self.records: dict[str, dict[str, Any] | None] = {}
        self.partial: dict[str, dict[str, dict[int, dict[str, Any]]]] = {}
        self.now: dict[str, str | None] = {}
        for n in engine.graph.order:
            self.read(n)

    def read(self, n: str) -> None:
        store = self.engine.store
        r = self.records[n] = store.read("stages", n)
        self.partial[n] = store.partials(n) if self.engine.graph.stages[n].kind == "batch" else {}
        for a in [*(r["artifacts"] if r else []), *(a for found in self.partial[n].values() for x in found.values() for a in x["artifacts"])]:
            self.now[a["path"]] = _current(self.engine.spark, a, self.rehash)


class Engine:
    def __init__(self, spark: SparkSession, pipeline: type[Pipeline], root: str, config: Any = None, args: Any = None, axes: dict[str, list[Any]] | None = None, temporary: dict[str, Any] | None = None):
        self.spark, self.store = spark, Store(root)
        self.graph = Graph(pipeline, axes)
        self.name = f"{pipeline.__module__}.{pipeline.__qualname__}"
        #: Dataclasses ``Config`` and ``Args`` of the pipeline, where it has them, check what they are given.
        typed_ = lambda name, value: typed.build(schema, value or {}) if (schema := getattr(pipeline, name, None)) else value
        self.config, self.args = typed_("Config", config), typed_("Args", args)
        self.temporary = temporary
        self._staged = list({s.base: s.func for s in self.graph.stages.values()}.values())
        #: Digests of input files by path, size and stamp: a log that runs add to, and what isn't in it yet.
        self._files = RecordLog(spark, f"{self.store.root.resolve().as_uri()}/files")
        self._unsaved: list[DataFrame] = []

    # Keys

    def _dependencies(self, s: Stage) -> Dependencies:
        return self.graph.pipeline.depends.merged(s.depends)

    def _content(self, path: str) -> str:
        """Digest of an input file or tree; only files that changed since their digest was taken are read."""
        known = self._files.state(kind="file").select(F.col("name").alias("path"), F.from_json("body", "size long, stamp long, version int, content_hash string").alias("b")).select("path", "b.*")
        for newer in self._unsaved:
            known = newer.unionByName(known.join(newer.select("path"), "path", "left_anti"))
        found = manifest.listed(self.spark, path)
        entries, fresh = manifest.hashed(found, known)
        out = manifest.digest(entries)
        discard(found)
        if not fresh.isEmpty():
            self._unsaved.append(fresh)
        return out

    def _save_digests(self) -> None:
        """Into the log, in one commit; the log is compacted now and then."""
        if self._unsaved:
            rows = self._unsaved[-1]
            for older in reversed(self._unsaved[:-1]):
                rows = rows.unionByName(older.join(rows.select("path"), "path", "left_anti"))
            body = F.to_json(F.struct("size", "stamp", "version", "content_hash"))
            self._files.append(rows.select(F.lit("file").alias("kind"), F.col("path").alias("name"), body.alias("body")))
            self._unsaved = []
            if len(self._files.commits()) > COMPACT:
                self._files.vacuum(self._files.compact())

    def _base(self, snapshot: Snapshot, s: Stage, inputs_memo: dict | None = None) -> dict[str, Any]:
        """What the cells of a base share: source fingerprints, config fields, inputs, values, as JSON; or what went wrong."""
        out: dict[str, Any] = {"rerun": None, "review": None, "config": {}, "inputs": {}, "values": {}, "error": None}
        try:
            d, call = self._dependencies(s), lambda v: v(self.config) if callable(v) else v
            out["rerun"], out["review"] = source_code.observe(s.func, self._staged, d.sources, d.review_sources, snapshot.sources)
            memo = {} if inputs_memo is None else inputs_memo
            for name, value in d.inputs.items():
                value, found = call(value), []
                for path in dict.fromkeys(map(str, value if isinstance(value, (list, tuple)) else [value])):
                    if path not in memo:
                        memo[path] = self._content(path)
                    found.append([path, memo[path]])
                out["inputs"][name] = canonical(sorted(found))
            values = {n: call(v) for n, v in d.values.items()} | ({"matrix-layout": "1"} if s.cell else {})
            out["values"] = {n: canonical(v) for n, v in values.items()}
            out["config"] = {n: canonical(v) for n, v in config_access.as_dict(self.config).items()}
        except Exception as e:
            out["error"] = f"{type(e).__name__}: {e}"
        return out

    def _state(self, n: str, at: int, snapshot: Snapshot, shared: dict[str, Any]) -> tuple:
        s, r = self.graph.stages[n], snapshot.records[n] or {}
        attempt, failure = self.store.read("attempts", n) or {}, self.store.read("failures", n) or {}
        decided = self.store.read("reviews", s.base) or {}
        return (
            n, s.base, s.kind, at, shared["rerun"], shared["review"], shared["error"], not r and self.store.outdated("stages", n), shared["config"], shared["inputs"], shared["values"],
            bool(r), r.get("key"), r.get("access"), r.get("rerun"), r.get("review"), r.get("elapsed"),
            attempt.get("key"), attempt.get("review"), failure.get("key"), failure.get("review"), decided.get("decision"), decided.get("review"),
        )

    def _around(self, names: list[str], snapshot: Snapshot) -> tuple[DataFrame, DataFrame]:
        """(needs, artifacts): of these stages and what they need."""
        needs, near = {}, dict.fromkeys(names)
        for n in names:
            s = self.graph.stages[n]
            fan = any(len(c) > 1 for _, c in s.need_cells)
            needs |= {(n, u): i if fan else None for _, cells in s.need_cells for i, u in enumerate(cells)}
            near |= dict.fromkeys(s.concrete_needs)
        known = [(n, r) for n in near if (r := snapshot.records[n])]
        rows = [(n, probe.MARK, "", "", "") for n, _ in known] + [(n, i, a["name"], a["fingerprint"], snapshot.now[a["path"]]) for n, r in known for i, a in enumerate(r["artifacts"])]
        return probe.relation(self.spark, [(*k, i) for k, i in needs.items()], probe.NEEDS), probe.relation(self.spark, rows, probe.ARTIFACTS)

    # Probe

    def probe(self, stages: Iterable[str] | None = None, rehash: bool = False, snapshot: Snapshot | None = None, force: bool = False) -> list[dict[str, Any]]:
        """Statuses in topological order; one Spark plan for all stages."""
        snapshot = snapshot or Snapshot(self, rehash)
        only = None if stages is None else set(stages)
        wanted = [n for n in self.graph.order if only is None or n in only]
        rows, memo = [], {}
        for at, n in enumerate(wanted):
            s = self.graph.stages[n]
            if s.base not in snapshot.bases:
                snapshot.bases[s.base] = self._base(snapshot, s, memo)
            rows.append(self._state(n, at, snapshot, snapshot.bases[s.base]))
        partial = [(n, k, i, a["path"], a["fingerprint"], snapshot.now[a["path"]]) for n in wanted for k, found in snapshot.partial[n].items() for i, x in found.items() for a in x["artifacts"]]
        make = lambda rows, schema: probe.relation(self.spark, rows, schema)
        relations = probe.Relations(make(rows, probe.STATE), *self._around(wanted, snapshot), make(partial, probe.PARTIAL) if partial else None)
        found = sorted((row.asDict() for row in probe.probed(relations, force).collect()), key=lambda p: p["ord"])
        reasons = ("execution_reason", "action_reason", "reason")
        if moved := [p for p in found if any(p[x] == probe.MOVED for x in reasons)]:
            parts = [(p["stage"], *row) for p in moved for row in _part_rows(snapshot.records[p["stage"]]["parts"])]
            now = [tuple(p[c] for c in ("stage", "rerun", "projected", "inputs", "values", "up")) for p in moved]
            told = {x.stage: x.reason for x in probe.changes(make(now, probe.FOUND), make(parts, probe.PARTS)).collect()}
            for p in moved:
                p |= {x: told[p["stage"]] for x in reasons if p[x] == probe.MOVED and p["stage"] in told}
        return [self._told(p, snapshot) for p in found]

    def _told(self, p: dict[str, Any], snapshot: Snapshot) -> dict[str, Any]:
        """A probe's row with the records that it speaks of."""
        checkpoints = lambda key, indexes: {i: snapshot.partial[p["stage"]][key][i] for i in indexes or []}
        return p | {"record": snapshot.records[p["stage"]], "parts": _parts(p, "projected"), "partial": checkpoints(p["key"], p["indexes"]), "whole_partial": checkpoints(p["whole"], p["whole_indexes"])}

    def _final(self, n: str, access: list[str] | None, rerun: str, snapshot: Snapshot) -> tuple[str, dict[str, Any]]:
        """Key and parts of a stage that ran, by the fields that it read; inputs are read again."""
        s = self.graph.stages[n]
        shared = self._base(snapshot, s) | {"rerun": rerun}
        if shared["error"]:
            raise RuntimeError(shared["error"])
        row = list(self._state(n, 0, snapshot, shared))
        row[probe.ACCESS], row[probe.RERUN] = access, rerun
        needs, artifacts = self._around([n], snapshot)
        found = probe.keyed(probe.relation(self.spark, [tuple(row)], probe.STATE), needs, probe.stored(artifacts)).first().asDict()
        return found["key"], _parts(found, "projected")

    def status(self, selector: str | None = None, rehash: bool = False, expand: bool = False) -> DataFrame:
        """Per base stage, or per cell (``expand``): effective status, cells, recorded seconds. Probed whole, then filtered."""
        chosen = set(self.graph.resolve(selector)) if selector else set(self.graph.order)
        rows = [(p["stage" if expand else "base"], p["stage"], p["status"], p["reason"], p["elapsed"], p["ord"]) for p in self.probe(rehash=rehash) if p["stage"] in chosen]
        frame = self.spark.createDataFrame(rows, "base string, stage string, status string, reason string, duration double, ord long")
        total = rollup.durations(frame, "base")
        order = frame.groupBy("base").agg(F.min("ord").alias("ord"), F.count("*").alias("cells"))
        return rollup.reasons(frame, "base").join(total, "base").join(order, "base").orderBy("ord").drop("ord")

    # Run

    def run(self, force: bool = False, **selection: Any) -> list[dict[str, Any]]:
        """Execute what isn't a hit, in topological order; outcomes per stage."""
        with self.store.lock():
            self.store.initialize(self.name, self.temporary)
            chosen = self.graph.select(**selection)
            snapshot = Snapshot(self)
            probes = {p["stage"]: p for p in self.probe(self.graph.closure(chosen), snapshot=snapshot, force=force)}
            if pending := [n for n in chosen if probes[n]["status"] == "needs-review"]:
                raise PendingReview(f"source changes need a review: {', '.join(pending)}")
            if wrong := [f"{n} ({p['reason']})" for n, p in probes.items() if p["status"] == "error"]:
                raise Blocked(f"can't evaluate {', '.join(wrong)}")
            if outside := [n for n, p in probes.items() if n not in chosen and p["status"] != "hit"]:
                raise Blocked(f"stages outside the selection aren't current: {', '.join(outside)}")
            outcomes, ran = [], set()
            for n in chosen:
                if ran & set(self.graph.stages[n].concrete_needs):  # only then is it another decision
                    probes[n] = self.probe([n], snapshot=snapshot, force=force)[0]
                outcomes.append(self._execute(n, probes[n], snapshot, force))
                if outcomes[-1]["ran"]:
                    ran.add(n)
                    snapshot.read(n)
            self._save_digests()
            return outcomes

    def _execute(self, n: str, p: dict[str, Any], snapshot: Snapshot, force: bool) -> dict[str, Any]:
        s = self.graph.stages[n]
        if p["status"] == "error":
            raise Blocked(f"{n}: {p['reason']}")
        if p["status"] == "needs-review":
            raise PendingReview(f"source changes need a review: {n}")
        invalidated = p["relationship"] == "changed" and p["decision"] == "invalidate"
        if p["action"] == "hit":
            self._refresh(n, p["record"])
            return {"stage": n, "status": "hit", "reason": "hit", "ran": False, "elapsed": 0.0}
        if force or invalidated:
            self.store.drop_partial(n)
            p["partial"] = {}
        elif p["relationship"] == "changed" and p["record"] and p["record"]["access"] is not None:
            p = self._whole_config(n, s, p)
        began = time.monotonic()
        mark = {"key": p["key"], "rerun": p["rerun"], "review": p["review_fingerprint"], "at": _now()}
        self.store.write(mark, "attempts", n)
        config = RecordingConfig(self.config)
        ctx = Ctx(self.spark, config, self.args, s, {u: snapshot.records[u] for u in s.concrete_needs}, p["partial"])
        ctx._valid = lambda: self._valid_rows(n, p["key"])
        try:
            artifacts = self._batch(n, s, ctx, p["key"]) if s.kind == "batch" else self._single(n, s, ctx)
        except Unfingerprinted:  # the attempt's mark stays: interrupted
            raise
        except Exception as e:
            self.store.write(mark | {"exception": type(e).__name__, "message": str(e)[:2000]}, "failures", n)
            self.store.drop("attempts", n)
            raise
        previous = p["record"]
        access = config_access.merge(config.recorded(), previous["access"] if previous else None, bool(previous), bool(previous) and previous["rerun"] == p["rerun"])
        key, parts = self._final(n, access, p["rerun"], snapshot)
        elapsed = time.monotonic() - began
        self.store.write({"key": key, "parts": parts, "access": access, "rerun": p["rerun"], "review": p["review_fingerprint"], "artifacts": artifacts, "elapsed": elapsed, "at": _now()}, "stages", n)
        for kind in ("attempts", "failures"):
            self.store.drop(kind, n)
        self.store.drop_partial(n)
        return {"stage": n, "status": p["action"], "reason": p["action_reason"], "ran": True, "elapsed": elapsed}

    def _whole_config(self, n: str, s: Stage, p: dict[str, Any]) -> dict[str, Any]:
        """Under reused source that changed, execution starts from the whole config; a batch's
        checkpoints of the projected key are adopted there, those of the whole key win."""
        if p["whole"] == p["key"]:
            return p
        partial = p["partial"]
        if s.kind == "batch":
            partial = partial | p["whole_partial"]
            for i, r in partial.items():
                self.store.write(r, "partial", n, p["whole"], str(i))
        return p | {"parts": _parts(p, "config"), "key": p["whole"], "partial": partial}

    def _refresh(self, n: str, record: dict[str, Any]) -> None:
        """Same content under other files or stamps: only the listings are renewed."""
        now = [listing(a["path"]) for a in record["artifacts"]]
        if now != [a["listing"] for a in record["artifacts"]]:
            self.store.write(record | {"artifacts": [a | {"listing": x} for a, x in zip(record["artifacts"], now, strict=True)]}, "stages", n)

    def _frames(self, made: Any, base: str) -> list[tuple[str, DataFrame]]:
        frames = made if isinstance(made, dict) else {base: made}
        for name, df in frames.items():
            if not isinstance(df, DataFrame):
                raise TypeError(f"{name!r} is {type(df).__name__}, not a DataFrame")
        return list(frames.items())

    def _single(self, n: str, s: Stage, ctx: Ctx) -> list[dict[str, Any]]:
        made, folder = s.func(ctx, **dict(s.cell)), self.store.fresh(n)
        if inspect.iscoroutine(made):
            made = asyncio.run(made)
        if isinstance(made, Outputs):
            return _write_split(self.spark, made, folder)
        return [_write(self.spark, df, f"{folder}/{name}", name) for name, df in self._frames(made, s.base)]

    def _batch(self, n: str, s: Stage, ctx: Ctx, key: str) -> list[dict[str, Any]]:
        found = {i: r["artifacts"] for i, r in ctx.done.items() if "sums" not in r}
        for count, made in enumerate(_drive(s.func(ctx, **dict(s.cell)))):
            if ctx._by_rows:
                self._commit_rows(n, key, made, s.base)
                continue
            if ctx._resumed is None:  # a body that doesn't resume starts over
                if not count:
                    warnings.warn(f"batch stage {n} yields without ctx.resume: nothing of it is resumed", stacklevel=2)
                found = {} if not count else found
            index = count if ctx._resumed is None else ctx._resumed[count]
            folder = self.store.fresh(n)
            found[index] = [_write(self.spark, df, f"{folder}/index={index}/{name}", name) for name, df in self._frames(made, s.base)]
            self.store.write({"artifacts": found[index], "at": _now(), "total": ctx._total}, "partial", n, key, str(index))
        if ctx._by_rows:
            return self._rows_artifacts(n, key)
        return [a | {"name": f"{i}/{a['name']}"} for i in sorted(found) for a in found[i]]

    # Batches by rows

    def _row_sums(self, folders: list[str]) -> DataFrame:
        """(folder, index, n, a, b) of what is stored, in one pass over all folders."""
        df = self.spark.read.option("recursiveFileLookup", "true").parquet(*folders)
        path = F.col("_metadata.file_path")
        at = df.select(F.element_at(F.split(path, "/"), -3).alias("folder"), F.regexp_extract(path, "/index=([0-9]+)/", 1).cast("long").alias("index"), "*")
        return at.groupBy("folder", "index").agg(*keys.fingerprint_aggregates(at.drop("folder", "index")))

    def _commits(self, n: str, key: str) -> dict[int, dict[str, Any]]:
        return {i: r for i, r in self.store.partial(n, key).items() if "sums" in r}

    def _commit_rows(self, n: str, key: str, frame: DataFrame, name: str) -> None:
        """Data, then its sums, then the record that names both."""
        folder = self.store.fresh(n)
        frame.write.partitionBy("index").parquet(folder)
        sums = f"{folder}-sums"
        if not self._held(folder):  # no rows
            return
        self._row_sums([folder]).write.parquet(sums)
        made = [{"name": name, "path": folder, "fingerprint": fingerprint(self.spark.read.parquet(folder)), "listing": listing(folder)}]
        number = max(self._commits(n, key), default=-1) + 1
        self.store.write({"sums": sums, "path": folder, "artifacts": made, "at": _now(), "total": None}, "partial", n, key, str(number))

    @staticmethod
    def _held(folder: str) -> bool:
        return any(x[0].startswith("index=") for x in listing(folder))

    def _valid_rows(self, n: str, key: str) -> DataFrame:
        """(index, folder) of committed items whose stored rows have the sums that were committed."""
        commits = self._commits(n, key).values()
        folders = [r["path"] for r in commits if self._held(r["path"])]
        if not folders:
            return self.spark.createDataFrame([], "index long, folder string")
        recorded = self.spark.read.parquet(*[r["sums"] for r in commits])
        return recorded.join(self._row_sums(folders), ["folder", "index", "n", "a", "b"], "left_semi").select("index", "folder")

    def _rows_artifacts(self, n: str, key: str) -> list[dict[str, Any]]:
        """The commits' folders without what is no longer valid; what was redone stands in a later one."""
        import shutil

        commits = self._commits(n, key)
        valid = self._valid_rows(n, key)
        folders = [r["path"] for r in commits.values() if self._held(r["path"])]
        stale = self._row_sums(folders).join(valid, ["folder", "index"], "left_anti").select("folder", F.col("index").alias("i")).collect() if folders else []
        for x in stale:  # as many as were altered
            shutil.rmtree(Path(folders[0]).parent / x.folder / f"index={x.i}", ignore_errors=True)
        out = []
        for i, r in commits.items():
            shutil.rmtree(r["sums"], ignore_errors=True)
            if self._held(r["path"]):
                a = r["artifacts"][0]
                now = listing(r["path"])
                out.append(a | {"name": str(i), "listing": now, "fingerprint": a["fingerprint"] if now == a["listing"] else fingerprint(self.spark.read.parquet(r["path"]))})
        return out

    def progress(self) -> DataFrame:
        """stage, done, total, progress of every batch stage with checkpoints under its current key."""
        rows = [(p["stage"], i, r.get("total")) for p in self.probe() for i, r in p["partial"].items()]
        return batch.progress(self.spark.createDataFrame(rows, "stage string, index long, total long"), "stage")

    # Reviews and cleaning

    def review(self, decision: str, *targets: str) -> dict[str, str]:
        """Record reuse or invalidate for base stages with an undecided source change."""
        if decision not in ("reuse", "invalidate"):
            raise ValueError(f"not a decision: {decision!r}")
        if cells := [t for t in targets if "@" in t]:
            raise ValueError(f"reviews are for base stages: {cells[0].partition('@')[0]!r}")
        if not self.store.known:
            raise ValueError(f"no store at {self.store.root}")
        with self.store.lock():
            bases = {self.graph.stages[n].base for t in targets for n in self.graph.resolve(t)} or set(self.graph.bases)
            out: dict[str, str] = {}
            for p in self.probe():
                if p["status"] == "error":
                    raise Blocked(f"{p['stage']}: {p['reason']}")
                if p["base"] in bases and out.get(p["base"]) != "recorded":
                    changed = p["relationship"] == "changed"
                    out[p["base"]] = "not-needed" if not changed else "already-decided" if p["decision"] == decision else "recorded"
                    if out[p["base"]] == "recorded":
                        self.store.write({"review": p["review_fingerprint"], "decision": decision, "at": _now()}, "reviews", p["base"])
            return out

    def clean(self, *targets: str, downstream: bool = False) -> list[str]:
        """Delete recorded artifacts and records of the targets (all, without any); reviews stay."""
        import shutil

        if not self.store.known:
            raise ValueError(f"no store at {self.store.root}")
        with self.store.lock():
            chosen = {n for t in targets for n in self.graph.resolve(t)} if targets else set(self.graph.stages)
            chosen = self.graph.closure(chosen, up=False) if downstream else chosen
            for n in chosen:
                inside = (self.store.root / "data").resolve()
                for a in (self.store.read("stages", n) or {"artifacts": []})["artifacts"]:
                    if inside in Path(a["path"]).resolve().parents:
                        shutil.rmtree(a["path"], ignore_errors=True)
                for kind in ("stages", "attempts", "failures"):
                    self.store.drop(kind, n)
                self.store.drop_partial(n)
            return [n for n in self.graph.order if n in chosen]


def _drive(items: Any) -> Iterable[Any]:
    """A batch body's frames, one by one, also from an async generator."""
    if not hasattr(items, "__anext__"):
        yield from items
        return
    loop = asyncio.new_event_loop()
    try:
        while True:
            try:
                yield loop.run_until_complete(items.__anext__())
            except StopAsyncIteration:
                return
    finally:
        loop.close()


def _parts(p: dict[str, Any], config: str) -> dict[str, Any]:
    """What a key is made of, as recorded."""
    plain = lambda m: {k: json.loads(v) for k, v in m.items()}
    return {"config": plain(p[config]), "inputs": plain(p["inputs"]), "values": plain(p["values"]), "upstreams": dict(p["up"]), "source": p["rerun"]}


def _part_rows(parts: dict[str, Any]) -> Iterable[tuple[str, str, str]]:
    yield "source", "code", parts["source"]
    for kind, name in (("config", "config"), ("value", "values"), ("input", "inputs")):
        yield from ((kind, k, canonical(v)) for k, v in parts[name].items())
    yield from (("upstream", k, v) for k, v in parts["upstreams"].items())


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()
