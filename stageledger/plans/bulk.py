"""Many stores at once: status, run and review over engines, each on its own."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup
from .engine import Engine

SCHEMA = "store string, base string, stage string, status string, reason string, duration double, last string"


def overview(spark: SparkSession, engines: Iterable[Engine]) -> DataFrame:
    """One row per store: effective status, strict seconds, completion, last run."""
    rows = []
    for e in engines:
        try:
            for p in e.probe():
                rows.append((str(e.store.root), p["base"], p["stage"], p["status"], p["reason"], p["elapsed"], (p["record"] or {}).get("at")))
        except Exception as x:  # one broken store doesn't hide the others
            rows.append((str(e.store.root), "", "", "error", f"{type(x).__name__}: {x}", None, None))
    frame = spark.createDataFrame(rows, SCHEMA)
    last = rollup.last_run(frame.withColumn("committed_at", F.coalesce("last", F.lit("none"))), "store")
    parts = [rollup.reasons(frame, "store"), rollup.durations(frame, "store"), rollup.completion(frame, "store"), last]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "store")
    return out.orderBy("store")


def run_all(engines: Iterable[Engine]) -> int:
    """Run stores that are neither complete, nor wait for a review, nor can't be evaluated.

    0: all are complete afterwards; 2: only reviews are pending; else 1, also without a
    store. What stops a store is warned of, and the next one still runs.
    """
    engines = list(engines)
    if not engines:
        return 1
    statuses: set[str] = set()
    for e in engines:
        before = {p["status"] for p in e.probe()}
        if before != {"hit"} and not before & {"needs-review", "error"}:
            try:
                e.run()
            except Exception as x:
                warnings.warn(f"{e.store.root}: {type(x).__name__}: {x}", stacklevel=2)
        statuses |= {p["status"] for p in e.probe()}
    left = statuses - {"hit"}
    return 0 if not left else 2 if left == {"needs-review"} else 1


def review_all(engines: Iterable[Engine], decision: str) -> dict[str, int]:
    """Decide for every store; counts of recorded, unchanged and failed."""
    totals = {"recorded": 0, "unchanged": 0, "failed": 0}
    for e in engines:
        try:
            for outcome in e.review(decision).values():
                totals["recorded" if outcome == "recorded" else "unchanged"] += 1
        except Exception:
            totals["failed"] += 1
    return totals
