"""Stage graphs as relations: expansion, alignment, selection, closures, levels.

Axis domains are small and declared, so products are between declared domains and
never between data. Closures and levels deal the edges out in blocks of about ``BLOCK``
rows, one for each task; a round goes as deep as each block does and ends in a written
table, so that a graph of one block takes one round however deep it is, a larger one as
many as its paths cross blocks. Rows stay linear in the edges. The engine's own stage
graph, a few hundred stages, is walked on the driver (``stageledger.plans.engine``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, materialize, ship

#: Edges that one task walks: some 100 MB.
BLOCK = 500_000
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
SAFE_ID = r"^[A-Za-z0-9._-]+$"


def axis(rows: DataFrame, column: str) -> DataFrame:
    """(id, ord): distinct ids of a column in order of value. A domain is declared, hence small."""
    ids = rows.select(F.col(column).cast("string").alias("id")).where("id is not null").distinct()
    return ids.select("id", (F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("ord"))


def active(domain: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested ids in declared order, whatever order they came in."""
    kept = domain.join(requested.select("id").distinct(), "id", "left_semi")
    return kept.select("id", (F.row_number().over(Window.orderBy("ord")) - 1).cast("long").alias("ord"))


def cell_name(base: str, axes: list[str]) -> Column:
    return F.concat(F.lit(f"{base}@"), F.concat_ws(",", *[F.concat(F.lit(f"{a}="), F.col(a)) for a in axes]))


def cell_path(base: str, axes: list[str]) -> Column:
    return F.concat_ws("/", F.lit(f"matrix/{base}"), *[F.concat(F.lit(f"{a}="), F.col(a)) for a in axes])


def expand(base: str, domains: dict[str, DataFrame]) -> DataFrame:
    """One row per cell: axis columns, name, path and position in declaration order."""
    named = [d.select(F.col("id").alias(a), F.col("ord").alias(f"_{a}")) for a, d in domains.items()]
    cells = reduce(lambda left, right: left.join(right, F.lit(True)), named)  # declared domains only
    axes = list(domains)
    place = (F.row_number().over(Window.orderBy(*[f"_{a}" for a in axes])) - 1).cast("long")
    return cells.select(*axes, cell_name(base, axes).alias("cell"), cell_path(base, axes).alias("path"), place.alias("position"))


def align(down: DataFrame, up: DataFrame, down_axes: list[str], up_axes: list[str]) -> DataFrame:
    """(cell, need, position): cells that agree on the shared axes; axes of the upstream alone fan in."""
    shared = [a for a in down_axes if a in up_axes]
    left = down.select(*shared, "cell")
    right = up.select(*shared, F.col("cell").alias("need"), F.col("position").alias("_p"))
    both = left.join(right, shared) if shared else left.join(right, F.lit(True))
    place = (F.row_number().over(Window.partitionBy("cell").orderBy("_p")) - 1).cast("long")
    return both.select("cell", "need", place.alias("position"))


def select_cells(cells: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """OR within an axis, AND across axes; an axis left out is a wildcard."""
    return cells.where(reduce(lambda a, b: a & b, (F.col(a).isin(ids) for a, ids in wanted.items()), F.lit(True)))


def _blocks(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """Rows in ``k`` tasks of about BLOCK each; a hub's rows may lie in several."""
    return rows.coalesce(1) if k == 1 else rows.repartitionByRange(k, *by)


def _block_count(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // BLOCK))


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, t, reached): what the block's own edges reach from its reached ends, as (stage)."""
    ahead: dict[str, list[str]] = {}
    stack: list[str] = []
    for batch in batches:
        for h, t, reached in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ahead.setdefault(h, []).append(t)
            if reached:
                stack.append(h)
    seen, found = set(stack), []
    stack = list(seen)
    while stack:
        for t in ahead.get(stack.pop(), ()):
            if t not in seen:
                seen.add(t)
                found.append(t)
                stack.append(t)
    for lo in range(0, len(found), 10_000):
        yield pa.RecordBatch.from_pydict({"stage": found[lo : lo + 10_000]})


def closure(edges: DataFrame, seeds: DataFrame, up: bool = True) -> DataFrame:
    """(stage): the seeds and all that they need (``up``) or that needs them, on graphs of any depth, cycles too.

    A round spreads through each block of edges as far as the block goes; another follows
    while something crossed from one block into the next. Null ends are no edges.
    """
    spark = edges.sparkSession
    ship(spark)
    here, there = ("stage", "need") if up else ("need", "stage")
    edges = edges.select(F.col(here).alias("h"), F.col(there).alias("t")).where("h is not null and t is not null")
    k = _block_count(edges)
    if k > 1:  # read again each round
        edges = materialize(edges, "edges")
    reached = materialize(seeds.select("stage").where("stage is not null").distinct(), "reached")
    while True:
        flagged = edges.join(reached.select(F.col("stage").alias("h"), F.lit(True).alias("reached")), "h", "left").select("h", "t", "reached")
        found = _blocks(flagged, k, "h", "t").mapInArrow(_reach, "stage string")
        if k == 1:
            return reached.unionByName(found.join(reached, "stage", "left_anti"))
        new = materialize(found.distinct().join(reached, "stage", "left_anti"), "reached")
        if new.isEmpty():
            for x in (new, edges):
                discard(x)
            return reached
        whole = materialize(reached.unionByName(new), "reached")
        for x in (reached, new):
            discard(x)
        reached = whole


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, p, d): pointers followed as far as they lead within the block; p null on a cycle."""
    to: dict[str, tuple[str, int]] = {}
    for batch in batches:
        for v, p, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            to[v] = (p, d)
    end: dict[str, tuple[str | None, int]] = {}
    for v in to:
        path, on = [], set()
        while v in to and v not in end and v not in on:
            path.append(v)
            on.add(v)
            v = to[v][0]
        at: tuple[str | None, int] = (None, 0) if v in on else end.get(v, (v, 0))
        for x in reversed(path):
            at = end[x] = (None, 0) if at[0] is None else (at[0], at[1] + to[x][1])
    found = list(end.items())
    for lo in range(0, len(found), 10_000):
        part = found[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in part], pa.string()), pa.array([e[0] for _, e in part], pa.string()), pa.array([e[1] for _, e in part], pa.int64())], names=["v", "p", "d"])


def _cycle(names: DataFrame) -> None:
    """An error that names some of what is left."""
    found = [r.stage for r in names.select("stage").distinct().orderBy("stage").limit(5).collect()]
    if found:
        raise ValueError(f"the stages form a cycle, or need one: {', '.join(found)}")


def _anchors(singles: DataFrame) -> DataFrame:
    """(v, p, d), written: for stages with one need, the first stage on the way that has none or several, and the steps to it.

    Pointers are followed within blocks, then doubled over the blocks' ends: a chain of n
    stages takes log n rounds at most. Pointers that never end are a cycle.
    """
    k = _block_count(singles)
    at = materialize(_blocks(singles, k, "v").mapInArrow(_compress, "v string, p string, d long"), "pointers")
    _cycle(at.where("p is null").select(F.col("v").alias("stage")))
    for _ in range(0 if k == 1 else 64):
        ends = at.select(F.col("v").alias("p"), F.col("p").alias("q"), F.col("d").alias("e"))
        moving = at.join(ends, "p")
        if moving.isEmpty():
            return at
        _cycle(moving.where("q = v").select(F.col("v").alias("stage")))
        further = materialize(at.join(ends, "p", "left").select("v", F.coalesce("q", "p").alias("p"), (F.col("d") + F.coalesce("e", F.lit(0))).alias("d")), "pointers")
        discard(at)
        at = further
    if k > 1:
        _cycle(at.select(F.col("v").alias("stage")).join(at.select(F.col("p").alias("stage")), "stage", "left_semi"))
    return at


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stage, low, open, need, w): levels of the stages whose open needs all get theirs within the block."""
    low: dict[str, int] = {}
    left: dict[str, int] = {}
    users: dict[str, list[tuple[str, int]]] = {}
    for batch in batches:
        for stage, least, n, need, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low[stage], left[stage] = least, left.get(stage, n)
            if need is not None:
                users.setdefault(need, []).append((stage, w))
    ready, found = [s for s, n in left.items() if not n], []
    while ready:
        need = ready.pop()
        found.append((need, low[need]))
        for stage, w in users.get(need, ()):
            low[stage] = max(low[stage], low[need] + w)
            left[stage] -= 1
            if not left[stage]:
                ready.append(stage)
    for lo in range(0, len(found), 10_000):
        part = found[lo : lo + 10_000]
        yield pa.RecordBatch.from_pydict({"stage": [s for s, _ in part], "level": [n for _, n in part]})


def levels(edges: DataFrame) -> DataFrame:
    """(stage, level): longest path from a stage without needs. A cycle is an error that names it.

    Chains are contracted: a stage with one need is so many steps above an anchor. What
    has several needs is peeled: each stage counts its open needs, and leaves with its
    level when none is left. A round peels each block of edges as deep as the block goes,
    so rounds follow the blocks, not the depth; what is never peeled is a cycle. A stage
    whose needs lie in several blocks waits for the counts. Null ends are no edges.
    """
    ship(edges.sparkSession)
    edges = materialize(edges.select("stage", "need").where("stage is not null and need is not null"), "edges")
    ends = edges.groupBy("stage").agg(F.min("need").alias("a"), F.max("need").alias("b"))
    pointers = _anchors(ends.where("a = b").select(F.col("stage").alias("v"), F.col("a").alias("p"), F.lit(1).cast("long").alias("d")))
    several = ends.where("a < b").select("stage")
    over = pointers.select(F.col("v").alias("need"), "p", "d")
    core = edges.join(several, "stage", "left_semi").join(over, "need", "left")
    core = materialize(core.groupBy("stage", F.coalesce("p", "need").alias("need")).agg((1 + F.max(F.coalesce("d", F.lit(0)))).cast("long").alias("w")), "core")
    roots = edges.select(F.col("need").alias("stage")).join(edges.select("stage"), "stage", "left_anti").distinct()
    known = materialize(roots.select("stage", F.lit(0).cast("long").alias("level")), "levels")
    rest, k = core, _block_count(core)
    while not rest.isEmpty():
        judged = rest.join(known.select(F.col("stage").alias("need"), "level"), "need", "left")
        counted = judged.groupBy("stage").agg(F.coalesce(F.max(F.col("level") + F.col("w")), F.lit(0)).alias("low"), F.count_if(F.col("level").isNull()).alias("open"))
        still = judged.where("level is null").select("stage", "need", "w")
        rows = counted.join(still, "stage", "left").select("stage", "low", "open", "need", "w")
        new = materialize(_blocks(rows, k, "stage", "need").mapInArrow(_peel, "stage string, level long"), "levels")
        left = materialize(rest.join(new, "stage", "left_anti"), "core")
        if new.isEmpty():
            _cycle(left)
        both = materialize(known.unionByName(new), "levels")
        for x in (rest, known, new):
            discard(x)
        rest, known = left, both
    for x in (rest, edges):
        discard(x)
    above = pointers.join(known.select(F.col("stage").alias("p"), "level"), "p").select(F.col("v").alias("stage"), (F.col("level") + F.col("d")).alias("level"))
    return known.unionByName(above)


def unknown_needs(edges: DataFrame, stages: DataFrame) -> DataFrame:
    return edges.join(stages.select(F.col("stage").alias("need")), "need", "left_anti").select("stage", "need")


def missing_upstream(edges: DataFrame, records: DataFrame) -> DataFrame:
    """For each stage, its first need (by position) without a record."""
    gone = edges.join(records.select(F.col("stage").alias("need")), "need", "left_anti")
    return gone.groupBy("stage").agg(F.min(F.struct("position", "need")).alias("first")).select("stage", F.col("first.need").alias("missing"))


def plan_edges(edges: DataFrame, selected: DataFrame) -> DataFrame:
    inner = selected.select("stage")
    return edges.join(inner, "stage", "left_semi").join(inner.withColumnRenamed("stage", "need"), "need", "left_semi").select("stage", "need")


def needs_summary(edges: DataFrame, k: int = 2) -> DataFrame:
    """First k needs and "+N more"; ranks are cut per stage before anything is joined."""
    ranked = edges.withColumn("_r", F.row_number().over(Window.partitionBy("stage").orderBy("position", "need")))
    found = ranked.groupBy("stage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= k, F.struct("_r", "need")))), lambda x: x["need"]), ", ").alias("_n"), F.count("*").alias("n"))
    return found.select("stage", F.when(F.col("n") > k, F.concat("_n", F.lit(" +"), (F.col("n") - k).cast("string"), F.lit(" more"))).otherwise(F.col("_n")).alias("needs"))


def external_blockers(edges: DataFrame, selected: DataFrame, statuses: DataFrame) -> DataFrame:
    """Upstreams of a selection, outside it, that are not hits."""
    outside = closure(edges, selected).join(selected.select("stage"), "stage", "left_anti")
    return outside.join(statuses, "stage", "left").select("stage", F.coalesce("status", F.lit("needs-run")).alias("status")).where("status <> 'hit'")


def pick_selector(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact module names first, else those without their ``.__main__``."""
    stripped = F.regexp_replace("module", r"\.__main__$", "")
    both = wanted.join(rows.withColumn("_s", stripped), (F.col("wanted") == F.col("module")) | (F.col("wanted") == F.col("_s")))
    return both.groupBy("wanted").agg(F.min(F.struct(F.when(F.col("wanted") == F.col("module"), 0).otherwise(1).alias("p"), "module")).alias("b")).select("wanted", F.col("b.module").alias("module"))


def ordered_distinct(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
