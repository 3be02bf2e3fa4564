"""The probe: keys, reasons, baselines and statuses of all stages in one plan of joins.

The driver lays down what it alone can know, a row per stage (source fingerprints, config
fields, values, the record's fields), and the relations around it: needs, artifacts with
what is stored now, batch checkpoints, recorded parts. Everything that follows from these
is joined and decided here, by the same operators as over any other tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators import batch, decide, keys

#: A row per stage. ``inputs`` and ``values`` map names to canonical JSON, ``config`` fields too.
STATE = """stage string, base string, kind string, ord long, rerun string, review string, error string, outdated boolean,
 config map<string,string>, inputs map<string,string>, `values` map<string,string>,
 success boolean, recorded_key string, recorded_access array<string>, recorded_rerun string, recorded_review string, elapsed double,
 attempt_key string, attempt_review string, failure_key string, failure_review string, decided string, decided_review string"""
_NAMES = [x.split()[0].strip("`") for x in STATE.replace("string,string", "").split(",")]
ACCESS, RERUN = _NAMES.index("recorded_access"), _NAMES.index("recorded_rerun")
#: ``position`` only where needs fan in.
NEEDS = "stage string, need string, position long"
#: Artifacts of every recorded stage; a row of place -1 says that there is a record.
ARTIFACTS = "stage string, place long, name string, recorded string, now string"
#: Artifacts of every batch checkpoint.
PARTIAL = "stage string, key string, index long, path string, recorded string, now string"
#: What recorded keys were made of.
PARTS = "stage string, kind string, name string, value string"

#: What was read again of a probed stage whose key moved.
FOUND = "stage string, rerun string, projected map<string,string>, inputs map<string,string>, `values` map<string,string>, up map<string,string>"

MARK = -1
MOVED = "key changed"


@dataclass
class Relations:
    """``partial`` is None if there is no checkpoint at all."""

    state: DataFrame
    needs: DataFrame
    artifacts: DataFrame
    partial: DataFrame | None


def relation(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver knows, as a local table: Spark knows its size and broadcasts it where it joins."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    entries = lambda column, kind: [None if v is None else list(v.items()) for v in column] if pa.types.is_map(kind) else column
    return spark.createDataFrame(pa.table([pa.array(entries(c, f.type), f.type) for c, f in zip(columns, fields, strict=True)], names=fields.names))


def _once(make: Callable[..., list[Column]]) -> Callable[..., list[Column]]:
    """Columns by name don't depend on a plan: they are made once per Spark application."""
    made: dict[tuple, list[Column]] = {}

    def found(*args: bool) -> list[Column]:
        at = (SparkContext._active_spark_context.applicationId, *args)
        if at not in made:
            made[at] = make(*args)
        return made[at]

    return found


@_once
def _stored_columns() -> list[Column]:
    now = F.coalesce("now", "recorded")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "place", "name", now).cast("decimal(38,0)")).cast("string")
    real = F.col("place") != MARK
    return [
        F.concat_ws(":", F.count("*").cast("string"), total(17), total(42)).alias("root"),
        F.bool_or(real & F.col("now").isNull()).alias("gone"),
        F.bool_or(real & F.col("now").isNotNull() & (F.col("now") != F.col("recorded"))).alias("differs"),
    ]


def stored(artifacts: DataFrame) -> DataFrame:
    """(stage, root, gone, differs): a digest of a stage's artifacts with their places, and what became of them.

    Sums of hashes, so a batch of any number of indexes is no row of its own; places are
    hashed, so order counts.
    """
    return artifacts.groupBy("stage").agg(*_stored_columns())


@_once
def _around_columns() -> list[Column]:
    text = F.concat("root", F.coalesce(F.concat(F.lit("@"), F.col("position").cast("string")), F.lit("")))
    entries = F.array_sort(F.collect_list(F.when(~F.col("own") & F.col("root").isNotNull(), F.struct("need", text.alias("value")))))
    own = lambda c: F.coalesce(F.bool_or(F.col("own") & F.col(c)), F.lit(False)).alias(c)
    return [F.map_from_entries(entries).alias("up"), F.bool_or(~F.col("own") & F.col("root").isNull()).alias("orphan"), own("gone"), own("differs")]


def around(state: DataFrame, needs: DataFrame, roots: DataFrame) -> DataFrame:
    """(stage, up, orphan, gone, differs): the needs' roots by name, whether one has none, and a stage's own artifacts.

    A stage counts among its own neighbours here, so that one join and one aggregate do both.
    """
    every = needs.withColumn("own", F.lit(False)).unionByName(state.select("stage", F.col("stage").alias("need"), F.lit(None).cast("long").alias("position"), F.lit(True).alias("own")))
    both = every.join(roots.withColumnRenamed("stage", "need"), "need", "left")
    return both.groupBy("stage").agg(*_around_columns())


def key(config: Column) -> Column:
    return keys.input_key(keys.canonical_json(config), keys.canonical_json(F.col("inputs")), keys.canonical_json(F.col("values")), keys.canonical_json(F.col("up")), F.col("rerun"))


@_once
def _access_columns() -> list[Column]:
    access = F.when(F.col("recorded_rerun").eqNullSafe(F.col("rerun")), F.col("recorded_access"))
    return [access.alias("access"), keys.project(F.col("config"), access).alias("projected")]


@_once
def _key_columns() -> list[Column]:
    known = F.col("error").isNull() & ~F.col("orphan")
    return [F.when(known, key(F.col("projected"))).alias("key"), F.when(known, key(F.col("config"))).alias("whole")]


def keyed(state: DataFrame, needs: DataFrame, roots: DataFrame) -> DataFrame:
    """``state`` with access, projected config, up, orphan, gone, differs, and the keys of the projected and of the whole config."""
    return state.join(around(state, needs, roots), "stage").select("*", *_access_columns()).select("*", *_key_columns())


def valid_partial(partial: DataFrame) -> DataFrame:
    """(stage, key, indexes): checkpoints whose every artifact still is what was recorded."""
    recorded = partial.select("stage", "key", "index", "path", F.col("recorded").alias("content_hash"))
    current = partial.select("path", F.col("now").alias("content_hash")).distinct()
    return batch.valid(recorded, current, ["stage", "key", "index"]).where("valid").groupBy("stage", "key").agg(F.sort_array(F.collect_list("index")).alias("indexes"))


def taken_up(found: DataFrame, valid: DataFrame | None) -> DataFrame:
    """With ``indexes`` and ``whole_indexes``; what was begun under the whole config is taken up under it."""
    if valid is None:
        none = F.lit(None).cast("array<long>")
        return found.select("*", none.alias("indexes"), none.alias("whole_indexes"))
    found = found.join(valid, ["stage", "key"], "left")
    found = found.join(valid.select("stage", F.col("key").alias("whole"), F.col("indexes").alias("whole_indexes")), ["stage", "whole"], "left")
    mark = F.coalesce("attempt_key", "failure_key")
    begun = F.col("access").isNotNull() & F.col("indexes").isNull() & F.col("whole_indexes").isNotNull() & (mark == F.col("whole")) & (mark != F.col("key"))
    pick = lambda a, b: F.when(begun, F.col(b)).otherwise(F.col(a))
    return found.withColumns({"key": pick("key", "whole"), "projected": pick("projected", "config"), "indexes": pick("indexes", "whole_indexes")})


def parts_of(found: DataFrame) -> DataFrame:
    """(stage, kind, name, value) of what the keys are made of."""
    one = lambda kind, m: F.transform(F.map_entries(m), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("value")))
    source = F.array(F.struct(F.lit("source").alias("kind"), F.lit("code").alias("name"), F.col("rerun").alias("value")))
    every = F.concat(source, *[one(k, m) for k, m in (("config", "projected"), ("value", "values"), ("input", "inputs"), ("upstream", "up"))])
    return found.select("stage", F.inline(every))


def changes(found: DataFrame, parts: DataFrame) -> DataFrame:
    """(stage, reason): what first explains that a stage's recorded ``parts`` aren't those of ``found`` (as probed)."""
    short = lambda c: F.coalesce(F.substring(c, 1, 40), F.lit("absent"))
    text = F.when(F.col("kind") == "upstream", F.concat(F.lit("upstream '"), "name", F.lit("' changed")))
    text = text.otherwise(F.concat("kind", F.lit(": "), "name", F.lit(" "), short(F.col("_o")), F.lit(" -> "), short(F.col("_n"))))
    return decide.first_difference(parts, parts_of(found), text)


def _result(status: str, reason: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), reason.alias("reason"))


@_once
def _match_columns() -> list[Column]:
    return [F.coalesce(F.col("recorded_key") == F.col("key"), F.lit(False)).alias("matches"), F.col("indexes").isNotNull().alias("begun")]


@_once
def _decided_columns() -> list[Column]:
    c = F.col
    made = decide.decide(c("failure_key").isNotNull(), c("attempt_key").isNotNull(), c("begun"), c("success"), c("matches"), c("gone"), c("differs"), F.lit(MOVED))
    made = F.when(c("orphan"), _result("needs-run", F.lit("no-cache"))).otherwise(made)
    reusable = c("success") & ~c("gone") & ~c("differs") & c("matches")
    baseline = decide.provenance(c("key"), c("attempt_key"), c("attempt_review"), c("failure_key"), c("failure_review"), c("recorded_review"), reusable)
    return [made.alias("m"), decide.relationship(baseline, c("review")).alias("relationship"), F.when(c("decided_review") == c("review"), c("decided")).alias("decision")]


@_once
def _error_columns() -> list[Column]:
    c = F.col
    return [F.when(c("error").isNotNull(), _result("error", c("error"))).when(c("outdated") & (c("m.reason") == "no-cache"), _result("needs-run", F.lit("schema-migration"))).otherwise(c("m")).alias("d")]


@_once
def _overlay_columns(force: bool) -> list[Column]:
    c = F.col
    invalidated = (c("relationship") == "changed") & c("decision").eqNullSafe("invalidate")
    return [decide.overlay(c("d.status"), c("d.reason"), F.lit(force), invalidated, c("begun")).alias("x")]


@_once
def _told_columns() -> list[Column]:
    c = F.col
    return [
        *map(c, "stage base ord elapsed relationship decision rerun key whole indexes whole_indexes projected config inputs values up".split()),
        c("review").alias("review_fingerprint"),
        c("d.status").alias("execution"), c("d.reason").alias("execution_reason"),
        c("x.status").alias("action"), c("x.reason").alias("action_reason"),
        decide.effective(c("d.status"), c("relationship"), c("decision")).alias("status"),
        decide.effective_reason(c("d.reason"), c("relationship"), c("decision")).alias("reason"),
    ]


def probed(r: Relations, force: bool = False) -> DataFrame:
    """One row per stage of ``state``: statuses, reasons, and what an execution needs.

    The reason ``MOVED`` stands for a first difference, which :func:`changes` words.
    """
    found = taken_up(keyed(r.state, r.needs, stored(r.artifacts)), valid_partial(r.partial) if r.partial is not None else None)
    for columns in (_match_columns(), _decided_columns(), _error_columns(), _overlay_columns(force)):
        found = found.select("*", *columns)
    return found.select(*_told_columns())
