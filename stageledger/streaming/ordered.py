"""Items of many batches, released in order as a stream.

Each key (a batch stage) has a state: the next index to release, and items that came
before their predecessors did. An item is released once, when all below it have been; a
repeated one is dropped. If an index doesn't come until the watermark has passed the
items that wait for it, a timer gives it up and the rest goes on behind the gap.

State lives in the checkpoint, so a stream that stops in between goes on where it was:
whatever the batches, without a gap given up the releases are those of :func:`in_order`
over all items at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import ship

RELEASED = "stage string, index long, item string, gap boolean"
_STATE = "next long, pending string"


def _step(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    expected, pending = (state.get[0], {int(i): x for i, x in json.loads(state.get[1]).items()}) if state.exists else (0, {})
    gap = False
    if state.hasTimedOut:
        gap, expected = True, min(pending)
    else:
        for frame in frames:
            for index, item, at in zip(frame["index"], frame["item"], frame["at"], strict=True):
                if index >= expected:
                    pending.setdefault(int(index), [item, int(pd.Timestamp(at).timestamp() * 1000)])
    rows = []
    while expected in pending:
        item, _ = pending.pop(expected)
        rows.append((key[0], expected, item, gap))
        gap, expected = False, expected + 1
    state.update((expected, json.dumps(pending)))
    if pending:
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, max(at for _, at in pending.values()) + 1))
    yield pd.DataFrame(rows, columns=["stage", "index", "item", "gap"])


def release_in_order(items: DataFrame, patience: str = "10 minutes") -> DataFrame:
    """``RELEASED`` from a stream of (stage, index, item, at); ``gap``: an index before this one was given up."""
    ship(items.sparkSession)
    kept = items.select(F.col("stage").cast("string").alias("stage"), F.col("index").cast("long").alias("index"), F.col("item").cast("string").alias("item"), F.col("at").cast("timestamp").alias("at"))
    kept = kept.where("stage is not null and index >= 0 and at is not null").withWatermark("at", patience)
    return kept.groupBy("stage").applyInPandasWithState(_step, RELEASED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def in_order(items: DataFrame) -> DataFrame:
    """The same of a whole table: each stage's items up to the first index that is missing."""
    own = items.where("stage is not null and index >= 0 and at is not null").dropDuplicates(["stage", "index"])
    place = F.row_number().over(Window.partitionBy("stage").orderBy("index")) - 1
    return own.withColumn("_p", place).where("_p = index").select(F.col("stage").cast("string").alias("stage"), F.col("index").cast("long").alias("index"), F.col("item").cast("string").alias("item"), F.lit(False).alias("gap"))
