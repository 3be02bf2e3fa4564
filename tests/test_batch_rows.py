import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stageledger import Pipeline, batch_stage, stage
from stageledger.plans.engine import Engine


class Rows(Pipeline):
    fail_after, seen = None, None

    @batch_stage()
    def parts(ctx):
        left = ctx.remaining(ctx.spark.range(40).select(F.col("id").alias("index"), (F.col("id") * 10).alias("value")))
        for half in (0, 1):  # two jobs, twenty items each
            made = left.where(F.col("index") % 2 == half)
            yield made.withColumn("twice", F.col("value") * 2) if Rows.seen is None else counted(made)
            if Rows.fail_after == half:
                raise RuntimeError("stop")

    @stage(needs=parts)
    def whole(ctx):
        return ctx.union("parts").drop("position")


def counted(df):
    seen = Rows.seen

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.withColumn("twice", F.col("value") * 2).mapInArrow(run, "index long, value long, twice long")


def result(spark, e):
    found = spark.read.parquet(e.store.read("stages", "whole")["artifacts"][0]["path"])
    return sorted(map(tuple, found.select("index", "value", "twice").collect()))


def test_only_what_is_missing_is_done_again(spark, tmp_path, monkeypatch):
    e = Engine(spark, Rows, str(tmp_path / "out"))
    monkeypatch.setattr(Rows, "fail_after", 0)
    with pytest.raises(RuntimeError, match="stop"):
        e.run()
    first = e.probe()[0]
    assert first["status"] == "failed" and first["action"] == "resume"
    commit = e.store.partial("parts", first["key"])[0]
    shutil.rmtree(Path(commit["path"]) / "index=4")  # lost
    changed = Path(commit["path"]) / "index=6"
    shutil.rmtree(changed)
    spark.createDataFrame([(60, 999)], "value long, twice long").write.parquet(str(changed))  # altered
    monkeypatch.setattr(Rows, "fail_after", None)
    monkeypatch.setattr(Rows, "seen", spark.sparkContext.accumulator(0))
    assert [o["ran"] for o in e.run()] == [True, True]
    assert Rows.seen.value == 22  # twenty odd items, the lost one and the altered one
    assert result(spark, e) == [(i, i * 10, i * 20) for i in range(40)]
    assert len(e.store.read("stages", "parts")["artifacts"]) == 3
    assert [p["status"] for p in e.probe(rehash=True)] == ["hit", "hit"]


def test_a_run_without_trouble(spark, tmp_path):
    e = Engine(spark, Rows, str(tmp_path / "out"))
    e.run()
    assert result(spark, e) == [(i, i * 10, i * 20) for i in range(40)]
    assert len(e.store.read("stages", "parts")["artifacts"]) == 2 and not list((tmp_path / "out" / "data" / "parts").glob("*-sums"))
    assert [o["ran"] for o in e.run()] == [False, False]
    assert len(e.run(force=True)) == 2 and result(spark, e)[-1] == (39, 390, 780)
