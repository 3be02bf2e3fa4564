import pytest
from pyspark.sql import functions as F

from stageledger import Outputs, Pipeline, stage
from stageledger.plans.engine import Engine, fingerprint


def counted(spark, seen):
    """100 rows that count themselves whenever they are made."""

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return spark.range(100, numPartitions=3).mapInArrow(run, "id long").withColumn("text", F.concat(F.lit("t"), "id"))


def pipeline(make):
    class Split(Pipeline):
        @stage()
        def parts(ctx):
            return make(ctx)

        @stage(needs=parts)
        def both(ctx):
            even, rest, none = ctx.inputs("parts")
            return even.select("id").unionByName(rest.select("id")).unionByName(none.select("id"))

    return Split


def test_several_outputs_are_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    parts = {"even": ("id % 2 = 0", ["id", F.upper("text").alias("text")]), "rest": (F.col("id") > 90, ["id"]), "none": ("id < 0", ["id", "text"])}
    e = Engine(spark, pipeline(lambda ctx: Outputs(counted(spark, seen), lambda: parts)), str(tmp_path / "out"))
    assert [o["ran"] for o in e.run()] == [True, True]
    assert seen.value == 100  # one scan of the source for three outputs
    artifacts = e.store.read("stages", "parts")["artifacts"]
    assert [(a["name"], a["columns"]) for a in artifacts] == [("even", ["id", "text"]), ("rest", ["id"]), ("none", ["id", "text"])]
    for a, rows in zip(artifacts, ([(i, f"T{i}") for i in range(0, 100, 2)], [(i,) for i in range(91, 100)], []), strict=True):
        found = spark.read.parquet(a["path"]).select(*a["columns"])
        assert sorted(map(tuple, found.collect())) == rows and a["fingerprint"] == fingerprint(found)
    assert spark.read.parquet(e.store.read("stages", "both")["artifacts"][0]["path"]).count() == 59
    assert [p["status"] for p in e.probe(rehash=True)] == ["hit", "hit"]
    assert [o["ran"] for o in e.run()] == [False, False]


def test_order_of_outputs_counts_and_loss_shows(spark, tmp_path):
    parts = {"a": ("id < 5", ["id"]), "b": ("id >= 5", ["id"]), "c": ("true", ["id"])}
    order = list(parts)
    e = Engine(spark, pipeline(lambda ctx: Outputs(spark.range(9), {k: parts[k] for k in order})), str(tmp_path / "out"))
    e.run()
    path = e.store.read("stages", "parts")["artifacts"][1]["path"]
    spark.range(2).write.mode("overwrite").parquet(path)
    first, second = e.probe()
    assert (first["status"], first["reason"]) == ("needs-run", "artifact-changed") and second["reason"] == "upstream 'parts' changed"
    order.reverse()
    assert [o["ran"] for o in e.run()] == [True, True]


def test_what_outputs_refuse(spark, tmp_path):
    for parts, error in (({"a": ("true", ["id"]), "b": ("true", [F.lit("x").alias("id")])}, "two types"), ({"a/b": ("true", ["id"])}, "output's name")):
        with pytest.raises((TypeError, ValueError), match=error):
            Engine(spark, pipeline(lambda ctx, parts=parts: Outputs(spark.range(3), parts)), str(tmp_path / error.replace(" ", ""))).run()
